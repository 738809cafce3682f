"""Conversation repair, spelling variants and exact deduplication against brute force and on odd inputs."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from corpuslint.llm import op11_conversation_repair as op11
from corpuslint.llm import op12_spelling_variants as op12
from corpuslint.llm import op13_exact_dedup as op13

WHITE = " \t\n\x0b\f\r"
DOCS = "doc_id long, text string, norm string, digest int, best string, word string, n long"


# ------------------------------------------------------------------ conversations

def _damage(rows):
    out = []
    for conv, turn, role, text in rows:
        conv_s, turn_s = (" " if v is None else str(v) for v in (conv, turn))
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(f"{conv_s}:{turn_s}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(turn, role, text)] * (2 if kind == 3 else 1)
    digest = lambda r, t: hashlib.sha256(f"{hashlib.sha256(r.encode()).hexdigest()}:{hashlib.sha256(t.encode()).hexdigest()}".encode()).digest()
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r[1], r[2])))


def _faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(WHITE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def _applied(audit_and_roles, rows):
    """The repaired rows, or None if the edits do not fit."""
    out, k = [], 0
    for letter, role in audit_and_roles:
        if letter == "I":
            out.append((role, ""))
            continue
        if k == len(rows):
            return None
        _, own, text = rows[k]
        k += 1
        if letter != "D":
            out.append((own if letter == "K" else role, text))
    return out if k == len(rows) else None


def _cheapest(rows, faults):
    """(cost, audit, repaired) by a plain search over suffixes."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(None)
    def best(k, state, inserts):
        found = [(0, "", ())] if k == len(rows) and state in ("", "a") else []
        moves = [("I", r, 5, k) for r in ("user", "assistant")] if inserts < 3 else []
        if k < len(rows):
            moves.append(("D", None, 2, k + 1))
            if faults[k] not in ("blank", "duplicate"):
                more = 5 if faults[k] == "truncated" else 0
                moves += [("K", rows[k][1], more, k + 1)] + [("R", r, 1 + more, k + 1) for r in ("user", "assistant")]
        for letter, role, price, nxt in moves:
            to = state if letter == "D" else step.get((state, role[:1]))
            if to is None:
                continue
            rest = best(nxt, to, inserts + 1 if letter == "I" else 0)
            if rest:
                found.append((price + rest[0], letter + rest[1], (role,) + rest[2]))
        return min(found) if found else None

    cost, audit, roles = best(0, "", 0)
    return cost, audit, _applied(list(zip(audit, roles)), rows)


def _expected(rows):
    rows = _damage(rows)
    faults = _faults(rows)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, repaired = _cheapest(rows, faults)
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha)


CONV = "conv_id long, turn long, role string, text string, times long, audit string, dig string"


def _conversations(rnd, count, longest):
    rows = []
    for conv in range(count):
        for turn in range(rnd.randint(1, longest)):
            role = rnd.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""])
            text = rnd.choice(["Hi.", "yes", "What? ", "a\n", "", "  ", None, "so!", "ümlaut.", f"t{turn}."])
            rows.append((conv, rnd.choice([turn, turn, turn + 3, None]), role, text))
    return rows


def test_repair_matches_plain_search(spark):
    rnd = random.Random(5)
    rows = _conversations(rnd, 150, 12)
    rows += [(None, t, r, x) for t, r, x in [(1, "user", "Hi."), (2, "assistant", "Yes."), (None, "user", "no")]]
    rows += [rows[3], rows[3], rows[40]]  # repeated whole
    df = spark.createDataFrame([(*r, 7, "x", "y") for r in rows], CONV).repartition(3)
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in op11.conversation_repair(df).collect()}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    assert set(got) == set(by)
    assert {c: got[c] for c in by} == {c: _expected(rs) for c, rs in by.items()}
    shown = {}
    for r in op11.repaired_rows(df).orderBy("conv_id", "n").collect():
        shown.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert all(hashlib.sha256("\n".join(shown.get(c, [])).encode()).hexdigest() == got[c][-1] for c in by)


def test_audit_is_the_least_of_all_edit_strings():
    """Every string of edits of short conversations is tried."""
    symbols = [("s", "o"), ("u", "o"), ("a", "o"), ("t", "o"), ("u", "t"), ("", "x")]
    powers = op11.Powers()
    for n in range(4):
        for conv in itertools.product(symbols, repeat=n):
            found = []
            for size in range(n + 4):
                for audit in itertools.product("DIKR", repeat=size):
                    if sum(c != "I" for c in audit) != n:
                        continue
                    cost, initials, k = 0, "", 0
                    for c in audit:
                        own = conv[k] if c != "I" else None
                        k += c != "I"
                        if c == "D":
                            cost += 2
                        elif own and own[1] == "x":
                            cost = None
                            break
                        else:
                            cost += {"I": 5, "K": 0, "R": 1}[c] + (5 if own and own[1] == "t" else 0)
                            initials += own[0] if c == "K" else "?"
                    if cost is None:
                        continue
                    rx = re.compile("(s?(ua)+)?")
                    if any(rx.fullmatch(initials.replace("?", "{}").format(*fill)) for fill in itertools.product("ua", repeat=initials.count("?"))):
                        found.append((cost, "".join(audit)))
            runs = [(s, len(list(g))) for s, g in itertools.groupby(conv)]
            assert op11.repair(runs, powers) == min(found)


def test_long_runs_cross_by_powers():
    powers = op11.Powers()
    n = 3 * op11.PIECE + 17
    cost, audit = op11.repair([(("u", "o"), n), (("", "x"), 5000), (("a", "o"), n + 1)], powers)
    assert cost == sum({"D": 2, "I": 5, "K": 0, "R": 1}[c] for c in audit)
    assert audit.count("D") >= 5000 and len(audit) == 2 * n + 1 + 5000 + audit.count("I")
    assert all(len(p) <= n.bit_length() for p in powers.known.values())


def test_repair_of_no_rows(spark):
    empty = spark.createDataFrame([], CONV)
    assert op11.conversation_repair(empty).count() == 0
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    one = op11.conversation_repair(spark.createDataFrame([(conv, 0, "user", "Hi.", 1, "", "")], CONV)).collect()
    assert [(r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) for r in one] == [(0, 0, 0, 0, 0, 0, "")]
    assert one[0].repaired_sha256 == hashlib.sha256(b"").hexdigest()


# ------------------------------------------------------------------ spelling

def _one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def _variants(rows):
    seen = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            seen[run] += 1
    words = {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}
    near = {w: [x for x in words if abs(len(x) - len(w)) < 2 and _one_edit(w, x)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


def _corpus(rnd):
    base = ["".join(rnd.choice("abé") for _ in range(rnd.randint(7, 10))) for _ in range(60)]
    base += ["Straße" + "nbahn", "aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab", "babababa", "ÀÉÎÕÜÝþ", "x" * 400, "x" * 401, "x" * 399 + "y"]
    words = []
    for w in base:
        words += [w] * rnd.choice([1, 2, 3, 30, 40, 500])
        for _ in range(3):  # variants
            at = rnd.randrange(len(w))
            words += [rnd.choice([w[:at] + w[at + 1:], w[:at] + "b" + w[at:], w[:at] + "c" + w[at + 1:]])] * rnd.choice([2, 3])
    rnd.shuffle(words)
    texts = [rnd.choice([" ", ", ", "\n"]).join(words[i: i + 50]) for i in range(0, len(words), 50)]
    return [(i if i != 4 else None, t) for i, t in enumerate(texts)] + [(90, None), (91, ""), (92, "short ones 123456789 Ωmega"), (2, texts[2])]


@pytest.mark.parametrize("block", [20_000, 5])
def test_variants_match_brute_force(spark, block):
    rows = _corpus(random.Random(3))
    expected = _variants(rows)
    df = spark.createDataFrame([(i, t, "a", 1, "b", "c", 2) for i, t in rows], DOCS).repartition(3)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in op12.spelling_variants(df, block).collect()}
    assert got == expected
    assert any(f and f != r for f, r, *_ in expected.values())  # chains of forms occur


def test_composition_gives_each_pair_once():
    rnd = random.Random(9)
    words = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randint(0, 6))) for _ in range(90)})
    other = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(0, 5))) for _ in range(90)})
    for right in (words, other):
        pairs = list(op12.one_edit_pairs(op12.Acceptor(words), op12.Acceptor(right)))
        assert len(pairs) == len(set(pairs))
        assert set(pairs) == {(i, j) for i, a in enumerate(words) for j, b in enumerate(right) if _one_edit(a, b)}


def test_acceptor_is_minimal():
    words = sorted("".join(p) for p in itertools.product("abc", repeat=5))
    acceptor = op12.Acceptor(words)
    assert len(acceptor.final) == 6 and acceptor.accepted[acceptor.start] == 243


def test_very_long_words_do_not_recurse(spark):
    long = "ab" * 30_000
    df = spark.createDataFrame([(1, f"{long} {long}"), (2, f"{long}c {long}c {long}c")], "doc_id long, text string")
    expected = _variants([(1, f"{long} {long}"), (2, f"{long}c {long}c {long}c")])
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in op12.spelling_variants(df).collect()} == expected


def test_variants_of_nothing(spark):
    assert op12.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ------------------------------------------------------------------ exact copies

def _groups(rows):
    by = {}
    for doc_id, text in rows:
        by.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc_id is None, doc_id))
    out = []
    for norm, members in by.items():
        best = min(members, key=lambda m: (m[0], m[1], m[2] or 0))
        out += [(m[2], best[2], len(members), hashlib.sha256(norm.encode()).hexdigest()) for m in members]
    return sorted(out, key=repr)


def _copies():
    rnd = random.Random(2)
    rows = [(i, rnd.choice(["a b", "ab", "a\tb ", "A b", None, "", " \n", "é e", "ée", " ", "x" * 50_000, f"own {i}"])) for i in range(400)]
    rows += [(1000 + i, "hot text" + " " * (i % 7)) for i in range(300)] + [(-5, "a b"), (None, "a b"), (None, "null id"), rows[3], rows[3], (2**63 - 1, "edge"), (-2**63, "edge")]
    return rows


@pytest.mark.parametrize("digest", ["whole", "weak"])
def test_exact_dedup_matches_brute_force(spark, digest):
    rows = _copies()
    df = spark.createDataFrame([(i, t, "a", 1, "b", "c", 2) for i, t in rows], DOCS).repartition(5)
    make = (lambda sha: sha) if digest == "whole" else (lambda sha: F.substring(sha, 1, 1))  # one hex digit: different texts collide
    got = op13.exact_dedup(df, make, salts=3).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == _groups(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) and all(r.doc_id == r.keep_id for r in kept)


def test_unique_documents_keep_their_columns(spark):
    rows = _copies()
    df = spark.createDataFrame([(i, t, "a", 1, "b", "c", 2) for i, t in rows], DOCS)
    got = op13.unique_documents(df)
    assert got.columns == df.columns
    best = {}
    for i, t in rows:
        norm, rank = re.sub(r"[\x20\x09-\x0D]", "", t or ""), (-len(t or ""), i is None, i or 0)
        if norm not in best or rank < best[norm][0]:
            best[norm] = (rank, i, t or "")
    assert sorted(((r.doc_id, r.text or "") for r in got.collect()), key=repr) == sorted(((i, t) for _, i, t in best.values()), key=repr)


def test_dedup_of_nothing(spark):
    assert op13.exact_dedup(spark.createDataFrame([], DOCS)).count() == 0
