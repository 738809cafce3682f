"""N-gram Jaccard join by universe partition and the pigeonhole principle.

Sets of word shingles (of SHINGLE words and for PERCENT by default; both are
parameters) fall into size bands. For a band, the universe of shingle
hashes is cut into m segments, where two sets that reach the threshold differ in at
most H shingles and m > H: so at least m - H segments of such a pair are equal, and
a set is indexed by the contents of its segments. An empty segment is worth
nothing, since any two sets may share it. What a set spends on its segments is
decided by cost:

* Up to m - H - 1 empty segments: the others suffice, at one entry each.
* More: every segment of two or more shingles also stands in the index with each
  one of its shingles left out (its one-deletion neighbourhood), which catches a
  difference of one and so is worth two.
* Not enough even so: the set's prefix (its first n - ceil(t n) + 1 shingles in
  hash order) stands in the index as well; two such sets meet there.

Entries are shuffled in PARTS turns, so that only a part of the index is on disk twice,
and of entries with the same sets (the same number, least, largest and two equal sums of hashes) one is kept.

Sets with an equal entry are candidates. An entry's sets are not expanded into
pairs: each entry names one of its sets (the smallest id), and each set is compared with the one
that most of its entries name; the links found give components. Where an entry's sets then still lie in several
components, up to FEW sets are resolved exactly, by the pairs across components. For larger
entries up to STAR_ROUNDS further rounds do the same, with another order of the sets in each,
as long as a FRUITFUL share of the pairs links;
what is still open after that is resolved exactly by a prefix filter in frequency order among
their sets, of whose pairs, if many, a share is compared first (SHARES). Before sets are compared, their histograms (shingles counted into BUCKETS by hash)
must allow the threshold: the sum of the smaller counts bounds the intersection from above. So must their
parities (one bit for each of 64 * WORDS_ODD hash buckets: whether it holds an odd number of shingles): each bit
that differs takes at least one shingle that only one of the sets has. No link is lost by either. Every link reported is verified on the whole sets. Equal sets are one class from the start.

Shingles are 64-bit hashes of their words; a class is a 64-bit hash of its set.

Defined cases: a null text or one without words has an empty set and links with
nothing; fewer words than a shingle has are one shingle; repeated rows fall into one class;
a null id takes part (components are named by the smallest id that is not null); an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslint.llm.common import Scratch, connected_components, merged_components
from corpuslint.llm.textnp import NON_SPACE, U, column_bytes, mix, row_bounds, signed, slices, word_table

SHINGLE = 4
PERCENT = 85
GROWTH = 1.4
PARTS = 8
SENT = 1 << 14  # pairs that are sent to every task
SENT_TURNS = 8
TURN = 1 << 16
TEXT_TURNS = 4
SHARES = (32, 4, 1)  # of many pairs of prefixes, one in 32 is compared first, then one in 4, then all; only those still across components
FEW = 4
STAR_ROUNDS = 4
FRUITFUL = 0.02  # rounds end when fewer of their pairs link
BUCKETS = 64
FULL = 127  # a bucket's count stops here and then bounds nothing
WORDS_ODD = 64  # 64-bit words of a set's parities; a power of two


def bands(largest: int, percent: int = PERCENT) -> list[tuple[int, int, int, int]]:
    """(smallest size, largest size, H, m) of each band up to `largest`."""
    out, low = [], 1
    while low <= largest:
        nxt = max(low + 1, int(low * GROWTH))
        most = 0
        for s in range(max(2, 2 * (nxt - 1) - 24), 2 * (nxt - 1) + 1):
            most = max(most, s - 2 * -(-percent * s // (100 + percent)))
        out.append((low, nxt - 1, most, most + 3 + most // 12))
        low = nxt
    return out


_SEG, _DEL, _PRE, _SET = U(0x51ED270B7A3C9F15), U(0x2545F4914F6CDD1D), U(0x9E6C63D0876A9A47), U(0xD6E8FEB86659FD93)


def shingles(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash), sorted and distinct, of every row's shingles."""
    off, data = column_bytes(column)
    _, row, h = word_table(off, data, NON_SPACE)
    bounds = row_bounds(row, len(off) - 1)
    count = np.diff(bounds)
    with np.errstate(over="ignore"):
        n = max(0, len(h) - size + 1)
        acc = np.zeros(n, U)
        for k in range(size):
            acc = acc * U(0x9FB21C651E98DF25) + h[k: k + n]
        acc = mix(acc)
        whole = row[:n] == row[size - 1: size - 1 + n] if n else np.zeros(0, bool)
        rows, vals = [row[:n][whole]], [acc[whole]]
        for k in range(1, size):  # texts of fewer words: the whole sequence
            at = bounds[:-1][count == k]
            acc = np.full(len(at), U(k))
            for j in range(k):
                acc = acc * U(0x9FB21C651E98DF25) + h[at + j]
            rows.append(row[at])
            vals.append(mix(acc ^ U(k << 56)))
    r, v = np.concatenate(rows), np.concatenate(vals)
    by = np.lexsort((v, r))
    r, v = r[by], v[by]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    return r[new], v[new]


def entries(s: np.ndarray, table: list[tuple[int, int, int, int]], percent: int = PERCENT) -> np.ndarray:
    """Index entries of one set, given as its sorted distinct hashes."""
    n, out, prefix = len(s), [], False
    own = next(k for k, b in enumerate(table) if b[0] <= n <= b[1])
    inner = mix(s ^ _SEG)
    with np.errstate(over="ignore"):
        for k in range(own, len(table)):
            low, _, most, m = table[k]
            if 100 * n < percent * low and k > own:
                break
            if most == 0:  # only equal sets, which are one class
                continue
            seg = ((s >> U(32)) * U(m)) >> U(32)
            first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
            size = np.diff(np.append(first, n))
            total = np.add.reduceat(inner, first)
            name = mix((U(k) << U(32)) + seg[first])
            out.append(mix(total ^ name))
            if m - len(first) > m - most - 1:
                more = name ^ _DEL
                wide = np.flatnonzero(size >= 2)
                out.append(mix(total[wide] ^ more[wide]))
                out.append(mix(total[size < 2] ^ more[size < 2]))
                each = np.repeat(np.arange(len(first)), size)
                keep = size[each] >= 2
                out.append(mix((total[each] - inner)[keep] ^ more[each][keep]))
                prefix |= len(first) + len(wide) < most + 1
        if prefix:
            out.append(mix(s[: n - -(-percent * n // 100) + 1] ^ _PRE))
    return np.concatenate(out) if out else np.zeros(0, U)


def indexed(docs: DataFrame, words: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, tk, n_shingles, cid, sigs0..): size, class and index entries by part of every document; tk names the text.

    Of equal sets that a task reads together only the first carries entries.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bands((1 << 16) * 100 // percent + 1, percent)
        with np.errstate(over="ignore"):
            for b in slices(batches, "text"):
                row, v = shingles(b.column("text"), words)
                bounds = row_bounds(row, b.num_rows)
                size = np.diff(bounds)
                reach = int(size.max(initial=0)) * 100 // percent + 1  # the largest set also stands in the bands of larger partners
                if reach > table[-1][1]:
                    table = bands(reach, percent)
                total = np.concatenate([np.zeros(1, U), np.cumsum(mix(v ^ _SET))])
                cid = mix((total[bounds[1:]] - total[bounds[:-1]]) + size.astype(U))
                first = np.zeros(b.num_rows, bool)
                first[np.unique(cid, return_index=True)[1]] = True
                own = [entries(v[a:z], table, percent) if z > a and f else np.zeros(0, U) for a, z, f in zip(bounds, bounds[1:], first)]
                at = np.repeat(np.arange(b.num_rows), [len(x) for x in own])
                sig = np.concatenate([np.zeros(0, U), *own])
                cols = [b.column("doc_id"), b.column("tk"), pa.array(size.astype(np.int64)), pa.array(signed(cid), mask=size == 0)]
                for part in range(PARTS):
                    mine = sig % U(PARTS) == part
                    ends = np.searchsorted(at[mine], np.arange(b.num_rows + 1))
                    cols.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(signed(sig[mine]))))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "tk", "n_shingles", "cid", *(f"sigs{k}" for k in range(PARTS))])

    lists = "".join(f", sigs{k} array<long>" for k in range(PARTS))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tk"), "text").mapInArrow(
        work, "doc_id long, tk long, n_shingles long, cid long" + lists)


def members_of(scratch: Scratch, index: DataFrame) -> DataFrame:
    """(sig, cid, lo, hi): the entries that several classes share, one of those with the same classes; lo and hi are their ends. Drops `index`."""
    parts = []
    for k in range(PARTS):
        entry = index.where("cid is not null").select("cid", F.explode(f"sigs{k}").alias("sig"))
        shared = scratch.keep(entry.groupBy("sig").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi")).where("lo < hi"))
        parts.append(scratch.keep(entry.join(shared.hint("shuffle_hash"), "sig").distinct()))
        scratch.drop(shared)
    scratch.drop(index)
    found = parts[0]
    for more in parts[1:]:
        found = found.union(more)
    same = [F.bit_xor(F.xxhash64("cid", F.lit(seed))).alias(f"s{seed}") for seed in (1, 2)]
    like = found.groupBy("sig", "lo", "hi").agg(F.count(F.lit(1)).alias("n"), *same)
    chosen = scratch.keep(like.groupBy("lo", "hi", "n", "s1", "s2").agg(F.min("sig").alias("sig")).select("sig"))
    out = scratch.keep(found.join(chosen, "sig", "left_semi"))
    scratch.drop(chosen, *parts)
    return out


def sets_of(scratch: Scratch, docs: DataFrame, index: DataFrame, needed: DataFrame, words: int = SHINGLE) -> list[DataFrame]:
    """(cid, sh, size, hist, odd): the whole sets of the needed classes, from one text of each; hist counts their shingles by bucket, odd has their parities.

    The names of few needed texts are sent to where the texts lie, and no other text travels. For many, TEXT_TURNS tables
    are written: each takes the texts of its share of the ids, so that only this share crosses the network at a time.
    """
    one = scratch.keep(index.join(needed, "cid").groupBy("cid").agg(F.min(F.struct("doc_id", "tk")).alias("x"))
                       .select("cid", F.col("x.doc_id").alias("d"), F.col("x.tk").alias("t")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    share = lambda c: F.pmod(F.xxhash64(c), F.lit(TEXT_TURNS))
    if one.count() <= SENT * SENT_TURNS:
        out = [scratch.keep(_sets(rows, F.broadcast(one), words))]
    else:
        out = [scratch.keep(_sets(rows.where(share("doc_id") == k), one.where(share("d") == k), words)) for k in range(TEXT_TURNS)]
    scratch.drop(one)
    return out


def _sets(rows: DataFrame, one: DataFrame, words: int) -> DataFrame:
    """The sets of the texts (doc_id d, tk t) that `one` names for its classes."""
    texts = (rows.withColumn("tk", F.xxhash64("text"))
             .join(one, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tk") == F.col("t"))).groupBy("cid").agg(F.first("text").alias("text")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            row, v = shingles(b.column("text"), words)
            ends = row_bounds(row, b.num_rows)
            at = row.astype(np.int64) * BUCKETS + (v % U(BUCKETS)).astype(np.int64)
            count = np.minimum(np.bincount(at, minlength=b.num_rows * BUCKETS), FULL).astype(np.int8)
            hist = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * BUCKETS, pa.int32()), pa.array(count))
            odd = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * WORDS_ODD, pa.int32()), pa.array(signed(parities(row, v, b.num_rows))))
            sets = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(signed(v)))
            yield pa.RecordBatch.from_arrays([b.column("cid"), sets, pa.array(np.diff(ends).astype(np.int64)), hist, odd], ["cid", "sh", "size", "hist", "odd"])

    return texts.mapInArrow(work, "cid long, sh array<long>, size long, hist array<tinyint>, odd array<long>")


def parities(row: np.ndarray, v: np.ndarray, rows: int) -> np.ndarray:
    """WORDS_ODD words for each row, whose shingles are sorted: a bit is set where its bucket holds an odd number of them."""
    out = np.zeros(rows * WORDS_ODD, U)
    if len(v):
        high = U(65 - WORDS_ODD.bit_length())  # the word is named by the highest bits, so shingles stand by word
        at = row.astype(np.int64) * WORDS_ODD + (v >> high).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        out[at[first]] = np.bitwise_xor.reduceat(U(1) << ((v >> (high - U(6))) & U(63)), first)
    return out


def _may_link(size: Column, hist: Column, size2: Column, hist2: Column, percent: int) -> Column:
    """False only where the histograms rule the threshold out."""
    add = lambda total, x: total + F.when(x == FULL, F.lit(1 << 40)).otherwise(x.cast("long"))
    most = F.aggregate(F.zip_with(hist, hist2, lambda x, y: F.least(x, y)), F.lit(0).cast("long"), add)
    return (100 + percent) * most >= percent * (size + size2)


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT, others: DataFrame | None = None) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold, compared as whole sets; those of b stand in `others` if given."""
    left = sets.select(F.col("cid").alias("a"), F.col("sh").alias("x"))
    right = (sets if others is None else others).select(F.col("cid").alias("b"), F.col("sh").alias("y"))
    both = F.size(F.array_intersect("x", "y")).cast("long")
    return pairs.join(right, "b").join(left, "a").where(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b")


def verified_few(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The same for at most SENT pairs: only the sets that they name cross the network."""
    both = F.size(F.array_intersect("sh", "sh2")).cast("long")
    return _met_few(pairs, sets, "sh").where(100 * both >= percent * (F.size("sh") + F.size("sh2") - both)).select("a", "b")


def _met_few(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """Few pairs (a, b), sent to where the sets lie, with the columns of a's set and, as column2, those of b's."""
    few = F.broadcast(pairs)
    left = few.join(sets.select(F.col("cid").alias("a"), *columns), "a")
    right = few.join(sets.select(F.col("cid").alias("b"), *[F.col(c).alias(f"{c}2") for c in columns]), "b")
    return left.join(right.hint("merge"), ["a", "b"])


def _plausible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and histograms allow the threshold."""
    left = sets.select(F.col("cid").alias("a"), "size", "hist")
    right = sets.select(F.col("cid").alias("b"), F.col("size").alias("size2"), F.col("hist").alias("hist2"))
    may = _may_link(F.col("size"), F.col("hist"), F.col("size2"), F.col("hist2"), percent)
    return pairs.join(left, "a").join(right, "b").where(may).select("a", "b")


def _alike(pairs: DataFrame, sets: DataFrame, percent: int, few: bool) -> DataFrame:
    """The pairs (a, b) whose parities allow the threshold."""
    if few:
        both = _met_few(pairs, sets, "size", "odd")
    else:
        both = (pairs.join(sets.select(F.col("cid").alias("a"), "size", "odd"), "a")
                .join(sets.select(F.col("cid").alias("b"), F.col("size").alias("size2"), F.col("odd").alias("odd2")), "b"))
    differ = F.aggregate(F.zip_with("odd", "odd2", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x).cast("long")
    return both.where((100 + percent) * differ <= (100 - percent) * (F.col("size") + F.col("size2"))).select("a", "b")


def _found(scratch: Scratch, pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that reach the threshold, written; where the sets have parities, only pairs that these allow are compared. Few pairs are sent to where the sets lie, SENT in a turn, and only
    their sets travel; of more than SENT_TURNS turns, the sets travel, in turns that take a share of the sets on
    each side and hold at most TURN pairs or half as many as there are sets."""
    may = scratch.keep(_plausible(pairs, sets, percent))
    if "odd" in sets.columns:
        rough, may = may, scratch.keep(_alike(may, sets, percent, may.count() <= SENT * SENT_TURNS))
        scratch.drop(rough)
    n = may.count()
    if n <= SENT * SENT_TURNS:
        turns = max(1, -(-n // SENT))
        part = F.pmod(F.xxhash64("a", "b"), F.lit(turns))
        found = [scratch.keep(verified_few(may.where(part == k), sets, percent)) for k in range(turns)]
    else:
        sides = max(2, math.isqrt(-(-n // max(TURN, sets.count() // 2)) - 1) + 1)
        part = lambda c: F.pmod(F.xxhash64(c), F.lit(sides))
        found = [scratch.keep(verified(may.where((part("a") == i) & (part("b") == j)), sets.where(part("cid") == i), percent, sets.where(part("cid") == j)))
                 for i in range(sides) for j in range(sides)]
    scratch.drop(may)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _across(members: DataFrame) -> DataFrame:
    """Pairs a < b of sets of one entry that lie in different components."""
    mine = members.select("sig", F.col("cid").alias("a"), "comp")
    other = members.select("sig", F.col("cid").alias("b"), F.col("comp").alias("comp2"))
    return mine.join(other, "sig").where("a < b and comp <> comp2").select("a", "b").distinct()


def _prefixes(scratch: Scratch, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(token, cid, n, rank): the n - ceil(t n) + 1 shingles of each member that are rarest among the members, those of one member only left out."""
    own = scratch.keep(members.select("cid").distinct())
    few = own.count() <= SENT * SENT_TURNS  # then the other sets stay where they lie
    tokens = (F.broadcast(own) if few else own).join(sets, "cid").select("cid", F.size("sh").alias("n"), F.explode("sh").alias("token"))
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    own = Window.partitionBy("cid")
    # those of one member only are the rarest and come first: they have ranks but need no rows
    rank = F.col("n") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("often", "token"))
    ranked = tokens.join(often, "token").withColumn("rank", rank)
    return ranked.where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).select("token", "cid", "n", "rank")


def _across_prefixes(prefixes: DataFrame, comps: DataFrame, percent: int, share: int = 1) -> DataFrame:
    """Pairs a < b across components that share a token of their prefixes, early enough; of these one in `share`, chosen by hash."""
    mine = prefixes.join(comps, F.col("cid") == F.col("node"), "left").select("token", "cid", "n", "rank", F.coalesce("component", "cid").alias("comp"))
    other = mine.select("token", F.col("cid").alias("b"), F.col("comp").alias("comp2"), F.col("n").alias("n2"), F.col("rank").alias("rank2"))
    # the first shared shingle of a linked pair leaves room for all they must share
    room = F.least(F.col("n") - F.col("rank"), F.col("n2") - F.col("rank2")) + 1
    chosen = F.pmod(F.xxhash64("cid", "b"), F.lit(share)) == 0
    return (mine.join(other, "token")
            .where((F.col("cid") < F.col("b")) & (F.col("comp") != F.col("comp2")) & (room * (100 + percent) >= percent * (F.col("n") + F.col("n2"))) & chosen)
            .select(F.col("cid").alias("a"), "b").distinct())


def _met_most(met: DataFrame) -> DataFrame:
    """Pairs a < b: each set `cid` with the one of its `p` that most of its entries name, the smallest of these."""
    votes = met.groupBy("cid", "p").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("cid").agg(F.min(F.struct((-F.col("n")).alias("n"), "p")).alias("x")).select("cid", F.col("x.p").alias("p"))
    return best.select(F.least("p", "cid").alias("a"), F.greatest("p", "cid").alias("b")).distinct()


def _open(members: DataFrame, comps: DataFrame) -> DataFrame:
    """(sig, cid, comp, n): the sets of entries whose sets lie in several components; n of them."""
    placed = members.select("sig", "cid").join(comps, F.col("cid") == F.col("node"), "left").select("sig", "cid", F.coalesce("component", "cid").alias("comp"))
    several = placed.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi")
    return placed.join(several.select("sig", "n"), "sig")


def classes(docs: DataFrame, words: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, tk, n_shingles, cid, group): `group` names the component of the document's class, null without words."""
    scratch = Scratch(docs.sparkSession, "ngrams")
    whole = scratch.keep(indexed(docs, words, percent))
    index = scratch.keep(whole.select("doc_id", "tk", "n_shingles", "cid"))
    members = members_of(scratch, whole)
    tested = scratch.keep(_met_most(members.where("lo < cid").select("cid", F.col("lo").alias("p"))))
    turns = sets_of(scratch, docs, index, members.select("cid").distinct(), words)
    sets = scratch.together(*turns)
    comps = scratch.keep(connected_components(scratch, _found(scratch, tested, sets, percent)))
    rest = scratch.keep(_open(members, comps))
    scratch.drop(members)

    def compared(pairs: DataFrame) -> float:
        """Compare the pairs not compared yet and join the components that they link; the share of them that did."""
        nonlocal comps, tested
        new = scratch.keep(pairs.join(tested, ["a", "b"], "left_anti"))
        found = _found(scratch, new, sets, percent)
        tested = tested.union(new)
        links = found.count()
        if not links:
            return 0.0
        comps = scratch.keep(merged_components(scratch, comps, found))
        return links / new.count()

    compared(_across(rest.where(F.col("n") <= FEW)))
    rest = _narrowed(scratch, rest, rest.where(F.col("n") > FEW), comps)
    for turn in range(STAR_ROUNDS):
        if rest.isEmpty():
            break
        order = F.xxhash64("cid", F.lit(turn))  # the same in all entries, so like entries choose the same set
        pivot = rest.groupBy("sig").agg(F.min(F.struct(order.alias("order"), "cid", "comp")).alias("p"))
        share = compared(_met_most(rest.join(pivot, "sig").where("comp <> p.comp").select("cid", F.col("p.cid").alias("p"))))
        if share:
            rest = _narrowed(scratch, rest, rest, comps)
        if share < FRUITFUL:  # sets that are alike, but not enough
            break
    if not rest.isEmpty():
        prefixes = scratch.keep(_prefixes(scratch, rest, sets, percent))
        meetings = prefixes.groupBy("token").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.expr("n * (n - 1) div 2"))).first()[0] or 0
        for share in SHARES if meetings > SENT else SHARES[-1:]:
            compared(_across_prefixes(prefixes, comps, percent, share))
        scratch.drop(prefixes)
    scratch.drop(rest, *turns)
    return (index.join(comps, F.col("cid") == F.col("node"), "left")
            .select("doc_id", "tk", "n_shingles", "cid", F.coalesce("component", "cid").alias("group")))


def _narrowed(scratch: Scratch, old: DataFrame, kept: DataFrame, comps: DataFrame) -> DataFrame:
    """What of `kept` is still open now; the table `old` that it comes from goes."""
    new = scratch.keep(_open(kept, comps))
    scratch.drop(old)
    return new


def ngram_join(docs: DataFrame) -> DataFrame:
    """One row per document: its set's size and the smallest id it is linked with, directly or not."""
    c = Scratch(docs.sparkSession, "ngram-classes").keep(classes(docs))
    least = c.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("least"))
    return c.join(least, "group", "left").select("doc_id", "n_shingles", F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def one_of_each(docs: DataFrame, words: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The input's rows without near copies: of each group the row with the smallest id, and all rows without words."""
    c = Scratch(docs.sparkSession, "ngram-classes").keep(classes(docs, words, percent))
    best = c.where("group is not null").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tk")).alias("x"))
    keep = best.select(F.col("x.doc_id").alias("d"), F.col("x.tk").alias("t"), F.lit(True).alias("worded"))
    empty = c.where("group is null").select(F.col("doc_id").alias("d"), F.col("tk").alias("t"), F.lit(False).alias("worded")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("k"))
    rows = rows.join(keep.union(empty), F.col("id").eqNullSafe(F.col("d")) & (F.col("k") == F.col("t")))
    copy = F.row_number().over(Window.partitionBy("id", "k").orderBy("k"))
    one = rows.where("worded").withColumn("n", copy).where("n = 1")
    return one.select("row.*").unionByName(rows.where("not worded").select("row.*"))


def query(spark, sf_dir):
    from corpuslint.llm.common import documents

    return ngram_join(documents(spark, sf_dir))
