"""Spelling variants by composing the vocabulary acceptor with a one-edit transducer and the acceptor again.

The vocabulary (words with their counts) is built from all texts: tasks count words in
bounded tables and Spark adds the counts up. Two words at one edit share their first or
their last floor(m / 2) code points, m being the shorter length. So the composition falls
into independent parts, one for each *initial state*: the acceptor's state after such a
beginning (or the reversed acceptor's after such an ending), for each m. A part holds the
words of length m and m + 1 that pass its state. In a part, the rests of the words are
made into a minimised acceptor, which is composed with the one-edit transducer and with
itself; a state knows how many words it accepts, so that a path gives the number of its
word. A pair found by its ending is left out if the words also share the beginning.

Every pair has one path: an inserted code point stands as far back as it can. What two
states both accept is kept for the part, so shared endings are walked once.

A part of more than `block` words is cut into blocks of words, and each block is composed
with each block in a task of its own; nothing but the words at one edit is ever emitted,
and of those only each word's number and best partner.

Defined cases: null texts have no words, a null id is an empty string in the hash; an
empty table gives no rows; repeated rows count as often as they stand; runs of any length
are whole words; ties between forms go to the word that is smaller in code-point order;
other columns are ignored.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslint.llm.common import Scratch, documents

RUN = re.compile("[a-zÀ-ÿ]+")
LEAST_LENGTH = 7
LEAST_COUNT = 2
TYPO = 31
RATIO = 10
TABLE = 200_000  # words that a task counts before it hands the counts on
BLOCK = 20_000


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of the batches' texts, whenever the table is full and at the end."""
    seen: Counter = Counter()

    def handed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            if not text:
                continue
            start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            text = text.encode("utf-8").lower().decode("utf-8")  # bytes: only A-Z change
            for run in RUN.findall(text):
                size = len(run)
                if size < LEAST_LENGTH:
                    continue
                h = zlib.crc32(run.encode("utf-8"), start)
                if h % TYPO == 0:
                    if size == LEAST_LENGTH:
                        continue
                    at = h % size
                    run = run[:at] + run[at + 1:]
                seen[run] += 1
            if len(seen) >= TABLE:
                yield handed()
                seen.clear()
    if seen:
        yield handed()


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): words of at least LEAST_LENGTH code points and LEAST_COUNT occurrences in all texts."""
    counted = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


class Acceptor:
    """The minimised acceptor of sorted distinct words; a path's offsets add up to its word's number."""

    def __init__(self, words: list[str]):
        self.final: list[bool] = []
        self.edges: list[dict[str, tuple[int, int]]] = []  # code point: (state, words before)
        self.accepted: list[int] = []
        self._same: dict[tuple, int] = {}
        self.start = self._state(words, 0, len(words), 0)

    def _state(self, words: list[str], a: int, z: int, depth: int) -> int:
        """The state of words[a:z], which agree up to `depth`; equal states are one. Recursion follows branchings only."""
        first, last, top = words[a], words[z - 1], depth
        while depth < len(first) and depth < len(last) and first[depth] == last[depth] and z - a > 1:
            depth += 1
        if z - a == 1:
            state, chain = self._make(True, ()), first[top:]
        else:
            final = len(first) == depth
            out, at = [], a + final
            while at < z:
                c, to = words[at][depth], at + 1
                while to < z and words[to][depth] == c:
                    to += 1
                out.append((c, self._state(words, at, to, depth + 1)))
                at = to
            state, chain = self._make(final, tuple(out)), first[top:depth]
        for c in reversed(chain):  # what all these words go through before they branch
            state = self._make(False, ((c, state),))
        return state

    def _make(self, final: bool, out: tuple) -> int:
        key = (final, out)
        known = self._same.get(key)
        if known is not None:
            return known
        total, edges = int(final), {}
        for c, state in out:
            edges[c] = (state, total)
            total += self.accepted[state]
        self.final.append(final)
        self.edges.append(edges)
        self.accepted.append(total)
        self._same[key] = len(self.edges) - 1
        return len(self.edges) - 1


def one_edit_pairs(left: Acceptor, right: Acceptor) -> Iterator[tuple[int, int]]:
    """Numbers (i, j) of the words accepted by left, by the one-edit transducer and by right, each pair once."""
    both_accept: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def common(p: int, q: int) -> list[tuple[int, int]]:
        """Offsets of what both states accept; a stretch without branches is walked in a loop."""
        start, a, b = (p, q), 0, 0
        while (found := both_accept.get((p, q))) is None and not (left.final[p] and right.final[q]):
            there = right.edges[q]
            shared = [c for c in left.edges[p] if c in there]
            if len(shared) != 1:
                break
            (p, x), (q, y) = left.edges[p][shared[0]], there[shared[0]]
            a, b = a + x, b + y
        if found is None:
            found = both_accept[p, q] = ([(0, 0)] if left.final[p] and right.final[q] else []) + steps(p, q, None)
        if start != (p, q):
            found = both_accept[start] = [(a + i, b + j) for i, j in found]
        return found

    def steps(p: int, q: int, but: str | None) -> list[tuple[int, int]]:
        out, there = [], right.edges[q]
        for c, (p2, a) in left.edges[p].items():
            if c != but and c in there:
                q2, b = there[c]
                out += [(a + i, b + j) for i, j in common(p2, q2)]
        return out

    def without(p: int, q: int, c: str) -> list[tuple[int, int]]:
        """What both accept, not beginning with the code point just inserted (that stands further back)."""
        return ([(0, 0)] if left.final[p] and right.final[q] else []) + steps(p, q, c)

    todo = [(left.start, right.start, 0, 0)]
    while todo:
        p, q, i, j = todo.pop()
        mine, there = left.edges[p], right.edges[q]
        for c, (p2, a) in mine.items():
            for x, y in without(p2, q, c):  # left has one more
                yield i + a + x, j + y
            for d, (q2, b) in there.items():
                if c == d:
                    todo.append((p2, q2, i + a, j + b))
                else:
                    for x, y in common(p2, q2):
                        yield i + a + x, j + b + y
        for d, (q2, b) in there.items():
            for x, y in without(p, q2, d):  # right has one more
                yield i + x, j + b + y


def _composed(side: int, m: int, left: list[tuple[str, int]], right: list[tuple[str, int]] | None) -> list[tuple[str, int, int, str]]:
    """(word, near words, best partner's count, best partner) of the words of one part, or of its left block."""
    half = m // 2

    def ordered(words: list[tuple[str, int]]) -> tuple[list[tuple[str, str, int]], Acceptor]:
        rests = sorted((w[half:] if side == 0 else w[:len(w) - half][::-1], w, n) for w, n in words)
        return rests, Acceptor([r for r, _, _ in rests])

    mine, first = ordered(left)
    theirs, second = (mine, first) if right is None else ordered(right)
    near: dict[int, list] = {}
    for i, j in one_edit_pairs(first, second):
        (_, a, _), (_, b, n) = mine[i], theirs[j]
        if len(a) > m and len(b) > m or side == 1 and a[:half] == b[:half]:
            continue  # found in another part
        best = near.get(i)
        if best is None:
            near[i] = [1, -n, b]
        else:
            best[0] += 1
            if (-n, b) < (best[1], best[2]):
                best[1], best[2] = -n, b
    return [(mine[i][1], k, -n, b) for i, (k, n, b) in near.items()]


_OUT = pa.schema([("word", pa.string()), ("k", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part (side, m, state, block pair): each part is composed when its last row has come."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 10 * BLOCK))  # at most one level a word of the part
    part, left, right, out = None, [], [], []

    def flushed() -> list[tuple[str, int, int, str]]:
        if part is None or not left or not right and len(left) < 2:
            return []
        return _composed(part[0], part[1], left, right or None)

    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("side", "m", "state", "i", "j", "role", "word", "n")]
        for side, m, state, i, j, role, word, n in zip(*cols):
            if (side, m, state, i, j) != part:
                out += flushed()
                part, left, right = (side, m, state, i, j), [], []
            (right if role == 2 else left).append((word, n))
        if len(out) >= 10_000:
            yield pa.RecordBatch.from_pylist([dict(zip(_OUT.names, r)) for r in out], schema=_OUT)
            out = []
    out += flushed()
    if out:
        yield pa.RecordBatch.from_pylist([dict(zip(_OUT.names, r)) for r in out], schema=_OUT)


def near_words(words: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """(word, k, best_n, best): number of words at one edit, and the most frequent of them."""
    size = F.char_length("word")
    of_length = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("m")).where(F.col("m") >= LEAST_LENGTH)
    half = F.floor(F.col("m") / 2).cast("int")
    states = F.array(F.struct(F.lit(0).alias("side"), F.substring("word", F.lit(1), half).alias("state")),
                     F.struct(F.lit(1).alias("side"), F.expr("right(word, cast(floor(m / 2) as int))").alias("state")))
    rows = of_length.select("word", "n", "m", F.explode(states).alias("s")).select("word", "n", "m", "s.side", "s.state")
    sizes = scratch.keep(rows.groupBy("side", "m", "state").agg(F.count(F.lit(1)).alias("words")).where("words > 1"))
    rows = rows.join(sizes, ["side", "m", "state"])
    zero = F.lit(0)
    whole = rows.where(F.col("words") <= block).select("side", "m", "state", zero.alias("i"), zero.alias("j"), zero.alias("role"), "word", "n")
    blocks = F.ceil(F.col("words") / block).cast("int")
    large = rows.where(F.col("words") > block).withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")
    cut = large.select("*", other)
    as_left = cut.select("side", "m", "state", F.col("own").alias("i"), F.col("o").alias("j"), F.lit(1).alias("role"), "word", "n")
    as_right = cut.select("side", "m", "state", F.col("o").alias("i"), F.col("own").alias("j"), F.lit(2).alias("role"), "word", "n")
    parts = whole.unionByName(as_left).unionByName(as_right)
    key = ["side", "m", "state", "i", "j"]
    tasks = 4 * int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes a part, but much work
    composed = parts.repartition(tasks, *key).sortWithinPartitions(*key, "role").mapInArrow(_compose, "word string, k long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return composed.groupBy("word").agg(F.sum("k").alias("k"), best.alias("b")).select("word", "k", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) for words with a form: the chains of forms are shortened by doubling.

    A form is at least RATIO times as frequent as its word, so a chain has at most
    as many steps as the largest count has digits.
    """
    cur = scratch.keep(forms.select("word", F.col("form").alias("root")))
    while True:
        up = cur.select(F.col("word").alias("root"), F.col("root").alias("top"))
        nxt = scratch.keep(cur.join(up, "root", "left").select("word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")))
        moved = not nxt.where("moved").isEmpty()
        scratch.drop(cur)
        cur = nxt.drop("moved") if not moved else scratch.keep(nxt.drop("moved"))
        if not moved:
            return cur


def spelling_variants(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row for each word of the vocabulary."""
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.keep(vocabulary(docs))
    near = scratch.keep(words.join(near_words(words, scratch, block), "word", "left"))
    is_form = F.col("best_n") >= RATIO * F.col("n")
    formed = near.select("word", F.when(is_form, F.col("best")).alias("form"), "n", F.coalesce("k", F.lit(0)).alias("n_near"),
                         F.when(is_form, F.col("best_n")).alias("form_n"))
    top = roots(formed.where("form is not null"), scratch)
    return formed.join(top, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark, sf_dir):
    return spelling_variants(documents(spark, sf_dir))
