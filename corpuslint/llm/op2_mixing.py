"""Mixing sources to target weights by blocks, shards and index permutations.

The words of a source, its documents in a keyed pseudorandom order, are cut into
blocks of a fixed length. The mix is a list of slots, cut into output shards. A
shard draws how many of its slots go to each source from a multinomial with the
target shares, seeded by the shard's number; slots drawn beyond a source's number
of slots are handed to sources that drew too few, so that totals are exact. The
k-th slot of a source takes block perm(k mod blocks) - a keyed permutation of the
source's block numbers - in pass k div blocks. A source's slots are its whole
passes and, of one pass more, as many blocks as the rest of its target needs: the
blocks of full length by a permutation of their own, then the short last one; the
last block taken gives only the words still needed. So every source gives its
target, rounded to a word. Slots and documents meet by block number. A shard's slots
stand in it at the places of a keyed permutation; `mixed_blocks` gives their texts.

Only the list of sources (name and size, one row each) comes to the driver.

Defined cases: a null text has no words; a null source is a source of its own,
last in the order; a document without words is taken 0 times; repeated rows are
documents of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslint.llm.common import Scratch, words

WEIGHTS = (5, 2, 1)
RATIO = 1.5
MOST_TIMES = 2
BLOCK_WORDS = 128
SHARD_SLOTS = 16384
FULL_BLOCK = 1 << 40  # a slot that takes all of its block
SEED = 20
DOCS_PER_BUCKET = 20_000
#: Up to so many sources their table is sent to every executor; beyond that they meet by a shuffle.
SMALL_SOURCES = 20_000


@dataclass(frozen=True)
class Source:
    sid: int
    name: str | None
    size: int
    target: float
    blocks: int
    slots: int
    whole: int  #: whole passes
    full: int  #: blocks that are not short
    cut: int  #: words of the last slot


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, ratio: float = RATIO, most: float = MOST_TIMES) -> list[tuple[str | None, int, float]]:
    """(source, size, target) in order: shares of `ratio` times all sizes by weight, none above `most` times its size."""
    rows = sorted(sizes, key=lambda r: (r[0] is None, (r[0] or "").encode("utf-8")))
    weight = [float(weights[i % len(weights)]) for i in range(len(rows))]
    out, open_, rest = [0.0] * len(rows), set(range(len(rows))), ratio * sum(n for _, n in rows)
    while open_:
        total = sum(weight[i] for i in sorted(open_))
        full = [i for i in sorted(open_) if rest * weight[i] / total > most * rows[i][1]]
        for i in full or sorted(open_):
            out[i] = float(most * rows[i][1]) if full else rest * weight[i] / total
        if not full:
            break
        rest -= sum(out[i] for i in full)
        open_ -= set(full)
    return [(name, n, out[i]) for i, (name, n) in enumerate(rows)]


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0..n-1 at the given places: four Feistel rounds, walked until inside."""
    if n <= 1:
        return np.zeros_like(index)
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def rounds(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for r in range(4):
            with np.errstate(over="ignore"):
                f = (right + np.uint64((key * 4 + r + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
                f ^= f >> np.uint64(29)
                f *= np.uint64(0x94D049BB133111EB)
                f ^= f >> np.uint64(32)
            left, right = right, left ^ (f & mask)
        return (left << np.uint64(half)) | right

    x = rounds(index.astype(np.uint64))
    while len(out := np.flatnonzero(x >= n)):
        x[out] = rounds(x[out])
    return x.astype(np.int64)


def plan(docs: DataFrame, weights=WEIGHTS, ratio: float = RATIO, block_words: int = BLOCK_WORDS) -> list[Source]:
    rows = docs.groupBy("source").agg(F.sum("size").alias("n")).collect()  # one row per source
    out = []
    for sid, (name, size, target) in enumerate(targets([(r["source"], r["n"]) for r in rows], weights, ratio)):
        blocks, full = -(-size // block_words), size // block_words
        whole, rest = divmod(min(round(target), MOST_TIMES * size), max(1, size))
        more = min(-(-rest // block_words), full + 1)
        cut = rest - (more - 1) * block_words if more else block_words
        out.append(Source(sid, name, size, target, blocks, whole * blocks + more, whole, full, cut))
    return out


def slots(spark, sources: list[Source], shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """(shard, place, sid, epoch, block, cut): the whole mix, one row per slot; it takes the first `cut` words of its block."""
    total = sum(s.slots for s in sources)
    shards = -(-total // shard_slots)
    share = np.array([s.slots for s in sources], float) / max(1, total)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard in b.column(0).to_pylist():
                n = min(shard_slots, total - shard * shard_slots)
                got = np.random.default_rng([seed, shard]).multinomial(n, share)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(got), shard, np.int64)), pa.array(np.arange(len(got), dtype=np.int32)), pa.array(got.astype(np.int64)), pa.array(np.cumsum(got) - got)],
                                                 ["shard", "sid", "n", "start"])

    scratch = Scratch(spark, "mix")
    drawn = scratch.keep(spark.range(shards).mapInArrow(draw, "shard long, sid int, n long, start long").where("n > 0"))
    got = {r["sid"]: r["n"] for r in drawn.groupBy("sid").agg(F.sum("n").alias("n")).collect()}  # one row per source
    over, short, a, z = [], [], 0, 0
    for s in sources:
        d = got.get(s.sid, 0) - s.slots
        if d > 0:
            over.append((s.sid, s.slots, a))
            a += d
        elif d < 0:
            short.append((s.sid, s.slots + d, z, -d))
            z -= d
    first = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    each = (drawn.withColumn("first", F.coalesce(F.sum("n").over(first), F.lit(0)))
            .select("shard", "sid", "first", "start", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("rank"))
            .select("shard", "sid", "rank", (F.col("start") + F.col("rank") - F.col("first")).alias("number")))  # of the slot in its shard
    lim = spark.createDataFrame(over or [(-1, 0, 0)], "sid int, held long, off long")
    each = each.join(_small(lim, len(over)), "sid", "left")
    kept = each.where("held is null or rank < held").select("shard", "sid", "rank", "number")
    if over:
        free = (spark.createDataFrame(short, "to int, have long, off long, d long")
                .select("to", "have", "off", F.explode(F.sequence(F.lit(0).cast("long"), F.col("d") - 1)).alias("i"))
                .select((F.col("off") + F.col("i")).alias("g"), F.col("to").alias("sid"), (F.col("have") + F.col("i")).alias("rank")))
        moved = each.where("rank >= held").select("shard", "number", (F.col("off") + F.col("rank") - F.col("held")).alias("g"))
        kept = kept.unionByName(moved.join(free, "g").select("shard", "sid", "rank", "number"))
    per = np.array([(s.blocks, s.slots, s.whole, s.full, s.cut) for s in sources] or [(0, 0, 0, 0, 0)], np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sid, rank = b.column("sid").to_numpy(zero_copy_only=False), b.column("rank").to_numpy(zero_copy_only=False)
            n, most, whole, full, last = per[sid].T
            epoch, at = rank // n, rank % n
            block = at.copy()  # where no permutation applies: the short block after the full ones
            rest = epoch >= whole
            for own in _groups(sid):
                s = int(sid[own[0]])
                a, z = own[~rest[own]], own[rest[own] & (at[own] < full[own])]
                block[a] = permuted(at[a], int(per[s, 0]), seed * 1_000_003 + s)
                block[z] = permuted(at[z], int(per[s, 3]), seed * 1_000_003 + s)
            cut = np.where(rest & (rank == most - 1), last, FULL_BLOCK)
            shard, number = b.column("shard").to_numpy(zero_copy_only=False), b.column("number").to_numpy(zero_copy_only=False)
            spot = number.copy()
            for own in _groups(shard):
                k = int(shard[own[0]])
                spot[own] = permuted(number[own], min(shard_slots, total - k * shard_slots), seed * 1_000_033 + k)
            yield pa.RecordBatch.from_arrays([b.column("shard"), pa.array(spot), b.column("sid"), pa.array(epoch.astype(np.int32)), pa.array(block), pa.array(cut)], ["shard", "place", "sid", "epoch", "block", "cut"])

    return kept.mapInArrow(place, "shard long, place long, sid int, epoch int, block long, cut long")


def _groups(keys: np.ndarray) -> list[np.ndarray]:
    """The places of each value."""
    by = np.argsort(keys, kind="stable")
    return np.split(by, np.flatnonzero(np.diff(keys[by])) + 1) if len(by) else []


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL_SOURCES else df


def placed(docs: DataFrame, sources: list[Source], carry: list[str], seed: int = SEED) -> DataFrame:
    """Each document with its source's number and where its words begin in the source (`pos`).

    The running sum is taken in two steps: inside buckets of the pseudorandom
    order, and over the buckets' totals, so a source with any share of the rows
    is spread over many tasks.
    """
    spark = docs.sparkSession
    names = spark.createDataFrame([(s.sid, s.name) for s in sources], "sid int, name string")
    d = docs.join(_small(names, len(sources)), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    buckets = max(1, -(-docs.count() // DOCS_PER_BUCKET))
    d = d.withColumn("order", F.xxhash64("doc_id", F.lit(seed)))
    d = d.withColumn("bucket", F.shiftrightunsigned(F.shiftrightunsigned("order", 33) * F.lit(buckets), 31).cast("long"))
    w = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    tops = (d.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
            .select(F.col("sid").alias("sid2"), F.col("bucket").alias("bucket2"), F.coalesce(F.sum("n").over(w), F.lit(0)).alias("top")))
    inner = Window.partitionBy("sid", "bucket").orderBy("order", "doc_id", "size", *[F.xxhash64(c) for c in carry]).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("before", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    return d.join(tops, (F.col("sid") == F.col("sid2")) & (F.col("bucket") == F.col("bucket2"))).select(
        "sid", (F.col("top") + F.col("before")).alias("pos"), "doc_id", "size", *carry)


def pieces(where: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(sid, pos, block, a, z): the words a..z-1 of a document that lie in a block."""
    b = F.lit(block_words)
    first, last = F.floor(F.col("pos") / b), F.floor((F.col("pos") + F.col("size") - 1) / b)
    p = where.where("size > 0").select("sid", "pos", "size", F.explode(F.sequence(first, last)).alias("block"))
    return p.select("sid", "pos", "block", F.greatest(F.lit(0), F.col("block") * b - F.col("pos")).alias("a"),
                    F.least(F.col("size"), (F.col("block") + 1) * b - F.col("pos")).alias("z"))


def mixed_pieces(where: DataFrame, slots: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The pieces of all slots: the words a..z-1 of a document that a slot takes, with the slot's columns."""
    end = F.col("block") * F.lit(block_words) + F.col("cut") - F.col("pos")
    return pieces(where, block_words).join(slots, ["sid", "block"]).withColumn("z", F.least("z", end)).where("z > a").drop("cut")


def sized(docs: DataFrame, *carry: str) -> DataFrame:
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"), *carry)


def taken(docs: DataFrame) -> DataFrame:
    """Per document: its size, its source's size and target, and how many of its words the mix takes."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixed")
    d = scratch.keep(sized(docs))
    sources = plan(d)
    where = scratch.keep(placed(d, sources, []))
    got = mixed_pieces(where, slots(spark, sources)).groupBy("sid", "pos").agg(F.sum(F.col("z") - F.col("a")).alias("got"))
    per = spark.createDataFrame([(s.sid, s.size, s.target) for s in sources], "sid int, source_size long, target double")
    full = where.where("size > 0").join(got, ["sid", "pos"], "left").unionByName(where.where("size = 0").withColumn("got", F.lit(0).cast("long")))
    return full.join(_small(per, len(sources)), "sid").select("doc_id", "size", "source_size", "target", F.coalesce("got", F.lit(0)).cast("long").alias("taken"))


def mixed_blocks(docs: DataFrame) -> DataFrame:
    """(shard, place, sid, text): the mix as blocks in their output shards; a block's words stand one space apart."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixed")
    sources = plan(sized(docs))
    where = scratch.keep(placed(sized(docs, "text"), sources, ["text"]))
    part = F.array_join(F.slice(words(F.col("text")), (F.col("a") + 1).cast("int"), (F.col("z") - F.col("a")).cast("int")), " ")
    texts = (mixed_pieces(where, slots(spark, sources)).join(where.where("size > 0").select("sid", "pos", "text"), ["sid", "pos"])
             .select("shard", "place", "sid", F.struct("pos", part.alias("t")).alias("piece")))
    return texts.groupBy("shard", "place", "sid").agg(F.sort_array(F.collect_list("piece")).alias("p")).select(
        "shard", "place", "sid", F.array_join(F.transform("p", lambda x: x["t"]), " ").alias("text"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: for each pass over a document, a row with its words the mix takes in that pass.

    Rows stand in the order of the mix, by shard and place of the slot that holds
    the first of their words, so each stretch of them has the drawn mix. A pass that takes the whole document keeps its text as it is; otherwise the
    taken words stand in order, one space apart. Documents without words go.
    """
    spark = docs.sparkSession
    names, kinds = docs.columns, dict(docs.dtypes)
    scratch = Scratch(spark, "mixed")
    sources = plan(sized(docs))
    rows = docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"))
    where = scratch.keep(placed(sized(rows, "row"), sources, ["row"]))
    ranges = (mixed_pieces(where, slots(spark, sources)).groupBy("sid", "pos", "epoch")
              .agg(F.sort_array(F.collect_list(F.struct("a", "z"))).alias("parts"), F.min(F.struct("a", "shard", "place")).alias("at")))
    rows = where.where("size > 0").join(ranges, ["sid", "pos"]).withColumn("got", F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["z"] - p["a"]))
    rows = rows.withColumns({"shard": F.col("at.shard"), "place": F.col("at.place")}).drop("at")
    rows = rows.repartitionByRange("shard", "place").sortWithinPartitions("shard", "place", "pos")
    some = F.array_join(F.flatten(F.transform("parts", lambda p: F.slice(F.col("w"), (p["a"] + 1).cast("int"), (p["z"] - p["a"]).cast("int")))), " ")
    rows = rows.withColumn("w", F.when(F.col("got") < F.col("size"), words(F.col("row.text"))))
    rows = rows.withColumn("new", F.when(F.col("got") == F.col("size"), F.col("row.text")).otherwise(some))
    out = {"text": F.col("new")}
    if "n_chars" in names:
        out["n_chars"] = F.length("new").cast(kinds["n_chars"])
    return rows.select(*[out.get(n, F.col("row")[n]).alias(n) for n in names])


def query(spark, sf_dir):
    from corpuslint.llm.common import documents

    return taken(documents(spark, sf_dir))
