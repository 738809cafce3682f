"""Embedding near-duplicates by a pivot-permutation index.

A vector is described by its nearest reference points in order; the first K of
them stand in inverted lists. A list is kept per set of SHARED reference points,
so two vectors meet in a list exactly when they share at least SHARED of their K
nearest ones (with the same label). Candidates are then verified by their cosine.

Lists are never expanded into pairs. Members of a list are first compared with the
list's leader: vectors within half the linking angle of a leader form its ball, and
all members of a ball are linked with each other (triangle inequality). Two balls
that share a list meet, unless their centres are too far apart for a link; then each
member of either is held against the other ball: by its angle to the centre all of
the ball's members are linked, or none, or - between the two - they are compared
one by one. Copies and dense groups thus cost in proportion to their size, and a link
is found from both its ends or from neither.

The reference points are REFERENCES vectors out of a hash sample of DRAWN; every
vector is indexed. Recall against brute force is tested (about 0.97 at the
threshold itself, higher above).

Defined cases: null label, null vector, zero vector or a null or non-finite
component: linked with nothing. Repeated rows are vectors of their own. Vectors of
another length than the reference points' stand in one list per label and length.
A null id takes part; components are named by the smallest id that is not null. An
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslint.llm.common import Scratch, connected_components

THRESHOLD = 0.93
REFERENCES, NEAREST, SHARED = 128, 8, 4
DRAWN = 1024
MARGIN = 1e-9


def unit(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """(rows that can link, their unit vectors) of lists of one length."""
    x = np.array([[np.nan if c is None else c for c in v] for v in vectors], np.float64)
    with np.errstate(all="ignore"):
        scale = np.max(np.abs(x), axis=1, initial=0.0)
        x = x / scale[:, None]
        n = np.sqrt((x * x).sum(1))
        ok = np.isfinite(n) & np.isfinite(scale) & (n > 0)
        return np.flatnonzero(ok), x[ok] / n[ok][:, None]


def references(vectors: DataFrame) -> np.ndarray:
    """Up to REFERENCES vectors, no two alike, out of the DRAWN with the smallest hash."""
    rows = (vectors.where("label is not null and embedding is not null and size(embedding) > 0")
            .select("embedding", F.xxhash64("vec_id", "label").alias("h")).orderBy("h").limit(DRAWN).collect())
    if not rows:
        return np.zeros((0, 0))
    sizes = [len(r["embedding"]) for r in rows]
    size = max(sorted(set(sizes)), key=sizes.count)
    _, x = unit([r["embedding"] for r in rows if len(r["embedding"]) == size])
    for limit in (0.8, 0.99):
        chosen = np.zeros((0, size))
        for v in x:
            if len(chosen) < REFERENCES and not (chosen @ v > limit).any():
                chosen = np.vstack([chosen, v])
        if len(chosen) >= NEAREST:
            break
    return chosen


def list_keys(u: np.ndarray, label: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """The lists of each vector: one per SHARED of its NEAREST reference points."""
    near = min(NEAREST, len(refs))
    order = np.argsort(-(u @ refs.T), axis=1, kind="stable")[:, :near]
    sets = np.array(list(combinations(range(near), min(SHARED, near))))
    ids = np.sort(order, axis=1)[:, sets]
    code = (ids * (REFERENCES ** np.arange(sets.shape[1]))).sum(2)
    return code + (label.astype(np.int64)[:, None] << 28)


def prepared(vectors: DataFrame, refs: np.ndarray) -> DataFrame:
    """(rid, vec_id, label, u, keys); u and keys are null for vectors that link with nothing."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label, emb = b.column("label").to_pylist(), b.column("embedding").to_pylist()
            u, keys = [None] * len(emb), [None] * len(emb)
            by_size: dict[int, list[int]] = {}
            for i, v in enumerate(emb):
                if v and label[i] is not None:
                    by_size.setdefault(len(v), []).append(i)
            for size, at in by_size.items():
                ok, x = unit([emb[i] for i in at])
                labels = np.array([label[at[k]] for k in ok], np.int64)
                found = list_keys(x, labels, refs) if len(refs) and size == refs.shape[1] and len(ok) else ((labels << 28) + (1 << 61) + (size << 40))[:, None]
                for k, v, f in zip(ok, x, found):
                    u[at[k]], keys[at[k]] = v, f
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("vec_id"), pa.array(u, pa.list_(pa.float64())), pa.array(keys, pa.list_(pa.int64()))], ["rid", "vec_id", "u", "keys"])

    rows = vectors.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    return rows.mapInArrow(work, "rid long, vec_id long, u array<double>, keys array<long>")


def cosines(pairs: DataFrame) -> DataFrame:
    """Replaces the unit vectors `u` and `v` of each row by their cosine `s`."""
    names = [c for c in pairs.columns if c not in ("u", "v")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, v = b.column("u"), b.column("v")
            a, z = u.flatten().to_numpy(zero_copy_only=False), v.flatten().to_numpy(zero_copy_only=False)
            size = np.array(u.value_lengths().to_numpy(zero_copy_only=False), np.int64)
            same = size == np.array(v.value_lengths().to_numpy(zero_copy_only=False), np.int64)
            if len(size) and same.all():
                s = np.add.reduceat(a * z, np.concatenate([[0], np.cumsum(size)[:-1]]))
            else:
                s = np.array([float(np.dot(x, y)) if len(x) == len(y) else -1.0 for x, y in zip(u.to_pylist(), v.to_pylist())], np.float64)
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(s, pa.float64())], [*names, "s"])

    kinds = dict(pairs.dtypes)
    return pairs.select(*names, "u", "v").mapInArrow(work, ", ".join(f"{n} {kinds[n]}" for n in names) + ", s double")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    angle = math.acos(threshold)
    v = scratch.keep(prepared(vectors, references(vectors)))
    unit_of = v.where("u is not null").select("rid", "u")
    centre_of = unit_of.select(F.col("rid").alias("ball"), F.col("u").alias("v"))
    k = scratch.keep(v.where("u is not null").select("rid", F.explode("keys").alias("key")))
    lists = k.groupBy("key").agg(F.min("rid").alias("lo"), F.max("rid").alias("hi")).where("lo < hi").select("key", "lo")
    tries = k.join(lists, "key").select("rid", F.col("lo").alias("ball")).distinct()
    tight = cosines(tries.join(unit_of, "rid").join(centre_of, "ball")).where(F.col("s") >= math.cos(angle / 2) + MARGIN)
    chosen = tight.groupBy("rid").agg(F.min(F.struct("ball", "s")).alias("x")).select("rid", "x.ball", "x.s")
    ball = scratch.keep(unit_of.select("rid").join(chosen, "rid", "left")
                        .select("rid", F.coalesce("ball", "rid").alias("ball"), F.coalesce("s", F.lit(1.0)).alias("s")))
    balls = scratch.keep(ball.groupBy("ball").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("edge"), F.min("rid").alias("some")))

    kb = k.join(ball.select("rid", "ball"), "rid").select("key", "rid", "ball")
    open_ = kb.groupBy("key").agg(F.min("ball").alias("lo"), F.max("ball").alias("hi")).where("lo < hi").select("key")
    listed = scratch.keep(kb.join(open_, "key").select("key", "ball").distinct())
    # Balls meet if any of their members share a list; then all members of either are held against the other ball,
    # so a link is found from both its ends or from neither.
    two = listed.join(listed.select("key", F.col("ball").alias("other")), "key").where("ball < other").select("ball", "other").distinct()
    radius = balls.select("ball", F.acos(F.least(F.lit(1.0), F.col("edge"))).alias("r"))
    far = angle + F.col("r") + F.col("r2") + MARGIN
    apart = (cosines(two.join(unit_of.select(F.col("rid").alias("ball"), "u"), "ball").join(centre_of.withColumnRenamed("ball", "other"), "other"))
             .join(radius, "ball").join(radius.select(F.col("ball").alias("other"), F.col("r").alias("r2")), "other")
             .where(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("s")))) <= far))
    near = scratch.keep(apart.select("ball", "other"))
    both = near.unionByName(near.select(F.col("other").alias("ball"), F.col("ball").alias("other")))
    meets = both.join(ball.select("ball", "rid"), "ball").select("rid", F.col("other").alias("ball"))
    meets = cosines(meets.join(unit_of, "rid").join(centre_of, "ball")).join(balls, "ball")
    a, r = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("s")))), F.acos(F.least(F.lit(1.0), F.col("edge")))
    alone = F.col("n") == 1  # its centre is its member
    how = (F.when(alone & (F.col("some") == F.col("ball")), F.when(F.col("s") >= threshold, "all").otherwise("none"))
           .when(a + r <= angle - MARGIN, "all").when(a - r > angle + MARGIN, "none").otherwise("each"))
    met = scratch.keep(meets.withColumn("how", how).where("how <> 'none'").select("rid", "ball", "n", "how"))
    member = ball.select("ball", F.col("rid").alias("member"))
    each = met.where("how = 'each'").select("rid", "ball").join(member, "ball").where("rid <> member")
    each = cosines(each.join(unit_of, "rid").join(unit_of.select(F.col("rid").alias("member"), F.col("u").alias("v")), "member"))
    each = each.where(F.col("s") >= threshold).groupBy("rid", "ball").agg(F.count(F.lit(1)).alias("n"))
    links = scratch.keep(met.where("how = 'all'").select("rid", "ball", "n").unionByName(each))

    edges = links.select("rid", F.col("ball").alias("b")).join(ball.select("rid", F.col("ball").alias("a")), "rid").select("a", "b")
    comps = scratch.keep(connected_components(scratch, edges))
    outside = links.groupBy("rid").agg(F.sum("n").alias("outside"))
    full = (v.select("rid", "vec_id").join(ball.select("rid", "ball"), "rid", "left")
            .join(balls.select("ball", "n"), "ball", "left")
            .join(outside, "rid", "left")
            .join(comps.select(F.col("node").alias("ball"), "component"), "ball", "left")
            .select("vec_id", F.coalesce("component", "ball").alias("c"),
                    (F.coalesce(F.col("n") - 1, F.lit(0)) + F.coalesce("outside", F.lit(0))).cast("long").alias("n_links")))
    names = full.where("c is not null").groupBy("c").agg(F.min("vec_id").alias("least"))
    full = full.join(names, "c", "left").withColumn("component_id", F.when(F.col("c").isNull(), F.col("vec_id")).otherwise(F.col("least")))
    return full.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def query(spark, sf_dir):
    from corpuslint.llm.common import table

    return near_duplicates(table(spark, sf_dir, "embeddings"))
