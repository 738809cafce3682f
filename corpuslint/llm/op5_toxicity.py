"""Toxicity: a chain of linear classifiers over words and word beginnings.

Categories are predicted one after the other; each later linear model also sees
the probabilities of the earlier categories. In training those probabilities are
out-of-fold, so a later model learns from predictions as honest as those it gets.
The label table knows one label; two categories that come before it are derived
from it and the text: `terms` (a toxic text with a telling word) and `repeated`
(a toxic text with at least three).

Features are the presence of a word, or of its first 4 or 5 bytes, among the
FEATURES that a likelihood-ratio test on the labelled sample finds most telling of
toxic texts. The sample has about SAMPLE labelled rows, drawn by hash.

Defined cases: a null or empty text has no features and gets the models' base
rate; repeated rows give a row each; repeated labels of a document count once (the
largest); an empty table gives no rows, and without labels nothing is toxic; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslint.llm.common import Scratch
from corpuslint.llm.textnp import ALNUM, column_bytes, mix, row_bounds, signed, slices, word_table

CATEGORIES = ("terms", "repeated", "toxic")
SAMPLE = 20_000
FEATURES = 2048
FOLDS = 5
MIN_DOCS = 4
STRONG = 0.9
REPEATED = 3
THRESHOLD = 0.5
PREFIXES = (4, 5)


def word_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every word of every row: the word, and its first bytes where it is longer."""
    off, data = column_bytes(column)
    start, row, h = word_table(off, data, ALNUM)
    rows, feats = [row], [h]
    low = np.append(data, np.zeros(8, np.uint8))
    low = np.where((low >= 65) & (low <= 90), low + 32, low).astype(np.uint64)
    word = ALNUM[np.append(data, np.zeros(8, np.uint8))]
    stop = off[row + 1]
    for n in PREFIXES:
        full = start + n < stop
        for k in range(n + 1):
            full &= word[start + k]
        at = start[full]
        key = np.zeros(len(at), np.uint64)
        for k in range(n):
            key = (key << np.uint64(8)) | low[at + k]
        rows.append(row[full])
        feats.append(mix(key ^ np.uint64(n << 56)))
    return np.concatenate(rows), np.concatenate(feats)


def presence(column: pa.Array, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, index into the sorted keys) of the features that are among the keys."""
    row, feat = word_features(column)
    door = np.zeros(1 << 16, bool)
    door[(keys & np.uint64(0xFFFF)).astype(np.int64)] = True
    near = np.flatnonzero(door[(feat & np.uint64(0xFFFF)).astype(np.int64)])
    row, feat = row[near], feat[near]
    k = np.minimum(np.searchsorted(keys, feat), max(0, len(keys) - 1))
    ok = (keys[k] == feat) if len(keys) else np.zeros(len(feat), bool)
    pair = np.unique(row[ok] * (len(keys) + 1) + k[ok])
    return pair // (len(keys) + 1), pair % (len(keys) + 1)


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(doc_id, text, y): about `most` labelled documents, drawn by a hash of the id."""
    y = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    share = min(1.0, most / max(1, y.count()))
    drawn = y.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < int(share * 1_000_000))
    return docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")  # about `most` rows


def telling(rows: DataFrame, most: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """(sorted feature hashes, share of toxic texts among those with the feature)."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            row, feat = word_features(b.column("text"))
            order = np.lexsort((row, feat))
            row, feat = row[order], feat[order]
            new = np.concatenate([[True], (feat[1:] != feat[:-1]) | (row[1:] != row[:-1])]) if len(row) else np.zeros(0, bool)
            row, feat = row[new], feat[new]
            y = b.column("y").to_numpy(zero_copy_only=False).astype(np.int64)[row]
            key, first = np.unique(feat, return_index=True)
            ends = np.append(first[1:], len(feat))
            pos = np.concatenate([[0], np.cumsum(y)])
            yield pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array((ends - first).astype(np.int64)), pa.array((pos[ends] - pos[first]).astype(np.int64))], ["f", "n", "p"])

    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p")).first()
    if not total["p"] or total["p"] == total["n"]:
        return np.zeros(0, np.uint64), np.zeros(0)
    rate = total["p"] / total["n"]
    stats = rows.mapInArrow(emit, "f long, n long, p long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    part = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
    n, p = F.col("n").cast("double"), F.col("p").cast("double")
    gain = part(p, n * rate) + part(n - p, n * (1 - rate))
    best = (stats.where((F.col("p") >= MIN_DOCS) & (p / n > 2 * rate)).withColumn("gain", gain)
            .orderBy(F.desc("gain"), "f").limit(most).collect())  # at most FEATURES rows
    keys = np.array([r["f"] for r in best], np.int64).view(np.uint64)
    by = np.argsort(keys)
    return keys[by], np.array([r["p"] / r["n"] for r in best])[by]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logistic(row: np.ndarray, col: np.ndarray, extra: np.ndarray, y: np.ndarray, width: int, rounds: int = 300, decay: float = 2e-4) -> np.ndarray:
    """Weights of the features, of the extra columns and the bias, by Adam on all rows."""
    w = np.zeros(width + extra.shape[1] + 1)
    w[-1] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        err = _sigmoid(np.bincount(row, w[col], len(y)) + extra @ w[width:-1] + w[-1]) - y
        g = np.concatenate([np.bincount(col, err[row], width), extra.T @ err, [err.sum()]]) / len(y)
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def train_chain(row: np.ndarray, col: np.ndarray, targets: list[np.ndarray], fold: np.ndarray, width: int) -> list[np.ndarray]:
    """One weight vector per category; category k also has the k earlier probabilities as columns."""
    n = len(fold)
    earlier = np.zeros((n, 0))
    chain = []
    for y in targets:
        chain.append(logistic(row, col, earlier, y, width))
        held = np.zeros(n)
        for f in range(FOLDS):
            test = fold == f
            if not test.any() or test.all():
                continue
            number = np.cumsum(~test) - 1
            use = ~test[row]
            w = logistic(number[row[use]], col[use], earlier[~test], y[~test], width)
            held[test] = _sigmoid(np.bincount(row, w[col], n) + earlier @ w[width:-1] + w[-1])[test]
        earlier = np.column_stack([earlier, held])
    return chain


def chain_probabilities(row: np.ndarray, col: np.ndarray, n: int, chain: list[np.ndarray], width: int) -> np.ndarray:
    p = np.zeros((n, 0))
    for w in chain:
        p = np.column_stack([p, _sigmoid(np.bincount(row, w[col], n) + p @ w[width:-1] + w[-1])])
    return p


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, list[np.ndarray]]:
    rows = Scratch(docs.sparkSession, "toxic").keep(sample(docs, labels))
    keys, share = telling(rows)
    if not len(keys):
        return keys, []

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            row, col = presence(b.column("text"), keys)
            bounds = row_bounds(row, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(np.split(col, bounds[1:-1]), pa.list_(pa.int64()))], ["doc_id", "y", "cols"])

    got = rows.mapInArrow(reduce, "doc_id long, y int, cols array<long>").orderBy("doc_id").collect()  # about SAMPLE rows
    sizes = [len(r["cols"]) for r in got]
    row, col = np.repeat(np.arange(len(got)), sizes), np.array([c for r in got for c in r["cols"]], np.int64)
    y = np.array([r["y"] for r in got], float)
    strong = np.bincount(row, (share[col] >= STRONG).astype(float), len(got))
    targets = [y * (strong >= 1), y * (strong >= REPEATED), y]
    fold = (mix(np.array([r["doc_id"] for r in got], np.int64).view(np.uint64)) % np.uint64(FOLDS)).astype(np.int64)
    return keys, train_chain(row, col, targets, fold, len(keys))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, keep: bool = False) -> DataFrame:
    """Per document p_<category> and `toxic`; with `keep`, the input's rows that are not toxic instead."""
    keys, chain = fit(docs, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            row, col = presence(b.column("text"), keys)
            p = chain_probabilities(row, col, b.num_rows, chain, len(keys)) if chain else np.zeros((b.num_rows, len(CATEGORIES)))
            if keep:
                yield b.filter(pa.array(p[:, -1] < threshold))
            else:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(p[:, k]) for k in range(p.shape[1])], pa.array(p[:, -1] >= threshold)],
                                                 ["doc_id", *[f"p_{c}" for c in CATEGORIES], "toxic"])

    if keep:
        return docs.mapInArrow(score, docs.schema)
    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, " + ", ".join(f"p_{c} double" for c in CATEGORIES) + ", toxic boolean")


def query(spark, sf_dir):
    from corpuslint.llm.common import documents, table

    return toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
