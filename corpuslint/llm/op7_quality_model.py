"""Quality classifier: a byte-level convolutional network in numpy.

A text is laid out in blocks of 256 bytes. Learned filters eight bytes wide run
over all bytes; a chunk is two neighbouring blocks, so chunks overlap by half and
cover the whole document. Each filter's largest value in a chunk goes through a
hidden layer; the hidden values' largest and mean over all chunks give one
probability by a logistic unit.

The network is trained on about SAMPLE labelled rows outside the held-out fold,
drawn by hash, each with all its blocks; where these hold more than TRAIN_BYTES, fewer
rows are drawn (by hash, whatever their length). Scoring reads every byte of every text.

Defined cases: a null or empty text is one empty block and gets a score like any
other; repeated rows give a row each; of repeated labels the largest counts; an
empty table gives no rows; without labels of both kinds the score is their share
(0.5 without any); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslint.llm.common import Scratch
from corpuslint.llm.textnp import column_bytes, slices

BLOCK_BYTES = 256
WIDTH, STEP, DIM, FILTERS, HIDDEN = 8, 2, 4, 16, 12
SAMPLE = 5000
TRAIN_BYTES = 1 << 25
PIECE = 4096  # blocks that are convolved at once
EPOCHS = 12
BATCH = 64
THRESHOLD = 0.7
HELD_OUT = 2


def laid_out(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all blocks and a spare end, first block of each row and the end). Zero bytes fill up;
    at least WIDTH of them follow each text, so no filter sees two texts."""
    off, data = column_bytes(column)
    size = np.diff(off)
    blocks = -(-(size + WIDTH) // BLOCK_BYTES)
    first = np.concatenate([[0], np.cumsum(blocks)])
    out = np.zeros(first[-1] * BLOCK_BYTES + WIDTH, np.uint8)
    out[np.arange(len(data)) + np.repeat(first[:-1] * BLOCK_BYTES - off[:-1], size)] = data
    return out, first


def start_weights(seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    return {"e": r.normal(0, 0.5, (256, DIM)).astype(np.float32), "w": (r.normal(0, 1, (WIDTH * DIM, FILTERS)) / np.sqrt(WIDTH * DIM)).astype(np.float32),
            "b": np.zeros(FILTERS, np.float32), "w2": (r.normal(0, 1, (FILTERS, HIDDEN)) / np.sqrt(FILTERS)).astype(np.float32), "b2": np.full(HIDDEN, 0.1, np.float32),
            "w3": (r.normal(0, 1, 2 * HIDDEN) / np.sqrt(2 * HIDDEN)).astype(np.float32), "b3": np.zeros(1, np.float32)}


def convolved(raw: np.ndarray, net: dict[str, np.ndarray]) -> np.ndarray:
    """Filter values at every second byte: (steps, FILTERS)."""
    steps = (len(raw) - WIDTH) // STEP
    x = net["e"][raw].reshape(-1, STEP * DIM)
    part = net["w"].reshape(WIDTH // STEP, STEP * DIM, FILTERS)
    out = x[:steps] @ part[0]
    for k in range(1, WIDTH // STEP):
        out += x[k: k + steps] @ part[k]
    return out


def tops(raw: np.ndarray, blocks: int, net: dict[str, np.ndarray], places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Each filter's largest value in each block and, if asked for, its step; piece by piece."""
    top, at = [], []
    for a in range(0, blocks, PIECE):
        z = min(blocks, a + PIECE)
        conv = convolved(raw[a * BLOCK_BYTES: z * BLOCK_BYTES + WIDTH], net).reshape(-1, BLOCK_BYTES // STEP, FILTERS)
        top.append(conv.max(axis=1))
        if places:
            at.append(conv.argmax(axis=1))
    return np.concatenate(top), np.concatenate(at) if places else None


def chunk_pairs(first: np.ndarray) -> np.ndarray:
    """For each block, the other block of its chunk: the next of the same row, or itself at the end."""
    other = np.arange(1, first[-1] + 1)
    other[first[1:] - 1] -= 1
    return other


def forward(raw: np.ndarray, first: np.ndarray, net: dict[str, np.ndarray], train: bool = False):
    top, at = tops(raw, int(first[-1]), net, train)
    other = chunk_pairs(first)
    c = np.maximum(np.maximum(top, top[other]) + net["b"], 0)
    h = np.maximum(c @ net["w2"] + net["b2"], 0)
    rows = len(first) - 1
    most, mean = np.maximum.reduceat(h, first[:-1]), np.add.reduceat(h, first[:-1]) / np.diff(first)[:, None]
    z = np.concatenate([most, mean], axis=1)
    p = 1 / (1 + np.exp(-np.clip(z @ net["w3"] + net["b3"], -30, 30)))
    return (p, at, top, other, c, h, most, z, rows) if train else p


def gradients(raw: np.ndarray, first: np.ndarray, y: np.ndarray, net: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    p, step, top, other, c, h, most, z, rows = forward(raw, first, net, True)
    size = np.diff(first)
    row = np.repeat(np.arange(rows), size)
    d = ((p - y) / rows).astype(np.float32)
    g = {"w3": z.T @ d, "b3": np.array([d.sum()], np.float32)}
    dz = d[:, None] * net["w3"]
    winner = h >= most[row]  # every chunk that reaches the largest value shares in it
    share = winner / np.add.reduceat(winner.astype(np.float32), first[:-1])[row]
    dh = (dz[row, :HIDDEN] * share + dz[row, HIDDEN:] / size[row][:, None]) * (h > 0)
    g["w2"], g["b2"] = c.T @ dh, dh.sum(0)
    dc = (dh @ net["w2"].T) * (c > 0)
    g["b"] = dc.sum(0)
    block = np.where(top >= top[other], np.arange(len(top))[:, None], other[:, None])
    dtop = np.zeros_like(top)
    np.add.at(dtop, (block, np.arange(FILTERS)[None, :]), dc)
    at = step * STEP + np.arange(len(top))[:, None] * BLOCK_BYTES
    used = np.flatnonzero(np.abs(dtop).ravel() > 0)
    g["w"], g["e"] = np.zeros_like(net["w"]), np.zeros_like(net["e"])
    for a in range(0, len(used), PIECE * FILTERS):
        some = used[a: a + PIECE * FILTERS]
        f, pos, val = some % FILTERS, at.ravel()[some], dtop.ravel()[some]
        seen = raw[pos[:, None] + np.arange(WIDTH)]
        emb = net["e"][seen].reshape(len(some), -1)
        for k in range(FILTERS):
            m = f == k
            g["w"][:, k] += emb[m].T @ val[m]
        back = (net["w"].T[f] * val[:, None]).reshape(-1, DIM)
        g["e"] += np.stack([np.bincount(seen.ravel(), back[:, k], 256) for k in range(DIM)], axis=1).astype(np.float32)
    return g


def train(texts: list[tuple[np.ndarray, float]], epochs: int = EPOCHS, seed: int = 7) -> dict[str, np.ndarray]:
    """Adam over minibatches of (blocks of a text, label)."""
    net, r = start_weights(seed), np.random.default_rng(seed)
    m, v, t = {k: np.zeros_like(x) for k, x in net.items()}, {k: np.zeros_like(x) for k, x in net.items()}, 0
    for epoch in range(epochs):
        order = r.permutation(len(texts))
        for a in range(0, len(order), BATCH):
            part = [texts[i] for i in order[a: a + BATCH]]
            raw = np.concatenate([*(x.ravel() for x, _ in part), np.zeros(WIDTH, np.uint8)])
            first = np.concatenate([[0], np.cumsum([len(x) for x, _ in part])])
            g = gradients(raw, first, np.array([y for _, y in part], np.float32), net)
            t += 1
            rate = 0.01 * (1 - 0.9 * epoch / epochs)
            for k in net:
                m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.999 * v[k] + 0.001 * g[k] ** 2
                net[k] = (net[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-7)).astype(np.float32)
    return net


def held_out():
    """crc32 of the id's digits, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> dict[str, np.ndarray]:
    y = labels.where("doc_id is not null and quality is not null").where(~held_out()).groupBy("doc_id").agg(F.max("quality").alias("y"))
    share = min(1.0, most / max(1, y.count()))
    drawn = y.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < int(share * 1_000_000))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            raw, first = laid_out(b.column("text"))
            out = [raw[a * BLOCK_BYTES: z * BLOCK_BYTES].tobytes() for a, z in zip(first, first[1:])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(out, pa.binary())], ["doc_id", "y", "blocks"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["doc_id"], r["y"], r["blocks"]) for b in batches for r in b.to_pylist())
        texts = [(np.frombuffer(raw, np.uint8).reshape(-1, BLOCK_BYTES), float(y)) for _, y, raw in rows]
        share = np.mean([y for _, y in texts]) if texts else 0.5
        net = train(texts) if 0 < share < 1 else {k: np.zeros_like(x) for k, x in start_weights().items()}
        if not 0 < share < 1:
            net["b3"][0] = 0.0 if not texts else 4.0 if share else -4.0
        yield pa.RecordBatch.from_arrays([pa.array(list(net)), pa.array([net[k].ravel().tolist() for k in net], pa.list_(pa.float32()))], ["name", "value"])

    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").mapInArrow(blocks, "doc_id long, y int, blocks binary")
    rows = Scratch(docs.sparkSession, "quality-model").keep(rows)
    all_of = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("blocks")), F.lit(0)).alias("bytes")).first()
    if all_of["bytes"] > TRAIN_BYTES:
        share = max(TRAIN_BYTES / all_of["bytes"], BATCH / all_of["n"])
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1_000_000)) < int(share * 1_000_000))
    # about SAMPLE rows of TRAIN_BYTES together, or BATCH longer ones, meet in the one task that trains
    got = {r["name"]: np.array(r["value"], np.float32) for r in rows.repartition(1).mapInArrow(learn, "name string, value array<float>").collect()}
    return {k: got[k].reshape(x.shape) for k, x in start_weights().items()}


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    net = fit(docs, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            raw, first = laid_out(b.column("text"))
            top, _ = tops(raw, int(first[-1]), net)
            c = np.maximum(np.maximum(top, top[chunk_pairs(first)]) + net["b"], 0)
            h = np.maximum(c @ net["w2"] + net["b2"], 0)
            z = np.concatenate([np.maximum.reduceat(h, first[:-1]), np.add.reduceat(h, first[:-1]) / np.diff(first)[:, None]], axis=1)
            p = 1 / (1 + np.exp(-np.clip(z.astype(np.float64) @ net["w3"] + net["b3"], -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def query(spark, sf_dir):
    from corpuslint.llm.common import documents, table

    return quality_scores(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
