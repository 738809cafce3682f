"""Language-model scoring: a causal self-attention model over subword ids, in numpy.

The model predicts the class of the next subword id from the ids before it, and the
id inside its class by its count. One attention layer with relative positions reads
windows of 32 ids, of which the last 16 are scored: windows overlap by half, every
id is scored once, with 16 to 31 ids of context, in batches of masked attention.
Beside the attention stands a table of class counts after the last id.

Learning reads all texts outside the held-out tenth: word counts, id counts (which
also give the input slots and output classes) and class counts after an id cover
every training text, and so do the gradient steps that give the attention's weights:
each task is a trainer over its whole texts; trainers start from the same weights
and their results are averaged, ROUNDS times. Texts are cut into ids once.

The base score needs each word's count. The FREQUENT most frequent words are sent
to every task (a fixed number); the others meet their counts by a join on the word's
64-bit hash.

Defined cases: a null or empty text is its end only; a null id counts as training;
repeated rows are scored one by one; an empty table gives no rows; without training
texts all counts are 0; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslint.llm.common import Scratch, settings
from corpuslint.llm.subwords import subwords
from corpuslint.llm.textnp import NON_SPACE, column_bytes, release, row_bounds, signed, slices, word_table

HELD_OUT = 0
FREQUENT = 1 << 18
SLOTS, CLASSES, DIM, HALF = 1024, 64, 16, 16
ROUNDS = 2
END_HASH = np.uint64(0x5BD1E9955BD1E995)
#: Distinct words a task holds before it gives them out.
PENDING = 1 << 20
#: Words that a worker remembers while it tokenizes and writes texts.
KNOWN_WORDS = 300_000
#: Rows of a batch on its way to or from a worker: the batches of a task lie in its JVM and in its worker at once.
BATCH_ROWS = "1000"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def held_out():
    """crc32 of the id's digits, mod 10, is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == HELD_OUT, F.lit(False))


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, text, held_out, ids): the ids as two bytes each."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = subwords(path)
        for b in slices(batches, "text"):
            ids, bounds = words.encode(b.column("text"), KNOWN_WORDS)
            ids = ids.astype(np.uint16)
            own = pa.array([ids[a:z].tobytes() for a, z in zip(bounds, bounds[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("text"), b.column("held_out"), own], ["doc_id", "text", "held_out", "ids"])
        words.clear()  # the later stages run in the same worker processes and need no words
        release()

    return docs.mapInArrow(work, "doc_id long, text string, held_out boolean, ids binary")


def ids_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all rows, where each row's begin and the last end)."""
    off, data = column_bytes(column)
    return np.frombuffer(data.tobytes(), np.uint16), off // 2


def assigned(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(input slot, output class) of each id: frequent ids have a slot of their own, classes hold like shares."""
    order = np.argsort(-counts, kind="stable")
    slot = np.full(len(counts), SLOTS - 1, np.int64)
    slot[order[: SLOTS - 1]] = np.arange(SLOTS - 1)
    share = (counts[order] + 0.01) / (counts + 0.01).sum()
    cls = np.zeros(len(counts), np.int64)
    k, room = 0, 1.0 / CLASSES
    left, here = 1.0, 0.0
    for i, s in zip(order.tolist(), share.tolist()):
        if here > 0 and here + s / 2 > room and k < CLASSES - 1:
            left -= here
            k, here = k + 1, 0.0
            room = left / (CLASSES - k)
        cls[i] = k
        here += s
    return slot, cls


def start_weights(seed: int = 4) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    n = lambda *s: (r.normal(0, 1, s) / np.sqrt(s[0])).astype(np.float32)
    return {"e": r.normal(0, 0.5, (SLOTS + 2, DIM)).astype(np.float32), "q": n(DIM, DIM), "k": n(DIM, DIM), "v": n(DIM, DIM), "u": n(DIM, DIM),
            "r": np.zeros(2 * HALF, np.float32), "o": np.zeros((DIM, CLASSES), np.float32)}


PAD, BEGIN = SLOTS, SLOTS + 1
_BACK = np.arange(HALF)[:, None] + HALF - np.arange(2 * HALF)[None, :]  # how far back key j stands of query i


def laid_out(ids: np.ndarray, bounds: np.ndarray, slot: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(input slots, target ids, first block of each row and the end): blocks of HALF, one empty block before each row."""
    size = np.diff(bounds)
    blocks = -(-(size + 1) // HALF) + 1
    first = np.concatenate([[0], np.cumsum(blocks)])
    x, y = np.full(first[-1] * HALF, PAD, np.int64), np.full(first[-1] * HALF, -1, np.int64)
    begin = (first[:-1] + 1) * HALF
    at = np.arange(len(ids)) + np.repeat(begin - bounds[:-1], size)
    x[begin] = BEGIN
    x[at + 1] = slot[ids]
    y[at] = ids
    y[begin + size] = end
    return x.reshape(-1, HALF), y.reshape(-1, HALF), first


def attended(x: np.ndarray, net: dict[str, np.ndarray], table: np.ndarray, blocks: np.ndarray):
    """Class logits of the given blocks (none is a row's empty first block), and what the gradient needs."""
    tabs = {k: net["e"] @ net[k] for k in "qkvu"}
    now, old = x[blocks], x[blocks - 1]
    both = np.concatenate([old, now], axis=1)
    q, k, v = tabs["q"][now], tabs["k"][both], tabs["v"][both]
    s = q @ k.transpose(0, 2, 1)
    s *= np.float32(DIM**-0.5)
    s += np.where(_BACK >= 0, net["r"][np.clip(_BACK, 0, None)], np.float32(-1e9)).astype(np.float32)
    s += np.where(both == PAD, np.float32(-1e9), np.float32(0))[:, None, :]
    np.minimum(s, 60, out=s)
    a = np.exp(s)
    a /= a.sum(axis=2, keepdims=True) + np.float32(1e-30)
    h = a @ v + tabs["u"][now]
    logits = h.reshape(-1, DIM) @ net["o"] + table[now.ravel()]
    return logits, (now, both, q, k, v, a, h)


def log_probabilities(logits: np.ndarray, cls: np.ndarray) -> np.ndarray:
    np.clip(logits, -60, 60, out=logits)
    picked = np.take_along_axis(logits, cls[:, None], 1)[:, 0]
    return picked - np.log(np.exp(logits, out=logits).sum(axis=1))


def gradients(x: np.ndarray, y_class: np.ndarray, net: dict[str, np.ndarray], table: np.ndarray, blocks: np.ndarray) -> dict[str, np.ndarray]:
    logits, (now, both, q, k, v, a, h) = attended(x, net, table, blocks)
    y = y_class[blocks].ravel()
    real = y >= 0
    p = np.exp(np.clip(logits, -60, 60))
    p /= p.sum(axis=1, keepdims=True)
    p[np.flatnonzero(real), y[real]] -= 1
    p[~real] = 0
    p /= max(1, real.sum())
    g = {"o": h.reshape(-1, DIM).T @ p}
    dh = (p @ net["o"].T).reshape(h.shape)
    dv = a.transpose(0, 2, 1) @ dh
    da = dh @ v.transpose(0, 2, 1)
    ds = a * (da - (da * a).sum(axis=2, keepdims=True))
    g["r"] = np.bincount(np.clip(_BACK, 0, None).ravel(), (ds.sum(0) * (_BACK >= 0)).ravel(), 2 * HALF).astype(np.float32)
    ds *= np.float32(DIM**-0.5)
    dq, dk = ds @ k, ds.transpose(0, 2, 1) @ q
    e_now, e_both = net["e"][now].reshape(-1, DIM), net["e"][both].reshape(-1, DIM)
    flat = lambda z: z.reshape(-1, DIM)
    g["q"], g["k"], g["v"], g["u"] = e_now.T @ flat(dq), e_both.T @ flat(dk), e_both.T @ flat(dv), e_now.T @ flat(dh)
    de_now = flat(dq) @ net["q"].T + flat(dh) @ net["u"].T
    de_both = flat(dk) @ net["k"].T + flat(dv) @ net["v"].T
    g["e"] = np.stack([np.bincount(now.ravel(), de_now[:, j], SLOTS + 2) + np.bincount(both.ravel(), de_both[:, j], SLOTS + 2) for j in range(DIM)], axis=1).astype(np.float32)
    return g


class Trainer:
    """Adam on batches of blocks."""

    def __init__(self, net: dict[str, np.ndarray], table: np.ndarray, rate: float):
        self.net, self.table, self.rate, self.t, self.seen = {k: v.copy() for k, v in net.items()}, table, rate, 0, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in net.items()} for _ in range(2))

    def step(self, x: np.ndarray, y_class: np.ndarray, first: np.ndarray, size: int = 256) -> None:
        blocks = np.setdiff1d(np.arange(1, len(x)), first[:-1])
        for a in range(0, len(blocks), size):
            g = gradients(x, y_class, self.net, self.table, blocks[a: a + size])
            self.t += 1
            self.seen += len(blocks[a: a + size])
            for k in self.net:
                self.m[k], self.v[k] = 0.9 * self.m[k] + 0.1 * g[k], 0.99 * self.v[k] + 0.01 * g[k] ** 2
                self.net[k] = (self.net[k] - self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-8)).astype(np.float32)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    by = np.argsort(key, kind="stable")
    key, n = key[by], n[by]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(first) else n


def id_counts(docs: DataFrame, end: int) -> np.ndarray:
    """Counts of all ids and of the end (one row per id that occurs)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(end + 1, np.int64)
        for b in slices(batches, "ids"):
            total += np.bincount(ids_of(b.column("ids"))[0], minlength=len(total))
            total[-1] += b.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    rows = docs.select("ids").mapInArrow(work, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(end + 1)
    for r in rows:
        out[r["id"]] = r["n"]
    return out


WORD, AFTER = 0, 1


def gathered(docs: DataFrame, end: int, slot: np.ndarray, cls: np.ndarray) -> DataFrame:
    """(kind, key, n) over all training texts: counts of words (by hash) and of classes after a slot."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after = np.zeros((SLOTS + 2) * CLASSES, np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def out(kind: int, key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(key), 1 << 16):
                k, c = key[a: a + (1 << 16)], n[a: a + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k.astype(np.int64)), pa.array(c.astype(np.int64))], ["kind", "key", "n"])

        for b in slices(batches, "text"):
            off, data = column_bytes(b.column("text"))
            key, n = np.unique(word_table(off, data, NON_SPACE)[2], return_counts=True)
            parts += [(key, n), (np.array([END_HASH]), np.array([b.num_rows]))]
            held += len(key)
            if held > PENDING:
                key, n = _merged(parts)
                parts, held = [(key, n)], len(key)
                if held > PENDING // 2:
                    yield from out(WORD, signed(key), n)
                    parts, held = [], 0
            x, y, _ = laid_out(*ids_of(b.column("ids")), slot, end)
            real = y >= 0
            after += np.bincount(x[real] * CLASSES + cls[y[real]], minlength=len(after))
        if parts:
            key, n = _merged(parts)
            yield from out(WORD, signed(key), n)
        parts = []
        at = np.flatnonzero(after)
        yield from out(AFTER, at, after[at])
        release()

    return docs.select("text", "ids").mapInArrow(work, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def trained(docs: DataFrame, end: int, slot: np.ndarray, cls: np.ndarray, table: np.ndarray, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Weights after `rounds` rounds of trainers on all the texts; a round's results are averaged by blocks seen."""
    net = start_weights()
    names, shapes = list(net), [net[k].shape for k in net]
    for turn in range(rounds):
        now, rate = net, 0.02 / (turn + 1)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Trainer(now, table, rate)
            for b in slices(batches, "ids", 1 << 17):
                x, y, first = laid_out(*ids_of(b.column("ids")), slot, end)
                own.step(x, np.where(y >= 0, cls[y], -1), first)
            flat = np.concatenate([own.net[k].ravel() for k in names]).astype(np.float64)
            if own.seen:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(np.full(len(flat), float(own.seen))), pa.array(flat)], ["i", "w", "x"])
            release()

        mean = F.round(F.sum(F.col("w") * F.col("x")) / F.sum("w"), 9)
        rows = docs.select("ids").mapInArrow(work, "i int, w double, x double").groupBy("i").agg(mean.alias("x")).collect()  # one row per weight
        if rows:
            flat = np.zeros(sum(int(np.prod(s)) for s in shapes), np.float32)
            flat[[r["i"] for r in rows]] = [r["x"] for r in rows]
            ends = np.cumsum([int(np.prod(s)) for s in shapes])
            net = {k: p.reshape(s) for k, p, s in zip(names, np.split(flat, ends[:-1]), shapes)}
    return net


def lm_scores(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document: the base score and the model's log10 probability of the text."""
    path = path or tokenizer_path()
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    end = subwords(path).size
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=BATCH_ROWS):
        return _scored(docs, path, spark, scratch, end)


def _scored(docs: DataFrame, path: str, spark: SparkSession, scratch: Scratch, end: int) -> DataFrame:
    d = scratch.keep(tokenized(docs.select("doc_id", "text").withColumn("held_out", held_out()), path))
    learn = d.where(~F.col("held_out"))
    ids = id_counts(learn, end)
    slot, cls = assigned(ids)
    counts = scratch.keep(gathered(learn, end, slot, cls))
    word = counts.where(F.col("kind") == WORD).select(F.col("key").alias("h"), F.col("n").alias("c"))
    totals = word.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, below = int(totals["n"]), float(np.log10(totals["n"] + 0.1 * (totals["v"] + 1)))
    after = np.zeros((SLOTS + 2, CLASSES))
    for r in counts.where(F.col("kind") == AFTER).collect():  # at most one row per cell of the table
        after[r["key"] // CLASSES, r["key"] % CLASSES] = r["n"]
    of_class = np.bincount(cls, ids + 0.5, CLASSES)
    inside = np.log((ids + 0.5) / of_class[cls]).astype(np.float32)
    share = of_class / of_class.sum()
    table = np.log((after + 20 * share) / (after.sum(1, keepdims=True) + 20)).astype(np.float32)
    net = trained(learn, end, slot, cls, table)
    often = word.orderBy(F.desc("c"), "h").limit(FREQUENT).toPandas()  # at most FREQUENT rows
    keys = often["h"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(keys)
    sent = spark.sparkContext.broadcast((keys[by], np.log10(often["c"].to_numpy(float) + 0.1)[by]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, logs = sent.value
        rid = TaskContext.get().partitionId() << 40
        for b in slices(batches, "text", 1 << 18):
            n = b.num_rows
            off, data = column_bytes(b.column("text"))
            _, row, h = word_table(off, data, NON_SPACE)
            row, h = np.concatenate([row, np.arange(n)]), np.concatenate([h, np.full(n, END_HASH)])
            at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
            hit = known[at] == h if len(known) else np.zeros(len(h), bool)
            part, found = np.bincount(row[hit], logs[at[hit]], n) if hit.any() else np.zeros(n), np.bincount(row[hit], minlength=n)
            rest, rest_row = h[~hit], row[~hit]
            order = np.lexsort((rest, rest_row))
            rest, rest_row = rest[order], rest_row[order]
            new = np.flatnonzero(np.concatenate([[True], (rest[1:] != rest[:-1]) | (rest_row[1:] != rest_row[:-1])])) if len(rest) else np.zeros(0, np.int64)
            often_there = np.diff(np.append(new, len(rest)))
            ends = row_bounds(rest_row[new], n)
            x, y, first = laid_out(*ids_of(b.column("ids")), slot, end)
            blocks = np.setdiff1d(np.arange(1, len(x)), first[:-1])
            logp = np.zeros(len(x))
            for a in range(0, len(blocks), 2048):
                some = blocks[a: a + 2048]
                target = y[some].ravel()
                logits, _ = attended(x, net, table, some)
                safe = np.maximum(target, 0)
                lp = log_probabilities(logits, cls[safe]) + inside[safe]
                logp[some] = np.where(target >= 0, lp, 0).reshape(-1, HALF).sum(axis=1, dtype=np.float64)
            score = np.add.reduceat(logp, first[:-1]) / np.log(10)
            yield pa.RecordBatch.from_arrays([
                pa.array(rid + np.arange(n)), b.column("doc_id").cast(pa.int64()), b.column("held_out"), pa.array(np.bincount(row, minlength=n)), pa.array(found), pa.array(part), pa.array(score),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(signed(rest[new]))), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(often_there, pa.int64()))],
                ["rid", "doc_id", "held_out", "n_tokens", "found", "part", "score", "hs", "tf"])
            rid += n

    scored = scratch.keep(d.mapInArrow(work, "rid long, doc_id long, held_out boolean, n_tokens long, found long, part double, score double, hs array<long>, tf array<long>"))
    rare = scored.select("rid", F.explode(F.arrays_zip("hs", "tf")).alias("x")).select("rid", F.col("x.hs").alias("h"), F.col("x.tf").alias("tf"))
    got = (rare.join(word, "h").groupBy("rid")
           .agg(F.sum("tf").alias("more"), F.sum(F.col("tf") * F.log10(F.col("c") + 0.1)).alias("sum")))
    full = scored.drop("hs", "tf").join(got, "rid", "left").withColumn("n_known", F.col("found") + F.coalesce("more", F.lit(0)))
    base = F.col("part") + F.coalesce("sum", F.lit(0.0)) - (F.col("n_tokens") - F.col("n_known")) - F.col("n_tokens") * F.lit(below)  # an unknown word counts log10(0.1)
    return full.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def query(spark, sf_dir):
    from corpuslint.llm.common import documents

    return lm_scores(documents(spark, sf_dir))
