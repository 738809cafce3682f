"""Packing: order-preserving dynamic programming over document and sentence ends.

Each task packs the stream of documents it reads, in their order. Windows of at
most 2048 tokens may end after a document (free), after a sentence (a small
penalty) or, where neither comes for long, inside a sentence (a larger one). The
programme minimises padding plus penalties over all windows; the best predecessor
of a cut is the front of a monotone queue. The stream is worked through in runs of
whole documents; the last window of a run is carried over. What is left at the end
of a task is cut into lengths that are powers of two, which need no padding.

Defined cases: a null or empty text is only its end id; a very long text spans
many sequences; repeated rows are packed one by one; an empty table gives no rows;
other columns are ignored. A task's rows depend only on what it reads, so a lost
task gives the same rows again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpuslint.llm.subwords import subwords
from corpuslint.llm.textnp import slices

LENGTH = 2048
END_ID = 1
SENTENCE_PENALTY = 4
INSIDE_PENALTY = 32
INSIDE_EVERY = 32
RUN_TOKENS = 1 << 20
SENTENCE_ENDS = ".!?"

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def cut(pos: np.ndarray, penalty: np.ndarray, length: int = LENGTH) -> list[int]:
    """Indices into `pos` of the chosen cuts, last included; pos[0] is the start of the run.

    cost(i, j) = length - (pos[j] - pos[i]) + penalty[j], for windows no longer
    than `length`; neighbours in `pos` are never further apart than that.
    """
    p, c = pos.tolist(), (penalty + length).tolist()
    n = len(p)
    value, back = [0] * n, [0] * n  # value: the cost up to a cut and its position
    queue, front, end = [0] * n, 0, 1
    value[0] = p[0]
    for j in range(1, n):
        low = p[j] - length
        while p[queue[front]] < low:
            front += 1
        back[j] = i = queue[front]
        value[j] = v = value[i] + c[j]
        while end > front and value[queue[end - 1]] >= v:
            end -= 1
        queue[end] = j
        end += 1
    out, j = [], n - 1
    while j:
        out.append(j)
        j = back[j]
    return out[::-1]


def candidates(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where windows may end: positions and penalties, position 0 first, the run's end last."""
    cost = np.zeros(len(ids) + 1, np.int64)  # by position; 0: no window ends there
    cost[1:][ends[ids]] = SENTENCE_PENALTY
    cost[0] = cost[doc_ends] = INSIDE_PENALTY
    pos = np.flatnonzero(cost)
    gap = np.diff(pos)
    wide = np.flatnonzero(gap > INSIDE_EVERY)
    more = -(-gap[wide] // INSIDE_EVERY) - 1
    nth = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
    cost[np.repeat(pos[wide], more) + nth * INSIDE_EVERY] = INSIDE_PENALTY
    pos = np.flatnonzero(cost)
    penalty = cost[pos]
    penalty[np.searchsorted(pos, doc_ends)] = 0
    return pos, penalty


def pack_stream(docs: Iterator[tuple[int | None, np.ndarray]], ends: np.ndarray, length: int = LENGTH, run: int = RUN_TOKENS) -> Iterator[list]:
    """Windows of a stream of (doc_id, ids): each a list of (doc_id, start, ids of the piece, doc_tokens)."""
    held: list[tuple] = []  # (doc_id, ids, start of these ids in the document, tokens of the document)
    size = 0

    def windows(last: bool):
        nonlocal held, size
        ids = np.concatenate([h[1] for h in held])
        doc_ends = np.cumsum([len(h[1]) for h in held])
        pos, penalty = candidates(ids, doc_ends, ends)
        at = [0] + [int(pos[k]) for k in cut(pos, penalty, length)]
        if last:
            tail, rest = at[-2], at[-1] - at[-2]
            at.pop()
            for bit in range(rest.bit_length() - 1, -1, -1):
                if rest >> bit & 1:
                    tail += 1 << bit
                    at.append(tail)
        else:
            at.pop()
        begins = doc_ends - [len(h[1]) for h in held]
        k = 0
        for a, z in zip(at, at[1:]):
            out = []
            while a < z:
                while doc_ends[k] <= a:
                    k += 1
                e = min(z, int(doc_ends[k]))
                out.append((held[k][0], held[k][2] + a - int(begins[k]), ids[a:e], held[k][3]))
                a = e
            yield out
        keep = []
        for k in range(k if len(at) > 1 else 0, len(held)):
            if doc_ends[k] > at[-1]:
                skip = max(0, at[-1] - int(begins[k]))
                keep.append((held[k][0], held[k][1][skip:].copy(), held[k][2] + skip, held[k][3]))
        held, size = keep, int(doc_ends[-1]) - at[-1]

    for doc_id, ids in docs:
        held.append((doc_id, ids, 0, len(ids)))
        size += len(ids)
        if size >= run:
            yield from windows(False)
    if held:
        yield from windows(True)


def pack(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of all sequences; `with_ids` adds the piece's token ids."""
    path = path or tokenizer_path()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words = subwords(path)
        strings = [words.tokenizer.id_to_token(i) or "" for i in range(words.size)]
        ends = np.array([s.removesuffix("</w>")[-1:] in tuple(SENTENCE_ENDS) and s.endswith("</w>") for s in strings] + [False])

        def stream():
            for b in slices(batches, "text"):
                ids, bounds = words.encode(b.column("text"))
                for k, doc_id in enumerate(b.column("doc_id").to_pylist()):
                    yield doc_id, np.append(ids[bounds[k]: bounds[k + 1]], np.uint16(END_ID))

        sequence = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        tokens: list[np.ndarray] = []
        for window in pack_stream(stream(), ends):
            offset = 0
            for doc_id, start, ids, total in window:
                rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset))
                offset += len(ids)
                if with_ids:
                    tokens.append(ids.astype(np.int32))
            sequence += 1
            if len(rows) >= 8192:
                yield batch(rows, tokens)
                rows, tokens = [], []
        if rows:
            yield batch(rows, tokens)

    def batch(rows: list[tuple], tokens: list[np.ndarray]) -> pa.RecordBatch:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        cols = [pa.array(c, pa.int64()) for c in zip(*rows)]
        if with_ids:
            bounds = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
            cols.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(tokens), pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(cols, names)

    return docs.select("doc_id", "text").mapInArrow(work, SCHEMA + (", ids array<int>" if with_ids else ""))


def query(spark, sf_dir):
    from corpuslint.llm.common import documents

    return pack(documents(spark, sf_dir))
