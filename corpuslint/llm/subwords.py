"""Subword ids of whole texts: each distinct word of a worker is tokenized once.

The tokenizer's pre-tokenizer ends every piece at white space and its normaliser
works on single characters, so a text's ids are those of its words in order.
"""

from __future__ import annotations

import os
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

from corpuslint.llm.textnp import LOWER, column_bytes

#: Words a worker remembers; beyond that it starts over (more work, same ids).
REMEMBERED = 1_000_000
_LOWER = bytes(LOWER)
_SMALL, _STOP, _SPACE = (np.isin(np.arange(256), list(x)) for x in (b"abcdefghijklmnopqrstuvwxyz", b".,", b" \t\n\v\f\r"))


def _apart(raw: bytes, off: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The texts with a space before each stop or comma that follows a small letter and precedes white space of its text."""
    data = np.frombuffer(raw, np.uint8)
    at = np.flatnonzero(_STOP[data])
    at = at[(at > 0) & (at < len(data) - 1)]
    at = at[_SMALL[data[at - 1]] & _SPACE[data[at + 1]]]
    row = np.searchsorted(off, at, "right") - 1
    at = at[(at > off[row]) & (at + 1 < off[row + 1])]
    return np.insert(data, at, 32).tobytes(), off + np.searchsorted(at, off)


def _words(raw: bytes, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(the words of all rows in order, where each row's begin and the last end)."""
    data = np.frombuffer(raw, np.uint8)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    here = off[:-1][off[:-1] < len(data)]
    first[here] |= inside[here]
    start = np.flatnonzero(first)
    packed = data[inside]  # the words without what stands between them
    ends = np.append((np.cumsum(inside) - 1)[start], len(packed)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(packed)])
    return words, np.searchsorted(start, off)


class Subwords:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self.tokenizer.encode("\x01", add_special_tokens=False).ids
        self.size = self.tokenizer.get_vocab_size()
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 20, np.uint16 if self.size <= 65536 else np.uint32)
        self.start = np.zeros(1 << 18, np.int64)
        self.used = 0

    def _add(self, words: list[bytes]) -> None:
        """Learn the ids of new words: many words in one call, a mark after each."""
        odd = [w for w in words if b"\x01" in w] if len(self.mark) == 1 else words
        plain = [w for w in words if b"\x01" not in w] if len(self.mark) == 1 else []
        texts = [b" \x01 ".join(plain[k: k + 64]).decode("utf-8", "replace") + " \x01" for k in range(0, len(plain), 64)]
        many = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        ids = np.fromiter(chain.from_iterable(e.ids for e in many(texts, add_special_tokens=False)), np.int64)
        marks = np.flatnonzero(ids == self.mark[0])
        if len(marks) != len(plain):  # cannot tell the words apart
            odd, plain, ids, marks = words, [], ids[:0], marks[:0]
        length = np.diff(marks, prepend=-1) - 1
        own = [self._one(w) for w in odd]
        ids = np.concatenate([ids[ids != self.mark[0]], *own])
        length = np.concatenate([length, [len(p) for p in own]]).astype(np.int64)
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(ids), len(self.ids)), self.ids.dtype)])
        k = len(self.known)
        if k + len(length) + 1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros(max(len(length) + 1, len(self.start)), np.int64)])
        self.ids[self.used: self.used + len(ids)] = ids
        self.start[k + 1: k + 1 + len(length)] = self.used + np.cumsum(length)
        self.used += len(ids)
        self.known.update(zip(chain(plain, odd), range(k, k + len(length))))

    def _one(self, word: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids, np.int64)

    def encode(self, column: pa.Array, most: int = REMEMBERED) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, where each row's begin and the last end); at most `most` words are known before."""
        if len(self.known) > most:
            self.clear()
        off, data = column_bytes(column)
        raw = data.tobytes()
        if b"<|" not in raw:  # else a special token's name in capitals would come to count as one
            raw = raw.translate(_LOWER)
        # a stop or comma after a letter and before white space is a piece of its own
        words, first = _words(*_apart(raw, off))
        each = words.dictionary_encode()  # only the distinct words of a block become Python objects
        own = each.dictionary.to_pylist()
        at = np.fromiter(map(self.known.get, own, repeat(-1)), np.int64, len(own))
        new = np.flatnonzero(at < 0)
        if len(new):
            missing = [own[k] for k in new.tolist()]
            self._add(missing)
            at[new] = np.fromiter(map(self.known.__getitem__, missing), np.int64, len(missing))
        of = each.indices.to_numpy(zero_copy_only=False)
        begin = self.start[at]
        length = (self.start[at + 1] - begin)[of]
        begin = begin[of]
        total = np.concatenate([[0], np.cumsum(length)])
        source = np.repeat(begin - total[:-1], length) + np.arange(total[-1])
        return self.ids[source], total[first]


_OPEN: dict[str, Subwords] = {}


def subwords(path: str) -> Subwords:
    """One per worker process and file."""
    if path not in _OPEN:
        _OPEN[path] = Subwords(path)
    return _OPEN[path]
