"""Licence scan: exact containment join of text blocks (lines) with licence templates.

A line matches a template when it holds at least THRESHOLD of the template's
distinct words. Words of templates are ordered by how many lines of the corpus
hold them, rarest first (one counting pass). A line can only reach the threshold
if it holds one of a template's first |T| - need + 1 words (prefix filter), has at
least `need` words (length filter) and has enough template words left from the
first shared one on (positional filter); the rest are counted exactly. Templates
are a fixed list, so each task holds their index.

A notice wrapped over several lines is found in runs of words: a run half as long
again as the template that goes over the end of a line and holds THRESHOLD of the
template's distinct words matches too, under the same prefix and length filters,
unless one of its lines matches by itself. Comment marks are no words. Runs that
overlap are one match, at the line where the best (the first of equals) begins.

Beside that the places of fixed licence phrases are counted over the words of the
whole text; hits found by hash are compared byte by byte.

Defined cases: a null or empty text has no words, no places and empty labels;
repeated rows give a row each; an empty table gives no rows; other columns are
ignored; a line without words matches nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslint.llm.textnp import ALNUM, LOWER, column_bytes, row_bounds, slices, word_ends, word_table

THRESHOLD = 0.8
#: Phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Notices and the labels of lines that hold them.
TEMPLATES = (
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("mit-notice", "Released under the MIT License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("all-rights-reserved", "All rights reserved"),
)


def template_words(text: str) -> list[bytes]:
    off, data = column_bytes(pa.array([text]))
    s, row, _ = word_table(off, data, ALNUM)
    e = word_ends(s, row, off, data, ALNUM)
    return [bytes(LOWER[data[a:z]]) for a, z in zip(s, e)]


def hash_of(words: list[bytes]) -> np.ndarray:
    off, data = column_bytes(pa.array([w.decode() for w in words]))
    return word_table(off, data, ALNUM)[2]


VOCABULARY = sorted({w for _, t in TEMPLATES for w in template_words(t)})


def block_words(column: pa.Array, keys: np.ndarray, rank: np.ndarray):
    """Words of the rows, and the distinct (line, rank) pairs of template words, ordered.

    Lines are numbered through all rows of the column.
    """
    off, data = column_bytes(column)
    start, row, h = word_table(off, data, ALNUM)
    breaks = np.flatnonzero(data == 10)
    line = np.searchsorted(breaks, start, "right") + row  # a row's end ends its last line
    k = np.searchsorted(keys, h)
    k[k == len(keys)] = 0
    hit = np.flatnonzero(keys[k] == h) if len(h) else np.zeros(0, np.int64)
    pair = np.unique(line[hit] * len(keys) + rank[k[hit]]) if len(hit) else np.zeros(0, np.int64)
    return off, data, start, row, h, line, breaks, hit, rank[k[hit]], pair // len(keys), pair % len(keys)


def wrapped(at: np.ndarray, word: np.ndarray, row: np.ndarray, line: np.ndarray, ranks: list[int], need: int, length: int, matched: set[int]) -> list[tuple[int, int]]:
    """(first template word's place, words held) of the runs over line ends that match; `at` and `word` are the places of template words."""
    own = np.isin(word, ranks)
    at, word = at[own], word[own]
    rows = row[at]
    hits = np.flatnonzero(np.isin(word, ranks[: len(ranks) - need + 1]))
    low, high = np.searchsorted(at, at[hits] - length, "right"), np.searchsorted(at, at[hits] + length, "left")
    out, last = [], -1
    starts = {s for f, a, z in zip(hits.tolist(), low.tolist(), high.tolist()) if z - a >= need and int(line[at[f]]) not in matched for s in range(a, f + 1)}
    for s in sorted(starts):
        z = min(int(np.searchsorted(at, at[s] + length, "left")), int(np.searchsorted(rows, rows[s], "right")))
        held = len(set(word[s:z].tolist()))
        if held < need:
            continue
        lines = range(int(line[at[s]]), int(line[at[z - 1]]) + 1)
        if len(lines) < 2 or not matched.isdisjoint(lines):
            continue
        if out and at[s] <= last:  # overlaps the run before
            if held > out[-1][1]:
                out[-1] = (int(at[s]), held)
        else:
            out.append((int(at[s]), held))
        last = int(at[z - 1])
    return out


def frequencies(docs: DataFrame) -> dict[int, int]:
    """In how many lines of the corpus each template word occurs (one row per template word)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = np.sort(hash_of(VOCABULARY))
        total = np.zeros(len(keys), np.int64)
        for b in slices(batches, "text"):
            total += np.bincount(block_words(b.column("text"), keys, np.arange(len(keys)))[-1], minlength=len(keys))
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(total)], ["word", "n"])

    rows = docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r["word"]: r["n"] for r in rows}


def license_scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document; `matches` lists (line, label, containment) of every matching line."""
    seen = frequencies(docs)
    hashes = {w: int(h) for w, h in zip(VOCABULARY, hash_of(VOCABULARY).view(np.int64))}
    order = sorted(VOCABULARY, key=lambda w: (seen.get(hashes[w], 0), w))  # rarest first
    place = {w: i for i, w in enumerate(order)}
    templates = [(label, sorted({place[w] for w in template_words(text)}), len(template_words(text)) * 3 // 2) for label, text in TEMPLATES]
    schema = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
              "score double, matches array<struct<line:long,label:string,containment:double>>")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = hash_of(order)
        by = np.argsort(own)
        keys, rank = own[by], by
        phrases = [(template_words(p), hash_of(template_words(p)), label) for p, label in PHRASES]
        for b in slices(batches, "text"):
            off, data, start, row, h, line, breaks, at_word, which_word, block, word = block_words(b.column("text"), keys, rank)
            n = b.num_rows
            bounds = row_bounds(row, n)
            base, labels, places = [set() for _ in range(n)], [set() for _ in range(n)], [[] for _ in range(n)]
            for text, want, label in phrases:
                m = len(want)
                at = np.flatnonzero(h[: len(h) - m + 1] == want[0]) if len(h) >= m else np.zeros(0, np.int64)
                for k in range(1, m):
                    at = at[h[at + k] == want[k]]
                at = at[row[at] == row[at + m - 1]] if len(at) else at
                if len(at):
                    ends = [word_ends(start[at + k], row[at + k], off, data, ALNUM) for k in range(m)]
                for j, a in enumerate(at):
                    if all(bytes(LOWER[data[start[a + k]: ends[k][j]]]) == text[k] for k in range(m)):
                        r = int(row[a])
                        base[r].add(label)
                        places[r].append(int(a - bounds[r]))
            found = [[] for _ in range(n)]
            starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, np.int64)
            lines, stops = block[starts] if len(block) else block, np.append(starts[1:], len(block))
            def add(label: str, ranks: list[int], at: int, both: int) -> None:
                r = int(row[at])
                number = int(line[at]) - r - int(np.searchsorted(breaks, off[r]))
                found[r].append({"line": number, "label": label, "containment": both / len(ranks)})
                labels[r].add(label)

            for label, ranks, length in templates:
                matched = set()
                need = math.ceil(threshold * len(ranks) - 1e-9)
                prefix = ranks[: len(ranks) - need + 1]
                hits = np.flatnonzero(np.isin(word, prefix))
                which, first = np.unique(np.searchsorted(starts, hits, "right") - 1, return_index=True)
                for g, f in zip(which, hits[first]):
                    left = len(ranks) - ranks.index(int(word[f]))
                    words_in_line = np.searchsorted(line, lines[g], "right") - np.searchsorted(line, lines[g], "left")
                    if words_in_line < need or min(left, int(stops[g] - f)) < need:
                        continue
                    both = len(set(ranks).intersection(word[starts[g]: stops[g]].tolist()))
                    if both >= need:
                        matched.add(int(lines[g]))
                        add(label, ranks, int(np.searchsorted(line, lines[g], "left")), both)
                for at, both in wrapped(at_word, which_word, row, line, ranks, need, length, matched):
                    add(label, ranks, at, both)
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id").cast(pa.int64()), pa.array(np.diff(bounds)), pa.array([len(p) for p in places], pa.int64()),
                pa.array([min(p) if p else None for p in places], pa.int64()), pa.array([max(p) if p else None for p in places], pa.int64()),
                pa.array([",".join(sorted(x)) for x in base], pa.string()), pa.array([",".join(sorted(x | y)) for x, y in zip(base, labels)], pa.string()),
                pa.array([max([0.0, *(f["containment"] for f in x)]) for x in found], pa.float64()),
                pa.array(found, pa.list_(pa.struct([("line", pa.int64()), ("label", pa.string()), ("containment", pa.float64())])))],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"])

    return docs.select("doc_id", "text").mapInArrow(scan, schema)


def query(spark, sf_dir):
    from corpuslint.llm.common import documents

    return license_scan(documents(spark, sf_dir)).drop("matches")
