"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of ``WINDOW`` consecutive words (the whole item if it has fewer).  A window is the set of its word
shingles.  Since containment asks for all of them, the necessary prefix of a window is its rarest shingle: shingles are counted
over all documents first, and only the rarest of each window is looked for.  Where it occurs, the window can start at one place
only; that place must lie inside the document (position), leave room for the whole window (length), have the window's hash, and
at last hold the same words, byte by byte.

Items come in blocks of bounded size; each block is broadcast and all documents are read against it, so the number of items is
not bounded.  The marks of one block travel on with the document to the next.

Null and empty texts have no words and are never hit.  Null item ids are left out of item lists.  Repeated items count once
for each different id; repeated documents are answered each.  Other columns, of whatever name, are not touched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Members, Words, steps, text_bytes

WINDOW, SHINGLE = 10, 3
#: Bytes of item texts in one block.
BLOCK_BYTES = 4 << 20


@dataclass
class Window:
    words: bytes
    size: int
    hash: int
    shingles: list[int]
    items: list[str]


def windows(items: list[tuple[str, str]], size: int = WINDOW, shingle: int = SHINGLE) -> list[Window]:
    """All different windows of some items, with the hashes of their shingles in order."""
    texts = pa.array([t for _, t in items], pa.string())
    words = Words(*text_bytes(texts))
    runs = {k: words.runs(k) for k in range(1, size + 1)}
    found: dict[bytes, Window] = {}
    for i, (item, _) in enumerate(items):
        low, high = int(words.first[i]), int(words.first[i + 1])
        length = min(size, high - low)
        part = min(shingle, length)
        for start in range(low, high - length + 1) if length else ():
            spelled = b" ".join(words.word(k) for k in range(start, start + length))
            w = found.get(spelled)
            if w is None:
                w = found[spelled] = Window(spelled, length, int(runs[length][start]), runs[part][start:start + length - part + 1].tolist(), [])
            if item not in w.items:
                w.items.append(item)
    return list(found.values())


def blocks(items: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str]]]:
    """Items (id as a string, text) in blocks of at most ``limit`` bytes of text, or one item each."""
    block, size = [], 0
    for row in items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string"), "text").toLocalIterator():
        more = len(row[1].encode())
        if block and size + more > limit:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += more
    if block:
        yield block


def shingle_counts(documents: DataFrame, found: list[Window]) -> dict[int, int]:
    """How often each shingle of the windows occurs in all documents: partial counts in the tasks, then a sum."""
    by_size: dict[int, set[int]] = {}
    for w in found:
        by_size.setdefault(w.size - len(w.shingles) + 1, set()).update(w.shingles)
    sent = documents.sparkSession.sparkContext.broadcast({k: np.array(sorted(v), np.uint64) for k, v in by_size.items()})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = {k: Members(v) for k, v in sent.value.items()}
        totals = {k: np.zeros(len(m.sorted), np.int64) for k, m in sets.items()}
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for low, high in steps(offsets):
                words = Words(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
                for k, m in sets.items():
                    at, place = m.find(words.runs(k))
                    place = place[at + k <= words.first[words.of[at] + 1]]
                    totals[k] += np.bincount(place, minlength=len(m.sorted))
        for k, m in sets.items():
            yield pa.RecordBatch.from_arrays([pa.array(m.sorted.view(np.int64)), pa.array(totals[k])], names=["shingle", "n"])

    rows = documents.select("text").mapInArrow(count, "shingle long, n long").where("n > 0").groupBy("shingle").agg(F.sum("n").alias("n"))
    out = {s & ((1 << 64) - 1): n for s, n in rows.collect()}     # a row for each shingle of the block at most
    sent.unpersist()
    return out


class Index:
    """The rarest shingle of each window, and how to get from it to the window."""

    def __init__(self, found: list[Window], counts: dict[int, int]) -> None:
        self.windows = found
        entries: dict[int, list[tuple[int, int, int]]] = {}
        for number, w in enumerate(found):
            part = w.size - len(w.shingles) + 1
            rarest = min(range(len(w.shingles)), key=lambda i: (counts.get(w.shingles[i], 0), w.shingles[i], i))
            if counts.get(w.shingles[rarest], 0):      # else it occurs nowhere
                entries.setdefault(part, []).append((w.shingles[rarest], number, rarest))
        self.size = np.array([w.size for w in found], np.int64)
        self.hash = np.array([w.hash for w in found], np.uint64)
        self.parts = {}
        for part, rows in entries.items():
            rows.sort()
            shingles = np.array([r[0] for r in rows], np.uint64)
            members = Members(shingles)
            first = np.searchsorted(shingles, members.sorted)
            self.parts[part] = members, first, np.append(first[1:], len(rows)), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])

    def occurrences(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Starts (word places) of windows in the texts, and the windows' numbers."""
        starts, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        runs: dict[int, np.ndarray] = {}
        for part, (members, first, last, window, offset) in self.parts.items():
            at, place = members.find(words.runs(part))
            many = last[place] - first[place]
            entry = np.repeat(first[place], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            at = np.repeat(at, many)
            start, number = at - offset[entry], window[entry]
            inside = (start >= words.first[words.of[at]]) & (start + self.size[number] <= words.first[words.of[at] + 1])
            start, number = start[inside], number[inside]
            for size in np.unique(self.size[number]).tolist():
                if size not in runs:
                    runs[size] = words.runs(size)
                own = self.size[number] == size
                s, n = start[own], number[own]
                same = runs[size][s] == self.hash[n]
                s, n = s[same], n[same]
                real = [b" ".join([words.word(k) for k in range(a, a + size)]) == self.windows[b].words for a, b in zip(s.tolist(), n.tolist())]
                starts.append(s[real])
                numbers.append(n[real])
        return np.concatenate(starts), np.concatenate(numbers)


MARKS = "spans array<struct<low:int,high:int>>, items array<string>, n_words int"


def _mark(rows: DataFrame, index: Index) -> DataFrame:
    """Add the windows of one block to the marks of each row (key, text, spans, items, n_words)."""
    sent = rows.sparkSession.sparkContext.broadcast(index)
    span = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            spans, items, n_words = batch.column("spans").to_pylist(), batch.column("items").to_pylist(), []
            data, offsets = text_bytes(batch.column("text"))
            for low, high in steps(offsets):
                words = Words(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
                n_words.append(np.diff(words.first))
                starts, numbers = index.occurrences(words)
                of = words.of[starts]
                begin = starts - words.first[of]
                for row, a, n in zip((of + low).tolist(), begin.tolist(), numbers.tolist()):
                    spans[row].append({"low": a, "high": a + int(index.size[n])})
                    items[row].extend(index.windows[n].items)
                for row in set((of + low).tolist()):
                    spans[row], items[row] = _merged(spans[row]), sorted(set(items[row]))
            n_words = np.concatenate(n_words) if n_words else np.zeros(0, np.int64)
            out = {"spans": pa.array(spans, span), "items": pa.array(items, pa.list_(pa.string())), "n_words": pa.array(n_words, pa.int32())}
            yield pa.RecordBatch.from_arrays([out.get(n, batch.column(n)) for n in batch.schema.names], names=batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def _merged(spans: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: s["low"]):
        if out and s["low"] <= out[-1]["high"]:
            out[-1]["high"] = max(out[-1]["high"], s["high"])
        else:
            out.append(dict(s))
    return out


def contamination(documents: DataFrame, items: DataFrame, carry: list[str]) -> DataFrame:
    """The columns of ``carry``, text, n_words, the hit word ranges (spans) and the items found (as sorted strings) of each document.

    ``documents`` has text, ``items`` has item_id and text.
    """
    types = dict(f.split(" ", 1) for f in MARKS.split(", "))
    renamed = documents.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(carry)), "text")
    empty = {"spans": F.array().cast(types["spans"]), "items": F.array().cast(types["items"]), "n_words": F.lit(0)}
    rows, seen = renamed.withColumns(empty), False
    for block in blocks(items):
        found = windows(block)
        if found:
            rows, seen = _mark(rows, Index(found, shingle_counts(documents.select("text"), found))), True
    if not seen:
        rows = _mark(rows, Index([], {}))
    return rows.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(carry)), "text", "n_words", "spans", "items")


def op7_decontamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Hit words and items of each document."""
    rows = contamination(documents, benchmark, ["doc_id"])
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.high - s.low)
    return rows.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))
