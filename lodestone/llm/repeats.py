"""Exact removal of repeated 100-byte strings: a sparse suffix sort over the corpus with hash-compared suffixes.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts earlier (in a smaller doc_id, or earlier in the document).

1. *Anchors.*  The windows of a text (starts of ``LENGTH`` bytes) are dealt to anchors: the place of the smallest hashed
   ``GRAM``-gram inside the window.  Equal windows have equal anchors at equal distance, wherever they stand, so windows need only
   be compared with those of anchors with the same gram.  The neighbouring windows of one anchor are a segment.
2. *Equal segments.*  Segments are hashed.  Of equal ones all but the first go as a whole: first inside a step of a task, so that a
   passage of many documents is thinned before it is shuffled, then by gram over the corpus, read in sorted order with the state
   of one segment.  A gram with one segment left is done.
3. *Suffix sort.*  What is left of a gram with different segments is fetched from the texts, and its windows are sorted as
   suffixes by a stable mergesort.  Two suffixes are compared by their longest common extension, found by binary search over
   prefix polynomial hashes in log2(100) steps.  Neighbours that agree are compared byte by byte; groups where a hash was wrong
   are sorted by their bytes.
4. A gram with more than ``MEMBERS`` different segments is dealt again: its segments are cut where the distance of window and anchor
   passes a multiple of ``BLOCK``, and each part goes with those of the same distances; should a part still be shared by too many, its
   windows go by their bytes' hash, of equal ones in a batch only the first.  What has been dealt again is sorted in the same way.
5. *Removal.*  Ranges are merged for each document.  Texts are shuffled only for documents that may have wanted segments (3.) or ranges:
   a table of bits of bounded size turns most others away, the joins decide.

Whole segments count as equal if their grams (64 bits) and two hashes of the whole with different bases (128 bits) agree.  Matches never cross
documents.  Null texts count as empty, a null id comes before all others.  Rows that share a doc_id are not earlier than each
other; each is judged by smaller ids and by itself.  Very long texts are worked on in overlapping pieces.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import BASE, BASE_INVERSE, OTHER, OTHER_INVERSE, STEP_BYTES, Sieve, mixed, powers, prefix_hashes, range_hashes, steps, text_bytes
from lodestone.session import cut_lineage, scratch

LENGTH, GRAM = 100, 32
#: Different segments of one gram that a task holds; windows that it sorts at once; distances that stay together when a gram is dealt again.
MEMBERS, SORTED, BLOCK = 1 << 15, 300_000, 8

_LOW = -(1 << 63)


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Gram hash, text, first window, last window, anchor and two hashes of all segments (places in ``data``)."""
    width = LENGTH - GRAM + 1
    if len(data) < LENGTH:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    sums, at = prefix_hashes(data), np.arange(len(data) - GRAM + 1)
    grams = range_hashes(sums, at, at + GRAM)
    # smallest by 38 bits of hash, then leftmost: the place is part of the value
    bits = np.uint64(max(26, int(len(data)).bit_length()))
    value = (grams >> bits) << bits | at.astype(np.uint64)
    blocks = np.concatenate((value, np.full(-len(value) % width, ~np.uint64(0)))).reshape(-1, width)
    ahead, back = np.minimum.accumulate(blocks, axis=1).ravel(), np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.arange(len(data) - LENGTH + 1)
    anchor = (np.minimum(back[starts], ahead[starts + width - 1]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[starts]
    inside = starts + LENGTH <= offsets[text + 1]
    starts, anchor, text = starts[inside], anchor[inside], text[inside]
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    first, last = first[:len(last)], last[:len(first)]
    low, high, anchor = starts[first], starts[last], anchor[first]
    whole = mixed(range_hashes(sums, low, high + LENGTH) + ((anchor - low) * 256 + high - low).astype(np.uint64))
    other = range_hashes(prefix_hashes(data, OTHER), low, high + LENGTH, OTHER_INVERSE)
    return grams[anchor], text[first], low, high, anchor, whole, other


def later(group: np.ndarray, doc: np.ndarray, version: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which rows, sorted by (group, doc, version, start), have an equal one that is earlier."""
    n = len(group)
    new = np.ones(n, bool)
    new[1:] = group[1:] != group[:-1]
    own = new.copy()
    own[1:] |= (doc[1:] != doc[:-1]) | (version[1:] != version[:-1])
    place = np.arange(n)
    first = np.maximum.accumulate(np.where(new, place, 0))
    block = np.maximum.accumulate(np.where(own, place, 0))
    return (doc > doc[first]) | (start > start[block])


#: kind 0: bytes start .. end of a document go.  kind 1: a segment.  window = first window, shape = (anchor - window) x 256 + windows - 1.
FOUND = "kind int, gram long, whole long, other long, doc long, version long, window int, shape int"
_FOUND = pa.schema([("kind", pa.int32()), ("gram", pa.int64()), ("whole", pa.int64()), ("other", pa.int64()), ("doc", pa.int64()), ("version", pa.int64()), ("window", pa.int32()), ("shape", pa.int32())])


def _rows(kind: int, gram: np.ndarray, whole: np.ndarray, other: np.ndarray, doc: np.ndarray, version: np.ndarray, window: np.ndarray, shape: np.ndarray) -> pa.RecordBatch:
    columns = [np.full(len(doc), kind, np.int32), gram.view(np.int64), whole.view(np.int64), other.view(np.int64), doc, version, window.astype(np.int32), shape.astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], schema=_FOUND)


def _ranges(doc: np.ndarray, version: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
    """Rows of kind 0; touching ranges of neighbouring rows are one.  The gram spreads them over the partitions."""
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (version[1:] != version[:-1]) | (low[1:] > high[:-1]) | (low[1:] < low[:-1])
    first = np.flatnonzero(new)
    top = np.maximum.reduceat(high, first) if len(first) else high
    doc, version, low = doc[first], version[first], low[first]
    none = np.zeros(len(doc), np.uint64)
    return _rows(0, mixed(doc.view(np.uint64)), none, none, doc, version, low, top)


def found_segments(rows: DataFrame) -> DataFrame:
    """Segments of all texts (doc, version, text), thinned inside each step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1)]
            data, offsets = text_bytes(batch.column(2))
            for a, b in steps(offsets):
                base = int(offsets[a])
                size = int(offsets[b]) - base
                piece = STEP_BYTES if size > 2 * STEP_BYTES else max(size, 1)         # a long text, alone in its step
                for shift in range(0, max(size, 1), piece):
                    low, high = base + shift, min(base + shift + piece + LENGTH - 1, base + size)
                    inner = np.clip(offsets[a:b + 1], low, high) - low
                    gram, text, first, last, anchor, whole, other = segments(data[low:high], inner)
                    if not len(gram):
                        continue
                    doc, version = ids[0][a + text], ids[1][a + text]
                    origin = offsets[a + text] - low
                    order = np.lexsort((first, version, doc, other, whole, gram))
                    gram, first, last, anchor, whole, other, doc, version, origin = (x[order] for x in (gram, first, last, anchor, whole, other, doc, version, origin))
                    same = np.cumsum(np.concatenate(([True], (gram[1:] != gram[:-1]) | (whole[1:] != whole[:-1]) | (other[1:] != other[:-1]))))
                    gone = later(same, doc, version, first)
                    keep = ~gone
                    yield _rows(1, gram[keep], whole[keep], other[keep], doc[keep], version[keep], (first - origin)[keep], ((anchor - first) * 256 + last - first)[keep])
                    if gone.any():
                        parts = [x[gone] for x in (doc, version, first - origin, last - origin + LENGTH)]
                        order = np.lexsort((parts[2], parts[1], parts[0]))
                        yield _ranges(*(x[order] for x in parts))

    return rows.mapInArrow(run, FOUND)


def equal_segments(found: DataFrame) -> DataFrame:
    """Of equal segments all but the first become ranges; segments that share a gram with different ones stay (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram_now = whole_now = other_now = None        # where the last batch ended
        first_doc = block = None                       # of the segment: its first document; document, version and start of the last
        several, held = False, None                    # whether the gram has several segments; its rows while it has one
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            done = columns[0] == 0
            if done.any():
                yield batch.filter(pa.array(done))
            gram, whole, other, doc, version, window, shape = (c[~done] for c in columns[1:])
            n = len(gram)
            if not n:
                continue
            new_gram, new = np.ones(n, bool), np.ones(n, bool)
            new_gram[1:] = gram[1:] != gram[:-1]
            new[1:] = new_gram[1:] | (whole[1:] != whole[:-1]) | (other[1:] != other[:-1])
            new_gram[0] = gram_now != gram[0]
            new[0] = new_gram[0] or whole_now != whole[0] or other_now != other[0]
            own = new.copy()
            own[1:] |= (doc[1:] != doc[:-1]) | (version[1:] != version[:-1])
            own[0] = new[0] or block[:2] != (doc[0], version[0])
            place = np.arange(n)
            at = np.maximum.accumulate(np.where(new, place, -1))
            lead = np.where(at >= 0, doc[at], first_doc if first_doc is not None else 0)
            at = np.maximum.accumulate(np.where(own, place, -1))
            start = np.where(at >= 0, window[at], block[2] if block else 0)
            gone = (doc > lead) | (window > start)
            group = np.cumsum(new_gram)                # 0: the gram that the last batch ended with
            kinds = np.bincount(group, new, group[-1] + 1).astype(int)
            kinds[0] += (2 if several else 1) if not new_gram[0] else 0
            if not new_gram[0] and not several and kinds[0] > 1 and held is not None:
                yield held
            if new_gram[0] or kinds[0] > 1:
                held = None
            stay = ~gone
            out = stay & (kinds[group] > 1)
            if out.any():
                yield _rows(1, *(c[out] for c in (gram, whole, other, doc, version, window, shape)))
            if gone.any():
                order = np.lexsort((window[gone], version[gone], doc[gone]))
                low = window[gone].astype(np.int64)
                yield _ranges(*(x[order] for x in (doc[gone], version[gone], low, low + (shape[gone] & 255) + LENGTH)))
            several = bool(kinds[group[-1]] > 1)
            if not several:
                last = stay & (group == group[-1])
                more = _rows(1, *(c[last] for c in (gram, whole, other, doc, version, window, shape)))
                held = more if held is None else pa.concat_batches([held, more])
            gram_now, whole_now, other_now, first_doc, block = gram[-1], whole[-1], other[-1], lead[-1], (doc[-1], version[-1], start[-1])

    order = ["gram", "whole", "other", "doc", "version", "window"]
    return found.repartition("gram").sortWithinPartitions(*order).mapInArrow(run, FOUND)


class Suffixes:
    """Suffixes of some bytes, compared on their first ``LENGTH`` bytes by hashes."""

    def __init__(self, data: np.ndarray) -> None:
        self.data, self.sums = data, prefix_hashes(data)
        self.back = powers(len(data) + 1, BASE_INVERSE)

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common extension, ``LENGTH`` at most, by binary search."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), LENGTH)
        sums_a, sums_b, back_a, back_b = self.sums[a], self.sums[b], self.back[a], self.back[b]
        for _ in range(int(LENGTH).bit_length()):
            middle = (low + high + 1) // 2
            same = (self.sums[a + middle] - sums_a) * back_a == (self.sums[b + middle] - sums_b) * back_b
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Below, at or above zero as suffix a comes before, with or after b."""
        length = self.extension(a, b)
        end = length == LENGTH
        at = np.where(end, 0, length)
        return np.where(end, 0, self.data[a + at].astype(np.int64) - self.data[b + at])

    def sort(self, suffix: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Stable mergesort inside groups: the order of ``suffix``, whose row i belongs to the group of rows low[i] .. high[i]."""
        order, place, width = np.arange(len(suffix)), np.arange(len(suffix)), 1
        most = int((high - low).max(initial=0))
        while width < most:
            local = place - low
            block = local // width
            begin = low + (block ^ 1) * width
            end = np.minimum(begin + width, high)
            left, right, after = begin.copy(), np.maximum(end, begin), block % 2 == 1
            while True:                                # how many of the other run come before each row
                open_ = np.flatnonzero(left < right)
                if not len(open_):
                    break
                middle = (left[open_] + right[open_]) // 2
                sign = self.compare(suffix[order[middle]], suffix[order[open_]])
                up = (sign < 0) | (after[open_] & (sign == 0))
                left[open_] = np.where(up, middle + 1, left[open_])
                right[open_] = np.where(up, right[open_], middle)
            target = low + (block & ~1) * width + local - block * width + left - begin
            merged = np.empty_like(order)
            merged[target] = order
            order, width = merged, 2 * width
        return order

    def bytes_at(self, suffix: np.ndarray) -> np.ndarray:
        return self.data[suffix[:, None] + np.arange(LENGTH)]


def repeated_windows(data: np.ndarray, first: np.ndarray, shape: np.ndarray, group: np.ndarray, doc: np.ndarray, version: np.ndarray,
                     window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of segments (bytes from ``first`` in ``data``, sorted by group, doc, version, window) that occur earlier: segment and number."""
    count = (shape & 255) + 1
    segment = np.repeat(np.arange(len(first)), count)
    number = np.arange(len(segment)) - np.repeat(np.cumsum(count) - count, count)
    distance = number - (shape >> 8)[segment]
    suffixes, found = Suffixes(data), []
    by_distance = np.argsort(distance, kind="stable") if len(segment) > 2 * SORTED else np.arange(len(segment))
    edges = np.append(np.flatnonzero(np.diff(distance[by_distance], prepend=1000)), len(segment)) if len(segment) > 2 * SORTED else np.array([0, len(segment)])
    low = 0
    while low < len(edges) - 1:                        # a large gram is sorted some distances at a time
        high = max(low + 1, int(np.searchsorted(edges, edges[low] + SORTED, "right")) - 1)
        at = by_distance[edges[low]:edges[high]]
        found.append(_repeated(suffixes, segment[at], number[at], distance[at], first, group, doc, version, window))
        low = high
    segment, number = (np.concatenate(x) for x in zip(*found)) if found else (segment, number)
    order = np.lexsort((number, segment))
    return segment[order], number[order]


def _repeated(suffixes: Suffixes, segment: np.ndarray, number: np.ndarray, distance: np.ndarray, first: np.ndarray, group: np.ndarray, doc: np.ndarray,
              version: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for some of the windows."""
    # only windows at the same distance from the anchor can agree
    order = np.lexsort((number, segment, distance, group[segment]))
    segment, number, key = segment[order], number[order], (group[segment] * 256 + distance + 128)[order]
    edges = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    size = np.diff(edges)
    several = np.repeat(size > 1, size)
    segment, number, key = segment[several], number[several], key[several]
    size = size[size > 1]
    if not len(size):
        return segment[:0], number[:0]
    low = np.repeat(np.cumsum(size) - size, size)
    high = low + np.repeat(size, size)
    start = first[segment] + number
    sorted_ = suffixes.sort(start, low, high)
    same = np.zeros(len(sorted_), bool)
    same[1:] = (key[sorted_[1:]] == key[sorted_[:-1]])
    at = np.flatnonzero(same)
    same[at] = suffixes.extension(start[sorted_[at]], start[sorted_[at - 1]]) == LENGTH
    wrong: list[int] = []
    for part in np.array_split(np.flatnonzero(same), max(1, int(same.sum()) // 20_000)):
        differs = (suffixes.bytes_at(start[sorted_[part]]) != suffixes.bytes_at(start[sorted_[part - 1]])).any(axis=1)
        wrong += np.unique(key[sorted_[part[differs]]]).tolist()
    run = np.cumsum(~same)
    for k in wrong:                                    # a hash agreed where bytes do not: sort this group by its bytes
        rows = np.flatnonzero(key == k)
        spelled = [r.tobytes() for r in suffixes.bytes_at(start[rows])]
        by = sorted(range(len(rows)), key=lambda i: (spelled[i], i))
        sorted_[rows[0]:rows[-1] + 1] = rows[by]
        fresh = [i == 0 or spelled[by[i]] != spelled[by[i - 1]] for i in range(len(by))]
        same[rows[0]:rows[-1] + 1] = ~np.array(fresh)
        run = np.cumsum(~same)
    segment, number = segment[sorted_], number[sorted_]
    gone = later(run, doc[segment], version[segment], window[segment] + number)
    return segment[gone], number[gone]


FETCHED = "gram long, doc long, version long, window int, shape int, bytes binary"
_FETCHED = pa.schema([("gram", pa.int64()), ("doc", pa.int64()), ("version", pa.int64()), ("window", pa.int32()), ("shape", pa.int32()), ("bytes", pa.binary())])


def _key() -> Column:
    return F.xxhash64("doc", "version")


def known_documents(documents: DataFrame) -> Sieve:
    """A table of bits, of bounded size, for the keys of some documents (doc, version): it turns most others away before texts are shuffled."""
    return Sieve(documents.select("doc", "version").distinct().select(_key().alias("key")), "key")


def may_be_among(sieve: Sieve) -> Column:
    """Whether a document may be one of those of the table; true for all that are."""

    @F.pandas_udf("boolean")
    def passes(keys: pd.Series) -> pd.Series:
        return pd.Series(sieve.passes(keys.to_numpy().view(np.uint64)))

    return passes(_key())


def fetched(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of wanted segments, from the texts."""
    rows = rows.where(may_be_among(known_documents(wanted)))
    lists = wanted.groupBy("doc", "version").agg(F.collect_list(F.struct("gram", "window", "shape")).alias("segments"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = (batch.column(2)[i].as_py() or "").encode()
                parts = batch.column(3)[i].values
                window, shape = parts.field("window").to_numpy(), parts.field("shape").to_numpy()
                spelled = [text[w:w + (s & 255) + LENGTH] for w, s in zip(window.tolist(), shape.tolist())]
                n = len(parts)
                yield pa.RecordBatch.from_arrays([parts.field("gram"), pa.array([batch.column(0)[i].as_py()] * n, pa.int64()), pa.array([batch.column(1)[i].as_py()] * n, pa.int64()),
                                                  pa.array(window), pa.array(shape), pa.array(spelled, pa.binary())], schema=_FETCHED)

    return rows.join(lists, ["doc", "version"]).select("doc", "version", "text", "segments").mapInArrow(run, FETCHED)


RANGES = "doc long, version long, low int, high int"
SORTED_ROWS = f"{RANGES}, gram long, window int, shape int, bytes binary"
_SORTED_ROWS = pa.schema([("doc", pa.int64()), ("version", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), *list(_FETCHED)[0:1], *list(_FETCHED)[3:]])


def sorted_segments(segments_: DataFrame, members: int | None) -> DataFrame:
    """Ranges found by suffix sort, gram by gram; segments of grams with more than ``members`` are passed on (gram is not null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = pa.concat_batches(parts)
            gram, doc, version, window, shape = (rows.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            data, first = text_bytes(rows.column(5))
            group = np.cumsum(np.concatenate(([True], gram[1:] != gram[:-1])))
            segment, number = repeated_windows(data, first[:-1], shape.astype(np.int64), group, doc, version, window)
            if len(segment):
                low = window[segment] + number
                new = np.concatenate(([True], (segment[1:] != segment[:-1]) | (number[1:] != number[:-1] + 1)))
                at = np.flatnonzero(new)
                end = np.append(at[1:], len(low)) - 1
                n = len(at)
                yield pa.RecordBatch.from_arrays([pa.array(doc[segment[at]]), pa.array(version[segment[at]]), pa.array(low[at].astype(np.int32)),
                                                  pa.array((low[end] + LENGTH).astype(np.int32)), *(pa.nulls(n, f.type) for f in list(_SORTED_ROWS)[4:])], schema=_SORTED_ROWS)

        def passed(rows: pa.RecordBatch) -> pa.RecordBatch:
            none = pa.nulls(rows.num_rows, pa.int32())
            return pa.RecordBatch.from_arrays([rows.column(1), rows.column(2), none, none, rows.column(0), rows.column(3), rows.column(4), rows.column(5)], schema=_SORTED_ROWS)

        ready: list[pa.RecordBatch] = []               # whole grams that wait for company
        weight = 0
        now, mine, size, over = None, [], 0, False
        for batch in batches:
            if not batch.num_rows:
                continue
            gram = batch.column(0).to_numpy()
            cuts = np.flatnonzero(gram[1:] != gram[:-1]) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(gram)]):
                part = batch.slice(low, high - low)
                if gram[low] != now:
                    if mine and not over and size > 1:
                        ready += mine
                        weight += size * (LENGTH - GRAM)
                    if weight >= 2 * SORTED:
                        yield from solved(ready)
                        ready, weight = [], 0
                    now, mine, size, over = gram[low], [], 0, False
                size += high - low
                if over:
                    yield passed(part)
                    continue
                mine.append(part)
                if members is not None and size > members:
                    over = True
                    for p in mine:
                        yield passed(p)
                    mine = []
        if mine and not over and size > 1:
            ready += mine
        if ready:
            yield from solved(ready)

    return segments_.repartition("gram").sortWithinPartitions("gram", "doc", "version", "window").mapInArrow(run, SORTED_ROWS)


def dealt_again(segments_: DataFrame, block: int) -> DataFrame:
    """Segments cut into parts of ``block`` distances, under a gram of their own; with 1, windows under the hash of their bytes.

    Of equal windows in a batch only the first goes on, the others are ranges.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            gram, doc, version, window, shape = (batch.column(i).to_numpy() for i in range(5))
            count, ahead = (shape & 255) + 1, (shape >> 8).astype(np.int64)
            row = np.repeat(np.arange(len(gram)), count)
            number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            part = (number - ahead[row] + LENGTH) // block
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (part[1:] != part[:-1])
            at = np.flatnonzero(new)
            row, part, low = row[at], part[at], number[at]
            high = number[np.append(at[1:], len(number)) - 1]
            data, starts = text_bytes(batch.column(5))
            key = mixed(gram.view(np.uint64)[row] * np.uint64(BASE) + part.astype(np.uint64))
            begin = starts[row] + low
            if block == 1:
                key = mixed(key + range_hashes(prefix_hashes(data), begin, begin + LENGTH))
            where = window[row] + low
            keep = np.ones(len(row), bool)
            if block == 1:
                second = range_hashes(prefix_hashes(data, OTHER), begin, begin + LENGTH, OTHER_INVERSE)
                order = np.lexsort((where, version[row], doc[row], second, key))
                same = np.cumsum(np.concatenate(([True], (np.diff(key[order]) != 0) | (np.diff(second[order]) != 0))))
                keep[order] = ~later(same, doc[row][order], version[row][order], where[order])
                gone = ~keep
                none = [pa.nulls(int(gone.sum()), f.type) for f in list(_SORTED_ROWS)[4:]]
                yield pa.RecordBatch.from_arrays([pa.array(doc[row][gone]), pa.array(version[row][gone]), pa.array(where[gone].astype(np.int32)),
                                                  pa.array((where[gone] + LENGTH).astype(np.int32)), *none], schema=_SORTED_ROWS)
            row, low, high, begin, key, where = (x[keep] for x in (row, low, high, begin, key, where))
            whole = data.tobytes()
            cut = [whole[a:b] for a, b in zip(begin.tolist(), (begin + high - low + LENGTH).tolist())]
            none = pa.nulls(len(row), pa.int32())
            yield pa.RecordBatch.from_arrays([
                pa.array(doc[row]), pa.array(version[row]), none, none, pa.array(key.view(np.int64)), pa.array(where.astype(np.int32)),
                pa.array(((ahead[row] - low) * 256 + high - low).astype(np.int32)), pa.array(cut, pa.binary())], schema=_SORTED_ROWS)

    return segments_.select("gram", "doc", "version", "window", "shape", "bytes").mapInArrow(run, SORTED_ROWS)


def repeated_ranges(rows: DataFrame, members: int = MEMBERS) -> DataFrame:
    """Byte ranges to remove (doc, version, low, high), not merged, of rows (doc, version, text)."""
    columns = ["gram", "doc", "version", "window", "shape", "bytes"]
    known = cut_lineage(equal_segments(found_segments(rows)))
    out = known.where("kind = 0").select("doc", "version", F.col("window").alias("low"), F.col("shape").alias("high"))
    parts = cut_lineage(sorted_segments(fetched(rows, known.where("kind = 1").select("gram", "doc", "version", "window", "shape")), members))
    for block in (BLOCK, 1):
        out = out.unionByName(parts.where("gram IS NULL").select("doc", "version", "low", "high"))
        crowded = parts.where("gram IS NOT NULL")
        if crowded.isEmpty():
            return out
        dealt = cut_lineage(dealt_again(crowded, block))
        out = out.unionByName(dealt.where("gram IS NULL").select("doc", "version", "low", "high"))
        parts = cut_lineage(sorted_segments(dealt.where("gram IS NOT NULL").select(columns), members if block > 1 else None))
    return out.unionByName(parts.where("gram IS NULL").select("doc", "version", "low", "high"))


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def merged(ranges: DataFrame) -> DataFrame:
    """One row for each document with ranges (doc, version): its ranges, ascending and apart."""
    fields = pa.schema([("doc", pa.int64()), ("version", pa.int64()), ("low", pa.list_(pa.int32())), ("high", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lows, highs = [], []
            for i in range(batch.num_rows):
                parts = batch.column(2)[i].values
                low, high = parts.field("low").to_numpy(), parts.field("high").to_numpy()
                order = np.argsort(low, kind="stable")
                low, high = low[order], np.maximum.accumulate(high[order])
                first = np.flatnonzero(np.concatenate(([True], low[1:] > high[:-1])))
                lows.append(low[first])
                highs.append(high[np.append(first[1:], len(low)) - 1])
            if lows:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lows, fields[2].type), pa.array(highs, fields[3].type)], schema=fields)

    lists = ranges.groupBy("doc", "version").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    return lists.mapInArrow(run, "doc long, version long, low array<int>, high array<int>")


def op10_repeated_passages(documents: DataFrame) -> DataFrame:
    """Removed bytes of each document, and a digest of what is left."""
    rows = documents.select(F.coalesce("doc_id", F.lit(_LOW)).alias("doc"), F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("text"))
    shared = not rows.groupBy("doc").count().where("count > 1").isEmpty()
    # tells rows with one id apart; never a constant, which would drop out of the joins' keys and have grouped lists shuffled again
    version = F.xxhash64("text") if shared else F.col("_id").isNull().cast("long")
    rows = rows.withColumn("version", version)
    texts = rows.select("doc", "version", "text")
    with scratch(documents.sparkSession) as keep:
        spans = keep(merged(repeated_ranges(texts.distinct() if shared else texts)))
    fields = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                doc_id, text, low, high = batch.column(0)[i].as_py(), (batch.column(1)[i].as_py() or "").encode(), batch.column(2)[i].as_py() or [], batch.column(3)[i].as_py() or []
                digest, at, removed = hashlib.sha256(), 0, 0
                for a, b in zip(low, high):
                    digest.update(text[at:a])
                    removed, at = removed + b - a, b
                digest.update(text[at:])
                out.append((doc_id, len(text), removed, len(low), digest.hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), fields)], schema=fields)

    sieve = known_documents(spans)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts without ranges, where they are read."""
        for batch in batches:
            batch = batch.filter(pa.array(~sieve.passes(batch.column(2).to_numpy().view(np.uint64))))
            none = pa.nulls(batch.num_rows, pa.list_(pa.int32()))
            yield from run(iter([pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), none, none], names=["_id", "text", "low", "high"])]))

    some = rows.where(may_be_among(sieve)).join(spans, ["doc", "version"], "left").select("_id", "text", "low", "high")
    return some.mapInArrow(run, RESULT).union(rows.select("_id", "text", _key().alias("key")).mapInArrow(whole, RESULT))
