"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has a bit set where over half of the shingles' XXH64 hashes have it.  For a radius r every one of the 64 bits gets a
non-zero vector of r + 1 bits; for each of the 2^(r+1) - 1 non-zero vectors v there is a table whose mask holds the bits whose
vector has an odd product with v (Pagh, 2016).  Two fingerprints that differ in at most r bits have a v that is orthogonal to the
vectors of all bits in which they differ, so they agree under that mask: no pair within the radius is missed.

Equal fingerprints are one node, so a group of copies counts once.  A bucket is searched in the manner of a flood: a fingerprint
that is linked to one already reached is never compared again, and a bucket returns a link for each fingerprint at most.  Buckets
over ``BUCKET`` fingerprints are not searched but dealt again by a further family of tables, independent of those before, up to
``FAMILIES`` in all.  Each leaves about half of the free bits free (masks have ``LEAST`` bits or more), so what shares the keys of
four has some 4 of 64: that bounds the last buckets, which are searched whole, however many documents there are.

Null texts have no words, like empty ones; texts without words have fingerprint zero and are linked like any other.  Rows with
null ids take part; a component of such rows alone has no id.  Repeated rows are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lodestone.llm.components import components
from lodestone.session import cut_lineage

#: Fingerprints that one bucket may have before it is dealt again.
BUCKET = 20_000
#: Families of tables by which a bucket is dealt at most, and the fewest bits of a mask.
FAMILIES, LEAST = 4, 24


def _line(text: str) -> bytes:
    return b" ".join(text.encode().lower().split())       # bytes.split(): blank and 9 to 13


def fingerprint(text: str, words: int = 4) -> int:
    """SimHash over runs of ``words`` words, repeats included (fewer words: the whole text; none: zero)."""
    return _fingerprint(_line(text), words)


def _fingerprint(line: bytes, words: int) -> int:
    if not line:
        return 0
    blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = [0, *(blanks + 1).tolist()]
    ends = [*blanks.tolist(), len(line)][words - 1:] or [len(line)]
    ones, total = np.zeros(64, np.int64), len(ends)
    for low in range(0, total, 1 << 16):
        part = ends[low:low + (1 << 16)]
        hashes = np.array([xxh64_intdigest(line[a:b], 42) for a, b in zip(starts[low:low + len(part)], part)], "<u8")
        ones += _ones(hashes)
    bits = np.flatnonzero(2 * ones > total)
    return sum(1 << b for b in bits.tolist())


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    if len(hashes) < 64:
        return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    out = np.zeros((8, 8), np.int64)                                   # bytes first: 8 look-ups in counts of byte values
    for byte in range(8):
        seen = np.bincount(hashes.view(np.uint8)[byte::8], minlength=256)
        out[byte] = seen @ _BITS
    return out.ravel()


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprints(documents: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, digest (xxhash64 of the text), fp (the fingerprint) and same (a hash of the words in order) of each row, as signed longs."""
    fields = pa.schema([(n, pa.int64()) for n in ("doc_id", "digest", "fp", "same")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [_line(t.as_py() or "") for t in batch.column(2)]
            made = np.array([_fingerprint(line, words) for line in lines], np.uint64).view(np.int64)
            same = np.array([xxh64_intdigest(line) for line in lines], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(made), pa.array(same)], schema=fields)

    return documents.select("doc_id", F.xxhash64("text"), "text").mapInArrow(run, "doc_id long, digest long, fp long, same long")


@lru_cache
def masks(radius: int, family: int = 0) -> list[int]:
    """The structured masks of one family, as signed longs.

    Vectors come about equally often.  Where there are more than 64, which of them come is drawn until all masks are wide enough.
    """
    size = 1 << (radius + 1)
    rng = np.random.default_rng([radius, family])
    while True:
        vectors = np.concatenate([rng.permutation(np.arange(1, size)) for _ in range(64 // (size - 1) + 1)])[:64]
        rng.shuffle(vectors)
        out = [sum(1 << bit for bit, vector in enumerate(vectors.tolist()) if (vector & v).bit_count() % 2) for v in range(1, size)]
        if min(m.bit_count() for m in out) >= LEAST:
            return [m - (1 << 64) if m >> 63 else m for m in out]


def dealt(rows: DataFrame, radius: int, family: int) -> DataFrame:
    """fp and the new bucket, for each row (fp, bucket) and table of a family.

    A bucket is a hash of the old one, the table and the masked fingerprint: should two fall together, both are searched as one.
    """
    tables = F.array(*(F.xxhash64("bucket", F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks(radius, family))))
    return rows.select("fp", F.explode(tables).alias("bucket"))


def flood(fps: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint, the place of the one within the radius from which it was reached (its own for the first of a group)."""
    reached = np.full(len(fps), -1, np.int64)
    rest = np.arange(len(fps))
    while len(rest):
        seed, rest = rest[0], rest[1:]
        reached[seed] = seed
        queue = [seed]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(fps[rest] ^ fps[at]) <= radius
            if near.any():
                reached[rest[near]] = at
                queue.extend(rest[near].tolist())
                rest = rest[~near]
    return reached


LINKS = "a long, b long, fp long, bucket long"


def links(buckets: DataFrame, radius: int, limit: int | None) -> DataFrame:
    """Links a - b within the radius inside buckets, one for each node at most; rows of buckets over ``limit`` come back.

    Buckets are read one after the other from sorted partitions, and never held beyond ``limit``.
    """
    fields = pa.schema([(n.split()[0], pa.int64()) for n in LINKS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            reached = flood(fps, radius)
            at = np.flatnonzero(reached != np.arange(len(reached)))
            if len(at):
                none = pa.nulls(len(at), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(fps[reached[at]].view(np.int64)), pa.array(fps[at].view(np.int64)), none, none], schema=fields)

        def passed(fps: np.ndarray, bucket: int) -> pa.RecordBatch:
            none = pa.nulls(len(fps), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, pa.array(fps.view(np.int64)), pa.array(np.full(len(fps), bucket, np.int64))], schema=fields)

        current, held, size, over = None, [], 0, False
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            fps, own = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            fps = fps.view(np.uint64)
            begins = np.flatnonzero(own[1:] != own[:-1]) + 1
            lows, highs = np.append(0, begins), np.append(begins, n)
            some = highs - lows > 1                    # most rows are alone in their bucket
            some[[0, -1]] = True
            for low, high in zip(lows[some].tolist(), highs[some].tolist()):
                here = int(own[low])
                if here != current:
                    if size > 1 and not over:
                        yield from found(np.concatenate(held))
                    current, held, size, over = here, [], 0, False
                size += high - low
                if over:
                    yield passed(fps[low:high], here)
                    continue
                held.append(fps[low:high].copy())
                if limit is not None and size > limit:
                    over = True
                    yield passed(np.concatenate(held), here)
                    held = []
        if size > 1 and not over:
            yield from found(np.concatenate(held))

    return buckets.select("fp", "bucket").repartition("bucket").sortWithinPartitions("bucket", "fp").mapInArrow(run, LINKS)


def near_links(nodes: DataFrame, radius: int = 4, limit: int = BUCKET) -> DataFrame:
    """Links a - b between different fingerprints (fp) that connect all that lie within ``radius`` of one another."""
    rows, found = nodes.select("fp", F.lit(0).cast("long").alias("bucket")), None
    for family in range(FAMILIES):
        last = family == FAMILIES - 1
        out = cut_lineage(links(dealt(rows, radius, family), radius, None if last else limit))
        pairs = out.where("a IS NOT NULL").select("a", "b")
        found = pairs if found is None else found.union(pairs)
        rows = out.where("fp IS NOT NULL").select("fp", "bucket")
        if last or rows.isEmpty():
            return found.distinct()


def near_components(documents: DataFrame, radius: int = 4, words: int = 4) -> DataFrame:
    """Each row's doc_id, digest (xxhash64 of the text), fp, group (a fingerprint that names it) and component (its smallest doc_id)."""
    rows = cut_lineage(fingerprints(documents, words))
    nodes = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    groups = components(near_links(nodes, radius))
    named = nodes.join(groups, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("group"))
    named = cut_lineage(named)
    least = named.groupBy("group").agg(F.min("least").alias("component"))
    names = cut_lineage(named.select("fp", "group").join(least, "group"))             # a table: a frequent fingerprint can be split
    return rows.join(names, "fp").select("doc_id", "digest", "fp", "group", "component")


def op8_simhash(documents: DataFrame) -> DataFrame:
    """One row for each document with its fingerprint in hexadecimal and its component."""
    return near_components(documents, 4).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
