"""Near copies by SuperMinHash signatures, banding, verification on whole sets and union of the links.

A text is the set of its runs of four words (words are what blanks separate, A-Z lower-cased); a text of fewer words is one run,
a text without words or a null has an empty set and is linked with nothing.  Texts with equal sets (128 bits and the size) are one
node; a repeated row changes nothing.

**Signature.**  Each member of a set draws, from its own hash, a random permutation of the ``SIZE`` places and one random fraction for
each step of it.  In step j it offers j + fraction to the place its permutation has in j, and a place keeps the least offer.  As
later steps offer more, a text is done as soon as every place holds less than the next step would offer: large sets stop after one
to three steps.  One permutation for each member spreads its offers over all places, so that estimates vary less than those of
independent minima.  All members of many texts take a step together.

**Bands.**  Places are kept as 16 bits, four of them make a band, and texts that agree on a band share a bucket.  A pair of
similarity 0.8 shares none of the 48 bands with a chance of 10^-11.

**Pairs.**  First each member of a bucket is paired with the bucket's hub, the text whose buckets are the largest (an original is in
more buckets with its copies than they are with each other): one pair for each entry at most, which joins most groups.  Only buckets
that still hold different groups go on: their texts are compared in ``numpy`` blocks, pairs of different groups come out of the first band
they share.  Both ways a pair goes on only if sizes and **sketches** allow it: a sketch holds, for each of 2048 cells, whether an odd number of
members falls there, so two sketches never differ in more cells than the sets in members.  This turns away nearly all siblings of one
template that are less than 0.8 alike, and none that is.  A bucket of more than ``BUCKET`` entries is dealt again by its texts' further
bands, so that no task holds a large one.  Every pair left is verified on its whole sets in integers; components of the links are classes.

An empty table gives no rows.  Columns besides doc_id and text are not read.  A text is held whole by one task, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Sieve, Words, mixed, steps, text_bytes
from lodestone.llm.components import components
from lodestone.session import cut_lineage, scratch

WORDS = 4
#: Two texts are linked if 100 x common members >= PERCENT x members of both.
PERCENT = 80
BANDS, PER_BAND = 48, 4
#: Places of a signature.
SIZE = BANDS * PER_BAND
#: Cells of a sketch.
CELLS = 2_048
#: Entries of a bucket that one task compares; fuller ones are dealt again.
BUCKET = 4_096
_FIRST, _STEP, _PLACE = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shingles(text: pa.Array, words: int = WORDS) -> Iterator[tuple[int, np.ndarray]]:
    """The row and the sorted set of hashes of each text with a word."""
    data, offsets = text_bytes(text)
    for low, high in steps(offsets):
        found = Words(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low], blanks=True)
        runs, first = found.runs(words), found.first.tolist()
        for row in range(low, high):
            begin, end = first[row - low], first[row - low + 1]
            if end - begin >= words:
                yield row, np.unique(runs[begin:end - words + 1])
            elif end > begin:
                whole = np.full(1, end - begin, np.uint64)
                for h in found.hashes[begin:end]:
                    whole = mixed(whole * _STEP + h)
                yield row, whole


def signatures(members: np.ndarray, of: np.ndarray, texts: int, size: int = SIZE) -> np.ndarray:
    """The least offers (texts x size, step in the upper 12 bits) of members, which belong to the texts ``of`` (each has one at least)."""
    least = np.full((texts, size), np.iinfo(np.uint64).max, np.uint64)
    flat = least.reshape(-1)
    seed = mixed(members ^ _FIRST)
    of = of.astype(np.int64)
    open_texts = np.arange(texts)
    swaps: list[np.ndarray] = []                  # for each step so far, the place that each member swapped with it
    for j in range(size):
        drawn = mixed(seed + np.uint64((2 * j + 1) * int(_STEP) % (1 << 64)))
        place = j + (((mixed(seed * _PLACE + np.uint64(j)) >> np.uint64(32)) * np.uint64(size - j)) >> np.uint64(32)).astype(np.int64)
        at = place
        for t in range(j - 1, -1, -1):            # what earlier swaps have put there
            at = np.where(at == swaps[t], t, at)
        np.minimum.at(flat, of * size + at, (np.uint64(j) << np.uint64(52)) | (drawn >> np.uint64(12)))
        still = open_texts[(least[open_texts] >= (np.uint64(j + 1) << np.uint64(52))).any(axis=1)]
        swaps.append(place)
        if not len(still):
            break
        if len(still) < len(open_texts):
            goes_on = np.zeros(texts, bool)
            goes_on[still] = True
            keep = goes_on[of]
            seed, of, swaps, open_texts = seed[keep], of[keep], [s[keep] for s in swaps], still
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """Signatures as 16 bits a place, seen as one 64-bit value for each band."""
    return (mixed(least) >> np.uint64(48)).astype(np.uint16).reshape(len(least), -1).view(np.uint64)


def sketches(members: np.ndarray, of: np.ndarray, texts: int) -> np.ndarray:
    """For each text 64-bit words with a bit for each cell: whether its number of members is odd."""
    cell = (mixed(members ^ _PLACE) % np.uint64(CELLS)).astype(np.int64)
    return np.packbits(np.bincount(of * CELLS + cell, minlength=texts * CELLS).astype(np.uint8) & 1).view(np.uint64).reshape(texts, -1)


def may_be_alike(n: np.ndarray, m: np.ndarray, differing: np.ndarray) -> np.ndarray:
    """Whether sets of n and m members whose sketches differ in so many cells can be similar: differing <= |A - B| + |B - A|."""
    return (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)) & (differing * (100 + PERCENT) <= (n + m) * (100 - PERCENT))


ROWS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("digest", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("bands", pa.binary()), ("sketch", pa.binary())])


def signed(documents: DataFrame, words: int = WORDS) -> DataFrame:
    """row (a number of its own), doc_id, digest (of the text), n (size of the set), d1 and d2 (the set's digest), bands and sketch of each document; these are null if the set is empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            rows, sets = [], []
            n = np.zeros(batch.num_rows, np.int64)
            digests = np.zeros((2, batch.num_rows), np.uint64)
            coded: list[list[bytes | None]] = [[None] * batch.num_rows for _ in range(2)]

            def close() -> None:
                if rows:
                    members, of = np.concatenate(sets), np.repeat(np.arange(len(rows)), [len(s) for s in sets])
                    for into, made in zip(coded, (bands(signatures(members, of, len(rows))), sketches(members, of, len(rows)))):
                        for row, line in zip(rows, made):
                            into[row] = line.tobytes()
                    rows.clear()
                    sets.clear()

            held = 0
            for row, members in shingles(batch.column(1), words):
                n[row] = len(members)
                spread = mixed(members)
                digests[:, row] = spread.sum(dtype=np.uint64), mixed(spread ^ _PLACE).sum(dtype=np.uint64)
                rows.append(row)
                sets.append(members)
                held += len(members)
                if held > 100_000:
                    close()
                    held = 0
            close()
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(number, number + batch.num_rows)), batch.column(0).cast(pa.int64()), batch.column(2), pa.array(n),
                *(pa.array(d.view(np.int64)) for d in digests), *(pa.array(c, pa.binary()) for c in coded)], schema=ROWS)
            number += batch.num_rows

    return documents.select("doc_id", "text", F.xxhash64("text")).mapInArrow(run, "row long, doc_id long, digest long, n long, d1 long, d2 long, bands binary, sketch binary")


def _keys(values: np.ndarray) -> np.ndarray:
    """A key for each band of each row: its value and its place in the signature, mixed."""
    return mixed(mixed(values) + np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP)


def _values(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, BANDS)


def _entries(nodes: DataFrame) -> DataFrame:
    """key, band and node for each node and band.  Should two keys fall together, their bucket holds both: some pairs more to look at."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if n := batch.num_rows:
                yield pa.RecordBatch.from_arrays([
                    pa.array(_keys(_values(batch.column(1))).view(np.int64).ravel()), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), n)),
                    pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], names=["key", "band", "node"])

    return nodes.select("node", "bands").mapInArrow(run, "key long, band int, node long")


def _again(entries: DataFrame) -> DataFrame:
    """Entries (key, band, node, bands) under their key with each further band."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            band = batch.column(1).to_numpy()
            row, later = np.nonzero(np.arange(BANDS) > band[:, None])
            keys = mixed(batch.column(0).to_numpy().view(np.uint64)[row] + _keys(_values(batch.column(3)))[row, later])
            yield pa.RecordBatch.from_arrays([
                pa.array(keys.view(np.int64)), pa.array(later.astype(np.int32)), batch.column(2).take(pa.array(row))], names=["key", "band", "node"])

    return entries.select("key", "band", "node", "bands").mapInArrow(run, "key long, band int, node long")


def hub_pairs(entries: DataFrame, nodes: DataFrame) -> DataFrame:
    """Different pairs a < b of each entry (key, node, size) with its bucket's hub that can be similar."""
    weight = entries.groupBy("node").agg(F.sum("size").alias("weight"))
    weighed = cut_lineage(entries.select("key", "node").join(weight, "node"))
    hubs = weighed.groupBy("key").agg(F.max(F.struct("weight", "node")).alias("hub")).select("key", F.col("hub.node").alias("hub"))
    both = weighed.join(cut_lineage(hubs), "key").where("node <> hub")
    pairs = cut_lineage(both.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for i in (3, 5))
                differing = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
                yield batch.select(["a", "b"]).filter(pa.array(may_be_alike(batch.column(2).to_numpy(), batch.column(4).to_numpy(), differing)))

    a, b = (nodes.select(F.col("node").alias(x), F.col("n").alias(f"{x}_n"), F.col("sketch").alias(f"{x}_sketch")) for x in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "a_n", "a_sketch", "b_n", "b_sketch").mapInArrow(run, "a long, b long")


def members_of(nodes: DataFrame, documents: DataFrame, words: int = WORDS) -> DataFrame:
    """node and members (the sorted set, 64-bit hashes) of nodes, given by doc_id and digest of the text of one document each.

    Texts are read in place; a table of bits keeps most that are not asked for out of the join.
    """
    sieve = Sieve(nodes, "digest")

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(sieve.passes(batch.column(1).to_numpy().view(np.uint64))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, members in shingles(batch.column(1), words):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), pa.array([members.tobytes()], pa.binary())], names=["node", "members"])

    named = documents.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_digest"), "text").mapInArrow(asked, "_id long, _digest long, text string")
    texts = named.join(nodes, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_digest") == F.col("digest")))
    return texts.dropDuplicates(["node"]).select("node", "text").mapInArrow(run, "node long, members binary")


def verified(pairs: DataFrame, nodes: DataFrame, documents: DataFrame, words: int = WORDS) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                if 100 * both >= PERCENT * (len(x) + len(y) - both):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    some = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = cut_lineage(members_of(cut_lineage(some.join(nodes.select("node", "doc_id", "digest"), "node")), documents, words))
    a, b = (sets.select(F.col("node").alias(x), F.col("members").alias(f"{x}_members")) for x in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "a_members", "b_members").mapInArrow(run, "a long, b long")


FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("band", pa.int32()), ("node", pa.int64())])


def bucket_pairs(entries: DataFrame, used: int, limit: int | None) -> DataFrame:
    """a, b of pairs of different groups that can be similar; key, band and node of entries in buckets over ``limit``.

    ``entries``: key (made of ``used`` bands), band (the last of them), node, group, n, bands, sketch.  A pair comes out once, of the bucket of
    the first bands that it shares.  Sorted partitions are read bucket by bucket, and no more than ``limit`` entries are held.
    """
    def compared(key: int, _: np.ndarray, nodes: np.ndarray, groups: np.ndarray, n: np.ndarray, values: np.ndarray, cells: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(n, kind="stable")
        nodes, groups, n, values, cells = nodes[order], groups[order], n[order], values[order], cells[order]
        wanted = np.uint64(key & ((1 << 64) - 1))
        last = np.searchsorted(n, n * 100 // PERCENT, "right").tolist()        # larger sets are too large for 0.8
        for i in range(len(nodes) - 1):
            near = np.arange(i + 1, last[i])
            near = near[groups[near] != groups[i]]
            near = near[may_be_alike(n[i], n[near], np.bitwise_count(cells[near] ^ cells[i]).sum(axis=1, dtype=np.int64))]
            if not len(near):
                continue
            own = _keys(values[i:i + 1])[0]
            equal = values[near] == values[i]
            first = equal.argmax(axis=1)
            made = own[first]
            for _ in range(1, used):                                             # the next shared band of each pair
                equal[np.arange(len(near)), first] = False
                first = equal.argmax(axis=1)
                made = mixed(made + own[first])
            if len(near := near[made == wanted]):
                a, b = np.full(len(near), nodes[i]), nodes[near]
                none = pa.nulls(len(near), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), none, none.cast(pa.int32()), none], schema=FOUND)

    def passed(key: int, band: np.ndarray, nodes: np.ndarray, *_: np.ndarray) -> Iterator[pa.RecordBatch]:
        none = pa.nulls(len(nodes), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.array(np.full(len(nodes), key)), pa.array(band), pa.array(nodes)], schema=FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, size = None, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, *rest = (batch.column(i).to_numpy() for i in range(5))
            rest += [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(len(keys), -1) for i in (5, 6)]
            begins = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            for low, high in zip([0, *begins.tolist()], [*begins.tolist(), len(keys)]):
                if (here := int(keys[low])) != current:
                    if size > 1 and held:
                        yield from compared(current, *(np.concatenate(x) for x in zip(*held)))
                    current, held, size = here, [], 0
                size += high - low
                held.append(tuple(x[low:high].copy() for x in rest))
                if limit is not None and size > limit:
                    yield from passed(here, *(np.concatenate(x) for x in zip(*held)))
                    held = []
        if size > 1 and held:
            yield from compared(current, *(np.concatenate(x) for x in zip(*held)))

    columns = ["key", "band", "node", "group", "n", "bands", "sketch"]
    return entries.select(columns).repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "a long, b long, key long, band int, node long")


def _crowds(entries: DataFrame) -> DataFrame:
    """Entries of buckets with different groups."""
    size = entries.groupBy("key").agg(F.min("group").alias("_low"), F.max("group").alias("_high"))
    return entries.join(cut_lineage(size.where("_low <> _high").select("key")), "key")


def _grouped(frame: DataFrame, links: DataFrame) -> DataFrame:
    """The frame (node, ...) with a column group: the least node that links lead to, or the node itself."""
    names = components(links).withColumnRenamed("component", "_group")
    return frame.join(names, "node", "left").withColumn("group", F.coalesce("_group", "node")).drop("_group")


def near_links(nodes: DataFrame, documents: DataFrame, words: int = WORDS, limit: int = BUCKET) -> DataFrame:
    """Links a - b between nodes (node, doc_id, digest, n, bands, sketch) that connect all pairs of similar sets."""
    with scratch(nodes.sparkSession) as keep:
        entries = _entries(nodes)
        shared = cut_lineage(entries.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
        entries = cut_lineage(entries.join(shared, "key"))
        links = cut_lineage(verified(cut_lineage(hub_pairs(entries, nodes)), nodes, documents, words))
        rest = entries.select("key", "band", "node")
        for used in (1, 2, 3):
            grouped = cut_lineage(_grouped(rest, links))
            open_entries = _crowds(grouped).join(nodes.select("node", "n", "bands", "sketch"), "node")
            found = cut_lineage(bucket_pairs(open_entries, used, limit if used < 3 else None))
            pairs = cut_lineage(found.where("a IS NOT NULL").select("a", "b"))
            links = cut_lineage(links.union(verified(pairs, nodes, documents, words)))
            crowded = found.where("node IS NOT NULL").select("key", "band", "node")
            if used == 3 or crowded.isEmpty():
                return keep(links)
            rest = cut_lineage(_again(crowded.join(nodes.select("node", "bands"), "node")))


def near_components(documents: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n (size of the set), component (the least doc_id reachable, itself included) of each row.

    A class without any doc_id has a null component.
    """
    keys = ["d1", "d2", "n"]
    with scratch(documents.sparkSession) as keep:
        whole = cut_lineage(signed(documents, words))
        rows = keep(whole.select("row", "doc_id", *keys))
        named = cut_lineage(rows.where("n > 0").groupBy(*keys).agg(F.min("row").alias("node"), F.min("doc_id").alias("least")))
        nodes = cut_lineage(whole.drop("d1", "d2").join(named.select(F.col("node").alias("row")), "row").withColumnRenamed("row", "node"))
        grouped = cut_lineage(_grouped(named, near_links(nodes, documents, words)))
        least = cut_lineage(grouped.groupBy("group").agg(F.min("least").alias("component")))
        classes = keep(grouped.join(least, "group").select(*keys, "component"))
    full = rows.where("n > 0").select("doc_id", *keys).join(classes, keys).select("doc_id", "n", "component")
    return full.union(rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component")))


def op13_superminhash(documents: DataFrame) -> DataFrame:
    """One row for each document: size of its set, its class, and whether it is the one to keep."""
    return near_components(documents).select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(False)).alias("kept"))


ORACLE = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 2, 2)), lambda i: array_to_string(w[i:i + 3], ' '))) END AS m FROM d),
t AS (SELECT doc_id, len(m) AS n, unnest(m) AS x FROM s),
p AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT DISTINCT a, a AS b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a AS doc_id, min(b) AS least FROM r GROUP BY a)
SELECT doc_id, CAST(len(m) AS BIGINT) AS n_shingles, coalesce(least, doc_id) AS component_id, doc_id = coalesce(least, doc_id) AS kept
FROM s LEFT JOIN c USING (doc_id)"""
