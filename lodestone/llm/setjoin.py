"""Pairs of texts that share 0.8 or more of their word shingles, by the prefix-filtered set join.

A text is the set of its runs of ``words`` words (words are what blanks separate, A-Z lower-cased).  All sets are sorted by one
order, rare shingles first; two sets of similarity (Jaccard) ``share`` or more then have a shingle in common among the first
n - ceil(share n) + 1 of each, so only these are joined.  The order takes counts of all shingles of all texts, added up in
``CELLS`` cells; any order gives the same pairs, this one keeps frequent passages out of the prefixes.  Pairs are held against
bounds on length and place, then on the parities of their shingles in some n cells (Sandes, 2017): two sets differ in at least as
many shingles as parities, so no similar pair is lost.  A set has n to 2n bits there instead of 64 a shingle, and only the sets of
pairs that pass are moved and compared as a whole.

Texts come in groups that are known to belong together, and a pair inside a group is never looked at.  Links are searched twice:
first between neighbours of each shingle's sorted list, and between its entries and the one that has it in the earliest place,
which joins most groups at the cost of two pairs for each entry; then between all entries of what still are different groups.

Null, empty and shorter texts have no run and link to nothing.  Repeated rows change nothing.  An empty table gives no links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import Sieve, Words, steps, text_bytes
from lodestone.llm.components import components
from lodestone.session import cut_lineage, scratch

#: Similarity from which two texts are linked.
SHARE = 0.8
#: Cells (a power of two) in which shingles are counted for the order: the size of what is broadcast, whatever the input.
CELLS = 1 << 18


def _sets(text: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """The row and the different shingles of each text that has any."""
    data, offsets = text_bytes(text)
    for low, high in steps(offsets):
        found = Words(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low], blanks=True)
        runs = found.runs(words)
        for row in range(low, high):
            first, last = int(found.first[row - low]), int(found.first[row - low + 1]) - words + 1
            if last > first:
                yield row, np.unique(runs[first:last])


def _new(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (text, digest) without the texts that this task has already seen: copies cost one set a task."""
    seen: set[int] = set()
    for batch in batches:
        digests = batch.column(1).to_pylist()
        new = [i for i, d in enumerate(digests) if not (d in seen or seen.add(d))]
        yield batch if len(new) == len(digests) else batch.take(pa.array(new, pa.int64()))


def _cells(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - (CELLS.bit_length() - 1))).astype(np.int64)


def counts(texts: DataFrame, words: int) -> np.ndarray:
    """How many sets hold a shingle of each cell, over all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in _new(batches):
            for _, shingles in _sets(batch.column(0), words):
                np.add.at(total, _cells(shingles), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    rows = texts.select("text", "digest").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CELLS, np.int64)
    out[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return out


def prefixes(texts: DataFrame, words: int, share: float) -> DataFrame:
    """token, place, n (size of the set) and digest for each shingle in the necessary prefix of each text."""
    sent = texts.sparkSession.sparkContext.broadcast(counts(texts, words))
    fields = pa.schema([("token", pa.int64()), ("place", pa.int32()), ("n", pa.int32()), ("digest", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _new(batches):
            tokens, rows, sizes = [np.zeros(0, np.uint64)], [], []
            for row, shingles in _sets(batch.column(0), words):
                n = len(shingles)
                order = np.lexsort((shingles, sent.value[_cells(shingles)]))[:n - _ceil(share * n) + 1]
                tokens.append(shingles[order])
                rows.append(row)
                sizes.append(n)
            lengths = [len(t) for t in tokens[1:]]
            at = np.repeat(np.array(rows, np.int64), lengths)
            place = np.concatenate([np.zeros(0, np.int64), *(np.arange(k) for k in lengths)])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(tokens).view(np.int64)), pa.array(place, pa.int32()), pa.array(np.repeat(np.array(sizes, np.int32), lengths)),
                batch.column(1).take(pa.array(at))], schema=fields)

    return texts.select("text", "digest").mapInArrow(run, "token long, place int, n int, digest long")


def _ceil(x: float) -> int:
    return int(np.ceil(x - 1e-9))


def _open(entries: DataFrame, by: str) -> DataFrame:
    """Entries of shingles that different texts (``by`` is digest) or groups have."""
    own = Window.partitionBy("token")
    return entries.withColumns({"low": F.min(by).over(own), "high": F.max(by).over(own)}).where("low <> high").drop("low", "high")


def _pairs(both: DataFrame, share: float) -> DataFrame:
    """Different pairs of texts out of rows of two entries (a_..., b_...) that are in bounds."""
    need = (F.col("a_n") + F.col("b_n")) * F.lit(share / (1 + share)) - F.lit(1e-6)
    room = F.least(F.col("a_n") - F.col("a_place"), F.col("b_n") - F.col("b_place"))       # what can be shared from this shingle on
    short, long = F.least("a_n", "b_n"), F.greatest("a_n", "b_n")
    inside = (F.col("a_group") != F.col("b_group")) & (short >= long * F.lit(share) - F.lit(1e-6)) & (room >= need)
    lower = F.col("a_digest") < F.col("b_digest")
    sides = [(x, y, F.when(lower, F.col(f"{x}_{c}")).otherwise(F.col(f"{y}_{c}")).alias(f"{x}_{c}"))
             for x, y in ("ab", "ba") for c in ("digest", "group")]
    return both.where(inside).select(*(c for _, _, c in sides)).distinct()


def _named(entries: DataFrame, side: str) -> DataFrame:
    return entries.select("token", *(F.col(c).alias(f"{side}_{c}") for c in ("place", "n", "digest", "group")))


def parities(shingles: np.ndarray) -> np.ndarray:
    """Whether an odd number of the shingles falls into each cell, packed; the cells are a power of two, as many as the shingles or more."""
    cells = max(64, 1 << (len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.uint64)


def most_common(a: np.ndarray, b: np.ndarray, sizes: int) -> int:
    """The most shingles that two sets of ``sizes`` together can share, by their parities."""
    while len(a) != len(b):                    # the halves of the finer one together are those over half the cells
        a, b = (a, b) if len(a) > len(b) else (b, a)
        a = a[:len(a) // 2] ^ a[len(a) // 2:]
    return (sizes - int(np.bitwise_count(a ^ b).sum())) // 2


def signatures(texts: DataFrame, words: int) -> DataFrame:
    """digest, n (size of the set) and bits (its parities) of each text that has any shingle."""
    fields = pa.schema([("digest", pa.int64()), ("n", pa.int64()), ("bits", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _new(batches):
            rows, sizes, bits = [], [], []
            for row, shingles in _sets(batch.column(0), words):
                rows.append(row)
                sizes.append(len(shingles))
                bits.append(parities(shingles).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary())], schema=fields)

    return cut_lineage(texts.select("text", "digest").mapInArrow(run, "digest long, n long, bits binary").dropDuplicates(["digest"]))


PAIR = ["a_digest", "b_digest", "a_group", "b_group"]


def bounded(pairs: DataFrame, signed: DataFrame, share: float = SHARE) -> DataFrame:
    """The pairs whose parities leave it open that they are similar."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = ([np.frombuffer(x, np.uint64) for x in batch.column(i).to_pylist()] for i in (5, 6))
            sizes = batch.column(4).to_pylist()
            common = np.array([most_common(*x) for x in zip(a, b, sizes)], np.int64)
            can = common >= share * (np.array(sizes, np.int64) - common) - 1e-6
            yield batch.select(PAIR).filter(pa.array(can, pa.bool_()))

    a, b = (signed.select(*(F.col(c).alias(f"{x}_{c}") for c in ("digest", "n", "bits"))) for x in "ab")
    rows = pairs.join(a, "a_digest").join(b, "b_digest").select(*PAIR, (F.col("a_n") + F.col("b_n")).alias("sizes"), "a_bits", "b_bits")
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in PAIR))


def verified(pairs: DataFrame, texts: DataFrame, words: int, signed: DataFrame, share: float = SHARE) -> DataFrame:
    """Links a - b between the groups of pairs whose whole sets are similar enough; ``signed`` has the signatures of the texts."""
    with scratch(pairs.sparkSession) as keep:
        near = cut_lineage(bounded(pairs, signed, share))
        asked = Sieve(cut_lineage(near.select(F.col("a_digest").alias("digest")).union(near.select("b_digest")).distinct()), "digest")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _new(batches):
                batch = batch.filter(pa.array(asked.passes(batch.column(1).to_numpy().view(np.uint64)), pa.bool_()))
                for row, shingles in _sets(batch.column(0), words):
                    yield pa.RecordBatch.from_arrays([batch.column(1).slice(row, 1), pa.array([shingles.view(np.int64)], pa.list_(pa.int64()))], names=["digest", "members"])

        # texts are not shuffled: those that nobody asked for are turned away where they are read
        sets = cut_lineage(texts.select("text", "digest").mapInArrow(run, "digest long, members array<long>").dropDuplicates(["digest"]))
        a, b = (sets.select(F.col("digest").alias(f"{x}_digest"), F.col("members").alias(f"{x}_members")) for x in "ab")
        common = F.size(F.array_intersect("a_members", "b_members"))
        rows = near.join(a, "a_digest").join(b, "b_digest").withColumn("common", common)
        similar = F.col("common") >= F.lit(share) * (F.size("a_members") + F.size("b_members") - F.col("common")) - F.lit(1e-6)
        return keep(rows.where(similar).select(F.col("a_group").alias("a"), F.col("b_group").alias("b")).distinct())


def _merged(frame: DataFrame, links: DataFrame) -> DataFrame:
    """The frame with the groups that links join."""
    names = components(links).withColumnsRenamed({"node": "group", "component": "joined"})
    return frame.join(names, "group", "left").withColumn("group", F.coalesce("joined", "group")).drop("joined")


def join_groups(texts: DataFrame, groups: DataFrame, words: int = 5, share: float = SHARE, signed: DataFrame | None = None) -> DataFrame:
    """group and joined (the name of the groups linked to it) of each group that has a link.

    ``texts`` has text and digest (one for each different text, never null), ``groups`` digest and group; ``signed`` the signatures
    of the texts, if they are there.  Texts are read in place; only the prefixes are shuffled, and only those that different texts
    share meet the groups.
    """
    with scratch(texts.sparkSession) as keep:
        signed = signatures(texts, words) if signed is None else signed
        shared = _open(prefixes(texts, words, share), "digest").distinct()
        entries = cut_lineage(_open(shared.join(cut_lineage(groups.select("digest", "group").distinct()), "digest"), "group"))
        after = Window.partitionBy("token").orderBy("n", "digest", "group")
        parts = ("place", "n", "digest", "group")
        last = F.struct(*(F.lag(c).over(after).alias(f"a_{c}") for c in parts))
        # the entry that has the shingle in the earliest place: the text that copies of a template are most alike
        hub = F.min(F.struct(*(F.col(c).alias(f"a_{c}") for c in parts))).over(Window.partitionBy("token"))
        both = entries.withColumns({"last": last, "hub": hub}).select(*(F.col(c).alias(f"b_{c}") for c in parts), F.inline(F.array("last", "hub")))
        neighbours = both.where("a_digest <> b_digest")
        first = verified(cut_lineage(_pairs(neighbours, share)), texts, words, signed, share)
        named = cut_lineage(_open(_merged(entries, first), "group"))
        rest = _pairs(_named(named, "a").join(_named(named, "b"), "token"), share)
        second = verified(cut_lineage(rest), texts, words, signed, share)
        return keep(components(first.union(second)).withColumnsRenamed({"node": "group", "component": "joined"}))
