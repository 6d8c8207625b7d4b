"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces of a text.

Paragraphs are lines.  A section ends at a blank line, or where a paragraph's digest says so (one in eight), so that an edit moves
no later section.  A paragraph's digest is BLAKE2b of its bytes, a section's of its paragraphs' digests, the root's of its
sections' digests: equal roots mean equal texts.  Below the paragraphs lie pieces of a few words with a 64-bit digest each, cut after line
ends, after blanks where the bytes before them say so (one in four), and, where no blank has come for ``STRETCH`` bytes, at any byte
where they say so (one in ``STRETCH`` / 2): an edit changes only the pieces around it, in texts without blanks too.

A tree holds digests and sizes, no text.  The likeness of two trees is twice the bytes of pieces that both have by the bytes of both;
paragraphs that differ are found from the sections that do.  Trees can be stored as bytes and compared later.

Null texts count as empty; the empty text has a fingerprint of its own.  Repeated rows get equal fingerprints.  Very long texts
take time in proportion to their length.  An empty table gives no rows; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import astuple, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import mixed, prefix_hashes, range_hashes

#: Bytes before a place that decide whether a piece ends there, one in how many blanks ends one, and bytes without a blank from which any byte can.
CONTEXT, BLANKS, STRETCH = 8, 4, 32
SECTION_PARAGRAPHS = 8


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def piece_ends(data: np.ndarray) -> np.ndarray:
    """Where the pieces of a text end; equal surroundings are cut alike."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    ends = [np.flatnonzero(data == 10) + 1, np.array([n])]
    if n > CONTEXT:
        seen = np.ndarray((n - CONTEXT,), "<u8", np.append(data, np.zeros(8, np.uint8)).tobytes(), strides=(1,))      # the bytes before place CONTEXT + i
        seen = mixed(seen.astype(np.uint64))
        blank = np.flatnonzero(data[CONTEXT:] == 32)
        ends.append(blank[seen[blank] % np.uint64(BLANKS) == 0] + CONTEXT + 1)
        at = np.arange(n)
        since = at - np.maximum.accumulate(np.where((data == 32) | (data == 10), at, -1))
        bare = np.flatnonzero(since[CONTEXT:] > STRETCH)
        ends.append(bare[seen[bare] % np.uint64(STRETCH // 2) == 0] + CONTEXT)
    return np.unique(np.concatenate(ends))


@dataclass
class Tree:
    root: str
    sections: list[bytes]
    #: Paragraph digests, by section.
    paragraphs: list[list[bytes]] = field(repr=False)
    #: Digests of the different pieces, sorted, with the bytes and the number of each.
    pieces: np.ndarray = field(repr=False)
    sizes: np.ndarray = field(repr=False)
    counts: np.ndarray = field(repr=False)
    size: int = 0

    def stored(self) -> bytes:
        return pickle.dumps(astuple(self))

    @staticmethod
    def restored(data: bytes) -> Tree:
        return Tree(*pickle.loads(data))


def tree(text: bytes) -> Tree:
    """Build all levels."""
    groups: list[list[bytes]] = [[]]
    for line in text.split(b"\n"):
        node = _digest(line)
        groups[-1].append(node)
        if node[0] % SECTION_PARAGRAPHS == 0 or not line.strip():
            groups.append([])
    groups = [g for g in groups if g]
    sections = [_digest(b"section" + b"".join(g)) for g in groups]
    data = np.frombuffer(text, np.uint8)
    ends = piece_ends(data)
    starts = np.append(0, ends[:-1])[:len(ends)]
    digests = range_hashes(prefix_hashes(data), starts, ends) if len(ends) else np.zeros(0, np.uint64)
    pieces, first, counts = np.unique(digests, return_index=True, return_counts=True)
    return Tree(_digest(b"root" + b"".join(sections)).hex(), sections, groups, pieces, (ends - starts)[first], counts, len(text))


def likeness(left: Tree, right: Tree) -> float:
    """Twice the bytes in pieces that both have by the bytes of both, from 0 to 1."""
    if left.root == right.root:
        return 1.0
    if not len(left.pieces) or not len(right.pieces):
        return 0.0
    at = np.minimum(np.searchsorted(right.pieces, left.pieces), len(right.pieces) - 1)
    same = right.pieces[at] == left.pieces
    common = int((np.minimum(left.counts, right.counts[at]) * left.sizes)[same].sum())
    return 2 * common / (left.size + right.size)


def differing(left: Tree, right: Tree) -> list[int]:
    """Which paragraphs of ``right`` are new, by number: the branches that locate an edit."""
    if left.root == right.root:
        return []
    same = Counter(left.sections) & Counter(right.sections)
    sides = []
    for t in (left, right):
        skip, rest = same.copy(), Counter()
        for node, group in zip(t.sections, t.paragraphs):
            if skip[node] > 0:
                skip[node] -= 1
            else:
                rest.update(group)
        sides.append(rest)
    new = sides[1] - sides[0]
    out, at = [], 0
    for group in right.paragraphs:
        for node in group:
            if new[node] > 0:
                new[node] -= 1
                out.append(at)
            at += 1
    return out


def with_next(rows: DataFrame, key: str, group_rows: int | None = None) -> DataFrame:
    """Deal rows into runs of neighbouring keys, each with a guest: the rows of the next run's first key.

    Adds ``_run``, ``_guest`` and ``_key``; partitions hold whole runs, sorted.  Runs begin at keys picked by hash, so they have
    ``group_rows`` rows on average whatever the distribution of keys.  The last run's guest is the first row of all.  Only the
    beginnings are collected: about 16 for each shuffle partition, 8 bytes each.
    """
    spark = rows.sparkSession
    lowest = -(1 << 63)
    keyed = rows.withColumn("_key", F.coalesce(F.col(key), F.lit(lowest)))
    keys = keyed.select("_key")
    total, first = keys.agg(F.count("*"), F.min("_key")).first()
    if not total:
        return keyed.withColumns({"_run": F.lit(0), "_guest": F.lit(False)})
    if group_rows is None:
        group_rows = max(16, total // (16 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    picked = keys.where(F.pmod(F.xxhash64("_key"), F.lit(group_rows)) == 0).distinct().toArrow().column(0).to_numpy()
    begins = np.unique(np.append(picked, first))
    sent = spark.sparkContext.broadcast(begins)

    @F.pandas_udf("array<int>")
    def runs(k):
        begins = sent.value
        values = k.to_numpy()
        run = np.searchsorted(begins, values, "right") - 1
        head = begins[run] == values
        before = np.where(run > 0, run - 1, len(begins) - 1)
        return k.__class__([[r, b] if h else [r] for r, b, h in zip(run.tolist(), before.tolist(), head.tolist())])

    dealt = keyed.select("*", F.posexplode(runs("_key")).alias("_seat", "_run")).withColumn("_guest", F.col("_seat") > 0).drop("_seat")
    rest = sorted(c for c in rows.columns if c != key)
    return dealt.repartition("_run").sortWithinPartitions("_run", "_guest", "_key", *rest)


RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
          "n_sections int, n_paragraphs int, new_paragraphs array<int>")


def op1_merkle_fingerprints(documents: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they find them.

    Rows with the same doc_id are ordered by text, null ids come first; the next of the last row is the first.
    """
    fields = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("n_sections", pa.int32()),
                        ("n_paragraphs", pa.int32()), ("new_paragraphs", pa.list_(pa.int32()))])

    def compare(doc_id: int | None, text: str, own: Tree, following: str, other: Tree) -> tuple:
        keep = len(text) - len(text) // 4
        edited = (text[:keep] + following[:len(text) // 4]).encode()
        changed = own if len(text) < 4 else tree(edited)
        return (doc_id, len(text), hashlib.sha256(edited).hexdigest(), own.root, changed.root, likeness(own, changed), likeness(own, other),
                len(own.sections), sum(map(len, own.paragraphs)), differing(own, changed))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, last = None, None
        for batch in batches:
            done = []
            for i in range(batch.num_rows):
                doc_id, text, at, guest = (batch.column(k)[i].as_py() for k in range(4))
                if at != run:
                    run, last = at, None
                elif last is None:                     # a further guest
                    continue
                here = tree(text.encode())
                if last is not None:
                    done.append(compare(*last, text, here))
                last = None if guest else (doc_id, text, here)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*done), fields)], schema=fields)

    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return with_next(rows, "doc_id").select("doc_id", "text", "_run", "_guest").mapInArrow(walk, RESULT)
