"""What the operators share: tables, and texts as bytes of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on (one longer text is a step of its own).
STEP_BYTES = 1 << 19

#: An odd base: powers of it have inverses modulo 2^64.
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: A second one, for hashes that have nothing to do with those of the first.
OTHER = 0xD1342543DE82EF95
OTHER_INVERSE = pow(OTHER, -1, 1 << 64)


#: Rows and bytes of an Arrow batch: texts of some kilobytes each make a few megabytes, long ones no more.
BATCH_ROWS, BATCH_BYTES = 2_000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data.  Batches of Spark's default size, ten thousand rows, would hold too much text: they are made smaller."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The largest table of bits that is sent to the tasks: 16 MB, for eight million hashes at one false hit in sixteen.
FILTER_BITS = 27


class Sieve:
    """A table of bits, of bounded size, that turns away most hashes which are not among given ones, and none that is.

    It is sized by the number of hashes; beyond its bound it lets more through, so what follows has to decide.
    """

    def __init__(self, frame: DataFrame, column: str) -> None:
        """``column`` holds hashes as longs.  Bits are put together by Spark; at most 2^21 words come to the driver."""
        self.bits = min(FILTER_BITS, max(16, (16 * frame.count()).bit_length()))
        cell = F.shiftrightunsigned(F.col(column), 64 - self.bits).alias("cell")
        words = frame.select(cell).select(F.shiftright("cell", 6).alias("word"), F.expr("shiftleft(1L, CAST(cell & 63 AS INT))").alias("bit"))
        rows = words.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
        table = np.zeros(1 << (self.bits - 6), np.uint64)
        table[rows["word"].to_numpy()] = rows["bit"].to_numpy().view(np.uint64)
        self.sent = frame.sparkSession.sparkContext.broadcast(table)

    def __getstate__(self) -> dict:
        return {"bits": self.bits, "sent": self.sent}

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        """Which of the hashes (unsigned) may be among those given."""
        cell = hashes >> np.uint64(64 - self.bits)
        return (self.sent.value[cell >> np.uint64(6)] >> (cell & np.uint64(63))) & np.uint64(1) == 1


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after the other, and the n + 1 places where they begin.  Null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, count=len(column) + 1, offset=8 * column.offset)
    if offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have at most ``limit`` bytes together, or one row each."""
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, high
        low = high


@lru_cache(maxsize=4)
def _powers(size: int, base: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(size: int, base: int = BASE) -> np.ndarray:
    """The first powers of ``base`` modulo 2^64.  Kept for the usual sizes, so that a step computes none."""
    room = 1 << max(16, int(size).bit_length())
    return (_powers(room, base) if room <= 2 * STEP_BYTES else _powers.__wrapped__(size, base))[:size]


def prefix_hashes(data: np.ndarray, base: int = BASE) -> np.ndarray:
    """Sums of byte x base^place before each place: the polynomial hash of any range in two look-ups."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data), base), out=out[1:])
    return out


def range_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, inverse: int = BASE_INVERSE) -> np.ndarray:
    """Hashes of byte ranges; equal bytes give equal hashes wherever they stand."""
    return mixed((prefix[ends] - prefix[starts]) * powers(len(prefix), inverse)[starts])


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of hashes (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


_FILLED = np.ones(256, bool)
_FILLED[[32, *range(9, 14)]] = False


class Words:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of lower-cased (A-Z) texts, as byte ranges with hashes.

    With ``blanks``, the words are what blanks separate instead: ``[^\\x20\\x09-\\x0D]+``; ``inside`` gives the bytes of a word in any other way.
    ``starts``, ``ends``: byte ranges.  ``of``: the text of each word.  ``first``: n + 1 places in the words where texts begin.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, blanks: bool = False, inside: np.ndarray | None = None) -> None:
        self.data = data = _LOWER[data]
        inside = (inside if inside is not None else _FILLED if blanks else _WORD)[data]
        start, end = inside.copy(), inside.copy()
        if len(data):
            start[1:] &= ~inside[:-1]
            end[:-1] &= ~inside[1:]
            begins, stops = offsets[:-1][np.diff(offsets) > 0], offsets[1:][np.diff(offsets) > 0] - 1
            start[begins] = inside[begins]
            end[stops] = inside[stops]
        self.starts, self.ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.of = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.sums = prefix_hashes(data)
        self.hashes = range_hashes(self.sums, self.starts, self.ends)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i]:self.ends[i]].tobytes()

    def runs(self, size: int) -> np.ndarray:
        """Hashes of all runs of ``size`` words, also those that reach into the next text: callers check the bounds."""
        n = len(self.hashes) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = np.zeros(n, np.uint64)
        for i in range(size):
            out = out * np.uint64(BASE) + self.hashes[i:i + n]
        return mixed(out)


class Members:
    """Which of many hashes are in a set: a bit table turns most away, a search in the sorted set decides."""

    BITS = 20

    def __init__(self, hashes: np.ndarray) -> None:
        self.sorted = np.unique(hashes)
        self.table = np.zeros(1 << self.BITS, bool)
        self.table[self.sorted >> np.uint64(64 - self.BITS)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``hashes`` of members, and their places in the sorted set."""
        if not len(self.sorted) or not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.table[hashes >> np.uint64(64 - self.BITS)])
        place = np.minimum(np.searchsorted(self.sorted, hashes[at]), len(self.sorted) - 1)
        hit = self.sorted[place] == hashes[at]
        return at[hit], place[hit]
