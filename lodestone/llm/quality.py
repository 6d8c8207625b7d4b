"""Quality by naive Bayes support vectors: n-gram indicators scaled by class log-count ratios, then a linear hinge-loss model.

Indicators are words, pairs of words, and runs of one to three word shapes (letters of one case, digits and other characters in
runs; a word that repeats the one before has a shape of its own), hashed to ``BUCKETS``.  An indicator's scale is the logarithm of
its share among documents of label 1 over its share among those of label 0.  The weights are fitted by dual coordinate descent
(Hsieh and others, 2008), drawn towards their mean size, and margins become chances by a logistic curve fitted on rows that the
model did not see.

The model is fitted on a bounded sample: ``SAMPLE`` labelled rows at most, in the order of a hash; a text that comes with several labels counts once, with the most frequent.
Null and empty texts have no indicators and get the chance of the intercept.  Every row is scored, repeated ones too; rows with
null labels or ids are not learnt from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import BASE, mixed, prefix_hashes, range_hashes, steps, text_bytes

BUCKET_BITS = 20
BUCKETS = 1 << BUCKET_BITS
#: Labelled rows that the model is fitted on at most, and in how many of them an indicator must stand.
SAMPLE, LEAST_ROWS = 12_000, 4
THRESHOLD = 0.3

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = _CLASS[128:] = ord("a")
_CLASS[65:91] = ord("A")
_CLASS[48:58] = ord("0")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def indicators(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which indicators each text has: rows and buckets, each pair once, by row."""
    none = np.zeros(0, np.int64)
    if not len(data):
        return none, none
    inside = ~_BLANK[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    some = np.diff(offsets) > 0
    start[offsets[:-1][some]] = inside[offsets[:-1][some]]
    end[offsets[1:][some] - 1] = inside[offsets[1:][some] - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    if not len(starts):
        return none, none
    of = np.searchsorted(offsets, starts, "right") - 1
    words = range_hashes(prefix_hashes(_LOWER[data]), starts, ends)
    shape = _CLASS[data]
    kept = start.copy()
    kept[1:] |= inside[1:] & (shape[1:] != shape[:-1])
    place = np.concatenate(([0], np.cumsum(kept)))
    shapes = range_hashes(prefix_hashes(shape[kept]), place[starts], place[ends])
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
    shapes[same] = np.uint64(1)
    grams = [(words, of, 1)]
    for kind, column, most in ((2, words, 2), (3, shapes, 3)):
        run = column
        for size in range(1, most + 1):
            if size > 1:
                run = run[:-1] * np.uint64(BASE) + column[size - 1:]
            if (kind, size) != (2, 1):
                rows = of[:len(run)]
                grams.append((run[rows == of[size - 1:]], rows[rows == of[size - 1:]], 10 * kind + size))
    keys = np.concatenate([rows << BUCKET_BITS | (mixed(run + np.uint64(salt)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64) for run, rows, salt in grams])
    keys = np.unique(keys)
    return keys >> BUCKET_BITS, keys & (BUCKETS - 1)


def svm(rows: list[np.ndarray], scale: np.ndarray, labels: np.ndarray, cost: np.ndarray, epochs: int = 12, seed: int = 6) -> np.ndarray:
    """Weights of a hinge-loss model by dual coordinate descent; ``rows`` hold places in ``scale``, the last weight is the intercept."""
    w = np.zeros(len(scale) + 1)
    values = [scale[r] for r in rows]
    square = np.array([v @ v + 1.0 for v in values])
    dual = np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)).tolist():
            gradient = labels[i] * (w[rows[i]] @ values[i] + w[-1]) - 1.0
            step = min(max(dual[i] - gradient / square[i], 0.0), cost[i])
            change = (step - dual[i]) * labels[i]
            if change:
                w[rows[i]] += change * values[i]
                w[-1] += change
                dual[i] = step
    return w


def fit(rows: list[np.ndarray], good: np.ndarray, smoothing: float = 1.0, cost: float = 0.01, mixture: float = 0.5) -> tuple[np.ndarray, float]:
    """Weight of each bucket and the intercept."""
    counts = [np.bincount(np.concatenate([r for r, g in zip(rows, good) if g == side] or [np.zeros(0, np.int64)]), minlength=BUCKETS) for side in (0, 1)]
    seen = np.flatnonzero(counts[0] + counts[1] >= LEAST_ROWS)
    place = np.full(BUCKETS, -1)
    place[seen] = np.arange(len(seen))
    # shares of documents, not of all indicators: labels of different length and number stay comparable
    share = [(c[seen] + smoothing) / (np.sum(good == side) + 2 * smoothing) for side, c in enumerate(counts)]
    scale = np.log(share[1] / share[0])
    packed = [place[r][place[r] >= 0] for r in rows]
    weight = np.where(good == 1, 0.5 / max(1, np.sum(good == 1)), 0.5 / max(1, np.sum(good == 0))) * len(good)
    w = svm(packed, scale, np.where(good == 1, 1.0, -1.0), cost * weight)
    mean = np.abs(w[:-1]).mean() if len(seen) else 0.0
    out = np.zeros(BUCKETS)
    out[seen] = scale * ((1 - mixture) * mean + mixture * w[:-1])
    return out, float(w[-1] * mixture)


def margins(rows: list[np.ndarray], weights: np.ndarray, intercept: float) -> np.ndarray:
    return np.array([weights[r].sum() + intercept for r in rows])


def squashed(margin: np.ndarray) -> np.ndarray:
    """Margins of very long texts, whose many indicators add up, stay comparable."""
    return np.arcsinh(margin)


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the chance of y = 1, by Newton's method with a small ridge."""
    b = np.zeros(2)
    design = np.column_stack([x, np.ones(len(x))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ b, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), design.T @ (y - p) - 1e-3 * b)
        b += step
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0]), float(b[1])


def sampled(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text and label of at most ``sample`` labels (doc_id, label) in the order of a hash: few enough to be broadcast."""
    known = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").select(F.col("doc_id").alias("_id"), F.col("label").cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("_id"), "_id", "label").limit(sample)
    return documents.join(F.broadcast(known), F.col("doc_id") == F.col("_id")).select(F.coalesce("text", F.lit("")).alias("text"), "label")


def one_label(labelled: DataFrame) -> DataFrame:
    """text and label, one row for each text: its most frequent label, of equally frequent ones the smallest, whatever the order of rows."""
    each = labelled.groupBy("text", "label").count()
    return each.groupBy("text").agg(F.max(F.struct("count", (-F.col("label")).alias("label"))).alias("m")).select("text", (-F.col("m.label")).alias("label"))


def trained(labelled: DataFrame) -> tuple[np.ndarray, float, float, float]:
    """Bucket weights, intercept, slope and offset from (text, label) rows.  One task fits the bounded sample, one row for each text."""
    fields = pa.schema([("label", pa.int32()), ("buckets", pa.list_(pa.int32()))])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for low, high in steps(offsets):
                row, bucket = indicators(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
                ends = np.searchsorted(row, np.arange(high - low + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(low, high - low), pa.ListArray.from_arrays(pa.array(ends), pa.array(bucket.astype(np.int32)))], schema=fields)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, rows = [], []
        for batch in batches:
            labels.append(batch.column(0).to_numpy(zero_copy_only=False))
            rows += [np.asarray(b.values, np.int64) for b in batch.column(1)]
        if not rows:
            return
        good = np.concatenate(labels).astype(int)
        order = sorted(range(len(rows)), key=lambda i: (good[i], rows[i].tobytes()))     # whatever order they arrived in
        rows, good = [rows[i] for i in order], good[order]
        half = np.arange(len(rows)) % 2 == 0
        unseen = np.zeros(len(rows))
        for side in (half, ~half):
            w, b = fit([r for r, s in zip(rows, side) if s], good[side])
            unseen[~side] = margins([r for r, s in zip(rows, side) if not s], w, b)
        slope, offset = logistic(squashed(unseen), good)
        w, b = fit(rows, good)
        at = np.flatnonzero(w)
        ids, values = np.concatenate((at, [-1, -2, -3])), np.concatenate((w[at], [b, slope, offset]))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(values, pa.float64())], names=["bucket", "weight"])

    one = one_label(labelled)
    model = one.mapInArrow(gather, "label int, buckets array<int>").repartition(1).mapInArrow(learn, "bucket long, weight double").toArrow()
    ids, values = model.column("bucket").to_numpy(), model.column("weight").to_numpy()
    weights = np.zeros(BUCKETS, np.float32)
    weights[ids[ids >= 0]] = values[ids >= 0]
    rest = dict(zip(ids[ids < 0].tolist(), values[ids < 0].tolist()))
    return weights, rest.get(-1, 0.0), rest.get(-2, 1.0), rest.get(-3, 0.0)


def score(documents: DataFrame, model: tuple[np.ndarray, float, float, float], keep: list[str]) -> DataFrame:
    """The columns of ``keep`` and the chance of label 1 (score)."""
    sent = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(*keep, F.col("text").alias("_text"))
    schema = documents.select(*keep).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, intercept, slope, offset = sent.value
        used = weights != 0
        for batch in batches:
            data, offsets = text_bytes(batch.column(batch.num_columns - 1))
            total = np.zeros(batch.num_rows)
            for low, high in steps(offsets):
                row, bucket = indicators(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
                at = used[bucket]
                total[low:high] = np.bincount(row[at], weights[bucket[at]], high - low)
            chance = 1 / (1 + np.exp(-np.clip(slope * squashed(total + intercept) + offset, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(chance)], names=[*batch.schema.names[:-1], "score"])

    return rows.mapInArrow(run, schema)


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def op6_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Score all documents; labels come from rows that are not held out only."""
    known = labels.where(~held_out()).select("doc_id", F.col("quality").alias("label"))
    scored = score(documents, trained(sampled(documents, known)), ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
