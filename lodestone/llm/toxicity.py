"""Toxicity by cumulative-link ordinal regression over sparse text features: words and beginnings of words.

Grades 0 .. K are ordered.  One weight for each feature is shared by all thresholds: the chance of a grade above k is
1 / (1 + exp(threshold_k - score)), with increasing thresholds, and the score is the sum of weight x log2(1 + count).  The expected
severity is the sum of these chances.  The model is fitted by accelerated proximal gradient steps with an absolute-value penalty,
which leaves a weight only to features that many labelled documents agree on; more steps on these alone undo the shrinking.

The model is fitted on a bounded sample: ``SAMPLE`` labelled rows at most, in the order of a hash; a text that comes with several labels counts once, with the most frequent.
Null and empty texts have no words and get the severity of the thresholds alone.  Every row is scored, repeated ones too; null
labels are not learnt from.  With no labelled rows every severity is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Members, Words, mixed, range_hashes, steps, text_bytes
from lodestone.llm.quality import one_label, sampled
from lodestone.session import cut_lineage, scratch

SAMPLE = 6_000
#: Beginnings of words count as features up to this length in bytes: inflected forms share them.
STEM = 8
#: A feature must stand in so many different sampled texts, and in this share of them with a grade; how many are looked at closely; the penalty that chooses among them, and
#: the ridge of the fit on the chosen ones.
LEAST_TEXTS, PURE, SCREENED, PENALTY, RIDGE = 8, 0.75, 600, 0.0005, 0.00001
GRADES = 3
#: The chance of a grade above 0 from which a document is called toxic.
CHANCE = 0.4


@dataclass
class Model:
    words: np.ndarray                                  # sorted hashes
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, scores: np.ndarray) -> np.ndarray:
        """Chances of a grade above 0, above 1 and so on, by row."""
        return _chance(scores[:, None] - self.thresholds[None])


def _chance(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def features(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Texts and hashes of the features of one kind after the other: whole words, then beginnings of 2 to ``STEM`` bytes of longer ones."""
    yield words.of, words.hashes
    length = words.ends - words.starts
    for size in range(2, STEM + 1):
        at = np.flatnonzero(length > size)
        starts = words.starts[at]
        yield words.of[at], mixed(range_hashes(words.sums, starts, starts + size) + np.uint64(size))


def counted(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and count of each different feature of each text."""
    rows, hashes = (np.concatenate(x) for x in zip(*features(words)))
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    first = np.flatnonzero(np.concatenate(([True] * bool(len(rows)), (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1]))))
    return rows[first], hashes[first], np.diff(np.append(first, len(rows)))


def _slopes(score: np.ndarray, thresholds: np.ndarray, grades: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of the negative log-likelihood of the grades by score and by threshold, for each row."""
    n, own = len(score), np.arange(len(score))
    full = np.concatenate((np.ones((n, 1)), _chance(score[:, None] - thresholds[None]), np.zeros((n, 1))), axis=1)
    upper, lower = full[own, grades], full[own, grades + 1]
    by_upper, by_lower = upper * (1 - upper), lower * (1 - lower)
    chance = np.maximum(upper - lower, 1e-12)
    by_threshold = np.zeros((n, full.shape[1]))
    by_threshold[own, grades] = by_upper / chance
    by_threshold[own, grades + 1] = -by_lower / chance
    return -(by_upper - by_lower) / chance, by_threshold[:, 1:-1]


def descend(x: np.ndarray, grades: np.ndarray, thresholds: np.ndarray, penalty: float, ridge: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Accelerated proximal steps from weight zero; weights stay at zero or above, thresholds in order."""
    n, width = x.shape
    probe, largest = np.ones(width), 1.0
    for _ in range(20):                                                               # the largest eigenvalue bounds the step
        probe = x.T @ (x @ probe)
        largest = np.linalg.norm(probe)
        probe /= max(largest, 1e-12)
    step = 1 / (0.5 * largest / n + ridge + 1e-9)
    weights, point, momentum = np.zeros(width), np.zeros(width), 1.0
    for _ in range(rounds):
        by_score, by_threshold = _slopes(x @ point, thresholds, grades)
        new = np.maximum(point - step * (x.T @ by_score / n + ridge * point + penalty), 0.0)
        thresholds = np.maximum.accumulate(thresholds - 2 * by_threshold.mean(axis=0))
        if (point - new) @ (new - weights) > 0:                                       # past the valley: start again from here
            momentum = 1.0
        ahead = (1 + np.sqrt(1 + 4 * momentum ** 2)) / 2
        point, weights, momentum = new + (momentum - 1) / ahead * (new - weights), new, ahead
    return weights, thresholds


def fit_ordinal(x: np.ndarray, grades: np.ndarray, n_grades: int, penalty: float, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the cumulative logit model for dense features and grades 0 .. n_grades - 1.

    Weights are never negative: no amount of harmless words makes up for others.  The penalty chooses features; the chosen ones
    are fitted again without it.
    """
    share = ((grades[:, None] > np.arange(n_grades - 1)[None]).sum(axis=0) + 0.5) / (len(x) + 1)
    thresholds = np.maximum.accumulate(np.log((1 - share) / share) + 1e-3 * np.arange(n_grades - 1))
    weights = np.zeros(x.shape[1])
    if not len(weights):
        return weights, thresholds
    first, _ = descend(x, grades, thresholds, penalty, ridge, 300)
    chosen = np.flatnonzero(first)
    weights[chosen], thresholds = descend(x[:, chosen], grades, thresholds, 0.0, ridge, 3000)
    return weights, thresholds


def severity_grades(rows: np.ndarray, columns: np.ndarray, counts: np.ndarray, toxic: np.ndarray, n_columns: int) -> np.ndarray:
    """Ordered grades from two-valued labels: 0 not toxic, 1 toxic, 2 toxic in many places.

    Many is more marked features than the median of toxic texts that have some; marked ones stand in toxic texts mostly.
    """
    seen = np.bincount(columns, minlength=n_columns)
    bad = np.bincount(columns, toxic[rows].astype(float), n_columns)
    marked = bad >= 0.8 * np.maximum(seen, 1)
    places = np.bincount(rows, counts * marked[columns], len(toxic))
    some = places[(toxic == 1) & (places > 0)]
    return np.where(toxic == 1, np.where(places > (np.median(some) if len(some) else 0), 2, 1), 0)


def trained(labelled: DataFrame, n_grades: int = GRADES, from_labels: bool = True) -> Model:
    """Fit (text, label) rows.  Labels are grades, or 0 and 1 from which grades are made (``from_labels``)."""
    fields = pa.schema([("label", pa.int32()), ("hashes", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32()))])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for low, high in steps(offsets):
                row, hashes, counts = counted(Words(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low]))
                ends = pa.array(np.searchsorted(row, np.arange(high - low + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    batch.column(1).slice(low, high - low), pa.ListArray.from_arrays(ends, pa.array(hashes.view(np.int64))),
                    pa.ListArray.from_arrays(ends, pa.array(counts.astype(np.int32)))], schema=fields)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, texts, wanted = [], [], Members(sent.value)
        for batch in batches:
            labels += batch.column(0).to_pylist()
            for h, c in zip(batch.column(1), batch.column(2)):
                at, _ = wanted.find(np.asarray(h.values).view(np.uint64))
                texts.append((np.asarray(h.values)[at], np.asarray(c.values)[at]))
        if not texts:
            return
        order = sorted(range(len(texts)), key=lambda i: (labels[i], texts[i][0].tobytes(), texts[i][1].tobytes()))
        grades = np.array([labels[i] for i in order])
        row = np.repeat(np.arange(len(order)), [len(texts[i][0]) for i in order])
        hashes, counts = (np.concatenate([texts[i][k] for i in order]) for k in (0, 1))
        words, column, seen = np.unique(hashes, return_inverse=True, return_counts=True)
        used = seen >= LEAST_TEXTS
        place = np.cumsum(used) - 1
        at = used[column]
        row, column, counts, words = row[at], place[column[at]], counts[at], words[used]
        if from_labels:
            grades = severity_grades(row, column, counts, grades, len(words))
        values = np.log2(1 + counts)
        # of the features that stand mostly in texts above grade 0, those whose slope at weight zero is largest
        pure = np.bincount(column, (grades > 0)[row], len(words)) >= PURE * np.bincount(column, minlength=len(words))
        slopes = pure * np.bincount(column, values * (grades - grades.mean())[row], len(words)) / len(order)
        best = np.sort(np.argsort(-slopes, kind="stable")[:SCREENED])
        at = np.full(len(words), -1)
        at[best] = np.arange(len(best))
        x = np.zeros((len(order), len(best)))
        dense = at[column] >= 0
        x[row[dense], at[column[dense]]] = values[dense]
        _, first = np.unique(x, axis=1, return_index=True)                            # beginnings that only one word has say nothing new
        weights, thresholds = fit_ordinal(x[:, np.sort(first)], grades, n_grades, PENALTY, RIDGE)
        words = words[best[np.sort(first)]]
        kept = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((words[kept], np.arange(len(thresholds))))), pa.array(np.concatenate((weights[kept], thresholds))),
                                          pa.array([True] * len(kept) + [False] * len(thresholds))], names=["word", "value", "weight"])

    spark = labelled.sparkSession
    with scratch(spark):
        texts = cut_lineage(one_label(labelled).mapInArrow(gather, "label int, hashes array<long>, counts array<int>"))
        # features that can get a weight at all: in enough texts, most of them with a grade.  The others never reach the one task that fits.
        each = texts.select((F.col("label") > 0).cast("int").alias("bad"), F.explode("hashes").alias("hash")).groupBy("hash").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
        pure = each.where((F.col("n") >= LEAST_TEXTS) & (F.col("bad") >= PURE * F.col("n"))).select("hash").toArrow()["hash"].to_numpy()
        sent = spark.sparkContext.broadcast(pure.view(np.uint64))
        model = texts.repartition(1).mapInArrow(learn, "word long, value double, weight boolean").toArrow()
    word, value, weight = (model.column(i).to_numpy() for i in range(3))
    weight = weight.astype(bool)
    if not len(word):
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.full(n_grades - 1, 30.0))
    order = np.argsort(word[weight].view(np.uint64))
    levels = np.argsort(word[~weight])
    return Model(word[weight].view(np.uint64)[order], value[weight][order], value[~weight][levels])


def severity(documents: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns of ``keep``, the expected severity, the chance of any grade above 0 (chance), and the likeliest grade."""
    sent = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)), F.col("text").alias("_text"))
    schema = rows.drop("_text").schema.add("severity", "double").add("chance", "double").add("grade", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        members = Members(model.words)
        for batch in batches:
            data, offsets = text_bytes(batch.column(batch.num_columns - 1))
            scores = np.zeros(batch.num_rows)
            for low, high in steps(offsets):
                words = Words(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
                found = []
                for of, hashes in features(words):
                    at, place = members.find(hashes)
                    found.append(of[at] * len(model.words) + place)
                pair, counts = np.unique(np.concatenate(found), return_counts=True)
                row, place = np.divmod(pair, max(1, len(model.words)))
                scores[low:high] = np.bincount(row, np.log2(1 + counts) * model.weights[place], high - low)
            above = model.above(scores)
            each = -np.diff(above, axis=1, prepend=1.0, append=0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(above.sum(axis=1)), pa.array(above[:, 0]), pa.array(each.argmax(axis=1).astype(np.int32))],
                                             names=[*batch.schema.names[:-1], "severity", "chance", "grade"])

    out = rows.mapInArrow(run, schema)
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)), "severity", "chance", "grade")


def from_labels(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    return trained(sampled(documents, labels.select("doc_id", F.col("toxic").alias("label")), sample))


def op2_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Expected severity (0 to 2) and grade of each document; toxic where a grade above 0 has a chance of ``CHANCE`` or more."""
    scored = severity(documents, from_labels(documents, labels), ["doc_id"])
    return scored.select("doc_id", "severity", "grade", (F.col("chance") >= CHANCE).alias("toxic"))
