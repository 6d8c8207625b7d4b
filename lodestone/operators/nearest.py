"""Exact nearest rows by cosine distance for a whole table of questions.

The corpus is scanned where it lies and never shuffled: each task multiplies its Arrow
batches with a block of question vectors and keeps a running top k per question,
so only ``k`` rows per question and partition reach the merge.  A block is broadcast
and holds at most ``BLOCK_BYTES``; more questions than that are answered block after
block, one scan and one broadcast at a time.

Matrix products only choose: whatever lies within ``SLACK`` of the k-th distance is
computed again, pair by pair in one fixed order, and ranked by that unrounded value.
So equal vectors tie exactly, and neighbours closer than the error of a product keep their order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestone.session import cut_lineage

BLOCK_BYTES = 64 << 20       # question vectors broadcast at once (8 bytes a component)
MATRIX_CELLS = 4_000_000     # distances held at once inside a task
SLACK = 1e-9                 # far above the error of a product of unit vectors
UNKNOWN = 9.0                # stands for a NULL distance: behind every real one (at most 2)


def nearest(questions: DataFrame, chunks: DataFrame, k: int, *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``questions(qid, qvec[, form_id])`` x ``chunks(issue_key, embedding[, form_ids])``.

    Returns ``(qid, rank, issue_key, distance)``, rank from 0.  With ``form_ids`` a
    question competes only on rows that list its ``form_id``.  Ties go to the smaller key.

    The dimension is the commonest length of a question vector (the longer one of two
    that are as common).  A NULL, zero or otherwise long vector is not usable, on either
    side: its distances are NULL and come last, and all other pairs are ranked as ever.
    """
    filtered = "form_ids" in chunks.columns
    asked = questions.select("qid", F.col("qvec").cast("array<double>").alias("qvec"),
                             *(["form_id"] if filtered else []))
    chunks = chunks.select("issue_key", "embedding", *(["form_ids"] if filtered else []))
    output = T.StructType([
        T.StructField("qid", asked.schema["qid"].dataType),
        T.StructField("issue_key", T.StringType()),
        T.StructField("distance", T.DoubleType()),
    ])
    length = F.when(F.col("qvec").isNotNull(), F.size("qvec")).otherwise(0).alias("dim")
    lengths = asked.groupBy(length).agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy()))
    usual = lengths.orderBy(F.col("dim") == 0, F.col("n").desc(), F.col("dim").desc()).first()
    if usual is None:
        return asked.sparkSession.createDataFrame(
            [], T.StructType([output["qid"], T.StructField("rank", T.IntegerType()),
                              output["issue_key"], output["distance"]]))
    dim = max(usual["dim"], 1)
    # Vectors of another length count as NULL: no block outgrows its bound.
    asked = asked.withColumn("qvec", F.when(F.size("qvec") == dim, F.col("qvec")))
    blocks = math.ceil(usual["total"] * dim * 8 / block_bytes)
    if blocks == 1:
        return merge_top(_scan(asked, chunks, k, dim, output)[0], k)
    # Each block's few rows are written before the next one is broadcast, so driver and executors hold one block.
    partials = []
    for at in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == at)
        partial, sent = _scan(block, chunks, k, dim, output)
        partials.append(cut_lineage(partial))
        sent.destroy()
    return merge_top(reduce(DataFrame.unionByName, partials), k)


def _scan(asked: DataFrame, chunks: DataFrame, k: int, dim: int, output: T.StructType) -> tuple[DataFrame, Broadcast]:
    """The k nearest rows of each task for one block of questions, and the block as it was broadcast."""
    block = asked.sparkSession.sparkContext.broadcast(asked.toArrow())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not block.value.num_rows:
            return
        best = TopK(block.value, k, dim)
        for batch in batches:
            best.add(batch)
        yield from best.result().to_batches()

    return chunks.mapInArrow(scan, output), block


def merge_top(partial: DataFrame, k: int) -> DataFrame:
    """Global top k from per-partition ones; a key counts once, at its smallest distance."""
    best = partial.groupBy("qid", "issue_key").agg(F.min("distance").alias("distance"))
    order = Window.partitionBy("qid").orderBy(F.col("distance").asc_nulls_last(), "issue_key")
    return (best.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)
            .select("qid", (F.col("_n") - 1).alias("rank"), "issue_key", "distance"))


class TopK:
    """Running top k per question over Arrow batches of one task."""

    def __init__(self, block: pa.Table, k: int, dim: int):
        self.k, self.dim = k, dim
        self.qids = pa.concat_arrays(block.column("qid").chunks)
        self.vectors = self._unit_rows(pa.concat_arrays(block.column("qvec").chunks))
        self.forms = None
        if "form_id" in block.column_names:
            form = block.column("form_id").to_numpy()
            self.forms = {f: np.flatnonzero(form == f) for f in np.unique(form)}
        self.distance = np.full((block.num_rows, k), np.inf)
        self.key = np.full((block.num_rows, k), "", dtype=object)

    def add(self, batch: pa.RecordBatch) -> None:
        if not batch.num_rows:
            return
        keys = np.array(batch.column("issue_key").to_pylist(), dtype=object)
        unit = self._unit_rows(batch.column("embedding"))
        everyone = np.arange(len(self.qids))
        if self.forms is None:
            self._score(everyone, keys, unit)
            return
        lists = batch.column("form_ids")
        row_of = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        listed = lists.flatten().to_numpy(zero_copy_only=False)
        by_form = np.argsort(listed, kind="stable")
        ids, starts = np.unique(listed[by_form], return_index=True)
        for form, rows in zip(ids, np.split(by_form, starts[1:])):
            if form in self.forms:
                picked = row_of[rows]
                self._score(self.forms[form], keys[picked], unit[picked])

    def _unit_rows(self, column: pa.Array) -> np.ndarray:
        """Vectors at unit length; NaN for those that are not usable."""
        lengths = np.diff(column.offsets.to_numpy())
        usable = np.asarray(column.is_valid()) & (lengths == self.dim)
        unit = np.full((len(column), self.dim), np.nan)
        flat = column.filter(pa.array(usable)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        unit[usable] = flat.reshape(-1, self.dim)
        with np.errstate(divide="ignore", invalid="ignore"):
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        return unit

    def _score(self, who: np.ndarray, keys: np.ndarray, unit: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        keys, unit = keys[order], unit[order]
        firsts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        step = max(1, MATRIX_CELLS // len(keys))
        for at in range(0, len(who), step):
            part = who[at:at + step]
            distance = self._exact_where_near(part, unit, firsts)
            if len(firsts) < len(keys):
                distance = np.minimum.reduceat(distance, firsts, axis=1)
            self._absorb(part, keys[firsts], distance)

    def _exact_where_near(self, part: np.ndarray, unit: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Distances of questions ``part`` to all rows; infinite where a row is surely behind the k nearest keys."""
        rough = 1.0 - self.vectors[part] @ unit.T
        rough[np.isnan(rough)] = UNKNOWN
        limit = self.distance[part, -1]
        if len(firsts) > self.k:
            by_key = np.minimum.reduceat(rough, firsts, axis=1)
            limit = np.minimum(limit, np.partition(by_key, self.k - 1, axis=1)[:, self.k - 1])
        q, row = np.nonzero(rough <= limit[:, None] + SLACK)
        exact = np.full(rough.shape, np.inf)
        step = max(1, MATRIX_CELLS // self.dim)
        for at in range(0, len(q), step):
            a, b = q[at:at + step], row[at:at + step]
            found = 1.0 - (self.vectors[part[a]] * unit[b]).sum(axis=1)
            exact[a, b] = np.where(np.isnan(found), UNKNOWN, found)
        return exact

    def _absorb(self, who: np.ndarray, keys: np.ndarray, distance: np.ndarray) -> None:
        """Merge distances of distinct, sorted keys into the state of questions ``who``."""
        k = self.k
        limit = self.distance[who, -1]
        if distance.shape[1] > k:
            limit = np.minimum(limit, np.partition(distance, k - 1, axis=1)[:, k - 1])
        near = (distance <= limit[:, None]) & np.isfinite(distance)
        if np.count_nonzero(near) > 4 * k * len(who):
            # Many copies tie at the limit: the first k keys of a tie are enough.
            tied = distance == limit[:, None]
            near &= ~tied | (np.cumsum(tied, axis=1) <= k)
        q, c = np.nonzero(near)
        if not len(q):
            return
        held_q, held_c = np.nonzero(np.isfinite(self.distance[who]))
        q = np.concatenate([held_q, q])
        d = np.concatenate([self.distance[who[held_q], held_c], distance[near]])
        key = np.concatenate([self.key[who[held_q], held_c], keys[c]])
        names, code = np.unique(key, return_inverse=True)
        order = np.lexsort((code, d, q))
        q, d, code = q[order], d[order], code[order]
        _, once = np.unique(q * len(names) + code, return_index=True)
        once.sort()
        q, d, code = q[once], d[once], code[once]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        top = place < k
        q, d, code, place = q[top], d[top], code[top], place[top]
        rows = np.unique(q)
        self.distance[who[rows]] = np.inf
        self.distance[who[q], place] = d
        self.key[who[q], place] = names[code]

    def result(self) -> pa.Table:
        q, c = np.nonzero(np.isfinite(self.distance))
        distance = self.distance[q, c]
        return pa.table({
            "qid": self.qids.take(pa.array(q)),
            "issue_key": pa.array(self.key[q, c].tolist(), pa.string()),
            "distance": pa.array(distance, pa.float64(), mask=distance == UNKNOWN),
        })
