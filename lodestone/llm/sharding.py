"""Sharding by jump consistent hashing (Lamping and Veach, 2014): no ring table, and a new shard takes rows only into itself.

A row's shard follows from its key and the number of shards alone.  Null keys are a key like any other, repeated rows go to
one shard, an empty table gives an empty result, and other columns of the input are kept untouched.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one numbering group holds on average, so that no task numbers a whole shard.
GROUP_ROWS = 50_000


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key."""
    if shards < 1:
        raise ValueError("there must be a shard at least")
    key = keys.astype(np.int64).view(np.uint64).copy()
    shard, ahead = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    going = np.arange(len(key))
    while len(going):
        shard[going] = ahead[going]
        key[going] = state = key[going] * np.uint64(2862933555777941757) + np.uint64(1)
        ahead[going] = ((shard[going] + 1) * (2.0 ** 31 / ((state >> np.uint64(33)) + np.uint64(1)).astype(float))).astype(np.int64)
        going = going[ahead[going] < shards]
    return shard


def shard_of(key: Column, shards: int) -> Column:
    """``key`` of any type is hashed to 64 bits first, so runs and strides of ids spread evenly."""

    @F.pandas_udf("int")
    def spread(hashed: pd.Series) -> pd.Series:
        return pd.Series(jump(hashed.to_numpy(), shards).astype(np.int32))

    return spread(F.xxhash64(key))


def with_slots(rows: DataFrame, shard: str, order: list[str], slot: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 without a gap.

    Shards are cut into groups by a hash of ``order``; rows are numbered inside a group and moved up by the sizes of the groups
    before it.  Only the group sizes, one row for each group, are added up by shard.
    """
    groups = max(1, -(-rows.count() // GROUP_ROWS))
    rows = rows.withColumn("_group", F.pmod(F.xxhash64(*order), F.lit(groups)))
    sizes = rows.groupBy(shard, "_group").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(shard).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(shard).alias("_shard"), F.col("_group").alias("_of"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = rows.withColumn("_place", F.row_number().over(Window.partitionBy(shard, "_group").orderBy(*order)) - 1)
    joined = inside.join(starts, (F.col(shard) == F.col("_shard")) & (F.col("_group") == F.col("_of")))
    return joined.withColumn(slot, F.col("_start") + F.col("_place")).drop("_group", "_shard", "_of", "_start", "_place")


def op9_jump_sharding(documents: DataFrame, shards: int = 40) -> DataFrame:
    """Shard, slot, and the shard that each row would have with one more."""
    rows = documents.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    rows = rows.withColumns({"law": F.lit("key"), "shard": shard_of(F.col("doc_id"), shards), "grown_shard": shard_of(F.col("doc_id"), shards + 1)})
    return with_slots(rows, "shard", ["doc_id", "text_crc32", "size"])
