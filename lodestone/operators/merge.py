"""Keyed upsert and snapshot helpers for tables without a native MERGE."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ISSUE_REFRESHED = ["summary", "description", "status", "resolution", "priority",
                   "updated", "resolutiondate", "raw"]


def upsert(target: DataFrame, source: DataFrame, keys: list[str], refreshed: list[str],
           arrival: list[str], stamp: str | None = None, partitions: int | None = None) -> DataFrame:
    """New snapshot of ``target`` after ``source`` rows arrive in ``arrival`` order.

    ``refreshed`` columns take the latest arrival's value, NULL included; every other
    column keeps its first-seen value.  ``stamp`` is set to now for touched rows.
    Duplicates of a key are folded by map-side aggregation, so a hot key in the
    source costs one row per task; a target bucketed by the keys is not shuffled.
    ``partitions`` deals both sides, the source once folded, into that many tasks by key,
    and the result stays so: a writer that wants it by key needs no shuffle of its own.
    """
    columns = [c for c in target.columns if c not in keys and c != stamp]
    first_seen = [c for c in columns if c not in refreshed]
    position = F.struct(*arrival)
    folded = source.groupBy(*keys).agg(
        F.min_by(F.struct(F.lit(1).alias("_"), *first_seen), position).alias("_first"),
        F.max_by(F.struct(F.lit(1).alias("_"), *refreshed), position).alias("_last"))
    if partitions:
        target, folded = target.repartition(partitions, *keys), folded.repartition(partitions, *keys)
    t, s = target.withColumn("_held", F.lit(True)).alias("t"), folded.withColumn("_new", F.lit(True)).alias("s")
    same = reduce(lambda a, b: a & b, (F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys))
    came, held = F.col("_new").isNotNull(), F.col("_held").isNotNull()

    def value(name: str) -> Column:
        if name in keys:
            return F.coalesce(f"t.{name}", f"s.{name}").alias(name)
        if name == stamp:
            return F.when(came, F.current_timestamp()).otherwise(F.col(f"t.{name}")).alias(name)
        if name in refreshed:
            return F.when(came, F.col(f"_last.{name}")).otherwise(F.col(f"t.{name}")).alias(name)
        return F.when(held, F.col(f"t.{name}")).otherwise(F.col(f"_first.{name}")).alias(name)

    return t.join(s, same, "full_outer").select(*(value(c) for c in target.columns))


def upsert_issues(target: DataFrame, source: DataFrame, arrival: list[str], partitions: int | None = None) -> DataFrame:
    """Issue type, project, id and creation time stay as first seen; the rest follows the update."""
    refreshed = [c for c in ISSUE_REFRESHED if c in target.columns]
    stamp = "ingested_at" if "ingested_at" in target.columns else None
    return upsert(target, source, ["issue_key"], refreshed, arrival, stamp, partitions)


def upsert_chunks(target: DataFrame, source: DataFrame, arrival: list[str]) -> DataFrame:
    """Every column but the natural key is replaced."""
    keys = ["issue_key", "strategy", "chunk_index"]
    stamp = "embedded_at" if "embedded_at" in target.columns else None
    refreshed = [c for c in target.columns if c not in keys and c != stamp]
    return upsert(target, source, keys, refreshed, arrival, stamp)


def chunk_id(*keys: str) -> Column:
    """Surrogate id derived from the natural key; needs no global sequence."""
    return F.xxhash64(*keys)
