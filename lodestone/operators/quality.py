"""Checks and maintenance that follow from the declared constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_keys(table: DataFrame, *keys: str) -> DataFrame:
    return table.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, key: str = "issue_key") -> DataFrame:
    return child.join(parent.select(key), key, "left_anti")


def cascade_delete(child: DataFrame, deleted: DataFrame, key: str = "issue_key") -> DataFrame:
    """Child rows that stay after the parents in ``deleted`` are gone."""
    return child.join(deleted.select(key), key, "left_anti")


def null_counts(table: DataFrame, *required: str) -> DataFrame:
    """``(column, nulls)`` in one pass over the table."""
    counted = table.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in required))
    return counted.unpivot([], list(required), "column", "nulls")


def wrong_dimension(chunks: DataFrame, dim: int) -> DataFrame:
    """Chunks whose stored vector does not have ``dim`` components."""
    return chunks.where(F.col("embedding").isNotNull() & (F.size("embedding") != dim))
