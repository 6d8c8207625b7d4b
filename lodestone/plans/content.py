"""Content to embed, the embedding backlog, and pluggable embedders."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone import values as V
from lodestone.functions import text

Embedder = Callable[[list[str]], np.ndarray]


def contents(issues: DataFrame, strategy: str, max_chars: int | None = None) -> DataFrame:
    """``(issue_key, strategy, chunk_index, content, token_count)``; the count is the uncut length in characters.

    ``max_chars`` cuts the content; without it texts stay whole.
    """
    whole = text.content(F.col("summary"), F.col("description"), strategy)
    return issues.select(
        "issue_key", F.lit(strategy).alias("strategy"), F.lit(0).alias("chunk_index"),
        text.clip(whole, max_chars).alias("content"),
        F.char_length(whole).alias("token_count"))


def all_contents(issues: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Every strategy from one scan of the issues."""
    made = F.explode(F.array(*(
        F.struct(F.lit(s).alias("strategy"), text.content(F.col("summary"), F.col("description"), s).alias("whole"))
        for s in V.STRATEGIES)))
    return (issues.select("issue_key", made.alias("m"))
            .select("issue_key", "m.strategy", F.lit(0).alias("chunk_index"),
                    text.clip(F.col("m.whole"), max_chars).alias("content"),
                    F.char_length("m.whole").alias("token_count")))


def content_report(made: DataFrame) -> DataFrame:
    """Rows, truncated rows and characters per strategy."""
    return made.groupBy("strategy").agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("token_count") > F.char_length("content")).alias("truncated"),
        F.sum("token_count").alias("chars"),
        F.sum(F.char_length("content")).alias("kept_chars"))


def backlog(issues: DataFrame, chunks: DataFrame, strategy: str, limit: int = 0) -> DataFrame:
    """Issues of a strategy without a chunk; ``limit`` takes the first ones by id (0 = all).

    Order only matters with a limit, which runs as a distributed top n.
    """
    done = chunks.where(F.col("strategy") == strategy).select("issue_key")
    left = issues.join(done, "issue_key", "left_anti")
    return left.orderBy("issue_id").limit(limit) if limit else left


class HashingEmbedder:
    """Deterministic default: signed feature hashing of words, scaled to unit length.

    The form of ``hash_embed`` for callers that plug in a model, such as the embedding stream.
    """

    def __init__(self, dim: int = V.STORED_DIM):
        self.dim = dim

    def __call__(self, texts: list[str]) -> np.ndarray:
        words = [re.findall(r"[^\W_]+", body.lower()) for body in texts]
        return unit_rows([[zlib.crc32(w.encode()) for w in row] for row in words], self.dim)


def unit_rows(codes: Sequence[Sequence[int]], dim: int) -> np.ndarray:
    """Word codes of each row summed into ``dim`` signed cells (bit 31 gives the sign), scaled to unit length; no words: zeros."""
    flat = np.concatenate([np.empty(0, np.int64), *codes]).astype(np.int64)
    rows = np.repeat(np.arange(len(codes)), [len(row) for row in codes])
    signs = np.where(flat >> 31 & 1, -1.0, 1.0)
    out = np.bincount(rows * dim + flat % dim, weights=signs, minlength=len(codes) * dim).reshape(len(codes), dim)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(length > 0, length, 1.0)).astype(np.float32)


def hash_embed(rows: DataFrame, dim: int = V.STORED_DIM, column: str = "content", into: str = "embedding") -> DataFrame:
    """Add the hashed vector of a text.  Words are cut and hashed on the JVM; only their codes reach Python, a batch at a time."""
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vectors(codes: pd.Series) -> pd.Series:
        return pd.Series(list(unit_rows(codes, dim)))

    codes = F.transform(text.words(F.coalesce(F.col(column), F.lit(""))), lambda w: F.crc32(w.cast("binary")))
    return rows.withColumn(into, vectors(codes))


def embed(rows: DataFrame, make: Callable[[], Embedder], column: str = "content", into: str = "embedding") -> DataFrame:
    """Add a vector column.  ``make()`` builds the model once per Python worker task."""
    schema = T.StructType([*rows.schema.fields, T.StructField(into, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for batch in batches:
            batch[into] = list(model(batch[column].tolist()))
            yield batch

    return rows.mapInPandas(run, schema)


def cut_vectors(rows: DataFrame, dim: int, native: int = V.NATIVE_DIM, column: str = "embedding") -> DataFrame:
    """Keep the first ``dim`` components, normalised after the cut."""
    from lodestone.functions.vector import truncate_and_normalize
    if dim > native:
        raise ValueError(f"dim {dim} exceeds the native {native}")
    return rows.withColumn(column, truncate_and_normalize(F.col(column), dim))


def throughput(run: DataFrame) -> DataFrame:
    """Rows, truncated rows, wall seconds and rows per second of a run log ``(rows, truncated, seconds)``."""
    return run.agg(F.sum("rows").alias("rows"), F.sum("truncated").alias("truncated"),
                   F.sum("seconds").alias("seconds"),
                   F.try_divide(F.sum("rows"), F.sum("seconds")).alias("rows_per_second"))
