"""Ranks, cuts and fusion of ranked lists in the long form (qid, rank, issue_key, score)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone import values as V


def top_rows(rows: DataFrame, k: int | None, *order: Column, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """Rank rows from 0 within ``by`` and keep the first ``k``.

    The limit reaches both sides of the shuffle (WindowGroupLimit), so a question
    with very many rows sends at most ``k`` of them from each task.
    """
    numbered = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    if k is not None:
        numbered = numbered.where(F.col("_n") <= k)
    rest = [c for c in rows.columns if c not in (*by, "rank")]
    return numbered.select(*by, (F.col("_n") - 1).alias("rank"), *rest)


def side_by_side(vec: DataFrame, kw: DataFrame) -> DataFrame:
    """``(qid, issue_key, vec_rank, kw_rank, distance)`` of the union of two lists.

    A union and one aggregation: the same result as a full outer join, with one shuffle.
    """
    none = F.lit(None)
    left = vec.select("qid", "issue_key", F.col("rank").alias("vec_rank"), none.cast("int").alias("kw_rank"), "distance")
    right = kw.select("qid", "issue_key", none.cast("int").alias("vec_rank"), F.col("rank").alias("kw_rank"),
                      none.cast("double").alias("distance"))
    return (left.unionByName(right).groupBy("qid", "issue_key")
            .agg(F.min("vec_rank").alias("vec_rank"), F.min("kw_rank").alias("kw_rank"),
                 F.min("distance").alias("distance")))


def reciprocal(rank: Column, k0: int = V.RRF_K, base: int = 0) -> Column:
    """1 / (k0 + rank + base); an absent rank adds nothing."""
    return F.coalesce(F.lit(1.0) / (F.lit(k0 + base) + rank), F.lit(0.0))


def fuse(vec: DataFrame, kw: DataFrame, k: int | None, weight: float = V.KEYWORD_WEIGHT) -> DataFrame:
    """Weighted reciprocal rank fusion of a vector and a keyword list (ranks from 0)."""
    both = side_by_side(vec, kw).withColumn(
        "score", reciprocal(F.col("vec_rank")) + F.lit(weight) * reciprocal(F.col("kw_rank")))
    ranked = top_rows(both, k, F.col("score").desc(), F.col("vec_rank").asc_nulls_last(), F.col("issue_key"))
    return ranked.select("qid", "rank", "issue_key", "score")


def fuse_lists(lists: DataFrame, weights: dict[str, float], k: int | None,
               k0: int = V.RRF_K, base: int = 0) -> DataFrame:
    """Fusion of any number of lists ``(qid, list, issue_key, rank)``; weight 0 keeps a list's keys."""
    weight = reduce(lambda c, n: c.when(F.col("list") == n, F.lit(float(weights[n]))), weights, F)
    first = next(iter(weights))
    scored = (lists.where(F.col("list").isin(list(weights)))
              .groupBy("qid", "issue_key")
              .agg(F.sum(weight * reciprocal(F.col("rank"), k0, base)).alias("score"),
                   F.min(F.when(F.col("list") == first, F.col("rank"))).alias("_first")))
    ranked = top_rows(scored, k, F.col("score").desc(), F.col("_first").asc_nulls_last(), F.col("issue_key"))
    return ranked.select("qid", "rank", "issue_key", "score")


def rescue(vec: DataFrame, kw: DataFrame, k: int = V.TOP_K, m: int = V.RESCUE_SLOTS) -> DataFrame:
    """Vector order untouched up to ``k - m``; the last ``m`` places go to keyword hits.

    Places the keyword list cannot fill go to the next vector rows (NULL score).
    """
    in_head = F.coalesce(F.col("vec_rank") < k - m, F.lit(False))
    both = side_by_side(vec, kw).withColumn("in_head", in_head)
    both = both.withColumn("_source", F.when(F.col("in_head"), 0).when(F.col("kw_rank").isNotNull(), 1).otherwise(2))
    by_question = Window.partitionBy("qid")
    order = by_question.orderBy("_source", F.when(F.col("_source") == 1, F.col("kw_rank")).otherwise(F.col("vec_rank")))
    placed = (both.withColumn("_n", F.row_number().over(order))
              .withColumn("_head", F.count_if("in_head").over(by_question))
              .where(F.col("in_head") | (F.col("_n") - F.col("_head") <= m)))
    score = F.when(F.col("in_head"), F.col("distance")).when(
        F.col("kw_rank").isNotNull(), F.lit(1.0) / (F.lit(V.RRF_K) + F.col("kw_rank")))
    return placed.select("qid", (F.col("_n") - 1).alias("rank"), "issue_key", score.alias("score"))


def rerank_order(scored: DataFrame) -> DataFrame:
    """Add ``rr_rank``: order by score, ties in vector order.  ``scored`` has (qid, rank, issue_key, pair_score)."""
    order = Window.partitionBy("qid").orderBy(F.col("pair_score").desc(), "rank")
    return scored.withColumn("rr_rank", F.row_number().over(order) - 1)


def blend(scored: DataFrame, k: int | None = V.TOP_K) -> DataFrame:
    """Reciprocal ranks of vector order and score order added up (ranks from 1)."""
    ranked = rerank_order(scored).withColumn(
        "score", reciprocal(F.col("rank"), base=1) + reciprocal(F.col("rr_rank"), base=1))
    return (top_rows(ranked.withColumnRenamed("rank", "_vec"), k, F.col("score").desc(), F.col("_vec"))
            .select("qid", "rank", "issue_key", "score"))


def pure_rerank(scored: DataFrame, depth: int, k: int | None = V.TOP_K, cut_first: bool = True) -> DataFrame:
    """Order by score only.  ``cut_first=False`` sorts every candidate and cuts afterwards."""
    if cut_first:
        scored = scored.where(F.col("rank") < depth)
    ranked = rerank_order(scored)
    limit = depth if k is None else min(depth, k)
    return (ranked.where(F.col("rr_rank") < limit)
            .select("qid", F.col("rr_rank").alias("rank"), "issue_key", F.col("pair_score").alias("score")))


def routed(candidates: DataFrame, flags: DataFrame, scores: DataFrame, depth: int = V.RERANK_DEPTH,
           k: int = V.TOP_K) -> DataFrame:
    """Blend where no filter was set, keep vector order where one was.

    ``candidates(qid, rank, issue_key, distance)``, ``flags(qid, filtered)``, and
    stored ``scores(qid, issue_key, pair_score)``; a missing score counts as 0.
    """
    cut = candidates.where(F.col("rank") < depth).join(flags.select("qid", "filtered"), "qid")
    kept = (cut.where(F.col("filtered") & (F.col("rank") < k))
            .select("qid", "rank", "issue_key", F.col("distance").alias("score"), F.lit("filtered").alias("route")))
    scored = (cut.where(~F.col("filtered")).join(scores, ["qid", "issue_key"], "left")
              .select("qid", "rank", "issue_key", F.coalesce("pair_score", F.lit(0.0)).alias("pair_score")))
    return kept.unionByName(blend(scored, k).withColumn("route", F.lit("rerank")))
