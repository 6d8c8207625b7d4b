"""Agreement of two score sets over the same pairs."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone import values as V
from lodestone.operators.fusion import rerank_order
from lodestone.plans.evaluate import same_lists

RANGES = 200


def paired_scores(candidates: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """``(qid, rank, issue_key, a, b)`` of all candidates; a missing score counts as 0."""
    keys = ["qid", "issue_key"]
    return (candidates.select("qid", "rank", "issue_key")
            .join(a.select(*keys, F.col("pair_score").alias("a")), keys, "left")
            .join(b.select(*keys, F.col("pair_score").alias("b")), keys, "left")
            .fillna(0.0, ["a", "b"]))


def average_ranks(counts: DataFrame, value: str) -> DataFrame:
    """``(value, avg_rank)`` over the whole column, ties sharing their mean rank.

    ``counts`` has ``value`` and ``n``.  A running total over all rows would need one
    task, so values are split at quantiles: ranges are numbered in parallel and shifted
    by the totals of the (at most ``RANGES``) ranges below.
    """
    per_value = counts.groupBy(value).agg(F.sum("n").alias("n"))
    edges = per_value.select(F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)], 10 * RANGES)).first()[0]
    edges = F.array(*(F.lit(e) for e in sorted(set(edges or []))), F.lit(float("inf")))
    located = per_value.withColumn("_range", F.size(F.filter(edges, lambda e: e < F.col(value))))
    totals = located.groupBy("_range").agg(F.sum("n").alias("_total"))
    # At most RANGES rows: the one place where a window may run in a single task.
    below = totals.select("_range", (F.sum("_total").over(Window.orderBy("_range")) - F.col("_total")).alias("_below"))
    inside = Window.partitionBy("_range").orderBy(value)
    return (located.withColumn("_upto", F.sum("n").over(inside)).join(F.broadcast(below), "_range")
            .select(value, (F.col("_below") + F.col("_upto") - (F.col("n") - 1) / 2).alias("avg_rank")))


def score_agreement(pairs: DataFrame) -> DataFrame:
    """One row: Spearman rho, largest and mean difference, pairs that differ."""
    joint = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    ranked = (joint.join(average_ranks(joint.select("a", "n"), "a").withColumnRenamed("avg_rank", "ra"), "a")
              .join(average_ranks(joint.select("b", "n"), "b").withColumnRenamed("avg_rank", "rb"), "b"))
    # Average ranks always have mean (N + 1) / 2, so one pass over centred ranks is enough.
    total = joint.agg(F.sum("n")).scalar()
    x, y = F.col("ra") - (total + 1) / 2, F.col("rb") - (total + 1) / 2
    n, gap = F.col("n"), F.abs(F.col("a") - F.col("b"))
    return ranked.agg(
        F.sum("n").alias("pairs"),
        F.try_divide(F.sum(n * x * y), F.sqrt(F.sum(n * x * x)) * F.sqrt(F.sum(n * y * y))).alias("spearman"),
        F.max(gap).alias("max_abs_diff"),
        (F.sum(n * gap) / F.sum("n")).alias("mean_abs_diff"),
        F.coalesce(F.sum(F.when(gap > V.SCORE_EPSILON, n)), F.lit(0)).alias("differing"))


def top_agreement(pairs: DataFrame, k: int = V.TOP_K) -> DataFrame:
    """``(questions, exact)``: questions whose first ``k`` by score are the same list under both sets."""
    def by(score: str) -> DataFrame:
        ranked = rerank_order(pairs.select("qid", "rank", "issue_key", F.col(score).alias("pair_score")))
        return ranked.where(F.col("rr_rank") < k).select("qid", F.col("rr_rank").alias("rank"), "issue_key")

    return same_lists(by("a"), by("b"), k).agg(F.count("*").alias("questions"), F.count_if("exact").alias("exact"))


def text_sizes(pairs: DataFrame, *measures) -> DataFrame:
    """Pair count and mean of each measure column over the same pairs."""
    return pairs.agg(F.count("*").alias("pairs"), *(F.avg(m).alias(m) for m in measures))
