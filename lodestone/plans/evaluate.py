"""Ranking quality: per-question metrics, reports, run comparison, sweeps.

Hits are ``(run.., qid, rank, issue_key)`` with rank from 0; gold is ``(qid, issue_key)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone import values as V
from lodestone.operators import fusion
from lodestone.operators.fusion import top_rows


def question_metrics(hits: DataFrame, gold: DataFrame, questions: DataFrame,
                     run: str = "strategy", runs: list | None = None) -> DataFrame:
    """``(run, qid, type, recall_at_5, recall_at_10, mrr, first_rank)``.

    With ``runs`` every question appears in every run, also where it got no hit.
    """
    k = V.TOP_K
    found = (hits.where(F.col("rank") < k).join(gold, ["qid", "issue_key"])
             .groupBy(run, "qid")
             .agg(F.count_if(F.col("rank") < 5).alias("in_5"), F.count("*").alias("in_10"),
                  (F.min("rank") + 1).alias("first_rank")))
    expected = gold.groupBy("qid").agg(F.count("*").alias("n_expected"))
    asked = questions.select("qid", "type").join(expected, "qid", "left")
    if runs is None:
        asked = asked.join(hits.select(run, "qid").distinct(), "qid")
    else:
        asked = asked.withColumn(run, F.explode(F.array(*(F.lit(r) for r in runs))))

    def share(hit: str):
        return F.coalesce(F.try_divide(F.col(hit).cast("double"), F.col("n_expected").cast("double")), F.lit(0.0))

    return (asked.join(found, [run, "qid"], "left")
            .select(run, "qid", "type", share("in_5").alias("recall_at_5"), share("in_10").alias("recall_at_10"),
                    F.coalesce(F.lit(1.0) / F.col("first_rank"), F.lit(0.0)).alias("mrr"), "first_rank"))


MEANS = ["recall_at_5", "recall_at_10", "mrr"]


def metrics_report(metrics: DataFrame, run: str = "strategy") -> DataFrame:
    """Means per run, overall and by question type, from one aggregation."""
    grouped = metrics.groupingSets([[F.col(run)], [F.col(run), F.col("type")]], F.col(run), F.col("type"))
    return (grouped.agg(F.grouping("type").alias("_all"), F.count("*").alias("n"),
                        *(F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in MEANS))
            .select(run, F.when(F.col("_all") == 1, "overall").otherwise(F.col("type")).alias("scope"), "n", *MEANS))


def overall_means(metrics: DataFrame) -> DataFrame:
    """One row of means; an empty input gives zeros."""
    return metrics.agg(F.count("*").alias("n"), *(F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in MEANS))


def compare_questions(base: DataFrame, other: DataFrame) -> DataFrame:
    """Paired rows with ``verdict`` worse / better / equal by MRR, and recall losses."""
    b = base.select("qid", *(F.col(m).alias(f"base_{m}") for m in [*MEANS, "first_rank"]))
    paired = other.join(b, "qid")
    delta = F.col("mrr") - F.col("base_mrr")
    return paired.select(
        "qid", "type", *(f"base_{m}" for m in MEANS), *MEANS, "base_first_rank", "first_rank",
        F.when(delta < -V.MRR_EPSILON, "worse").when(delta > V.MRR_EPSILON, "better").otherwise("equal").alias("verdict"),
        (F.col("recall_at_10") < F.col("base_recall_at_10")).alias("lost_recall"))


def comparison_report(paired: DataFrame) -> DataFrame:
    """Per scope: means of both runs, their deltas, and counts of changed questions."""
    grouped = paired.groupingSets([[], [F.col("type")]], F.col("type"))
    out = grouped.agg(
        F.grouping("type").alias("_all"), F.count("*").alias("n"),
        *(F.avg(f"base_{m}").alias(f"base_{m}") for m in MEANS), *(F.avg(m).alias(m) for m in MEANS),
        F.count_if(F.col("verdict") == "worse").alias("worse"),
        F.count_if(F.col("verdict") == "better").alias("better"),
        F.count_if("lost_recall").alias("lost_recall"))
    return out.select(
        F.when(F.col("_all") == 1, "overall").otherwise(F.col("type")).alias("scope"), "n",
        *(f"base_{m}" for m in MEANS), *MEANS,
        *((F.col(m) - F.col(f"base_{m}")).alias(f"delta_{m}") for m in MEANS), "worse", "better", "lost_recall")


def gold_movement(before: DataFrame, after: DataFrame, gold: DataFrame) -> DataFrame:
    """``(qid, issue_key, rank_before, rank_after, marker)``: ranks from 1, -1 where absent."""
    def ranks(hits: DataFrame, name: str) -> DataFrame:
        return hits.select("qid", "issue_key", (F.col("rank") + 1).alias(name))

    moved = (gold.join(ranks(before, "rank_before"), ["qid", "issue_key"], "left")
             .join(ranks(after, "rank_after"), ["qid", "issue_key"], "left")
             .fillna(-1, ["rank_before", "rank_after"]))
    return moved.withColumn("marker", F.when(F.col("rank_after") > F.col("rank_before"), " ").otherwise("\u2193"))


def result_count_check(hits: DataFrame, filter_counts: DataFrame, k: int = V.TOP_K) -> DataFrame:
    """Every question must return min(k, rows its filter accepts)."""
    got = hits.groupBy("qid").agg(F.count("*").alias("actual"))
    return (filter_counts.join(got, "qid", "left")
            .select("qid", "filter_row_count", F.least(F.lit(k).cast("long"), "filter_row_count").alias("expected"),
                    F.coalesce("actual", F.lit(0)).cast("long").alias("actual"))
            .withColumn("ok", F.col("expected") == F.col("actual")))


def weight_sweep(vec: DataFrame, kw: DataFrame, weights: list[float] = V.WEIGHT_SWEEP, k: int = V.TOP_K) -> DataFrame:
    """``(weight, qid, rank, issue_key, score)``: the two lists meet once, then every weight scores them."""
    both = (fusion.side_by_side(vec, kw)
            .withColumn("weight", F.explode(F.array(*(F.lit(float(w)) for w in weights))))
            .withColumn("score", fusion.reciprocal(F.col("vec_rank"))
                        + F.col("weight") * fusion.reciprocal(F.col("kw_rank"))))
    ranked = top_rows(both, k, F.col("score").desc(), F.col("vec_rank").asc_nulls_last(), F.col("issue_key"),
                      by=("weight", "qid"))
    return ranked.select("weight", "qid", "rank", "issue_key", "score")


def depth_sweep(scored: DataFrame, depths: list[int] = V.OFFLINE_DEPTHS, k: int = V.TOP_K) -> DataFrame:
    """``(depth, qid, rank, issue_key, pair_score)``: candidates cut to each depth, then ordered by score."""
    cut = (scored.withColumn("depth", F.explode(F.array(*(F.lit(d) for d in depths))))
           .where(F.col("rank") < F.col("depth")).withColumnRenamed("rank", "_vec"))
    ranked = top_rows(cut, k, F.col("pair_score").desc(), F.col("_vec"), by=("depth", "qid"))
    return ranked.select("depth", "qid", "rank", "issue_key", "pair_score")


def routed_depth_sweep(candidates: DataFrame, flags: DataFrame, scores: DataFrame,
                       depths: list[int], k: int = V.TOP_K) -> DataFrame:
    """Routed rerank repeated for each depth."""
    runs = [fusion.routed(candidates, flags, scores, d, k).withColumn("depth", F.lit(d)) for d in depths]
    out = runs[0]
    for run in runs[1:]:
        out = out.unionByName(run)
    return out.select("depth", "qid", "rank", "issue_key", "score", "route")


def sweep_report(metrics: DataFrame, run: str, base_metrics: DataFrame) -> DataFrame:
    """Report of a sweep with worse / better counts against a base run."""
    base = base_metrics.select("qid", F.col("mrr").alias("base_mrr"))
    delta = F.col("mrr") - F.col("base_mrr")
    changed = (metrics.join(base, "qid").groupBy(run)
               .agg(F.count_if(delta < -V.MRR_EPSILON).alias("worse"), F.count_if(delta > V.MRR_EPSILON).alias("better")))
    return metrics_report(metrics, run).join(changed, run)


def same_lists(got: DataFrame, want: DataFrame, k: int = V.TOP_K) -> DataFrame:
    """``(qid, exact, same_set)`` over the first ``k`` of both runs; arrays hold at most k keys."""
    def listed(hits: DataFrame, name: str) -> DataFrame:
        pairs = F.array_sort(F.collect_list(F.struct("rank", "issue_key")))
        return (hits.where(F.col("rank") < k).groupBy("qid")
                .agg(F.transform(pairs, lambda p: p.issue_key).alias(name)))

    both = listed(got, "got").join(listed(want, "want"), "qid", "full_outer")
    empty = F.array().cast("array<string>")
    got, want = F.coalesce("got", empty), F.coalesce("want", empty)
    return both.select("qid", (got == want).alias("exact"), (F.array_sort(got) == F.array_sort(want)).alias("same_set"))


def stage_means(timings: DataFrame) -> DataFrame:
    """Average stage seconds; ``sql`` is the vector stage without embedding."""
    return timings.agg(*(F.avg(c).alias(c) for c in ["parse", "embed", "vector", "rerank", "total"]),
                       F.avg(F.col("vector") - F.col("embed")).alias("sql"))
