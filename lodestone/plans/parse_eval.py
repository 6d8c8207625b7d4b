"""How well filter forms select: rows returned, gold kept, difference to a candidate predicate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import forms as fm
from lodestone.operators.fusion import top_rows
from lodestone.plans.contexts import rows_of_keys


def gold_kept(questions: DataFrame, issues: DataFrame, gold: DataFrame) -> DataFrame:
    """``(qid, issue_key, kept)``: is each gold issue among the rows the form selects?"""
    rows = rows_of_keys(issues, gold).select("issue_key", *fm.FACETS, "created").alias("i")
    asked = questions.select("qid", *fm.FILTER_COLUMNS).alias("f")
    pairs = gold.select("qid", "issue_key").alias("g").join(asked, F.col("g.qid") == F.col("f.qid"))
    joined = pairs.join(rows, F.col("g.issue_key") == F.col("i.issue_key"), "left")
    return joined.select("g.qid", "g.issue_key", F.coalesce(
        F.col("i.issue_key").isNotNull() & fm.form_condition("i.", "f."), F.lit(False)).alias("kept"))


def extra_keys(questions: DataFrame, issues: DataFrame, gold: DataFrame, kept: int,
               largest_gold: int | None = None) -> DataFrame:
    """``(qid, rank, issue_key)``: the first ``kept`` selected issues by id that are not gold.

    Looked up once per distinct form: its first ``kept`` + |gold| rows are enough,
    and each task sends no more than that.
    """
    asked = fm.with_form_id(questions)
    if largest_gold is None:
        largest_gold = gold.groupBy("qid").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    matched = (fm.match_forms(issues, asked, "issue_id")
               .select("issue_key", "issue_id", F.explode("form_ids").alias("form_id")))
    first = top_rows(matched, kept + largest_gold, F.col("issue_id"), by=("form_id",))
    others = (asked.select("qid", "form_id").join(first.drop("rank"), "form_id")
              .join(gold, ["qid", "issue_key"], "left_anti"))
    return top_rows(others, kept, F.col("issue_id")).select("qid", "rank", "issue_key")


def candidate_diff(questions: DataFrame, issues: DataFrame, predicates: dict[str, str]) -> DataFrame:
    """``(qid, issue_key, side)``: issues that only the form ("extra") or only the candidate ("missing") selects.

    A question names its candidate predicate in ``candidate``; ``predicates`` maps
    names to SQL over the issue columns.  Issues are scanned once: each row lists the
    predicates and the forms it satisfies, and only those meet the (form, candidate)
    combinations, through an equality key.
    """
    asked = fm.with_form_id(questions.where(F.col("candidate").isin(list(predicates))))
    held = F.array_compact(F.array(*(F.when(F.expr(sql), F.lit(name)) for name, sql in predicates.items())))
    none = F.array().cast("array<bigint>")
    rows = (issues.select("issue_key", held.alias("held"))
            .join(fm.match_forms(issues, asked), "issue_key", "left")
            .withColumn("form_ids", F.coalesce("form_ids", none)))
    satisfied = rows.select("issue_key", "held", "form_ids", F.explode(F.concat(
        F.col("held"), F.col("form_ids").cast("array<string>"))).alias("key"))
    by_candidate = F.struct(F.col("candidate").alias("key"), F.lit("missing").alias("side"))
    by_form = F.struct(F.col("form_id").cast("string").alias("key"), F.lit("extra").alias("side"))
    combinations = (asked.select("form_id", "candidate").distinct()
                    .select("form_id", "candidate", F.inline(F.array(by_candidate, by_form))))
    other = (F.when(F.col("side") == "missing", F.array_contains("form_ids", F.col("form_id")))
             .otherwise(F.array_contains("held", F.col("candidate"))))
    differing = (satisfied.join(combinations, "key").where(~other)
                 .select("issue_key", "form_id", "candidate", "side"))
    return (differing.join(asked.select("qid", "form_id", "candidate"), ["form_id", "candidate"])
            .select("qid", "issue_key", "side"))


def exact_matches(questions: DataFrame, differences: DataFrame) -> DataFrame:
    """``(qid, candidate, missing, extra, exact)`` for every question with a candidate predicate."""
    counted = differences.groupBy("qid").agg(F.count_if(F.col("side") == "missing").alias("missing"),
                                             F.count_if(F.col("side") == "extra").alias("extra"))
    return (questions.where(F.col("candidate").isNotNull()).select("qid", "candidate")
            .join(counted, "qid", "left").fillna(0, ["missing", "extra"])
            .withColumn("exact", (F.col("missing") == 0) & (F.col("extra") == 0)))


def candidate_rows(issues: DataFrame, candidates: dict) -> DataFrame:
    """``(name, candidate_rows)`` of each candidate predicate, all counted in one scan."""
    names = {name: f"c{at}" for at, name in enumerate(candidates)}
    counted = issues.agg(*(F.count_if(F.expr(sql)).alias(names[n]) for n, sql in candidates.items()))
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(c).alias("candidate_rows")) for n, c in names.items())))
    return counted.select(pairs.alias("p")).select("p.*")


def parse_eval(questions: DataFrame, issues: DataFrame, gold: DataFrame) -> DataFrame:
    """Per question: rows returned, gold kept "x/y", extra rows, filter and error flags.

    ``date_error`` marks a form whose created bound is no time; it returns no rows, and the other questions are not affected.
    """
    counts = fm.filter_row_count(questions, issues).withColumnRenamed("filter_row_count", "rows_returned")
    kept = gold_kept(questions, issues, gold).groupBy("qid").agg(
        F.count_if("kept").alias("n_kept"), F.count("*").alias("n_gold"))
    return (questions.select("qid", "type", "parse_error", fm.date_error().alias("date_error"), fm.has_filter().alias("filtered"))
            .join(counts, "qid").join(kept, "qid", "left").fillna(0, ["n_kept", "n_gold"])
            .select("qid", "type", "parse_error", "date_error", "filtered", "rows_returned",
                    F.concat(F.col("n_kept").cast("string"), F.lit("/"), F.col("n_gold").cast("string")).alias("gold_kept"),
                    (F.col("rows_returned") - F.col("n_kept")).alias("extra_count")))


def parse_summary(evaluated: DataFrame) -> DataFrame:
    """Counts of empty forms, questions that lost gold and parse errors, by question type and overall."""
    kept, total = text.kept_of_total(F.col("gold_kept"))
    out = evaluated.groupingSets([[], [F.col("type")]], F.col("type")).agg(
        F.grouping("type").alias("_all"), F.count("*").alias("n"),
        F.count_if(~F.col("filtered")).alias("empty_forms"),
        F.count_if(kept < total).alias("dropped_gold"), F.count_if("parse_error").alias("parse_errors"))
    return out.select(F.when(F.col("_all") == 1, "overall").otherwise(F.col("type")).alias("scope"),
                      "n", "empty_forms", "dropped_gold", "parse_errors")
