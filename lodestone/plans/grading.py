"""Grading of cited answers against gold keys and the contexts they were given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text


def _mentions(key: Column, whole_key: bool):
    """Does a text mention ``key``?  By default any substring counts, so K-1 is found in K-12."""
    if whole_key:
        return lambda body: F.rlike(body, F.concat(F.lit(r"\b\Q"), key, F.lit(r"\E\b")))
    return lambda body: F.contains(body, key)


def classify_citations(answers: DataFrame, contexts: DataFrame, project: str = "SPARK",
                       whole_key: bool = False) -> DataFrame:
    """``(qid, pos, key, class, found_in_issue, field, excerpt)``, one row per cited key.

    ``answers(qid, answer, context_keys)``; ``contexts(qid, contexts)`` holds at most k
    contexts per question, searched in rank order and summary before description
    inside the row, so no cited x context pairs are made.
    """
    cited = (answers.select("qid", "context_keys", F.posexplode(text.cited_keys(F.col("answer"), project)).alias("pos", "key"))
             .join(contexts.select("qid", "contexts"), "qid", "left"))
    key = F.col("key")
    mentions = _mentions(key, whole_key)
    places = F.flatten(F.transform("contexts", lambda c: F.array(
        F.struct(c["issue_key"].alias("issue_key"), F.lit("summary").alias("field"), c["summary"].alias("body")),
        F.struct(c["issue_key"].alias("issue_key"), F.lit("description").alias("field"), c["description"].alias("body")))))
    found = F.get(F.filter(places, lambda p: F.coalesce(mentions(p["body"]), F.lit(False))), F.lit(0))
    in_context = F.array_contains("context_keys", key)
    placed = cited.withColumn("_in", in_context).withColumn("_at", F.when(~in_context, found))
    return placed.select(
        "qid", "pos", "key",
        F.when(F.col("_in"), "in_context").when(F.col("_at").isNotNull(), "from_text").otherwise("invented").alias("class"),
        F.col("_at.issue_key").alias("found_in_issue"), F.col("_at.field").alias("field"),
        text.excerpt(F.col("_at.body"), key).alias("excerpt"))


def missing_gold(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Answers without a gold question; grading requires this to be empty."""
    return answers.join(questions.select("qid"), "qid", "left_anti")


def grade_answers(answers: DataFrame, classes: DataFrame, gold: DataFrame, questions: DataFrame) -> DataFrame:
    """One row per answer: hit, gold_in_context, counts per class, cite_ratio, no_citation."""
    cited = (classes.join(gold.withColumnRenamed("issue_key", "key").withColumn("_gold", F.lit(True)), ["qid", "key"], "left")
             .groupBy("qid")
             .agg(F.count_if("_gold").alias("gold_cited"), F.count("*").alias("n_cited"),
                  *(F.count_if(F.col("class") == c).alias(c) for c in ["in_context", "from_text", "invented"])))
    context = F.explode(F.array_distinct("context_keys"))
    held = (answers.select("qid", context.alias("issue_key")).join(gold, ["qid", "issue_key"])
            .select("qid").distinct().withColumn("_held", F.lit(True)))
    size = F.size(F.array_distinct("context_keys"))
    ratio = F.coalesce(F.try_divide(F.col("in_context").cast("double"), size.cast("double")), F.lit(0.0))
    graded = (answers.join(questions.select("qid", "type"), "qid").join(cited, "qid", "left").join(held, "qid", "left")
              .fillna(0, ["gold_cited", "n_cited", "in_context", "from_text", "invented"]))
    return graded.select(
        "qid", "type", (F.col("gold_cited") > 0).alias("hit"), F.col("_held").isNotNull().alias("gold_in_context"),
        "n_cited", "in_context", "from_text", "invented",
        F.round(ratio, 3).alias("cite_ratio"), (F.col("n_cited") == 0).alias("no_citation"),
        "seconds", "completion_tokens")


def grade_summary(grades: DataFrame) -> DataFrame:
    """Rates and totals, overall and by question type, from one aggregation."""
    hit, held = F.col("hit"), F.col("gold_in_context")
    out = grades.groupingSets([[], [F.col("type")]], F.col("type")).agg(
        F.grouping("type").alias("_all"), F.count("*").alias("n"), F.count_if(hit).alias("hit"),
        F.count_if(held).alias("ceiling"), F.count_if(hit & held).alias("hit_on_ceiling"),
        F.sum("invented").alias("invented_total"), F.sum("from_text").alias("from_text_total"),
        F.count_if("no_citation").alias("no_citation"), F.round(F.avg("cite_ratio"), 3).alias("avg_cite_ratio"),
        F.count_if(F.col("cite_ratio") == 1.0).alias("cited_all"),
        F.round(F.avg("seconds"), 2).alias("avg_seconds"),
        F.round(F.avg("completion_tokens"), 1).alias("avg_completion_tokens"))
    return out.select(
        F.when(F.col("_all") == 1, "overall").otherwise(F.col("type")).alias("scope"), "n", "hit",
        F.round(F.try_divide(F.col("hit").cast("double"), F.col("n").cast("double")), 3).alias("hit_rate"),
        "ceiling", "hit_on_ceiling",
        F.round(F.try_divide(F.col("hit_on_ceiling").cast("double"), F.col("ceiling").cast("double")), 3).alias("hit_on_ceiling_rate"),
        "invented_total", "from_text_total", "no_citation", "avg_cite_ratio", "cited_all",
        "avg_seconds", "avg_completion_tokens")


def grade_flags(grades: DataFrame) -> DataFrame:
    """``(flag, qid, type)``: the questions behind the summary's counts.

    A long table instead of id arrays in one row, so it grows with the questions.
    """
    flags = {
        "no_citation": F.col("no_citation"),
        "cited_all_contexts": F.col("cite_ratio") == 1.0,
        "invented": F.col("invented") > 0,
        "from_text": F.col("from_text") > 0,
        "missed_ceiling": F.col("gold_in_context") & ~F.col("hit"),
    }
    raised = F.array_compact(F.array(*(F.when(cond, F.lit(name)) for name, cond in flags.items())))
    return grades.select(F.explode(raised).alias("flag"), "qid", "type")
