"""Context rows, prompt text and citation splits for ranked hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import values as V
from lodestone.functions import text
from lodestone.session import cut_lineage


def rows_of_keys(issues: DataFrame, keys: DataFrame) -> DataFrame:
    """Issues whose key is listed.  A listed set whose bytes allow it is broadcast by Spark, so issue texts stay in place."""
    return issues.join(keys.select("issue_key").distinct(), "issue_key", "left_semi")


def iso_time(stamp: Column) -> Column:
    whole = F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ssxxx")
    exact = F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    return F.when(F.date_trunc("second", stamp) == stamp, whole).otherwise(exact)


def context_rows(hits: DataFrame, issues: DataFrame, chars: int | None = None) -> DataFrame:
    """``(qid, rank, issue fields, description)``, rank from 1; hits without an issue are skipped."""
    hits = cut_lineage(hits.select("qid", "rank", "issue_key"))
    fields = [F.col(c) for c in V.CONTEXT_FIELDS if c != "created"]
    shown = rows_of_keys(issues, hits).select(
        *fields, iso_time(F.col("created")).alias("created"),
        text.clip(F.col("description"), chars).alias("description"))
    return (hits.withColumn("rank", F.col("rank") + 1).join(shown, "issue_key")
            .select("qid", "rank", *V.CONTEXT_FIELDS, "description"))


def context_lists(rows: DataFrame) -> DataFrame:
    """``(qid, contexts)``: the contexts of each question as one array in rank order (at most k)."""
    item = F.struct("rank", *V.CONTEXT_FIELDS, "description")
    return rows.groupBy("qid").agg(F.array_sort(F.collect_list(item)).alias("contexts"))


def prompts(questions: DataFrame, contexts: DataFrame, chars: int | None = None) -> DataFrame:
    """``(qid, prompt, desc_chars_total)`` from ``contexts(qid, contexts)``."""
    def lines(c: Column, at: Column) -> Column:
        shown = F.concat_ws("; ", *(F.concat(F.lit(f"{n}="), c[n]) for n in V.CONTEXT_FIELDS))
        head = F.concat((at + 1).cast("string"), F.lit(". ["), c["issue_key"], F.lit("] "), shown)
        return F.concat_ws("\n", head, F.concat(F.lit("description="), text.clip(c["description"], chars)))

    listed = F.coalesce("contexts", F.array().cast(contexts.schema["contexts"].dataType))
    total = F.aggregate(listed, F.lit(0), lambda n, c: n + F.coalesce(
        F.char_length(text.clip(c["description"], chars)), F.lit(0)))
    head = F.array(F.concat(F.lit(V.PROMPT_QUESTION), F.col("question")), F.lit(""), F.lit(V.PROMPT_HEADING))
    tail = F.array(F.lit(""), F.lit(V.PROMPT_CLOSING))
    return (questions.select("qid", "question").join(contexts, "qid", "left")
            .select("qid", F.array_join(F.concat(head, F.transform(listed, lines), tail), "\n").alias("prompt"),
                    total.alias("desc_chars_total")))


def citation_split(answers: DataFrame, project: str = "SPARK") -> DataFrame:
    """``(qid, cited_keys, citations, invented_citations)``: cited keys inside and outside the context."""
    cited = text.cited_keys(F.col("answer"), project)
    return answers.select("qid", cited.alias("cited_keys"),
                          F.array_intersect(cited, "context_keys").alias("citations"),
                          F.array_except(cited, F.col("context_keys")).alias("invented_citations"))
