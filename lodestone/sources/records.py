"""JSON and JSONL scans of evaluation records, and the caches built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone import schemas
from lodestone.sources.sinks import path_exists


def scan_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold questions, one JSON object a line, with ``corrupt``: the line where it cannot be read, else NULL.  Blank lines give no row."""
    schema = T.StructType([*schemas.GOLD.fields, T.StructField("corrupt", T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    return (lines.select(F.from_json("value", schema, {"columnNameOfCorruptRecord": "corrupt"}).alias("g"))
            .select("g.*"))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold questions; a line that cannot be read, or has no id, fails the job that meets it."""
    bad = F.col("corrupt").isNotNull() | F.col("id").isNull()
    told = F.concat(F.lit("gold line cannot be read: "), F.coalesce("corrupt", F.lit("no id")))
    return (scan_gold(spark, path).withColumn("id", F.when(bad, F.raise_error(told).cast("string")).otherwise(F.col("id")))
            .drop("corrupt"))


def gold_keys(gold: DataFrame) -> DataFrame:
    return gold.select(F.col("id").alias("qid"), F.explode("expected").alias("issue_key"))


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    pages = spark.read.schema(schemas.ANSWERS).option("multiLine", True).json(path)
    return pages.select(F.explode("questions").alias("q")).select("q.*").withColumnRenamed("id", "qid")


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """``(qid, issue_key, pair_score)`` from {qid: {scores: {key: score}}} documents."""
    documents = spark.read.text(path, wholetext=True)
    return (documents.select(F.explode(F.from_json("value", schemas.SCORES)).alias("qid", "entry"))
            .select("qid", F.explode("entry.scores").alias("issue_key", "pair_score")))


# --- parse cache ------------------------------------------------------------------

def fingerprint(source: Column, model: Column) -> Column:
    """Validity key of a parser: sha256 over the source's sha256 and the model name."""
    return F.sha2(F.concat_ws("|", F.sha2(source, 256), model), 256)


def write_parse_cache(parses: DataFrame, path: str, key: str, model: str, commit: str) -> None:
    """Store the parses under their fingerprint; those of other fingerprints stay, an earlier run of this one is replaced."""
    (parses.withColumns({"fingerprint": F.lit(key), "model": F.lit(model), "commit": F.lit(commit)})
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fingerprint").parquet(path))


def valid_parses(cache: DataFrame, key: str | Column) -> DataFrame:
    return cache.where(F.col("fingerprint") == key)


def uncached_questions(questions: DataFrame, valid: DataFrame) -> DataFrame:
    """Questions the valid cache does not answer; it may only be used when this is empty."""
    return questions.join(valid.select("question"), "question", "left_anti")


def read_parse_cache(spark: SparkSession, path: str, key: str, questions: DataFrame) -> DataFrame:
    """Forms of ``questions`` from a cache with this fingerprint; refuses a stale or partial cache."""
    valid = valid_parses(spark.read.parquet(path), key)
    if valid.isEmpty():
        raise ValueError(f"no parses with fingerprint {key} in {path}: parse again")
    missing = uncached_questions(questions, valid)
    if not missing.isEmpty():
        raise ValueError(f"{path} lacks parses of asked questions, one of them {missing.select('qid').first()[0]!r}")
    return questions.join(valid.select("question", "form"), "question").select("qid", "form.*")


# --- score cache ------------------------------------------------------------------

def unscored(questions: DataFrame, scores: DataFrame) -> DataFrame:
    """Questions without any stored score: the work left for a resumed run."""
    return questions.join(scores.select("qid").distinct(), "qid", "left_anti")


def append_scores(scores: DataFrame, path: str) -> None:
    """Add the scores of questions that have none in ``path`` yet, so a run that is tried again adds nothing twice."""
    spark = scores.sparkSession
    if path_exists(spark, path):
        scores = unscored(scores, spark.read.schema(scores.schema).parquet(path))
    scores.write.mode("append").parquet(path)
