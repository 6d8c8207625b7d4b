"""A stored keyword index: postings in directories by word bucket, and the frequency and word forms of every stem.

``postings``: bucket, lexeme (a word as written, lower-cased), issue_key, the facets, created, n_a, n_b; sorted by
lexeme inside a bucket's files, so that a reader skips buckets by directory and row groups by their least and greatest lexeme.
``forms``: bucket (of the stem), stem, ndoc (issues that hold any form of it), form, form_bucket.
``size``: one row with the number of issues and of buckets.
Words, not stems, are the keys of the postings: they go from the text to their bucket in one shuffle, and a
question's stems are turned into their forms, which are few, before postings are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import values as V
from lodestone.functions.stem import stem_words
from lodestone.operators.forms import FACETS, FILTER_COLUMNS, form_condition
from lodestone.operators.fusion import top_rows
from lodestone.operators.keyword import posting_rows, question_lexemes, weighted_sum
from lodestone.session import cut_lineage, kept_path, scratch

BUCKETS = 32      # directories of the index; each should come to some hundred megabytes
PART_BYTES = 24 << 20     # text whose postings one task sorts and writes when the index is written (some 2 million)


@dataclass(frozen=True)
class KeywordIndex:
    path: str
    postings: DataFrame
    forms: DataFrame
    issues: int
    buckets: int

    def bucket_of(self, lexeme: Column) -> Column:
        return bucket_of(lexeme, self.buckets)

    def within(self, table: DataFrame, asked: DataFrame) -> DataFrame:
        """Rows of the buckets that ``asked(bucket)`` names; the driver reads at most one number a bucket."""
        named = [r.bucket for r in asked.select("bucket").distinct().collect()]
        return table.where(F.col("bucket").isin(named))


def bucket_of(lexeme: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(lexeme), F.lit(buckets)).cast("int")


@contextmanager
def one_writer(spark: SparkSession) -> Iterator[None]:
    """Tasks of one directory each need no sort by directory before they write; sorts by lexeme compare its first bytes alone."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, "2")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def build_index(issues: DataFrame, path: str | None = None, buckets: int = BUCKETS, spread: int | None = None) -> KeywordIndex:
    """Write the index of ``issues`` to ``path`` (default: a kept table of this session) and open it.

    The words of the text are shuffled once, by bucket and part of a bucket, one task for each part.  A bucket has ``spread``
    parts, by default as many as its text needs at ``PART_BYTES`` a task: tasks grow in number and not in size, and a word of
    every issue is dealt among them all.  All else is made from the written postings.  A target that exists is refused.
    """
    spark = issues.sparkSession
    path = path or kept_path(spark)
    octets = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in ("summary", "description")), F.lit(0))
    size = issues.agg(F.count("*").alias("issues"), F.coalesce(F.sum(octets), F.lit(0)).alias("octets")).first()
    spread = spread or max(1, math.ceil(size.octets / (buckets * PART_BYTES)))
    part = F.pmod(F.xxhash64("issue_key"), F.lit(spread)).cast("int")
    dealt = (posting_rows(issues, *FACETS, "created")
             .withColumn("bucket", bucket_of(F.col("lexeme"), buckets))
             .repartitionById(buckets * spread, F.col("bucket") * spread + part))
    with one_writer(spark):
        (dealt.sortWithinPartitions("lexeme", "issue_key")
         .write.partitionBy("bucket").parquet(f"{path}/postings"))
    with scratch(spark):
        (_forms(_postings(spark, path)).select(
            bucket_of(F.col("stem"), buckets).alias("bucket"), "stem", "ndoc", F.col("word").alias("form"),
            bucket_of(F.col("word"), buckets).alias("form_bucket"))
         .repartitionById(buckets * spread, F.col("bucket") * spread + F.pmod(F.hash("form"), F.lit(spread)).cast("int"))
         .sortWithinPartitions("bucket", "stem")
         .write.partitionBy("bucket").parquet(f"{path}/forms"))
    (spark.range(1).select(F.lit(size.issues).cast("long").alias("issues"), F.lit(buckets).alias("buckets"))
     .write.parquet(f"{path}/size"))
    return open_index(spark, path)


def _forms(postings: DataFrame) -> DataFrame:
    """``(word, stem, ndoc)``.  A stem of one form is found as often as that; only issues of the others are made distinct."""
    words = cut_lineage(postings.groupBy(F.col("lexeme").alias("word")).agg(F.count("*").alias("n")))
    forms = cut_lineage(words.join(stem_words(words.select("word")), "word"))
    several = forms.groupBy("stem").agg(F.count("*").alias("forms")).where("forms > 1").select("stem")
    several = cut_lineage(forms.join(several, "stem", "left_semi").select("word", "stem"))
    held = (postings.select(F.col("lexeme").alias("word"), "issue_key").join(several, "word")
            .select("stem", "issue_key").distinct().groupBy("stem").agg(F.count("*").alias("issues")))
    return forms.join(held, "stem", "left").select("word", "stem", F.coalesce("issues", "n").alias("ndoc"))


def _postings(spark: SparkSession, path: str) -> DataFrame:
    """An index of no issue has no files to read columns from, so they are given."""
    columns = ("lexeme string, issue_key string, priority string, issue_type string, resolution string, "
               "created timestamp, n_a long, n_b long, bucket int")
    return spark.read.schema(columns).parquet(f"{path}/postings")


def open_index(spark: SparkSession, path: str) -> KeywordIndex:
    size = spark.read.parquet(f"{path}/size").first()
    return KeywordIndex(path, _postings(spark, path),
                        spark.read.schema("stem string, ndoc long, form string, form_bucket int, bucket int").parquet(f"{path}/forms"),
                        size.issues, size.buckets)


def lexeme_frequency(index: KeywordIndex) -> DataFrame:
    """``(word, ndoc)`` of all stems."""
    return index.forms.groupBy(F.col("stem").alias("word")).agg(F.max("ndoc").alias("ndoc"))


def rare_forms(index: KeywordIndex, stems: DataFrame, share: float = V.RARE_SHARE) -> DataFrame:
    """``stems(lexeme, ...)`` found in fewer than ``share`` of all issues, with ``form``, ``bucket`` of the form and ``ndoc``.

    A stem that no issue holds matches nothing and is left out.
    """
    asked = stems.withColumn("bucket", index.bucket_of(F.col("lexeme")))
    forms = (index.within(index.forms, asked).where(F.col("ndoc") < F.lit(share) * F.lit(index.issues))
             .withColumnRenamed("stem", "lexeme"))
    return (asked.join(forms, ["bucket", "lexeme"])
            .select(*stems.columns, "form", F.col("form_bucket").alias("bucket"), "ndoc"))


def question_stems(questions: DataFrame, *keep: str) -> DataFrame:
    """``(qid, *keep, lexeme)``: the distinct stems of each question's non-stop words."""
    words = cut_lineage(question_lexemes(questions, *keep))
    stems = stem_words(words.select(F.col("lexeme").alias("word")).distinct())
    return (words.join(stems, F.col("lexeme") == F.col("word"))
            .select("qid", *keep, F.col("stem").alias("lexeme")).dropDuplicates(["qid", "lexeme"]))


def keyword_hits(questions: DataFrame, index: KeywordIndex, chunk_keys: DataFrame,
                 n: int = V.FUSION_DEPTH, share: float = V.RARE_SHARE) -> DataFrame:
    """``(qid, rank, issue_key, score)``: top ``n`` issues per question by the rare stems they share with it; forms of a stem add up.

    ``questions`` carries the form columns; the filter is applied where a posting meets its question, before anything
    is shuffled.  Only issues in ``chunk_keys(issue_key)`` count.  No text is read: only the buckets of the asked stems' forms.
    A question without rare stems gets no rows.
    """
    # Few rows, but they cost a pass over the questions and the frequencies; the kept table tells Spark its bytes.
    wanted = cut_lineage(rare_forms(index, question_stems(questions, *FILTER_COLUMNS), share))
    found = (index.within(index.postings, wanted).alias("i")
             .join(wanted.alias("f"), (F.col("i.bucket") == F.col("f.bucket")) & (F.col("i.lexeme") == F.col("f.form")))
             .where(form_condition("i.", "f."))
             .groupBy("f.qid", "i.issue_key").agg(weighted_sum()))
    found = found.join(chunk_keys.select("issue_key"), "issue_key", "left_semi")
    return top_rows(found, n, F.col("score").desc(), F.col("issue_key"))
