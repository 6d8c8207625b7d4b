"""A corpus pipeline of five stages: toxicity, near-duplicates, benchmark passages, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns documents; all but the last keep the columns they were given.  ``run`` writes
what a stage returns as Parquet in the shared folder and gives the next one what it reads back.

Columns besides doc_id and text may have any name; they are carried along untouched.  Null texts count as empty.  Rows with the
same doc_id and text are repeats, of which the near-duplicate stage keeps one.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, decontaminate, secrets, setjoin, simhash, toxicity
from lodestone.llm.common import table
from lodestone.llm.components import components
from lodestone.session import cut_lineage, scratch


#: Bits in which fingerprints over runs of five words may differ in the near-duplicate stage: 127 tables.  What they link is a
#: candidate only.  Two texts that share 0.8 of their runs differ in about 10 bits on average, for which 64-bit fingerprints would
#: need thousands of tables; the set join of ``lodestone.llm.setjoin`` finds the links that these tables leave out.
NEAR_BITS = 6
#: Words of a run.
NEAR_WORDS = 5


def _apart(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Give all columns but doc_id and text plain names, and a way back, so that no name clashes with an operator's own."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    plain = {c: f"other_{i}" for i, c in enumerate(others)} | {"doc_id": "doc_id", "text": "text"}
    ahead = docs.select(*(F.col(f"`{c}`").alias(plain[c]) for c in docs.columns))
    return ahead, lambda df, *more: df.select(*(F.col(plain[c]).alias(c) for c in docs.columns), *more)


def _named(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of a toxic grade is below the operator's limit."""
    rows, back = _apart(docs)
    model = toxicity.from_labels(rows, table(spark, sf_dir, "labels"))
    return back(toxicity.severity(rows, model, rows.columns).where(F.col("chance") < toxicity.CHANCE))


def _proposed(near: DataFrame) -> DataFrame:
    """Pairs of texts (a_digest, b_digest, a_group, b_group) with fingerprints that are equal or linked; one text of each group."""
    texts = cut_lineage(near.groupBy("group").agg(F.min("digest").alias("digest"), F.min("fp").alias("fp")))
    one = cut_lineage(texts.groupBy("fp").agg(F.min(F.struct("group", "digest")).alias("one")).select("fp", "one.*"))
    a, b = (one.select(*(F.col(c).alias(f"{x}_{c}") for c in ("fp", "digest", "group"))) for x in "ab")
    columns = ["a_digest", "b_digest", "a_group", "b_group"]
    equal = texts.select(F.col("fp").alias("a_fp"), F.col("digest").alias("b_digest"), F.col("group").alias("b_group")).join(a, "a_fp").where("a_group <> b_group")
    links = simhash.near_links(one.select("fp"), NEAR_BITS).toDF("a_fp", "b_fp")
    return cut_lineage(equal.select(columns).union(links.join(a, "a_fp").join(b, "b_fp").select(columns)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest doc_id (nulls last, then by digest).

    Texts of the same words in order are one, by whatever blanks and whichever case of A-Z; any others, short ones among them,
    are linked only if their whole sets of five-word runs have a similarity of 0.8.  Fingerprints propose links, of which the
    similar ones make the first groups; the set join then finds all links that are left between groups.
    """
    rows, back = _apart(docs)
    texts = rows.select("text", F.xxhash64("text").alias("digest"))
    with scratch(spark) as keep:
        near = cut_lineage(simhash.fingerprints(rows, NEAR_WORDS)).withColumnRenamed("same", "group")
        signed = setjoin.signatures(texts, NEAR_WORDS)
        links = setjoin.verified(_proposed(near), texts, NEAR_WORDS, signed)
        first = components(links).withColumnsRenamed({"node": "group", "component": "first"})
        near = cut_lineage(near.join(first, "group", "left").select("doc_id", "digest", F.coalesce("first", "group").alias("group")))
        names = setjoin.join_groups(texts, near, NEAR_WORDS, signed=signed)
        near = near.join(names, "group", "left").withColumn("group", F.coalesce("joined", "group"))
        order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
        kept = keep(near.groupBy("group").agg(F.min(order).alias("k")).select(F.col("k.doc_id").alias("_id"), F.col("k.digest").alias("_digest")))
    marked = rows.withColumns({"_own": F.coalesce("doc_id", F.lit(-1)), "_text": F.xxhash64("text"), "_none": F.col("doc_id").isNull()})
    kept = kept.select(F.coalesce("_id", F.lit(-1)).alias("_own"), F.col("_digest").alias("_text"), F.col("_id").isNull().alias("_none"))
    keys = ["_own", "_text", "_none"]          # made unique and joined by the same columns: texts are shuffled once, a repeated row once a task
    return back(marked.dropDuplicates(keys).join(kept, keys))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    rows, back = _apart(docs)
    others = [c for c in rows.columns if c != "text"]
    return back(decontaminate.contamination(rows, table(spark, sf_dir, "benchmark"), others).where(F.size("spans") == 0))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced; a column n_chars follows the new text."""
    rows, back = _apart(docs)
    out = back(secrets.redact(rows, secrets.trained(rows)), "_spans")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("_spans") > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*_named(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their token ids (little-endian unsigned 32-bit), the number of tokens, and whether decoding gives the text."""
    rows, back = _apart(docs)
    coded = bpe.there_and_back(rows, bpe.vocabulary_path())
    ids = F.col("coded.ids")
    return back(coded, ids.alias("ids"), (F.octet_length(ids) / 4).cast("long").alias("n_tokens"),
                (F.col("coded.text") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark),
    ("secret_scan", redact_secrets),
    ("bpe_encoding", encode),
]

#: No stage but the third can be put in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
