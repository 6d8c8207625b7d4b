"""The tables of the query suite, derived by Spark from the given parquet files."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import values as V
from lodestone.functions import vector
from lodestone.operators import forms as fm
from lodestone.operators.fusion import top_rows
from lodestone.operators.index import KeywordIndex, build_index
from lodestone.plans.contexts import context_lists, context_rows
from lodestone.plans.search import candidate_lists, pair_scores, search, vec_of
from lodestone.session import cut_lineage

SHORT_DIM = 32


def by_value(column: str, mapping: dict[str, str], default: str | None = None):
    expr = F
    for value, name in mapping.items():
        expr = expr.when(F.col(column) == value, F.lit(name))
    return expr.otherwise(F.lit(default))


PRIORITY_OF = {"1-URGENT": "Blocker", "2-HIGH": "Critical", "3-MEDIUM": "Major", "4-NOT SPECIFIED": "Minor"}
TYPE_OF = {"en": "Bug", "fr": "Improvement", "de": "Sub-task", "es": "Question"}
RESOLUTION_OF = {"F": "Fixed", "P": "Won't Fix"}
QUESTION_TYPE_OF = {"F": "lookup", "O": "topic", "P": "filtered"}


class Tables:
    """Lazy frames over one scale directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def issues(self) -> DataFrame:
        """Documents as issues: first line = summary, the rest = description, order = metadata."""
        d, o = self.read("documents"), self.read("orders")
        break_at = F.instr("text", "\n")
        body = F.when(break_at > 0, F.expr("substr(text, instr(text, '\n') + 1)"))
        rejected = F.concat(F.lit("Duplicate of DOC-"), F.col("o_custkey").cast("string"), F.lit("\n"),
                            F.coalesce(body, F.lit("")))
        closed = F.col("o_orderstatus") != "O"
        created = F.col("o_orderdate").cast("timestamp")
        return d.join(o, F.col("o_orderkey") == F.col("doc_id")).select(
            F.concat(F.lit("DOC-"), F.col("doc_id").cast("string")).alias("issue_key"),
            F.col("doc_id").alias("issue_id"),
            F.col("source").alias("project"),
            F.substring_index("text", "\n", 1).alias("summary"),
            F.when(F.col("o_orderstatus") == "P", rejected).otherwise(body).alias("description"),
            by_value("lang", TYPE_OF, "Task").alias("issue_type"),
            by_value("o_orderpriority", PRIORITY_OF, "Trivial").alias("priority"),
            F.col("o_orderstatus").alias("status"),
            by_value("o_orderstatus", RESOLUTION_OF).alias("resolution"),
            created.alias("created"),
            F.when(closed, created + F.expr("INTERVAL 30 DAYS")).alias("updated"),
            F.when(closed, created + F.expr("INTERVAL 30 DAYS")).alias("resolutiondate"))

    @cached_property
    def chunks(self) -> DataFrame:
        """Both strategies: the stored vector, and its first components normalised again."""
        full = (self.read("embeddings").join(self.issues.select("issue_id", "issue_key"),
                                             F.col("vec_id") == F.col("issue_id")))
        def part(strategy: str, embedding) -> DataFrame:
            return full.select("issue_key", F.lit(strategy).alias("strategy"), F.lit(0).alias("chunk_index"),
                               embedding.alias("embedding"), "label")

        # A union of constants, so a strategy filter drops the other branch as partition pruning would.
        return part("summary_desc", F.col("embedding")).unionByName(
            part("summary_only", vector.truncate_and_normalize(F.col("embedding"), SHORT_DIM)))

    @cached_property
    def _asked(self) -> DataFrame:
        b, e, o = self.read("benchmark"), self.read("embeddings"), self.read("orders")
        return (b.join(e, F.col("vec_id") == F.col("item_id"))
                .join(o, F.col("o_orderkey") == F.col("item_id"))
                .withColumn("type", by_value("o_orderstatus", QUESTION_TYPE_OF))
                .withColumn("priority_name", by_value("o_orderpriority", PRIORITY_OF, "Trivial"))
                .withColumn("year", F.year("o_orderdate"))
                .withColumn("question", F.when(
                    F.col("type") == "filtered",
                    F.concat(F.lit("Which "), F.lower("priority_name"), F.lit(" bugs are about: "), F.col("text")))
                    .otherwise(F.col("text"))))

    @cached_property
    def plain_questions(self) -> DataFrame:
        return self._asked.select(F.col("item_id").alias("qid"), "question", F.col("embedding").alias("qvec"), "type")

    @cached_property
    def responses(self) -> DataFrame:
        """Raw parser responses as JSON text: fenced, bare strings, unknown values, invalid, a bound with a time, a bound that is no date."""
        p, y = F.col("priority_name"), F.col("year").cast("string")
        until = (F.col("year") + 2).cast("string")
        empty = ('{"priority":null,"issue_type":null,"open":null,"resolution":null,'
                 '"created_from":null,"created_to":null,"text_terms":[]}')
        filtered = (
            F.when(p == "Blocker", F.lit(
                '```json\n{"priority":["Blocker"],"issue_type":["Bug","Task"],"open":true,"resolution":null,'
                '"created_from":null,"created_to":null,"text_terms":["parser"]}\n```'))
            .when(p == "Critical", F.concat(F.lit(
                '{"priority":"Critical","issue_type":"Improvement","open":null,"resolution":["Fixed","Nonsense"],'
                '"created_from":"'), y, F.lit('-01-01","created_to":"'), until, F.lit('-01-01","text_terms":"scan"}')))
            .when(p == "Major", F.concat(F.lit(
                '```\n{"priority":["Major","Urgent"],"issue_type":[],"open":false,"created_from":"'), y, F.lit('-01-01"}\n```')))
            .when(p == "Minor", F.concat(F.lit(
                '{"issue_type":["Bug"],"priority":["Unknown"],"resolution":["Fixed","Won\'t Fix"],"issuetype":"x","created_to":"'),
                until, F.lit('-01-01T12:00:00"}')))
            .otherwise(F.lit('{"priority":["Trivial","Minor"],"issue_type":null,"open":null,"created_from":"last year","text_terms":[]}')))
        return self._asked.select(
            F.col("item_id").alias("qid"), "question",
            F.when(F.col("type") == "filtered", filtered)
            .when((F.col("type") == "topic") & (p == "Trivial"), F.lit("No filter is stated."))
            .otherwise(F.lit(empty)).alias("response"))

    @cached_property
    def forms(self) -> DataFrame:
        return fm.normalize_forms(self.responses).drop("question", "response", "dropped_values", "dropped_names")

    @cached_property
    def questions(self) -> DataFrame:
        """Questions with vector, type and form columns, stored once as a parse cache is."""
        return cut_lineage(self.plain_questions.join(self.forms, "qid"))

    @cached_property
    def gold(self) -> DataFrame:
        """``(qid, issue_key)``: the question's own issue and, but for lookups, four of its label in md5 order."""
        labelled = self.chunks.where("strategy = 'summary_desc'").select("label", "issue_key")
        order = [F.md5("issue_key"), F.col("issue_key")]
        sample = top_rows(labelled, 5, *order, by=("label",)).select("label", "issue_key")
        own = F.concat(F.lit("DOC-"), F.col("qid").cast("string"))
        asked = self._asked.select(F.col("item_id").alias("qid"), "label", "type")
        others = asked.where("type <> 'lookup'").join(sample, "label").where(F.col("issue_key") != own)
        return (top_rows(others, 4, *order).select("qid", "issue_key")
                .unionByName(asked.select("qid", own.alias("issue_key"))))

    @cached_property
    def types(self) -> DataFrame:
        return self.plain_questions.select("qid", "type")

    @cached_property
    def hits(self) -> DataFrame:
        """Plain vector top 10, the contexts of the answers below."""
        return cut_lineage(search(self.plain_questions, self.chunks, "summary_desc"))

    @cached_property
    def index(self) -> KeywordIndex:
        """Stored keyword index of all issues."""
        return build_index(self.issues)

    @cached_property
    def lists(self) -> DataFrame:
        """Stored candidate lists: small, costly, and read by many evaluation queries."""
        return cut_lineage(candidate_lists(self.questions, self.issues, self.chunks, index=self.index))

    @cached_property
    def scores(self) -> DataFrame:
        """Stored pair scores of all vector candidates, over whole descriptions."""
        return cut_lineage(pair_scores(vec_of(self.lists), self.questions, self.issues))

    @cached_property
    def narrow_scores(self) -> DataFrame:
        """The same with 500 description characters, one side of the score comparison."""
        return cut_lineage(pair_scores(vec_of(self.lists), self.questions, self.issues, V.RERANK_DESC_CHARS))

    @cached_property
    def wide_scores(self) -> DataFrame:
        """The same with 1000 description characters, the other side."""
        return cut_lineage(pair_scores(vec_of(self.lists), self.questions, self.issues, V.OFFLINE_RERANK_DESC_CHARS))

    @cached_property
    def contexts(self) -> DataFrame:
        return cut_lineage(context_lists(context_rows(self.hits, self.issues)))

    @cached_property
    def answers(self) -> DataFrame:
        """Answers citing ranked contexts, a key mentioned inside a context, or a key that does not exist."""
        key = lambda n: F.get(F.col("context_keys"), F.lit(n - 1))
        mention = F.array_compact(F.transform("contexts", lambda c: F.nullif(
            F.regexp_extract(F.coalesce(c["description"], F.lit("")), "Duplicate of (DOC-[0-9]+)", 1), F.lit(""))))
        keyed = (self.contexts.withColumn("context_keys", F.transform("contexts", lambda c: c["issue_key"]))
                 .withColumn("mention", F.coalesce(F.get(mention, F.lit(0)), F.lit("none")))
                 .join(self.plain_questions.select("qid", "question", "type"), "qid"))
        text = (F.when(F.char_length("question") > 250, F.lit("The issues do not answer this."))
                .when(F.col("type") == "lookup", F.concat(F.lit("The fix is in ["), key(1), F.lit("] and ["), key(2), F.lit("].")))
                .when(F.col("type") == "topic", F.concat(F.lit("See ["), key(1), F.lit("], which repeats "), F.col("mention"),
                                                         F.lit("; also [DOC-999999].")))
                .otherwise(F.concat(F.lit("As ["), key(3), F.lit("] says, ["), key(3), F.lit("] supersedes ["), key(2), F.lit("]."))))
        return (keyed.withColumn("answer", text)
                .select("qid", "answer", "context_keys",
                        (F.char_length("question") / F.lit(100.0)).alias("seconds"),
                        F.char_length("answer").alias("completion_tokens")))

    @cached_property
    def page_bodies(self) -> DataFrame:
        """One landed page per issue as JSON text: its first version and, once closed, its closing version.

        Fields come with undeclared and nested ones, explicit nulls, and a bare string where a named object belongs.
        """
        offset = F.when(F.col("issue_type") == "Improvement", "+0200").otherwise("+0000")

        def stamp(c):
            return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS"), offset)

        def named(c):
            return F.when(c.isNotNull(), F.struct(c.alias("name")))

        def version(description, status, resolution, updated):
            return F.struct(
                F.col("issue_key").alias("key"), F.col("issue_id").cast("string").alias("id"),
                F.to_variant_object(F.struct(
                    F.col("summary").alias("summary"), description.alias("description"),
                    named(F.col("issue_type")).alias("issuetype"), named(F.col("priority")).alias("priority"),
                    named(status).alias("status"), resolution.alias("resolution"),
                    stamp(F.col("created")).alias("created"), stamp(updated).alias("updated"),
                    stamp(updated).alias("resolutiondate"), F.array("project", F.lit(None)).alias("labels"),
                    F.struct(F.col("issue_id").alias("count"), F.struct(F.lit(None).cast("string").alias("by")).alias("last"))
                    .alias("votes"))).alias("fields"))

        first = version(F.col("description"), F.lit("O"), F.lit("none"), F.lit(None).cast("timestamp"))
        closing = version(F.when(F.col("priority") != "Trivial", F.col("description")), F.col("status"),
                          named(F.col("resolution")), F.col("updated"))
        versions = F.when(F.col("status") == "O", F.array(first)).otherwise(F.array(first, closing))
        return self.issues.select(F.to_json(F.struct(
            F.col("issue_id").alias("startAt"), F.lit(1).alias("total"), versions.alias("issues"))).alias("body"))

    @cached_property
    def stored_issues(self) -> DataFrame:
        """The issue table as it stood at the start of 1999: everything open, older type names."""
        return self.issues.where(F.col("created") < F.lit("1999-01-01").cast("timestamp")).select(
            "issue_key", "issue_id", F.lit("archive").alias("project"), F.lower("summary").alias("summary"),
            "description", F.lower("issue_type").alias("issue_type"), "priority", F.lit("O").alias("status"),
            F.lit(None).cast("string").alias("resolution"), "created",
            F.lit(None).cast("timestamp").alias("updated"), F.lit(None).cast("timestamp").alias("resolutiondate"),
            F.lit(None).cast("string").alias("raw"))
