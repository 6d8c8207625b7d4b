from datetime import datetime

from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import keyword as kw
from lodestone.operators.index import build_index, keyword_hits
from lodestone.plans import content

ISSUE = "issue_key string, issue_id long, summary string, description string, priority string, issue_type string, resolution string, created timestamp"
DAY = datetime(2024, 1, 1)
ROWS = [("K-1", 1, "Upgrade ZooKeeper", "the zookeeper client, zookeeper again", "Major", "Bug", None, DAY),
        ("K-2", 2, "Shuffle spill", None, "Minor", "Bug", None, DAY),
        ("K-3", 3, None, "zookeeper", "Major", "Bug", None, DAY),
        ("K-4", 4, "Zookeeper", "", "Minor", "Bug", None, DAY)]
FORM = "priority array<string>, issue_type array<string>, open boolean, resolution array<string>, created_from string, created_to string"


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("v")).first().v


def test_content_and_truncation(spark):
    issues = spark.createDataFrame(ROWS, ISSUE)
    got = {r.issue_key: r.content for r in content.contents(issues, "summary_desc").collect()}
    assert got == {"K-1": "Upgrade ZooKeeper\n\nthe zookeeper client, zookeeper again", "K-2": "Shuffle spill",
                   "K-3": "\n\nzookeeper", "K-4": "Zookeeper\n\n"}
    long = spark.createDataFrame([("L", 1, "é" * 9000, None, None, None, None, DAY)], ISSUE)
    row = content.contents(long, "summary_only", 8000).first()
    assert (len(row.content), row.token_count) == (8000, 9000)
    assert len(content.contents(long, "summary_only").first().content) == 9000
    assert content.content_report(content.all_contents(long, 8000)).where("strategy = 'summary_only'").first().truncated == 1
    both = content.all_contents(issues)
    assert both.count() == 8 and content.content_report(both).where("strategy = 'summary_only'").first().truncated == 0


def test_excerpt_and_citations(spark):
    body = "x" * 300 + "K-9" + "y" * 300
    assert one(spark, text.excerpt(F.col("a"), F.col("b")), a=body, b="K-9") == body[200:450]
    assert one(spark, text.excerpt(F.col("a"), F.col("b")), a="ab K-9", b="K-9") == "ab K-9"
    assert one(spark, text.cited_keys(F.col("a")), a="[SPARK-2] and [SPARK-10], SPARK-2 again") == ["SPARK-2", "SPARK-10"]


def test_kept_of_total(spark):
    kept, total = text.kept_of_total(F.col("a"))
    for value, want in [("3/5", (3, 5)), ("-", (None, None)), ("a/b", (None, None)), (None, (None, None))]:
        row = spark.createDataFrame([(value,)], "a string").select(kept.alias("k"), total.alias("t")).first()
        assert (row.k, row.t) == want


def test_postings_and_frequency(spark):
    issues = spark.createDataFrame(ROWS, ISSUE)
    got = {(r.lexeme, r.issue_key): (r.n_a, r.n_b) for r in kw.postings(issues).collect()}
    assert got[("zookeeper", "K-1")] == (1, 2) and got[("zookeeper", "K-4")] == (1, 0)
    assert ("the", "K-1") not in got and not any(k == "K-3" for _, k in got)
    df = {r.word: r.ndoc for r in kw.lexeme_df(issues).collect()}
    assert df["zookeeper"] == 2 and df["spill"] == 1 and "the" not in df
    wanted = spark.createDataFrame([("zookeeper",), ("missing",)], "word string")
    assert {r.word: r.ndoc for r in kw.lexeme_df(issues, wanted).collect()} == {"zookeeper": 2}


def test_rare_lexemes_keep_unseen_words(spark):
    issues = spark.createDataFrame(ROWS, ISSUE)
    asked = spark.createDataFrame([(1, "Which ZooKeeper spill is unheard of?")], "qid int, question string")
    rare = kw.rare_lexemes(asked, kw.lexeme_df(issues), issues, 0.3)
    assert {(r.lexeme, r.ndoc) for r in rare.collect()} == {("spill", 1), ("unheard", 0)}


def test_keyword_hits_filter_rank_and_tie_break(spark):
    issues = spark.createDataFrame([*ROWS, ("K-5", 5, "zookeeper", None, "Minor", "Bug", None, DAY)], ISSUE)
    asked = spark.createDataFrame(
        [(1, "zookeeper", None, None, None, None, None, None), (2, "zookeeper", ["Minor"], None, None, None, None, None),
         (3, "the", None, None, None, None, None, None)], "qid int, question string, " + FORM)
    hits = keyword_hits(asked, build_index(issues), issues.where("issue_key <> 'K-5'"), n=5, share=2.0)
    assert {(r.qid, r.rank, r.issue_key, r.score) for r in hits.collect()} == {
        (1, 0, "K-1", 1.8), (1, 1, "K-4", 1.0), (2, 0, "K-4", 1.0)}
    stored = kw.score_postings(kw.question_lexemes(asked), kw.postings(issues))
    assert {(r.qid, r.issue_key): r.score for r in stored.collect()}[(1, "K-1")] == 1.8


def test_backlog(spark):
    issues = spark.createDataFrame(ROWS, ISSUE)
    chunks = spark.createDataFrame([("K-2", "summary_desc"), ("K-1", "summary_only")], "issue_key string, strategy string")
    assert [r.issue_key for r in content.backlog(issues, chunks, "summary_desc", 2).collect()] == ["K-1", "K-3"]
    assert content.backlog(issues, chunks, "summary_desc").count() == 3


def test_hashing_embedder_is_unit_length_and_repeatable(spark):
    issues = spark.createDataFrame(ROWS, ISSUE)
    made = content.embed(content.contents(issues, "summary_only"), lambda: content.HashingEmbedder(16))
    a = {r.issue_key: r.embedding for r in made.collect()}
    assert a == {r.issue_key: r.embedding for r in made.repartition(3).collect()}
    assert abs(sum(x * x for x in a["K-1"]) - 1) < 1e-6 and a["K-3"] == [0.0] * 16
