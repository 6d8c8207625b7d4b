import re

import pytest
from pyspark.sql import functions as F

from lodestone.operators import index as kwx
from lodestone.operators import keyword as kw

ISSUE = ("issue_key string, issue_id int, summary string, description string, priority string, issue_type string, "
         "resolution string, created timestamp")
FORM = ("priority array<string>, issue_type array<string>, open boolean, resolution array<string>, "
        "created_from string, created_to string")
NONE = (None,) * 6


def issue(n, summary, description=None, priority="Major", resolution=None, day="2020-01-01"):
    from datetime import datetime

    return (f"K-{n}", n, summary, description, priority, "Bug", resolution, datetime.fromisoformat(day))


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [issue(1, "Zookeeper fails", "failing again and failed"), issue(2, "the shuffle", "spills", "Minor"),
            issue(3, None, "zookeeper"), issue(4, "zookeepers", None, "Minor", "Fixed", "2021-05-01"),
            issue(5, "zookeeper", None, "Minor"), issue(6, "", "")]
    return spark.createDataFrame(rows, ISSUE)


@pytest.fixture(scope="module")
def index(corpus):
    return kwx.build_index(corpus, buckets=4, spread=2)


def test_postings_are_words_and_forms_share_a_frequency(index):
    rows = {(r.lexeme, r.issue_key): (r.n_a, r.n_b) for r in index.postings.collect()}
    assert rows[("fails", "K-1")] == (1, 0) and rows[("failed", "K-1")] == (0, 1) and rows[("zookeepers", "K-4")] == (1, 0)
    assert {k for _, k in rows} == {"K-1", "K-2", "K-4", "K-5"} and ("the", "K-2") not in rows
    frequency = {r.word: r.ndoc for r in kwx.lexeme_frequency(index).collect()}
    assert frequency["zookeep"] == 3 and frequency["fail"] == 1 and index.issues == 6
    assert {r.form for r in index.forms.where("stem = 'fail'").collect()} == {"fails", "failing", "failed"}


def asked_of(spark, *rows):
    return spark.createDataFrame(list(rows), "qid int, question string, " + FORM)


def test_hits_find_other_forms_filter_rank_and_tie_break(spark, corpus, index):
    asked = asked_of(spark, (1, "zookeeper", *NONE), (2, "Zookeepers?", ["Minor"], *NONE[1:]), (3, "the", *NONE),
                     (4, "failure of a failed shuffle", *NONE), (5, "zookeeper", None, None, False, None, "2021-01-01", None),
                     (6, "zookeeper", None, None, None, None, "last year", None), (7, "unheard", *NONE))
    hits = kwx.keyword_hits(asked, index, corpus.where("issue_key <> 'K-5'"), n=5, share=2.0).collect()
    assert {(r.qid, r.rank, r.issue_key, round(r.score, 6)) for r in hits} == {
        (1, 0, "K-1", 1.0), (1, 1, "K-4", 1.0), (2, 0, "K-4", 1.0), (4, 0, "K-1", 1.8), (4, 1, "K-2", 1.0), (5, 0, "K-4", 1.0)}


def test_frequent_stems_are_not_asked(spark, index):
    lexemes = kwx.question_stems(spark.createDataFrame([(1, "zookeepers spilling nowhere")], "qid int, question string"))
    assert [(r.lexeme, r.form, r.ndoc) for r in kwx.rare_forms(index, lexemes, 0.5).collect()] == [("spill", "spills", 1)]


def test_search_reads_only_buckets_of_asked_stems(spark, corpus, index):
    asked = asked_of(spark, (1, "zookeeper", *NONE))
    plan = kwx.keyword_hits(asked, index, corpus.select("issue_key"), share=2.0)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "n_a" in line and "FileScan parquet" in line)
    assert re.search(r"PartitionFilters: \[.*bucket", scan) and "regexp_extract_all" not in plan   # no words are cut


def test_stored_index_opens_again_and_is_not_overwritten(spark, corpus, tmp_path):
    path = str(tmp_path / "index")
    kwx.build_index(corpus, path, buckets=3)
    again = kwx.open_index(spark, path)
    assert (again.issues, again.buckets) == (6, 3) and again.postings.where("lexeme = 'shuffle'").count() == 1
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        kwx.build_index(corpus, path)


def test_no_issue_and_no_question(spark, corpus, index):
    empty = kwx.build_index(corpus.where("false"))
    asked = asked_of(spark, (1, "zookeeper", *NONE))
    assert empty.postings.count() == 0 and kwx.keyword_hits(asked, empty, corpus).count() == 0
    assert kwx.keyword_hits(asked.where("false"), index, corpus).count() == 0


def test_a_stem_of_every_issue_is_counted_whole_however_it_is_dealt(spark):
    rows = spark.range(400).selectExpr(
        "concat('K-', id) AS issue_key", "int(id) AS issue_id", "'running' AS summary", "concat('runs word', id) AS description",
        "'Major' AS priority", "'Bug' AS issue_type", "string(NULL) AS resolution", "timestamp '2020-01-01' AS created")
    made = [kwx.build_index(rows, buckets=2, spread=spread) for spread in (1, 7)]
    a, b = ({tuple(r) for r in x.postings.drop("bucket").collect()} for x in made)
    assert a == b and len(a) == 1200
    assert {r.word: r.ndoc for r in kwx.lexeme_frequency(made[1]).collect()}["run"] == 400


def test_unstemmed_scores_stay(spark, corpus):
    asked = spark.createDataFrame([(1, "zookeeper fails")], "qid int, question string")
    scores = kw.score_postings(kw.question_lexemes(asked), kw.postings(corpus))
    assert {r.issue_key: r.score for r in scores.collect()} == {"K-1": 2.0, "K-5": 1.0}


def test_parts_of_a_bucket_grow_in_number_with_the_text(spark, corpus, tmp_path, monkeypatch):
    monkeypatch.setattr(kwx, "PART_BYTES", 2)
    many = corpus.selectExpr("issue_key", "summary", "description", "priority", "issue_type", "resolution", "created",
                             "explode(sequence(1, 20)) AS n").withColumn("issue_key", F.concat("issue_key", F.lit("."), "n"))
    made = kwx.build_index(many, str(tmp_path / "index"), buckets=2)
    assert len(list((tmp_path / "index/postings/bucket=0").glob("*.parquet"))) > 4
    for file in (tmp_path / "index/postings").glob("*/*.parquet"):
        words = [r.lexeme for r in spark.read.parquet(str(file)).collect()]
        assert words == sorted(words)
    assert made.postings.where("lexeme = 'zookeeper'").count() == 40 and made.issues == 120


def test_words_are_counted_without_a_shuffle(corpus):
    plan = kw.postings(corpus)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan


def test_rows_of_one_key_add_up_and_both_fields_make_one_row(spark, corpus):
    twice = corpus.union(corpus.where("issue_key = 'K-1'")).union(
        spark.createDataFrame([issue(7, "spill Spill, the x", "spill 1x x spillx")], ISSUE))
    found = kw.postings(twice).collect()
    rows = {(r.lexeme, r.issue_key): (r.n_a, r.n_b) for r in found}
    assert len(rows) == len(found) and rows[("fails", "K-1")] == (2, 0) and rows[("failing", "K-1")] == (0, 2)
    assert {w: n for (w, k), n in rows.items() if k == "K-7"} == {"spill": (2, 1), "x": (1, 1), "1x": (0, 1), "spillx": (0, 1)}


def test_stemmed_scores_look_up_forms_of_rare_stems(spark, corpus):
    asked = spark.createDataFrame([(1, "zookeeper fail"), (2, "nowhere")], "qid int, question string")
    scores = lambda share: {(r.qid, r.issue_key): round(r.score, 6)
                            for r in kw.stemmed_scores(asked, corpus, kw.postings(corpus), share).collect()}
    assert scores(2.0) == {(1, "K-1"): 2.8, (1, "K-4"): 1.0, (1, "K-5"): 1.0}
    assert scores(0.4) == {(1, "K-1"): 1.8}     # "zookeep" has three issues of six, its forms have two at most
