from datetime import datetime

from pyspark.sql import functions as F

from lodestone.plans import contexts as cx
from lodestone.plans import grading

ISSUE = ("issue_key string, summary string, status string, resolution string, priority string, issue_type string, "
         "created timestamp, description string")
ROWS = [("SPARK-1", "Bump ZooKeeper", "Resolved", "Fixed", "Major", "Improvement", datetime(2019, 9, 1, 10), "x" * 2000),
        ("SPARK-2", "No description", "Open", None, None, "Bug", None, None),
        ("SPARK-30", "See SPARK-4", "Open", None, None, "Bug", datetime(2020, 1, 1, 0, 0, 0, 500000), "mentions SPARK-55 here")]
HITS = [(1, 0, "SPARK-1"), (1, 1, "SPARK-404"), (1, 2, "SPARK-2"), (2, 0, "SPARK-30")]


def listed(spark):
    hits = spark.createDataFrame(HITS, "qid int, rank int, issue_key string")
    return cx.context_lists(cx.context_rows(hits, spark.createDataFrame(ROWS, ISSUE)))


def test_prompt_text(spark):
    asked = spark.createDataFrame([(1, "Which ZooKeeper bumps fixed CVEs?")], "qid int, question string")
    assert "description=" + "x" * 1501 in cx.prompts(asked, listed(spark)).first().prompt
    row = cx.prompts(asked, listed(spark), 1500).first()
    assert row.prompt == "\n".join([
        "Question: Which ZooKeeper bumps fixed CVEs?", "", "Jira issues:",
        "1. [SPARK-1] issue_key=SPARK-1; summary=Bump ZooKeeper; status=Resolved; resolution=Fixed; priority=Major; "
        "issue_type=Improvement; created=2019-09-01T10:00:00+00:00",
        "description=" + "x" * 1500,
        "2. [SPARK-2] issue_key=SPARK-2; summary=No description; status=Open; issue_type=Bug",
        "", "Answer with citations."])
    assert row.desc_chars_total == 1500


def test_prompt_without_contexts(spark):
    asked = spark.createDataFrame([(9, "Nothing found?")], "qid int, question string")
    row = cx.prompts(asked, listed(spark)).first()
    assert row.prompt == "Question: Nothing found?\n\nJira issues:\n\nAnswer with citations." and row.desc_chars_total == 0


def test_fractional_seconds_are_kept(spark):
    hits = spark.createDataFrame(HITS, "qid int, rank int, issue_key string")
    rows = {r.issue_key: r for r in cx.context_rows(hits, spark.createDataFrame(ROWS, ISSUE)).collect()}
    assert rows["SPARK-30"].created == "2020-01-01T00:00:00.500000+00:00" and rows["SPARK-2"].rank == 3


def test_citation_split(spark):
    answers = spark.createDataFrame([(1, "[SPARK-2], [SPARK-1] and [SPARK-999] SPARK-2", ["SPARK-1", "SPARK-2", "SPARK-3"])],
                                    "qid int, answer string, context_keys array<string>")
    row = cx.citation_split(answers).first()
    assert (row.citations, row.invented_citations) == (["SPARK-2", "SPARK-1"], ["SPARK-999"])


def test_grades(spark):
    answers = spark.createDataFrame(
        [(1, "[SPARK-1] [SPARK-999]", ["SPARK-1", "SPARK-2"], 1.0, 10), (2, "SPARK-5 SPARK-55 SPARK-4", ["SPARK-30"], 3.0, 20),
         (3, "nothing", [], 2.0, 30)],
        "qid int, answer string, context_keys array<string>, seconds double, completion_tokens long")
    gold = spark.createDataFrame([(1, "SPARK-2"), (2, "SPARK-30"), (3, "SPARK-7")], "qid int, issue_key string")
    asked = spark.createDataFrame([(1, "topic"), (2, "topic"), (3, "lookup")], "qid int, type string")
    classes = grading.classify_citations(answers, listed(spark))
    got = {(r.qid, r.key): (r["class"], r.found_in_issue, r.field) for r in classes.collect()}
    assert got == {(1, "SPARK-1"): ("in_context", None, None), (1, "SPARK-999"): ("invented", None, None),
                   (2, "SPARK-5"): ("from_text", "SPARK-30", "description"),
                   (2, "SPARK-55"): ("from_text", "SPARK-30", "description"), (2, "SPARK-4"): ("from_text", "SPARK-30", "summary")}
    whole = grading.classify_citations(answers, listed(spark), whole_key=True)
    assert {r["class"] for r in whole.where("key = 'SPARK-5'").collect()} == {"invented"}
    grades = grading.grade_answers(answers, classes, gold, asked)
    rows = {r.qid: r for r in grades.collect()}
    assert (rows[1].hit, rows[1].gold_in_context, rows[1].cite_ratio, rows[1].invented) == (False, True, 0.5, 1)
    assert (rows[2].from_text, rows[2].cite_ratio, rows[3].no_citation, rows[3].cite_ratio) == (3, 0.0, True, 0.0)
    summary = {r.scope: r for r in grading.grade_summary(grades).collect()}
    assert (summary["overall"].n, summary["overall"].ceiling, summary["overall"].hit_on_ceiling_rate) == (3, 2, 0.0)
    assert summary["lookup"].hit_on_ceiling_rate is None and summary["overall"].avg_seconds == 2.0
    flags = {(r.flag, r.qid) for r in grading.grade_flags(grades).collect()}
    assert flags == {("invented", 1), ("missed_ceiling", 1), ("missed_ceiling", 2), ("from_text", 2), ("no_citation", 3)}
    assert grading.missing_gold(answers, asked.where("qid < 3")).count() == 1
