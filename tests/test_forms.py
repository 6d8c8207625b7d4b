from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.operators import forms as fm

GUARD = [
    ("Which blocker sub-tasks are open?", '{"issue_type":["Sub-task","Task"]}', None, ["Sub-task"]),
    ("Which critical-priority planning efforts for Spark Connect are still open?", '{"issue_type":["Task"]}', None, None),
    ("Which critical bugs filed in 2026 are still open?", '{"priority":["Critical"],"issue_type":["Bug"]}', ["Critical"], ["Bug"]),
    ("Were any ZooKeeper upgrades proposed but then rejected or postponed?", '{"issue_type":["Improvement"]}', None, None),
    ("Which tasks and subtasks are major?", '{"priority":"Major","issue_type":["Task"]}', ["Major"], ["Task"]),
]


def normalize(spark, rows):
    frame = spark.createDataFrame([(i, q, r) for i, (q, r) in enumerate(rows)], "qid int, question string, response string")
    return {r.qid: r for r in fm.normalize_forms(frame).collect()}


def test_guard_keeps_only_named_values(spark):
    out = normalize(spark, [(q, r) for q, r, _, _ in GUARD])
    for i, (_, _, priority, issue_type) in enumerate(GUARD):
        assert (out[i].priority, out[i].issue_type) == (priority, issue_type), i


def test_response_shapes(spark):
    q = "major bugs"
    out = normalize(spark, [
        (q, '```json\n{"priority":"Major","resolution":["Fixed","No"],"open":false,"text_terms":"s3"}\n```'),
        (q, '```{"priority":["Major"]}```'),
        (q, '  {"priority":[],"text_terms":[],"created_from":"2024-01-01","created_to":""}  '),
        (q, "not json"), (q, "[1,2]"), (q, '{"priority":5}'), (q, '{"priority":0,"open":"true"}'),
        (q, '{"priority":{"Major":1},"text_terms":7}'), (q, None)])
    assert (out[0].priority, out[0].resolution, out[0].open, out[0].text_terms) == (["Major"], ["Fixed"], False, ["s3"])
    assert out[0].dropped_values == ["No"]
    assert out[1].priority == ["Major"] and not out[1].parse_error
    assert (out[2].priority, out[2].text_terms, out[2].created_from, out[2].created_to) == (None, [], "2024-01-01", None)
    for bad in (3, 4, 5, 8):
        assert out[bad].parse_error and out[bad].priority is None and out[bad].text_terms == []
    assert not out[6].parse_error and out[6].open is None
    assert not out[7].parse_error and out[7].priority is None and out[7].text_terms == []


ISSUES = [(f"K-{i}", p, t, r, datetime(2020 + i % 4, 1 + i % 12, 1 + i % 28))
          for i, (p, t, r) in enumerate((p, t, r) for p in ["Major", "Minor", None] for t in ["Bug", "Task", None]
                                        for r in ["Fixed", "Later", None])]
FORMS = [
    (0, None, None, None, None, None, None), (1, ["Major"], None, None, None, None, None),
    (2, ["Major", "Minor"], ["Bug"], None, None, None, None), (3, None, None, True, None, None, None),
    (4, None, None, False, None, None, None), (5, None, None, None, ["Fixed", "Later"], None, None),
    (6, None, None, True, ["Fixed"], None, None), (7, None, None, False, ["Later"], None, None),
    (8, None, None, None, None, "2021-01-01", None), (9, None, ["Task"], None, None, "2021-02-03", "2023-01-01"),
    (10, ["Minor", "Major"], ["Bug"], None, None, None, None),
]


@pytest.fixture()
def issues(spark):
    return spark.createDataFrame(ISSUES, "issue_key string, priority string, issue_type string, resolution string, created timestamp")


@pytest.fixture()
def forms(spark):
    return spark.createDataFrame(FORMS, "qid int, priority array<string>, issue_type array<string>, open boolean, "
                                        "resolution array<string>, created_from string, created_to string")


def accepts(form, issue):
    _, priority, types, is_open, resolution, start, end = form
    _, p, t, r, created = issue
    return ((priority is None or p in priority) and (types is None or t in types)
            and (is_open is None or is_open == (r is None)) and (resolution is None or r in resolution)
            and (start is None or created >= datetime.fromisoformat(start)) and (end is None or created < datetime.fromisoformat(end)))


WANT = {(f[0], i[0]) for f in FORMS for i in ISSUES if accepts(f, i)}


def test_match_forms_equals_brute_force(spark, issues, forms):
    asked = fm.with_form_id(forms)
    matched = fm.match_forms(issues, asked).select("issue_key", F.explode("form_ids").alias("form_id"))
    assert {(r.qid, r.issue_key) for r in matched.join(asked, "form_id").collect()} == WANT
    ids = {r.qid: r.form_id for r in asked.collect()}
    assert ids[2] == ids[10] and len(set(ids.values())) == len(FORMS) - 1


def test_condition_equals_brute_force(issues, forms):
    pairs = issues.alias("i").join(forms.alias("f"), fm.form_condition("i.", "f."))
    assert {(r.qid, r.issue_key) for r in pairs.select("f.qid", "i.issue_key").collect()} == WANT


def test_row_counts_keep_zero(issues, forms):
    got = {r.qid: r.filter_row_count for r in fm.filter_row_count(forms, issues).collect()}
    assert got == {f[0]: sum(q == f[0] for q, _ in WANT) for f in FORMS}
    assert got[6] == 0


def test_single_form(issues):
    for form in FORMS:
        fields = dict(zip(["priority", "issue_type", "open", "resolution", "created_from", "created_to"], form[1:]))
        assert {r.issue_key for r in fm.where_form(issues, fields).collect()} == {k for q, k in WANT if q == form[0]}


def test_empty_form_has_no_filter(spark, forms):
    flags = {r.qid: (r.f, r.w) for r in forms.select("qid", fm.has_filter().alias("f"), fm.where_text().alias("w")).collect()}
    assert flags[0] == (False, "") and all(f for q, (f, _) in flags.items() if q)
    assert flags[9][1] == "issue_type IN ('Task') AND created >= '2021-02-03' AND created < '2023-01-01'"
    assert set(schemas.FORM_COLUMNS) >= set(fm.FILTER_COLUMNS)


def test_only_days_and_full_timestamps_are_bounds(spark):
    good = ["2020-01-31", "2020-02-29", "2020-01-31 10:00", "2020-01-31T10:00:00", "2020-01-31T10:00:00.123456", "2020-01-31T10:00:00Z",
            "2020-01-31T10:00:00+02:00"]
    bad = ["2020", "2020-01", "2020-1-5", "2021-02-29", "last year", "", " 2020-01-01", "2020-01-01x", "2020-01-01T25:00:00", "12:00", "20200101"]
    rows = spark.createDataFrame([(b, None) for b in [*good, *bad, None]] + [(None, b) for b in [*good, *bad]],
                                 "created_from string, created_to string")
    flagged = [tuple(r) for r in rows.where(fm.date_error()).collect()]
    assert flagged == [(b, None) for b in bad] + [(None, b) for b in bad]
    issues = spark.createDataFrame(ISSUES, "issue_key string, priority string, issue_type string, resolution string, created timestamp")
    assert fm.where_form(issues, {"created_from": "2020"}).count() == 0


def test_timed_and_unreadable_bounds_agree_on_both_paths(spark):
    """Bounds count to the second, and a bound that is no time fails its own question only."""
    issues = spark.sql("""SELECT * FROM VALUES ('A-1', timestamp'2020-01-01 06:00:00'), ('A-2', timestamp'2020-01-01 18:00:00'), ('A-3', timestamp'2020-01-02 00:00:00')
                          AS t(issue_key, created)""").selectExpr("*", "'Major' AS priority", "'Bug' AS issue_type", "CAST(NULL AS string) AS resolution")
    forms = spark.sql("""SELECT * FROM VALUES (1, '2020-01-01T12:00:00', CAST(NULL AS string)), (2, 'last year', NULL), (3, NULL, '2020-01-01T12:00:00'), (4, NULL, 'soon')
                         AS t(qid, created_from, created_to)""").selectExpr(
        "qid", "CAST(NULL AS array<string>) AS priority", "CAST(NULL AS array<string>) AS issue_type", "CAST(NULL AS array<string>) AS resolution",
        "CAST(NULL AS boolean) AS open", "created_from", "created_to")
    want = {(1, "A-2"), (1, "A-3"), (3, "A-1")}
    joined = forms.alias("f").crossJoin(issues.alias("i")).where(fm.form_condition("i.", "f."))
    assert {(r.qid, r.issue_key) for r in joined.select("qid", "issue_key").collect()} == want
    asked = fm.with_form_id(forms)
    ids = {r.form_id: r.qid for r in asked.collect()}
    assert {(ids[f], r.issue_key) for r in fm.match_forms(issues, asked).collect() for f in r.form_ids} == want
    assert {r.qid: r.filter_row_count for r in fm.filter_row_count(forms, issues).collect()} == {1: 2, 2: 0, 3: 1, 4: 0}
