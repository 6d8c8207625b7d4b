import json

import pytest
from pyspark.sql import functions as F

from lodestone.sources import pages, records, sinks


def page(start, *issues):
    return {"startAt": start, "total": 9, "issues": list(issues)}


def issue(key, number, **fields):
    return {"key": key, "id": str(number), "fields": {"summary": "s", "created": "2020-05-01T12:00:00.000+0200", **fields}}


def test_pages(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(page(0, issue("AB-1", 1, priority={"name": "Major"}, resolution=None),
                                                     issue("AB-2", 2, status={"name": "Open"}, description="d")), indent=1))
    (tmp_path / "b.json").write_text(json.dumps(page(2)))
    rows = {r.issue_key: r for r in pages.flatten_pages(pages.read_pages(spark, str(tmp_path))).collect()}
    assert set(rows) == {"AB-1", "AB-2"}
    a = rows["AB-1"]
    assert (a.issue_id, a.project, a.priority, a.resolution, a.status, a.date_suspect) == (1, "AB", "Major", None, None, False)
    assert a.created.strftime("%H:%M") == "10:00" and json.loads(a.raw)["priority"] == {"name": "Major"}
    assert (rows["AB-2"].start_at, rows["AB-2"].position, rows["AB-2"].status) == (0, 1, "Open")
    flat = pages.flatten_pages(pages.read_pages(spark, str(tmp_path)), "OTHER")
    assert pages.of_project(flat, "OTHER", 1).first().issue_key == "AB-1"
    assert pages.project_counts(flat).first().n == 2


def test_raw_is_what_was_delivered(spark, tmp_path):
    fields = {"summary": "é \"q\"\n\u0001", "description": None, "issuetype": "Bug", "priority": {"name": None}, "status": ["x"],
              "resolution": 7, "customfield_1": {"b": [1, 2.5, {"c": None}], "a": True}, "created": "2020-05-01T12:00:00.000+0200",
              "labels": [], "empty": {}, "big": 12345678901234567890}
    bare = {"summary": 12, "created": "2020-05-01T12:00:00.000+0200"}
    body = page(0, {"key": "A-1", "id": "1", "fields": fields}, {"key": "A-2", "id": "2", "fields": bare}, {"key": "A-3", "id": "3"})
    (tmp_path / "a.json").write_text(json.dumps(body, indent=1))
    as_text = pages.parse_pages(spark.createDataFrame([(json.dumps(body),), ("{broken",), (None,)], "body string"))
    for made in (pages.read_pages(spark, str(tmp_path)), as_text):
        rows = {r.issue_key: r for r in pages.flatten_pages(made).collect()}
        a = rows["A-1"]
        assert json.loads(a.raw) == fields and list(json.loads(a.raw)) == sorted(fields)
        assert (a.issue_type, a.priority, a.status, a.resolution, a.description) == (None,) * 5
        assert a.summary == fields["summary"] and rows["A-2"].summary == "12"
        assert rows["A-3"].raw is None and len(rows) == 3


def test_gold(spark, tmp_path):
    path = tmp_path / "gold.jsonl"
    path.write_text('{"id":"G1","type":"topic","question":"q","expected":["A-1","A-2"]}\n\n'
                    '{"id":"G2","type":"lookup","question":"r","expected":[],"candidate_sql":"x = 1"}\n')
    gold = records.read_gold(spark, str(path))
    assert gold.count() == 2
    assert {(r.qid, r.issue_key) for r in records.gold_keys(gold).collect()} == {("G1", "A-1"), ("G1", "A-2")}


def test_scores_and_answers(spark, tmp_path):
    (tmp_path / "scores.json").write_text(json.dumps({"G1": {"keys": ["A-1"], "scores": {"A-1": 0.5, "A-2": 0.25}, "seconds": 1.0},
                                                      "G2": {"keys": [], "scores": {}, "seconds": 1.0}}, indent=1))
    scores = records.read_scores(spark, str(tmp_path / "scores.json"))
    assert {(r.qid, r.issue_key, r.pair_score) for r in scores.collect()} == {("G1", "A-1", 0.5), ("G1", "A-2", 0.25)}
    asked = spark.createDataFrame([("G1",), ("G2",)], "qid string")
    assert [r.qid for r in records.unscored(asked, scores).collect()] == ["G2"]
    records.append_scores(scores, str(tmp_path / "cache"))
    records.append_scores(scores.withColumn("qid", F.lit("G2")), str(tmp_path / "cache"))
    assert records.unscored(asked, spark.read.parquet(str(tmp_path / "cache"))).count() == 0
    (tmp_path / "answers.json").write_text(json.dumps({"questions": [{"id": "G1", "answer": "a", "cited_keys": ["A-1"]}]}, indent=1))
    assert records.read_answers(spark, str(tmp_path / "answers.json")).first().cited_keys == ["A-1"]


def test_parse_cache(spark, tmp_path):
    import hashlib
    source, model = "rules v1", "m"
    key = spark.range(1).select(records.fingerprint(F.lit(source), F.lit(model))).first()[0]
    assert key == hashlib.sha256(f"{hashlib.sha256(source.encode()).hexdigest()}|{model}".encode()).hexdigest()
    form = "struct<priority:array<string>,issue_type:array<string>,open:boolean,resolution:array<string>,created_from:string,created_to:string,text_terms:array<string>,parse_error:boolean>"
    parses = spark.createDataFrame([("q1", (["Major"], None, None, None, None, None, [], False))], f"question string, form {form}")
    path = str(tmp_path / "cache")
    records.write_parse_cache(parses, path, key, model, "abc")
    asked = spark.createDataFrame([(1, "q1")], "qid int, question string")
    assert records.read_parse_cache(spark, path, key, asked).first().priority == ["Major"]
    with pytest.raises(ValueError, match="fingerprint"):
        records.read_parse_cache(spark, path, "other", asked)
    with pytest.raises(ValueError, match="lacks"):
        records.read_parse_cache(spark, path, key, asked.union(spark.createDataFrame([(2, "q2")], asked.schema)))


def test_sinks(spark, tmp_path):
    rows = sinks.stamp_run(spark.range(3), run="r1", k=10)
    path = str(tmp_path / "out")
    sinks.write_once(rows, path)
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_once(rows, path)
    assert sinks.write_with_suffix(rows, path) == path + "_2"
    assert sinks.write_with_suffix(rows, path) == path + "_3"
    sinks.rebuild(rows.limit(1), path)
    assert spark.read.parquet(path).count() == 1
    lists = spark.createDataFrame([(1, "vec", 0, "a"), (1, "kw", 0, "b")], "qid int, list string, rank int, issue_key string")
    sinks.write_lists(lists, str(tmp_path / "lists"))
    assert spark.read.parquet(str(tmp_path / "lists")).where("list = 'kw'").first().issue_key == "b"


def test_kept_frames(spark):
    import os
    from lodestone import session
    kept = session.cut_lineage(spark.range(5).withColumn("x", F.rand(1)))
    assert kept.collect() == kept.collect() and kept.schema["id"].dataType.typeName() == "long"
    path = session._kept[-1].removeprefix("file:")
    held, session._kept[:] = session._kept[:-1], session._kept[-1:]
    session.release_kept(spark)
    session._kept[:] = held
    assert not os.path.exists(path)


def test_two_writers_one_wins(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor
    path = str(tmp_path / "out")

    def write(n):
        try:
            sinks.write_once(spark.range(1000).withColumn("writer", F.lit(n)), path)
            return n
        except FileExistsError:
            return None

    with ThreadPoolExecutor(4) as pool:
        winners = [n for n in pool.map(write, range(4)) if n is not None]
    rows = spark.read.parquet(path)
    assert len(winners) == 1 and rows.count() == 1000 and rows.select("writer").distinct().first()[0] == winners[0]
    assert [f.name for f in tmp_path.iterdir() if not f.name.startswith(".")] == ["out"]       # nothing staged, no claim is left


def test_rebuild_may_read_what_it_replaces_and_a_failed_one_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "stats")
    sinks.rebuild(spark.range(10), path)
    sinks.rebuild(spark.read.parquet(path).where("id < 4"), path)
    with pytest.raises(Exception, match="broken"):
        sinks.rebuild(spark.range(3).withColumn("x", F.raise_error(F.lit("broken")).cast("string")), path)
    assert spark.read.parquet(path).count() == 4


def test_corrupt_gold_lines_are_told_and_refused(spark, tmp_path):
    path = tmp_path / "gold.jsonl"
    path.write_text('{"id":"G1","type":"topic","question":"q","expected":["A-1"]}\n   \n{"id":"G2","expec\n{"type":"topic"}\n')
    rows = records.scan_gold(spark, str(path)).collect()
    assert [r.corrupt for r in rows if r.corrupt] == ['{"id":"G2","expec'] and len(rows) == 3
    with pytest.raises(Exception, match="cannot be read"):
        records.read_gold(spark, str(path)).select("id").collect()


def test_caches_keep_other_parsers_and_add_nothing_twice(spark, tmp_path):
    parses = spark.createDataFrame([("q1", (1,))], "question string, form struct<x:int>")
    path, asked = str(tmp_path / "parses"), spark.createDataFrame([(1, "q1")], "qid int, question string")
    for key in ["p1", "p2", "p1"]:
        records.write_parse_cache(parses, path, key, "m", "c")
    assert spark.read.parquet(path).count() == 2 and records.read_parse_cache(spark, path, "p2", asked).first().x == 1
    scores = spark.createDataFrame([(1, "A", 0.5), (1, "B", 0.25), (2, "A", 0.75)], "qid int, issue_key string, pair_score double")
    for part in [scores.where("qid = 1"), scores, scores]:
        records.append_scores(part, str(tmp_path / "scores"))
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "scores")).collect()) == sorted(tuple(r) for r in scores.collect())


def test_hash_embedding_equals_the_plugged_in_model(spark):
    from lodestone.plans import content
    bodies = ["Zoo keeper été 東京 x1", "", "a a a b", None, "z" * 200_000 + " y"]
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, content string")
    made = {r.i: r.embedding for r in content.hash_embed(rows, 16).collect()}
    want = content.HashingEmbedder(16)([b or "" for b in bodies])
    assert all(made[i] == want[i].tolist() for i in made) and made[1] == [0.0] * 16
