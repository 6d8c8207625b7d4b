import pytest
from pyspark.sql import functions as F

from lodestone.operators import fusion
from lodestone.plans import agreement, evaluate, search

VEC = [(1, i, f"V-{i}", 0.1 * i) for i in range(12)]
KW = [(1, 0, "V-11", 3.0), (1, 1, "W-1", 2.0), (1, 2, "V-2", 1.0), (2, 0, "W-9", 1.0)]


@pytest.fixture()
def vec(spark):
    return spark.createDataFrame(VEC, "qid int, rank int, issue_key string, distance double")


@pytest.fixture()
def kw(spark):
    return spark.createDataFrame(KW, "qid int, rank int, issue_key string, score double")


def keys(df, qid=1):
    return [r.issue_key for r in df.where(F.col("qid") == qid).orderBy("rank").collect()]


def test_weighted_fusion(vec, kw):
    rows = {r.issue_key: r.score for r in fusion.fuse(vec, kw, None).where("qid = 1").collect()}
    assert rows["V-2"] == pytest.approx(1 / 62 + 0.25 / 62) and rows["W-1"] == pytest.approx(0.25 / 61)
    assert rows["V-11"] == pytest.approx(1 / 71 + 0.25 / 60) and len(rows) == 13


def test_zero_weight_is_the_vector_list(vec, kw):
    assert keys(fusion.fuse(vec, kw, 10, 0.0)) == [f"V-{i}" for i in range(10)]
    assert keys(fusion.fuse(vec, kw, None, 0.0))[-1] == "W-1"


def test_list_fusion_base(vec, kw):
    lists = (vec.select("qid", F.lit("vec").alias("list"), "rank", "issue_key")
             .unionByName(kw.select("qid", F.lit("kw").alias("list"), "rank", "issue_key")))
    same = fusion.fuse_lists(lists, {"vec": 1.0, "kw": 0.25}, 10)
    assert keys(same) == keys(fusion.fuse(vec, kw, 10))
    one = fusion.fuse_lists(lists, {"vec": 1.0}, 1, base=1).where("qid = 1").first()
    assert one.score == pytest.approx(1 / 61)


def test_rescue(vec, kw):
    assert keys(fusion.rescue(vec, kw, 10, 0)) == [f"V-{i}" for i in range(10)]
    assert keys(fusion.rescue(vec, kw, 10, 1)) == [f"V-{i}" for i in range(9)] + ["V-11"]
    assert keys(fusion.rescue(vec, kw, 10, 2)) == [f"V-{i}" for i in range(8)] + ["V-11", "W-1"]
    assert keys(fusion.rescue(vec, kw, 10, 4)) == [f"V-{i}" for i in range(6)] + ["V-11", "W-1", "V-6", "V-7"]
    assert keys(fusion.rescue(vec, kw, 10, 1), qid=2) == ["W-9"]
    filled = fusion.rescue(vec, kw.where("qid = 2"), 10, 1).where("qid = 1 AND rank = 9").first()
    assert (filled.issue_key, filled.score) == ("V-9", None)


def test_routed_blend_uses_ranks_from_one_and_missing_scores(spark, vec):
    flags = spark.createDataFrame([(1, False)], "qid int, filtered boolean")
    scores = spark.createDataFrame([(1, "V-3", 0.9), (1, "V-0", 0.5)], "qid int, issue_key string, pair_score double")
    rows = fusion.routed(vec, flags, scores, depth=5, k=10).orderBy("rank").collect()
    assert [r.issue_key for r in rows] == ["V-0", "V-3", "V-1", "V-2", "V-4"]
    assert rows[0].score == pytest.approx(1 / 61 + 1 / 62) and rows[0].route == "rerank"
    kept = fusion.routed(vec, flags.withColumn("filtered", F.lit(True)), scores, 20, 10).orderBy("rank").collect()
    assert [r.issue_key for r in kept] == [f"V-{i}" for i in range(10)] and kept[3].score == pytest.approx(0.3)


def test_pure_rerank_depth(spark, vec):
    scored = vec.withColumn("pair_score", F.col("rank").cast("double"))
    assert keys(fusion.pure_rerank(scored, 5, 3)) == ["V-4", "V-3", "V-2"]
    assert keys(fusion.pure_rerank(scored, 5, 3, cut_first=False)) == ["V-11", "V-10", "V-9"]


def test_metrics(spark, vec):
    gold = spark.createDataFrame([(1, "V-6"), (1, "X")], "qid int, issue_key string")
    asked = spark.createDataFrame([(1, "topic"), (2, "lookup")], "qid int, type string")
    metrics = evaluate.question_metrics(vec.withColumn("strategy", F.lit("s")), gold, asked, runs=["s"])
    rows = {r.qid: r for r in metrics.collect()}
    assert (rows[1].recall_at_5, rows[1].recall_at_10, rows[1].mrr, rows[1].first_rank) == (0.0, 0.5, pytest.approx(1 / 7), 7)
    assert (rows[2].recall_at_5, rows[2].recall_at_10, rows[2].mrr, rows[2].first_rank) == (0.0, 0.0, 0.0, None)
    report = {r.scope: r for r in evaluate.metrics_report(metrics).collect()}
    assert report["overall"].n == 2 and report["overall"].recall_at_10 == 0.25 and report["topic"].recall_at_10 == 0.5
    empty = evaluate.overall_means(metrics.where("qid > 5")).first()
    assert (empty.n, empty.mrr) == (0, 0.0)


def test_comparison_and_movement(spark):
    cols = "qid int, type string, recall_at_5 double, recall_at_10 double, mrr double, first_rank int"
    a = spark.createDataFrame([(1, "t", 0.0, 1.0, 0.5, 2), (2, "t", 1.0, 1.0, 1.0, 1)], cols)
    b = spark.createDataFrame([(1, "t", 0.0, 0.5, 0.5 + 1e-12, 2), (2, "t", 1.0, 1.0, 0.5, 2)], cols)
    paired = evaluate.compare_questions(a, b)
    assert {(r.qid, r.verdict, r.lost_recall) for r in paired.collect()} == {(1, "equal", True), (2, "worse", False)}
    assert evaluate.comparison_report(paired).where("scope = 'overall'").first().worse == 1
    hits = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "qid int, rank int, issue_key string")
    gold = spark.createDataFrame([(1, "b"), (1, "c")], "qid int, issue_key string")
    moved = evaluate.gold_movement(hits, hits.where("rank = 0"), gold)
    assert {(r.issue_key, r.rank_before, r.rank_after) for r in moved.collect()} == {("b", 2, -1), ("c", -1, -1)}
    same = {r.qid: (r.exact, r.same_set) for r in evaluate.same_lists(hits, hits.withColumn("rank", 1 - F.col("rank"))).collect()}
    assert same == {1: (False, True)}


def test_result_counts_and_stage_means(spark, vec):
    counts = spark.createDataFrame([(1, 50), (2, 0)], "qid int, filter_row_count long")
    check = {r.qid: (r.expected, r.actual, r.ok) for r in evaluate.result_count_check(vec.where("rank < 10"), counts).collect()}
    assert check == {1: (10, 10, True), 2: (0, 0, True)}
    times = spark.createDataFrame([(1.0, 0.2, 0.5, 2.0, 4.0)], "parse double, embed double, vector double, rerank double, total double")
    assert evaluate.stage_means(times).first().sql == pytest.approx(0.3)


def test_average_ranks_and_spearman(spark):
    import pandas as pd
    values = [(i, float((i * 7) % 13), float((i * i) % 11)) for i in range(300)] + [(i, 5.0, 5.0) for i in range(300, 450)]
    pdf = pd.DataFrame(values, columns=["rank", "a", "b"])
    pairs = spark.createDataFrame(pdf).withColumns({"qid": F.lit(1), "issue_key": F.col("rank").cast("string")})
    ranks = agreement.average_ranks(pairs.groupBy("a").agg(F.count("*").alias("n")), "a")
    assert {r.a: r.avg_rank for r in ranks.collect()} == dict(zip(pdf.a, pdf.a.rank()))
    row = agreement.score_agreement(pairs).first()
    assert row.spearman == pytest.approx(pdf.a.rank().corr(pdf.b.rank())) and row.pairs == 450
    assert row.differing == int(((pdf.a - pdf.b).abs() > 1e-6).sum())


def test_request_limits(spark):
    rows = [("", 10), ("abc", None), ("abc", 999), ("x" * 501, 1), ("x" * 500, 50), ("abc", 21), (None, 1)]
    asked = spark.createDataFrame(rows, "question string, k int")
    assert [r.valid for r in search.valid_requests(asked).collect()] == [False, True, False, False, True, True, False]
    assert not [r.valid for r in search.valid_requests(asked, 20).collect()][5]
