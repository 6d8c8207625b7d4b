import pytest
from pyspark.sql import functions as F

from lodestone.operators import batching, merge, quality

COLS = "issue_key string, issue_id long, project string, summary string, issue_type string, status string, created string"


def table(spark, rows, extra=""):
    return spark.createDataFrame(rows, COLS + extra)


def test_issue_upsert_column_policy(spark):
    target = table(spark, [("K-1", 1, "P", "old", "Bug", "Open", "2020"), ("K-2", 2, "P", "kept", "Bug", "Open", "2020")])
    source = table(spark, [
        ("K-1", 9, "Q", "mid", "Task", "Open", "2021", 0), ("K-1", 9, "Q", None, "Task", "Done", "2021", 1),
        ("K-3", 3, "P", "first", "Wish", "Open", "2022", 0), ("K-3", 4, "R", "second", "Epic", "Done", "2023", 5)], ", arrival int")
    after = merge.upsert_issues(target, source, ["arrival"])
    assert {tuple(r) for r in after.collect()} == {
        ("K-1", 1, "P", None, "Bug", "Done", "2020"),       # a new NULL overwrites, first-seen columns stay
        ("K-2", 2, "P", "kept", "Bug", "Open", "2020"),
        ("K-3", 3, "P", "second", "Wish", "Done", "2022")}  # new key: first arrival's identity, last arrival's state
    again = merge.upsert_issues(after, source, ["arrival"])
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in after.collect()}


def test_upsert_of_a_hot_key(spark):
    target = table(spark, [("K-1", 1, "P", "s", "Bug", "Open", "2020")])
    source = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "K-1").otherwise(F.concat(F.lit("N-"), F.col("id"))).alias("issue_key"),
        F.col("id").alias("issue_id"), F.lit("P").alias("project"), F.col("id").cast("string").alias("summary"),
        F.lit("Bug").alias("issue_type"), F.lit("Open").alias("status"), F.lit("2021").alias("created"), F.col("id").alias("arrival"))
    after = merge.upsert_issues(target, source, ["arrival"])
    assert after.count() == 3334 and after.where("issue_key = 'K-1'").first().summary == "4998"


def test_chunk_upsert_replaces_everything(spark):
    schema = "issue_key string, strategy string, chunk_index int, content string, token_count int"
    target = spark.createDataFrame([("K-1", "a", 0, "x", 1), ("K-1", "b", 0, "y", 1)], schema)
    source = spark.createDataFrame([("K-1", "a", 0, None, 7, 1)], schema + ", arrival int")
    assert {tuple(r) for r in merge.upsert_chunks(target, source, ["arrival"]).collect()} == {
        ("K-1", "a", 0, None, 7), ("K-1", "b", 0, "y", 1)}


def test_stamp_only_for_touched_rows(spark):
    target = table(spark, [("K-1", 1, "P", "a", "Bug", "Open", "2020"), ("K-2", 2, "P", "b", "Bug", "Open", "2020")]).withColumn(
        "ingested_at", F.lit("2001-01-01").cast("timestamp"))
    source = table(spark, [("K-1", 1, "P", "a", "Bug", "Open", "2020", 0)], ", arrival int")
    years = {r.issue_key: r.ingested_at.year for r in merge.upsert_issues(target, source, ["arrival"]).collect()}
    assert years["K-2"] == 2001 and years["K-1"] > 2001


def test_bucketed_target_is_not_shuffled(spark, tmp_path):
    from lodestone.sources.sinks import save_bucketed
    rows = table(spark, [(f"K-{i}", i, "P", "s", "Bug", "Open", "2020") for i in range(50)])
    spark.sql("DROP TABLE IF EXISTS held")
    save_bucketed(rows, "held", 4, "issue_key")
    try:
        held = spark.table("held")
        for threshold in ["-1"]:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            plan = held.join(held.select("issue_key", F.lit(1).alias("x")), "issue_key")._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE held")


def test_quality(spark):
    rows = table(spark, [("K-1", 1, "P", None, "Bug", "Open", "2020"), ("K-1", 1, "P", "a", "Bug", "Open", "2020")])
    assert [tuple(r) for r in quality.duplicate_keys(rows, "issue_key").collect()] == [("K-1", 2)]
    assert {r.column: r.nulls for r in quality.null_counts(rows, "summary", "status").collect()} == {"summary": 1, "status": 0}
    chunks = spark.createDataFrame([("K-1", [1.0]), ("K-9", [1.0, 2.0]), ("K-9", None)], "issue_key string, embedding array<float>")
    assert quality.orphans(chunks, rows).count() == 2
    assert quality.cascade_delete(chunks, spark.createDataFrame([("K-9",)], "issue_key string")).count() == 1
    assert quality.wrong_dimension(chunks, 1).count() == 1


def filled(sizes, budget):
    """One pass over (size, key)."""
    out, batch, held = {}, -1, 0
    for size, key in sorted((max(s or 1, 1), k) for k, s in sizes.items()):
        if batch < 0 or (held + 1) * size > budget:
            batch, held = batch + 1, 0
        out[key], held = batch, held + 1
    return out


@pytest.mark.parametrize("kind", ["spread", "hot", "equal", "over", "odd"])
@pytest.mark.parametrize("budget", [2000, 7])
def test_token_budget(spark, kind, budget):
    by_kind = {"spread": F.pmod(F.hash("id"), F.lit(2500)),
               "hot": F.when(F.col("id") % 3 == 0, 70).otherwise(F.pmod(F.hash("id"), F.lit(2500))),
               "equal": F.lit(3), "over": F.lit(2001) + F.col("id") % 5,
               "odd": F.when(F.col("id") % 2 == 0, F.lit(None)).otherwise(F.col("id") % 9 - 3)}
    rows = spark.range(3000).repartition(7).select(
        F.concat(F.lit("K-"), F.col("id")).alias("issue_key"), by_kind[kind].cast("int").alias("size"), F.lit("x").alias("part"))
    out = batching.token_budget_batches(rows, "size", "issue_key", budget=budget)
    assert out.columns == ["issue_key", "size", "part", "batch"]
    got = out.collect()
    assert {r.issue_key: r.batch for r in got} == filled({r.issue_key: r["size"] for r in got}, budget) and len(got) == 3000


def test_token_budget_of_nothing(spark):
    assert batching.token_budget_batches(spark.createDataFrame([], "k string, n int"), "n", "k").collect() == []


def test_token_budget_does_not_depend_on_the_partitioning(spark):
    rows = spark.range(2000).select("id", F.pmod(F.hash("id"), F.lit(90)).alias("size"))
    made = []
    for partitions in ("2", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        made.append({tuple(r) for r in batching.token_budget_batches(rows, "size", "id", budget=500).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert made[0] == made[1]
