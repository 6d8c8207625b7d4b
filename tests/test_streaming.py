import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone import schemas
from lodestone.operators.merge import upsert_issues
from lodestone.plans.content import HashingEmbedder
from lodestone.sources import pages
from lodestone.streaming import ingest
from lodestone.streaming.store import BucketStore, dealt_into


def land(folder, name, start, *rows):
    issues = [{"key": k, "id": k[2:], "fields": {"summary": s, "status": {"name": st}, "created": "2020-05-01T12:00:00.000+0000"}}
              for k, s, st in rows]
    (folder / name).write_text(json.dumps({"startAt": start, "total": 9, "issues": issues}))


def test_incremental_ingest_and_embedding(spark, tmp_path):
    landing, root = tmp_path / "landing", str(tmp_path / "issues")
    landing.mkdir()

    def run():
        ingest.stream_issues(spark, str(landing), root, str(tmp_path / "s1")).awaitTermination()
        ingest.stream_chunks(spark, str(landing), root, str(tmp_path / "chunks"), str(tmp_path / "s2"), "summary_desc",
                             lambda: HashingEmbedder(8)).awaitTermination()
        return (ingest.latest_snapshot(spark, root, schemas.ISSUES),
                ingest.latest_snapshot(spark, str(tmp_path / "chunks"), schemas.CHUNKS))

    land(landing, "p0.json", 0, ("A-1", "one", "Open"), ("A-2", "two", "Open"))
    issues, chunks = run()
    assert {(r.issue_key, r.status) for r in issues.collect()} == {("A-1", "Open"), ("A-2", "Open")}
    first = {r.issue_key: (r.content, r.embedded_at) for r in chunks.collect()}
    assert set(first) == {"A-1", "A-2"}

    land(landing, "p1.json", 2, ("A-2", "two!", "Done"), ("A-3", "three", "Open"), ("A-3", "three!", "Done"))
    issues, chunks = run()
    assert {(r.issue_key, r.summary, r.status) for r in issues.collect()} == {
        ("A-1", "one", "Open"), ("A-2", "two!", "Done"), ("A-3", "three!", "Done")}
    second = {r.issue_key: (r.content, r.embedded_at) for r in chunks.collect()}
    assert set(second) == {"A-1", "A-2", "A-3"}
    assert second["A-2"] == first["A-2"]      # already embedded: skipped, as a resumed run does

    flat = pages.flatten_pages(pages.read_pages(spark, str(landing)))
    batch = upsert_issues(spark.createDataFrame([], schemas.ISSUES), flat, ["start_at", "position"])
    columns = [c for c in issues.columns if c != "ingested_at"]
    assert {tuple(r) for r in issues.select(columns).collect()} == {tuple(r) for r in batch.select(columns).collect()}


def test_snapshots_are_numbered_by_the_store(spark, tmp_path):
    landing, root = tmp_path / "landing", str(tmp_path / "issues")
    landing.mkdir()
    store = ingest.issue_store(spark, root)

    def run(state, **options):
        ingest.stream_issues(spark, str(landing), root, str(tmp_path / state), **options).awaitTermination()
        return {(r.issue_key, r.status) for r in store.read().collect()}

    for at in range(3):
        land(landing, f"p{at}.json", at, (f"A-{at}", "one", "Open"), (f"B-{at}", "two", "Open"))
    assert len(run("s1", max_files=1)) == 6
    assert store.numbers() == [0, 1, 2]

    # the same batch once more: nothing is made
    (stream, batch), = store.snapshot().applied.items()
    assert not store.merge(store.read(), lambda before, buckets: 1 / 0, stream, batch)

    # a new checkpoint starts at batch 0, but its rows come last
    land(landing, "p9.json", 9, ("A-0", "one", "Done"))
    assert ("A-0", "Done") in run("s2") and store.numbers()[-1] == 3


def test_an_issue_merged_after_its_batch_is_still_embedded(spark, tmp_path):
    changes, landing = tmp_path / "changes", tmp_path / "landing"
    changes.mkdir(), landing.mkdir()
    root = str(tmp_path / "issues")

    def merge():
        ingest.stream_issues(spark, str(landing), root, str(tmp_path / "s1")).awaitTermination()

    def run():
        ingest.stream_chunks(spark, str(changes), root, str(tmp_path / "chunks"), str(tmp_path / "s2"), "summary_desc",
                             lambda: HashingEmbedder(8)).awaitTermination()
        return {r.issue_key for r in ingest.chunk_store(spark, str(tmp_path / "chunks")).read().collect()}

    land(changes, "c0.json", 0, ("A-1", "one", "Open"), ("A-2", "two", "Open"))
    assert run() == set()                      # announced before anything is merged
    land(landing, "p0.json", 0, ("A-1", "one", "Open"))
    merge()
    assert run() == {"A-1"}                    # no new announcement: the commit drives it
    land(landing, "p1.json", 1, ("A-2", "two", "Open"))
    merge()
    assert run() == {"A-1", "A-2"}


# --- the store ----------------------------------------------------------------------

KEYED = T.StructType([T.StructField("issue_key", T.StringType()), T.StructField("n", T.LongType())])


def keyed(spark, *rows):
    return spark.createDataFrame(list(rows), KEYED)


def latest_wins(source):
    return lambda before, buckets: before.join(source, "issue_key", "left_anti").unionByName(source).repartition(buckets, "issue_key")


def contents_of(store, number=None):
    return dict(map(tuple, store.read(store.snapshot(number)).collect()))


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path), KEYED, "issue_key", buckets=8)
    first = spark.range(200).select(F.concat(F.lit("K-"), "id").alias("issue_key"), F.col("id").alias("n"))
    assert store.merge(first, latest_wins(first), "s", 0)
    before = store.snapshot()
    change = keyed(spark, ("K-7", -7), ("K-7x", 1))
    touched = {r.b for r in change.select(store.bucket_of(8).alias("b")).collect()}
    assert store.merge(change, latest_wins(change), "s", 1)
    after = store.snapshot()
    assert {b for b in after.folders if after.folders[b] != before.folders.get(b)} == touched and len(touched) < 8
    parts = [n for there in before.folders.values() for f in there for n in store._names(f"{tmp_path}/{f}") if n.endswith(".parquet")]
    assert len(parts) == len(before.folders)       # one task writes a bucket
    expected = {f"K-{i}": i for i in range(200)}
    assert contents_of(store, 0) == expected       # an older snapshot still reads as it was
    assert contents_of(store) == expected | {"K-7": -7, "K-7x": 1}


def test_of_two_writers_one_wins_and_the_other_merges_again(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path), KEYED, "issue_key", buckets=2)
    other, tries = BucketStore(spark, str(tmp_path), KEYED, "issue_key", buckets=2), []

    def slow(before, buckets):
        tries.append(1)
        if len(tries) == 1:
            source = keyed(spark, ("B", 2))
            assert other.merge(source, latest_wins(source), "other", 0)
        return latest_wins(mine)(before, buckets)

    mine = keyed(spark, ("A", 1))
    assert store.merge(mine, slow, "mine", 0)
    assert len(tries) == 2 and contents_of(store) == {"A": 1, "B": 2}
    assert store.snapshot().applied == {"other": 0, "mine": 0}
    assert not [n for n in store._names(store.manifests) if n.startswith(".staged")]


def test_expiry_deletes_only_what_no_kept_snapshot_names(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path), KEYED, "issue_key", buckets=4)
    for batch in range(5):
        source = keyed(spark, ("A", batch), (f"K-{batch}", batch))
        store.merge(source, latest_wins(source), "s", batch)
    written = store._write(keyed(spark, ("Z", 1)), 5, 4)       # a writer at work
    store.expire(2)
    assert store.numbers() == [3, 4]
    assert contents_of(store, 3) == {"A": 3} | {f"K-{i}": i for i in range(4)}
    assert contents_of(store) == {"A": 4} | {f"K-{i}": i for i in range(5)}
    named = {f for n in (3, 4) for there in store.snapshot(n).folders.values() for f in there}
    there = {f"data/{v}/{b}" for v in store._names(f"{tmp_path}/data") for b in store._names(f"{tmp_path}/data/{v}") if b.startswith("_b")}
    assert there == named | {f for folders in written.values() for f in folders}
    assert not store.merge(keyed(spark, ("A", 9)), lambda before, buckets: 1 / 0, "s", 4)      # still known after expiry


def test_appends_compaction_and_other_bucket_counts(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path), KEYED, "issue_key", buckets=2)
    assert store.read().count() == 0 and store.numbers() == []
    for i in range(6):
        assert store.append(store.snapshot(), keyed(spark, *((f"K-{i}-{j}", j) for j in range(10))), {"s": i}, {})
    assert max(map(len, store.snapshot().folders.values())) > 3
    rows = contents_of(store)
    store.compact(3)
    assert contents_of(store) == rows and {len(f) for f in store.snapshot().folders.values()} == {1}
    store.rebucket(5)
    assert contents_of(store) == rows and store.snapshot().buckets == 5 and store.snapshot().applied == {"s": 5}
    empty = keyed(spark)
    assert store.merge(empty, latest_wins(empty), "s", 6) and contents_of(store) == rows


def test_embedding_reads_changed_buckets_and_survives_rebucketing(spark, tmp_path):
    issues = ingest.issue_store(spark, str(tmp_path / "issues"), buckets=8)
    chunks = ingest.chunk_store(spark, str(tmp_path / "chunks"))

    def add(n, *keys):
        body = json.dumps({"startAt": 0, "issues": [{"key": k, "id": "1", "fields": {"summary": f"text of {k}"}} for k in keys]})
        flat = pages.flatten_pages(pages.parse_pages(spark.createDataFrame([(body,)], "body string"))).withColumn(
            "created", F.lit("2020-01-01").cast("timestamp"))
        issues.merge(flat, lambda before, buckets: upsert_issues(before, flat, ["start_at", "position"], buckets), "i", n)

    def run(n, make=lambda: HashingEmbedder(8)):
        ingest.embed_missing(issues, chunks, "summary_only", make, "c", n)
        return {r.issue_key: r.embedded_at for r in chunks.read().collect()}

    add(0, *(f"A-{i}" for i in range(20)))
    first = run(0)
    assert len(first) == 20
    held = chunks.snapshot()
    add(1, "B-1")
    second = run(1)
    assert set(second) == set(first) | {"B-1"} and all(second[k] == first[k] for k in first)
    now = chunks.snapshot()
    assert all(now.folders[b][:len(there)] == there for b, there in held.folders.items())      # vectors stay where they are
    assert sum(map(len, now.folders.values())) == sum(map(len, held.folders.values())) + 1
    issues.rebucket(3)
    assert run(2) == second and chunks.snapshot().buckets == 3
    assert run(2) == second                    # the same batch once more


def test_a_merge_shuffles_each_side_once(spark):
    rows = spark.createDataFrame([], schemas.ISSUES)
    arriving = rows.withColumns({"start_at": F.lit(0), "position": F.lit(0)})
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with dealt_into(spark, 5):
        plan = upsert_issues(rows, arriving, ["start_at", "position"], 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(issue_key") == 2 and spark.conf.get("spark.sql.shuffle.partitions") == before
