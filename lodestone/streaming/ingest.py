"""Incremental ingest and embedding as Structured Streaming jobs over bucket stores.

Each micro-batch makes one snapshot and rewrites only the buckets its keys fall into.  The store notes the last batch
of every stream: a replayed batch is not applied again, and a stream that lost its checkpoint is a new one whose
batches come last.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lodestone import schemas
from lodestone.operators.merge import upsert_issues
from lodestone.plans.content import Embedder, backlog, contents, embed
from lodestone.session import cut_lineage, scratch
from lodestone.sources.pages import flatten_pages
from lodestone.streaming.store import BUCKETS, BucketStore, Snapshot


def issue_store(spark: SparkSession, root: str, buckets: int = BUCKETS) -> BucketStore:
    return BucketStore(spark, root, schemas.ISSUES, "issue_key", buckets)


def chunk_store(spark: SparkSession, root: str) -> BucketStore:
    """Bucketed by issue, not by chunk, so that a bucket of issues meets one bucket of chunks."""
    return BucketStore(spark, root, schemas.CHUNKS, "issue_key")


def latest_snapshot(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """The newest snapshot under ``root``; an empty table where there is none."""
    return BucketStore(spark, root, schema, "issue_key").read()


def _stream_id(checkpoint: str, batch: DataFrame) -> str:
    """The id Spark keeps in the checkpoint: the same after a restart, another one for a new checkpoint."""
    spark = batch.sparkSession
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def stream_issues(spark: SparkSession, landing: str, root: str, checkpoint: str,
                  project: str | None = None, multi_line: bool = True, max_files: int | None = None,
                  buckets: int = BUCKETS, keep: int = 0) -> StreamingQuery:
    """Landed pages -> keyed upsert into the issue store; runs until the landing folder is drained.

    ``multi_line`` reads one page per file; without it every line is a page.  ``max_files`` bounds the files of one
    micro-batch, ``buckets`` is for a new store, and all but the newest ``keep`` snapshots expire (0: none do).
    """
    pages = _landed(spark, landing, multi_line, max_files)

    def merge(batch: DataFrame, number: int) -> None:
        store = issue_store(batch.sparkSession, root, buckets)
        with scratch(batch.sparkSession):
            arriving = cut_lineage(flatten_pages(batch, project))      # pages are parsed once
            store.merge(arriving, lambda before, buckets: upsert_issues(before, arriving, ["start_at", "position"], buckets),
                        _stream_id(checkpoint, batch), number)
        store.expire(keep)

    return (pages.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def _landed(spark: SparkSession, folder: str, multi_line: bool, max_files: int | None) -> DataFrame:
    reader = spark.readStream.schema(schemas.PAGE).option("multiLine", multi_line)
    return (reader if max_files is None else reader.option("maxFilesPerTrigger", max_files)).json(folder)


def embed_missing(issues: BucketStore, chunks: BucketStore, strategy: str, make: Callable[[], Embedder], stream: str,
                  batch: int, max_chars: int | None = None) -> bool:
    """Embed the issues without a chunk of the strategy, out of the buckets that changed since this was last done.

    The chunk store notes which folders of the issue store it has caught up with, so an anti join reads changed buckets
    alone and an issue is found whichever batch merged it.  Vectors made earlier are not written again: new chunks are
    appended.  False if the batch is in the store already.
    """
    while True:
        now, held = issues.snapshot(), chunks.snapshot()
        if held.applied.get(stream, -1) >= batch:
            return False
        if held.number < 0:
            held = Snapshot(buckets=now.buckets)
        elif held.buckets != now.buckets:
            chunks.rebucket(now.buckets)      # forgets what was seen: all buckets are looked at
            continue
        changed = [b for b, there in now.folders.items() if held.seen.get(f"{strategy}/{b}") != there]
        todo = backlog(issues.read(now, changed), chunks.read(held, changed), strategy)
        made = (embed(contents(todo, strategy, max_chars), make).withColumn("embedded_at", F.current_timestamp())
                .select(*chunks.schema.names))
        if chunks.append(held, made, {stream: batch}, {f"{strategy}/{b}": now.folders[b] for b in changed}):
            return True


def stream_chunks(spark: SparkSession, changes: str, issue_root: str, root: str, checkpoint: str,
                  strategy: str, make: Callable[[], Embedder], max_files: int | None = None,
                  max_chars: int | None = None, multi_line: bool = True, keep: int = 0) -> StreamingQuery:
    """Embed what is missing whenever landed pages announce issues or the issue store has a new snapshot.

    Two streams drive it, the landed pages and the manifests of the store under ``issue_root``; each batch embeds what
    the newest snapshot holds.  An issue announced before its page is merged is embedded when the merge commits.
    """
    issues = issue_store(spark, issue_root)
    files, there = issues._hadoop(issues.manifests)
    files.mkdirs(there)
    commits = spark.readStream.text(issues.manifests, wholetext=True).select(F.lit("merged").alias("cause"))
    pages = _landed(spark, changes, multi_line, max_files).select(F.lit("announced").alias("cause"))

    def extend(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        store = chunk_store(session, root)
        embed_missing(issue_store(session, issue_root), store, strategy, make, _stream_id(checkpoint, batch), number, max_chars)
        store.compact()
        store.expire(keep)

    return (pages.unionByName(commits).writeStream.foreachBatch(extend).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
