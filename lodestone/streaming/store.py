"""A keyed table in files: rows lie in buckets by key, a manifest names the folders of every bucket.

A change reads and writes only the buckets its keys fall into; all others keep their files.  A snapshot is one small
manifest, made visible by a rename that fails if the number is taken, so readers see the table before or after a
change and of two writers one wins; the other one merges again with what the winner left.  A manifest also notes the
last batch of each stream, so a replayed batch changes nothing, whatever became of the files of the first try.

``buckets`` is fixed when the store is made; ``rebucket`` deals a grown table into more.  Choose it so that a bucket
holds some hundred MB: a manifest has one line for each bucket, and a change costs the buckets it touches.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.sources.sinks import path_exists

BUCKETS = 64


@dataclass(frozen=True)
class Snapshot:
    number: int = -1
    buckets: int = BUCKETS
    folders: dict[int, list[str]] = field(default_factory=dict)     # bucket -> folders below the root
    applied: dict[str, int] = field(default_factory=dict)           # stream -> its last batch
    seen: dict[str, list[str]] = field(default_factory=dict)        # what of another store this one has caught up with


@contextmanager
def dealt_into(spark: SparkSession, partitions: int) -> Iterator[None]:
    """Aggregations by key are dealt as ``repartition(partitions, key)`` deals, so that Spark drops the second of the two shuffles."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(partitions))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class BucketStore:
    """The table under ``root``.  ``buckets`` counts only for a store that has no snapshot yet."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, key: str, buckets: int = BUCKETS):
        self.spark, self.root, self.schema, self.key, self.buckets = spark, root.rstrip("/"), schema, key, buckets

    @property
    def manifests(self) -> str:
        return f"{self.root}/manifests"

    def _hadoop(self, path: str):
        there = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return there.getFileSystem(self.spark._jsc.hadoopConfiguration()), there

    def _names(self, folder: str) -> list[str]:
        if not path_exists(self.spark, folder):
            return []
        files, there = self._hadoop(folder)
        return [s.getPath().getName() for s in files.listStatus(there)]

    def numbers(self) -> list[int]:
        """Numbers of the snapshots, oldest first."""
        return sorted(int(name[1:9]) for name in self._names(self.manifests) if name.startswith("m"))

    def snapshot(self, number: int | None = None) -> Snapshot:
        """The newest snapshot, or the one of that number; an empty one where the store has none."""
        if number is None:
            numbers = self.numbers()
            if not numbers:
                return Snapshot(buckets=self.buckets)
            number = numbers[-1]
        body = json.loads(self.spark.read.text(f"{self.manifests}/m{number:08d}.json", wholetext=True).first()[0])
        folders = {int(b): there for b, there in body["folders"].items()}
        return Snapshot(number, body["buckets"], folders, body["applied"], body["seen"])

    def bucket_of(self, buckets: int) -> Column:
        """The task that ``repartition(buckets, key)`` deals a row to: one task writes a bucket, one file each."""
        return F.pmod(F.hash(self.key), F.lit(buckets)).cast("int")

    def read(self, held: Snapshot | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows of a snapshot (the newest), or of some of its buckets: only their files are listed and opened."""
        held = held or self.snapshot()
        wanted = held.folders if only is None else [b for b in only if b in held.folders]
        paths = [f"{self.root}/{folder}" for b in wanted for folder in held.folders[b]]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def merge(self, source: DataFrame, make: Callable[[DataFrame, int], DataFrame], stream: str, batch: int) -> bool:
        """Replace the buckets of ``source``'s keys by ``make(their rows, buckets)``; false if the batch is in the store already.

        ``make`` leaves its rows dealt by ``repartition(buckets, key)``, so that writing them needs no shuffle.
        ``source`` is read twice, for its buckets and by ``make``.
        """
        while True:
            held = self.snapshot()
            if held.applied.get(stream, -1) >= batch:
                return False
            numbers = source.select(self.bucket_of(held.buckets).alias("b")).distinct()
            touched = [row.b for row in numbers.collect()]      # at most one row a bucket
            with dealt_into(self.spark, held.buckets):
                done = self.replace(held, touched, make(self.read(held, touched), held.buckets), {stream: batch})
            if done:
                return True

    def replace(self, held: Snapshot, touched: list[int], rows: DataFrame, applied: dict[str, int]) -> bool:
        """Next snapshot: ``rows``, dealt by key, are all rows of the ``touched`` buckets.  False if another writer took the number."""
        gone = set(touched)
        folders = {b: there for b, there in held.folders.items() if b not in gone}
        if touched:
            folders |= self._write(rows, held.number + 1, held.buckets)
        return self._commit(Snapshot(held.number + 1, held.buckets, folders, held.applied | applied, held.seen))

    def append(self, held: Snapshot, rows: DataFrame, applied: dict[str, int], seen: dict[str, list[str]]) -> bool:
        """Next snapshot: ``rows`` of new keys lie beside what their buckets hold.  False if another writer took the number."""
        folders = dict(held.folders)
        for b, there in self._write(rows.repartition(held.buckets, self.key), held.number + 1, held.buckets).items():
            folders[b] = folders.get(b, []) + there
        return self._commit(Snapshot(held.number + 1, held.buckets, folders, held.applied | applied, held.seen | seen))

    def compact(self, most: int = 16) -> None:
        """Write buckets that appends left in more than ``most`` folders into one folder each."""
        while True:
            held = self.snapshot()
            spread = [b for b, there in held.folders.items() if len(there) > most]
            rows = self.read(held, spread).repartition(held.buckets, self.key)
            if not spread or self.replace(held, spread, rows, {}):
                return

    def rebucket(self, buckets: int) -> None:
        """Deal the whole table into another number of buckets, as a snapshot of its own."""
        while True:
            held = self.snapshot()
            folders = self._write(self.read(held).repartition(buckets, self.key), held.number + 1, buckets)
            if self._commit(Snapshot(held.number + 1, buckets, folders, held.applied)):
                return

    def _write(self, rows: DataFrame, number: int, buckets: int) -> dict[int, list[str]]:
        folder = f"data/v{number:08d}-{uuid.uuid4().hex}"
        (rows.withColumn("_bucket", self.bucket_of(buckets)).write.partitionBy("_bucket")
         .option("compression", "zstd").parquet(f"{self.root}/{folder}"))
        names = [n for n in self._names(f"{self.root}/{folder}") if n.startswith("_bucket=")]
        return {int(n.split("=")[1]): [f"{folder}/{n}"] for n in names}

    def _commit(self, made: Snapshot) -> bool:
        """Write beside and rename: atomic on HDFS and local disks, and refused if the number is taken."""
        body = {"buckets": made.buckets, "folders": made.folders, "applied": made.applied, "seen": made.seen}
        files, staged = self._hadoop(f"{self.manifests}/.staged-{uuid.uuid4().hex}")
        out = files.create(staged)
        out.write(json.dumps(body).encode())
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration())
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        mode = self.spark.sparkContext._gateway.new_array(rename, 1)
        mode[0] = rename.NONE
        try:
            context.rename(staged, self._hadoop(f"{self.manifests}/m{made.number:08d}.json")[1], mode)
        except Py4JJavaError as error:
            files.delete(staged, False)
            if "AlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        return True

    def expire(self, keep: int) -> None:
        """Forget all but the newest ``keep`` snapshots and delete the files no kept one names.

        Files of a number not yet committed belong to a writer at work and stay; a reader of a forgotten snapshot fails.
        """
        numbers = self.numbers()
        if keep < 1 or not numbers:
            return
        used = {folder for n in numbers[-keep:] for there in self.snapshot(n).folders.values() for folder in there}
        named = {folder.split("/")[1] for folder in used}
        for n in numbers[:-keep]:
            files, there = self._hadoop(f"{self.manifests}/m{n:08d}.json")
            files.delete(there, False)
        for name in self._names(f"{self.root}/data"):
            if int(name[1:9]) > numbers[-1]:
                continue
            files, there = self._hadoop(f"{self.root}/data/{name}")
            if name not in named:
                files.delete(there, True)
                continue
            for part in self._names(f"{self.root}/data/{name}"):
                if part.startswith("_bucket=") and f"data/{name}/{part}" not in used:
                    files.delete(self._hadoop(f"{self.root}/data/{name}/{part}")[1], True)
