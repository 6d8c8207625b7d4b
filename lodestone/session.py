"""Session set-up, the shared folder, and frames kept in it."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

def build_session(master: str | None = None, app: str = "lodestone", **conf: str) -> SparkSession:
    """Session with UTC time, ANSI mode and AQE.  Cluster sizing stays with the caller."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can read: ``spark.checkpoint.dir``, or a temporary one where it is unset (local master only)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lodestone-ckpt-"))
    return context.getCheckpointDir()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that it need only be on the driver's path."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        here = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="lodestone-ship-")
        context.addPyFile(shutil.make_archive(f"{folder}/{here.name}", "zip", here.parent, here.name))
        _shipped.add(context.applicationId)


_kept: list[str] = []


def kept_path(spark: SparkSession) -> str:
    """A new place in the shared folder, removed by ``release_kept``."""
    _kept.append(f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}")
    return _kept[-1]


#: Whether Spark removes the shuffle files of a query when it ends (4.1; sessions of older versions do not look at it).
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run inside go as soon as it ends, and not when the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Keep a small, costly frame that several branches read, as a table in the shared folder.

    Unlike a checkpointed RDD the written table tells Spark its size, so joins with it
    are planned as broadcasts from the start where it is small.  Shuffle files behind it are not read again and go at once.
    """
    spark = df.sparkSession
    path = kept_path(spark)
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, names: list[str]) -> None:
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables kept inside the block are removed when it ends, but for those made by the function it gives.

    What leaves the block must have been made by that function, or read nothing that the block kept.
    Blocks can be nested: what an inner one leaves belongs to the outer one.
    """
    first, spared = len(_kept), []

    def keep(df: DataFrame) -> DataFrame:
        out = cut_lineage(df)
        spared.append(_kept[-1])
        return out

    try:
        yield keep
    finally:
        inside = _kept[first:]
        _kept[first:] = [name for name in inside if name in spared]
        _remove(spark, [name for name in inside if name not in spared])


def release_kept(spark: SparkSession) -> None:
    """Remove the tables this process kept.  Frames that read them cannot be used afterwards."""
    names = _kept[:]
    _kept.clear()
    _remove(spark, names)
