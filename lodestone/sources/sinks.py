"""Result sinks: write once, write with a suffix, keyed snapshots, bucketed tables."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _staged(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> str:
    """Written beside ``path``; readers of ``path`` never see a half table."""
    staged = f"{path.rstrip('/')}._staged-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(staged)
    return staged


def _claim(spark: SparkSession, path: str) -> bool:
    """Create the claim file of ``path``; false if another writer holds it.  Creation is atomic, so one writer wins."""
    files, claim = _files(spark, f"{path.rstrip('/')}._claim")
    try:
        files.create(claim, False).close()
    except Py4JJavaError as error:
        if "AlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def _move(spark: SparkSession, source: str, target: str) -> None:
    files, there = _files(spark, target)
    if not files.rename(_files(spark, source)[1], there):
        raise OSError(f"cannot rename {source} to {target}")


def _delete(spark: SparkSession, path: str) -> None:
    files, there = _files(spark, path)
    files.delete(there, True)


def write_once(df: DataFrame, path: str, *partition_by: str) -> None:
    """Refuse an existing target, also one that another writer is about to make.

    The table is written beside the target and renamed to it by the one writer that holds the claim file.
    A writer that dies in between leaves staged files or a claim, never a half table; remove them by hand.
    """
    spark = df.sparkSession
    if path_exists(spark, path):
        raise FileExistsError(f"{path} already exists")
    staged = _staged(df, path, partition_by)
    if not _claim(spark, path):
        _delete(spark, staged)
        raise FileExistsError(f"{path} already exists: another writer claimed it")
    try:
        if path_exists(spark, path):
            _delete(spark, staged)
            raise FileExistsError(f"{path} already exists")
        _move(spark, staged, path)
    finally:
        _delete(spark, f"{path.rstrip('/')}._claim")


def write_with_suffix(df: DataFrame, path: str) -> str:
    """Write to ``path`` or, where it exists, to ``path_2``, ``path_3``, ...  Returns the path used."""
    n = 1
    while True:
        free = path if n == 1 else f"{path}_{n}"
        if not path_exists(df.sparkSession, free):
            try:
                write_once(df, free)
                return free
            except FileExistsError:      # another writer was first
                pass
        n += 1


def write_lists(lists: DataFrame, path: str) -> None:
    """Candidate lists, one directory per list so a reader prunes the other."""
    write_once(lists, path, "list")


def rebuild(df: DataFrame, path: str) -> None:
    """Make anew, for statistics derived from the corpus: written in full beside ``path``, then swapped in by renames.

    ``df`` may read the table it replaces.  Between the two renames a reader finds no table, never a half one.
    """
    spark = df.sparkSession
    staged = _staged(df, path)
    if path_exists(spark, path):
        old = f"{path.rstrip('/')}._old-{uuid.uuid4().hex}"
        _move(spark, path, old)
        _move(spark, staged, path)
        _delete(spark, old)
    else:
        _move(spark, staged, path)


def save_bucketed(df: DataFrame, table: str, buckets: int, *keys: str) -> None:
    """Bucketed and sorted by key: later joins and upserts on the key need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)


def stamp_run(df: DataFrame, **provenance) -> DataFrame:
    """Add run columns such as date, commit, model, k, strategy."""
    return df.withColumns({name: F.lit(value) for name, value in provenance.items()})
