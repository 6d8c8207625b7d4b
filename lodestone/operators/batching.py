"""Token-budget batches: similar sizes together, count x longest within the budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone import values as V
from lodestone.session import cut_lineage, scratch


def token_budget_batches(rows: DataFrame, size: str, key: str, budget: int = V.MAX_BATCH_TOKENS) -> DataFrame:
    """Add ``batch``, numbered from 0 over the whole table in ascending order of (size, key).

    A batch closes when one more row would make count x longest exceed the budget, so the batches are those of one
    pass over the sorted rows, however many tasks there are.  A row over the budget is alone in its batch.  A size
    below 1 or NULL counts as 1.

    In ascending order a row is the longest of its batch, so it fits behind ``c`` others if and only if
    ``c + 1 <= budget // size``, its room.  Rows of one room therefore fill batches alike: what is carried from room
    to room is one open batch and its count, folded over at most ``2 * sqrt(budget)`` rooms, and a row's batch
    follows from its place among the rows of its room.  Equal sizes spread over tasks by key.
    """
    spark, names = rows.sparkSession, rows.columns
    taken = F.greatest(F.coalesce(F.col(size), F.lit(1)).cast("long"), F.lit(1).cast("long"))
    room = F.greatest(F.floor(F.lit(budget) / taken), F.lit(1)).cast("long")
    with scratch(spark) as keep:
        # Written once: places are counted and used in different jobs and must not be dealt anew in between.
        ordered = keep(rows.withColumn("_taken", taken).withColumn("_room", room)
                       .repartitionByRange(F.col("_taken"), F.col(key)).sortWithinPartitions("_taken", key)
                       .withColumn("_place", F.monotonically_increasing_id()).drop("_taken"))
        # A task holds a range of sizes: one row a task and room, and both ends of a range share theirs.
        runs = cut_lineage(ordered.groupBy(F.shiftright("_place", 33).alias("_part"), "_room")
                           .agg(F.min("_place").alias("_from"), F.count("*").alias("_n")))
        totals = runs.groupBy("_room").agg(F.sum("_n").alias("n")).orderBy(F.desc("_room")).collect()
        starts = []
        opened, count = 0, 0            # batches opened so far; rows of the last one
        for r in totals:
            into_open = min(max(r._room - count, 0), r.n) if opened else 0
            starts.append((r._room, opened, into_open))
            left = r.n - into_open
            if left:
                opened += -(-left // r._room)
                count = left - (-(-left // r._room) - 1) * r._room
            else:
                count += into_open
        first = spark.createDataFrame(starts, "_room long, _opened long, _into long")
        earlier = Window.partitionBy("_room").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)      # a row a task
        offsets = keep(runs.withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
                       .join(F.broadcast(first), "_room"))
    at = F.col("_offset") + F.col("_place") - F.col("_from")
    batch = F.when(at < F.col("_into"), F.col("_opened") - 1).otherwise(
        F.col("_opened") + F.floor((at - F.col("_into")) / F.col("_room")))
    return (ordered.withColumn("_part", F.shiftright("_place", 33)).join(offsets, ["_part", "_room"])
            .select(*names, batch.cast("long").alias("batch")))
