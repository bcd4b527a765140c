"""Deal rows out to tasks by weight, ahead of work that a single task would hold up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factspark.session import cut_lineage

#: What a task gets at most, in bytes of input, besides its last row.
MOST = 64 << 20


def dealt(rows: DataFrame, weight: Column | int, most: int = MOST) -> DataFrame:
    """The rows in partitions of about equal total ``weight`` (a number of bytes), none above ``most`` by more than one row.

    Deal narrow rows: keys, sizes and what the text is made or read from, not the text.  Weights are summed up over
    all rows in their order and the sums cut into equal ranges, a range a partition: as many as there are cores, or more
    where ``most`` asks for it.  The narrow rows are written once when the plan is made, since their places and
    their total are needed before they move.  With one weight for all rows, a row's place gives its sum, and nothing is sorted.
    """
    same = isinstance(weight, int)
    heavy = F.greatest(F.coalesce((F.lit(weight) if same else weight).cast("long"), F.lit(0)), F.lit(1))
    # The high bits of this id are the input split, the low 33 count its rows in their order.
    placed = rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_weight", heavy).withColumn("_split", F.shiftright("_at", 33))
    placed = cut_lineage(placed)  # read twice: the places must be the same
    splits = placed.groupBy("_split").agg(F.sum("_weight").alias("_sum"))
    total = splits.agg(F.sum("_sum")).first()[0] or 0
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-total // most))
    width = max(1, -(-total // parts))
    # One row per input split passes through this window.
    before = splits.select("_split", (F.sum("_sum").over(Window.orderBy("_split")) - F.col("_sum")).alias("_before"))
    inside = F.col("_at").bitwiseAND((1 << 33) - 1) * F.col("_weight") if same else F.sum("_weight").over(Window.partitionBy("_split").orderBy("_at")) - F.col("_weight")
    placed = placed.withColumn("_run", inside).join(before, "_split")
    part = F.floor((F.col("_before") + F.col("_run")) / width).cast("int")
    return placed.withColumn("_part", part).repartitionById(parts, F.col("_part")).select(*[F.col(f"`{c}`") for c in rows.columns])
