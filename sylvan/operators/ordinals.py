"""Row numbers over a whole context without moving it to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_ordinals(df: DataFrame, sorts: list, name: str) -> DataFrame:
    """df with its 1-based position in the order of ``sorts``.

    Rows are sorted by range and stored in the checkpoint folder, so that the partition of a row stays what it
    is; each partition's rows are counted, and a row's number is its place in its partition after the rows of
    the partitions before, which are one number a partition.
    """
    from ..plans.shared import stored

    ordered = stored(df.orderBy(*sorts).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    first = ordered.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = first.withColumn("__before", F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))).drop("__n")
    return ordered.join(F.broadcast(before), "__part").withColumn(name, F.coalesce("__before", F.lit(0)) + F.col("__at") - F.col("__first") + 1).drop("__part", "__at", "__before", "__first")


def bounded_window(df: DataFrame, ordinal: str, low: int, high: int, make, name: str) -> DataFrame:
    """A frame of rows low..high around each row, in blocks of ordinals with the neighbours that they need.

    ``make(spec)`` gives the window Column; each row goes to its block and, near an edge, to the next one.
    """
    block, reach = max(100_000, 4 * max(abs(low), abs(high))), max(abs(low), abs(high))
    own = F.floor(F.col(ordinal) / block)
    blocks = F.array_distinct(F.array(own, F.floor((F.col(ordinal) - reach) / block), F.floor((F.col(ordinal) + reach) / block)))
    spread = df.withColumn("__own", own).withColumn("__block", F.explode(blocks))
    spec = Window.partitionBy("__block").orderBy(ordinal).rowsBetween(low, high)
    return spread.withColumn(name, make(spec)).where("__own = __block").drop("__own", "__block")
