"""Frames that two branches of a plan must see alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AT = "__at"


def stable(df: DataFrame) -> DataFrame:
    """df, computed once: written to the folder that executors share if one is set, else held in memory and on disk.

    The bounds of ranges come from a sample that may differ each time a plan runs.
    """
    return df.checkpoint(eager=True) if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def placed(df: DataFrame, by: list[Column | str]) -> DataFrame:
    """df with ``__place``, each row's 0-based place in an order, and ``__all``, the number of rows; no task orders the whole table.

    Rows go to ranges of the order; a row's place is that in its range after the rows
    of the ranges before, of which only the counts meet. Without an order, the order of partitions.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = df.repartitionByRange(ranges, *by).sortWithinPartitions(*by) if by else df
    d = stable(d.withColumn(AT, F.monotonically_increasing_id()))
    part = F.shiftright(AT, 33)
    n = d.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))  # a row for each range
    before = n.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"), F.sum("__n").over(Window.partitionBy(F.lit(1))).alias("__all"))
    d = d.join(F.broadcast(before), part == F.col("__part"))
    return d.withColumn("__place", F.col("__before") + F.col(AT).bitwiseAND(F.lit((1 << 33) - 1))).drop(AT, "__part", "__before")
