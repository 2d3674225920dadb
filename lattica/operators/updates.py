"""Keyed updates on batches: upsert, partial update, removal, ring buffer, deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.stable import stable


def append(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new, allowMissingColumns=True)


def latest(df: DataFrame, key: str, arrival: str) -> DataFrame:
    """The last row of each key; one aggregation, combined on the map side, without a window."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(arrival)).alias("__r")).select(*[F.col(f"__r.{c}").alias(c) if c != key else F.col(key) for c in df.columns])


def upsert(old: DataFrame, new: DataFrame, key: str, arrival: str) -> DataFrame:
    """Last write of each key wins, within the batch too; new rows win over old ones."""
    both = old.withColumn("__n", F.lit(0)).unionByName(new.withColumn("__n", F.lit(1)))
    rest = [c for c in old.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("__n", arrival)).alias("__r")).select(*[F.col(f"__r.{c}").alias(c) if c != key else F.col(key) for c in old.columns])


def partial(old: DataFrame, new: DataFrame, key: str, arrival: str, given: dict[str, Column] | None = None) -> DataFrame:
    """Columns that the batch lacks keep their value; a null in a given column clears it.

    given: by column a Column of ``new`` that says whether the row gives it; all present columns if left out.
    """
    given = given or {c: F.lit(True) for c in new.columns if c != key}
    cols = [c for c in old.columns if c != key]
    side = lambda d, n, g: d.select(F.col(key), F.struct(F.lit(n), F.col(arrival)).alias("__o"), *[F.struct(g.get(c, F.lit(False)).alias("g"), (F.col(c) if c in d.columns else F.lit(None).cast(old.schema[c].dataType)).alias("v")).alias(c) for c in cols])
    both = side(old, 0, {c: F.lit(True) for c in cols}).unionByName(side(new, 1, given))
    return both.groupBy(key).agg(*[F.max_by(F.col(f"{c}.v"), F.when(F.col(f"{c}.g"), F.col("__o"))).alias(c) for c in cols]).select(*old.columns)


def remove(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key).distinct(), key, "left_anti").select(*df.columns)


def ring(df: DataFrame, limit: int, arrival: str) -> DataFrame:
    """The newest row of each slot ``arrival mod limit``."""
    return latest(df.withColumn("__slot", F.pmod(F.col(arrival), F.lit(limit))), "__slot", arrival).drop("__slot")


def tails(df: DataFrame, limit: int, at: str) -> DataFrame:
    """The last ``limit`` rows of each partition, with the partition and the place in it as of monotonically_increasing_id."""
    place = F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    d = df.withColumn(at, F.monotonically_increasing_id())
    return latest(d.withColumn("__slot", F.col(at) - place + F.pmod(place, F.lit(limit))), "__slot", at).drop("__slot")


def transitions(old: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """By key how a cell changed: added, removed, same, changed, set or cleared."""
    a = old.select(key, F.col(column).alias("old"), F.lit(True).alias("__o"))
    b = new.select(key, F.col(column).alias("new"), F.lit(True).alias("__n"))
    kind = F.when(F.col("__o").isNull(), "added").when(F.col("__n").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "same").when(F.col("old").isNull(), "set").when(F.col("new").isNull(), "cleared").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, "old", "new", kind.alias("transition"))


def deltas(old: DataFrame, new: DataFrame, key: str, group: str, value: str) -> DataFrame:
    """What a changed batch adds to each group's sum and count, as signed rows: minus the old, plus the new."""
    touched = old.join(new.select(key).distinct(), key, "left_semi")
    signed = touched.select(group, (-F.col(value)).alias("v"), F.lit(-1).alias("n")).union(new.select(group, F.col(value).alias("v"), F.lit(1).alias("n")))
    return signed.groupBy(group).agg(F.sum("v").alias("delta_sum"), F.sum("n").cast("long").alias("delta_count"))


def row_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of the new view that the old one lacks."""
    return new.exceptAll(old)


def parent_tree(df: DataFrame, key: str, parent: str) -> DataFrame:
    """Each row with its path of ancestors by key, root first, however deep.

    Each round joins a path to that of its topmost row, so paths double; rounds go on until none grows.
    A row without a known parent is a root; rows of a cycle end where the cycle would begin again.
    """
    known = df.select(F.col(key).alias("__u")).where("__u is not null").distinct()
    out = df.join(known, (F.col(parent) == F.col("__u")) & (F.col(parent) != F.col(key)), "left").select(F.col(key).alias("__k"), F.col("__u").alias("__p"), F.array(F.col(key)).alias("path"))
    while True:
        up = out.where("__k is not null").dropDuplicates(["__k"]).select(F.col("__k").alias("__u"), F.col("__p").alias("__up"), F.col("path").alias("__path"))
        free = ~F.arrays_overlap("path", "__path")
        out = out.join(up, F.col("__p") == F.col("__u"), "left").select("__k", F.when(free, F.col("__up")).alias("__p"), F.when(free, F.concat("__path", "path")).otherwise(F.col("path")).alias("path"))
        out = stable(out)  # so that plans don't double with the paths
        if out.where("__p is not null").isEmpty():
            return out.select(F.col("__k").alias(key), "path", F.size("path").alias("depth"))


def water_marks(old: DataFrame | None, new: DataFrame, group: str, value: str) -> DataFrame:
    """The highest and lowest value that each group has ever had: folded over batches, so that a removal lowers nothing."""
    now = new.groupBy(group).agg(F.max(value).alias("high"), F.min(value).alias("low"))
    return now if old is None else old.unionByName(now).groupBy(group).agg(F.max("high").alias("high"), F.min("low").alias("low"))
