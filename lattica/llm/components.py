"""Connected components and grouped work on whole key groups, both without a hot task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, tidy

#: So few links are followed by union-find in one task (16 bytes each); more by rounds over the cluster.
FEW_LINKS = 500_000
HOT_KEYS = 1000


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable, for every id in a link.

    Up to FEW_LINKS links are followed in one task. More are taken through the
    large-star and small-star steps, which keep components and turn each into one
    star around its smallest id. Each step is written to the shared
    checkpoint folder. Links of an id with itself, repeated and reversed links are fine.
    """
    e = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    before = _digest(e)
    if before[0] <= FEW_LINKS:
        return e.coalesce(1).mapInArrow(_follow, "id long, component long")
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        e = both.join(low.select("u", F.least("u", "m").alias("m")), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = cut(e.join(low, "u").select("v", "m").where("v <> m").union(low.select("u", "m")).toDF("u", "v").distinct())
        after = _digest(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up: dict[int, int] = {}

    def top(i: int) -> int:
        while (j := up.setdefault(i, i)) != i:
            up[i] = up.setdefault(j, j)
            i = up[i]
        return i

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = top(u), top(v)
            up[max(x, y)] = min(x, y)
    ids = list(up)
    for k in range(0, len(ids), 10_000):
        part = ids[k : k + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([top(i) for i in part], pa.int64())], names=["id", "component"])


def _digest(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1000003)).first())


def hot_join(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Each of ``total`` rows with its group; groups: one row for each key, with its number of rows in the column ``size``.

    Groups of a thousandth of all rows or more, of which there are HOT_KEYS at most, are
    broadcast, so their rows stay where they are; the others are joined by a shuffle.
    """
    least = max(2, total // HOT_KEYS)
    hot, cold = F.broadcast(groups.where(F.col(size) >= least)), groups.where(F.col(size) < least)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys))


def blocked(df: DataFrame, keys: list[str], member: str, limit: int) -> DataFrame:
    """Rows of keys with two members at least, with columns ``own``, ``lo``, ``hi``.

    A key of up to ``limit`` members is one block pair (0, 0). A larger one is split
    into blocks of about that size by a hash of the member, and each row goes to all
    block pairs with its block, so that every two members meet in exactly one of
    them if in different blocks; within a block they meet in (own, own).
    """
    size = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    size = size.where("__n > 1").withColumn("__b", F.ceil(F.col("__n") / limit).cast("int")).drop("__n")
    d = df.join(size, keys).withColumn("own", _block(member, F.col("__b")))
    return d.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__b") - 1))).withColumn("lo", F.least("own", "__o")).withColumn("hi", F.greatest("own", "__o")).drop("__o", "__b")


def _block(member: str, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(11), member), blocks).cast("int")


def apart(df: DataFrame, key: str, component: str, member: str, limit: int) -> DataFrame:
    """Rows with ``own``, ``lo``, ``hi`` as of ``blocked``, where members of one component need not meet.

    Keys with one component go. In the others, members outside the largest component
    meet all; those of the largest meet these alone, so that a key with few members
    outside grows by few copies of its rows.
    """
    n = df.groupBy(key, component).agg(F.count(F.lit(1)).alias("n"))
    n = n.groupBy(key).agg(F.max_by(component, F.struct("n", component)).alias("__main"), F.max("n").alias("__n"), F.sum("n").alias("__all")).where("__all > __n")
    blocks = lambda c: F.ceil(c / limit).cast("int")
    d = hot_join(df, n.withColumn("__m", blocks(F.col("__n"))).withColumn("__o", blocks(F.col("__all") - F.col("__n"))), [key], "__all", df.count())
    main, o, m = F.col(component) == F.col("__main"), F.col("__o"), F.col("__m")
    whole = F.col("__all") <= limit
    d = d.withColumn("own", F.when(whole, 0).when(main, o + _block(member, m)).otherwise(_block(member, o)))
    others = F.when(whole, F.array(F.lit(0))).when(main, F.sequence(F.lit(0), o - 1)).otherwise(F.sequence(F.lit(0), o + m - 1))
    d = d.withColumn("__with", F.explode(others))
    return d.withColumn("lo", F.least("own", "__with")).withColumn("hi", F.greatest("own", "__with")).drop("__with", "__main", "__n", "__all", "__m", "__o")


def each_group(df: DataFrame, keys: list[str], work: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Run ``work`` on the rows of each group; a group must fit in memory, as block pairs do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            cuts = _cuts(held, keys)
            for lo, hi in zip(cuts[:-2], cuts[1:-1], strict=True):
                if (out := work(held.slice(lo, hi - lo))) is not None:
                    yield out
            held = held.slice(cuts[-2]) if len(cuts) > 1 else None
        if held is not None and held.num_rows and (out := work(held)) is not None:
            yield out

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(tidy(run), schema)


def _cuts(t: pa.Table, keys: list[str]) -> list[int]:
    n = t.num_rows
    if not n:
        return []
    change = np.zeros(n - 1, bool)
    for k in keys:
        v = t[k].to_numpy()
        change |= v[1:] != v[:-1]
    return [0, *(np.flatnonzero(change) + 1).tolist(), n]


class Forest:
    """Union-find over row numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.top(i), self.top(j)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True
