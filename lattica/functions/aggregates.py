"""Aggregates by name.

One-pass aggregates are plain Columns, so that partial aggregation, ROLLUP and
GROUPING SETS work on them. ``median`` and ``dominant`` first count equal values:
that combines on the map side, and no group's values are held in one list.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_DISTINCT = 1000


def truthy(c: Column, kind: str) -> Column:
    if kind == "boolean":
        return F.coalesce(c, F.lit(False))
    if kind == "string":
        return F.coalesce(F.length(c) > 0, F.lit(False))
    if kind in ("date", "timestamp", "timestamp_ntz", "array"):
        return c.isNotNull()
    return F.coalesce(c != 0, F.lit(False))


def _sum(c, by, kind):
    return F.coalesce(F.sum(c), F.lit(0).cast("double" if kind in ("double", "float") else "long"))


def _weighted(c, by, kind):
    ok = c.isNotNull() & by.isNotNull() & ~F.isnan(c.cast("double")) & ~F.isnan(by.cast("double"))
    w = F.sum(F.when(ok, by.cast("double")))
    return F.when(w > 0, F.sum(F.when(ok, by.cast("double") * c)) / w)


def _unique(c, by, kind):
    """The value if all rows have it, else ``-``; without a distinct."""
    n, rows = F.count(c), F.count(F.lit(1))
    return F.when(n == 0, F.lit(None).cast("string")).when((n == rows) & (F.min(c) == F.max(c)), F.min(c).cast("string")).otherwise("-")


def _any(c, by, kind):
    t = truthy(c, kind)
    return F.min_by(c, F.struct((~t).cast("int"), F.when(t, by.cast("double")).otherwise(-by.cast("double"))))


def _join(c, by, kind):
    return F.concat(F.array_join(F.array_sort(F.collect_set(c.cast("string"))), ", "), F.when(F.count(c) > 0, ", ").otherwise(""))


ONE_PASS: dict[str, Callable[[Column, Column | None, str], Column]] = {
    "sum": _sum,
    "count": lambda c, by, kind: F.count(F.lit(1)),
    "avg": lambda c, by, kind: F.avg(c),
    "mean": lambda c, by, kind: F.avg(c),
    "mean by count": lambda c, by, kind: F.avg(c),
    "weighted mean": _weighted,
    "unique": _unique,
    "any": _any,
    "or": _any,
    "and": lambda c, by, kind: F.bool_and(truthy(c, kind)),
    "join": _join,
    "distinct count": lambda c, by, kind: F.count_distinct(c) + F.max(c.isNull().cast("int")),
    "distinct values": lambda c, by, kind: F.slice(F.array_sort(F.collect_set(c)), 1, MAX_DISTINCT),
    "distinct values truncated": lambda c, by, kind: F.count_distinct(c) > MAX_DISTINCT,
    "distinct leaf": _unique,
    "first by index": lambda c, by, kind: F.min_by(c, by),
    "last by index": lambda c, by, kind: F.max_by(c, by),
    "first": lambda c, by, kind: F.min_by(c, by),
    "last": lambda c, by, kind: F.max_by(c, by),
    "high": lambda c, by, kind: F.max(c),
    "max": lambda c, by, kind: F.max(c),
    "low": lambda c, by, kind: F.min(c),
    "min": lambda c, by, kind: F.min(c),
    "mul": lambda c, by, kind: F.product(c.cast("double")),
    "sum abs": lambda c, by, kind: F.coalesce(F.sum(F.abs(c)), F.lit(0).cast("double" if kind in ("double", "float") else "long")),
    "sum not null": lambda c, by, kind: F.sum(F.when(c.isNotNull() & ~F.isnan(c.cast("double")), c)),
    "identity": lambda c, by, kind: F.min(c),
    "pct sum parent": _sum,
    "pct sum grand total": _sum,
}
#: Those that can be put together from parts of a group: by part how it is taken and how parts are joined.
PARTS: dict[str, dict[str, tuple[Callable[[Column], Column], Callable[[str], Column]]]] = {
    **dict.fromkeys(("sum", "pct sum parent", "pct sum grand total"), {"sum": (F.sum, F.sum)}),
    "sum abs": {"sum": (lambda c: F.sum(F.abs(c)), F.sum)},
    "count": {"count": (lambda c: F.count(F.lit(1)), F.sum)},
    **dict.fromkeys(("avg", "mean", "mean by count"), {"sum": (lambda c: F.sum(c.cast("double")), F.sum), "count": (F.count, F.sum)}),
    **dict.fromkeys(("high", "max"), {"top": (F.max, F.max)}),
    **dict.fromkeys(("low", "min", "identity"), {"top": (F.min, F.min)}),
}


def in_parts(ops: list[str]) -> bool:
    return all(op in PARTS for op in ops)


def whole(op: str, name: str, kind: str) -> Column:
    """An aggregate from its parts, which stand in columns ``__<part>_<name>``."""
    joined = [join(f"__{k}_{name}") for k, (_, join) in PARTS[op].items()]
    if len(joined) == 2:
        return F.try_divide(*joined)
    return F.coalesce(joined[0], F.lit(0).cast("double" if kind in ("double", "float") else "long")) if "sum" in PARTS[op] else joined[0]


#: Counted by value first.
TWO_PHASE = ("median", "dominant")
#: From other aggregates of the same view: scaled sums, quotients and products, and a copy.
AFTER = ("add", "div", "scaled mul", "custom")
AGGREGATES = {*ONE_PASS, *TWO_PHASE, *AFTER}
ORDERED = ("any", "or", "first", "last", "first by index", "last by index")


def default(kind: str) -> str:
    return "any" if kind == "array" else "count" if kind in ("string", "date", "timestamp", "timestamp_ntz") else "sum"


def after(op: str, a: Column, b: Column, scale: tuple[float, float]) -> Column:
    wa, wb = scale
    if op == "add":
        return a * wa + b * wb
    if op == "div":
        return F.try_divide(a * wa, b * wb)
    if op == "scaled mul":
        return (a * wa) * (b * wb)
    return a


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys where null equals null; the right keys go."""
    r = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    if not keys:
        return left.withColumn("__one", F.lit(1)).join(r.withColumn("__one", F.lit(1)), "__one", how).drop("__one")
    cond = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    out = left.join(r, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"__r_{k}" for k in keys])


def by_value(counts: DataFrame, op: str, keys: list[str], alias: str) -> DataFrame:
    """``counts``: keys, __v and its count __n. A group's mode (ties: the smallest) or upper median (nulls first)."""
    if op == "dominant":
        return counts.groupBy(*keys).agg(F.min_by("__v", F.struct(-F.when(F.col("__v").isNull(), 1).otherwise(F.col("__n")), F.col("__v").isNotNull(), "__v")).alias(alias))
    w = Window.partitionBy(*keys)
    run = counts.withColumn("__c", F.sum("__n").over(w.orderBy(F.col("__v").asc_nulls_first()))).withColumn("__t", F.sum("__n").over(w))
    hit = run.where((F.col("__c") > F.floor(F.col("__t") / 2)) & (F.col("__c") - F.col("__n") <= F.floor(F.col("__t") / 2)))
    return hit.select(*keys, F.col("__v").alias(alias))


def custom(df: DataFrame, keys: list[str], column: str, reduce_values: Callable, kind: str = "double", alias: str = "x") -> DataFrame:
    """A user's aggregate over a Series of a group's values, in Arrow batches; a group must fit in memory."""
    import pandas as pd

    def f(v: pd.Series) -> float:
        return reduce_values(v)

    f.__annotations__ = {"v": pd.Series, "return": float}
    return df.groupBy(*keys).agg(F.pandas_udf(f, kind)(F.col(column)).alias(alias))
