"""Views: a frozen configuration and a table in, one DataFrame plan out.

- flat: filter, search, sort, limit, page.
- one-sided: ROLLUP over the row pivots, one row for each pivot prefix.
- two-sided: GROUPING SETS over {row prefixes} x {column prefixes}, long or crossed.

``level`` (``row_level``, ``col_level``) says how many pivots a row has, so that a null
key is never taken for a subtotal.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ITEMS, PERCENT, Agg, ConfigError, Having, Limit, Pivot, ViewConfig
from ..functions import aggregates as A
from ..functions import computed, levels
from ..operators import filters, search
from .stable import placed

MAX_COLUMNS = 2000


def key_column(p: Pivot) -> Column:
    c = F.col(p.column)
    if p.bins is not None:
        return p.bins.middle(c)
    return levels.LEVELS[p.level](c) if p.level else c


def key_name(p: Pivot) -> str:
    return f"{p.column}_{p.level}" if p.level else f"{p.column}_bin" if p.bins else p.column


def source(df: DataFrame, v: ViewConfig, now: datetime | None = None) -> DataFrame:
    """Computed columns, filters and search, in this order."""
    for name, text in v.computed.items():
        df = df.withColumn(name, computed.parse(text)[0])
    df = filters.apply(df, v.filters, v.filter_op, now)
    return search.apply(df, v.search) if v.search else df


def order(df: DataFrame, sort: tuple[tuple[str, str], ...], key: str | None = None) -> list[Column]:
    """Strings without regard to case, nulls last in either direction, the key last of all."""
    out = []
    for c, how in sort:
        how = how.removeprefix("col ")
        if how == "none":
            continue
        x = F.col(c)
        x = F.lower(x) if df.schema[c].dataType.typeName() == "string" else F.abs(x) if how.endswith("abs") else x
        out.append(x.asc_nulls_last() if how.startswith("asc") else x.desc_nulls_last())
    return out + ([F.col(key)] if key else [])


def count_of(n: float, kind: str, total: int) -> int:
    return max(1, int(total * n // 100)) if kind == PERCENT else max(1, int(n))


def flat(df: DataFrame, v: ViewConfig, now: datetime | None = None) -> DataFrame:
    df = source(df, v, now)
    cols = list(v.columns) or df.columns
    by = order(df, v.sort, v.key)
    if v.top and v.top[1] == PERCENT:
        df = first_share(df, by, v.top[0])
    elif v.top:
        df = df.orderBy(*by).limit(count_of(v.top[0], ITEMS, 0))
    elif by:
        df = df.orderBy(*by)
    if v.items_per_page:
        df = page(df, by, v.page_num, v.items_per_page)
    return df.select(*cols)


def first_share(df: DataFrame, by: list[Column], percent: float) -> DataFrame:
    """The first rows in an order, a share of all, one at least."""
    return placed(df, by).where(F.col("__place") < F.greatest(F.lit(1), F.floor(F.col("__all") * percent / 100))).drop("__place", "__all")


def page(df: DataFrame, by: list[Column], number: int, size: int) -> DataFrame:
    """Rows of a 1-based page: a sort with a limit and an offset, so that no task orders the whole table."""
    return (df.orderBy(*by) if by else df).offset((number - 1) * size).limit(size)


def window_of_data(df: DataFrame, by: list[Column], start_row: int = 0, end_row: int | None = None, start_col: int = 0, end_col: int | None = None) -> DataFrame:
    d = (df.orderBy(*by) if by else df).offset(start_row)
    d = d.limit(end_row - start_row) if end_row is not None else d
    return d.select(*df.columns[start_col:end_col])


def _inputs(df: DataFrame, v: ViewConfig) -> DataFrame:
    """Pivot keys under their names, lists unnested; aggregate inputs under names of their own, so that no key hides them."""
    for p in (*v.row_pivots, *v.column_pivots):
        if p.unnest or df.schema[p.column].dataType.typeName() == "array":
            df = levels.unnest(df, p.column)
    keys = [key_column(p).alias(key_name(p)) for p in (*v.row_pivots, *v.column_pivots)]
    ins = []
    for name, a in v.aggregates.items():
        if a.op in A.AFTER:
            continue
        by = a.by or v.key
        if a.op in A.ORDERED and by is None:
            raise ConfigError(f"{a.op} needs a key or an order")
        ins.append((F.col(a.column) if a.column else F.lit(1)).alias(f"__in_{name}"))
        if by and a.op in (*A.ORDERED, "weighted mean"):
            ins.append(F.col(by).alias(f"__by_{name}"))
    return df.select(*keys, *ins)


def _aggregate(d: DataFrame, v: ViewConfig, sets: list[list[str]], keys: list[str]) -> DataFrame:
    """All aggregates for all grouping sets; a bit for each key says whether a row lacks it."""
    one, two = [], {}
    for name, a in v.aggregates.items():
        if a.op in A.TWO_PHASE:
            two[name] = a
        elif a.op not in A.AFTER:
            kind = d.schema[f"__in_{name}"].dataType.typeName()
            by = F.col(f"__by_{name}") if f"__by_{name}" in d.columns else None
            one.append(A.ONE_PASS[a.op](F.col(f"__in_{name}"), by, kind).alias(name))
    marks = [F.grouping(k).alias(f"__g_{k}") for k in keys]
    grouped = lambda e: e.groupingSets([[F.col(k) for k in s] for s in sets], *keys)
    if keys and len(sets) > 1 and A.in_parts([a.op for a in v.aggregates.values() if a.op not in (*A.TWO_PHASE, *A.AFTER)]):
        # the finest groups first, so that it is they and not the rows that are expanded by the grouping sets
        parts, one = [F.count(F.lit(1)).alias("__n")], [F.sum("__n").alias("__n")]
        for name, a in v.aggregates.items():
            if a.op not in (*A.TWO_PHASE, *A.AFTER):
                for k, (part, _) in A.PARTS[a.op].items():
                    parts.append(part(F.col(f"__in_{name}")).alias(f"__{k}_{name}"))
                one.append(A.whole(a.op, name, d.schema[f"__in_{name}"].dataType.typeName()).alias(name))
        out = grouped(d.groupBy(*keys).agg(*parts)).agg(*marks, *one)
    elif keys:
        out = grouped(d).agg(*marks, *(one or [F.count(F.lit(1)).alias("__n")]))
    else:
        out = d.agg(*(one or [F.count(F.lit(1)).alias("__n")]))
    for name, a in two.items():
        value = F.col(f"__in_{name}")
        if keys:
            c = d.groupBy(*keys, value.alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
            c = c.groupingSets([[*[F.col(k) for k in s], F.col("__v")] for s in sets], *keys, "__v").agg(*marks, F.sum("__n").alias("__n"))
        else:
            c = d.groupBy(value.alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
        on = [*keys, *[f"__g_{k}" for k in keys]]
        out = A.null_safe(out, A.by_value(c, a.op, on, name), on, "left")
    return out.drop("__n")


def _finish(out: DataFrame, v: ViewConfig) -> DataFrame:
    for name, a in v.aggregates.items():
        if a.op in A.AFTER:
            out = out.withColumn(name, A.after(a.op, F.col(a.column), F.col(a.by or a.column), a.scale))
    return out


def _depth(keys: list[str], name: str) -> Column:
    return (reduce(lambda a, b: a + b, [1 - F.col(f"__g_{k}") for k in keys]) if keys else F.lit(0)).cast("int").alias(name)


def _root() -> Column:
    return F.array().cast("array<string>")


def _path(keys: list[str], depth: Column, drop: int = 0) -> Column:
    """A key's path as text, null keys marked, so that paths can be joined and partitioned by."""
    return F.slice(F.array(*[F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("null")) for k in keys]), 1, F.greatest(depth - drop, F.lit(0)))


def _percent_of(out: DataFrame, v: ViewConfig, keys: list[str]) -> DataFrame:
    for name, a in v.aggregates.items():
        if a.op == "pct sum parent":
            out = out.withColumn("__p", _path(keys, F.col("level"))).withColumn("__up", _path(keys, F.col("level"), 1))
            parent = out.select(F.col("__p").alias("__up"), F.col("level").alias("__l"), F.col(name).alias("__total"))
            out = out.withColumn("__l", F.greatest(F.col("level") - 1, F.lit(0))).join(parent, ["__up", "__l"], "left")
            out = out.withColumn(name, F.when(F.col("level") == 0, 100.0).when(F.col("__total") != 0, 100.0 * F.col(name) / F.col("__total"))).drop("__p", "__up", "__l", "__total")
        elif a.op == "pct sum grand total":
            total = out.where("level = 0").select(F.col(name).alias("__total"))
            out = A.null_safe(out, total, []).withColumn(name, F.when(F.col("__total") != 0, 100.0 * F.col(name) / F.col("__total"))).drop("__total")
    return out


def constrain(d: DataFrame, v: ViewConfig, keys: list[str]) -> DataFrame:
    """Base rows that survive having and limits: from the deepest level up, each level on what is left below."""
    for depth in range(len(keys), 0, -1):
        here = [h for h in v.havings if h.level == depth] + [x for x in v.limits if x.level == depth]
        if not here:
            continue
        at = keys[:depth]
        agg = _finish(_aggregate(d, v, [at], at), v)
        for h in here:
            if isinstance(h, Having):
                p = filters._scalar(h.op, F.col(h.aggregate), h.value, agg.schema[h.aggregate].dataType.typeName())
                agg = agg.where(p) if p is not None else agg
            else:
                agg = _limited(agg, h, at)
        d = A.null_safe(d, agg.select(*at), at, "left_semi")
    return d


def _limited(agg: DataFrame, x: Limit, at: list[str]) -> DataFrame:
    w = Window.partitionBy(*at[:-1])
    c = F.col(x.by)
    rank = F.row_number().over(w.orderBy(c.desc_nulls_last() if x.descending else c.asc_nulls_last(), F.col(at[-1])))
    most = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(w) * x.n / 100)) if x.kind == PERCENT else F.lit(max(1, int(x.n)))
    return agg.withColumn("__k", rank).withColumn("__m", most).where("__k <= __m").drop("__k", "__m")


def one_sided(df: DataFrame, v: ViewConfig, now: datetime | None = None) -> DataFrame:
    """Columns: the pivot keys, level, the aggregates. The total row has level 0."""
    keys = [key_name(p) for p in v.row_pivots]
    d = constrain(_inputs(source(df, v, now), v), v, keys)
    deepest = len(keys) if v.row_pivot_depth is None else min(v.row_pivot_depth, len(keys))
    out = _finish(_aggregate(d, v, [keys[:k] for k in range(deepest + 1)], keys), v)
    out = out.withColumn("level", _depth(keys, "level"))
    out = _percent_of(out, v, keys)
    for name, a in v.aggregates.items():
        if a.op == "distinct leaf":
            out = out.withColumn(name, F.when(F.col("level") == len(keys), F.col(name)))
    for k, p in enumerate(v.row_pivots, 1):
        if not p.subtotal and k < len(keys):
            for name in v.aggregates:
                out = out.withColumn(name, F.when(F.col("level") != k, F.col(name)))
    out = shown(out, v, keys, [])
    out = out.select(*keys, "level", *v.aggregates)
    if v.sort:
        out = sort_tree(out, keys, v.sort)
    return out


def sort_tree(out: DataFrame, keys: list[str], sort: tuple[tuple[str, str], ...]) -> DataFrame:
    """Children in the order of an aggregate or key below their parent; a parent stands before its children."""
    name, how = sort[0]
    c = F.abs(F.col(name)) if how.endswith("abs") else F.col(name)
    by: list[Column] = []
    columns = out.columns
    for k in range(1, len(keys) + 1):
        w = Window.partitionBy(*[F.col(x) for x in keys[:k]], (F.col("level") >= k))
        own = F.max(F.when(F.col("level") == k, c)).over(w)
        out = out.withColumn(f"__own{k}", own)
        own = F.col(f"__own{k}")
        by += [(F.col("level") >= k).asc(), own.desc_nulls_last() if how.removeprefix("col ").startswith("desc") else own.asc_nulls_last(), F.col(keys[k - 1]).asc_nulls_first()]
    return out.orderBy(*by).select(*columns)


def two_sided(df: DataFrame, v: ViewConfig, now: datetime | None = None) -> DataFrame:
    """Long form: row keys, column keys, row_level, col_level, aggregates."""
    rows, cols = [key_name(p) for p in v.row_pivots], [key_name(p) for p in v.column_pivots]
    d = constrain(_inputs(source(df, v, now), v), v, rows)
    sets = [rows[:i] + cols[:j] for i in range(len(rows) + 1) for j in range(len(cols) + 1)]
    out = _finish(_aggregate(d, v, sets, rows + cols), v)
    out = out.withColumn("row_level", _depth(rows, "row_level")).withColumn("col_level", _depth(cols, "col_level"))
    return shown(out, v, rows, cols).select(*rows, *cols, "row_level", "col_level", *v.aggregates)


def shown(out: DataFrame, v: ViewConfig, rows: list[str], cols: list[str]) -> DataFrame:
    """Show types, from the finished cells."""
    if not any(s != "default" for s in v.show.values()):
        return out
    two = bool(cols)
    rl = F.col("row_level" if two else "level")
    cl = F.col("col_level") if two else F.lit(0)
    out = out.withColumn("__row", _path(rows, rl) if rows else _root()).withColumn("__col", _path(cols, cl) if two else _root()).withColumn("__rl", rl).withColumn("__cl", cl)
    for name, how in v.show.items():
        c = F.col(name)
        if how == "default":
            continue
        if how in ("running_total", "running_%"):
            leaf = F.col("__rl") == len(rows)
            w = Window.partitionBy("__col", "__cl", leaf).orderBy(*[F.col(r).asc_nulls_first() for r in rows]).rowsBetween(Window.unboundedPreceding, 0)
            run = F.when(leaf, F.sum(c).over(w)).otherwise(c)
            if how == "running_total":
                out = out.withColumn(name, run)
                continue
            out = out.withColumn("__run", run)
            out = _against(out, name, _root(), F.lit(0), F.col("__col"), F.col("__cl"), F.col("__run")).drop("__run")
        elif how == "%_of_row":
            out = _against(out, name, F.col("__row"), F.col("__rl"), _root(), F.lit(0), c)
        elif how == "%_of_column":
            out = _against(out, name, _root(), F.lit(0), F.col("__col"), F.col("__cl"), c)
        elif how == "%_of_grand_total":
            out = _against(out, name, _root(), F.lit(0), _root(), F.lit(0), c)
        elif how == "%_of_parent_row":
            out = _against(out, name, _path(rows, F.col("__rl"), 1) if rows else F.col("__row"), F.col("__rl") - 1, F.col("__col"), F.col("__cl"), c)
        elif how == "%_of_parent_column":
            out = _against(out, name, F.col("__row"), F.col("__rl"), _path(cols, F.col("__cl"), 1), F.col("__cl") - 1, c) if two else out.withColumn(name, F.lit(100.0))
        elif how == "diff_from_prev_value":
            p = F.col(f"{name}_previous")
            out = out.withColumn(name, F.when(p.isNull(), c).otherwise(c - p))
        elif how == "%_of_prev_value":
            p = F.col(f"{name}_previous")
            out = out.withColumn(name, F.when(p != 0, 100.0 * c / p))
    return out.drop("__row", "__col", "__rl", "__cl")


def _against(out: DataFrame, name: str, row: Column, rl: Column, col: Column, cl: Column, value: Column) -> DataFrame:
    """100 * value / the cell at (row, col); none if that cell is absent or 0."""
    cells = out.select(F.col("__row").alias("__br"), F.col("__rl").alias("__brl"), F.col("__col").alias("__bc"), F.col("__cl").alias("__bcl"), F.col(name).alias("__base"))
    j = out.withColumn("__v", value).withColumn("__br", row).withColumn("__brl", rl).withColumn("__bc", col).withColumn("__bcl", cl)
    j = j.join(cells, ["__br", "__brl", "__bc", "__bcl"], "left")
    return j.withColumn(name, F.when(F.col("__base") != 0, 100.0 * F.col("__v") / F.col("__base"))).drop("__br", "__brl", "__bc", "__bcl", "__base", "__v")


CUT = "__columns_left_out__"


def crossed(long: DataFrame, rows: list[str], cols: list[str], values: list[str], flat_names: bool = False, descending: bool = False, most: int = MAX_COLUMNS) -> DataFrame:
    """The long form with one column for each column path and value, of at most ``most`` paths.

    Where there are more, the column ``__columns_left_out__`` says so in each row.
    """
    sep = " - " if flat_names else "|"
    label = F.when(F.col("col_level") == 0, "TOTAL").otherwise(F.array_join(F.slice(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in cols]), 1, F.col("col_level")), sep))
    d = long.withColumn("__label", label)
    labels = [r[0] for r in d.select("__label").distinct().orderBy(F.col("__label").desc() if descending else F.col("__label")).limit(most + 1).collect()]
    flag = [F.lit(True).alias(CUT)] if len(labels) > most else []
    labels = labels[:most]
    out = d.groupBy(*rows, "row_level").pivot("__label", labels).agg(*[F.first(x, ignorenulls=True).alias(x) for x in values])
    if len(values) == 1:
        return out.select(*rows, "row_level", *[F.col(f"`{x}`").alias(f"{x}{sep}{values[0]}") for x in labels], *flag)
    return out.select(*rows, "row_level", *[F.col(f"`{x}_{y}`").alias(f"{x}{sep}{y}") for x in labels for y in values], *flag)


def nested(out: DataFrame, keys: list[str], level: str = "level") -> DataFrame:
    """The nested form: one path of keys as text, from the outermost, in place of a column for each pivot."""
    path = F.slice(F.array(*[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys]), 1, F.col(level))
    return out.select(path.alias("__ROW_PATH__"), *[c for c in out.columns if c not in (*keys, level)])


def combined(out: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    """Several aggregates as one more row level: (ids, field, value)."""
    return out.unpivot(ids, values, "field", "value")


def period_view(df: DataFrame, v: ViewConfig, column: str, op: str, now: datetime) -> DataFrame:
    """A one-sided view over a named range, with ``<aggregate>_previous`` for the period before it, in one scan."""
    from ..operators import dates

    lo, hi = dates.named_range(op, now)
    before = dates.previous_start(op, now)
    c = F.col(column)
    current = c >= F.lit(lo) if hi is None else (c >= F.lit(lo)) & (c < F.lit(hi))
    d = source(df, v, now).where((c >= F.lit(before)) & (current | (c < F.lit(lo)))).withColumn("__p", F.when(current, 1).otherwise(2))
    aggs = {}
    for name, a in v.aggregates.items():
        if a.op not in ("sum", "count", "avg", "mean", "min", "max", "low", "high"):
            raise ConfigError(f"no previous period for {a.op}")
        for k, suffix in ((1, ""), (2, "_previous")):
            d = d.withColumn(f"__{name}{suffix}", F.when(F.col("__p") == k, F.col(a.column) if a.column else F.lit(1)))
            op_ = "sum" if a.op == "count" else a.op
            aggs[name + suffix] = Agg(op_, f"__{name}{suffix}")
    inner = ViewConfig(row_pivots=v.row_pivots, aggregates=aggs, key=v.key)
    out = one_sided(d, inner, now)
    keys = [key_name(p) for p in v.row_pivots]
    return shown(out, ViewConfig(row_pivots=v.row_pivots, aggregates=aggs, show=v.show), keys, []).select(*keys, "level", *aggs)


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, sum, average, minimum and maximum of a selection."""
    return df.select(*columns).agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("count", F.count), ("sum", F.sum), ("avg", F.avg), ("min", F.min), ("max", F.max))])


def build(df: DataFrame, v: ViewConfig, now: datetime | None = None) -> DataFrame:
    return (flat, one_sided, two_sided)[v.sides](df, v, now)
