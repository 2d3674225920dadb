"""The registered queries of the engine, each with the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PERCENT, Agg, Filter, Having, Limit, Pivot, ViewConfig
from ..functions import aggregates, computed, levels
from ..functions.levels import Bins
from ..operators import search, updates
from ..operators.filters import GroupFilter
from ..operators.search import Search
from ..sources import build, ingest
from ..streaming import keyed
from ..table import longest_text
from . import surface, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
NOW = datetime(1998, 7, 15, 12)


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


def rounded(df: DataFrame, digits: int = 2) -> DataFrame:
    return df.select(*[F.round(f.name, digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f"`{f.name}`") for f in df.schema])


# --- filters -------------------------------------------------------------------------------------
_ORDERS = ("o_orderkey", "o_totalprice", "o_orderpriority")


def _filter(name: str, f, where: str, prepare: Callable[[DataFrame], DataFrame] = lambda d: d, table: str = "orders", columns: tuple[str, ...] = _ORDERS, source: str | None = None, op: str = "and") -> None:
    fs = f if isinstance(f, list) else [f]
    add(f"filter_{name}", lambda s, d: view.flat(prepare(t(s, d, table)), ViewConfig(columns=columns, filters=tuple(fs), filter_op=op), NOW), f"SELECT {', '.join(columns)} FROM {source or table} WHERE {where}")


_filter("lt", Filter("o_totalprice", "<", 50000.0), "o_totalprice < 50000")
_filter("le", Filter("o_totalprice", "<=", 50000.0), "o_totalprice <= 50000")
_filter("gt", Filter("o_totalprice", ">", 150000.0), "o_totalprice > 150000")
_filter("ge", Filter("o_totalprice", ">=", 150000.0), "o_totalprice >= 150000")
_filter("eq", Filter("o_orderpriority", "==", "1-urgent"), "lower(o_orderpriority) = '1-urgent'")
_filter("eq_number", Filter("o_orderkey", "==", 7), "o_orderkey = 7")
_filter("begins_with", Filter("o_orderpriority", "begins with", "2-h"), "starts_with(lower(o_orderpriority), '2-h')")
_filter("ends_with", Filter("o_orderpriority", "ends with", "LOW"), "ends_with(lower(o_orderpriority), 'low')")
_filter("contains", Filter("o_orderkey", "contains", "77"), "contains(CAST(o_orderkey AS VARCHAR), '77')")
_filter("in", Filter("o_orderpriority", "in", ["1-URGENT", "5-low"]), "lower(o_orderpriority) IN ('1-urgent', '5-low')")
_filter("between", Filter("o_totalprice", "between", [90000.0, 60000.0]), "o_totalprice >= 60000 AND o_totalprice < 90000")
_filter("before", Filter("o_orderdate", "before", date(1995, 3, 1)), "o_orderdate < TIMESTAMP '1995-03-01'")
_filter("after", Filter("o_orderdate", "after", date(1998, 1, 1)), "o_orderdate > TIMESTAMP '1998-01-01'")
_filter("any_of", [Filter("o_totalprice", "<", 20000.0), Filter("o_orderkey", "<", 50)], "o_totalprice < 20000 OR o_orderkey < 50", op="or")
_filter("ignore_all", Filter("o_orderkey", "ignore all"), "FALSE")
_filter("no_value", Filter("o_totalprice", ">", None), "TRUE")
_filter("all_date_range", Filter("o_orderdate", "all date range"), "TRUE")
_filter("group", GroupFilter(((("o_orderpriority", ("1-URGENT", "2-HIGH")), ("o_orderstatus", ("F",))), (("o_orderstatus", ("P",)),))), "(o_orderpriority NOT IN ('1-URGENT', '2-HIGH') OR o_orderstatus NOT IN ('F')) AND o_orderstatus NOT IN ('P')")

for _n, _op, _w in (
    ("last_7_days", "last 7 days", "o_orderdate >= TIMESTAMP '1998-07-08'"),
    ("last_10_days", "last 10 days", "o_orderdate >= TIMESTAMP '1998-07-05'"),
    ("last_30_days", "last 30 days", "o_orderdate >= TIMESTAMP '1998-06-15'"),
    ("today", "today", "o_orderdate >= TIMESTAMP '1998-07-15' AND o_orderdate < TIMESTAMP '1998-07-16'"),
    ("yesterday", "yesterday", "o_orderdate >= TIMESTAMP '1998-07-14' AND o_orderdate < TIMESTAMP '1998-07-15'"),
    ("this_week", "this week", "o_orderdate >= TIMESTAMP '1998-07-12' AND o_orderdate < TIMESTAMP '1998-07-19'"),
    ("last_week", "last week", "o_orderdate >= TIMESTAMP '1998-07-05' AND o_orderdate < TIMESTAMP '1998-07-12'"),
    ("this_month", "this month", "o_orderdate >= TIMESTAMP '1998-07-01' AND o_orderdate < TIMESTAMP '1998-08-01'"),
    ("last_month", "last month", "o_orderdate >= TIMESTAMP '1998-06-01' AND o_orderdate < TIMESTAMP '1998-07-01'"),
    ("this_quarter", "this quarter", "o_orderdate >= TIMESTAMP '1998-07-01' AND o_orderdate < TIMESTAMP '1998-10-01'"),
    ("last_quarter", "last quarter", "o_orderdate >= TIMESTAMP '1998-04-01' AND o_orderdate < TIMESTAMP '1998-07-01'"),
    ("this_year", "this year", "o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'"),
    ("last_year", "last year", "o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'"),
    ("year_to_date", "year to date", "o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1998-07-16'"),
):
    _filter(_n, Filter("o_orderdate", _op), _w)
_filter("relative_previous", Filter("o_orderdate", "relative date", ("previous", 2, "months")), "o_orderdate >= TIMESTAMP '1998-05-01' AND o_orderdate < TIMESTAMP '1998-07-01'")
_filter("relative_this", Filter("o_orderdate", "relative date", ("this", 1, "quarters")), "o_orderdate >= TIMESTAMP '1998-07-01' AND o_orderdate < TIMESTAMP '1998-10-01'")
_filter("relative_next", Filter("o_orderdate", "relative date", ("next", 2, "weeks")), "o_orderdate >= TIMESTAMP '1998-07-19' AND o_orderdate < TIMESTAMP '1998-08-02'")
_filter("level_year", Filter("o_orderdate", "==", 1995, level="year"), "year(o_orderdate) = 1995")
_filter("level_month", Filter("o_orderdate", "==", "March", level="month"), "month(o_orderdate) = 3")
_filter("bin_label", Filter("o_totalprice", "==", "50000 - 99999", bins=Bins(0, 500000, 50000)), "o_totalprice >= 50000 AND o_totalprice < 100000")

_nulls = lambda d: d.withColumn("prio", F.when(F.col("o_orderstatus") != "O", F.col("o_orderpriority")))
_NULLS = "(SELECT *, CASE WHEN o_orderstatus <> 'O' THEN o_orderpriority END AS prio FROM orders)"
_with_nulls = lambda name, f, where: _filter(name, f, where, _nulls, columns=("o_orderkey", "prio"), source=_NULLS)
_with_nulls("ne", Filter("prio", "!=", "1-urgent"), "prio IS NULL OR lower(prio) <> '1-urgent'")
_with_nulls("not_contain", Filter("prio", "not contain", "low"), "prio IS NULL OR NOT contains(lower(prio), 'low')")
_with_nulls("not_in", Filter("prio", "not in", ["1-URGENT"]), "prio IS NOT NULL AND lower(prio) <> '1-urgent'")
_with_nulls("is_none", Filter("prio", "is None"), "prio IS NULL")
_with_nulls("is_not_none", Filter("prio", "is not None"), "prio IS NOT NULL")
_with_nulls("empty", Filter("prio", "empty"), "prio IS NULL")
_with_nulls("not_empty", Filter("prio", "not empty"), "prio IS NOT NULL")
_with_nulls("lt_null", Filter("prio", "<", "3"), "lower(prio) < '3'")
_flags = lambda d: d.withColumn("big", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") > 100000)).withColumn("root", F.sqrt(F.col("o_totalprice") - 100000))
_FLAGS = "(SELECT *, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice > 100000 END AS big FROM orders)"
_filter("is_true", Filter("big", "is true"), "coalesce(big, FALSE)", _flags, columns=("o_orderkey",), source=_FLAGS)
_filter("is_false", Filter("big", "is false"), "NOT coalesce(big, TRUE)", _flags, columns=("o_orderkey",), source=_FLAGS)
_filter("is_nan", Filter("root", "is nan"), "o_totalprice < 100000", _flags, columns=("o_orderkey",))
_filter("is_not_nan", Filter("root", "is not nan"), "o_totalprice >= 100000", _flags, columns=("o_orderkey",))

_words = lambda d: d.withColumn("words", F.split(F.concat_ws(" ", "p_name", "p_type"), " ")).withColumn("sizes", F.array("p_size", F.col("p_size") * 2)).withColumn("flags", F.array(F.col("p_size") > 25)).withColumn("days", F.array(F.date_add(F.lit(date(2020, 1, 1)), F.col("p_size"))))
_WORDS = "(SELECT *, string_split(p_name || ' ' || p_type, ' ') AS words, [p_size, p_size * 2] AS sizes FROM part)"
for _n, _f, _w in (
    ("in_any", Filter("words", "in (any)", ["bolt", "PROMO", "ring"]), "list_has_any(words, ['bolt', 'PROMO', 'ring'])"),
    ("in_all", Filter("words", "in (all)", ["ring"]), "list_has_all(words, ['ring'])"),
    ("list_in", Filter("words", "in", ["RING"]), "len([x FOR x IN words IF lower(x) = 'ring']) > 0"),
    ("list_not_in", Filter("words", "not in", ["RING"]), "len([x FOR x IN words IF lower(x) <> 'ring']) > 0"),
    ("list_empty", Filter("words", "empty"), "len(words) = 0"),
    ("element_equals", Filter("words", "element equals", "RING"), "len([x FOR x IN words IF lower(x) = 'ring']) > 0"),
    ("element_not_equals", Filter("words", "element not equals", "RING"), "len([x FOR x IN words IF lower(x) = 'ring']) = 0"),
    ("element_contains", Filter("words", "element contains", "idge"), "len([x FOR x IN words IF contains(lower(x), 'idge')]) > 0"),
    ("element_not_contains", Filter("words", "element not contains", "idge"), "len([x FOR x IN words IF contains(lower(x), 'idge')]) = 0"),
    ("element_begins_with", Filter("words", "element begins with", "sm"), "len([x FOR x IN words IF starts_with(lower(x), 'sm')]) > 0"),
    ("element_ends_with", Filter("words", "element ends with", "ll"), "len([x FOR x IN words IF ends_with(lower(x), 'll')]) > 0"),
    ("element_greater", Filter("sizes", "element greater", 90), "p_size * 2 > 90"),
    ("element_greater_or_equal", Filter("sizes", "element greater or equal", 90), "p_size * 2 >= 90"),
    ("element_less", Filter("sizes", "element less", 5), "p_size < 5"),
    ("element_less_or_equal", Filter("sizes", "element less or equal", 5), "p_size <= 5"),
    ("element_in", Filter("sizes", "element in", [4, 8]), "p_size IN (2, 4, 8)"),
    ("element_not_in", Filter("sizes", "element not in", [4, 8]), "p_size NOT IN (2, 4, 8)"),
    ("element_between", Filter("sizes", "element between", [10, 12]), "p_size IN (5, 6, 10, 11, 12)"),
    ("element_is_true", Filter("flags", "element is true"), "p_size > 25"),
    ("element_is_false", Filter("flags", "element is false"), "p_size <= 25"),
    ("element_before", Filter("days", "element before", date(2020, 1, 6)), "p_size < 5"),
    ("element_after", Filter("days", "element after", date(2020, 1, 6)), "p_size > 5"),
):
    _filter(_n, _f, _w, _words, "part", ("p_partkey", "p_type", "p_size"), _WORDS)

# --- flat views ----------------------------------------------------------------------------------
add("flat_sort_top_n", lambda s, d: view.flat(t(s, d, "orders"), ViewConfig(columns=_ORDERS, sort=(("o_orderpriority", "asc"), ("o_totalprice", "desc")), key="o_orderkey", top=(50, "Items"))), "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders ORDER BY lower(o_orderpriority), o_totalprice DESC, o_orderkey LIMIT 50")
add("flat_top_percent", lambda s, d: view.flat(t(s, d, "orders"), ViewConfig(columns=("o_orderkey",), sort=(("o_totalprice", "desc"),), key="o_orderkey", top=(1, PERCENT))), "SELECT o_orderkey FROM orders QUALIFY row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) <= greatest(1, floor((SELECT count(*) FROM orders) * 1 / 100))")
add("flat_sort_abs", lambda s, d: view.flat(t(s, d, "customer"), ViewConfig(columns=("c_custkey", "c_acctbal"), sort=(("c_acctbal", "asc abs"),), key="c_custkey", top=(40, "Items"))), "SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal), c_custkey LIMIT 40")
add("flat_sort_hidden", lambda s, d: view.flat(t(s, d, "customer"), ViewConfig(columns=("c_name",), sort=(("c_acctbal", "desc"),), key="c_custkey", top=(25, "Items"))), "SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
add("flat_sort_nulls_last", lambda s, d: view.flat(_nulls(t(s, d, "orders")), ViewConfig(columns=("o_orderkey", "prio"), sort=(("prio", "desc"),), key="o_orderkey", top=(60, "Items"))), f"SELECT o_orderkey, prio FROM {_NULLS} ORDER BY lower(prio) DESC NULLS LAST, o_orderkey LIMIT 60")
add("pagination", lambda s, d: view.flat(t(s, d, "orders"), ViewConfig(columns=("o_orderkey",), sort=(("o_totalprice", "asc"),), key="o_orderkey", items_per_page=20, page_num=3)), "SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20 OFFSET 40")
add("data_window", lambda s, d: view.window_of_data(t(s, d, "customer"), [F.col("c_custkey")], 10, 30, 0, 2), "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 10")
add("projection", lambda s, d: view.flat(t(s, d, "supplier"), ViewConfig(columns=("s_suppkey", "s_name"))), "SELECT s_suppkey, s_name FROM supplier")
add("rename", lambda s, d: t(s, d, "nation").withColumnsRenamed({"n_name": "country"}).select("n_nationkey", "country"), "SELECT n_nationkey, n_name AS country FROM nation")
add("longest_text", lambda s, d: longest_text(t(s, d, "part").select("p_name", "p_brand", "p_type")), "SELECT first(p_name ORDER BY -length(p_name), p_name) AS p_name, first(p_brand ORDER BY -length(p_brand), p_brand) AS p_brand, first(p_type ORDER BY -length(p_type), p_type) AS p_type FROM part")
add("selection_summary", lambda s, d: rounded(view.summary(t(s, d, "customer"), ["c_acctbal"])), "SELECT count(c_acctbal) AS c_acctbal_count, round(sum(c_acctbal), 2) AS c_acctbal_sum, round(avg(c_acctbal), 2) AS c_acctbal_avg, round(min(c_acctbal), 2) AS c_acctbal_min, round(max(c_acctbal), 2) AS c_acctbal_max FROM customer")

# --- aggregates over a two-level row pivot ---------------------------------------------------------
_LEVEL = "CAST(2 - grouping(l_returnflag) - grouping(l_linestatus) AS INTEGER) AS level"
_ROLL = "FROM {} GROUP BY ROLLUP (l_returnflag, l_linestatus)"
_FLAGGED = ("l_returnflag", "l_linestatus")
_lines = lambda d: d.withColumn("id", (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")).withColumn("qty", F.when(F.col("l_linenumber") != 3, F.col("l_quantity").cast("long"))).withColumn("mode", F.when(F.col("l_linenumber") != 3, (F.col("l_partkey") % 7).cast("long"))).withColumn("odd", F.col("l_linenumber") > 1)
_LINES = "(SELECT *, (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey AS id, CASE WHEN l_linenumber <> 3 THEN CAST(l_quantity AS BIGINT) END AS qty, CASE WHEN l_linenumber <> 3 THEN CAST(l_partkey % 7 AS BIGINT) END AS mode, l_linenumber > 1 AS odd FROM lineitem)"


def _agg(name: str, a: Agg, sql: str, cast: str | None = None, digits: int = 2) -> None:
    def run(s: SparkSession, d: str) -> DataFrame:
        out = view.one_sided(_lines(t(s, d, "lineitem")), ViewConfig(row_pivots=_FLAGGED, aggregates={"x": a}, key="id"))
        return rounded(out.withColumn("x", F.col("x").cast(cast)) if cast else out, digits)

    add(f"agg_{name}", run, f"SELECT l_returnflag, l_linestatus, {_LEVEL}, {sql} AS x {_ROLL.format(_LINES)}")


_agg("sum", Agg("sum", "l_quantity"), "round(sum(l_quantity), 2)")
_agg("sum_integer", Agg("sum", "qty"), "CAST(coalesce(sum(qty), 0) AS BIGINT)")
_agg("count", Agg("count", "qty"), "count(*)")
_agg("avg", Agg("avg", "qty"), "round(avg(qty), 2)")
_agg("mean", Agg("mean", "l_discount"), "round(avg(l_discount), 4)", digits=4)
_agg("mean_by_count", Agg("mean by count", "l_tax"), "round(avg(l_tax), 4)", digits=4)
_agg("weighted_mean", Agg("weighted mean", "l_extendedprice", by="qty"), "round(sum(CASE WHEN qty IS NOT NULL THEN l_extendedprice * qty END) / sum(qty), 2)")
_agg("unique", Agg("unique", "l_returnflag"), "CASE WHEN count(l_returnflag) = 0 THEN NULL WHEN count(l_returnflag) = count(*) AND min(l_returnflag) = max(l_returnflag) THEN min(l_returnflag) ELSE '-' END")
_agg("any", Agg("any", "mode"), "coalesce(arg_min(mode, id) FILTER (mode <> 0), arg_max(mode, id))")
_agg("or", Agg("or", "odd"), "bool_or(odd)")
_agg("and", Agg("and", "odd"), "bool_and(odd)")
_agg("median", Agg("median", "qty"), "list_sort(list(qty), 'ASC', 'NULLS FIRST')[count(*) // 2 + 1]")
_agg("join", Agg("join", "mode"), "array_to_string(list_sort(list_distinct(list(CAST(mode AS VARCHAR)))), ', ') || ', '")
_agg("distinct_count", Agg("distinct count", "mode"), "count(DISTINCT mode) + max(CASE WHEN mode IS NULL THEN 1 ELSE 0 END)", "long")
_agg("distinct_values", Agg("distinct values", "mode"), "array_to_string(list_sort(list_distinct(list(mode)))[1:1000], ',')")
_agg("distinct_leaf", Agg("distinct leaf", "l_linestatus"), "CASE WHEN grouping(l_linestatus) = 0 THEN min(l_linestatus) END")
_agg("first_by_index", Agg("first by index", "l_partkey", by="id"), "arg_min(l_partkey, id)")
_agg("last_by_index", Agg("last by index", "l_partkey", by="id"), "arg_max(l_partkey, id)")
_agg("last", Agg("last", "l_suppkey"), "arg_max(l_suppkey, id)")
_agg("high", Agg("high", "l_extendedprice"), "round(max(l_extendedprice), 2)")
_agg("low", Agg("low", "l_extendedprice"), "round(min(l_extendedprice), 2)")
_agg("mul", Agg("mul", "rate"), "round(exp(sum(ln(1 + l_tax / 1e6))), 4)", digits=4)
_agg("sum_abs", Agg("sum abs", "signed"), "round(sum(abs(l_quantity - 25)), 2)")
_agg("sum_not_null", Agg("sum not null", "qty"), "CAST(sum(qty) AS BIGINT)")
_agg("identity", Agg("identity", "l_linestatus"), "min(l_linestatus)")
_values = QUERIES["agg_distinct_values"]
QUERIES["agg_distinct_values"] = lambda s, d: _values(s, d).withColumn("x", F.array_join("x", ","))
for _n, _c in (("mul", "1 + l_tax / 1e6"), ("sum_abs", "l_quantity - 25")):
    _a = Agg(_n.replace("_", " "), "v")
    QUERIES[f"agg_{_n}"] = lambda s, d, a=_a, c=_c, k=4 if _n == "mul" else 2: rounded(view.one_sided(t(s, d, "lineitem").withColumn("v", F.expr(c)), ViewConfig(row_pivots=_FLAGGED, aggregates={"x": a})), k)
# the mode of a group, ties to the smallest; a group of lone values with a null has null
_DOM = f"WITH c AS (SELECT l_returnflag, l_linestatus, mode, grouping(l_returnflag) AS g1, grouping(l_linestatus) AS g2, count(*) AS n FROM {_LINES} GROUP BY GROUPING SETS ((l_returnflag, l_linestatus, mode), (l_returnflag, mode), (mode))) SELECT l_returnflag, l_linestatus, CAST(2 - g1 - g2 AS INTEGER) AS level, mode AS x FROM c QUALIFY row_number() OVER (PARTITION BY l_returnflag, l_linestatus, g1, g2 ORDER BY CASE WHEN mode IS NULL THEN 1 ELSE n END DESC, mode NULLS FIRST) = 1"
add("agg_dominant", lambda s, d: view.one_sided(_lines(t(s, d, "lineitem")), ViewConfig(row_pivots=_FLAGGED, aggregates={"x": Agg("dominant", "mode")})), _DOM)
add("agg_pct_sum_parent", lambda s, d: rounded(view.one_sided(t(s, d, "lineitem"), ViewConfig(row_pivots=_FLAGGED, aggregates={"x": Agg("pct sum parent", "l_quantity")}))), f"WITH r AS (SELECT l_returnflag, l_linestatus, {_LEVEL}, sum(l_quantity) AS v {_ROLL.format('lineitem')}) SELECT l_returnflag, l_linestatus, level, round(100 * v / CASE level WHEN 0 THEN v WHEN 1 THEN (SELECT v FROM r q WHERE q.level = 0) ELSE (SELECT v FROM r q WHERE q.level = 1 AND q.l_returnflag = r.l_returnflag) END, 2) AS x FROM r")
add("agg_pct_sum_grand_total", lambda s, d: rounded(view.one_sided(t(s, d, "lineitem"), ViewConfig(row_pivots=_FLAGGED, aggregates={"x": Agg("pct sum grand total", "l_quantity")}))), f"SELECT l_returnflag, l_linestatus, {_LEVEL}, round(100 * sum(l_quantity) / (SELECT sum(l_quantity) FROM lineitem), 2) AS x {_ROLL.format('lineitem')}")
add("agg_scaled", lambda s, d: rounded(view.one_sided(t(s, d, "lineitem"), ViewConfig(row_pivots=_FLAGGED, aggregates={"p": Agg("sum", "l_extendedprice"), "q": Agg("sum", "l_quantity"), "per": Agg("div", "p", "q"), "plus": Agg("add", "p", "q", (1.0, 2.0)), "times": Agg("scaled mul", "q", "q", (0.01, 0.01)), "same": Agg("custom", "q")}))), f"SELECT l_returnflag, l_linestatus, {_LEVEL}, round(sum(l_extendedprice), 2) AS p, round(sum(l_quantity), 2) AS q, round(sum(l_extendedprice) / sum(l_quantity), 2) AS per, round(sum(l_extendedprice) + 2 * sum(l_quantity), 2) AS plus, round(sum(l_quantity) * 0.01 * sum(l_quantity) * 0.01, 2) AS times, round(sum(l_quantity), 2) AS same {_ROLL.format('lineitem')}")


def flagship(s: SparkSession, d: str) -> DataFrame:
    v = ViewConfig(row_pivots=_FLAGGED, aggregates={"sum_qty": Agg("sum", "l_quantity"), "sum_price": Agg("sum", "l_extendedprice"), "avg_disc": Agg("avg", "l_discount"), "n": Agg("count")}, filters=(Filter("l_shipdate", "before", date(1998, 9, 2)),))
    return rounded(view.one_sided(t(s, d, "lineitem"), v), 4)


add("rollup_pricing", flagship, f"SELECT l_returnflag, l_linestatus, {_LEVEL}, round(sum(l_quantity), 4) AS sum_qty, round(sum(l_extendedprice), 4) AS sum_price, round(avg(l_discount), 4) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-09-02' GROUP BY ROLLUP (l_returnflag, l_linestatus)")
add("pivot_null_group", lambda s, d: view.one_sided(_nulls(t(s, d, "orders")), ViewConfig(row_pivots=("prio",), aggregates={"n": Agg("count")})), f"SELECT prio, CAST(1 - grouping(prio) AS INTEGER) AS level, count(*) AS n FROM {_NULLS} GROUP BY ROLLUP (prio)")

# --- levels, bins, lists ---------------------------------------------------------------------------
for _l, _sql in (("year", "year(o_orderdate)"), ("quarter", "quarter(o_orderdate)"), ("month", "month(o_orderdate) - 1"), ("week", "(dayofyear(o_orderdate) + dayofweek(date_trunc('year', o_orderdate)) + 1 - 2) // 7 + 1"), ("hour", "hour(ts)"), ("minute", "hour(ts) * 60 + minute(ts)"), ("second", "hour(ts) * 3600 + minute(ts) * 60 + second(ts)")):
    _col, _tab = ("ts", "events") if _l in ("hour", "minute", "second") else ("o_orderdate", "orders")
    add(f"level_{_l}", lambda s, d, x=_l, c=_col, n=_tab: view.one_sided(t(s, d, n), ViewConfig(row_pivots=(Pivot(c, x),), aggregates={"n": Agg("count")})).withColumnRenamed(f"{c}_{x}", "k").withColumn("k", F.col("k").cast("long")), f"WITH b AS (SELECT CAST({_sql} AS BIGINT) AS k FROM {_tab}) SELECT k, CAST(1 - grouping(k) AS INTEGER) AS level, count(*) AS n FROM b GROUP BY ROLLUP (k)")
for _l, _sql in (("day", "'2016-' || strftime(o_orderdate, '%m-%d')"), ("date", "strftime(o_orderdate, '%Y-%m-%d')")):
    add(f"level_{_l}", lambda s, d, x=_l: view.one_sided(t(s, d, "orders"), ViewConfig(row_pivots=(Pivot("o_orderdate", x),), aggregates={"n": Agg("count")})).withColumnRenamed(f"o_orderdate_{x}", "k").withColumn("k", F.col("k").cast("string")), f"WITH b AS (SELECT {_sql} AS k FROM orders) SELECT k, CAST(1 - grouping(k) AS INTEGER) AS level, count(*) AS n FROM b GROUP BY ROLLUP (k)")
add("level_labels", lambda s, d: t(s, d, "orders").select("o_orderkey", *[levels.LABELS[x](F.col("o_orderdate")).alias(x) for x in ("year", "quarter", "month", "week", "day")]), "SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR) AS year, 'Q' || quarter(o_orderdate) AS quarter, monthname(o_orderdate) AS month, 'Wk ' || CAST((dayofyear(o_orderdate) + dayofweek(date_trunc('year', o_orderdate)) - 1) // 7 + 1 AS VARCHAR) AS week, strftime(o_orderdate, '%b %d') AS day FROM orders")
add("label_clock", lambda s, d: t(s, d, "events").select("event_id", levels.LABELS["hour"](F.col("ts")).alias("hour"), levels.LABELS["minute"](F.col("ts")).alias("minute")), "SELECT event_id, CASE WHEN hour(ts) % 12 = 0 THEN '12' ELSE CAST(hour(ts) % 12 AS VARCHAR) END || ':00 ' || CASE WHEN hour(ts) < 12 THEN 'AM' ELSE 'PM' END AS hour, CASE WHEN hour(ts) % 12 = 0 THEN '12' ELSE CAST(hour(ts) % 12 AS VARCHAR) END || strftime(ts, ':%M ') || CASE WHEN hour(ts) < 12 THEN 'AM' ELSE 'PM' END AS minute FROM events")
add("bin_custom", lambda s, d: rounded(view.one_sided(t(s, d, "lineitem"), ViewConfig(row_pivots=(Pivot("l_extendedprice", bins=Bins(1000, 50000, 5000)),), aggregates={"n": Agg("count")}))), "WITH b AS (SELECT CASE WHEN l_extendedprice BETWEEN 1000 AND 50000 THEN (greatest(floor((l_extendedprice - 1000) / 5000) * 5000 + 1000, 1000) + least((floor((l_extendedprice - 1000) / 5000) + 1) * 5000 + 1000, 50000)) / 2 END AS l_extendedprice_bin FROM lineitem) SELECT l_extendedprice_bin, CAST(1 - grouping(l_extendedprice_bin) AS INTEGER) AS level, count(*) AS n FROM b GROUP BY ROLLUP (l_extendedprice_bin)")
add("bin_auto", lambda s, d: (lambda df: df.groupBy(F.round(levels.default_bins(df, "c_acctbal").middle(F.col("c_acctbal")), 3).alias("bin")).agg(F.count(F.lit(1)).alias("n")))(t(s, d, "customer")), "WITH m AS (SELECT floor(min(c_acctbal) * 100) / 100 AS lo, ceil(max(c_acctbal) * 100) / 100 AS hi, ceil(sqrt(count(*))) AS k FROM customer), p AS (SELECT lo, hi, floor((hi - lo) * 100 / k) / 100 AS size FROM m) SELECT round(floor((c_acctbal - lo) / size) * size + lo + size / 2, 3) AS bin, count(*) AS n FROM customer, p GROUP BY 1")
add("bin_labels", lambda s, d: t(s, d, "part").select("p_partkey", Bins(0, 48, 10).label(F.col("p_size")).alias("label")), "SELECT p_partkey, CASE WHEN p_size BETWEEN 0 AND 48 THEN CAST(p_size // 10 * 10 AS VARCHAR) || ' - ' || CASE WHEN p_size >= 40 THEN '48' ELSE CAST(p_size // 10 * 10 + 9 AS VARCHAR) END ELSE 'Other/Blank' END AS label FROM part")
add("list_unnest", lambda s, d: view.one_sided(_words(t(s, d, "part")), ViewConfig(row_pivots=("words",), aggregates={"n": Agg("count"), "size": Agg("sum", "p_size")})), "WITH b AS (SELECT unnest(string_split(p_name || ' ' || p_type, ' ')) AS words, p_size FROM part) SELECT words, CAST(1 - grouping(words) AS INTEGER) AS level, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS size FROM b GROUP BY ROLLUP (words)")
add("list_unnest_two", lambda s, d: levels.unnest(_words(t(s, d, "part")), "words", "sizes").groupBy("words", "sizes").agg(F.count(F.lit(1)).alias("n")), f"WITH a AS (SELECT unnest(words) AS words, sizes FROM {_WORDS}), b AS (SELECT words, unnest(sizes) AS sizes FROM a) SELECT words, sizes, count(*) AS n FROM b GROUP BY 1, 2")
add("subtotals_off", lambda s, d: rounded(view.one_sided(t(s, d, "lineitem"), ViewConfig(row_pivots=(Pivot("l_returnflag", subtotal=False), "l_linestatus"), aggregates={"x": Agg("sum", "l_quantity")}))), f"SELECT l_returnflag, l_linestatus, {_LEVEL}, CASE WHEN grouping(l_returnflag) = 0 AND grouping(l_linestatus) = 1 THEN NULL ELSE round(sum(l_quantity), 2) END AS x {_ROLL.format('lineitem')}")
add("pivot_depth", lambda s, d: rounded(view.one_sided(t(s, d, "lineitem"), ViewConfig(row_pivots=_FLAGGED, row_pivot_depth=1, aggregates={"x": Agg("sum", "l_quantity")}))).drop("l_linestatus"), "SELECT l_returnflag, CAST(1 - grouping(l_returnflag) AS INTEGER) AS level, round(sum(l_quantity), 2) AS x FROM lineitem GROUP BY ROLLUP (l_returnflag)")

# --- column pivots -----------------------------------------------------------------------------------
_CROSS = ViewConfig(row_pivots=("o_orderpriority",), column_pivots=("o_orderstatus",), aggregates={"total": Agg("sum", "o_totalprice"), "n": Agg("count")})
_CUBE = "FROM orders GROUP BY GROUPING SETS ((), (o_orderpriority), (o_orderstatus), (o_orderpriority, o_orderstatus))"
_CUBE_LEVELS = "CAST(1 - grouping(o_orderpriority) AS INTEGER) AS row_level, CAST(1 - grouping(o_orderstatus) AS INTEGER) AS col_level"
add("two_sided", lambda s, d: rounded(view.two_sided(t(s, d, "orders"), _CROSS)), f"SELECT o_orderpriority, o_orderstatus, {_CUBE_LEVELS}, round(sum(o_totalprice), 2) AS total, count(*) AS n {_CUBE}")
_cells = ", ".join(f"count(*) FILTER (o_orderstatus = '{x}') AS \"{x}|n\"" for x in "FOP")
add("two_sided_crossed", lambda s, d: view.crossed(view.two_sided(t(s, d, "orders"), _CROSS), ["o_orderpriority"], ["o_orderstatus"], ["n"]), f"SELECT o_orderpriority, CAST(1 - grouping(o_orderpriority) AS INTEGER) AS row_level, {_cells}, count(*) AS \"TOTAL|n\" FROM orders GROUP BY ROLLUP (o_orderpriority)")
add("two_sided_flat_names", lambda s, d: view.crossed(view.two_sided(t(s, d, "orders"), _CROSS), ["o_orderpriority"], ["o_orderstatus"], ["n"], flat_names=True, descending=True), f"SELECT o_orderpriority, CAST(1 - grouping(o_orderpriority) AS INTEGER) AS row_level, {_cells.replace('|n', ' - n')}, count(*) AS \"TOTAL - n\" FROM orders GROUP BY ROLLUP (o_orderpriority)")
add("column_only", lambda s, d: view.two_sided(t(s, d, "orders"), ViewConfig(column_pivots=("o_orderstatus",), aggregates={"n": Agg("count")})), "SELECT o_orderstatus, CAST(0 AS INTEGER) AS row_level, CAST(1 - grouping(o_orderstatus) AS INTEGER) AS col_level, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus)")
add("two_sided_deep", lambda s, d: view.two_sided(t(s, d, "lineitem"), ViewConfig(row_pivots=_FLAGGED, column_pivots=(Pivot("l_shipdate", "year"), "l_linenumber"), aggregates={"n": Agg("count")})).withColumn("l_shipdate_year", F.col("l_shipdate_year").cast("long")), "WITH b AS (SELECT l_returnflag, l_linestatus, year(l_shipdate) AS l_shipdate_year, l_linenumber FROM lineitem) SELECT l_returnflag, l_linestatus, l_shipdate_year, l_linenumber, CAST(2 - grouping(l_returnflag) - grouping(l_linestatus) AS INTEGER) AS row_level, CAST(2 - grouping(l_shipdate_year) - grouping(l_linenumber) AS INTEGER) AS col_level, count(*) AS n FROM b GROUP BY ROLLUP (l_returnflag, l_linestatus), ROLLUP (l_shipdate_year, l_linenumber)")
add("combined_field", lambda s, d: rounded(view.combined(view.one_sided(t(s, d, "orders"), ViewConfig(row_pivots=("o_orderstatus",), aggregates={"total": Agg("sum", "o_totalprice"), "average": Agg("avg", "o_totalprice")})), ["o_orderstatus", "level"], ["total", "average"])), "WITH r AS (SELECT o_orderstatus, CAST(1 - grouping(o_orderstatus) AS INTEGER) AS level, sum(o_totalprice) AS total, avg(o_totalprice) AS average FROM orders GROUP BY ROLLUP (o_orderstatus)) SELECT o_orderstatus, level, 'total' AS field, round(total, 2) AS value FROM r UNION ALL SELECT o_orderstatus, level, 'average', round(average, 2) FROM r")

# --- having, limits, sorted trees ----------------------------------------------------------------------
_REGION = ("c_mktsegment", "c_nationkey")
_bal = {"bal": Agg("sum", "c_acctbal"), "n": Agg("count")}
add("having_inner", lambda s, d: rounded(view.one_sided(t(s, d, "customer"), ViewConfig(row_pivots=_REGION, aggregates=_bal, havings=(Having("bal", ">", 60000.0, 2),)))), "WITH k AS (SELECT c_mktsegment, c_nationkey FROM customer GROUP BY 1, 2 HAVING sum(c_acctbal) > 60000), b AS (SELECT * FROM customer SEMI JOIN k USING (c_mktsegment, c_nationkey)) SELECT c_mktsegment, c_nationkey, CAST(2 - grouping(c_mktsegment) - grouping(c_nationkey) AS INTEGER) AS level, round(coalesce(sum(c_acctbal), 0), 2) AS bal, count(*) AS n FROM b GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
add("having_outer", lambda s, d: rounded(view.one_sided(t(s, d, "customer"), ViewConfig(row_pivots=_REGION, aggregates=_bal, havings=(Having("n", ">=", 300, 1),)))), "WITH k AS (SELECT c_mktsegment FROM customer GROUP BY 1 HAVING count(*) >= 300), b AS (SELECT * FROM customer SEMI JOIN k USING (c_mktsegment)) SELECT c_mktsegment, c_nationkey, CAST(2 - grouping(c_mktsegment) - grouping(c_nationkey) AS INTEGER) AS level, round(coalesce(sum(c_acctbal), 0), 2) AS bal, count(*) AS n FROM b GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
add("limit_children", lambda s, d: rounded(view.one_sided(t(s, d, "customer"), ViewConfig(row_pivots=_REGION, aggregates=_bal, limits=(Limit(3, "bal", 2),)))), "WITH a AS (SELECT c_mktsegment, c_nationkey, sum(c_acctbal) AS v FROM customer GROUP BY 1, 2), k AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY v DESC, c_nationkey) <= 3), b AS (SELECT * FROM customer SEMI JOIN k USING (c_mktsegment, c_nationkey)) SELECT c_mktsegment, c_nationkey, CAST(2 - grouping(c_mktsegment) - grouping(c_nationkey) AS INTEGER) AS level, round(sum(c_acctbal), 2) AS bal, count(*) AS n FROM b GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
add("limit_percent", lambda s, d: rounded(view.one_sided(t(s, d, "customer"), ViewConfig(row_pivots=_REGION, aggregates=_bal, limits=(Limit(20, "n", 2, PERCENT),)))), "WITH a AS (SELECT c_mktsegment, c_nationkey, count(*) AS v FROM customer GROUP BY 1, 2), k AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY v DESC, c_nationkey) <= greatest(1, floor(count(*) OVER (PARTITION BY c_mktsegment) * 20 / 100))), b AS (SELECT * FROM customer SEMI JOIN k USING (c_mktsegment, c_nationkey)) SELECT c_mktsegment, c_nationkey, CAST(2 - grouping(c_mktsegment) - grouping(c_nationkey) AS INTEGER) AS level, round(sum(c_acctbal), 2) AS bal, count(*) AS n FROM b GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
add("sorted_tree", lambda s, d: rounded(view.one_sided(t(s, d, "lineitem"), ViewConfig(row_pivots=_FLAGGED, aggregates={"x": Agg("sum", "l_quantity")}, sort=(("x", "desc"),)))), f"SELECT l_returnflag, l_linestatus, {_LEVEL}, round(sum(l_quantity), 2) AS x {_ROLL.format('lineitem')}")

# --- show types and periods -----------------------------------------------------------------------------
_R1 = f"WITH r AS (SELECT l_returnflag, l_linestatus, {_LEVEL}, sum(l_quantity) AS v {_ROLL.format('lineitem')}) SELECT l_returnflag, l_linestatus, level, "


def _show(name: str, how: str, sql: str) -> None:
    add(f"show_{name}", lambda s, d: rounded(view.one_sided(t(s, d, "lineitem"), ViewConfig(row_pivots=_FLAGGED, aggregates={"x": Agg("sum", "l_quantity")}, show={"x": how}))), _R1 + sql + " AS x FROM r")


_TOTAL = "(SELECT v FROM r q WHERE q.level = 0)"
_show("percent_of_row", "%_of_row", "100.0::DOUBLE")
_show("percent_of_column", "%_of_column", f"round(100 * v / {_TOTAL}, 2)")
_show("percent_of_grand_total", "%_of_grand_total", f"round(100 * v / {_TOTAL}, 2)")
_show("percent_of_parent_row", "%_of_parent_row", f"CASE level WHEN 0 THEN NULL WHEN 1 THEN round(100 * v / {_TOTAL}, 2) ELSE round(100 * v / (SELECT v FROM r q WHERE q.level = 1 AND q.l_returnflag = r.l_returnflag), 2) END")
_show("percent_of_parent_column", "%_of_parent_column", "100.0::DOUBLE")
_RUN = "CASE WHEN level = 2 THEN sum(v) OVER (PARTITION BY level ORDER BY l_returnflag, l_linestatus ROWS UNBOUNDED PRECEDING) ELSE v END"
_show("running_total", "running_total", f"round({_RUN}, 2)")
_show("running_percent", "running_%", f"round(100 * ({_RUN}) / {_TOTAL}, 2)")
_C2 = f"WITH r AS (SELECT o_orderpriority, o_orderstatus, {_CUBE_LEVELS}, sum(o_totalprice) AS v {_CUBE}) SELECT o_orderpriority, o_orderstatus, row_level, col_level, "
for _n, _how, _base in (
    ("percent_of_row", "%_of_row", "(SELECT v FROM r q WHERE q.col_level = 0 AND q.row_level = r.row_level AND q.o_orderpriority IS NOT DISTINCT FROM r.o_orderpriority)"),
    ("percent_of_column", "%_of_column", "(SELECT v FROM r q WHERE q.row_level = 0 AND q.col_level = r.col_level AND q.o_orderstatus IS NOT DISTINCT FROM r.o_orderstatus)"),
    ("percent_of_grand_total", "%_of_grand_total", "(SELECT v FROM r q WHERE q.row_level = 0 AND q.col_level = 0)"),
    ("percent_of_parent_row", "%_of_parent_row", "CASE WHEN row_level = 1 THEN (SELECT v FROM r q WHERE q.row_level = 0 AND q.col_level = r.col_level AND q.o_orderstatus IS NOT DISTINCT FROM r.o_orderstatus) END"),
    ("percent_of_parent_column", "%_of_parent_column", "CASE WHEN col_level = 1 THEN (SELECT v FROM r q WHERE q.col_level = 0 AND q.row_level = r.row_level AND q.o_orderpriority IS NOT DISTINCT FROM r.o_orderpriority) END"),
):
    add(f"show2_{_n}", lambda s, d, how=_how: rounded(view.two_sided(t(s, d, "orders"), ViewConfig(row_pivots=("o_orderpriority",), column_pivots=("o_orderstatus",), aggregates={"x": Agg("sum", "o_totalprice")}, show={"x": how}))), _C2 + f"round(100 * v / {_base}, 2) AS x FROM r")
add("show2_running_total", lambda s, d: rounded(view.two_sided(t(s, d, "orders"), ViewConfig(row_pivots=("o_orderpriority",), column_pivots=("o_orderstatus",), aggregates={"x": Agg("sum", "o_totalprice")}, show={"x": "running_total"}))), _C2 + "round(CASE WHEN row_level = 1 THEN sum(v) OVER (PARTITION BY o_orderstatus, col_level, row_level ORDER BY o_orderpriority ROWS UNBOUNDED PRECEDING) ELSE v END, 2) AS x FROM r")
_PERIOD = ViewConfig(row_pivots=("o_orderpriority",), aggregates={"total": Agg("sum", "o_totalprice"), "n": Agg("count")})
_P = "WITH b AS (SELECT *, o_orderdate >= TIMESTAMP '1998-07-01' AS cur FROM orders WHERE o_orderdate >= TIMESTAMP '1998-06-01' AND o_orderdate < TIMESTAMP '1998-08-01'), r AS (SELECT o_orderpriority, CAST(1 - grouping(o_orderpriority) AS INTEGER) AS level, coalesce(sum(o_totalprice) FILTER (cur), 0) AS total, coalesce(sum(o_totalprice) FILTER (NOT cur), 0) AS total_previous, count(*) FILTER (cur) AS n, count(*) FILTER (NOT cur) AS n_previous FROM b GROUP BY ROLLUP (o_orderpriority)) SELECT o_orderpriority, level, "
add("period_previous", lambda s, d: rounded(view.period_view(t(s, d, "orders"), _PERIOD, "o_orderdate", "this month", NOW)), _P + "round(total, 2) AS total, round(total_previous, 2) AS total_previous, n, n_previous FROM r")
add("period_diff", lambda s, d: rounded(view.period_view(t(s, d, "orders"), _PERIOD.changed(show={"total": "diff_from_prev_value"}), "o_orderdate", "this month", NOW)), _P + "round(total - total_previous, 2) AS total, round(total_previous, 2) AS total_previous, n, n_previous FROM r")
add("period_percent", lambda s, d: rounded(view.period_view(t(s, d, "orders"), _PERIOD.changed(show={"total": "%_of_prev_value"}), "o_orderdate", "this month", NOW)), _P + "CASE WHEN total_previous <> 0 THEN round(100 * total / total_previous, 2) END AS total, round(total_previous, 2) AS total_previous, n, n_previous FROM r")

# --- search ----------------------------------------------------------------------------------------------
_PART = ("p_partkey", "p_name", "p_type")
_find = lambda x: lambda s, d: search.apply(t(s, d, "part"), x).select(*_PART)
add("search_edge", _find(Search("sm ec", {"p_name": "edge", "p_type": "edge"})), "SELECT p_partkey, p_name, p_type FROM part WHERE (regexp_matches(lower(p_name), '(^|\\s)sm') OR regexp_matches(lower(p_type), '(^|\\s)sm')) AND (regexp_matches(lower(p_name), '(^|\\s)ec') OR regexp_matches(lower(p_type), '(^|\\s)ec'))")
add("search_contains", _find(Search("idge 12", {"p_name": "contains", "p_type": "contains", "p_partkey": "contains"})), "SELECT p_partkey, p_name, p_type FROM part WHERE (contains(lower(p_name), 'idge') OR contains(lower(p_type), 'idge') OR contains(CAST(p_partkey AS VARCHAR), 'idge')) AND (contains(lower(p_name), '12') OR contains(lower(p_type), '12') OR contains(CAST(p_partkey AS VARCHAR), '12'))")
add("search_equals", _find(Search("17", {"p_size": "equals", "p_name": None})), "SELECT p_partkey, p_name, p_type FROM part WHERE abs(p_size - 17) < 0.0001")
add("search_startswith", _find(Search("sta", {"p_type": "startswith"})), "SELECT p_partkey, p_name, p_type FROM part WHERE starts_with(lower(p_type), 'sta')")
add("search_exact_phrase", lambda s, d: search.apply(t(s, d, "nation"), Search("nation_1", {"n_name": "contains"}, exact=True)).select("n_nationkey", "n_name"), "SELECT n_nationkey, n_name FROM nation WHERE contains(lower(n_name), 'nation_1')")
add("search_date", lambda s, d: search.apply(t(s, d, "orders"), Search("march 1995", {"o_orderdate": "equals"})).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE month(o_orderdate) = 3 AND year(o_orderdate) = 1995")
add("suggestions", lambda s, d: search.suggestions(t(s, d, "part"), "p_type", "st", 5), "SELECT DISTINCT p_type FROM part WHERE contains(lower(p_type), 'st') ORDER BY 1 LIMIT 5")

# --- updates ------------------------------------------------------------------------------------------------
_EV = "event_id, user_id, event_type, value"
#: Batches that grow with the table and overlap: the first six tenths of the ids, and the last six tenths.
_end = lambda s, d: t(s, d, "events").select(F.max("event_id") + 1).scalar()
_early = lambda s, d: t(s, d, "events").where(F.col("event_id") * 10 < _end(s, d) * 6).select("event_id", "user_id", "event_type", "value")
_late = lambda s, d: t(s, d, "events").where(F.col("event_id") * 10 >= _end(s, d) * 4).select("event_id", "user_id", "event_type", "value")
_EARLY = "(SELECT * FROM events WHERE event_id * 10 < 6 * (SELECT max(event_id) + 1 FROM events))"
_LATE = "(SELECT * FROM events WHERE event_id * 10 >= 4 * (SELECT max(event_id) + 1 FROM events))"
_LAST = "SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type, round(arg_max(value, event_id), 4) AS value FROM {} GROUP BY user_id"
add("update_upsert", lambda s, d: rounded(updates.upsert(updates.latest(_early(s, d), "user_id", "event_id"), _late(s, d), "user_id", "event_id").select("user_id", "event_id", "event_type", "value"), 4), _LAST.format("events"))
add("update_ring", lambda s, d: rounded(updates.ring(t(s, d, "events"), 64, "event_id").select("event_id", "value"), 4), "SELECT event_id, round(value, 4) AS value FROM events QUALIFY row_number() OVER (PARTITION BY event_id % 64 ORDER BY event_id DESC) = 1")
# the same over whole tables; those above keep the id ranges that their SQL states
_LASTS = f"WITH o AS (SELECT user_id, arg_max(event_type, event_id) AS e, arg_max(value, event_id) AS v FROM {_EARLY} GROUP BY 1), n AS (SELECT user_id, arg_max(event_type, event_id) AS e FROM {_LATE} GROUP BY 1) "
add("update_append", lambda s, d: updates.append(_early(s, d), _late(s, d)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), f"SELECT event_type, count(*) AS n FROM (SELECT event_type FROM {_EARLY} UNION ALL SELECT event_type FROM {_LATE}) GROUP BY 1")
add("update_flatten", lambda s, d: rounded(updates.latest(t(s, d, "events").select("event_id", "user_id", "event_type", "value"), "user_id", "event_id").select("user_id", "event_id", "event_type", "value"), 4), _LAST.format("events"))
add("update_partial", lambda s, d: rounded(updates.partial(updates.latest(_early(s, d), "user_id", "event_id").withColumn("at", F.col("event_id")), _late(s, d).select("user_id", "event_type", F.col("event_id").alias("at")), "user_id", "at").select("user_id", "event_type", "value"), 4), _LASTS + "SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(n.e, o.e) AS event_type, round(o.v, 4) AS value FROM o FULL JOIN n ON o.user_id = n.user_id")
add("update_remove", lambda s, d: updates.remove(t(s, d, "orders"), t(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey").select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
add("update_transitions", lambda s, d: updates.transitions(updates.latest(_early(s, d), "user_id", "event_id"), updates.latest(_late(s, d), "user_id", "event_id"), "user_id", "event_type").groupBy("transition").agg(F.count(F.lit(1)).alias("n")), _LASTS + "SELECT CASE WHEN o.user_id IS NULL THEN 'added' WHEN n.user_id IS NULL THEN 'removed' WHEN o.e = n.e THEN 'same' ELSE 'changed' END AS transition, count(*) AS n FROM o FULL JOIN n ON o.user_id = n.user_id GROUP BY 1")
add("update_deltas", lambda s, d: rounded(updates.deltas(_early(s, d), _late(s, d).withColumn("value", F.col("value") * 2), "event_id", "event_type", "value"), 3), f"SELECT event_type, round(sum(v), 3) AS delta_sum, CAST(sum(n) AS BIGINT) AS delta_count FROM (SELECT event_type, -value AS v, -1 AS n FROM {_EARLY} WHERE event_id IN (SELECT event_id FROM {_LATE}) UNION ALL SELECT event_type, value * 2, 1 FROM {_LATE}) GROUP BY 1")
add("row_delta", lambda s, d: updates.row_delta(*(view.one_sided(x, ViewConfig(row_pivots=("event_type",), aggregates={"n": Agg("count")})) for x in (_early(s, d), t(s, d, "events")))), f"WITH a AS (SELECT event_type, CAST(1 - grouping(event_type) AS INTEGER) AS level, count(*) AS n FROM {_EARLY} GROUP BY ROLLUP (event_type)), b AS (SELECT event_type, CAST(1 - grouping(event_type) AS INTEGER) AS level, count(*) AS n FROM events GROUP BY ROLLUP (event_type)) SELECT * FROM b EXCEPT ALL SELECT * FROM a")
add("parent_tree", lambda s, d: updates.parent_tree(t(s, d, "nation").select("n_nationkey", F.when(F.col("n_nationkey") > 0, F.floor(F.col("n_nationkey") / 3).cast("int")).alias("up")), "n_nationkey", "up").select("n_nationkey", "depth", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path")), "WITH RECURSIVE r AS (SELECT n_nationkey, 1 AS depth, CAST(n_nationkey AS VARCHAR) AS path FROM nation WHERE n_nationkey = 0 UNION ALL SELECT n.n_nationkey, r.depth + 1, r.path || '/' || n.n_nationkey FROM nation n JOIN r ON n.n_nationkey // 3 = r.n_nationkey AND n.n_nationkey > 0) SELECT n_nationkey, CAST(depth AS INTEGER) AS depth, path FROM r")
add("event_windows", lambda s, d: rounded(keyed.tumbling(t(s, d, "events"), "ts", "1 hour", ["event_type"], "value").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))), "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
add("event_windows_sliding", lambda s, d: rounded(keyed.tumbling(t(s, d, "events"), "ts", "2 hours", [], "value", slide="1 hour").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))), "SELECT strftime(date_trunc('hour', ts) - to_hours(CAST(k AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n, round(sum(value), 2) AS total FROM events, range(2) x(k) GROUP BY 1")
add("event_sessions", lambda s, d: keyed.sessions(t(s, d, "events"), "ts", "30 minutes", "user_id").withColumn("session_start", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss")), "WITH m AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n FROM s GROUP BY user_id, k")

# --- computed columns --------------------------------------------------------------------------------------
for _n, _e, _sql in (
    ("add", '"o_totalprice" + "o_custkey"', "o_totalprice + o_custkey"),
    ("subtract", '"o_totalprice" - 100', "o_totalprice - 100"),
    ("multiply", '"o_totalprice" * 2', "o_totalprice * 2"),
    ("divide", '"o_totalprice" / ("o_custkey" + 0.7)', "o_totalprice / (o_custkey + 0.7::DOUBLE)"),
    ("percent_of", '"o_custkey" % "o_totalprice"', "100.0 * o_custkey / o_totalprice"),
    ("pow", '"o_custkey" ^ 2', "CAST(o_custkey AS DOUBLE) ^ 2"),
    ("invert", 'invert("o_totalprice")', "1 / o_totalprice"),
    ("pow2", 'pow2("o_custkey")', "CAST(o_custkey AS DOUBLE) * o_custkey"),
    ("sqrt", 'sqrt("o_totalprice")', "sqrt(o_totalprice)"),
    ("abs", 'abs("o_totalprice" - 100000)', "abs(o_totalprice - 100000)"),
    ("log", 'log("o_totalprice")', "ln(o_totalprice)"),
    ("exp", 'exp("o_totalprice" / 100000)', "exp(o_totalprice / 100000)"),
    ("bin10", 'bin10("o_totalprice")', "floor(o_totalprice / 10) * 10"),
    ("bin100", 'bin100("o_totalprice")', "floor(o_totalprice / 100) * 100"),
    ("bin1000", 'bin1000("o_totalprice")', "floor(o_totalprice / 1000) * 1000"),
    ("bin10th", 'bin10th("o_totalprice")', "floor(o_totalprice / 0.1::DOUBLE) * 0.1::DOUBLE"),
    ("bin100th", 'bin100th("o_totalprice")', "floor(o_totalprice / 0.01::DOUBLE) * 0.01::DOUBLE"),
    ("bin1000th", 'bin1000th("o_totalprice")', "floor(o_totalprice / 0.001::DOUBLE) * 0.001::DOUBLE"),
    ("precedence", '"o_totalprice" + "o_custkey" * 2 ^ 2', "o_totalprice + o_custkey * 4"),
    ("nested", 'sqrt(abs("o_totalprice" - "o_custkey")) as y', "sqrt(abs(o_totalprice - o_custkey))"),
):
    add(f"computed_{_n}", lambda s, d, e=_e: t(s, d, "orders").select("o_orderkey", F.round(computed.parse(e)[0], 4).alias("x")), f"SELECT o_orderkey, round({_sql}, 4) AS x FROM orders")
for _n, _e, _sql in (
    ("equals", '"o_custkey" == 7', "o_custkey = 7"), ("not_equals", '"o_custkey" != 7', "o_custkey <> 7"), ("greater_than", '"o_totalprice" > 100000', "o_totalprice > 100000"), ("less_than", '"o_totalprice" < 100000', "o_totalprice < 100000"), ("is", "\"o_orderstatus\" is 'F'", "o_orderstatus = 'F'"),
    ("length", 'length("o_orderpriority")', "CAST(strlen(o_orderpriority) AS BIGINT)"), ("uppercase", 'uppercase("o_orderpriority")', "upper(o_orderpriority)"), ("lowercase", 'lowercase("o_orderpriority")', "lower(o_orderpriority)"),
    ("concat_space", 'concat_space("o_orderstatus", "o_orderpriority")', "o_orderstatus || ' ' || o_orderpriority"), ("concat_comma", 'concat_comma("o_orderstatus", "o_orderpriority")', "o_orderstatus || ', ' || o_orderpriority"),
):
    add(f"computed_{_n}", lambda s, d, e=_e: t(s, d, "orders").select("o_orderkey", computed.parse(e)[0].alias("x")), f"SELECT o_orderkey, {_sql} AS x FROM orders")
for _n, _sql in (
    ("hour_of_day", "CAST(hour(ts) AS VARCHAR)"), ("day_of_week", "CAST(dayofweek(ts) + 1 AS VARCHAR) || ' ' || dayname(ts)"), ("month_of_year", "strftime(ts, '%m ') || monthname(ts)"), ("second_bucket", "strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S')"), ("minute_bucket", "strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S')"), ("hour_bucket", "strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S')"),
    ("day_bucket", "strftime(ts, '%Y-%m-%d')"), ("week_bucket", "strftime(date_trunc('week', ts), '%Y-%m-%d')"), ("month_bucket", "strftime(date_trunc('month', ts), '%Y-%m-%d')"), ("year_bucket", "strftime(date_trunc('year', ts), '%Y-%m-%d')"),
):
    add(f"computed_{_n}", lambda s, d, n=_n: t(s, d, "events").select("event_id", computed.apply(n, F.col("ts")).cast("string").alias("x")), f"SELECT event_id, {_sql} AS x FROM events")
add("computed_divide_error", lambda s, d: t(s, d, "orders").select("o_orderkey", (F.col("o_custkey") % 5).alias("z"), F.col("o_custkey")).select("o_orderkey", computed.apply("/", F.col("o_custkey"), F.col("z")).alias("x"), computed.error_of("/", F.col("o_custkey"), F.col("z")).alias("x__error")), "SELECT o_orderkey, CASE WHEN o_custkey % 5 <> 0 THEN o_custkey / (o_custkey % 5) END AS x, CASE WHEN o_custkey % 5 = 0 THEN '#DIV#ZERO' END AS x__error FROM orders")
add("computed_in_view", lambda s, d: rounded(view.one_sided(t(s, d, "lineitem"), ViewConfig(row_pivots=("l_returnflag",), aggregates={"revenue": Agg("sum", "net")}, computed={"net": '"l_extendedprice" * (1 - "l_discount")'}, filters=(Filter("net", ">", 1000.0),)))), "SELECT l_returnflag, CAST(1 - grouping(l_returnflag) AS INTEGER) AS level, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 1000 GROUP BY ROLLUP (l_returnflag)")


def _pandas_udf(s: SparkSession, d: str) -> DataFrame:
    @F.pandas_udf("double")
    def f(v: pd.Series) -> pd.Series:
        return v * 1.5 + 2

    return t(s, d, "events").select("event_id", F.round(f("value"), 4).alias("x"))


add("computed_udf", _pandas_udf, "SELECT event_id, round(value * 1.5 + 2, 4) AS x FROM events")

add("water_marks", lambda s, d: rounded(updates.water_marks(updates.water_marks(None, _early(s, d), "event_type", "value"), _late(s, d), "event_type", "value"), 4), "SELECT event_type, round(max(value), 4) AS high, round(min(value), 4) AS low FROM events GROUP BY 1")
add("agg_custom_function", lambda s, d: rounded(aggregates.custom(t(s, d, "events"), ["event_type"], "value", lambda v: float(v.max() - v.min())), 4), "SELECT event_type, round(max(value) - min(value), 4) AS x FROM events GROUP BY 1")

# --- sources ------------------------------------------------------------------------------------------------
add("source_rows", lambda s, d: build.frame(s, [{"x": 1, "y": "a"}, {"x": 2, "y": "b"}, {"x": None, "y": "c"}]), "SELECT * FROM (VALUES (1::BIGINT, 'a'), (2, 'b'), (NULL, 'c')) v(x, y)")
add("source_columns", lambda s, d: build.frame(s, {"x": [1.5, 2.5], "y": ["a", "b"]}), "SELECT * FROM (VALUES (1.5::DOUBLE, 'a'), (2.5, 'b')) v(x, y)")
add("source_schema", lambda s, d: build.frame(s, {"x": "integer", "y": "string", "z": "float"}), "SELECT 1::BIGINT AS x, 'a' AS y, 1.0::DOUBLE AS z WHERE FALSE")


def _arrow(s: SparkSession, d: str) -> DataFrame:
    import pyarrow as pa

    return build.frame(s, pa.table({"i": pa.array([1, 2, None], pa.int16()), "f": pa.array([0.5, None, 2.5], pa.float32()), "w": pa.array(["a", "b", "a"]).dictionary_encode()}))


add("source_arrow", _arrow, "SELECT i::SMALLINT AS i, f, w FROM (VALUES (1::SMALLINT, 0.5::DOUBLE, 'a'), (2, NULL, 'b'), (NULL, 2.5, 'a')) v(i, f, w)")
_CSV = b"# notes\nid;name;when;ok;list;amount\n1;a;2020-01-02;yes;<1, 2>;1.5\n2;b;2020-02-03;no;< >;oops\n3;NULL;2020-03-04;yes;<3>;\n"


def _csv(s: SparkSession, d: str) -> DataFrame:
    from dataclasses import replace

    x, rows = ingest.sniff(_CSV)
    fields = [replace(f, kind="decimal") if f.name == "amount" else f for f in x.fields]
    raw = s.createDataFrame([tuple(r) for r in rows[1:]], [f.name for f in fields])
    out = ingest.typed(raw, fields)
    return out.select("id", "name", F.col("when").cast("string").alias("when"), "ok", F.array_join(F.transform("list", lambda x: x.cast("string")), ",").alias("list"), "amount", F.array_join(ingest.ERROR, ",").alias("error"))


add("ingest_typed", _csv, "SELECT * FROM (VALUES (1::BIGINT, 'a', '2020-01-02', TRUE, '1,2', 1.5::DOUBLE, ''), (2, 'b', '2020-02-03', FALSE, '', NULL, 'amount'), (3, NULL, '2020-03-04', TRUE, '3', NULL, '')) v(id, name, \"when\", ok, list, amount, error)")
add("row_numbers", lambda s, d: ingest.numbered(t(s, d, "nation").select("n_name"), ["n_name"]), "SELECT n_name, CAST(row_number() OVER (ORDER BY n_name) AS INTEGER) AS __rownum__ FROM nation")



def _narrowed(s: SparkSession, d: str) -> DataFrame:
    out = ingest.narrowed(t(s, d, "orders").select("o_orderkey", F.col("o_custkey").cast("long").alias("o_custkey"), (F.col("o_custkey") % 100).cast("long").alias("small")))
    kinds = [F.lit(f.dataType.simpleString()).alias(f"{f.name}_type") for f in out.schema]
    return out.select(*[F.col(c).cast("long").alias(c) for c in out.columns], *kinds)


_KIND = "(SELECT CASE WHEN max(abs({0})) <= 127 THEN 'tinyint' WHEN max(abs({0})) <= 32767 THEN 'smallint' WHEN max(abs({0})) < 2147483648 THEN 'int' ELSE 'bigint' END FROM orders) AS {1}_type"
add("narrowed_integers", _narrowed, f"SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey, CAST(o_custkey % 100 AS BIGINT) AS small, {_KIND.format('o_orderkey', 'o_orderkey')}, {_KIND.format('o_custkey', 'o_custkey')}, {_KIND.format('o_custkey % 100', 'small')} FROM orders")

QUERIES |= surface.QUERIES
ORACLE_SQL |= surface.ORACLE_SQL
