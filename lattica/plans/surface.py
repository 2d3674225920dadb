"""Registered queries of the table and view API, of sinks and of file readers, over whole tables."""

from __future__ import annotations

import io
import tempfile
import time
import uuid
import zipfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Agg, ConfigError, Filter, Having, Pivot, ViewConfig
from ..sources import build, ingest, sinks
from ..table import Table, View, table
from . import jobs, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def t(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name], ORACLE_SQL[name] = run, sql


def scratch(s: SparkSession) -> str:
    """A new folder that all executors share; a temporary one on a local master."""
    d = s.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not s.sparkContext.master.startswith("local"):
            raise ConfigError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp()
    return f"{d.rstrip('/')}/files-{uuid.uuid4().hex}"


# --- views as a user holds them ------------------------------------------------------------------
_AGGS = {"total": Agg("sum", "o_totalprice"), "n": Agg("count")}
_BY = ("o_orderpriority", "o_orderstatus")


def orders(s: SparkSession, d: str) -> Table:
    return table(s, t(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"), index="o_orderkey")


def by_priority(s: SparkSession, d: str, **options) -> View:
    return orders(s, d).view(ViewConfig(row_pivots=_BY, aggregates=_AGGS, **options))


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(f"`{f.name}`", 2).alias(f.name) if f.dataType.typeName() == "double" else F.col(f"`{f.name}`") for f in df.schema])


_LEVEL = "CAST(2 - grouping(o_orderpriority) - grouping(o_orderstatus) AS INTEGER)"
_TREE = f"SELECT o_orderpriority, o_orderstatus, {_LEVEL} AS level, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)"


def rows_of(s: SparkSession, names: str, rows: list[tuple]) -> DataFrame:
    return s.createDataFrame(rows, names)


def values(names: str, rows: list[tuple]) -> str:
    text = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else f"CAST({v} AS BIGINT)" if isinstance(v, int) else f"'{v}'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) v({names})"


add("view_set_depth", lambda s, d: rounded(by_priority(s, d).set_depth(1).to_df()), f"SELECT * FROM ({_TREE}) WHERE level <= 1")
add("view_expand_path", lambda s, d: rounded(by_priority(s, d).children("1-URGENT")), f"SELECT * FROM ({_TREE}) WHERE level = 2 AND o_orderpriority = '1-URGENT'")
add("view_flat_columns", lambda s, d: rounded(by_priority(s, d).to_df()), _TREE)
add("view_nested_path", lambda s, d: rounded(by_priority(s, d).nested().withColumn("path", F.array_join("__ROW_PATH__", "/")).select("path", "total", "n")), f"SELECT CASE level WHEN 0 THEN '' WHEN 1 THEN o_orderpriority ELSE o_orderpriority || '/' || o_orderstatus END AS path, total, n FROM ({_TREE})")
add("view_cached", lambda s, d: rounded(by_priority(s, d).enable_cache().to_df()), _TREE)


def _uncached(s: SparkSession, d: str) -> DataFrame:
    v = by_priority(s, d).enable_cache()
    held = v.to_df().storageLevel.useMemory
    v.disable_cache()
    return rounded(v.to_df()).withColumn("held", F.lit(held))


add("view_cache_given_back", _uncached, f"SELECT *, TRUE AS held FROM ({_TREE})")
add("view_options_by_other_names", lambda s, d: rounded(orders(s, d).view(**{"row-pivots": ["o_orderpriority"], "aggregate": {"n": Agg("count")}, "filter": [("o_orderstatus", "==", "F")]}).to_df()), "SELECT o_orderpriority, CAST(1 - grouping(o_orderpriority) AS INTEGER) AS level, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY ROLLUP (o_orderpriority)")
add("agg_custom_copy", lambda s, d: rounded(orders(s, d).view(ViewConfig(row_pivots=("o_orderpriority",), aggregates={"total": Agg("sum", "o_totalprice"), "again": Agg("custom", "total")})).to_df()), "SELECT o_orderpriority, CAST(1 - grouping(o_orderpriority) AS INTEGER) AS level, round(sum(o_totalprice), 2) AS total, round(sum(o_totalprice), 2) AS again FROM orders GROUP BY ROLLUP (o_orderpriority)")


def _refused(s: SparkSession, d: str) -> DataFrame:
    bad = ({"rows": ["x"]}, {"aggregates": {"x": Agg("nothing")}}, {"row_pivots": (Pivot("o_orderdate", level="fortnight"),)}, {"filters": [("a", "like", 1)]}, {"sort": [("a", "up")]}, {"havings": (Having("n", ">", 1, 3),)}, {"show": {"a": "half"}}, {"filter_op": "xor"}, {"row_pivots": ("o_orderdate",)})
    out = []
    for k, options in enumerate(bad):
        try:
            ViewConfig.of(**options)
            out.append((k, False))
        except ConfigError:
            out.append((k, True))
    return rows_of(s, "option long, refused boolean", out)


add("view_options_refused", _refused, values("option, refused", [(k, k < 8) for k in range(9)]))


def _valid(s: SparkSession, d: str) -> DataFrame:
    o = orders(s, d)
    tried = [Filter("o_totalprice", ">", 5), Filter("o_totalprice", ">", None), Filter("nothing", ">", 5), Filter("o_orderdate", "is None"), Filter("o_orderdate", "this year")]
    config = ViewConfig(row_pivots=("o_orderpriority",), aggregates={"n": Agg("count")})
    out = [(k, o.is_valid_filter(f)) for k, f in enumerate(tried)]
    return rows_of(s, "tried long, valid boolean", out + [(10 + k, o.is_valid_having(h, config)) for k, h in enumerate((Having("n", ">", 5), Having("x", ">", 5), Having("n", ">", None)))])


add("validity_of_filters", _valid, values("tried, valid", [(0, True), (1, False), (2, False), (3, True), (4, True), (10, True), (11, False), (12, False)]))


def _schema(s: SparkSession, d: str) -> DataFrame:
    v = orders(s, d).view(ViewConfig(row_pivots=("o_orderpriority",), aggregates={"n": Agg("count"), "m": Agg("mean", "o_custkey"), "share": Agg("pct sum grand total", "o_totalprice"), "kinds": Agg("distinct values", "o_orderstatus"), "days": Agg("distinct count", "o_orderdate"), "one": Agg("unique", "o_orderstatus"), "top": Agg("high", "o_totalprice")}))
    return rows_of(s, "name string, type string", list(v.schema().items()))


add("schema_after_aggregation", _schema, values("name, type", [("o_orderpriority", "string"), ("level", "integer"), ("n", "integer"), ("m", "float"), ("share", "float"), ("kinds", "list_string"), ("days", "integer"), ("one", "string"), ("top", "float")]))


def _extents(s: SparkSession, d: str) -> DataFrame:
    o, v = orders(s, d), by_priority(s, d)
    return rows_of(s, "size long, n_columns long, view_rows long, view_columns long, window_rows long, window_columns long", [(o.size(), len(o.columns()), v.num_rows(), v.num_columns(), v.window(end_row=4).count(), len(v.window(end_col=3).columns))])


add("extents", _extents, f"SELECT (SELECT count(*) FROM orders) AS size, CAST(6 AS BIGINT) AS n_columns, (SELECT count(*) FROM ({_TREE})) AS view_rows, CAST(5 AS BIGINT) AS view_columns, least(4, (SELECT count(*) FROM ({_TREE}))) AS window_rows, CAST(3 AS BIGINT) AS window_columns")


def _metadata(s: SparkSession, d: str) -> DataFrame:
    o = orders(s, d)
    o.set_format("o_totalprice", "financial")
    o.rename({"o_custkey": "customer"})
    out = [("column", m["name"], m["type"], m["format"]) for m in o.column_metadata()]
    out += [("computed", k, v, None) for k, v in o.computed_schema(half="\"o_totalprice\" / 2").items()]
    return rows_of(s, "what string, name string, type string, format string", out + [("aggregate", k, v, None) for k, v in o.agg_custom_schema({"n": Agg("count")}).items()])


_COMPUTED = "half"
add("table_metadata", _metadata, values("what, name, type, format", [("column", "o_orderkey", "integer", None), ("column", "customer", "integer", None), ("column", "o_orderstatus", "string", None), ("column", "o_totalprice", "float", "financial"), ("column", "o_orderdate", "datetime", None), ("column", "o_orderpriority", "string", None), ("computed", _COMPUTED, "float", None), ("aggregate", "o_orderkey", "integer", None), ("aggregate", "level", "integer", None), ("aggregate", "n", "integer", None)]))


def _functions(s: SparkSession, d: str) -> DataFrame:
    o = orders(s, d)
    known = o.get_computed_functions()
    return rows_of(s, "name string, known boolean, n_inputs long", [(k, k in known, len(o.get_computation_input_types(k))) for k in ("+", "/", "sqrt", "uppercase", "day_of_week", "concat_space")])


add("computed_function_list", _functions, values("name, known, n_inputs", [("+", True, 2), ("/", True, 2), ("sqrt", True, 1), ("uppercase", True, 1), ("day_of_week", True, 1), ("concat_space", True, 2)]))


def _state(s: SparkSession, d: str) -> DataFrame:
    v = orders(s, d).view(ViewConfig(row_pivots=(Pivot("o_orderpriority", subtotal=False), "o_orderstatus"), aggregates=_AGGS))
    w = v.table.view(ViewConfig(row_pivots=("o_orderpriority",), column_pivots=("o_orderstatus",), aggregates=_AGGS))
    v.set_depth(1)
    return rows_of(s, "sides long, sides_flat long, sides_two long, expanded0 boolean, expanded1 boolean, subtotals string, pivots long", [(v.sides, v.table.view().sides, w.sides, v.get_row_expanded(0), v.get_row_expanded(1), ",".join(map(str, v.subtotal_list())), len(v.get_config().row_pivots))])


add("view_state", _state, values("sides, sides_flat, sides_two, expanded0, expanded1, subtotals, pivots", [(1, 0, 2, True, False, "False,True", 2)]))


def _binning(s: SparkSession, d: str) -> DataFrame:
    b = orders(s, d).get_default_binning("o_custkey")
    cut = orders(s, d).view(ViewConfig(row_pivots=("o_orderpriority",), aggregates={"few": Agg("distinct values", "o_orderstatus"), "many": Agg("distinct values", "o_orderkey")})).truncated_columns()
    return rows_of(s, "low double, high double, size double, cut string", [(float(b.low), float(b.high), float(b.size), ",".join(cut))])


add("default_binning", _binning, "WITH x AS (SELECT min(o_custkey) AS lo, max(o_custkey) AS hi, ceil(sqrt(count(*))) AS k, count(DISTINCT o_orderkey) AS n FROM orders) SELECT CAST(lo AS DOUBLE) AS low, CAST(CASE WHEN hi > lo THEN hi ELSE lo + CASE WHEN floor((hi - lo) / k) > 0 THEN floor((hi - lo) / k) ELSE 10 END END AS DOUBLE) AS high, CAST(CASE WHEN floor((hi - lo) / k) > 0 THEN floor((hi - lo) / k) ELSE 10 END AS DOUBLE) AS size, CASE WHEN n > 1000 THEN 'many' ELSE '' END AS cut FROM x")
add("update_show_type", lambda s, d: by_priority(s, d).update_show_type("n", "%_of_grand_total").to_df().select("o_orderpriority", "o_orderstatus", "level", F.round("n", 6).alias("n")), f"SELECT o_orderpriority, o_orderstatus, level, round(100.0 * n / (SELECT count(*) FROM orders), 6) AS n FROM ({_TREE})")
add("update_pagination", lambda s, d: orders(s, d).view(ViewConfig(columns=("o_orderkey",), sort=(("o_totalprice", "desc"),), key="o_orderkey")).update_pagination_setting(25, 2).to_df(), "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 25")
add("min_max_by_depth", lambda s, d: rounded(rows_of(s, "depth long, low double, high double", [(k, *by_priority(s, d).min_max("total", k)) for k in range(3)])), f"SELECT CAST(level AS BIGINT) AS depth, min(total) AS low, max(total) AS high FROM ({_TREE}) GROUP BY 1")


def _capped(s: SparkSession, d: str) -> DataFrame:
    long = orders(s, d).view(ViewConfig(row_pivots=("o_orderstatus",), column_pivots=("o_orderpriority",), aggregates={"n": Agg("count")})).to_df()
    return view.crossed(long, ["o_orderstatus"], ["o_orderpriority"], ["n"], most=2).withColumnsRenamed({"1-URGENT|n": "first", "2-HIGH|n": "second"})


add("pivot_values_cut", _capped, "SELECT o_orderstatus, CAST(1 - grouping(o_orderstatus) AS INTEGER) AS row_level, nullif(count(*) FILTER (WHERE o_orderpriority = '1-URGENT'), 0) AS first, nullif(count(*) FILTER (WHERE o_orderpriority = '2-HIGH'), 0) AS second, TRUE AS __columns_left_out__ FROM orders GROUP BY ROLLUP (o_orderstatus)")

# --- sinks ---------------------------------------------------------------------------------------
_SMALL = lambda s, d: rounded(by_priority(s, d).to_df())
_KINDS = "o_orderpriority string, o_orderstatus string, level int, total double, n long"
add("sink_json_rows", lambda s, d: s.createDataFrame([tuple(r.values()) for r in sinks.rows(_SMALL(s, d))], _KINDS), _TREE)
add("sink_json_columns", lambda s, d: s.createDataFrame(list(zip(*sinks.columns(_SMALL(s, d)).values(), strict=True)), _KINDS), _TREE)
add("sink_arrow", lambda s, d: build.frame(s, sinks.arrow_bytes(_SMALL(s, d))), _TREE)
add("sink_csv", lambda s, d: s.read.schema(_KINDS).csv(s.sparkContext.parallelize(sinks.csv(_SMALL(s, d)).splitlines()[1:])), _TREE)
add("sink_typed_array", lambda s, d: s.createDataFrame([(int(x),) for x in by_priority(s, d).col_to_array("n")], "n long"), f"SELECT n FROM ({_TREE})")


def _files(fmt: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(s: SparkSession, d: str) -> DataFrame:
        df, to = t(s, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), f"{scratch(s)}.{fmt}"
        sinks.write(df, to, fmt)
        return s.read.format(fmt).schema(df.schema).load(to)

    return run


for _fmt in ("parquet", "csv", "json", "orc"):
    add(f"sink_files_{_fmt}", _files(_fmt), "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders")


# --- files of unknown shape ----------------------------------------------------------------------
_PART = "p_partkey, p_name, p_brand"


def _written(s: SparkSession, d: str, lines: DataFrame, **options) -> str:
    """A file of text lines written from table rows: its folder."""
    to = scratch(s)
    lines.coalesce(1).write.options(**options).text(to)
    return to


def _csv(begin: str, sep: str, cell: Callable = lambda c: c) -> Callable[[SparkSession, str], DataFrame]:
    """Part rows as a file with some lines before them, read with what sniffing finds."""

    def run(s: SparkSession, d: str) -> DataFrame:
        cells = [F.col("p_partkey").cast("string"), cell(F.col("p_name")), F.col("p_brand")]
        body = t(s, d, "part").select(F.col("p_partkey").alias("k"), F.concat_ws(sep, *cells).alias("value"))
        head = s.createDataFrame([(-len(begin) + i, x) for i, x in enumerate(begin.split("\n"))], "k long, value string")
        out = ingest.read_csv(s, _written(s, d, head.union(body).orderBy("k").select("value")))
        return out.drop(ingest.ERROR).toDF("p_partkey", "p_name", "p_brand")

    return run


_PLAIN = f"SELECT {_PART} FROM part"
add("ingest_csv_header", _csv("key,name,brand", ","), _PLAIN)
add("ingest_csv_semicolons", _csv("key;name;brand", ";"), _PLAIN)
add("ingest_csv_comment", _csv("# made by hand\nkey\tname\tbrand", "\t"), _PLAIN)
add("ingest_csv_preamble", _csv("A report of parts,,\n2024-01-01,,\nkey,name,brand", ","), _PLAIN)
add("ingest_csv_quoted_breaks", _csv("key,name,brand", ",", lambda c: F.concat(F.lit('"'), c, F.lit('\n, and "" more"'))), "SELECT p_partkey, p_name || chr(10) || ', and \" more' AS p_name, p_brand FROM part")


def _like_header(s: SparkSession, d: str) -> DataFrame:
    """Rows whose first cell is that of the header or of a skipped line are data."""
    rows = t(s, d, "part").select((F.col("p_partkey") % 3).alias("m"), "p_partkey")
    body = rows.select((F.col("p_partkey") + 10).alias("k"), F.concat_ws(",", F.when(F.col("m") == 0, "key").when(F.col("m") == 1, "A report").otherwise(""), F.col("p_partkey").cast("string")).alias("value"))
    head = s.createDataFrame([(0, "A report,"), (1, "key,number")], "k long, value string")
    return ingest.read_csv(s, _written(s, d, head.union(body).orderBy("k").select("value"))).drop(ingest.ERROR).toDF("word", "p_partkey")


add("ingest_csv_cells_like_the_header", _like_header, "SELECT CASE p_partkey % 3 WHEN 0 THEN 'key' WHEN 1 THEN 'A report' END AS word, p_partkey FROM part")


def _numbers(s: SparkSession, d: str) -> DataFrame:
    body = t(s, d, "part").select(F.col("p_partkey").alias("k"), F.concat_ws(",", F.col("p_partkey").cast("string"), (F.col("p_partkey") * 2).cast("string")).alias("value"))
    return ingest.read_csv(s, _written(s, d, body.orderBy("k").select("value"))).drop(ingest.ERROR)


add("ingest_csv_without_header", _numbers, 'SELECT p_partkey AS "Field_1", p_partkey * 2 AS "Field_2" FROM part')


def _names(s: SparkSession, d: str) -> DataFrame:
    x, _ = ingest.sniff(b"a,,a,b\n1,2,3,4\n5,6,7,8\n")
    return rows_of(s, "place long, name string, type string", [(k, f.name, f.kind) for k, f in enumerate(x.fields)])


add("ingest_column_names", _names, values("place, name, type", [(0, "a", "integer"), (1, "Field_2", "integer"), (2, "a_2", "integer"), (3, "b", "integer")]))


def _archive(s: SparkSession, d: str, member: str | None) -> DataFrame:
    """All nations in a ZIP file of two members; the reader is chosen by the file's first bytes."""
    out = io.BytesIO()
    rows = t(s, d, "nation").select("n_nationkey", "n_name").collect()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("regions.csv", "key;region\n" + "".join(f"{r[0]};{r[1]}\n" for r in t(s, d, "region").select("r_regionkey", "r_name").collect()))
        z.writestr("nations.csv", "key,nation\n" + "".join(f"{r[0]},{r[1]}\n" for r in rows))
    to = f"{scratch(s)}.zip"
    _put(s, to, out.getvalue())
    return ingest.read(s, to, member=member).drop(ingest.ERROR)


def _put(s: SparkSession, to: str, content: bytes) -> None:
    """One small file, written through Spark's own file systems."""
    p = s._jvm.org.apache.hadoop.fs.Path(to)
    o = p.getFileSystem(s._jsc.hadoopConfiguration()).create(p)
    o.write(content)
    o.close()


add("ingest_zip", lambda s, d: _archive(s, d, None), "SELECT CAST(r_regionkey AS BIGINT) AS key, r_name AS region FROM region")
add("ingest_zip_member", lambda s, d: _archive(s, d, "nations.csv"), "SELECT CAST(n_nationkey AS BIGINT) AS key, n_name AS nation FROM nation")


def workbook(sheets: dict[str, list[list]]) -> bytes:
    """A small XLSX file with text and whole numbers."""
    out = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    cell = lambda v: f"<c><v>{v}</v></c>" if isinstance(v, int) else f'<c t="inlineStr"><is><t>{v}</t></is></c>'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("xl/workbook.xml", f"<workbook {ns} {rel}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="worksheets/s{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
        for k, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/s{k}.xml", f"<worksheet {ns}><sheetData>" + "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in rows) + "</sheetData></worksheet>")
    return out.getvalue()


def _excel(s: SparkSession, d: str) -> DataFrame:
    rows = [[int(r[0]), r[1]] for r in t(s, d, "nation").select("n_nationkey", "n_name").collect()]
    to = f"{scratch(s)}.xlsx"
    _put(s, to, workbook({"other": [["x"], [1]], "nations": [["key", "nation"], *rows]}))
    return ingest.read(s, to, sheet="nations").drop(ingest.ERROR)


add("ingest_xlsx_sheet", _excel, "SELECT CAST(n_nationkey AS BIGINT) AS key, n_name AS nation FROM nation")
add("row_numbers_whole", lambda s, d: ingest.numbered(t(s, d, "orders").select("o_orderkey"), ["o_orderkey"]), "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderkey) AS INTEGER) AS __rownum__ FROM orders")


# --- live tables ---------------------------------------------------------------------------------
def customers(s: SparkSession, d: str) -> Table:
    return table(s, t(s, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), index="c_custkey")


def _batch(s: SparkSession, d: str) -> DataFrame:
    """A batch that moves a tenth of the customers to another segment."""
    return t(s, d, "customer").where("c_custkey % 10 = 0").select("c_custkey", F.lit("MOVED").alias("c_mktsegment"))


_MOVED = "(SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer)"
_SEGMENTS = "SELECT c_mktsegment, CAST(1 - grouping(c_mktsegment) AS INTEGER) AS level, count(*) AS n FROM {} GROUP BY ROLLUP (c_mktsegment)"


def _told(s: SparkSession, d: str, mode: str) -> DataFrame:
    c = customers(s, d)
    v = c.view(ViewConfig(row_pivots=("c_mktsegment",), aggregates={"n": Agg("count")}))
    told: list = []
    unheard: list = []
    v.on_update((lambda *x: told.append(x[0] if x else None)), mode)
    gone = lambda *x: unheard.append(x)
    v.on_update(gone, mode)
    v.remove_update(gone)
    c.update(_batch(s, d))
    if unheard or len(told) != 1:
        raise AssertionError("callbacks")
    return told[0] if told[0] is not None else v.to_df()


add("on_update_none", lambda s, d: _told(s, d, "none"), _SEGMENTS.format(_MOVED))
add("on_update_rows", lambda s, d: _told(s, d, "rows"), f"{_SEGMENTS.format(_MOVED)} EXCEPT ALL {_SEGMENTS.format('customer')}")
add("on_update_keys", lambda s, d: _told(s, d, "pkey"), "SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0")


def _flat_notify(s: SparkSession, d: str) -> DataFrame:
    c = customers(s, d)
    v = c.view(ViewConfig(columns=("c_custkey", "c_mktsegment"), key="c_custkey"))
    told: list = []
    v.on_update(told.append, "rows")
    c.update(_batch(s, d))
    return told[0]


add("on_update_flat_rows", _flat_notify, "SELECT c_custkey, 'MOVED' AS c_mktsegment FROM customer WHERE c_custkey % 10 = 0")


def _deleted(s: SparkSession, d: str) -> DataFrame:
    c = customers(s, d)
    told: list = []
    c.view().on_delete(lambda: told.append("view"))
    c.on_delete(lambda: told.append("table"))
    c.delete()
    return rows_of(s, "place long, what string", list(enumerate(told)))


add("on_delete", _deleted, values("place, what", [(0, "view"), (1, "table")]))


def _replaced(s: SparkSession, d: str) -> DataFrame:
    c = customers(s, d)
    c.replace(t(s, d, "customer").where("c_acctbal > 0").select("c_custkey", "c_mktsegment", "c_acctbal"))
    return rounded(c.df)


def _cleared(s: SparkSession, d: str) -> DataFrame:
    c = customers(s, d)
    c.clear()
    empty = c.size()
    c.update(_batch(s, d))
    return c.df.select("c_custkey", "c_mktsegment", "c_acctbal").withColumn("before", F.lit(empty).cast("long"))


add("table_replace", _replaced, "SELECT c_custkey, c_mktsegment, round(c_acctbal, 2) AS c_acctbal FROM customer WHERE c_acctbal > 0")
add("table_clear", _cleared, "SELECT c_custkey, 'MOVED' AS c_mktsegment, CAST(NULL AS DOUBLE) AS c_acctbal, CAST(0 AS BIGINT) AS before FROM customer WHERE c_custkey % 10 = 0")


def _ring(s: SparkSession, d: str) -> DataFrame:
    """All orders by key in a ring of 100 rows, then as many again."""
    o = t(s, d, "orders").select("o_orderkey").orderBy("o_orderkey")
    r = table(s, o, limit=100)
    r.update(o.limit(30))
    return r.df


add("table_ring", _ring, "WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders), a AS (SELECT * FROM o UNION ALL SELECT o_orderkey, (SELECT count(*) FROM o) + n FROM o WHERE n < 30) SELECT o_orderkey FROM a WHERE n >= (SELECT max(n) FROM a) - 99")


def _run(s: SparkSession, d: str) -> DataFrame:
    run = jobs.Run(s, lambda: by_priority(s, d).to_arrow())
    out = run.wait(600)
    return rounded(build.frame(s, pa.table(out)).withColumn("progress", F.lit(float(run.progress()))))


add("run_with_progress", _run, f"SELECT *, 1.0::DOUBLE AS progress FROM ({_TREE})")


def _cancelled(s: SparkSession, d: str) -> DataFrame:
    """A run that would take days is cancelled once it has begun."""
    run = jobs.Run(s, lambda: s.range(0, 1 << 44, 1, 8).where(F.xxhash64("id") == 0).count())
    end = time.time() + 60
    while not s.sparkContext.statusTracker().getJobIdsForGroup(run.group) and time.time() < end:
        time.sleep(0.05)
    run.cancel()
    try:
        run.wait(60)
    except TimeoutError:
        raise
    except Exception:  # Spark's own, of the cancelled job
        return rows_of(s, "cancelled boolean", [(True,)])
    return rows_of(s, "cancelled boolean", [(False,)])


add("run_cancelled", _cancelled, values("cancelled", [(True,)]))