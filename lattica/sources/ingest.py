"""Files of unknown shape: sniffing on the first megabyte, typed reading by Spark.

The sample gives encoding, delimiter, quote, comment character, header and column
types; the whole file is then read in parallel as text and cast column by column,
so that a cell that doesn't fit becomes null with an entry in ``__error__``.
"""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from datetime import datetime, time, timedelta
from collections import Counter
from dataclasses import dataclass, field
from functools import reduce
from typing import Any
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.stable import placed

SAMPLE_BYTES = 1 << 20
SAMPLE_ROWS = 100
ERROR, ROWNUM = "__error__", "__rownum__"

#: Patterns of the types and texts of booleans and nulls.
INTEGER = r"0|-?[1-9]\d*"
DECIMAL = r"-?(0|[1-9]\d*)?\.\d+([eE][+-]?\d+)?|-?(0|[1-9]\d*)(\.\d*)?[eE][+-]?\d+|-?(0|[1-9]\d*)\.\d*"
BOOLEAN = {"0": False, "1": True, "n": False, "y": True, "no": False, "yes": True, "false": False, "true": True}
NULLS = ("NULL", "null", "")
WKT = r"(?i)\s*(POINT|LINESTRING|POLYGON|MULTIPOINT|MULTILINESTRING|MULTIPOLYGON|GEOMETRYCOLLECTION)\s*(Z|M|ZM)?\s*(\(|EMPTY)"

#: Date and time patterns tried in order: a test and the pattern Spark parses by.
DATES = [(r"\d{4}-\d{1,2}-\d{1,2}", "yyyy-M-d"), (r"\d{4}/\d{1,2}/\d{1,2}", "yyyy/M/d"), (r"\d{1,2}/\d{1,2}/\d{4}", "M/d/yyyy"), (r"\d{1,2}-[A-Za-z]{3}-\d{4}", "d-MMM-yyyy"), (r"[A-Za-z]{3} \d{1,2}, \d{4}", "MMM d, yyyy")]
TIMES = [(r"\d{1,2}:\d{2}", "H:mm"), (r"\d{1,2}:\d{2}:\d{2}", "H:mm:ss"), (r"\d{1,2}:\d{2} ?[AaPp][Mm]", "h:mm a")]


@dataclass
class Field:
    name: str
    kind: str  # boolean, integer, decimal, date, time, datetime, xml, json, wkt, list_*, string
    pattern: str | None = None


@dataclass
class Layout:
    encoding: str = "UTF-8"
    delimiter: str = ","
    quote: str = '"'
    escape: str | None = None
    comment: str | None = None
    header: bool = False
    skip: int = 0  # records before the header, those without any character not counted
    multiline: bool = False  # whether a quoted cell holds a line break
    fields: list[Field] = field(default_factory=list)


def head(spark: SparkSession, path: str, size: int = SAMPLE_BYTES) -> bytes:
    """A file's first bytes, through Spark's own file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    s = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        return bytes(s.readNBytes(size))
    finally:
        s.close()


def encoding_of(b: bytes) -> str:
    for mark, name in ((b"\xef\xbb\xbf", "UTF-8"), (b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE")):
        if b.startswith(mark):
            return name
    try:
        b.decode()
        return "UTF-8"
    except UnicodeDecodeError as e:
        return "UTF-8" if e.start > len(b) - 4 else "windows-1252"


def sniff(b: bytes) -> tuple[Layout, list[list[str]]]:
    """Layout and sample rows from a file's first bytes."""
    out = Layout(encoding=encoding_of(b))
    text = b.decode({"UTF-16LE": "utf-16-le", "UTF-16BE": "utf-16-be", "windows-1252": "cp1252"}.get(out.encoding, "utf-8"), "replace").lstrip("﻿")
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    whole = lines[:-1] if len(b) >= SAMPLE_BYTES and len(lines) > 1 else lines
    if whole and whole[0].startswith("#") and sum(x.startswith("#") for x in whole) < len(whole):
        out.comment = "#"
        whole = [x for x in whole if not x.startswith("#")]
    body = "\n".join(whole)
    if "'" in body and '"' not in body and re.search(r"(^|[,;\t|])'[^'\n]*'([,;\t|]|$)", body, re.M):
        out.quote = "'"
    if f"\\{out.quote}" in body:
        out.escape = "\\"
    best = (-1.0, 0)
    parsed: list[list[str]] = []
    for k, d in enumerate(",;\t|:^"):
        rows = _parse(body, d, out)[: SAMPLE_ROWS + 20]
        widths = Counter(len(r) for r in rows)
        if not widths:
            continue
        width, n = max(widths.items(), key=lambda x: (x[1], x[0]))
        score = (n / len(rows) if width > 1 else 0.0, -k)
        if score > best:
            best, out.delimiter, parsed = score, d, rows
    _header(out, parsed)
    out.multiline = any("\n" in c or "\r" in c for r in parsed for c in r)
    if out.header and out.skip:  # blank records count where a file is read by position
        full = [i for i, r in enumerate(_records(body, out.delimiter, out)) if any(c.strip() for c in r)]
        out.skip = full[out.skip]
    return out, parsed


def _records(text: str, delimiter: str, x: Layout) -> list[list[str]]:
    """All records but those of empty lines, of which readers make none."""
    try:
        return [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter, quotechar=x.quote, escapechar=x.escape) if r]
    except csv.Error:
        return []


def _parse(text: str, delimiter: str, x: Layout) -> list[list[str]]:
    return [r for r in _records(text, delimiter, x) if any(c.strip() for c in r)]


def _header(out: Layout, rows: list[list[str]]) -> None:
    """The header is the best of the first rows, if the types below differ from its own."""
    if not rows:
        return
    width = max(map(len, rows))
    best, at = -1, 0
    for k, r in enumerate(rows[:10]):
        full = len(r) == width
        score = full * sum(bool(c.strip()) for c in r) - k + 2 * sum(kind_of([c])[0] == "string" and bool(c.strip()) for c in r) + 2 * (len({c for c in r if c.strip()}) == width)
        if score > best:
            best, at = score, k
    below = rows[at + 1 : at + 1 + SAMPLE_ROWS]
    head_kinds = [kind_of([c])[0] for c in rows[at]]
    kinds = [kind_of([r[i] if i < len(r) else "" for r in below])[0] for i in range(width)]
    strings = all(k == "string" for k in head_kinds)
    out.header = strings and (any(k != "string" for k in kinds) or not below or len({c.lower() for c in rows[at]}) == width and not any(set(rows[at]) & set(r) for r in below))
    out.skip = at if out.header else 0
    names = column_names(rows[at], width) if out.header else [f"Field_{i + 1}" for i in range(width)]
    data = below if out.header else rows[:SAMPLE_ROWS]
    out.fields = [Field(n, *kind_of([r[i] if i < len(r) else "" for r in data])) for i, n in enumerate(names)]


def column_names(cells: list[str], width: int) -> list[str]:
    """Blank names by place, repeated ones numbered."""
    out: list[str] = []
    seen: Counter = Counter()
    for i in range(width):
        n = (cells[i].strip() if i < len(cells) else "") or f"Field_{i + 1}"
        seen[n] += 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return out


def kind_of(cells: list[str]) -> tuple[str, str | None]:
    """The first type that all cells fit that are not null."""
    v = [c.strip() for c in cells if c.strip() not in NULLS]
    if not v:
        return "string", None
    fits = lambda p: all(re.fullmatch(p, x) for x in v)
    if all(x.lower() in BOOLEAN for x in v) and not all(x in "01" for x in v):
        return "boolean", None
    if fits(INTEGER):
        return "integer", None
    if fits(f"{DECIMAL}|{INTEGER}"):
        return "decimal", None
    for p, f in DATES:
        if fits(p):
            return "date", f
    for p, f in TIMES:
        if fits(p):
            return "time", f
    for p, f in DATES:
        for q, g in TIMES:
            for sep, lit in ((" ", " "), ("T", "'T'")):
                if fits(p + sep + q):
                    return "datetime", f"{f}{lit}{g}"
    if fits(r"(?s)<\?xml.*|<([A-Za-z_][\w.-]*)(\s[^>]*)?>.*</\1>"):
        return "xml", None
    if all(x[0] in "{[" and _is_json(x) for x in v):
        return ("geojson" if all('"type"' in x and ('"coordinates"' in x or '"geometry' in x or '"features"' in x) for x in v) else "json"), None
    if fits(WKT + r".*"):
        return "wkt", None
    if all(x[:1] == "<" and x[-1:] == ">" for x in v):
        inner = [y.strip() for x in v for y in x[1:-1].split(",") if y.strip()]
        return f"list_{kind_of(inner)[0] if inner else 'string'}", None
    if all("," in x for x in v):
        k = kind_of([y for x in v for y in x.split(",")])[0]
        if k in ("integer", "decimal", "boolean"):
            return f"list_{k}", None
    return "string", None


def _is_json(x: str) -> bool:
    try:
        json.loads(x)
        return True
    except ValueError:
        return False


def cell(c: Column, f: Field) -> Column:
    """A text cell as its type; null if it doesn't fit."""
    t = F.trim(c)
    raw = F.when(~t.isin(*NULLS), t)
    if f.kind == "boolean":
        low = F.lower(raw)
        return F.when(low.isin([k for k, v in BOOLEAN.items() if v]), True).when(low.isin([k for k, v in BOOLEAN.items() if not v]), False)
    if f.kind == "integer":
        return F.when(raw.rlike(f"^({INTEGER})$"), raw.try_cast("long"))
    if f.kind == "decimal":
        return F.when(raw.rlike(f"^({DECIMAL}|{INTEGER})$"), raw.try_cast("double"))
    if f.kind == "date":
        return F.try_to_timestamp(raw, F.lit(f.pattern)).cast("date")
    if f.kind == "datetime":
        return F.try_to_timestamp(raw, F.lit(f.pattern))
    if f.kind == "time":
        x = F.try_to_timestamp(raw, F.lit(f.pattern))
        return (F.hour(x) * 3600 + F.minute(x) * 60 + F.second(x)).cast("double")
    if f.kind.startswith("list_"):
        inner = Field(f.name, f.kind[5:])
        body = F.regexp_replace(raw, r"^<\s*|\s*>$", "")
        return F.when(body == "", F.array().cast("array<string>").cast(f"array<{_sql(inner.kind)}>")).otherwise(F.transform(F.split(body, ","), lambda e: cell(e, inner)))
    return raw


def _sql(kind: str) -> str:
    return {"integer": "bigint", "decimal": "double", "boolean": "boolean", "time": "double", "date": "date", "datetime": "timestamp"}.get(kind, "string")


def typed(raw: DataFrame, fields: list[Field]) -> DataFrame:
    """Typed columns, and in ``__error__`` the columns whose cell had a value that didn't fit."""
    cells = {f.name: cell(F.col(f"`{f.name}`"), f) for f in fields}
    bad = [F.when(~F.trim(F.col(f"`{f.name}`")).isin(*NULLS) & cells[f.name].isNull(), F.lit(f.name)) for f in fields]
    return raw.select(*[c.alias(n) for n, c in cells.items()], F.array_compact(F.array(*bad)).alias(ERROR))


def read_csv(spark: SparkSession, path: str, layout: Layout | None = None) -> DataFrame:
    """A delimited file, or a folder of files alike, typed by its sniffed layout.

    Records before the header are skipped by their place in the file, which only the
    task that reads its beginning has to know. Where the sample has a quoted line break
    a file is read as one piece, since it cannot be split at line breaks then. Records
    without any character are left out; blank cells are null.
    """
    x = layout or sniff(head(spark, _first(spark, path)))[0]
    schema = T.StructType([T.StructField(f.name, T.StringType()) for f in x.fields])
    r = spark.read.schema(schema).option("sep", x.delimiter).option("quote", x.quote).option("escape", x.escape or x.quote).option("encoding", x.encoding).option("mode", "PERMISSIVE").option("enforceSchema", "true").option("multiLine", str(x.multiline).lower())
    if x.comment:
        r = r.option("comment", x.comment)
    r = r.option("header", str(x.header and not x.skip).lower())
    if not x.skip:
        return typed(r.csv(path), x.fields)
    parts = [_after(r.csv(p), x.skip + 1) for p in sorted(r.csv(path).inputFiles())]
    return typed(reduce(DataFrame.unionAll, parts), x.fields)


def _after(raw: DataFrame, n: int) -> DataFrame:
    """One file's records without its first n: those of the split at its beginning, which its task reads first."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return raw.withColumns({"__begin": F.input_file_block_start(), "__place": place}).where((F.col("__begin") > 0) | (F.col("__place") >= n)).drop("__begin", "__place")


def _first(spark: SparkSession, path: str) -> str:
    """The file itself, or the first one of a folder."""
    files = sorted(spark.read.format("binaryFile").load(path).inputFiles())
    return files[0] if files else path


def numbered(df: DataFrame, by: list[str]) -> DataFrame:
    """A 1-based row number in the given order; no task orders the whole table."""
    return placed(df, by).withColumn(ROWNUM, (F.col("__place") + 1).cast("int")).drop("__place", "__all")


def read_bytes(spark: SparkSession, b: bytes) -> DataFrame:
    """A small file that is already in memory, as members of archives are."""
    x, _ = sniff(b[:SAMPLE_BYTES])
    text = b.decode({"UTF-16LE": "utf-16-le", "UTF-16BE": "utf-16-be", "windows-1252": "cp1252"}.get(x.encoding, "utf-8"), "replace").lstrip("﻿")
    if x.comment:
        text = "\n".join(r for r in text.splitlines() if not r.startswith(x.comment))
    rows = _records(text, x.delimiter, x)[x.skip + x.header :]
    w = len(x.fields)
    raw = spark.createDataFrame([tuple((r + [None] * w)[:w]) for r in rows], T.StructType([T.StructField(f.name, T.StringType()) for f in x.fields]))
    return typed(raw, x.fields)


def read_zip(spark: SparkSession, path: str, member: str | None = None) -> DataFrame:
    """A member of a ZIP file, the first one that is a file by default."""
    content = spark.read.format("binaryFile").load(path).select("content").first()[0]
    with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
        name = member or next(i.filename for i in z.infolist() if not i.is_dir())
        return read_bytes(spark, z.read(name))


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def sheet_rows(content: bytes, sheet: Any = 0) -> list[list[str]]:
    """The cells of a sheet of an XLSX file as text; sheet: its place or its name.

    Dates are numbers with a date format; they come out as ISO text, as booleans do as true and false.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        part = lambda n: ElementTree.fromstring(z.read(n))
        shared = ["".join(x.text or "" for x in i.iter(f"{{{_NS['m']}}}t")) for i in part("xl/sharedStrings.xml").findall("m:si", _NS)] if "xl/sharedStrings.xml" in names else []
        styles = part("xl/styles.xml") if "xl/styles.xml" in names else None
        formats = {int(x.get("numFmtId")): x.get("formatCode", "") for x in styles.iter(f"{{{_NS['m']}}}numFmt")} if styles is not None else {}
        used = [int(x.get("numFmtId", 0)) for x in styles.findall("m:cellXfs/m:xf", _NS)] if styles is not None else []
        is_date = [14 <= i <= 22 or 45 <= i <= 47 or bool(re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", formats.get(i, "")), re.I)) for i in used]
        links = {x.get("Id"): x.get("Target", "").lstrip("/").removeprefix("xl/") for x in part("xl/_rels/workbook.xml.rels")}
        sheets = part("xl/workbook.xml").findall("m:sheets/m:sheet", _NS)
        pick = sheets[sheet] if isinstance(sheet, int) else next(x for x in sheets if x.get("name") == sheet)
        link = next(v for k, v in pick.attrib.items() if k.endswith("}id"))
        out: list[list[str]] = []
        for row in part(f"xl/{links[link]}").findall("m:sheetData/m:row", _NS):
            cells: list[str] = []
            for c in row.findall("m:c", _NS):
                letters = re.match(r"[A-Z]+", c.get("r", ""))
                at = reduce(lambda n, x: 26 * n + ord(x) - 64, letters[0], 0) - 1 if letters else len(cells)
                cells += [""] * (at - len(cells)) + [_sheet_cell(c, shared, is_date)]
            while len(out) < int(row.get("r", len(out) + 1)) - 1:
                out.append([])
            out.append(cells)
        return out


def _sheet_cell(c: ElementTree.Element, shared: list[str], is_date: list[bool]) -> str:
    kind, v = c.get("t", "n"), c.find("m:v", _NS)
    if kind == "inlineStr":
        return "".join(x.text or "" for x in c.iter(f"{{{_NS['m']}}}t"))
    if v is None or v.text is None or kind == "e":
        return ""
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return "true" if v.text == "1" else "false"
    style = int(c.get("s", 0))
    if kind == "n" and style < len(is_date) and is_date[style]:
        when = datetime(1899, 12, 30) + timedelta(seconds=round(float(v.text) * 86400))
        return when.strftime("%Y-%m-%d" if when.time() == time(0) else "%Y-%m-%d %H:%M:%S" if float(v.text) >= 1 else "%H:%M:%S")
    return str(int(float(v.text))) if kind == "n" and float(v.text).is_integer() else v.text


def read_excel(spark: SparkSession, path: str, sheet: Any = 0) -> DataFrame:
    """A sheet of an XLSX file; of an XLS file where pandas has a reader for it. The file must fit in the driver."""
    content = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    out = io.StringIO()
    if content[:2] == b"PK":
        csv.writer(out).writerows(sheet_rows(content, sheet))
    else:
        import pandas as pd

        pd.read_excel(io.BytesIO(content), sheet_name=sheet, dtype=str, header=None).to_csv(out, index=False, header=False)
    return read_bytes(spark, out.getvalue().encode())


def read(spark: SparkSession, path: str, member: str | None = None, sheet: Any = 0) -> DataFrame:
    """By the first bytes: ZIP, XLSX (a ZIP with a workbook), XLS, else delimited text."""
    b = head(spark, path, 1 << 16)
    if b[:4] == b"PK\x03\x04":
        return read_excel(spark, path, sheet) if b"xl/" in b or b"[Content_Types].xml" in b else read_zip(spark, path, member)
    if b[:8] == b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
        return read_excel(spark, path, sheet)
    return read_csv(spark, path)


def narrowed(df: DataFrame) -> DataFrame:
    """Whole numbers in the narrowest type that holds them; one aggregate."""
    longs = [f.name for f in df.schema if f.dataType.typeName() == "long"]
    if not longs:
        return df
    most = df.agg(*[F.max(F.abs(c)).alias(c) for c in longs]).first()
    pick = lambda m: "byte" if m is None or m <= 127 else "short" if m <= 32767 else "int" if m < 2**31 else "long"
    return df.withColumns({c: F.col(c).cast(pick(most[c])) for c in longs})
