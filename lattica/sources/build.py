"""Tables from Python values, Arrow and schemas; type names."""

from __future__ import annotations

import re
from datetime import date, datetime, time
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

NAMES = {"integer": T.LongType(), "float": T.DoubleType(), "boolean": T.BooleanType(), "string": T.StringType(), "date": T.DateType(), "datetime": T.TimestampType(), "duration": T.DayTimeIntervalType(), "decimal": T.DecimalType(38, 10)}


def type_of(name: str) -> T.DataType:
    return T.ArrayType(NAMES[name[5:]]) if name.startswith("list_") else NAMES[name]


def name_of(t: T.DataType) -> str:
    k = t.typeName()
    if k == "array":
        return f"list_{name_of(t.elementType)}"
    return {"tinyint": "integer", "byte": "integer", "short": "integer", "smallint": "integer", "integer": "integer", "long": "integer", "bigint": "integer", "double": "float", "float": "float", "timestamp": "datetime", "timestamp_ntz": "datetime", "daytimeinterval": "duration", "interval day to second": "duration"}.get(k, k.split("(")[0])


def names(schema: T.StructType) -> dict[str, str]:
    return {f.name: name_of(f.dataType) for f in schema}


_DATE = re.compile(r"\d{4}-\d{2}-\d{2}$")
_DATETIME = re.compile(r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?$")


def _kind(v: Any) -> str | None:
    if v is None:
        return None
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "integer" if float(v).is_integer() and v != 0 and not isinstance(v, float) or isinstance(v, int) else "float"
    if isinstance(v, datetime):
        return "date" if v.time() == time(0) else "datetime"
    if isinstance(v, date):
        return "date"
    if isinstance(v, (list, tuple)):
        inner = next((k for x in v if (k := _kind(x))), "string")
        return f"list_{inner}"
    s = str(v).strip()
    if re.fullmatch(r"-?\d+", s):
        return "integer"
    if re.fullmatch(r"-?\d*\.\d+(e-?\d+)?", s, re.I):
        return "float"
    if _DATE.match(s):
        return "date"
    if _DATETIME.match(s):
        return "datetime"
    return "boolean" if s.lower() in ("true", "false") else "string"


def infer(values: list) -> str:
    """The narrowest type of all values; string where they don't agree."""
    kinds = {k for v in values if (k := _kind(v))}
    if not kinds:
        return "string"
    if len(kinds) == 1:
        return kinds.pop()
    return "float" if kinds <= {"integer", "float"} else "datetime" if kinds <= {"date", "datetime"} else "string"


def convert(v: Any, kind: str) -> Any:
    """A value as its type; None if it can't be."""
    if v is None or v == "" and kind != "string":
        return None
    try:
        if kind.startswith("list_"):
            return [convert(x, kind[5:]) for x in v]
        if kind == "integer":
            return int(float(v)) if not isinstance(v, int) else v
        if kind == "float":
            return float(v)
        if kind == "boolean":
            return v if isinstance(v, bool) else {"true": True, "false": False}[str(v).lower()]
        if kind == "date":
            return v.date() if isinstance(v, datetime) else v if isinstance(v, date) else date.fromisoformat(str(v))
        if kind == "datetime":
            return v if isinstance(v, datetime) else datetime(v.year, v.month, v.day) if isinstance(v, date) else datetime.fromisoformat(str(v))
        return str(v)
    except (ValueError, KeyError, TypeError):
        return None


def frame(spark: SparkSession, data: Any, like: T.StructType | None = None) -> DataFrame:
    """From a DataFrame, Arrow table, list of rows, dict of columns, or dict of type names (an empty table)."""
    if isinstance(data, DataFrame):
        return data
    if isinstance(data, (pa.Table, pa.RecordBatch)):
        return from_arrow(spark, data)
    if isinstance(data, (bytes, bytearray)):
        return from_arrow(spark, pa.ipc.open_stream(data).read_all() if data[:6] != b"ARROW1" else pa.ipc.open_file(data).read_all())
    if isinstance(data, dict) and data and all(isinstance(v, str) for v in data.values()):
        return spark.createDataFrame([], T.StructType([T.StructField(k, type_of(v)) for k, v in data.items()]))
    if isinstance(data, dict):
        n = len(next(iter(data.values()), []))
        data = [{k: v[i] for k, v in data.items()} for i in range(n)]
    cols = list(dict.fromkeys(k for r in data for k in r))
    known = names(like) if like is not None else {}
    kinds = {c: known.get(c) or infer([r.get(c) for r in data]) for c in cols}
    schema = T.StructType([T.StructField(c, like[c].dataType if c in known else type_of(kinds[c])) for c in cols])
    return spark.createDataFrame([tuple(convert(r.get(c), kinds[c]) for c in cols) for r in data], schema)


def from_arrow(spark: SparkSession, t: pa.Table | pa.RecordBatch) -> DataFrame:
    """Arrow columns of supported types; dictionaries decoded, binary as text, floats as double, others left out."""
    t = pa.Table.from_batches([t]) if isinstance(t, pa.RecordBatch) else t
    out = {}
    for f, c in zip(t.schema, t.columns, strict=True):
        k = f.type.value_type if pa.types.is_dictionary(f.type) else f.type
        c = c.cast(k) if pa.types.is_dictionary(f.type) else c
        if pa.types.is_nested(k) or pa.types.is_time(k) or pa.types.is_date(k) or pa.types.is_interval(k):
            continue
        if pa.types.is_floating(k):
            c = c.cast(pa.float64())
        elif pa.types.is_binary(k) or pa.types.is_large_binary(k):
            c = c.cast(pa.string())
        elif pa.types.is_timestamp(k):
            c = c.cast(pa.timestamp("us", k.tz), safe=False)
        elif pa.types.is_unsigned_integer(k):
            c = c.cast(pa.int64(), safe=False)
        out[f.name] = c
    return spark.createDataFrame(pa.table(out))
