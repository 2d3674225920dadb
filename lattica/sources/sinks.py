"""Results as JSON rows, columns, CSV and Arrow; large ones as files."""

from __future__ import annotations

import csv as _csv
import io
import json

import pyarrow as pa
from pyspark.sql import DataFrame


def rows(df: DataFrame) -> list[dict]:
    return df.toArrow().to_pylist()


def columns(df: DataFrame) -> dict[str, list]:
    return df.toArrow().to_pydict()


def csv(df: DataFrame) -> str:
    t = df.toArrow()
    out = io.StringIO()
    w = _csv.writer(out, lineterminator="\n")
    w.writerow(t.column_names)
    for r in t.to_pylist():
        w.writerow(["" if v is None else json.dumps(v) if isinstance(v, (list, dict)) else v for v in r.values()])
    return out.getvalue()


def arrow(df: DataFrame) -> pa.Table:
    return df.toArrow()


def arrow_bytes(df: DataFrame) -> bytes:
    t = df.toArrow()
    out = io.BytesIO()
    with pa.ipc.new_stream(out, t.schema) as w:
        w.write_table(t)
    return out.getvalue()


def column(df: DataFrame, name: str):
    """One column as a numpy array."""
    return df.select(name).toArrow()[name].to_numpy()


def write(df: DataFrame, path: str, fmt: str = "parquet", **options) -> None:
    """Without the driver: parquet, csv, json or orc files."""
    df.write.format(fmt).options(**options).mode("overwrite").save(path)
