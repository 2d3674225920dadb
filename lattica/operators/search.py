"""Free-text search over several columns, and suggestions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDGE, CONTAINS, EQUALS, STARTS = "edge", "contains", "equals", "startswith"


@dataclass(frozen=True)
class Search:
    """columns: by name the match mode; None leaves a column out. Empty: all columns by edge."""

    term: str
    columns: dict[str, str | None] = field(default_factory=dict)
    exact: bool = False


def _number(word: str) -> float | None:
    try:
        return float(word)
    except ValueError:
        return None


def match(c: Column, kind: str, word: str, mode: str) -> Column:
    if kind in ("date", "timestamp", "timestamp_ntz"):
        parts = [F.year(c), F.month(c), F.date_format(c, "MMMM"), F.dayofmonth(c)]
        return reduce(lambda a, b: a | b, [match(p.cast("string"), "string", word, mode) for p in parts])
    if mode == EQUALS and kind not in ("string", "boolean", "array"):
        v = _number(word)
        return F.abs(c.cast("double") - v) < 1e-4 if v is not None else F.lit(False)
    t = F.lower(c.cast("string"))
    w = word.lower()
    if mode == EQUALS:
        return t == w
    if mode == STARTS:
        return t.startswith(w)
    if mode == CONTAINS:
        return F.contains(t, F.lit(w))
    return t.rlike(r"(^|\s)" + re.sub(r"([^\w\s])", r"\\\1", w))


def apply(df: DataFrame, s: Search) -> DataFrame:
    """Rows where every word matches some column; or, if exact, the whole term or two neighbouring words of it do; or a date equals a parsed one."""
    modes = {c: m for c, m in (s.columns or dict.fromkeys(df.columns, EDGE)).items() if m is not None}
    words = s.term.split()
    if not words or not modes:
        return df
    kinds = {c: df.schema[c].dataType.typeName() for c in modes}
    some = lambda w: reduce(lambda a, b: a | b, [F.coalesce(match(F.col(c), kinds[c], w, m), F.lit(False)) for c, m in modes.items()])
    if s.exact:
        phrases = [s.term] + [" ".join(p) for p in zip(words, words[1:], strict=False)]
        return df.where(reduce(lambda a, b: a | b, [some(p) for p in phrases]))
    cond = reduce(lambda a, b: a & b, [some(w) for w in words])
    days = [c for c, k in kinds.items() if k in ("date", "timestamp", "timestamp_ntz")]
    for k, w in enumerate(words):
        if days and re.fullmatch(r"\d{4}-\d{2}-\d{2}", w):
            equal = reduce(lambda a, b: a | b, [F.coalesce(F.to_date(F.col(c)) == F.lit(w).cast("date"), F.lit(False)) for c in days])
            rest = [some(x) for i, x in enumerate(words) if i != k]
            cond = cond | reduce(lambda a, b: a & b, [equal, *rest])
    return df.where(cond)


def suggestions(df: DataFrame, column: str, term: str | None = None, n: int | None = None, mode: str = CONTAINS) -> DataFrame:
    """Distinct values of a column in order, of all rows: one aggregation that combines on the map side."""
    d = df.select(column)
    if term:
        d = d.where(match(F.col(column), df.schema[column].dataType.typeName(), term, mode))
    d = d.where(F.col(column).isNotNull()).distinct().orderBy(column)
    return d.limit(n) if n else d
