"""Filters: op names to Columns.

Strings compare without regard to case. Ordering predicates never hold for null;
``!=`` and ``not contain`` do. A filter without a usable value is skipped.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.levels import LABELS
from . import dates


@dataclass(frozen=True)
class GroupFilter:
    """AND over groups of OR over fields of ``field not in values``."""

    groups: tuple[tuple[tuple[str, tuple], ...], ...]


def _low(c: Column, kind: str) -> Column:
    return F.lower(c) if kind == "string" else c


def _val(v: Any, kind: str) -> Any:
    return v.lower() if kind == "string" and isinstance(v, str) else v


def _printed(c: Column) -> Column:
    return F.lower(c.cast("string"))


def _between(c: Column, v: Any, kind: str, closed: bool = False) -> Column:
    lo, hi = sorted(_val(x, kind) for x in v)
    return (c >= F.lit(lo)) & ((c <= F.lit(hi)) if closed else (c < F.lit(hi)))


SCALAR = {
    "<": lambda c, v, k: _low(c, k) < F.lit(_val(v, k)),
    "<=": lambda c, v, k: _low(c, k) <= F.lit(_val(v, k)),
    ">": lambda c, v, k: _low(c, k) > F.lit(_val(v, k)),
    ">=": lambda c, v, k: _low(c, k) >= F.lit(_val(v, k)),
    "==": lambda c, v, k: _low(c, k) == F.lit(_val(v, k)),
    "!=": lambda c, v, k: F.coalesce(_low(c, k) != F.lit(_val(v, k)), F.lit(True)),
    "begins with": lambda c, v, k: F.lower(c).startswith(v.lower()),
    "ends with": lambda c, v, k: F.lower(c).endswith(v.lower()),
    "contains": lambda c, v, k: F.contains(_printed(c), F.lit(str(v).lower())),
    "not contain": lambda c, v, k: ~F.coalesce(F.contains(_printed(c), F.lit(str(v).lower())), F.lit(False)),
    "in": lambda c, v, k: _low(c, k).isin([_val(x, k) for x in v]),
    "not in": lambda c, v, k: c.isNotNull() & ~_low(c, k).isin([_val(x, k) for x in v]),
    "between": lambda c, v, k: _between(_low(c, k), v, k),
    "before": lambda c, v, k: c < F.lit(v),
    "after": lambda c, v, k: c > F.lit(v),
    "in (any)": lambda c, v, k: F.arrays_overlap(c, F.array(*[F.lit(x) for x in v])) if v else F.lit(True),
    "in (all)": lambda c, v, k: F.size(F.array_except(F.array(*[F.lit(x) for x in v]), c)) == 0 if v else F.lit(True),
}
NO_VALUE = {
    "is nan": lambda c, k: F.isnan(c),
    "is not nan": lambda c, k: ~F.isnan(c),
    "is None": lambda c, k: c.isNull(),
    "is not None": lambda c, k: c.isNotNull(),
    "empty": lambda c, k: c.isNull() | (F.size(c) == 0) if k == "array" else c.isNull(),
    "not empty": lambda c, k: c.isNotNull() & (F.size(c) > 0) if k == "array" else c.isNotNull(),
    "is true": lambda c, k: F.coalesce(c, F.lit(False)),
    "is false": lambda c, k: ~F.coalesce(c, F.lit(True)),
    "all date range": lambda c, k: F.lit(True),
    "ignore all": lambda c, k: F.lit(False),
    "top n": lambda c, k: F.lit(True),
}
#: Some element satisfies the scalar predicate.
ELEMENT = {
    "element equals": "==", "element contains": "contains", "element begins with": "begins with", "element ends with": "ends with", "element greater": ">", "element greater or equal": ">=",
    "element less": "<", "element less or equal": "<=", "element before": "before", "element after": "after", "element is true": "is true", "element is false": "is false",
}
NONE_OF = {"element not equals": "==", "element not contains": "contains"}
OPS = {*SCALAR, *NO_VALUE, *ELEMENT, *NONE_OF, "element in", "element not in", "element between", "relative date", *dates.LAST_DAYS, *dates.NAMED}


def _scalar(op: str, c: Column, value: Any, kind: str) -> Column | None:
    if op in NO_VALUE:
        return NO_VALUE[op](c, kind)
    if value is None:
        return None  # nothing to compare with
    return SCALAR[op](c, value, kind)


def predicate(df: DataFrame, f: Any, now: datetime) -> Column | None:
    if isinstance(f, GroupFilter):
        return reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [F.col(c).isNotNull() & ~F.col(c).isin(list(v)) for c, v in g]) for g in f.groups])
    c, t = F.col(f.column), df.schema[f.column].dataType
    kind, inner = t.typeName(), getattr(t, "elementType", None)
    if f.bins is not None:
        return _scalar(f.op, f.bins.label(c), f.value, "string")
    if f.level is not None:
        return _scalar(f.op, F.year(c), int(f.value), "integer") if f.level == "year" else _scalar(f.op, LABELS[f.level](c), f.value, "string")
    if f.op in dates.LAST_DAYS or f.op in dates.NAMED or f.op == "relative date":
        lo, hi = dates.relative_range(*f.value, now) if f.op == "relative date" else dates.named_range(f.op, now)
        return c >= F.lit(lo) if hi is None else (c >= F.lit(lo)) & (c < F.lit(hi))
    if f.op in ELEMENT or f.op in NONE_OF:
        k = inner.typeName()
        if (ELEMENT | NONE_OF)[f.op] not in NO_VALUE and f.value is None:
            return None
        some = F.coalesce(F.exists(c, lambda e: _scalar((ELEMENT | NONE_OF)[f.op], e, f.value, k)), F.lit(False))
        return ~some if f.op in NONE_OF else some
    if f.op in ("element in", "element not in"):
        k = inner.typeName()
        some = F.coalesce(F.exists(c, lambda e: SCALAR["in"](e, f.value, k)), F.lit(False))
        return some if f.op == "element in" else ~some
    if f.op == "element between":
        return F.exists(c, lambda e: _between(_low(e, inner.typeName()), f.value, inner.typeName(), closed=True))
    if kind == "array" and f.op in ("in", "not in"):
        return F.exists(c, lambda e: SCALAR[f.op](e, f.value, inner.typeName()))
    return _scalar(f.op, c, f.value, kind)


def is_valid(df: DataFrame, f: Any) -> bool:
    """Whether a filter names a column and an op and has the value that the op needs."""
    if getattr(f, "column", None) not in df.columns or f.op not in OPS:
        return False
    return f.op in NO_VALUE or f.op in dates.NAMED or f.op in dates.LAST_DAYS or f.value is not None


def apply(df: DataFrame, filters: tuple, op: str = "and", now: datetime | None = None) -> DataFrame:
    now = now or datetime.now()
    ps = [p for f in filters if (p := predicate(df, f, now)) is not None]
    return df.where(reduce((lambda a, b: a & b) if op == "and" else (lambda a, b: a | b), ps)) if ps else df
