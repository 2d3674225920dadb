"""Declarative view configuration: what a view computes, validated before any plan is built."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from .functions.aggregates import AGGREGATES
from .functions.levels import LEVELS, Bins
from .operators.filters import OPS

#: Names of sort and show types.
SORTS = ("none", "asc", "desc", "asc abs", "desc abs", "col asc", "col desc", "col asc abs", "col desc abs")
SHOWS = ("default", "%_of_row", "%_of_column", "%_of_grand_total", "%_of_parent_row", "%_of_parent_column", "running_total", "running_%", "diff_from_prev_value", "%_of_prev_value")
ITEMS, PERCENT = "Items", "Percent"


class ConfigError(ValueError):
    """A view configuration that cannot be planned."""


@dataclass(frozen=True)
class Pivot:
    column: str
    level: str | None = None
    bins: Bins | None = None
    subtotal: bool = True
    unnest: bool = False


@dataclass(frozen=True)
class Agg:
    """op over a column; ``by`` is its second input (weight, order or key); ``scale`` the weights of add, div and mul."""

    op: str
    column: str | None = None
    by: str | None = None
    scale: tuple[float, float] = (1.0, 1.0)


@dataclass(frozen=True)
class Filter:
    column: str
    op: str
    value: Any = None
    level: str | None = None
    bins: Bins | None = None


@dataclass(frozen=True)
class Having:
    """Keep the children at pivot ``level`` (1 is the outermost) whose aggregate satisfies op."""

    aggregate: str
    op: str
    value: Any
    level: int = 1


@dataclass(frozen=True)
class Limit:
    """Keep the first n (or n percent of the) children at pivot ``level`` by an aggregate."""

    n: float
    by: str
    level: int = 1
    kind: str = ITEMS
    descending: bool = True


@dataclass(frozen=True)
class ViewConfig:
    row_pivots: tuple[Pivot, ...] = ()
    column_pivots: tuple[Pivot, ...] = ()
    columns: tuple[str, ...] = ()
    aggregates: dict[str, Agg] = field(default_factory=dict)
    filters: tuple[Any, ...] = ()
    filter_op: str = "and"
    computed: dict[str, str] = field(default_factory=dict)
    search: Any = None
    havings: tuple[Having, ...] = ()
    limits: tuple[Limit, ...] = ()
    sort: tuple[tuple[str, str], ...] = ()
    top: tuple[float, str] | None = None
    show: dict[str, str] = field(default_factory=dict)
    items_per_page: int | None = None
    page_num: int = 1
    row_pivot_depth: int | None = None
    key: str | None = None

    def __post_init__(self):
        piv = lambda ps: tuple(Pivot(p) if isinstance(p, str) else p for p in ps)
        object.__setattr__(self, "row_pivots", piv(self.row_pivots))
        object.__setattr__(self, "column_pivots", piv(self.column_pivots))
        object.__setattr__(self, "filters", tuple(Filter(*f) if isinstance(f, (tuple, list)) else f for f in self.filters))
        self.validate()

    def validate(self) -> None:
        if self.filter_op not in ("and", "or"):
            raise ConfigError(f"filter_op: {self.filter_op}")
        for a in self.aggregates.values():
            if a.op not in AGGREGATES:
                raise ConfigError(f"unknown aggregate: {a.op}")
        for p in (*self.row_pivots, *self.column_pivots):
            if p.level and p.level not in LEVELS:
                raise ConfigError(f"unknown level: {p.level}")
        for f in self.filters:
            if getattr(f, "op", None) is not None and f.op not in OPS:
                raise ConfigError(f"unknown filter: {f.op}")
        for _, s in self.sort:
            if s not in SORTS:
                raise ConfigError(f"unknown sort: {s}")
        for s in self.show.values():
            if s not in SHOWS:
                raise ConfigError(f"unknown show type: {s}")
        for h in (*self.havings, *self.limits):
            if not 1 <= h.level <= len(self.row_pivots):
                raise ConfigError(f"no such pivot level: {h.level}")

    @property
    def sides(self) -> int:
        return 2 if self.column_pivots else 1 if self.row_pivots else 0

    @staticmethod
    def of(**options: Any) -> ViewConfig:
        """From plain options with the usual other names; unknown ones are an error."""
        names = {"row_pivot": "row_pivots", "row-pivots": "row_pivots", "column_pivot": "column_pivots", "column-pivots": "column_pivots", "aggregate": "aggregates", "filter": "filters", "sorts": "sort", "having": "havings", "computed_columns": "computed"}
        clean = {names.get(k, k): v for k, v in options.items()}
        if bad := set(clean) - set(ViewConfig.__dataclass_fields__):
            raise ConfigError(f"unknown options: {sorted(bad)}")
        return ViewConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in clean.items()})

    def changed(self, **options: Any) -> ViewConfig:
        return replace(self, **options)
