"""Table and View: the API of a keyed table with live, immutable views."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import ViewConfig
from .functions import aggregates, computed, levels
from .operators import filters, search, updates
from .plans import view as planner
from .plans.stable import stable
from .sources import build, sinks

ARRIVAL = "__arrival"
#: Updates after which the rows are written, so that plans stay short.
ROUNDS = 8


class View:
    """A configuration over a table's current rows. Changing an option gives a new view."""

    def __init__(self, table: Table, config: ViewConfig, now: datetime | None = None):
        self.table, self.config, self.now = table, config, now
        self._cached: DataFrame | None = None
        self._expanded: int | None = config.row_pivot_depth
        self._callbacks: list[tuple[str, Callable]] = []
        self._deleted: list[Callable] = []

    @property
    def sides(self) -> int:
        return self.config.sides

    def to_df(self) -> DataFrame:
        if self._cached is not None:
            return self._cached
        out = planner.build(self.table.df, self.config, self.now)
        depth = "row_level" if self.sides == 2 else "level"
        return out.where(F.col(depth) <= self._expanded) if self.sides and self._expanded is not None else out

    def schema(self) -> dict[str, str]:
        return build.names(self.to_df().schema)

    def columns(self) -> list[str]:
        return self.to_df().columns

    def num_rows(self) -> int:
        return self.to_df().count()

    def num_columns(self) -> int:
        return len(self.columns())

    def get_config(self) -> ViewConfig:
        return self.config

    def set_depth(self, depth: int) -> View:
        self._expanded = depth
        return self

    expand_to = set_depth

    def nested(self) -> DataFrame:
        """The view with one path for each row in place of its pivot columns."""
        return planner.nested(self.to_df(), [planner.key_name(p) for p in self.config.row_pivots], "row_level" if self.sides == 2 else "level")

    def children(self, *path: Any) -> DataFrame:
        """The rows right below a path: what expanding that node shows."""
        keys = [planner.key_name(p) for p in self.config.row_pivots]
        out = planner.build(self.table.df, self.config, self.now).where(F.col("level") == len(path) + 1)
        for k, v in zip(keys, path, strict=False):
            out = out.where(F.col(k).eqNullSafe(F.lit(v)))
        return out

    def get_row_expanded(self, level: int) -> bool:
        return level < (self._expanded if self._expanded is not None else len(self.config.row_pivots))

    def subtotal_list(self) -> list[bool]:
        return [p.subtotal for p in self.config.row_pivots]

    def window(self, start_row: int = 0, end_row: int | None = None, start_col: int = 0, end_col: int | None = None) -> DataFrame:
        out = self.to_df()
        return planner.window_of_data(out, planner.order(out, self.config.sort, self.config.key) if not self.sides else [], start_row, end_row, start_col, end_col)

    def to_json(self, **window: Any) -> list[dict]:
        return sinks.rows(self.window(**window) if window else self.to_df())

    def to_columns(self, **window: Any) -> dict[str, list]:
        return sinks.columns(self.window(**window) if window else self.to_df())

    def to_csv(self, **window: Any) -> str:
        return sinks.csv(self.window(**window) if window else self.to_df())

    def to_arrow(self, **window: Any):
        return sinks.arrow(self.window(**window) if window else self.to_df())

    def col_to_array(self, column: str):
        return sinks.column(self.to_df(), column)

    def selection(self, columns: list[str]) -> DataFrame:
        return planner.summary(self.to_df(), columns)

    def min_max(self, aggregate: str, depth: int) -> tuple:
        return tuple(self.to_df().where(F.col("row_level" if self.sides == 2 else "level") == depth).agg(F.min(aggregate), F.max(aggregate)).first())

    def truncated_columns(self) -> list[str]:
        """Aggregates of distinct values that some row has too many of."""
        lists = {n: aggregates_of(a.column) for n, a in self.config.aggregates.items() if a.op == "distinct values"}
        if not lists:
            return []
        got = planner.build(self.table.df, self.config.changed(aggregates=lists), self.now).agg(*[F.bool_or(n).alias(n) for n in lists]).first()
        return [n for n in lists if got[n]]

    def update_show_type(self, column: str, show: str) -> View:
        return View(self.table, self.config.changed(show={**self.config.show, column: show}), self.now)

    def update_pagination_setting(self, items_per_page: int, page_num: int = 1) -> View:
        return View(self.table, self.config.changed(items_per_page=items_per_page, page_num=page_num), self.now)

    def enable_cache(self) -> View:
        self._cached = self.to_df().cache()
        return self

    def disable_cache(self) -> View:
        if self._cached is not None:
            self._cached.unpersist()
            self._cached = None
        return self

    def on_update(self, callback: Callable, mode: str = "none") -> None:
        """mode: none (no argument), rows (changed rows of this view) or pkey (changed keys)."""
        if mode not in ("none", "rows", "pkey"):
            raise ValueError(f"unknown mode: {mode}")
        self._callbacks.append((mode, callback))

    def remove_update(self, callback: Callable) -> None:
        self._callbacks = [c for c in self._callbacks if c[1] is not callback]

    def on_delete(self, callback: Callable) -> None:
        self._deleted.append(callback)

    def delete(self) -> None:
        self.disable_cache()
        self.table._views.remove(self)
        for c in self._deleted:
            c()

    def _notify(self, before: DataFrame, changed: DataFrame | None) -> None:
        for mode, callback in list(self._callbacks):
            if mode == "none":
                callback()
            elif mode == "rows":
                callback(updates.row_delta(before, planner.build(self.table.df, self.config, self.now)))
            else:
                callback(changed.select(self.table.index) if changed is not None and self.table.index else None)


def aggregates_of(column: str):
    from .config import Agg

    return Agg("distinct values truncated", column)


class Table:
    """Rows with an arrival number; keyed by ``index``, or a ring of ``limit`` rows, or append-only."""

    def __init__(self, spark: SparkSession, data: Any, index: str | None = None, limit: int | None = None):
        if index and limit:
            raise ValueError("a table has an index or a limit, not both")
        self.spark, self.index, self.limit = spark, index, limit
        self._views: list[View] = []
        self._deleted: list[Callable] = []
        self._batch = self._arrivals = self._since = 0
        self._held: DataFrame | None = None
        self._rows = self._arrived(build.frame(spark, data))
        self._settle()

    def _arrived(self, df: DataFrame) -> DataFrame:
        """Rows numbered in order of arrival: by batch, then by place in it.

        A ring needs numbers without gaps: a row's place in its partition after the rows of the
        partitions before, which are counted. Only the counts reach the driver. The newest rows of each
        partition are computed once, since a plan that runs again may deal rows to partitions otherwise.
        """
        if ARRIVAL not in df.columns and self.limit:
            df = stable(updates.tails(df, self.limit, ARRIVAL))
            part, place = F.shiftright(ARRIVAL, 33), F.col(ARRIVAL).bitwiseAND(F.lit((1 << 33) - 1))
            before = {}
            for p, last in sorted(map(tuple, df.groupBy(part.alias("p")).agg(F.max(place)).collect())):
                before[p], self._arrivals = self._arrivals, self._arrivals + last + 1
            bases = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else F.lit(None).cast("map<bigint,bigint>")
            df = df.withColumn(ARRIVAL, place + F.element_at(bases, part).cast("long"))
        elif ARRIVAL not in df.columns:
            df = df.withColumn(ARRIVAL, F.struct(F.lit(self._batch).alias("batch"), F.monotonically_increasing_id().alias("place")))
        self._batch += 1
        return df

    def _settle(self) -> None:
        if self.index:
            self._rows = updates.latest(self._rows, self.index, ARRIVAL)
        elif self.limit:
            self._rows = updates.ring(self._rows, self.limit, ARRIVAL)

    def _kept(self) -> None:
        """Every ROUNDS updates write the rows to the folder that executors share, if there is one, else hold them in memory and on disk."""
        self._since += 1
        if self._since < ROUNDS:
            return
        self._since = 0
        if self.spark.sparkContext.getCheckpointDir():
            self._rows = self._rows.checkpoint(eager=True)
        else:
            old, self._held = self._held, self._rows.persist()
            self._held.count()
            if old is not None:
                old.unpersist()

    @property
    def df(self) -> DataFrame:
        return self._rows.drop(ARRIVAL)

    def view(self, config: ViewConfig | None = None, now: datetime | None = None, **options: Any) -> View:
        v = View(self, config or ViewConfig.of(**options), now)
        self._views.append(v)
        return v

    def update(self, data: Any) -> None:
        """Upsert by index, where columns that the batch lacks keep their value; else append."""
        before = [(v, planner.build(self.df, v.config, v.now) if v._callbacks else None) for v in self._views]
        new = self._arrived(build.frame(self.spark, data, self.df.schema))
        if self.index:
            self._rows = updates.partial(self._rows, new, self.index, ARRIVAL, {c: F.lit(True) for c in new.columns if c != self.index})
        else:
            self._rows = updates.append(self._rows, new)
            self._settle()
        self._changed(before, new)

    def remove(self, keys: list) -> None:
        before = [(v, planner.build(self.df, v.config, v.now) if v._callbacks else None) for v in self._views]
        gone = self.spark.createDataFrame([(k,) for k in keys], self._rows.select(self.index).schema)
        self._rows = updates.remove(self._rows, gone, self.index)
        self._changed(before, gone)

    def clear(self) -> None:
        self._rows = self._rows.limit(0)
        self._changed([(v, None) for v in self._views], None)

    def replace(self, data: Any) -> None:
        self._rows = self._arrived(build.frame(self.spark, data, self.df.schema))
        self._settle()
        self._changed([(v, None) for v in self._views], None)

    def _changed(self, before: list, new: DataFrame | None) -> None:
        self._kept()
        for v, old in before:
            v.disable_cache()
            if v._callbacks:
                v._notify(old if old is not None else planner.build(self.df, v.config, v.now).limit(0), new)

    def size(self) -> int:
        return self._rows.count()

    def schema(self) -> dict[str, str]:
        return build.names(self.df.schema)

    def columns(self) -> list[str]:
        return self.df.columns

    def column_metadata(self) -> list[dict]:
        return [{"name": f.name, "type": build.name_of(f.dataType), "format": f.metadata.get("format")} for f in self.df.schema]

    def set_format(self, column: str, fmt: str) -> None:
        """Display formats are metadata only."""
        self._rows = self._rows.withMetadata(column, {"format": fmt})

    def rename(self, names: dict[str, str]) -> None:
        self._rows = self._rows.withColumnsRenamed(names)

    def add_computed(self, **expressions: Any) -> Table:
        """A new table with computed columns; an expression is text or a function from the DataFrame to a Column."""
        t = Table.__new__(Table)
        t.__dict__ = self.__dict__ | {"_views": [], "_rows": self._rows}
        for name, e in expressions.items():
            t._rows = t._rows.withColumn(name, e(t._rows) if callable(e) else computed.parse(e)[0])
        return t

    def computed_schema(self, **expressions: str) -> dict[str, str]:
        return build.names(self.add_computed(**expressions).df.select(*expressions).schema)

    def get_computed_functions(self) -> dict:
        return computed.computed_functions()

    def get_computation_input_types(self, function: str) -> list[str]:
        return list(computed.FUNCTIONS[computed.ALIASES.get(function, function)].inputs)

    def agg_custom_schema(self, aggs: dict) -> dict[str, str]:
        return View(self, ViewConfig(aggregates=aggs, row_pivots=(self.columns()[0],))).schema()

    def default_aggregates(self) -> dict[str, str]:
        return {f.name: aggregates.default(f.dataType.typeName()) for f in self.df.schema}

    def get_default_binning(self, column: str) -> levels.Bins:
        return levels.default_bins(self.df, column)

    def is_valid_filter(self, f: Any) -> bool:
        return filters.is_valid(self.df, f)

    def is_valid_having(self, h: Any, config: ViewConfig) -> bool:
        return h.aggregate in config.aggregates and h.op in filters.OPS and h.value is not None

    def longest_text(self) -> DataFrame:
        return longest_text(self.df)

    def suggestions(self, column: str, term: str | None = None, n: int | None = None) -> list:
        return [r[0] for r in search.suggestions(self.df, column, term, n).collect()]

    def execute(self, f: Callable[[Table], Any]) -> Any:
        return f(self)

    def on_delete(self, callback: Callable) -> None:
        self._deleted.append(callback)

    def delete(self) -> None:
        for v in list(self._views):
            v.delete()
        for c in self._deleted:
            c()


def longest_text(df: DataFrame) -> DataFrame:
    """By string column its longest value, the first in order on a tie."""
    cols = [f.name for f in df.schema if f.dataType.typeName() == "string"]
    return df.agg(*[F.min_by(F.col(c), F.struct(-F.length(c), F.col(c))).alias(c) for c in cols])


def table(spark: SparkSession, data: Any, index: str | None = None, limit: int | None = None) -> Table:
    return Table(spark, data, index, limit)
