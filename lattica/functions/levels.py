"""Pivot keys: date and time levels, their labels, numeric bins, list unnesting."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OTHER = "Other/Blank"


def week(c: Column) -> Column:
    """Weeks begin on Sunday; week 1 holds January 1."""
    first = F.trunc(c.cast("date"), "year")
    return (F.floor((F.dayofyear(c) + F.dayofweek(first) - 2) / 7) + 1).cast("int")


LEVELS = {
    "year": lambda c: F.year(c),
    "quarter": lambda c: F.quarter(c),
    "month": lambda c: F.month(c) - 1,
    "week": week,
    "day": lambda c: F.make_date(F.lit(2016), F.month(c), F.day(c)),
    "date": lambda c: F.to_date(c),
    "hour": lambda c: F.hour(c),
    "minute": lambda c: F.hour(c) * 60 + F.minute(c),
    "second": lambda c: F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c),
}


def _clock(minutes: Column) -> Column:
    hour = F.floor(minutes / 60).cast("int")
    return F.format_string("%d:%02d %s", F.when(hour % 12 == 0, 12).otherwise(hour % 12).cast("int"), (minutes % 60).cast("int"), F.when(hour < 12, "AM").otherwise("PM"))


LABELS = {
    "year": lambda c: F.year(c).cast("string"),
    "quarter": lambda c: F.concat(F.lit("Q"), F.quarter(c).cast("string")),
    "month": lambda c: F.date_format(c, "MMMM"),
    "week": lambda c: F.concat(F.lit("Wk "), week(c).cast("string")),
    "day": lambda c: F.date_format(c, "MMM dd"),
    "date": lambda c: F.date_format(c, "EEE, MMM dd, yyyy"),
    "hour": lambda c: _clock(F.hour(c) * 60),
    "minute": lambda c: _clock(F.hour(c) * 60 + F.minute(c)),
    "second": lambda c: F.date_format(c, "h:mm:ss a"),
}


@dataclass(frozen=True)
class Bins:
    low: float
    high: float
    size: float
    custom: bool = True
    whole: bool = True  # whether labels step by 1 rather than by 0.01

    def middle(self, c: Column) -> Column:
        """The middle of a value's bin; null if out of range."""
        begin = F.floor((c - self.low) / self.size).cast("double") * self.size + self.low
        end = begin + self.size
        if self.custom:
            begin, end = F.greatest(begin, F.lit(float(self.low))), F.least(end, F.lit(float(self.high)))
        return F.when((c >= self.low) & (c <= self.high), (begin + end) / 2)

    def label(self, c: Column) -> Column:
        begin = F.floor((c - self.low) / self.size).cast("double") * self.size + self.low
        end = begin + self.size
        if self.custom:
            begin, end = F.greatest(begin, F.lit(float(self.low))), F.least(end, F.lit(float(self.high)))
            end = F.when((end != self.high) | (end - begin == self.size), end - (1 if self.whole else 0.01)).otherwise(end)
        text = lambda x: F.regexp_replace(F.format_string("%.2f", x), r"\.?0+$", "")
        return F.when((c >= self.low) & (c <= self.high), F.concat(text(begin), F.lit(" - "), text(end))).otherwise(OTHER)


def default_bins(df: DataFrame, column: str) -> Bins:
    """ceil(sqrt(n)) bins between the rounded extremes; one small aggregate."""
    lo, hi, n = df.agg(F.min(column), F.max(column), F.count(F.lit(1))).first()
    whole = df.schema[column].dataType.typeName() not in ("double", "float", "decimal")
    if lo is None:
        return Bins(0, 10, 10, False, whole)
    k = math.ceil(math.sqrt(n))
    r = 1 if whole else 100
    low, high = math.floor(lo * r) / r, math.ceil(hi * r) / r
    size = math.floor((high - low) * r / k) / r or 10
    return Bins(low, high if high > low else low + size, size, False, whole)


def unnest(df: DataFrame, *columns: str) -> DataFrame:
    """One row for each element of each list column: a cross product over several; an empty list gives one null row."""
    for c in columns:
        df = df.withColumn(c, F.explode_outer(c))
    return df
