"""Computed columns: the function registry and the expression language.

A null input gives null. Arithmetic is in double. ``log(0)`` is -infinity and a
division by zero is null, with its text in the column's error companion.
Functions that are only declared upstream are given the meaning of their help text.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

DIV_ZERO = "#DIV#ZERO"
_d = lambda c: c.cast("double")


def _bin(k: float) -> Callable[[Column], Column]:
    return lambda c: F.floor(_d(c) / k).cast("double") * k


@dataclass(frozen=True)
class Function:
    build: Callable[..., Column]
    inputs: tuple[str, ...]
    output: str


NUMBER, TEXT, TIME = "number", "string", "datetime"
FUNCTIONS: dict[str, Function] = {
    "+": Function(lambda a, b: _d(a) + _d(b), (NUMBER, NUMBER), "float"),
    "-": Function(lambda a, b: _d(a) - _d(b), (NUMBER, NUMBER), "float"),
    "*": Function(lambda a, b: _d(a) * _d(b), (NUMBER, NUMBER), "float"),
    "/": Function(lambda a, b: F.try_divide(_d(a), _d(b)), (NUMBER, NUMBER), "float"),
    "%": Function(lambda a, b: F.when(b != 0, 100 * _d(a) / _d(b)), (NUMBER, NUMBER), "float"),
    "^": Function(lambda a, b: F.pow(_d(a), _d(b)), (NUMBER, NUMBER), "float"),
    "==": Function(lambda a, b: a == b, (NUMBER, NUMBER), "boolean"),
    "!=": Function(lambda a, b: a != b, (NUMBER, NUMBER), "boolean"),
    ">": Function(lambda a, b: a > b, (NUMBER, NUMBER), "boolean"),
    "<": Function(lambda a, b: a < b, (NUMBER, NUMBER), "boolean"),
    "is": Function(lambda a, b: a == b, (TEXT, TEXT), "boolean"),
    "invert": Function(lambda a: F.when(a != 0, 1 / _d(a)), (NUMBER,), "float"),
    "pow2": Function(lambda a: _d(a) * _d(a), (NUMBER,), "float"),
    "sqrt": Function(lambda a: F.sqrt(_d(a)), (NUMBER,), "float"),
    "abs": Function(lambda a: F.abs(_d(a)), (NUMBER,), "float"),
    "log": Function(lambda a: F.when(_d(a) == 0, F.lit(float("-inf"))).when(_d(a) < 0, F.lit(float("nan"))).otherwise(F.log(_d(a))), (NUMBER,), "float"),
    "exp": Function(lambda a: F.exp(_d(a)), (NUMBER,), "float"),
    "bin10": Function(_bin(10), (NUMBER,), "float"),
    "bin100": Function(_bin(100), (NUMBER,), "float"),
    "bin1000": Function(_bin(1000), (NUMBER,), "float"),
    "bin10th": Function(_bin(0.1), (NUMBER,), "float"),
    "bin100th": Function(_bin(0.01), (NUMBER,), "float"),
    "bin1000th": Function(_bin(0.001), (NUMBER,), "float"),
    "length": Function(lambda a: F.octet_length(a).cast("long"), (TEXT,), "integer"),
    "uppercase": Function(lambda a: F.upper(a), (TEXT,), "string"),
    "lowercase": Function(lambda a: F.lower(a), (TEXT,), "string"),
    "concat_space": Function(lambda a, b: F.concat(a, F.lit(" "), b), (TEXT, TEXT), "string"),
    "concat_comma": Function(lambda a, b: F.concat(a, F.lit(", "), b), (TEXT, TEXT), "string"),
    "hour_of_day": Function(lambda a: F.hour(a), (TIME,), "integer"),
    "day_of_week": Function(lambda a: F.concat(F.dayofweek(a).cast("string"), F.lit(" "), F.date_format(a, "EEEE")), (TIME,), "string"),
    "month_of_year": Function(lambda a: F.date_format(a, "MM MMMM"), (TIME,), "string"),
    "second_bucket": Function(lambda a: F.date_trunc("second", a), (TIME,), "datetime"),
    "minute_bucket": Function(lambda a: F.date_trunc("minute", a), (TIME,), "datetime"),
    "hour_bucket": Function(lambda a: F.date_trunc("hour", a), (TIME,), "datetime"),
    "day_bucket": Function(lambda a: F.to_date(a), (TIME,), "date"),
    "week_bucket": Function(lambda a: F.to_date(F.date_trunc("week", a)), (TIME,), "date"),
    "month_bucket": Function(lambda a: F.trunc(a.cast("date"), "month"), (TIME,), "date"),
    "year_bucket": Function(lambda a: F.trunc(a.cast("date"), "year"), (TIME,), "date"),
}
ALIASES = {"add": "+", "subtract": "-", "multiply": "*", "divide": "/", "percent_of": "%", "pow": "^", "equals": "==", "not_equals": "!=", "greater_than": ">", "less_than": "<", "uppercase": "uppercase"}
_TOKEN = re.compile(r"\s*(?:(?P<number>\d+\.?\d*(?:[eE][+-]?\d+)?)|\"(?P<column>[^\"]*)\"|'(?P<text>[^']*)'|(?P<op>==|!=|[-+*/%^<>(),])|(?P<name>[A-Za-z_]\w*))")
#: Binding strength; operators of one strength associate to the left.
_BINDS = {"^": 3, "*": 2, "/": 2, "+": 1, "-": 1, "%": 0, "==": 0, "!=": 0, ">": 0, "<": 0, "is": 0}


class ExpressionError(ValueError):
    """An expression that cannot be parsed."""


def apply(name: str, *inputs: Column) -> Column:
    f = FUNCTIONS.get(ALIASES.get(name, name))
    if f is None:
        raise ExpressionError(f"unknown function: {name}")
    if len(inputs) != len(f.inputs):
        raise ExpressionError(f"{name} takes {len(f.inputs)} inputs")
    return f.build(*inputs)


def error_of(name: str, *inputs: Column) -> Column:
    """Text of an ERROR cell, else null."""
    if ALIASES.get(name, name) == "/":
        return F.when(inputs[0].isNotNull() & (inputs[1] == 0), DIV_ZERO)
    return F.lit(None).cast("string")


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"cannot read: {text[at:]}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


def parse(text: str) -> tuple[Column, str | None]:
    """An expression and the name after ``as``. Columns are in double quotes, strings in single ones."""
    tokens = _tokens(text)
    name = None
    if len(tokens) > 2 and tokens[-2] == ("name", "as"):
        name = tokens[-1][1]
        tokens = tokens[:-2]
    at = 0

    def peek() -> tuple[str, str] | tuple[None, None]:
        return tokens[at] if at < len(tokens) else (None, None)

    def primary() -> Column:
        nonlocal at
        kind, v = peek()
        at += 1
        if kind == "number":
            return F.lit(float(v))
        if kind == "column":
            return F.col(f"`{v}`")
        if kind == "text":
            return F.lit(v)
        if (kind, v) == ("op", "-"):
            return -primary()
        if (kind, v) == ("op", "("):
            inner = binary(0)
            expect(")")
            return inner
        if kind == "name":
            expect("(")
            args = [binary(0)]
            while peek() == ("op", ","):
                at += 1
                args.append(binary(0))
            expect(")")
            return apply(v, *args)
        raise ExpressionError(f"unexpected {v!r} in: {text}")

    def expect(op: str) -> None:
        nonlocal at
        if peek() != ("op", op):
            raise ExpressionError(f"expected {op!r} in: {text}")
        at += 1

    def binary(least: int) -> Column:
        nonlocal at
        left = primary()
        while peek()[1] in _BINDS and peek()[0] in ("op", "name") and _BINDS[peek()[1]] >= least:
            op = peek()[1]
            at += 1
            left = apply(op, left, binary(_BINDS[op] + 1))
        return left

    out = binary(0)
    if at != len(tokens):
        raise ExpressionError(f"unexpected {peek()[1]!r} in: {text}")
    return out, name


def computed_functions() -> dict[str, dict]:
    return {k: {"inputs": list(f.inputs), "output": f.output} for k, f in FUNCTIONS.items()}
