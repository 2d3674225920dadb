"""Licence scans: Aho-Corasick phrases and identifier tags, shunting-yard expressions.

One automaton holds the notice phrases, one the identifier tag. A text's words
(A-Z lowered; runs of letters, digits and characters beyond ASCII) are joined by
single spaces, so that a phrase's words stand consecutively exactly where the
automaton reports the phrase between spaces. An expression after a tag goes up
to the end of its line; a shunting-yard parser turns it into postfix order, with
``with`` binding closest, then ``and``, then ``or``. Its evaluation gives the
licences it names and whether its terms can be met by permissive ones alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import as_bytes, small_batches, struct, tidy

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notice phrases, in words, with the label each gives and how sure it is.
NOTICES = {
    "apache license": ("apache", 0.8),
    "bsd license": ("bsd", 0.7),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "mit license": ("mit", 0.8),
    "permission is hereby granted free of charge": ("mit", 0.9),
    "mozilla public license": ("mpl", 0.8),
    "lesser general public license": ("lgpl", 0.8),
    "affero general public license": ("agpl", 0.8),
    "eclipse public license": ("epl", 0.8),
    "boost software license": ("bsl", 0.8),
    "isc license": ("isc", 0.7),
    "creative commons attribution": ("cc-by", 0.8),
    "creative commons zero": ("cc0", 0.8),
    "cc by sa": ("cc-by-sa", 0.7),
    "cc by nc": ("cc-by-nc", 0.7),
    "cc by nd": ("cc-by-nd", 0.7),
    "cc0": ("cc0", 0.6),
    "public domain": ("public-domain", 0.5),
    "proprietary and confidential": ("reserved", 0.7),
}
BASE_SURE = 0.6
TAG = "spdx-license-identifier:"
TAG_SURE = 0.95
#: First parts of identifiers of licences without share-alike terms.
PERMISSIVE = ("apache", "bsd", "mit", "isc", "bsl", "cc0", "cc-by-4", "cc-by-3", "unlicense", "zlib", "0bsd", "ncsa", "python", "psf")

WORDS = np.full(256, 32, np.uint8)
WORDS[48:58] = np.arange(48, 58)
WORDS[65:91] = np.arange(97, 123)
WORDS[97:123] = np.arange(97, 123)
WORDS[128:] = np.arange(128, 256)
_WORDS = WORDS.tobytes()
_LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
_RANK = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[()]|[^\s()]+")


def postfix(expression: str) -> list[str] | None:
    """An expression's operands and operators in postfix order; None if it isn't one."""
    out: list[str] = []
    ops: list[str] = []
    operand = False  # whether an operand has just ended
    for t in _TOKEN.findall(expression):
        low = t.lower()
        if low in _RANK:
            if not operand:
                return None
            while ops and ops[-1] != "(" and _RANK[ops[-1]] >= _RANK[low]:
                out.append(ops.pop())
            ops.append(low)
            operand = False
        elif t == "(":
            if operand:
                return None
            ops.append(t)
        elif t == ")":
            while ops and ops[-1] != "(":
                out.append(ops.pop())
            if not ops or not operand:
                return None
            ops.pop()
        else:
            if operand or not re.fullmatch(r"[A-Za-z0-9.+\-:]+", t):
                return None
            out.append(low)
            operand = True
    if not operand or "(" in ops:
        return None
    return out + ops[::-1]


def evaluate(expression: str) -> tuple[list[str], bool] | None:
    """The licences an expression names (exceptions kept with theirs) and whether permissive terms can meet it."""
    rpn = postfix(expression)
    if rpn is None:
        return None
    stack: list[tuple[frozenset[str], bool]] = []
    for t in rpn:
        if t in _RANK:
            (b, pb), (a, pa_) = stack.pop(), stack.pop()
            if t == "with":
                if len(a) != 1 or len(b) != 1:
                    return None
                stack.append((frozenset(f"{x}-with-{y}" for x in a for y in b), pa_))
            else:
                stack.append((a | b, pa_ and pb if t == "and" else pa_ or pb))
        else:
            stack.append((frozenset([t]), t.startswith(PERMISSIVE)))
    names, ok = stack[0]
    return sorted(names), ok


def longest_expression(line: str) -> tuple[list[str], bool] | None:
    """The longest start of a line, in whole tokens, that is an expression."""
    depth, operand, end, kept = 0, False, 0, []
    for t in _TOKEN.findall(line):
        if t in "()":
            if operand == (t == "("):
                break
            depth += 1 if t == "(" else -1
            if depth < 0:
                break
            kept.append(t)
        else:
            t = t.rstrip(".,;*/")
            if (t.lower() in _RANK) != operand or not re.fullmatch(r"[A-Za-z0-9.+\-:]+", t):
                break
            operand = not operand
            kept.append(t)
        if operand and not depth:
            end = len(kept)
    return evaluate(" ".join(kept[:end])) if end else None


def _automaton() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    a, t = ahocorasick.Automaton(), ahocorasick.Automaton()
    for p in {*BASE, *NOTICES}:
        a.add_word(f" {p} ", p)
    t.add_word(TAG, TAG)
    a.make_automaton()
    t.make_automaton()
    return a, t


def scan_text(b: bytes, automata: tuple) -> dict:
    """All figures of one text, given as UTF-8 bytes."""
    phrases, tags = automata
    words = b.translate(_WORDS).split()
    text = " " + b" ".join(words).decode("latin-1") + " " if words else " "
    n_base, first, last, found = 0, None, None, {}
    for end, p in phrases.iter(text):
        start = end - len(p) - 1
        found[p] = found.get(p, 0) + 1
        if p in BASE:
            n_base += 1
            first = start if first is None else min(first, start)
            last = start if last is None else max(last, start)
    at = lambda x: None if x is None else text.count(" ", 0, x + 1) - 1
    base = sorted({BASE[p] for p in found if p in BASE})
    sure = {x: BASE_SURE for x in base}
    for p in found:
        if p in NOTICES:
            label, s = NOTICES[p]
            sure[label] = max(sure.get(label, 0), s)
    expressions, permissive = [], None
    low = b.translate(_LOWER).decode("latin-1")
    for end, _ in tags.iter(low):
        stop = low.find("\n", end)
        line = b[end + 1 : stop if stop >= 0 else len(b)].decode("utf-8", "replace")
        if got := longest_expression(line):
            expressions.append(" ".join(got[0]))
            permissive = got[1] if permissive is None else permissive and got[1]
            for x in got[0]:
                sure[x] = max(sure.get(x, 0), TAG_SURE)
    return {"n_words": len(words), "n_base": n_base, "first_word": at(first), "last_word": at(last), "base_labels": ",".join(base), "labels": ",".join(sorted(sure)), "score": float(1 - np.prod([1 - x for x in sure.values()])), "n_expressions": len(expressions), "permissive": permissive}


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_expressions long, permissive boolean"
_TYPES = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "n_expressions": pa.int64(), "permissive": pa.bool_()}


def _scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    automata = _automaton()
    for arr in batches:
        rows = [scan_text(b or b"", automata) for b in as_bytes(arr)]
        yield struct({k: pa.array([r[k] for r in rows], t) for k, t in _TYPES.items()})


def scan(df: DataFrame, text: str = "text", into: str = "licence") -> DataFrame:
    """Add the struct column ``into``. Null texts count as empty: no words, no labels, score 0.

    Texts of any length are read as a whole. A word that ends one phrase may begin the next;
    all places count. Rows are kept as they are, repeated ones included; other columns pass
    through, one of the name ``into`` is replaced; an empty table gives no rows.
    """
    small_batches(df.sparkSession)
    return df.withColumn(into, arrow_udf(tidy(_scan), SCHEMA)(F.col(text)))


def contract(docs: DataFrame) -> DataFrame:
    return scan(docs.select("doc_id", "text"), into="r").select("doc_id", "r.*")
