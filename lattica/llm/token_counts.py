"""Token counts by section, from one encoding of the whole document.

A document is encoded once. The byte lengths of its tokens give every token's
span, and an interval join by binary search puts the spans against the
sections. A token that crosses a boundary is allocated by an explicit rule:

- ``first``: to the section of its first byte;
- ``majority``: to the section with most of its bytes, the earliest on a tie;
- ``share``: to each section in proportion to its bytes.

With any rule the counts of a document's sections add up to its tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import Chunk, chunks, small_batches, tidy

TOKENIZER = "byte_bpe_50k.tiktoken"
RULES = ("first", "majority", "share")
_loaded: dict[str, tuple] = {}


def load(name: str = TOKENIZER):
    """A byte-level tokenizer and the byte length of each of its tokens."""
    if name not in _loaded:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        lens = np.zeros(max(ranks.values()) + 1, np.int64)
        lens[list(ranks.values())] = [len(k) for k in ranks]
        _loaded[name] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), lens
    return _loaded[name]


def attribute(token_ends: np.ndarray, section_starts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each section by the rule, how many begin in it, and how many of those run beyond it.

    Spans and sections both tile the text; positions are bytes and tokens have at least one.
    """
    n = len(section_starts)
    starts = np.concatenate(([0], token_ends[:-1])) if len(token_ends) else token_ends
    a = np.searchsorted(section_starts, starts, side="right") - 1
    z = np.searchsorted(section_starts, token_ends - 1, side="right") - 1
    begun = np.bincount(a, minlength=n)
    crossing = a != z
    cross = np.bincount(a[crossing], minlength=n)
    if rule == "first":
        return begun.astype(float), begun, cross
    count = np.bincount(a[~crossing], minlength=n).astype(float)
    for t in np.flatnonzero(crossing):
        bounds = np.concatenate(([starts[t]], section_starts[a[t] + 1 : z[t] + 1], [token_ends[t]]))
        held = np.diff(bounds)
        if rule == "share":
            count[a[t] : z[t] + 1] += held / held.sum()
        else:
            count[a[t] + int(held.argmax())] += 1
    return count, begun, cross


def _sections(c: Chunk, encoding, lens: np.ndarray, rule: str) -> Iterator[tuple[int, list[dict]]]:
    for row, lo, hi in zip(c.rows.tolist(), c.starts.tolist(), (c.ends - 1).tolist(), strict=True):
        b = c.buf[lo:hi]
        ids = encoding.encode_ordinary(b.tobytes().decode())
        ends = np.cumsum(lens[np.array(ids, np.int64)]) if ids else np.zeros(0, np.int64)
        cuts = np.concatenate(([0], np.flatnonzero(b[:-1] == 10) + 1)) if len(b) else np.zeros(1, np.int64)
        tokens, begun, cross = attribute(ends, cuts, rule)
        chars = np.concatenate(([0], np.cumsum((b & 0xC0) != 0x80)))
        starts = chars[cuts]
        stops = np.append(starts[1:], chars[-1])
        yield row, [{"section": k, "start": s, "end": e, "n_tokens": t, "n_crossing": x} for k, (s, e, t, x) in enumerate(zip(starts.tolist(), stops.tolist(), tokens.tolist(), cross.tolist(), strict=True))]


SECTION = pa.struct([("section", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("n_tokens", pa.float64()), ("n_crossing", pa.int64())])


def count_by_line(df: DataFrame, text: str = "text", into: str = "sections", rule: str = "first", tokenizer: str = TOKENIZER) -> DataFrame:
    """Add the array column ``into``: for each line (with its line feed) its characters, tokens and crossing tokens.

    A null or empty text has one empty section without tokens; texts of any length are
    encoded as a whole. Rows are kept as they are, repeated ones included; other columns
    pass through, one of the name ``into`` is replaced; an empty table gives no rows.
    """
    if rule not in RULES:
        raise ValueError(f"unknown rule: {rule}")
    small_batches(df.sparkSession)

    @arrow_udf("array<struct<section:int,start:long,end:long,n_tokens:double,n_crossing:long>>")
    @tidy
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoding, lens = load(tokenizer)
        for arr in batches:
            out: list = [[{"section": 0, "start": 0, "end": 0, "n_tokens": 0.0, "n_crossing": 0}]] * len(arr)
            for c in chunks(arr):
                for row, sections in _sections(c, encoding, lens, rule):
                    out[row] = sections
            yield pa.array(out, pa.list_(SECTION))

    return df.withColumn(into, run(F.col(text)))


def query(docs: DataFrame) -> DataFrame:
    s = count_by_line(docs.select("doc_id", "text"), into="s").select("doc_id", F.explode("s").alias("s"))
    return s.select("doc_id", "s.section", F.col("s.start").alias("char_start"), F.col("s.end").alias("char_end"), F.col("s.n_tokens").cast("long").alias("n_tokens"), "s.n_crossing")
