"""Language identification by prediction by partial matching (PPM).

Each language has a byte context tree of orders 0 to ``ORDER`` with the symbol
counts of its training texts. A symbol's code length in a context is that of
PPM method C: ``log2((n + d) / c)`` if the context has seen it ``c`` times among
``n`` symbols of ``d`` kinds, else the escape ``log2((n + d) / d)`` plus the code
length in the next shorter context; below order 0 all symbols are equally
likely. There are no exclusions, so every code length depends on its context
alone. After training the statistics are frozen, so the code lengths of all
(context, symbol) pairs are computed once and scoring a text is a table lookup
per byte. Contexts that were seen fewer than ``MIN_CONTEXT`` times in all are
pruned, which makes the order variable.

Training takes at most ``TRAIN_DOCS`` documents a language, a bounded sample drawn by
a hash of doc_id, each as a whole: their runs of ``ORDER`` + 1 bytes are counted where
the texts are, and the counts of the ``MAX_GRAMS`` most frequent ones make the tables.
"""

from __future__ import annotations

import io
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import chunks, crc_mod, small_batches, struct, tidy

ORDER = 3
MIN_CONTEXT = 6
MAX_CONTEXTS = 24_000
#: The most frequent bytes are symbols of their own; rarer ones share one.
MAX_SYMBOLS = 127
TRAIN_DOCS = 400
#: Runs of bytes, over all languages, that reach the driver.
MAX_GRAMS = 2_000_000
UNDETERMINED = "und"
RANGE = 1 << 40  # of hashes
SCHEMA = "lang string, score double, bits_per_byte double"


def _normal(arr: pa.Array) -> pa.Array:
    return pc.utf8_lower(arr)


@dataclass
class Model:
    langs: list[str]
    symbol: np.ndarray  # byte -> symbol
    contexts: np.ndarray  # code of the last ORDER symbols -> node
    bits: np.ndarray  # [node * size + symbol, language]
    size: int

    @staticmethod
    def train(texts: dict[str, list[bytes]]) -> Model:
        """texts: by language. Languages without a text are left out."""
        return Model.of_counts({k: count_grams(v) for k, v in texts.items()})

    @staticmethod
    def of_counts(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
        """counts: by language its runs of ORDER + 1 bytes, as numbers, and how often each occurs."""
        langs = sorted(k for k, (g, _) in counts.items() if len(g))
        seen = np.zeros(256, np.int64)
        for k in langs:
            seen += np.bincount(counts[k][0] & 255, counts[k][1], 256).astype(np.int64)
        known = np.sort(np.argsort(-seen, kind="stable")[: min(MAX_SYMBOLS, int((seen > 0).sum()))])
        symbol = np.zeros(256, np.int64)  # 0 stands for every other byte
        if not langs:
            return Model([], symbol, np.zeros(1, np.int32), np.zeros((1, 0), np.float32), 1)
        symbol[known] = np.arange(1, len(known) + 1)
        a = len(known) + 1
        grams = [sum(symbol[counts[k][0] >> 8 * j & 255] * a**j for j in range(ORDER + 1)) for k in langs]
        return Model(langs, symbol, *_tables(grams, [counts[k][1] for k in langs], a))

    def score(self, arr: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For some rows at a time: their indices, their bytes, and bits in each language."""
        a = self.size
        for c in chunks(_normal(arr)):
            s = self.symbol[c.buf]
            nl = self.symbol[10]
            # each text is preceded by line feeds, as in training
            prev = np.concatenate((np.full(ORDER, nl), s))
            firsts = np.concatenate([c.starts + k for k in range(ORDER)])
            code = prev[ORDER - 1 : -1].copy()
            for k in range(2, ORDER + 1):
                code += prev[ORDER - k : -k] * a ** (k - 1)
            # a text's first symbols must not see the text before it
            ok = firsts[firsts < len(s)]
            doc_start = c.starts[c.doc_of(ok)]
            fix = np.zeros(len(ok), np.int64)
            for k in range(1, ORDER + 1):
                at = ok - k
                fix += np.where(at >= doc_start, s[np.maximum(at, 0)], nl) * a ** (k - 1)
            code[ok] = fix
            where = self.contexts[code] * a + s
            bits = np.zeros((len(c.rows), len(self.langs)))
            # whole documents at a time, a bounded number of bytes in each gather
            step = 1 << 18
            for lo in range(0, len(where), step):
                part = self.bits[where[lo : lo + step]]
                cum = np.zeros((len(part) + 1, part.shape[1]))
                np.cumsum(part, axis=0, out=cum[1:])
                first, last = np.searchsorted(c.ends, lo, side="right"), np.searchsorted(c.starts, lo + len(part))
                a0 = np.clip(c.starts[first:last] - lo, 0, len(part))
                b0 = np.clip(c.ends[first:last] - 1 - lo, 0, len(part))
                bits[first:last] += cum[np.maximum(a0, b0)] - cum[a0]
            yield c.rows, c.ends - 1 - c.starts, bits

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, symbol=self.symbol, contexts=self.contexts, bits=self.bits, size=self.size, langs=np.array(self.langs))
        return out.getvalue()

    @staticmethod
    def from_bytes(b: bytes) -> Model:
        z = np.load(io.BytesIO(b))
        return Model([str(x) for x in z["langs"]], z["symbol"], z["contexts"], z["bits"], int(z["size"]))


def count_grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ORDER + 1 bytes of whole texts, each preceded by line feeds and ended by one; and how often each occurs."""
    found = []
    for t in texts:
        if t:
            b = np.frombuffer(b"\n" * ORDER + t + b"\n", np.uint8).astype(np.int64)
            found.append(sum(b[ORDER - j : len(b) - j] << 8 * j for j in range(ORDER + 1)))
    return np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)


def _counted(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of several counts."""
    g, back = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
    return g, np.bincount(back, np.concatenate([n for _, n in found]), len(g)).astype(np.int64)


def _tables(grams: list[np.ndarray], times: list[np.ndarray], a: int) -> tuple[np.ndarray, np.ndarray, int]:
    """grams: by language codes of (context of ORDER symbols, symbol)."""
    texts = grams
    rows: list[np.ndarray] = []
    parent_cost = np.full((1, a, len(texts)), np.log2(a), np.float32)
    lookup = np.zeros(1, np.int64)
    for order in range(ORDER + 1):
        per = [_counted([(g % a ** (order + 1), n)]) for g, n in zip(grams, times, strict=True)]
        total = np.bincount(np.concatenate([u // a for u, _ in per]), np.concatenate([n for _, n in per]), a**order)
        keep = np.flatnonzero(total >= (MIN_CONTEXT if order else 0))
        if order and len(keep) > MAX_CONTEXTS:
            keep = np.sort(keep[np.argsort(-total[keep], kind="stable")[:MAX_CONTEXTS]])
        if not order:
            keep = np.zeros(1, np.int64)
        count = np.zeros((len(keep), a, len(texts)), np.float32)
        for j, (u, n) in enumerate(per):
            at = np.searchsorted(keep, u // a)
            ok = (at < len(keep)) & (keep[np.minimum(at, len(keep) - 1)] == u // a) if len(keep) else np.zeros(len(u), bool)
            count[at[ok], u[ok] % a, j] = n[ok]
        n, d = count.sum(1, keepdims=True), (count > 0).sum(1, keepdims=True).astype(np.float32)
        up = np.concatenate(rows)[lookup[keep % a ** (order - 1)]] if order else parent_cost
        with np.errstate(divide="ignore", invalid="ignore"):
            cost = np.where(count > 0, np.log2((n + d) / count), np.log2((n + d) / d) + up)
        cost = np.where(n > 0, cost, up).astype(np.float32)
        here = sum(len(r) for r in rows)
        rows.append(cost)
        wider = np.tile(lookup, a) if order else lookup  # a context that is not kept stands at its longest kept suffix
        if order:
            wider[keep] = here + np.arange(len(keep))
        lookup = wider
    return lookup.astype(np.int32), np.concatenate(rows).reshape(-1, len(texts)), a


def fit(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", train=None) -> Model:
    """Train on the rows for which the Column ``train`` holds (all if None) with an id, a text and a lang."""
    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull())
    if train is not None:
        rows = rows.where(train)
    spark = df.sparkSession
    small_batches(spark)
    rows = rows.select(F.col(key).alias("__id"), F.col(lang).alias("__lang"), F.col(text).alias("__text"), F.abs(F.xxhash64(F.lit("langid"), F.col(key)) % RANGE).alias("__o"))
    # a share of each language's rows that holds enough of them, then the first ones by hash: no language is ordered in one task
    share = rows.groupBy("__lang").agg(F.least(F.lit(RANGE), F.ceil(F.lit(3.0 * TRAIN_DOCS * RANGE) / F.count(F.lit(1)))).alias("__most"))
    some = rows.drop("__text").join(F.broadcast(share), "__lang").where(F.col("__o") <= F.col("__most")).select("__lang", "__o", "__id").distinct().collect()
    want = []
    held: Counter = Counter()
    for r in sorted(some):
        held[r["__lang"]] += 1
        if held[r["__lang"]] <= TRAIN_DOCS:
            want.append((r["__id"], r["__lang"]))
    ids = spark.createDataFrame(want, rows.select("__id", "__lang").schema)
    got = rows.join(F.broadcast(ids), ["__id", "__lang"]).select("__lang", "__text")
    grams = got.mapInArrow(tidy(_count_rows), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang", "gram").limit(MAX_GRAMS).toArrow()
    by_lang = grams["lang"].to_numpy()
    gram, n = grams["gram"].to_numpy(), grams["n"].to_numpy()
    return Model.of_counts({k: (gram[by_lang == k], n[by_lang == k]) for k in set(by_lang)})


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of some rows of (lang, text)."""
    for batch in batches:
        found: dict[str, list] = {}
        for k, t in zip(batch.column(0).to_pylist(), _normal(batch.column(1)).to_pylist(), strict=True):
            found.setdefault(k, []).append(count_grams([t.encode("utf-8", "replace")]))
        for k, v in found.items():
            g, n = _counted(v)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(g), pa.string()), pa.array(g), pa.array(n)], names=["lang", "gram", "n"])


def predict(df: DataFrame, model: Model, text: str = "text", into: str = "language") -> DataFrame:
    """Add the struct column ``into``: lang, score (posterior of lang under equal priors), bits_per_byte.

    lang is ``und`` with score 0 if text is null or has no letter, or if nothing
    was learned. Ties go to the first language in code-point order. Texts of any length
    are scored as a whole. Rows are kept as they are, repeated ones included; other columns
    pass through, one of the name ``into`` is replaced; an empty table gives no rows.
    """
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model.to_bytes())

    @arrow_udf(SCHEMA)
    @tidy
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = Model.from_bytes(shared.value)
        for arr in batches:
            n = len(arr)
            lang = [UNDETERMINED] * n
            score, rate = np.zeros(n), np.zeros(n)
            texts = arr.to_pylist()
            if m.langs:
                for rows, size, bits in m.score(arr):
                    best = bits.argmin(1)
                    p = 1 / np.exp2(np.clip(bits.min(1, keepdims=True) - bits, -1000, 0)).sum(1)
                    for i, b, q, r in zip(rows.tolist(), best.tolist(), p.tolist(), (bits.min(1) / np.maximum(size, 1)).tolist(), strict=True):
                        if any(map(str.isalpha, texts[i])):
                            lang[i], score[i], rate[i] = m.langs[b], q, r
            yield struct({"lang": pa.array(lang, pa.string()), "score": pa.array(score), "bits_per_byte": pa.array(rate)})

    return df.withColumn(into, run(F.col(text)))


def contract(docs: DataFrame) -> DataFrame:
    held = crc_mod(F.col("doc_id"), 4) == 2
    model = fit(docs, train=~held)
    p = predict(docs.select("doc_id", "text"), model, into="p")
    return p.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.bits_per_byte").alias("bits_per_byte"))
