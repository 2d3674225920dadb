"""Document quality by a linear-chain conditional random field over lines.

Every line is good (1) or bad (0). Its features are counts by kind of character,
word and repetition figures of the line and of its two neighbours. Forward and
backward messages are products of 2x2 matrices; they are computed for all lines
of a chunk at once by a parallel scan, in which a document's first line has a
matrix of equal rows and so forgets what came before. A document's quality is
the mean marginal of its lines, weighted by length, put through a logistic
curve fitted on training documents so that 0.7 separates the labels best.

Lines have no labels of their own. Training starts from the document's label;
a second round takes the lines of bad documents as the first model labels them,
the worst one staying bad. It uses at most ``MAX_TRAIN`` documents, drawn by a
hash of doc_id. A document of more than ``RUNS`` * ``RUN_LINES`` lines trains with
``RUNS`` runs of neighbouring lines drawn from all of it by a hash; features come from the
whole text, where the text is, and only they reach the driver. Scoring covers all rows and lines.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import Chunk, bounded_ids, chunks, crc_mod, ids_frame, mix, small_batches, tidy

MAX_TRAIN = 5000
RUNS, RUN_LINES = 4, 50
THRESHOLD = 0.7

#: Kinds of bytes: 0 lower-case letter, 1 upper-case letter, 2 digit, 3 space, 4 bar,
#: 5 sentence punctuation, 6 other symbol, 7 continuation of a character.
KIND = np.full(256, 6, np.int64)
KIND[97:123] = 0
KIND[65:91] = 1
KIND[48:58] = 2
KIND[[9, 10, 13, 32]] = 3
KIND[124] = 4
KIND[[ord(x) for x in ".,;:?'\"-()"]] = 5
KIND[128:192] = 7
KIND[192:] = 0
WIDTH = 15
WORD = np.ones(256, bool)
WORD[[9, 10, 13, 32]] = False


def line_features(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line with those of its neighbours, its length, and each document's first line."""
    ends = np.flatnonzero(c.buf == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    lens = ends - starts
    line = np.repeat(np.arange(len(starts)), lens + 1)
    kinds = np.bincount(line * 8 + KIND[c.buf], minlength=8 * len(starts)).reshape(-1, 8).astype(float)
    kinds[:, 3] -= 1  # its line feed
    chars = lens - kinds[:, 7]
    n = np.maximum(chars, 1)
    words = kinds[:, 3] + 1
    first = np.searchsorted(starts, c.starts)
    doc = np.zeros(len(starts), np.int64)
    doc[first[1:]] = 1
    doc = np.cumsum(doc)
    again = np.zeros(len(starts))
    full = np.flatnonzero(lens > 0)
    if len(full):
        h = c.word_hashes(starts[full], ends[full])
        o = np.lexsort((full, h, doc[full]))
        same = (h[o][1:] == h[o][:-1]) & (doc[full][o][1:] == doc[full][o][:-1])
        again[full[o[1:][same]]] = 1
    own = np.empty((len(starts), WIDTH))
    own[:, 0] = 1
    own[:, 1] = np.log1p(chars) / 4
    own[:, 2:8] = kinds[:, 1:7] / n[:, None]
    own[:, 8] = np.minimum(kinds[:, 4] / words * 2, 1)
    own[:, 9] = np.minimum(kinds[:, 6] / words, 1)
    own[:, 10] = (kinds[:, 1] > 0.5 * (kinds[:, 0] + kinds[:, 1])) & (kinds[:, 1] > 3)
    own[:, 11] = chars / words / 10
    own[:, 12] = again
    ws, we = c.runs(WORD)
    h = c.word_hashes(ws, we)
    at = line[ws]
    n_words = np.maximum(np.bincount(at, minlength=len(starts)), 1)
    same = (h[1:] == h[:-1]) & (at[1:] == at[:-1])
    own[:, 13] = np.bincount(at[1:][same], minlength=len(starts)) / n_words
    o = np.lexsort((h, at))
    same = (h[o][1:] == h[o][:-1]) & (at[o][1:] == at[o][:-1])
    own[:, 14] = np.bincount(at[o][1:][same], minlength=len(starts)) / n_words
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first] = 0
    last = np.concatenate((first[1:], [len(starts)])) - 1
    after[last] = 0
    return np.hstack((own, before, after)), np.maximum(chars, 0) + 1, first


def _scan(m: np.ndarray, reverse: bool = False) -> np.ndarray:
    """Prefix (or, reversed, suffix) products of 2x2 matrices, scaled."""
    m = m / m.max(axis=(1, 2), keepdims=True)
    d = 1
    while d < len(m):
        left, right = (m[:-d], m[d:])
        p = np.empty_like(left)
        for i in (0, 1):
            for j in (0, 1):
                p[:, i, j] = left[:, i, 0] * right[:, 0, j] + left[:, i, 1] * right[:, 1, j]
        p /= p.max(axis=(1, 2), keepdims=True)
        m = np.concatenate((p, m[-d:])) if reverse else np.concatenate((m[:d], p))
        d *= 2
    return m


@dataclass
class Model:
    weight: np.ndarray
    turn: np.ndarray  # score of each pair of neighbouring labels
    slope: float = 1.0
    offset: float = 0.0

    def messages(self, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward, backward (each normalised) and the matrices."""
        u = np.clip(x @ self.weight, -20, 20)
        m = np.empty((len(x), 2, 2))
        t = np.exp(self.turn)
        m[:, :, 0] = t[:, 0]
        m[:, :, 1] = t[:, 1] * np.exp(u)[:, None]
        m[first, :, 0] = 1
        m[first, :, 1] = np.exp(u[first])[:, None]
        a = _scan(m)[:, 0, :]
        b = np.ones_like(a)
        if len(x) > 1:
            b[:-1] = _scan(m[1:], reverse=True).sum(2)
        return a / a.sum(1, keepdims=True), b / b.sum(1, keepdims=True), m

    def marginals(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        a, b, _ = self.messages(x, first)
        p = a * b
        return p[:, 1] / p.sum(1)

    def mean(self, x: np.ndarray, lens: np.ndarray, first: np.ndarray) -> np.ndarray:
        p = self.marginals(x, first)
        return np.add.reduceat(p * lens, first) / np.add.reduceat(lens, first)

    def score(self, c: Chunk) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * _logit(self.mean(*line_features(c))) + self.offset)))

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, weight=self.weight, turn=self.turn, rest=np.array([self.slope, self.offset]))
        return out.getvalue()

    @staticmethod
    def from_bytes(b: bytes) -> Model:
        z = np.load(io.BytesIO(b))
        return Model(z["weight"], z["turn"], *map(float, z["rest"]))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def gradient(m: Model, x: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected minus observed counts of features and of neighbouring labels, by weight: the slope of minus the log-likelihood."""
    inner = np.ones(len(x), bool)
    inner[first] = False
    inner = np.flatnonzero(inner)
    a, b, mats = m.messages(x, first)
    p = a * b
    p = p[:, 1] / p.sum(1)
    xi = a[inner - 1][:, :, None] * mats[inner] * b[inner][:, None, :]
    xi /= xi.sum(axis=(1, 2), keepdims=True)
    pair = np.bincount(2 * y[inner - 1] + y[inner], weight[inner], 4)
    return np.concatenate((x.T @ (weight * (p - y)), (xi * weight[inner, None, None]).sum(0).ravel() - pair))


def _fit_lines(x: np.ndarray, first: np.ndarray, y: np.ndarray, start: Model, weight: np.ndarray, steps: int = 150, rate: float = 0.1, decay: float = 1e-3) -> Model:
    """Maximum conditional likelihood by Adam."""
    w = np.concatenate((start.weight, start.turn.ravel()))
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    total = weight.sum()
    for k in range(1, steps + 1):
        g = gradient(Model(w[:-4], w[-4:].reshape(2, 2)), x, first, y, weight) / total + decay * w
        m1 += 0.1 * (g - m1)
        m2 += 0.01 * (g * g - m2)
        w = w - rate * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-8)
    return Model(w[:-4], w[-4:].reshape(2, 2))


@dataclass
class Lines:
    """Features of a document's training lines, their lengths, and the first line of each run."""

    x: np.ndarray
    lens: np.ndarray
    first: np.ndarray


def training_lines(c: Chunk) -> Iterator[Lines]:
    """For each document of a chunk."""
    x, lens, first = line_features(c)
    for k, (a, z) in enumerate(zip(first.tolist(), [*first[1:].tolist(), len(x)], strict=True)):
        if z - a <= RUNS * RUN_LINES:
            yield Lines(x[a:z], lens[a:z], np.zeros(1, np.int64))
            continue
        starts = np.arange(a, z, RUN_LINES)
        seed = np.uint64(zlib.crc32(c.buf[c.starts[k] : c.ends[k]].tobytes()))
        drawn = np.sort(starts[np.argsort(mix(np.arange(len(starts), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + seed), kind="stable")[:RUNS]])
        size = np.minimum(drawn + RUN_LINES, z) - drawn
        at = np.concatenate([np.arange(p, p + n) for p, n in zip(drawn.tolist(), size.tolist(), strict=True)])
        yield Lines(x[at], lens[at], np.cumsum(size) - size)


def train(docs: list[Lines], good: np.ndarray) -> Model:
    empty = Model(np.zeros(3 * WIDTH), np.zeros((2, 2)), 0.0, float(_logit(np.array(good.mean() if len(good) else 0.5))))
    if not docs or good.min() == good.max():
        return empty
    n_lines = np.array([len(d.x) for d in docs])
    before = np.cumsum(n_lines) - n_lines
    x, lens = np.concatenate([d.x for d in docs]).astype(np.float64), np.concatenate([d.lens for d in docs])
    first = np.concatenate([d.first + b for d, b in zip(docs, before.tolist(), strict=True)])
    doc = np.repeat(np.arange(len(docs)), n_lines)
    by_doc = good[doc]
    share = lens / np.bincount(doc, lens)[doc]  # each document counts once
    m = _fit_lines(x, first, by_doc, empty, share)
    p = m.marginals(x, first)
    worst = np.minimum.reduceat(p, before)
    cutoff = np.where(worst < 0.5, 0.5, worst + 1e-9)
    m = _fit_lines(x, first, np.where((by_doc == 0) & (p < cutoff[doc]), 0, 1), m, share)
    # the logistic curve: its middle is the cut with the fewest errors, put where the score is THRESHOLD
    z = _logit(np.bincount(doc, m.marginals(x, first) * share))
    o = np.argsort(z)
    zs, ys = z[o], good[o]
    errors = np.concatenate(([0], np.cumsum(ys == 1))) + np.concatenate((np.cumsum((ys == 0)[::-1])[::-1], [0]))
    best = np.flatnonzero(errors == errors.min())
    k = best[len(best) // 2]
    at = (zs[max(k - 1, 0)] + zs[min(k, len(zs) - 1)]) / 2
    m.slope = 1.0
    m.offset = float(_logit(np.array(THRESHOLD)) - m.slope * at)
    return m


def fit(docs: DataFrame, labels: DataFrame, train_row: Column, text: str = "text", key: str = "doc_id", quality: str = "quality") -> Model:
    known = labels.where(F.col(key).isNotNull() & F.col(quality).isNotNull() & train_row).groupBy(key).agg(F.min(quality).alias("__y"))
    bad = bounded_ids(known.where("__y = 0"), key, MAX_TRAIN // 2, "crf-bad")
    fine = bounded_ids(known.where("__y = 1"), key, MAX_TRAIN // 2, "crf-good")
    y = dict.fromkeys(bad, 0) | dict.fromkeys(fine, 1)
    small_batches(docs.sparkSession)
    want = ids_frame(docs.sparkSession, sorted(y), "__id")
    got = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(want), "__id")
    lines = arrow_udf(_training, "struct<x:array<float>,lens:array<long>,first:array<long>>")
    rows: dict[tuple, Lines] = {}
    for r in got.select("__id", F.xxhash64("__text").alias("__h"), lines("__text").alias("__r")).toLocalIterator():
        x = np.array(r["__r"]["x"], np.float32).reshape(-1, 3 * WIDTH)
        rows[r["__id"], r["__h"]] = Lines(x, np.array(r["__r"]["lens"], np.int64), np.array(r["__r"]["first"], np.int64))
    order = sorted(rows)
    return train([rows[k] for k in order], np.array([y[i] for i, _ in order], np.int64))


@tidy
def _training(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for arr in batches:
        out: list = [None] * len(arr)
        for c in chunks(arr):
            for row, d in zip(c.rows.tolist(), training_lines(c), strict=True):
                out[row] = {"x": d.x.astype(np.float32).ravel(), "lens": d.lens, "first": d.first}
        yield pa.array(out, pa.struct([("x", pa.list_(pa.float32())), ("lens", pa.list_(pa.int64())), ("first", pa.list_(pa.int64()))]))


def score(df: DataFrame, model: Model, text: str = "text", into: str = "quality_score") -> DataFrame:
    """Add the double column ``into``, 0 to 1. A null text counts as one empty line, as an empty text does.

    Texts of any length are scored as a whole. Rows are kept as they are, repeated ones included;
    other columns pass through, one of the name ``into`` is replaced; an empty table gives no rows.
    """
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model.to_bytes())

    @arrow_udf("double")
    @tidy
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = Model.from_bytes(shared.value)
        empty = float(m.score(Chunk(np.zeros(1, int), [b""]))[0])
        for arr in batches:
            out = np.full(len(arr), empty)
            for c in chunks(arr):
                out[c.rows] = m.score(c)
            yield pa.array(out)

    return df.withColumn(into, run(F.col(text)))


def contract(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    s = score(docs.select("doc_id", "text"), fit(docs, labels, ~held), into="score")
    return s.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
