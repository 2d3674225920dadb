"""Toxicity by non-negative positive-unlabelled (PU) learning.

Confirmed toxic texts are the positives P; a sample of all training texts, of
unknown label, is U. With class prior ``pi`` and loss ``l`` a linear model ``g`` is
trained on the risk estimator

    pi E_P[l(g)] + max(0, E_U[l(-g)] - pi E_P[l(-g)])

whose second term estimates the loss on negatives and is kept from going below
zero: while it would be, only the first term is followed. ``pi`` is the share of toxic rows among
the labelled training rows. The loss is the logistic loss, which doesn't fade
where a text is far on the wrong side. Several models that
differ in the order of their batches are averaged. Features are the distinct
words of the whole text, hashed; training keeps the ``FEATURES`` whose share of P
differs most from their share of U, and by at least ``APART`` standard errors.

Training takes at most ``MAX_POSITIVE`` + ``MAX_UNLABELLED`` texts, drawn by a hash of
doc_id; scoring covers all rows.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import Chunk, bounded_ids, chunks, crc_mod, fold_ascii, ids_frame, mix, small_batches, tidy

BITS = 18
MAX_POSITIVE = 3000
MAX_UNLABELLED = 6000
MIN_TEXTS = 5
FEATURES = 2000
APART = 6.0
MODELS = 3
FOLD = fold_ascii()
LETTER = np.zeros(256, bool)
LETTER[97:123] = LETTER[128:] = True


def word_features(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(document index, bucket) of each distinct word, sorted."""
    s, e = c.runs(LETTER)
    h = c.word_hashes(s, e) >> np.uint64(64 - BITS)
    both = np.unique((c.doc_of(s) << BITS) | h.astype(np.int64))
    return both >> BITS, both & ((1 << BITS) - 1)


@dataclass
class Model:
    weight: np.ndarray
    bias: float

    def score(self, c: Chunk) -> np.ndarray:
        d, f = word_features(c)
        g = np.full(len(c.rows), self.bias) + np.bincount(d, self.weight[f], len(c.rows))
        return 1 / (1 + np.exp(-np.clip(g, -30, 30)))

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, weight=self.weight, bias=self.bias)
        return out.getvalue()

    @staticmethod
    def from_bytes(b: bytes) -> Model:
        z = np.load(io.BytesIO(b))
        return Model(z["weight"], float(z["bias"]))


def one_of_each(texts: list[np.ndarray]) -> list[np.ndarray]:
    """The texts without near copies, which would make their own rare words look telling.

    A text goes if its three smallest buckets, under either of two hashes, are those of an earlier one.
    """
    seen: set = set()
    out = []
    for t in texts:
        keys = []
        for k in (1, 2):
            h = mix(t.astype(np.uint64) * np.uint64(2 * k + 1) + np.uint64(k))
            keys.append((k, *np.sort(h)[:3].tolist()))
        if not seen.intersection(keys):
            out.append(t)
        seen.update(keys)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def risk(g: np.ndarray, is_p: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The estimate of the risk, and what is followed to lower it: its gradient by each text's logit."""
    p, u = is_p / max(1, is_p.sum()), ~is_p / max(1, (~is_p).sum())
    s = _sigmoid(g)
    loss = np.logaddexp(0, g)  # l(-g), with the slope s; l(g) = l(-g) - g has the slope s - 1
    positive, negative = prior * p @ (loss - g), u @ loss - prior * p @ loss
    return positive + max(0.0, negative), prior * p * (s - 1) + (negative >= 0) * (u * s - prior * p * s)


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, epochs: int = 400, batches: int = 1, rate: float = 0.1, decay: float = 5e-5) -> Model:
    """positive, unlabelled: the feature buckets of each text."""
    size = 1 << BITS
    positive, unlabelled = one_of_each(positive), one_of_each(unlabelled)
    if not positive or not unlabelled or prior <= 0:
        return Model(np.zeros(size), -5.0)
    texts = positive + unlabelled
    in_p, in_u = (np.bincount(np.concatenate(x), minlength=size) for x in (positive, unlabelled))
    share = (in_p + in_u) / len(texts)
    apart = np.abs(in_p / len(positive) - in_u / len(unlabelled)) / np.sqrt((share * (1 - share) + 1e-6) * (1 / len(positive) + 1 / len(unlabelled)))
    apart[in_p + in_u < MIN_TEXTS] = 0
    kept = np.argsort(-apart, kind="stable")[:FEATURES]
    kept = np.sort(kept[apart[kept] >= APART])
    to = np.full(size, -1)
    to[kept] = np.arange(len(kept))
    rows = [x[x >= 0] for x in (to[t] for t in texts)]
    n_p = len(positive)
    total_w, total_b = np.zeros(len(kept)), 0.0
    for model in range(MODELS):
        rng = np.random.default_rng(model)
        w = np.zeros(len(kept) + 1)
        m1, m2, step = np.zeros(len(w)), np.zeros(len(w)), 0
        w[-1] = np.log(prior / (1 - prior)) if prior < 1 else 1.0
        for _ in range(epochs):
            ps, us = np.array_split(rng.permutation(n_p), batches), np.array_split(n_p + rng.permutation(len(unlabelled)), batches)
            for p, u in zip(ps, us, strict=True):
                if not len(p) or not len(u):
                    continue
                ids = np.concatenate((p, u))
                lens = np.array([len(rows[i]) for i in ids])
                flat = np.concatenate([rows[i] for i in ids])
                doc = np.repeat(np.arange(len(ids)), lens)
                g = w[-1] + np.bincount(doc, w[flat], len(ids))
                grad = risk(g, np.arange(len(ids)) < len(p), prior)[1]
                gw = np.append(np.bincount(flat, grad[doc], len(w) - 1), grad.sum()) + decay * np.append(w[:-1], 0)
                step += 1
                m1 += 0.1 * (gw - m1)
                m2 += 0.001 * (gw * gw - m2)
                w -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        total_w += w[:-1]
        total_b += w[-1]
    out = np.zeros(size)
    out[kept] = total_w / MODELS
    return Model(out, total_b / MODELS)


def _features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for arr in batches:
        out: list = [[]] * len(arr)
        for c in chunks(arr, FOLD):
            d, f = word_features(c)
            cuts = np.searchsorted(d, np.arange(len(c.rows) + 1))
            for i, r in enumerate(c.rows.tolist()):
                out[r] = f[cuts[i] : cuts[i + 1]]
        yield pa.array(out, pa.list_(pa.int32()))


def fit(docs: DataFrame, labels: DataFrame, train_row: Column, text: str = "text", key: str = "doc_id", toxic: str = "toxic") -> Model:
    """train_row: a Column over ``key`` that says which rows may be learned from.

    Labels without an id or a value are not used; of several labels of an id the highest counts,
    and of several texts of an id the one with the smallest hash. Without positives every text is taken for clean.
    """
    small_batches(docs.sparkSession)
    known = labels.where(F.col(key).isNotNull() & F.col(toxic).isNotNull() & train_row).groupBy(key).agg(F.max(toxic).alias("__y"))
    prior = known.agg(F.avg("__y")).first()[0] or 0.0
    p = bounded_ids(known.where("__y = 1"), key, MAX_POSITIVE, "pu-positive")
    u = bounded_ids(docs.where(train_row), key, MAX_UNLABELLED, "pu-unlabelled")
    spark = docs.sparkSession
    want = ids_frame(spark, sorted({*p, *u}), "__id")
    got = docs.select(F.col(key).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(want), "__id").select("__id", F.xxhash64("__text").alias("__h"), arrow_udf(tidy(_features), "array<int>")("__text").alias("__f"))
    of_id: dict[int, tuple[int, np.ndarray]] = {}
    for r in got.toLocalIterator():
        if r["__id"] not in of_id or r["__h"] < of_id[r["__id"]][0]:
            of_id[r["__id"]] = r["__h"], np.array(r["__f"], np.int64)
    feats = {i: f for i, (_, f) in of_id.items()}
    return train([feats[i] for i in p if i in feats], [feats[i] for i in u if i in feats], float(prior))


def score(df: DataFrame, model: Model, text: str = "text", into: str = "toxicity") -> DataFrame:
    """Add the double column ``into``, 0 to 1. Null and empty texts get the score of a text without words.

    Texts of any length are scored as a whole. Rows are kept as they are, repeated ones included;
    other columns pass through, one of the name ``into`` is replaced; an empty table gives no rows.
    """
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model.to_bytes())

    @arrow_udf("double")
    @tidy
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = Model.from_bytes(shared.value)
        for arr in batches:
            out = np.full(len(arr), 1 / (1 + np.exp(-m.bias)))
            for c in chunks(arr, FOLD):
                out[c.rows] = m.score(c)
            yield pa.array(out)

    return df.withColumn(into, run(F.col(text)))


def contract(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    s = score(docs.select("doc_id", "text"), fit(docs, labels, ~held), into="score")
    return s.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
