"""Near-duplicate embeddings by a pivot-permutation index.

Reference vectors (pivots) are drawn from a bounded sample. A vector is described
by its ``NEAREST`` nearest pivots in order, nearest first. Each pivot pair of a
description has an inverted list for each label, so two vectors meet in a list
exactly if they share ``SHARED`` of their nearest pivots at least. Lists hold ids,
descriptions and a sketch of a byte for each of at most ``AXES`` coordinates,
never vectors:

1. In each list the shared pivots of a pair are counted, and the pair is looked at
   in the list of its two lowest shared pivots alone. It goes on unless its sketches
   are too far apart; a projection lengthens no distance, so this test loses no link.
2. Vectors with such a pair are fetched, once for each list that has one, and
   verified by cosine in double precision.

Equal vectors with equal labels are one class and are not expanded into pairs.
Long lists are split into block pairs; a block pair gives link counts and a
spanning forest of its links, never the links themselves. Vectors of a length
that the sample holds too few of for pivots share one list for each length and label.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import cut, tidy
from .components import Forest, blocked, components, each_group, hot_join

LEAST = 0.98
NEAREST = 6
SHARED = 2
#: Vectors that pivots are drawn from, and the fewest of one length that give pivots.
SAMPLE = 4096
FEWEST = 32
MIN_PIVOTS, MAX_PIVOTS = 64, 512
AXES = 16
STEPS = 127  # of a sketch's byte for a coordinate of 1
LIST_BLOCK = 8192
#: So many ids are broadcast at most; the vectors of more are fetched by a shuffle.
BROADCAST_IDS = 1_000_000


def n_pivots(n: int) -> int:
    """The root of the number of vectors, so that lists, one for each pair of pivots, stay as short as before."""
    return int(min(MAX_PIVOTS, max(MIN_PIVOTS, round(n**0.5))))


def choose_pivots(sample: np.ndarray, n: int, seed: int = 5) -> np.ndarray:
    """Pivots from unit vectors: each the farthest from those before among a few drawn at random."""
    rng = np.random.default_rng(seed)
    if not len(sample):
        return np.zeros((0, sample.shape[1]))
    n = min(n, len(sample))
    picked = [int(rng.integers(len(sample)))]
    near = sample @ sample[picked[0]]
    for _ in range(n - 1):
        some = rng.choice(len(sample), min(16, len(sample)), replace=False)
        best = int(some[np.argmin(near[some])])
        picked.append(best)
        near = np.maximum(near, sample @ sample[best])
    return sample[sorted(set(picked), key=picked.index)]


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)  # so that no square is beyond the range of numbers
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def pivots_by_length(sample: list[list[float]], n: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors its pivots, and axes that span the first of them."""
    out = {}
    for d in sorted({len(v) for v in sample}):
        own = _unit(np.array([v for v in sample if len(v) == d], np.float64))
        if len(own) >= FEWEST:
            p = choose_pivots(own, n_pivots(n))
            out[d] = p, np.linalg.qr(p[:AXES].T)[0].T
    return out


def _describe(by_length):
    """desc: the nearest pivots in order as int16 (-1: none), then a sketch of AXES bytes."""

    def run(v: pa.Array) -> pa.Array:
        n = len(v)
        size = np.diff(v.offsets.to_numpy())
        flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        start = np.cumsum(size) - size
        near, sketch = np.full((n, NEAREST), -1, np.int16), np.zeros((n, AXES), np.int8)
        for d in np.unique(size).tolist():
            if d not in by_length.value:
                continue
            pivots, axes = by_length.value[d]
            rows = np.flatnonzero(size == d)
            x = _unit(flat[start[rows][:, None] + np.arange(d)])
            order = np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :NEAREST]
            near[rows, : order.shape[1]] = order
            sketch[rows, : len(axes)] = np.rint(np.clip(x @ axes.T, -1, 1) * STEPS)
        both = np.hstack((near.view(np.int8).reshape(n, -1), sketch))
        return pa.array([r.tobytes() for r in both], pa.binary())

    return arrow_udf(run, "binary")


def _lists(desc: pa.Array) -> pa.Array:
    """A number for each pair of a description's pivots, the lower one first; -1 alone without pivots."""
    near = _read(desc)[0]
    out = []
    for r in near.tolist():
        p = sorted(x for x in r if x >= 0)
        out.append([a << 10 | b for k, a in enumerate(p) for b in p[k + 1 :]] or [-1])
    return pa.array(out, pa.list_(pa.int32()))


def _read(desc: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(desc.to_pylist()), np.int8).reshape(len(desc), 2 * NEAREST + AXES)
    return np.ascontiguousarray(raw[:, : 2 * NEAREST]).view(np.int16), raw[:, 2 * NEAREST :].astype(np.float32)


class _Block:
    """A block pair's rows; pairs in it are looked at in one list alone."""

    def __init__(self, t: pa.Table):
        self.ids = t["id"].to_numpy()
        self.near, self.sketch = _read(t["desc"])
        self.code = int(t["list"][0].as_py())
        own, lo, hi = t["own"].to_numpy(), t["lo"][0].as_py(), t["hi"][0].as_py()
        self.same = lo == hi
        self.a = np.arange(len(own)) if self.same else np.flatnonzero(own == lo)
        self.b = self.a if self.same else np.flatnonzero(own == hi)

    def tiles(self, step: int = 256):
        for s in range(0, len(self.a), step):
            yield self.a[s : s + step]

    def pairs(self, rows: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the pairs that are ok, those that this is the list of: SHARED pivots in common, none of them lower than the list's."""
        if self.same:
            ok &= self.b[None, :] > rows[:, None]
        i, j = np.nonzero(ok)
        i, j = rows[i], self.b[j]
        if self.code < 0 or not len(i):
            return i, j
        first, second = self.code >> 10, self.code & 1023
        count, early = np.zeros(len(i), np.int8), np.zeros(len(i), bool)
        for k in range(NEAREST):
            p = self.near[i, k]
            hit = (self.near[j] == p[:, None]).any(1) & (p >= 0)
            count += hit
            early |= hit & (p < second) & (p != first)
        keep = (count >= SHARED) & ~early
        return i[keep], j[keep]


def _reach(least: float) -> float:
    """How far apart sketches of linked vectors may be, squared: their distance, and half a step for each of two roundings on each axis."""
    return (STEPS * np.sqrt(max(0.0, 2 - 2 * least)) + np.sqrt(AXES) + 0.01) ** 2


def _survivors(least: float):
    def work(t: pa.Table) -> pa.RecordBatch | None:
        x = _Block(t)
        some = np.zeros(len(x.ids), bool)
        square = (x.sketch**2).sum(1)
        for rows in x.tiles():
            near = square[rows][:, None] + square[x.b] - 2 * (x.sketch[rows] @ x.sketch[x.b].T) <= _reach(least)
            i, j = x.pairs(rows, near)
            some[i] = some[j] = True
        if not some.any():
            return None
        return pa.RecordBatch.from_arrays([t[c].combine_chunks().filter(pa.array(some)) if c != "id" else pa.array(x.ids[some]) for c in ("label", "dims", "list", "id")], names=["label", "dims", "list", "id"])

    return work


def _verify(least: float):
    def work(t: pa.Table) -> pa.RecordBatch | None:
        x = _Block(t)
        n, weight = len(x.ids), t["n_same"].to_numpy()
        v = _unit(np.array(t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, -1))
        links, forest = np.zeros(n, np.int64), Forest(n)
        edges: list[tuple[int, int]] = []
        for rows in x.tiles():
            i, j = x.pairs(rows, v[rows] @ v[x.b].T >= least)
            links += (np.bincount(i, weight[j], n) + np.bincount(j, weight[i], n)).astype(np.int64)
            edges += [(p, q) for p, q in zip(i.tolist(), j.tolist(), strict=True) if forest.join(p, q)]
        out = [(int(x.ids[k]), None, int(links[k])) for k in np.flatnonzero(links)] + [(int(x.ids[p]), int(x.ids[q]), 0) for p, q in edges]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], names=["a", "b", "links"]) if out else None

    return work


def _fine(v: str) -> Column:
    return F.expr(f"label is not null and size({v}) > 0 and not exists({v}, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists({v}, x -> x <> 0)")


def link(df: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label", least: float = LEAST) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each distinct vector id.

    Null, empty, zero or non-finite vectors, vectors with null or non-finite parts,
    and rows without a label link with nothing; vectors of unequal lengths never link.
    Repeated rows of an id count once: of unequal ones that may link, the one with the
    smallest label and hash. Rows without an id are left out. An empty table gives no rows.
    """
    spark = df.sparkSession
    v = F.col(vector)
    v = v if df.schema[vector].dataType.simpleString() in ("array<float>", "array<double>") else v.cast("array<double>")
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), v.alias("v")).where("id is not null")
    hashes = [F.xxhash64("v").alias("h1"), F.hash("v").alias("h2")]
    fine = rows.where(_fine("v"))
    sample = [r["v"] for r in fine.orderBy(F.xxhash64(F.lit("pivots"), "id"), "id").limit(SAMPLE).select("v").collect()]
    shared = spark.sparkContext.broadcast(pivots_by_length(sample, fine.count()))
    which = F.struct("label", "h1", "h2")
    described = fine.select("id", "label", *hashes, F.size("v").alias("dims"), _describe(shared)("v").alias("desc"))
    described = cut(described.groupBy("id").agg(F.min_by(F.struct("label", "h1", "h2", "dims", "desc"), which).alias("r")).select("id", "r.*"))
    # equal vectors: one class for each label
    classes = cut(described.groupBy("label", "h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n_same")))
    reps = cut(described.join(classes.withColumnRenamed("rep", "id"), ["id", "label", "h1", "h2"]))
    lists = arrow_udf(_lists, "array<int>")
    posted = reps.select("label", "dims", "id", "desc", F.explode(lists("desc")).alias("list"))
    where = ["label", "dims", "list"]
    columns = [*where, "lo", "hi", "own", "id", "desc"]
    label_type = described.schema["label"].dataType.simpleString()
    met = each_group(blocked(posted, where, "id", LIST_BLOCK).select(*columns), [*where, "lo", "hi"], _survivors(least), f"label {label_type}, dims int, list int, id long")
    met = cut(met.distinct())
    wanted = cut(reps.join(met.select("id").distinct(), "id", "left_semi"))
    few = F.broadcast if wanted.count() <= BROADCAST_IDS else lambda d: d
    vectors = rows.select("id", "label", *hashes, "v").join(few(wanted), ["id", "label", "h1", "h2"]).dropDuplicates(["id"]).select("id", "v", "n_same", "desc")
    found = each_group(blocked(met, where, "id", LIST_BLOCK).join(vectors, "id").select(*columns, "n_same", "v"), [*where, "lo", "hi"], _verify(least), "a long, b long, links long")
    found = cut(found)
    per_class = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    comp = components(found.where("b is not null")).withColumnRenamed("id", "rep")
    of_class = classes.join(per_class, "rep", "left").join(comp, "rep", "left")
    full = hot_join(described.select("id", "label", "h1", "h2"), of_class, ["label", "h1", "h2"], "n_same", described.count())
    out = rows.select("id").distinct().join(full, "id", "left")
    c = F.coalesce("component", "rep", "id")
    return out.select(F.col("id").alias("vec_id"), (F.coalesce("links", F.lit(0)) + F.coalesce("n_same", F.lit(1)) - 1).cast("long").alias("n_links"), c.alias("component_id"), (F.col("id") == c).alias("kept"))


def contract(vectors: DataFrame) -> DataFrame:
    return link(vectors)
