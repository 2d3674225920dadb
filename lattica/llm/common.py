"""Shared pieces of the training-data operators.

Texts reach Python as Arrow arrays and are processed as one byte buffer per
chunk, so that word splitting, hashing and counting are numpy passes and never
loops over words. A chunk holds at most ``CHUNK_BYTES`` bytes or one document.
"""

from __future__ import annotations

import ctypes
import functools
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 19
ROWS_PER_BATCH = 500
BLOOM = "spark.sql.optimizer.runtime.bloomFilter.enabled"

_RNG = np.random.default_rng(20240229)
#: A random 64-bit value for each byte.
BYTE_HASH = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xFF51AFD7ED558CCD)
_MIX2 = np.uint64(0xC4CEB9FE1A85EC53)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of one Arrow batch, since a row holds a whole text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only on a local master without one, as in tests."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not d:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        d = tempfile.mkdtemp(prefix="checkpoint-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and cut its lineage.

    Meanwhile Spark makes no Bloom filters for its joins. It does so only where one side is small, for each key of
    a join: a megabyte from every task, all merged in one task, and in the plans that the driver holds and sends.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(spark))
    held = spark.conf.get(BLOOM)
    spark.conf.set(BLOOM, "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set(BLOOM, held)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop what finished steps left and nothing refers to any more: shuffle files, and the driver's memory; no result depends on it."""
    import gc

    gc.collect()
    _trim()
    spark.sparkContext._jvm.System.gc()


def _trim() -> None:
    """Give freed memory back to the system, for a Python worker outlives its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def tidy(run: Callable) -> Callable:
    """A task's function over batches that leaves no memory behind."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            _trim()

    return wrapped


def crc_mod(doc_id: Column, m: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(m)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes in place."""
    h ^= h >> np.uint64(33)
    h *= _MIX1
    h ^= h >> np.uint64(29)
    h *= _MIX2
    h ^= h >> np.uint64(32)
    return h


def hash_text(text: str, seed: int = 0) -> int:
    """The hash that ``Chunk.word_hashes`` gives the same bytes."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return int(_hash_runs(b, np.array([0]), np.array([len(b)]))[0]) if len(b) else 0


_POW = np.cumprod(np.full(256, _MULT))


def _powers(n: int) -> np.ndarray:
    global _POW
    if n > len(_POW):
        _POW = np.cumprod(np.full(max(n, 2 * len(_POW)), _MULT))
    return _POW


def _hash_runs(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    lens = ends - starts
    if not len(lens):
        return np.zeros(0, np.uint64)
    first = np.cumsum(lens) - lens
    at = np.arange(int(lens.sum()))
    within = at - np.repeat(first, lens)
    idx = within + np.repeat(starts, lens)
    vals = BYTE_HASH[buf[idx]]
    vals *= _powers(int(lens.max()) + 1)[within]
    return mix(np.add.reduceat(vals, first))


class Chunk:
    """Some documents in one byte buffer, each followed by one line feed."""

    def __init__(self, rows: np.ndarray, parts: list[bytes], fold: np.ndarray | None = None):
        raw = b"\n".join(parts) + b"\n"
        self.rows = rows
        self.buf = np.frombuffer(raw, np.uint8)
        if fold is not None:
            self.buf = fold[self.buf]
        lens = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
        self.ends = np.cumsum(lens)
        self.starts = self.ends - lens

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs of bytes for which the 256-entry table is true."""
        m = inside[self.buf]
        m[-1] = False
        d = np.flatnonzero(m[1:] != m[:-1]) + 1
        if len(m) and m[0]:
            d = np.concatenate(([0], d))
        return d[0::2], d[1::2]

    def word_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _hash_runs(self.buf, starts, ends)

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        """Index within the chunk of the document at each byte position."""
        return np.searchsorted(self.ends, positions, side="right")


def fold_ascii() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def as_bytes(arr: pa.Array) -> list[bytes | None]:
    if pa.types.is_string(arr.type):
        return arr.cast(pa.binary()).to_pylist()
    if pa.types.is_large_string(arr.type):
        return arr.cast(pa.large_binary()).to_pylist()
    return arr.to_pylist()


def chunks(arr: pa.Array, fold: np.ndarray | None = None, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The non-null texts of an Arrow array, in order; empty texts are included."""
    rows: list[int] = []
    parts: list[bytes] = []
    held = 0
    for i, b in enumerate(as_bytes(arr)):
        if b is None:
            continue
        if rows and held + len(b) > size:
            yield Chunk(np.array(rows), parts, fold)
            rows, parts, held = [], [], 0
        rows.append(i)
        parts.append(b)
        held += len(b)
    if rows:
        yield Chunk(np.array(rows), parts, fold)


def sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of each slice; empty slices give 0."""
    c = np.concatenate((np.zeros((1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64), np.cumsum(values, axis=0, dtype=np.float64 if values.dtype.kind == "f" else np.int64)))
    return c[ends] - c[starts]


def struct(fields: dict[str, pa.Array]) -> pa.StructArray:
    return pa.StructArray.from_arrays(list(fields.values()), names=list(fields))


def bounded_ids(df: DataFrame, id_col: str, limit: int, salt: str) -> list[int]:
    """At most ``limit`` distinct ids, drawn by a hash of the id and so alike for any partitioning."""
    key = F.xxhash64(F.lit(salt), F.col(id_col))
    rows = df.select(id_col).where(F.col(id_col).isNotNull()).distinct().select(id_col, key.alias("__k")).orderBy("__k", id_col).limit(limit).collect()
    return [r[0] for r in rows]


def ids_frame(spark: SparkSession, ids: list[int], name: str) -> DataFrame:
    return spark.createDataFrame([(int(i),) for i in ids], f"{name} long")
