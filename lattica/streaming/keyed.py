"""Structured Streaming into a keyed table, and event-time windows.

Batches are folded into a snapshot of the newest row of each key, kept as Parquet in
a shared folder by buckets of the key's hash. A batch writes anew the buckets that it
touches, as a version of its own number, and last of all the list of these buckets,
without which the version does not count. The state before a batch stays until the
next batch is applied, so a batch that is run again after a failure starts from the
same state and writes the same version: each is applied once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import updates

OP = "__op"


class KeyedState:
    """A folder of versions ``v<batch>/__bucket=<bucket>``, each with the list ``t<batch>`` of its buckets."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, arrival: str, buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.arrival, self.buckets = spark, path.rstrip("/"), schema, key, arrival, buckets

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _touched(self) -> dict[int, list[int]]:
        """The buckets of each version, by its number."""
        root, fs = self._fs(self.path)
        names = [x.getPath().getName() for x in fs.listStatus(root)] if fs.exists(root) else []
        done = sorted(int(n[1:]) for n in names if n[:1] == "t" and n[1:].isdigit() and fs.exists(self._fs(f"{self.path}/{n}/_SUCCESS")[0]))
        if not done:
            return {}
        out: dict[int, list[int]] = {n: [] for n in done}
        for r in self.spark.read.schema("version long, bucket int").parquet(*[f"{self.path}/t{n}" for n in done]).collect():  # a number for each bucket that some version kept
            out[r["version"]].append(r["bucket"])
        return out

    def _newest(self, touched: dict[int, list[int]], before: int | None) -> dict[int, int]:
        """The newest version of each bucket, or the newest one before a batch."""
        return {b: n for n in sorted(touched) if before is None or n < before for b in touched[n]}

    def read(self, before: int | None = None, only: set[int] | None = None) -> DataFrame:
        """The newest rows, or those before a batch; of some buckets alone if given."""
        newest = self._newest(self._touched(), before)
        paths = [f"{self.path}/v{n}/__bucket={b}" for b, n in sorted(newest.items()) if only is None or b in only]
        paths = [p for p in paths if self._fs(p)[1].exists(self._fs(p)[0])]  # a bucket may have become empty
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("__bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def apply(self, batch: DataFrame, number: int) -> DataFrame:
        """Upsert a batch's rows; those whose ``__op`` is ``delete`` remove their key. Within a batch the last of a key counts."""
        deleted = F.coalesce(F.col(OP) == "delete", F.lit(False)) if OP in batch.columns else F.lit(False)
        last = updates.latest(batch.withColumn("__d", deleted).drop(OP), self.key, self.arrival)
        touched = sorted(r[0] for r in self._bucketed(last.select(self.key)).select("__bucket").distinct().collect())
        kept = updates.remove(self.read(before=number, only=set(touched)), last, self.key)
        new = kept.unionByName(last.where(~F.col("__d")).drop("__d").select(*self.schema.names))
        self._bucketed(new).repartition("__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(f"{self.path}/v{number}")
        self.spark.createDataFrame([(number, b) for b in touched], "version long, bucket int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/t{number}")
        self._drop_old(number)
        return last

    def _drop_old(self, number: int) -> None:
        """Delete the buckets that neither the state before this batch nor the one after it reads."""
        touched = self._touched()
        before = self._newest(touched, number)
        for n, buckets in touched.items():
            gone = [b for b in buckets if n < before.get(b, n)]
            for b in gone:
                p, fs = self._fs(f"{self.path}/v{n}/__bucket={b}")
                fs.delete(p, True)
            if buckets and len(gone) == len(buckets):
                for name in (f"t{n}", f"v{n}"):
                    p, fs = self._fs(f"{self.path}/{name}")
                    fs.delete(p, True)

    def start(self, stream: DataFrame, checkpoint: str, on_update: Callable[[DataFrame, int], None] | None = None, available_now: bool = True):
        def each(batch: DataFrame, number: int) -> None:
            changed = self.apply(batch, number)
            if on_update:
                on_update(changed, number)

        w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
        return (w.trigger(availableNow=True) if available_now else w).start()


def tumbling(events: DataFrame, ts: str, size: str, keys: list[str], value: str, late: str | None = None, slide: str | None = None) -> DataFrame:
    """Counts and sums by event-time window; sliding if ``slide`` is given. Works on batches and, with a watermark, on streams."""
    d = events.withWatermark(ts, late) if late else events
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return d.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def sessions(events: DataFrame, ts: str, gap: str, key: str, late: str | None = None) -> DataFrame:
    d = events.withWatermark(ts, late) if late else events
    return d.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("session_start"), "n")
