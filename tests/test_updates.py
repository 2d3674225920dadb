"""Keyed updates: batches one at a time give the same as the final state."""

import pytest
from pyspark.sql import functions as F

from lattica.config import Agg
from lattica.streaming.keyed import KeyedState
from lattica.table import table


def rows(t, key="y"):
    return sorted((tuple(r.values()) for r in t.view().to_json()), key=str)


def test_partial_update_keeps_and_clears(spark):
    t = table(spark, [{"x": 1, "y": "a", "z": True}, {"x": 2, "y": "b", "z": False}], index="y")
    t.update([{"x": 5, "y": "a"}])
    t.update([{"y": "b", "z": True}])
    assert rows(t) == [(2, "b", True), (5, "a", True)]
    t.update({"y": ["a"], "x": [None]})
    assert rows(t) == [(2, "b", True), (None, "a", True)]
    t.remove(["b", "none"])
    assert rows(t) == [(None, "a", True)]


def test_append_ring_replace_clear(spark):
    t = table(spark, [{"x": 1}, {"x": 2}])
    t.update([{"x": 3}])
    assert t.size() == 3
    t.replace([{"x": 9}])
    assert rows(t) == [(9,)]
    t.clear()
    assert t.size() == 0
    ring = table(spark, [{"x": i} for i in range(4)], limit=2)
    assert rows(ring) == [(2,), (3,)]
    with pytest.raises(ValueError):
        table(spark, [{"x": 1}], index="x", limit=3)


def test_ring_of_rows_sorted_by_sampled_ranges(spark):
    n = 600_000  # beyond the sample that bounds the ranges of a sort, which differs each time a plan runs
    rows_in_order = spark.range(n, numPartitions=2).select((F.col("id") * 7919 % n).alias("x")).orderBy("x")
    ring = table(spark, rows_in_order, limit=100)
    assert rows(ring, "x") == sorted(((i,) for i in range(n - 100, n)), key=str)
    ring.update(rows_in_order.limit(30))
    assert rows(ring, "x") == sorted(((i,) for i in [*range(n - 70, n), *range(30)]), key=str)


def test_ring_smaller_or_larger_than_partitions(spark):
    d = spark.range(100, numPartitions=7)
    for limit in (1, 5, 40, 99, 100, 1000):
        ring = table(spark, d, limit=limit)
        assert sorted(r.id for r in ring.df.collect()) == list(range(max(0, 100 - limit), 100))
        ring.update(d.where("id < 3"))
        assert sorted(r.id for r in ring.df.collect()) == sorted([*range(100), 0, 1, 2][-limit:] if limit < 103 else [*range(100), 0, 1, 2])
        ring.update(d.limit(0))
        ring.update(d)
        assert sorted(r.id for r in ring.df.collect()) == sorted([*range(100), 0, 1, 2, *range(100)][-limit:])


def test_callbacks(spark):
    t = table(spark, [{"x": 1, "y": "a"}, {"x": 2, "y": "b"}], index="y")
    v = t.view(row_pivots=["y"], aggregates={"n": Agg("sum", "x")})
    got = []
    v.on_update(lambda: got.append("called"))
    v.on_update(lambda df: got.append(sorted((r["y"] or "", r["n"]) for r in df.collect())), "rows")
    v.on_update(lambda df: got.append([r["y"] for r in df.collect()]), "pkey")
    t.update([{"x": 7, "y": "b"}])
    assert got == ["called", [("", 8), ("b", 7)], ["b"]]
    v.on_delete(lambda: got.append("gone"))
    t.delete()
    assert got[-1] == "gone"


def test_stream_equals_final_state(spark, tmp_path):
    batches = [[(1, "a", 1, None), (2, "b", 2, None)], [(1, "c", 3, None), (3, "d", 4, None)], [(2, None, 5, "delete"), (3, "e", 6, None), (3, "f", 7, None)]]
    cols = "k long, v string, at long, __op string"
    src = tmp_path / "in"
    for i, b in enumerate(batches):
        spark.createDataFrame(b, cols).coalesce(1).write.mode("append").parquet(str(src))
    schema = spark.createDataFrame([], "k long, v string, at long").schema
    state = KeyedState(spark, str(tmp_path / "state"), schema, "k", "at")
    seen = []
    q = state.start(spark.readStream.schema(cols).option("maxFilesPerTrigger", 1).parquet(str(src)), str(tmp_path / "cp"), lambda df, n: seen.append((n, df.count())))
    q.awaitTermination(120)
    assert sorted((r.k, r.v) for r in state.read().collect()) == [(1, "c"), (3, "f")]
    again = state.apply(spark.createDataFrame(batches[2], cols), 2)  # the same batch once more changes nothing
    assert again.count() == 2 and sorted((r.k, r.v) for r in state.read().collect()) == [(1, "c"), (3, "f")] and len(seen) == 3


def test_watermarked_window_on_a_stream(spark, tmp_path):
    from lattica.streaming.keyed import tumbling

    spark.createDataFrame([("2024-01-01 00:01:00", 1.0), ("2024-01-01 00:02:00", 2.0), ("2024-01-01 02:00:00", 4.0)], "ts string, v double").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "e"))
    s = tumbling(spark.readStream.schema("ts timestamp, v double").parquet(str(tmp_path / "e")), "ts", "1 hour", [], "v", late="10 minutes")
    q = s.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.total for r in spark.table("windows").collect()) == [3.0, 4.0]


def test_state_rewrites_only_touched_buckets(spark, tmp_path):
    import os
    import random

    rng = random.Random(3)
    schema = spark.createDataFrame([], "k long, v string, at long").schema
    state = KeyedState(spark, str(tmp_path / "s"), schema, "k", "at", buckets=8)
    want: dict = {}
    at = 0
    for n in range(12):
        rows = []
        for _ in range(rng.randint(1, 4) if n else 40):
            at += 1
            k, gone = rng.randint(1, 30), n > 0 and rng.random() < 0.3
            rows.append((k, None if gone else f"x{at}", at, "delete" if gone else None))
            want.pop(k, None) if gone else want.update({k: f"x{at}"})
        for _ in range(2 if n % 4 == 0 else 1):  # a batch that is run again changes nothing
            state.apply(spark.createDataFrame(rows, "k long, v string, at long, __op string"), n)
        assert {r.k: r.v for r in state.read().collect()} == want
    folders = [f for v in os.listdir(tmp_path / "s") if v[0] == "v" for f in os.listdir(tmp_path / "s" / v) if f.startswith("__bucket")]
    assert len(folders) <= 16  # two states at most


def test_ancestors_at_any_depth(spark):
    from lattica.operators import updates

    rows = [(i, i - 1 if i else None) for i in range(11)] + [(20, 99), (30, 31), (31, 30), (40, 40), (None, 3)]
    got = {r.k: r.path for r in updates.parent_tree(spark.createDataFrame(rows, "k long, up long"), "k", "up").collect()}
    assert all(got[i] == list(range(i + 1)) for i in range(11)) and got[20] == [20] and got[40] == [40]
    assert set(got[30]) == set(got[31]) == {30, 31} and got[30][-1] == 30
