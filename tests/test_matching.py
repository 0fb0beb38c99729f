"""Nearest and interval joins, sketches, and the watch of folders."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelmill.operators import matching, ranking
from voxelmill.streaming import watch


def nearest(axis, targets):
    out = {}
    for g, t in set(targets):
        best = min(((abs(c - t), i) for h, i, c in axis if h == g), default=None)
        if best:
            out[g, t] = best[1]
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_nearest_equals_brute_force(spark, parts):
    rng = np.random.default_rng(parts)
    axis = [(int(g), i, float(c)) for g in range(5) for i, c in enumerate(rng.integers(-20, 20, rng.integers(0, 30)) / 2)]
    targets = [(int(rng.integers(0, 6)), float(t) / 4) for t in rng.integers(-60, 60, 300)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = matching.nearest_rows(spark.createDataFrame([*axis, (0, 99, None), (None, 1, 0.0)], "grp int, idx int, coord double"), spark.createDataFrame([*targets, (0, None), (None, 1.0)], "grp int, target double"))
        assert {(r.grp, r.target): r.idx for r in got.collect()} == nearest(axis, targets) and got.count() == len(nearest(axis, targets))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_nearest_in_one_group_of_a_million(spark):
    n = 1_000_000
    axis = spark.range(n).select(F.lit(0).alias("grp"), F.col("id").alias("idx"), (F.col("id") * 2.0).alias("coord"))
    targets = spark.range(n).select(F.lit(0).alias("grp"), (F.col("id") * 2.0 + F.when(F.col("id") % 3 == 0, 1.0).otherwise(0.5)).alias("target"))
    got = matching.nearest_rows(axis, targets)
    # a third lie halfway: the lower index
    assert got.where(F.col("idx") != F.floor(F.col("target") / 2)).count() == 0 and got.count() == n


def test_windows_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    axis = [(g, i, float(c)) for g in range(4) for i, c in enumerate(sorted(rng.integers(-40, 40, 25) / 4))]
    windows = [(int(rng.integers(0, 5)), w, float(rng.integers(-60, 60) / 8), float(rng.choice([0.0, 1e-7, 0.1, 0.25, 2.0, 11.0]))) for w in range(400)]
    want = set()
    for g, w, t, d in windows:
        mine = [(i, c) for h, i, c in axis if h == g]
        inside = [i for i, c in mine if d > 1e-6 and t - d <= c <= t + d]
        want |= {(g, w, i) for i in inside or [i for _, i in sorted((abs(c - t), i) for i, c in mine)[:1]]}
    got = matching.window_rows(spark.createDataFrame(axis, "grp int, idx int, coord double"), spark.createDataFrame(windows, "grp int, wid int, target double, width double")).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_sketches_keep_their_error(spark):
    n, shares = 200_000, [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]
    for k in (100, 400):
        for kind in (F.exp(F.rand(5) * 12), F.floor(F.rand(6) * 3)):
            values = spark.range(n).select(F.lit(1).alias("vol"), kind.cast("double").alias("x")).cache()
            x = np.sort([r.x for r in values.collect()])
            got = ranking.sketch_percentiles(values, ["vol"], shares, k).first().p
            error = ranking.rank_error(k)
            for s, v in zip(shares, got, strict=True):
                low, high = np.searchsorted(x, v, "left") / n, np.searchsorted(x, v, "right") / n
                assert low - 3 * error <= s <= high + 3 * error, (k, s, low, high)
    parts = values.withColumn("part", F.spark_partition_id())
    merged = ranking.merged(ranking.sketches(parts, ["vol", "part"], 400), ["vol"])
    assert merged.select(F.kll_sketch_get_n_double("sketch")).first()[0] == n


def files(spark, path):
    return spark.readStream.schema("folder string, name string, bytes long").option("maxFilesPerTrigger", 1).json(path)


def put(spark, path, i, rows):
    spark.createDataFrame(rows, "folder string, name string, bytes long").coalesce(1).write.mode("append").json(path)


def test_a_stack_is_handed_over_once(spark, tmp_path):
    """Frames over several batches, repeated and late ones; one folder falls short and goes quiet."""
    path = str(tmp_path / "in")
    put(spark, path, 0, [("a", "1", 10), ("a", "1", 10), ("b", "1", 1)])
    out = watch.stacks(files(spark, path), frames=3, quiet_ms=15_000)
    query = out.writeStream.format("memory").queryName("stacks_seen").option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="1 second").start()
    try:
        # timers keep batches coming, so the stream is never idle: wait for what it has read
        def wait(ready):
            deadline = time.time() + 60
            while not ready() and time.time() < deadline:
                time.sleep(0.5)

        read = lambda: sum(p.numInputRows for p in query.recentProgress)
        for i, rows in enumerate(([("a", "2", 20), ("a", "1", 10), ("c", "1", 1)], [("a", "3", 30), ("c", "2", 1)], [("a", "4", 40), ("c", "3", 1), ("a", "1", 10)])):
            put(spark, path, i + 1, rows)
        wait(lambda: read() >= 11)
        wait(lambda: spark.table("stacks_seen").count() >= 3)
        put(spark, path, 9, [("b", "2", 1)])
        wait(lambda: read() >= 12)
        assert sorted(map(tuple, spark.table("stacks_seen").collect())) == [("a", 3, 60, "complete"), ("b", 1, 1, "quiet"), ("c", 3, 3, "complete")]
    finally:
        query.stop()
