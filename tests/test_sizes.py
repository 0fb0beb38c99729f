"""Steps whose work has to be dealt over all tasks, or done once, however large their tables are."""

import pyarrow as pa
from pyspark.sql import functions as F

from voxelmill import catalog
from voxelmill.operators import matching, surface, symmetry
from voxelmill.operators.volume import DIMS, Grid, Volume, affine
from voxelmill.sources import fixtures as X
from voxelmill.sources import frames as S
from voxelmill.sources import parameters as P

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pixels_carry_what_their_layer_has(spark):
    """No join of a table of layers to its own pixels, which sent the table to the driver."""
    layers = spark.createDataFrame([("a", 2, 1.0, 0.5, 2.0, 0.1, 1.5, 1.5, [7, 8, 9], "HK"), ("b", 2, 1.0, 0.5, 2.0, 0.1, 1.5, 1.5, [], "HL")], "path string, nx int, i00 double, i01 double, i11 double, s double, cx double, cy double, payload array<int>, plane string")
    got = S.layer_pixels(layers, "plane")
    assert got.columns == ["path", "row", "col", "idx1", "idx2", "val", "plane"]
    assert sorted(got.select("path", "row", "col", "val", "plane").collect()) == [("a", 0, 0, 7, "HK"), ("a", 0, 1, 8, "HK"), ("a", 1, 0, 9, "HK")]
    assert "Join" not in plan(catalog.QUERIES["layer_read"](spark, SF))


def test_one_long_layer_list_is_made_by_many_tasks(spark):
    """A single request is dealt as files; rows, numbers and lines are those of the whole list."""
    wanted = spark.createDataFrame([("a", -3.0, 40.0, 0.02), ("b", 1.0, 0.0, 0.5), ("c", 0.0, 0.0, 0.5), ("d", 0.0, 4.99, 0.01)], "name string, l_min double, l_max double, l_step double").coalesce(1)
    rows = P.layer_rows(wanted)
    assert rows.where("name = 'a'").select(F.spark_partition_id()).distinct().count() > 1
    n = {"a": 2151, "c": 1, "d": 500}
    start, step = {"a": -3.0, "c": 0.0, "d": 0.0}, {"a": 0.02, "c": 0.5, "d": 0.01}
    got = sorted(map(tuple, rows.collect()))
    assert got == sorted((k, i // 500, i % 500 + 1, round((start[k] + i * step[k]) * 1e6) / 1e6, -(-n[k] // 500)) for k in n for i in range(n[k]))
    lines = {(r.file, r.row_no): r.line for r in P.layer_lines(rows, 0.75).collect()}
    assert len(lines) == len(got)
    for k, file, row, l, files in got:
        name = f"{k}.dcunwarp" if files == 1 else f"{k}_{file + 1:03d}.dcunwarp"
        z, one = f"{0:10.6f}", f"{1:10.6f}"
        assert lines[name, row] == f'"{row}"   {z}   {z}  {l:10.6f}     {one}   {z}   {z}     {z}   {one}   {z}        {0.75:10.6f}       0       0'


def test_frames_are_taken_one_by_one(spark):
    """A batch of frames is never held whole, and files made of one small table are dealt over tasks."""
    schema = pa.schema([("path", pa.string()), ("payload", pa.list_(pa.int32()))])
    taken = []

    def rows(n, pixels):
        for i in range(n):
            taken.append(i)
            yield {"path": str(i), "payload": [i] * pixels}

    assert next(S.bounded(rows(10_000, 2), schema)).num_rows == len(taken) == S.HELD_ROWS
    assert [b.num_rows for b in S.bounded(rows(2 * S.HELD_ROWS + 1, 2), schema)] == [S.HELD_ROWS, S.HELD_ROWS, 1]
    assert [b.num_rows for b in S.bounded(rows(5, S.HELD // 2), schema)] == [2, 2, 1]
    assert list(S.bounded([], schema)) == []
    for kind in ("compressed", "cbf"):
        files = X.frame_files(spark, SF, kind)
        assert files.select(F.spark_partition_id()).distinct().count() > 1
        assert files.count() == spark.read.parquet(f"{SF}/embeddings.parquet").count()


def test_windows_of_one_group_meet_in_many_tasks(spark):
    """One group in one bucket is many tasks; rows are those of all pairs, empty and zero windows take the nearest."""
    axis = spark.range(40).select(F.lit(1).alias("grp"), F.col("id").alias("idx"), (F.col("id") % 7 / 2.0).alias("coord"))
    w = F.col("id")
    windows = spark.range(300).select(F.lit(1).alias("grp"), w.alias("wid"), (w * 13 % 97 / 16.0 - 1).alias("target"), F.when(w % 3 == 0, 0.0).otherwise(w % 5 / 8.0).alias("width"))
    got = matching.window_rows(axis, windows)
    want = set()
    places = [(r.idx, r.coord) for r in axis.collect()]
    for r in windows.collect():
        inside = [i for i, x in places if r.width > 1e-6 and r.target - r.width <= x <= r.target + r.width]
        want |= {(1, r.wid, i) for i in inside or [min(places, key=lambda p: (abs(p[1] - r.target), p[0]))[0]]}
    rows = list(map(tuple, got.collect()))
    assert len(rows) == len(want) and set(rows) == want
    one = windows.where("width > 0.4").withColumn("target", F.lit(1.0))
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert matching.window_rows(axis, one).select(F.spark_partition_id()).distinct().count() > 3
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)


def test_gathered_rounds_make_their_voxels_once(spark):
    v = X.embedding_voxels(spark, SF, hot=True)
    v = v.with_voxels(v.voxels.where("vol < 3"))
    one = symmetry.reject_outliers(v, "mmm", strategy="gather").voxels
    assert "posexplode" not in plan(one)
    rows = lambda how: sorted((*r[:4], round(r[4], 6), r[5]) for r in symmetry.reject_outliers(v, "mmm", 3.0, 2, strategy=how).voxels.collect())
    assert rows("gather") == rows("orbit")


def test_lines_of_a_surface_stay_dealt(spark):
    """Lines are dealt in a fixed number of parts, which are not joined to few large ones."""
    voxels = spark.range(64).select(F.lit(0).alias("vol"), *[(F.floor(F.col("id") / 4**d) % 4).cast("int").alias(n) for d, n in enumerate(DIMS)], F.pmod(F.xxhash64("id"), F.lit(9)).cast("double").alias("val"))
    axis = affine(4, 1.0, 0.0)
    got = surface.iso_crossings(Volume(voxels, Grid((axis, axis, axis)), {"dense": True}), spark.createDataFrame([(0, 4.5)], "vol int, iso double"))
    assert plan(got).count("REPARTITION_BY_NUM") == 3
    at = {tuple(r[1:4]): r[4] for r in voxels.collect()}
    want = {(d, *p) for p in at for d in range(3) if (q := tuple(x + (i == d) for i, x in enumerate(p))) in at and (at[p] < 4.5) != (at[q] < 4.5)}
    assert sorted(map(tuple, got.select("dim", *DIMS).collect())) == sorted(want)
