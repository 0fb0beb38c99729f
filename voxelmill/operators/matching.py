"""Nearest and interval joins of groups of any size: neighbours meet in ranges, never all pairs of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelmill.sources.scratch import cut

#: A window at most this wide takes the nearest value.
NARROW = 1e-6
#: Parts in which the windows of a bucket are dealt; the bucket's values go to each.
SHARES = 16


def neighbours(axis: DataFrame, targets: DataFrame) -> DataFrame:
    """``axis(grp, idx, coord)`` and ``targets(grp, target)`` to the values beside each different target: (grp, target, low, high).

    ``low`` and ``high`` are structs of the last value up to the target and the
    first from it on, x, and its lowest index, idx; null where there is none.
    Values and targets are put in one order, dealt in ranges, and each target
    takes the last value before it and the first behind it in its range; where
    a range has none, the nearest range that has one gives it, over a table of
    one row a range.  Nulls are left out.
    """
    values = axis.where("grp is not null and coord is not null").groupBy("grp", F.col("coord").cast("double").alias("x")).agg(F.min("idx").alias("idx"))
    wanted = targets.where("grp is not null and target is not null").select("grp", F.col("target").cast("double").alias("x")).distinct()
    rows = values.select("grp", "x", F.struct("x", "idx").alias("at")).unionByName(wanted, allowMissingColumns=True)
    dealt = cut(rows.repartitionByRange("grp", "x").withColumn("part", F.spark_partition_id()))
    ends = dealt.groupBy("grp", "part").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    before = W.partitionBy("grp").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    behind = W.partitionBy("grp").orderBy(F.desc("part")).rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select("grp", "part", F.max("last").over(before).alias("low"), F.min("first").over(behind).alias("high"))
    # of equal places the value comes first either way
    up = W.partitionBy("grp", "part").orderBy("x", F.col("at").isNull()).rowsBetween(W.unboundedPreceding, W.currentRow)
    down = W.partitionBy("grp", "part").orderBy(F.desc("x"), F.col("at").isNull()).rowsBetween(W.unboundedPreceding, W.currentRow)
    near = dealt.withColumn("down", F.last("at", True).over(up)).withColumn("up", F.last("at", True).over(down)).where("at is null").drop("at")
    return near.join(ends, ["grp", "part"]).select("grp", F.col("x").alias("target"), F.coalesce("down", "low").alias("low"), F.coalesce("up", "high").alias("high"))


def _nearest() -> Column:
    """The index of the nearer of ``low`` and ``high``, the lower index on a tie; null where there is neither."""
    far = lambda s: F.when(F.col(s).isNotNull(), F.struct(F.abs(F.col(f"{s}.x") - F.col("target")).alias("d"), F.col(f"{s}.idx").alias("idx")))
    return F.array_min(F.array(far("low"), far("high")))


def nearest_rows(axis: DataFrame, targets: DataFrame) -> DataFrame:
    """``axis(grp, idx, coord)`` and ``targets(grp, target)`` to the nearest index of each different target, the lowest on a tie.

    Groups without values give no rows; nulls are left out.
    """
    return neighbours(axis, targets).select("grp", "target", _nearest().alias("b")).where("b is not null").select("grp", "target", F.col("b.idx").alias("idx"))


def window_rows(axis: DataFrame, windows: DataFrame) -> DataFrame:
    """``axis(grp, idx, coord)`` and ``windows(grp, wid, target, width)`` to (grp, wid, idx): the values within ``width`` of each window's target.

    A window without a value, or no wider than NARROW, takes the nearest one,
    the lowest index on a tie; the values beside its target tell whether it is
    empty, so that no pairs are made for that.  Values and windows meet in
    buckets as wide as a group's mean window, so that windows span three buckets
    in the mean at most; a bucket's windows are dealt in SHARES, each of which
    meets the bucket's values, so that few groups are many tasks.
    """
    windows = windows.where("grp is not null and target is not null").select("grp", "wid", F.col("target").cast("double").alias("target"), F.coalesce(F.col("width").cast("double"), F.lit(0.0)).alias("width"))
    tasks = int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    low, high, wide_enough = F.col("target") - F.col("width"), F.col("target") + F.col("width"), F.col("width") > NARROW
    wide = windows.where(wide_enough)
    size = wide.groupBy("grp").agg((2 * F.avg("width")).alias("size"))
    place = lambda x: F.floor(x / F.col("size"))
    share = F.pmod(F.xxhash64("wid"), F.lit(SHARES)).cast("int")
    dealt = wide.join(size, "grp").select("grp", "wid", low.alias("low"), high.alias("high"), share.alias("share"), F.explode(F.sequence(place(low), place(high))).alias("bucket"))
    dealt = dealt.repartition(tasks, "grp", "bucket", "share")
    values = axis.where("coord is not null").join(size, "grp").select("grp", "idx", "coord", place(F.col("coord")).alias("bucket"), F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share"))
    found = dealt.join(values, ["grp", "bucket", "share"]).where("coord between low and high").select("grp", "wid", "idx")
    meets = lambda s: F.coalesce(F.col(f"{s}.x").between(low, high), F.lit(False))
    known = windows.join(neighbours(axis, windows.select("grp", "target")), ["grp", "target"]).select("grp", "wid", (wide_enough & (meets("low") | meets("high"))).alias("some"), _nearest().alias("b"))
    # rows of one window's id are one window
    rest = known.withColumn("some", F.max("some").over(W.partitionBy("grp", "wid"))).where("not some and b is not null")
    return found.union(rest.select("grp", "wid", F.col("b.idx").alias("idx")))
