"""What a viewer shows of slices: start values, grid lines, values under points, surfaces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelmill.operators import surface
from voxelmill.operators.volume import Volume, crop


def default_slice(axes: DataFrame) -> DataFrame:
    """``axes(grp, idx, coord)`` to the slice each axis starts with: (grp, target, idx).

    The target is 0 where the first and last value enclose it, else the middle
    value; the index is that of the nearest value, the lowest on a tie.
    """
    ends = axes.groupBy("grp").agg(F.min_by("coord", "idx").alias("first"), F.max_by("coord", "idx").alias("last"), F.count("*").alias("n"))
    middle = axes.join(ends, "grp").where(F.col("idx") == F.floor(F.col("n") / 2)).select("grp", F.when((F.col("first") <= 0) & (F.col("last") >= 0), 0.0).otherwise(F.col("coord")).alias("target"))
    best = F.min_by("idx", F.struct(F.abs(F.col("coord") - F.col("target")), F.col("idx"))).alias("idx")
    return axes.join(middle, "grp").groupBy("grp", "target").agg(best)


def grid_lines(inv: dict[str, Column], x: tuple[Column, Column], y: tuple[Column, Column]) -> Column:
    """Integer index lines across a plane region: array of (family, n, x0, y0, x1, y1).

    Family 1 has n of the first index, from the left to the right edge where the
    axes are not at right angles, else upright over the region's height; family 2
    likewise for the second index.
    """
    region = [(a, b) for a in x for b in y]

    def family(k: int, along: Column, across: Column, tilted: Column) -> Column:
        value = F.array(*[along * a + across * b for a, b in region])
        span = F.sequence(F.floor(F.array_min(value)).cast("int"), F.ceil(F.array_max(value)).cast("int"))

        def line(n: Column) -> Column:
            # where the line meets the region's edges
            at_y = [F.try_divide(n - along * e, across) for e in x]
            level = F.try_divide(n, along if k == 1 else across)
            straight = (level, y[0], level, y[1]) if k == 1 else (x[0], level, x[1], level)
            slanted = (x[0], at_y[0], x[1], at_y[1])
            ends = [F.when(tilted, a).otherwise(b).alias(c) for a, b, c in zip(slanted, straight, ("x0", "y0", "x1", "y1"), strict=True)]
            return F.struct(F.lit(k).alias("family"), n.alias("n"), *ends)

        return F.transform(span, line)

    tiny = F.lit(1e-12)
    return F.concat(family(1, inv["i00"], inv["i01"], F.abs(inv["i01"]) > tiny), family(2, inv["i10"], inv["i11"], F.abs(inv["i10"]) > tiny))


def readout(image: DataFrame, points: DataFrame, shape: tuple[int, int], extent: Sequence[float], inv: Sequence[Sequence[float]]) -> DataFrame:
    """``image(vol, row, col, val)`` under ``points(vol, pid, x, y)`` in plane coordinates: (vol, pid, row, col, idx1, idx2, val).

    ``shape`` is (columns, rows) and ``extent`` the image's outer edges (left,
    right, low, high).  A point reads its pixel (halves go to the even one);
    points off the image give no row; pixels that the table lacks read 0.
    """
    nx, ny = shape
    left, right, low, high = (float(e) for e in extent)
    col = F.rint((F.col("x") - left) / (right - left) * nx - 0.5).cast("int")
    row = F.rint((F.col("y") - low) / (high - low) * ny - 0.5).cast("int")
    at = points.withColumn("col", col).withColumn("row", row).where(F.col("col").between(0, nx - 1) & F.col("row").between(0, ny - 1))
    index = [(F.lit(float(a)) * F.col("x") + F.lit(float(b)) * F.col("y")).alias(n) for (a, b), n in zip(inv, ("idx1", "idx2"), strict=True)]
    got = at.select("vol", "pid", "row", "col", *index).join(image, ["vol", "row", "col"], "left")
    return got.select("vol", "pid", "row", "col", "idx1", "idx2", F.coalesce("val", F.lit(0)).alias("val"))


def isosurface(volume: Volume, isovalues: Sequence[float] | None = None, ranges: dict[int, tuple[float, float]] | None = None) -> DataFrame:
    """Surface vertices of a dense volume within ``ranges``: (vol, iso, dim, ih, ik, il, x, y, z).

    Without isovalues each volume has one: the median of the positive values
    that are left, 1 where there is none.
    """
    v = crop(volume, ranges or {})
    if isovalues is None:
        vols = v.voxels.select("vol").distinct()
        iso = vols.join(surface.default_iso(v), "vol", "left").select("vol", F.coalesce("iso", F.lit(1.0)).alias("iso"))
    else:
        levels = F.array(*[F.lit(float(i)) for i in isovalues])
        iso = v.voxels.select("vol").distinct().select("vol", F.explode(levels).alias("iso"))
    return surface.iso_crossings(v, iso)
