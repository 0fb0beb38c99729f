"""Slices, resampling, line profiles and display ranges."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelmill.functions.geometry import PLANES
from voxelmill.operators.ranking import largest, percentiles
from voxelmill.operators.volume import DIMS, Volume, positives

#: Stored dimension that each view keeps fixed.
FIXED = {"HK": 2, "HL": 1, "KL": 0}


def hat(distance: Column) -> Column:
    """Weight of a neighbour in linear interpolation."""
    return F.greatest(F.lit(0.0), 1 - F.abs(distance))


def native_slice(volume: Volume, target: float, width: float = 0.0) -> tuple[DataFrame, dict]:
    """Sum over the layers within ``width`` of ``target``, or the nearest layer: (vol, row = ik, col = ih, val) and what was taken.

    The layers become a filter on il, which reaches a Parquet scan.
    """
    idx = volume.grid.window(2, target, width)
    rows = volume.within({2: (idx[0], idx[-1])})
    if idx != list(range(idx[0], idx[-1] + 1)):
        rows = rows.where(F.col("il").isin(idx))
    out = rows.groupBy("vol", F.col("ik").alias("row"), F.col("ih").alias("col")).agg(F.sum("val").alias("val"))
    return out, {"actual": volume.grid.axes[2][idx[len(idx) // 2]], "n_slices": len(idx)}


def _targets(volume: Volume, dim: int, target: float, width: float) -> tuple[list[float], float]:
    """Axis values to interpolate at (a single slice: the requested one) and the value to report."""
    idx = volume.grid.window(dim, target, width)
    reported = volume.grid.axes[dim][idx[len(idx) // 2]]
    return ([target] if width < 1e-6 else [volume.grid.axes[dim][i] for i in idx]), reported


def plane_matrix(meta: dict, plane: str, stored: bool = True) -> list[list[float]]:
    """Cartesian to Miller indices in ``plane``: the stored matrix, else by the orientation matrix (first, unless ``stored``), else one."""
    given = meta.get("m_inv")
    if meta.get("ub") is None or (stored and given):
        return given or [[1.0, 0.0], [0.0, 1.0]]
    ub, wl = meta["ub"], meta.get("wavelength") or 1.0
    u, v = ([ub[3 * r + c] / wl for r in range(3)] for c in PLANES[plane])
    m11 = math.hypot(*u)
    m12 = sum(a * b for a, b in zip(u, v, strict=True)) / m11
    m22 = math.sqrt(sum(b * b for b in v) - m12 * m12)
    return [[1 / m11, -m12 / (m11 * m22)], [0.0, 1 / m22]]


def oblique_slab(volume: Volume, view: str, target: float, width: float = 0.0) -> tuple[DataFrame, dict]:
    """The HL or KL slab by linear interpolation along the fixed axis: (vol, ix, iy, val).

    Every voxel next to the slab adds to its own cell with its interpolation
    weight, so no neighbour is looked up and one aggregation does it.  The h cross term
    (m_inv[0][1] * s) shifts the fixed h of a KL slab row by row.
    """
    grid, meta, dim = volume.grid, volume.meta, FIXED[view]
    if dim == 2:
        raise ValueError("HK is the native view")
    values, reported = _targets(volume, dim, target, width)
    inv = plane_matrix(meta, grid.plane)
    s = meta.get("s") if meta.get("s") is not None else abs(grid.step(0) / inv[0][0])
    cy = meta.get("cy", (grid.shape[1] + 1) / 2)
    cross = inv[0][1] * s
    last = grid.shape[dim] - 1
    start, step = grid.axes[dim][0], grid.step(dim)

    def weight(tv: float) -> Column:
        at = (F.lit(tv) - F.lit(cross) * (F.col("ik") + 1 - F.lit(cy)) - F.lit(start)) / F.lit(step) if dim == 0 else F.lit((tv - start) / step)
        return F.when((at >= 0) & (at <= last), hat(F.col(DIMS[dim]) - at)).otherwise(F.lit(0.0))

    def place(tv: float, k: float) -> float:
        """Where row ``k`` is interpolated along the fixed axis, moved into the grid."""
        return min(max((tv - (cross * (k + 1 - cy) if dim == 0 else 0.0) - start) / step, 0.0), float(last))

    w = weight(values[0])
    for tv in values[1:]:
        w = w + weight(tv)
    # only neighbouring layers: a range that reaches the scan, for KL then row by row
    ends = [place(tv, k) for tv in values for k in ((0, grid.shape[1] - 1) if dim == 0 else (0,))]
    near = F.lit(True)
    if dim == 0 and cross:
        mine = [F.greatest(F.lit(0.0), F.least(F.lit(float(last)), (F.lit(tv) - F.lit(cross) * (F.col("ik") + 1 - F.lit(cy)) - F.lit(start)) / F.lit(step))) for tv in values]
        near = near & (F.least(*[F.abs(F.col("ih") - m) for m in mine]) < 1 if len(mine) > 1 else F.abs(F.col("ih") - mine[0]) < 1)
    x, y = ("ik", "il") if dim == 0 else ("ih", "il")
    slab = volume.within({dim: (math.floor(min(ends)), math.ceil(max(ends)))}).where(near).groupBy("vol", F.col(x).alias("ix"), F.col(y).alias("iy")).agg(F.sum(F.col("val") * w).alias("val"))
    shift = 0.0
    if dim == 1:
        shift = cross * ((sum(values) / len(values) - start) / step + 1 - cy)
    x_dim = 1 if dim == 0 else 0
    return slab, {"actual": reported, "n_slices": len(values), "x0": grid.axes[x_dim][0] + shift, "dx": grid.step(x_dim), "nx": grid.shape[x_dim], "y0": grid.axes[2][0], "dy": grid.step(2), "ny": grid.shape[2], "s": s}


def bilinear(values: DataFrame, points: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """``values(vol, ix, iy, val)`` at ``points(vol, pid, fx, fy)``: (vol, pid, val), 0 outside the grid.

    A point goes to its up to four neighbours with a weight each, meets the
    values there in an equi-join and sums up.
    """
    inside = F.col("fx").between(0, shape[0] - 1) & F.col("fy").between(0, shape[1] - 1)
    corner = F.array(*[F.struct((F.floor("fx") + i).cast("int").alias("ix"), (F.floor("fy") + j).cast("int").alias("iy")) for i in (0, 1) for j in (0, 1)])
    near = points.where(inside).select("vol", "pid", "fx", "fy", F.explode(corner).alias("c")).select("vol", "pid", "c.ix", "c.iy", (hat(F.col("fx") - F.col("c.ix")) * hat(F.col("fy") - F.col("c.iy"))).alias("w"))
    got = near.where("w > 0").join(values, ["vol", "ix", "iy"]).groupBy("vol", "pid").agg(F.sum(F.col("w") * F.col("val")).alias("val"))
    return points.select("vol", "pid").join(got, ["vol", "pid"], "left").select("vol", "pid", F.coalesce("val", F.lit(0.0)).alias("val"))


def regrid(slab: DataFrame, at: dict, inv, out_n: int) -> DataFrame:
    """A slab on a square Cartesian grid of ``out_n`` points: (vol, row, col, val)."""
    c = (out_n + 1) / 2
    pts = slab.select("vol").distinct().withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(out_n - 1)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(out_n - 1))))
    x, y = F.col("col") + 1 - F.lit(c), F.col("row") + 1 - F.lit(c)
    s = F.lit(float(at["s"]))
    i1 = F.lit(float(inv[0][0])) * s * x + F.lit(float(inv[0][1])) * s * y
    i2 = F.lit(float(inv[1][0])) * s * x + F.lit(float(inv[1][1])) * s * y
    pts = pts.select("vol", (F.col("row") * out_n + F.col("col")).alias("pid"), ((i1 - at["x0"]) / at["dx"]).alias("fx"), ((i2 - at["y0"]) / at["dy"]).alias("fy"))
    out = bilinear(slab, pts, (at["nx"], at["ny"]))
    return out.select("vol", F.floor(F.col("pid") / out_n).cast("int").alias("row"), (F.col("pid") % out_n).cast("int").alias("col"), "val")


def extract_slice(volume: Volume, view: str, target: float, width: float = 0.0, view_inverse=None) -> tuple[DataFrame, dict]:
    """A plane of the volume with its description: the stored plane natively, HL and KL interpolated and put on a Cartesian grid.

    HK of frames that are stored as another plane is the one nearest layer, whatever the width.
    """
    if FIXED[view] == 2 or view == volume.grid.plane:
        return native_slice(volume, target, width if view == volume.grid.plane else 0.0)
    slab, at = oblique_slab(volume, view, target, width)
    return regrid(slab, at, view_inverse or plane_matrix(volume.meta, view, stored=False), volume.grid.shape[0]), at


def line_profile(image: DataFrame, shape: tuple[int, int], start: tuple[float, float], end: tuple[float, float], samples: int) -> DataFrame:
    """``image(vol, row, col, val)`` along a line in (col, row) pixel coordinates: (vol, sample, val), null off the image."""
    t = F.col("sample") / F.lit(float(max(1, samples - 1)))
    pts = image.select("vol").distinct().withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    pts = pts.select("vol", F.col("sample").alias("pid"), (start[0] + t * (end[0] - start[0])).alias("fx"), (start[1] + t * (end[1] - start[1])).alias("fy"))
    got = bilinear(image.select("vol", F.col("col").alias("ix"), F.col("row").alias("iy"), "val"), pts, shape)
    on = (F.col("fx") >= 0) & (F.col("fx") < shape[0] - 1) & (F.col("fy") >= 0) & (F.col("fy") < shape[1] - 1)
    return got.join(pts, ["vol", "pid"]).select("vol", F.col("pid").alias("sample"), F.when(on, F.col("val")).alias("val"))


def sample_count(start: tuple[float, float], end: tuple[float, float], pixel: float) -> int:
    return max(500, int(max(abs(end[0] - start[0]), abs(end[1] - start[1])) / pixel * 3))


def axis_profile(volume: Volume, along: int, at: dict[int, float]) -> DataFrame:
    """Values along a stored dimension at the nearest points of the other two: (vol, idx, val)."""
    v = volume.within({d: (i, i) for d, value in at.items() for i in [volume.grid.nearest(d, value)]})
    return v.select("vol", F.col(DIMS[along]).alias("idx"), "val")


def montage(volume: Volume, targets: list[float], share: float = 0.99) -> DataFrame:
    """The nearest layer of each target with the given percentile of its positives: (vol, target, row, col, val, vmax)."""
    if not targets:
        raise ValueError("no targets")
    by_layer: dict[int, list[float]] = {}
    for t in targets:
        by_layer.setdefault(volume.grid.nearest(2, t), []).append(float(t))
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("t")) for i, ts in by_layer.items() for t in ts])
    v = volume.voxels.where(F.col("il").isin(list(by_layer)))
    v = v.select("vol", F.explode(F.filter(pairs, lambda p: p["i"] == F.col("il"))).alias("p"), "ik", "ih", "val").select("vol", F.col("p.t").alias("target"), F.col("ik").alias("row"), F.col("ih").alias("col"), "val")
    layer = volume.grid.shape[0] * volume.grid.shape[1]
    top = percentiles(positives(v, "target"), ["vol", "target"], [share], size=layer).select("vol", "target", F.col("p")[0].alias("vmax"))
    return v.join(top, ["vol", "target"], "left")


def auto_range(image: DataFrame, pixels: int | None = None) -> DataFrame:
    """Display limits of each image: 1st percentile of its positives (0 if none) and 99.5th of all; ``pixels`` of an image, if known."""
    size = largest(image, ["vol"]) if pixels is None else pixels
    low = percentiles(positives(image), ["vol"], [0.01], size=size).select("vol", F.col("p")[0].alias("vmin"))
    high = percentiles(image.select("vol", F.col("val").alias("x")), ["vol"], [0.995], size=size).select("vol", F.col("p")[0].alias("vmax"))
    return high.join(low, "vol", "left").select("vol", F.coalesce("vmin", F.lit(0.0)).alias("vmin"), "vmax")
