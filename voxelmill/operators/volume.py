"""Volumes of gridded intensities: a table of voxels and a small grid of axis values.

Voxel tables have the columns vol, ih, ik, il, val; a null or zero val is
unmeasured.  All volumes of a table share the grid, which holds a few thousand
numbers and lives on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from voxelmill.functions.geometry import floor_mean
from voxelmill.operators.ranking import percentiles

DIMS = ("ih", "ik", "il")


@dataclass(frozen=True)
class Grid:
    """Axis values of the three stored dimensions."""

    axes: tuple[tuple[float, ...], tuple[float, ...], tuple[float, ...]]
    plane: str = "HK"

    @property
    def shape(self) -> tuple[int, int, int]:
        return tuple(map(len, self.axes))

    @property
    def points(self) -> int:
        return len(self.axes[0]) * len(self.axes[1]) * len(self.axes[2])

    def step(self, dim: int) -> float:
        a = self.axes[dim]
        return a[1] - a[0] if len(a) > 1 else 1.0

    def nearest(self, dim: int, value: float) -> int:
        """Index of the axis value nearest to ``value``; the lowest on a tie."""
        a = self.axes[dim]
        return min(range(len(a)), key=lambda i: (abs(a[i] - value), i))

    def window(self, dim: int, value: float, width: float) -> list[int]:
        """Indices within ``width`` of ``value``; the nearest if there is none or the width is 0."""
        a = self.axes[dim]
        got = [i for i, x in enumerate(a) if value - width <= x <= value + width] if width >= 1e-6 else []
        return got or [self.nearest(dim, value)]


def affine(n: int, step: float, start: float) -> tuple[float, ...]:
    return tuple(start + step * i for i in range(n))


@dataclass(frozen=True)
class Volume:
    """``bricks``, if there, holds the same voxels as arrays of small boxes (``to_bricks``).

    ``observed`` are counts that the voxels' plan makes on its way; they are
    known once the voxels have been written, and go into the metadata then.
    """

    voxels: DataFrame
    grid: Grid
    meta: dict = field(default_factory=dict)
    bricks: DataFrame | None = None
    observed: tuple[Observation, ...] = ()

    def with_voxels(self, voxels: DataFrame, **meta) -> Volume:
        return replace(self, voxels=voxels, meta=self.meta | meta, bricks=None)

    def within(self, ranges: dict[int, tuple[int, int]]) -> DataFrame:
        """Voxels whose indices lie in inclusive ranges by dimension; of bricks only those that meet the ranges are opened."""
        rows = self.voxels
        if self.bricks is not None:
            near = self.bricks
            for d, (first, last) in ranges.items():
                near = near.where((F.col(f"{BOX[d]}0") <= last) & (F.col(f"{BOX[d]}1") >= first))
            rows = from_bricks(near)
        for d, (first, last) in ranges.items():
            rows = rows.where(F.col(DIMS[d]).between(first, last))
        return rows


#: Names of a brick's place and of its first and last index, by dimension: bh, h0, h1 and so on.
BOX = ("h", "k", "l")
#: Points along a brick's edges: at most 4,096 values in a row.
EDGE = 16


def to_bricks(volume: Volume, edge: int = EDGE) -> DataFrame:
    """Voxels as rows of boxes: (vol, edge, bh, bk, bl, h0, h1, k0, k1, l0, l1, z, pos, val).

    The first and last index of the voxels that a brick has are its ranges.
    ``z`` interleaves the bits of its place, so that bricks near in space are
    near in order; ``pos`` are packed places within the brick, rising.
    """
    place = [F.floor(F.col(d) / edge).cast("int") for d in DIMS]
    offset = [F.col(d) % edge for d in DIMS]
    rows = volume.voxels.select("vol", *[p.alias(f"b{b}") for p, b in zip(place, BOX, strict=True)], *DIMS, ((offset[0] * edge + offset[1]) * edge + offset[2]).cast("int").alias("pos"), "val")
    ends = [f(d).alias(f"{b}{i}") for d, b in zip(DIMS, BOX, strict=True) for i, f in enumerate((F.min, F.max))]
    out = rows.groupBy("vol", "bh", "bk", "bl").agg(*ends, F.array_sort(F.collect_list(F.struct("pos", "val"))).alias("v"))
    z = F.lit(0).cast("long")
    for bit in range(max(1, (max(volume.grid.shape) // edge).bit_length())):
        for d, b in enumerate(BOX):
            z = z.bitwiseOR(F.shiftleft(F.shiftright(F.col(f"b{b}"), bit).bitwiseAND(F.lit(1)).cast("long"), 3 * bit + 2 - d))
    return out.select("vol", F.lit(edge).alias("edge"), "bh", "bk", "bl", *[f"{b}{i}" for b in BOX for i in (0, 1)], z.alias("z"), F.col("v.pos").alias("pos"), F.col("v.val").alias("val"))


def from_bricks(bricks: DataFrame) -> DataFrame:
    """Bricks back to voxels: (vol, ih, ik, il, val)."""
    each = bricks.select("vol", "edge", "bh", "bk", "bl", F.explode(F.arrays_zip("pos", "val")).alias("v")).select("vol", "edge", "bh", "bk", "bl", "v.pos", "v.val")
    e, pos = F.col("edge"), F.col("pos")
    within = (F.floor(pos / (e * e)), F.floor(pos / e) % e, pos % e)
    return each.select("vol", *[(F.col(f"b{b}") * e + w).cast("int").alias(d) for b, w, d in zip(BOX, within, DIMS, strict=True)], "val")


def axis_table(volume: Volume) -> DataFrame:
    """The grid as rows (dim, idx, coord)."""
    rows = [(d, i, float(x)) for d, a in enumerate(volume.grid.axes) for i, x in enumerate(a)]
    return volume.voxels.sparkSession.createDataFrame(rows, "dim int, idx int, coord double")


def axis_values(spark: SparkSession, grid: Grid, dim: int, index: str, value: str) -> DataFrame:
    """One axis as rows of its ``index`` (int) and ``value`` (double)."""
    rows = [(i, float(x)) for i, x in enumerate(grid.axes[dim])]
    return spark.createDataFrame(rows, f"{index} int, {value} double")


def coordinate(grid: Grid, dim: int, at: Column | None = None) -> Column:
    """The axis value at a voxel's index, or at ``at``: start and step of an even axis, else its values."""
    a, step, at = grid.axes[dim], grid.step(dim), F.col(DIMS[dim]) if at is None else at
    if all(abs(x - (a[0] + step * i)) <= 1e-12 * max(abs(x), abs(step)) for i, x in enumerate(a)):
        return F.lit(float(a[0])) + F.lit(float(step)) * at
    return F.get(F.array(*[F.lit(float(x)) for x in a]), at)


def lattice(volume: Volume) -> DataFrame:
    """Every grid point of every volume: (vol, ih, ik, il).

    A layer is a row of its own before its points are made, and layers are dealt
    over all tasks, so that a single volume is made by many.
    """
    nh, nk, nl = volume.grid.shape
    tasks = int(volume.voxels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = volume.voxels.select("vol").distinct().withColumn("il", F.explode(F.sequence(F.lit(0), F.lit(nl - 1)))).repartition(tasks, "vol", "il")
    for name, n in (("ih", nh), ("ik", nk)):
        out = out.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return out.select("vol", *DIMS)


def densify(volume: Volume) -> Volume:
    """Every grid point of every volume as a row; absent ones get 0, rows of one point are summed.

    Points and voxels meet in one aggregation, which sums what a task has of a
    point before the shuffle.  A volume that is dense already stays as it is.
    """
    if volume.meta.get("dense"):
        return volume
    kind = volume.voxels.schema["val"].dataType
    rows = volume.voxels.select("vol", *DIMS, "val").union(lattice(volume).withColumn("val", F.lit(0).cast(kind)))
    return volume.with_voxels(rows.groupBy("vol", *DIMS).agg(F.coalesce(F.sum("val"), F.lit(0)).cast(kind).alias("val")), dense=True)


def bin_frames(voxels: DataFrame, shape: tuple[int, int], by: int, bx: int) -> DataFrame:
    """Block means of each layer (floor of the integer mean); the trailing remainder is dropped."""
    return _binned(voxels, (shape[0] // bx * bx, shape[1] // by * by, None), (bx, by, 1), True)


def _binned(voxels: DataFrame, keep, factors, integer: bool) -> DataFrame:
    for name, n in zip(DIMS, keep, strict=True):
        if n is not None:
            voxels = voxels.where(F.col(name) < n)
    block = [F.floor(F.col(d) / b).cast("int").alias(d) if b > 1 else F.col(d) for d, b in zip(DIMS, factors, strict=True)]
    size = factors[0] * factors[1] * factors[2]
    total = F.sum(F.coalesce("val", F.lit(0)))
    mean = floor_mean(total, F.lit(size)) if integer else total / F.lit(float(size))
    return voxels.groupBy("vol", *block).agg(mean.alias("val"))


def bin_axis(axis: tuple[float, ...], b: int) -> tuple[float, ...]:
    """Block means of axis values, remainder dropped."""
    return tuple(sum(axis[i : i + b]) / b for i in range(0, len(axis) // b * b, b))


def bin_volume(volume: Volume, bh: int, bk: int, bl: int) -> Volume:
    """Block means over the trimmed volume; unmeasured voxels count as 0.

    Integer values give the floor of the mean, others the mean.  Scale and
    factors in the metadata follow once: s and bin_xy by the larger of bh and
    bk, bin_z by bl; the pixel centre is that of the new grid.  Factors of 1
    leave the volume as it is.
    """
    if min(bh, bk, bl) < 1:
        raise ValueError("bin factors are positive")
    if (bh, bk, bl) == (1, 1, 1):
        return volume
    f = (bh, bk, bl)
    grid = Grid(tuple(bin_axis(a, b) for a, b in zip(volume.grid.axes, f, strict=True)), volume.grid.plane)
    keep = [n * b if n * b < m else None for n, b, m in zip(grid.shape, f, volume.grid.shape, strict=True)]
    integer = volume.voxels.schema["val"].dataType.typeName() in ("long", "integer", "short", "byte")
    m, xy = volume.meta, max(bh, bk)
    meta = {"bin_xy": m.get("bin_xy", 1) * xy, "bin_z": m.get("bin_z", 1) * bl, "cx": (grid.shape[0] + 1) / 2, "cy": (grid.shape[1] + 1) / 2}
    if m.get("s") is not None:
        meta["s"] = m["s"] * xy
    return Volume(_binned(volume.voxels, keep, f, integer), grid, m | meta)


def crop(volume: Volume, ranges: dict[int, tuple[float, float]]) -> Volume:
    """Voxels with axis values inside inclusive ranges by dimension; indices start anew.  Filters reach the scan."""
    axes, ends = list(volume.grid.axes), {}
    for d, (lo, hi) in ranges.items():
        inside = [i for i, x in enumerate(axes[d]) if lo <= x <= hi]
        axes[d] = tuple(axes[d][i] for i in inside)
        ends[d] = (inside[0], inside[-1]) if inside else (0, -1)
    v = volume.within(ends).withColumns({DIMS[d]: F.col(DIMS[d]) - F.lit(first) for d, (first, _) in ends.items()}) if ends else volume.voxels
    return Volume(v, Grid(tuple(axes), volume.grid.plane), volume.meta)


def clip_symmetric(volume: Volume, limits: dict[int, float]) -> Volume:
    """Keep |axis value| <= limit, where the limit is below the axis' largest by more than 0.01."""
    todo = {d: (-v, v) for d, v in limits.items() if v < max(map(abs, volume.grid.axes[d])) - 0.01}
    return crop(volume, todo)


def info(voxels: DataFrame, size: int) -> DataFrame:
    """Per volume: least and largest value, measured count and percentage of ``size`` grid points."""
    return voxels.groupBy("vol").agg(
        F.min("val").alias("min_val"),
        F.max("val").alias("max_val"),
        F.count_if(F.col("val") != 0).alias("n_measured"),
        F.round(100.0 * F.count_if(F.col("val") != 0) / F.lit(float(size)), 6).alias("percent"),
    )


def positives(voxels: DataFrame, *group: str) -> DataFrame:
    """The positive values as x, by volume and ``group``."""
    return voxels.where("val > 0").select("vol", *group, F.col("val").alias("x"))


def positive_percentiles(volume: Volume, shares: list[float]) -> DataFrame:
    """Exact percentiles (linear interpolation) of the positive values of each volume, one column each."""
    p = percentiles(positives(volume.voxels), ["vol"], shares, size=volume.grid.points)
    return p.select("vol", *[F.col("p")[i].alias("p" + f"{100 * s:g}".replace(".", "_")) for i, s in enumerate(shares)])


def size_estimate_mb(nx: Column, ny: Column, n: Column) -> Column:
    """Size of a stack of n frames of 32-bit values."""
    return nx * ny * n * 4 / F.lit(1e6)
