"""Symmetry operators: equivalents of a voxel are its orbit, or are gathered over index maps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.functions.laue import ORDERS, STORED, stored_operations, times, usable
from voxelmill.operators.ranking import percentiles
from voxelmill.operators.volume import DIMS, Grid, Volume, axis_values, densify, lattice
from voxelmill.sources.scratch import cut

#: Half-steps that a centred coordinate or a sum of two may have to either side, for packed keys.
HALF = 1 << 20
#: Rows of a map of two dimensions that are broadcast (24 bytes each); more are joined by a shuffle.
BROADCAST_MAP = 1_000_000
MAD_SCALE = 1.4826
MAD_FLOOR = 1e-10


def half_steps(grid: Grid) -> list[list[int]] | None:
    """Axis values in half steps, if they are all integers to within 1e-6."""
    out = []
    for d in range(3):
        c = [2 * x / grid.step(d) for x in grid.axes[d]]
        if any(abs(x - round(x)) > 1e-6 or 2 * abs(x) >= HALF for x in c):
            return None
        out.append([round(x) for x in c])
    return out


def commensurate(grid: Grid, group: str, full: bool = False) -> bool:
    """Whether every operation in use takes grid points onto grid points (or outside)."""
    half = half_steps(grid)
    if half is None:
        return False
    for op in stored_operations(group, grid.plane, full):
        for t, row in enumerate(op):
            if any(m and abs(grid.step(t) - grid.step(s)) > 1e-9 for s, m in enumerate(row)):
                return False
            if (sum(m * half[s][0] for s, m in enumerate(row)) - half[t][0]) % 2:
                return False
    return True


def _image(row, c: list[Column]) -> Column:
    """A coordinate of an image: the sum of the source's coordinates by a matrix row of small integers."""
    terms = [(m, c[s]) for s, m in enumerate(row) if m]
    scaled = lambda m, x: x if abs(m) == 1 else F.lit(abs(m)) * x
    out = scaled(*terms[0]) if terms[0][0] > 0 else -scaled(*terms[0])
    for m, x in terms[1:]:
        out = out + scaled(m, x) if m > 0 else out - scaled(m, x)
    return out


def orbit_key(grid: Grid, group: str, full: bool = False) -> Column:
    """A long that is equal for exactly the equivalent voxels: the largest packed image over the operations.

    Groups with all three mirror planes need the absolute coordinates and the
    distinct permutations only.
    """
    half = half_steps(grid)
    c = [F.round(F.col(n) * 2 + half[d][0]).cast("long") for d, n in enumerate(DIMS)]
    ops = stored_operations(group, grid.plane, full)
    signs = {tuple(op[i][i] for i in range(3)) for op in ops if all(op[i][i] for i in range(3)) and sum(map(abs, sum(op, ()))) == 3}
    if len(signs) == 8 and all(sum(map(abs, sum(op, ()))) == 3 for op in ops):
        c = [F.abs(x) for x in c]
        ops = sorted({tuple(tuple(map(abs, row)) for row in op) for op in ops})

    def packed(op) -> Column:
        x, y, z = (_image(row, c) + F.lit(HALF) for row in op)
        return F.shiftleft(x, 42) + F.shiftleft(y, 21) + z

    images = [packed(op) for op in ops]
    # never null: else Spark would infer filters from what is made of the key and compute it twice
    return F.coalesce(F.greatest(*images) if len(images) > 1 else images[0], F.lit(0).cast("long"))


def _stabilisers(ops: list) -> tuple[list[tuple[int, ...]], list[int], list[int]]:
    """What tells which operations leave a point as it is, from few tests.

    Linear forms (up to sign) that are zero where an operation keeps a
    coordinate; for each pattern of zero forms the operations, as bits, that
    keep the point; and for each operation g those s for which g s comes before
    g.  If one of them keeps the point, g repeats an earlier image.
    """
    place = {op: i for i, op in enumerate(ops)}

    def forms_of(op):
        rows = [tuple(m - (t == s) for s, m in enumerate(row)) for t, row in enumerate(op)]
        return {max(r, tuple(-x for x in r)) for r in rows if any(r)}

    forms = sorted(set().union(*map(forms_of, ops)))
    bits = [sum(1 << forms.index(f) for f in forms_of(op)) for op in ops]
    kept = [sum(1 << i for i, b in enumerate(bits) if b & pattern == b) for pattern in range(1 << len(forms))]
    earlier = [sum(1 << place[s] for s in ops if place[times(g, s)] < place[g]) for g in ops]
    return forms, kept, earlier


def orbit_members(means: DataFrame, grid: Grid, group: str, full: bool = False) -> DataFrame:
    """``means(vol, _o, val)`` by orbit to the distinct grid points of each orbit: (vol, ih, ik, il, val).

    The operations are a small constant array.  An image is left out if an
    operation that keeps the orbit's own point makes it equal to an earlier
    one, and if it is off the grid.  All of it is arithmetic on columns.
    """
    half, ops = half_steps(grid), stored_operations(group, grid.plane, full)
    forms, kept, earlier = _stabilisers(ops)
    mask, key = F.lit((1 << 21) - 1), F.col("_o")
    c = [F.shiftright(key, 42) - HALF, F.shiftright(key, 21).bitwiseAND(mask) - HALF, key.bitwiseAND(mask) - HALF]
    rows = means.select("vol", "val", *[x.cast("int").alias(f"_c{d}") for d, x in enumerate(c)])
    c = [F.col(f"_c{d}") for d in range(3)]
    pattern = F.lit(0)
    for i, form in enumerate(forms):
        pattern = pattern.bitwiseOR(F.when(_image(form, c) == 0, F.lit(1 << i)).otherwise(F.lit(0)))
    # never null: else Spark would infer a filter from the test below and compute all this before the aggregation, too
    rows = rows.select("*", F.coalesce(F.get(F.lit(kept).cast("array<long>"), pattern), F.lit(0).cast("long")).alias("_k"))
    names = [f"m{t}{d}" for t in range(3) for d in range(3)]
    table = F.array(*[F.struct(*[F.lit(m).alias(n) for n, m in zip(names, sum(op, ()), strict=True)], F.lit(e).cast("long").alias("e")) for op, e in zip(ops, earlier, strict=True)])
    rows = rows.select("vol", "val", *c, "_k", F.explode(table).alias("_g")).where(F.col("_k").bitwiseAND(F.col("_g.e")) == 0)
    at = [F.shiftright(sum((F.col(f"_g.m{t}{d}") * c[d] for d in range(3)), F.lit(-half[t][0])), 1).alias(n) for t, n in enumerate(DIMS)]
    rows = rows.select("vol", *at, "val")
    for n, size in zip(DIMS, grid.shape, strict=True):
        rows = rows.where((F.col(n) >= 0) & (F.col(n) < size))
    return rows


def index_maps(grid: Grid, group: str) -> list[tuple[int, int, int, int, int]]:
    """Valid rows (op, target dimension, source dimension, source index, target index).

    A target reads the source nearest to its image on each axis, ties to even;
    images off the axis have no row.  At most 48 times the axis lengths.
    """
    rows = []
    for o, op in enumerate(usable(group, grid.plane)):
        for t, (s, sign) in enumerate(op):
            at = np.rint((sign * np.asarray(grid.axes[t]) - grid.axes[s][0]) / grid.step(s)).astype(int)
            rows += [(o, t, s, int(i), j) for j, i in enumerate(at) if 0 <= i < len(grid.axes[s])]
    return rows


def plane_maps(spark: SparkSession, grid: Grid, group: str) -> tuple[tuple[int, int, int], DataFrame]:
    """For all operations of a trigonal or hexagonal group: the stored dimensions (a, b, c) of h, k and l, and rows (op, sa, sb, ta, tb, sign).

    An operation sends (h, k) to sums of both and l to itself or its opposite.
    The target at (ta, tb) reads the source nearest to its image, on each axis
    by itself, ties to even; images off the axes have no row.  Made on the
    executors, from the two axes: operations times the plane's points.
    """
    stored = STORED.get(grid.plane, STORED["HK"])
    a, b, c = (stored.index(i) for i in range(3))
    ops = [(o, *(op[i][j] for i in (a, b) for j in (a, b)), op[c][c]) for o, op in enumerate(stored_operations(group, grid.plane, True))]
    na, nb = grid.shape[a], grid.shape[b]
    at = spark.range(na * nb).select(F.floor(F.col("id") / nb).cast("int").alias("ta"), (F.col("id") % nb).cast("int").alias("tb"))
    at = at.join(F.broadcast(axis_values(spark, grid, a, "ta", "xa")), "ta").join(F.broadcast(axis_values(spark, grid, b, "tb", "xb")), "tb")
    at = at.join(F.broadcast(spark.createDataFrame(ops, "op int, m00 int, m01 int, m10 int, m11 int, sign int")))
    image = lambda i: F.col(f"m{i}0") * F.col("xa") + F.col(f"m{i}1") * F.col("xb")
    near = lambda i, d: F.rint((image(i) - F.lit(float(grid.axes[d][0]))) / F.lit(float(grid.step(d)))).cast("int")
    at = at.select("op", near(0, a).alias("sa"), near(1, b).alias("sb"), "ta", "tb", "sign")
    return (a, b, c), at.where(F.col("sa").between(0, na - 1) & F.col("sb").between(0, nb - 1))


def gather_full(volume: Volume, group: str) -> DataFrame:
    """``gather`` over all operations of a trigonal or hexagonal group, those that mix h and k included.

    A measured voxel's plane place is looked up in the map of two dimensions,
    which is broadcast up to BROADCAST_MAP rows and joined by a shuffle beyond,
    and its third index in that of one.
    """
    spark, grid = volume.voxels.sparkSession, volume.grid
    (a, b, c), plane = plane_maps(spark, grid, group)
    rows = len(stored_operations(group, grid.plane, True)) * grid.shape[a] * grid.shape[b]
    plane = F.broadcast(plane) if rows <= BROADCAST_MAP else plane
    axis = np.asarray(grid.axes[c])
    third = [(s, int(i), j) for s in (-1, 1) for j, i in enumerate(np.rint((s * axis - axis[0]) / grid.step(c)).astype(int)) if 0 <= i < len(axis)]
    third = F.broadcast(spark.createDataFrame(third, "sign int, sc int, tc int"))
    v = volume.voxels.where("val is not null and val <> 0").select("vol", *[F.col(DIMS[d]).alias(f"s{n}") for d, n in ((a, "a"), (b, "b"), (c, "c"))], "val")
    v = v.join(plane, ["sa", "sb"]).join(third, ["sign", "sc"])
    names = {a: "ta", b: "tb", c: "tc"}
    return v.select("vol", *[F.col(names[d]).alias(n) for d, n in enumerate(DIMS)], "val")


def gather(volume: Volume, group: str, full: bool = False) -> DataFrame:
    """Measured equivalents of each target voxel: (vol, ih, ik, il, val), a row for each operation that hits one.

    Each operation reads the target's source along three axes; the maps hold at
    most a few hundred thousand rows by construction and are broadcast.
    """
    if full and len(usable(group, volume.grid.plane)) < ORDERS[group]:
        return gather_full(volume, group)
    spark = volume.voxels.sparkSession
    maps = spark.createDataFrame(index_maps(volume.grid, group), "op int, t int, s int, src int, tgt int")
    sets = maps.groupBy("op", "s", "src").agg(F.first("t").alias("t"), F.collect_list("tgt").alias("tgts"))
    v = volume.voxels.where("val is not null and val <> 0")
    for s, name in enumerate(DIMS):
        on = sets.where(F.col("s") == s).select("op", F.col("src").alias(name), F.col("t").alias(f"t{s}"), F.col("tgts").alias(f"g{s}"))
        v = v.join(F.broadcast(on), ["op", name] if s else [name])
    for s in range(3):
        v = v.withColumn(f"g{s}", F.explode(f"g{s}"))
    pick = lambda t: F.when(F.col("t0") == t, F.col("g0")).when(F.col("t1") == t, F.col("g1")).otherwise(F.col("g2"))
    return v.select("vol", *[pick(t).alias(n) for t, n in enumerate(DIMS)], "val")


def symmetrize(volume: Volume, group: str, strategy: str | None = None, full: bool = False) -> Volume:
    """Each voxel becomes the mean of its measured equivalents, 0 if there is none.

    Where the axes are commensurate the equivalents are the voxel's orbit
    (strategy "orbit"): voxels and, unless the volume is dense, all grid points are summed
    by the orbit's key, within a task first, and each orbit then gives its
    members, with no sort and no join.  Else values are gathered over index maps
    ("gather").  ``full``: trigonal and hexagonal groups use all operations,
    not only those that mix no indices.  The result is dense.
    """
    strategy = strategy or ("orbit" if commensurate(volume.grid, group, full) else "gather")
    if strategy == "orbit":
        key = orbit_key(volume.grid, group, full).alias("_o")
        v = volume.voxels.select("vol", key, F.nullif(F.col("val"), F.lit(0)).alias("val"))
        if not volume.meta.get("dense"):
            v = v.union(lattice(volume).select("vol", key, F.lit(None).cast(v.schema["val"].dataType)))
        means = v.groupBy("vol", "_o").agg(F.coalesce(F.avg("val"), F.lit(0.0)).alias("val"))
        out = orbit_members(means, volume.grid, group, full)
    else:
        grid_points = densify(volume).voxels
        means = gather(volume, group, full).groupBy("vol", *DIMS).agg((F.sum("val") / F.count("val")).cast("double").alias("_m"))
        out = grid_points.join(means, ["vol", *DIMS], "left").select("vol", *DIMS, F.coalesce("_m", F.lit(0.0)).alias("val"))
    return volume.with_voxels(out, laue_group=group, dense=True, **({"all_operations": True} if full else {}))


def let(value: Column, body) -> Column:
    """``body`` of ``value``, computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def array_median(a: Column) -> Column:
    """Median of an array without nulls, null if empty."""
    mid = lambda s, i: F.get(s, i.cast("int"))
    # not array_sort, which calls a comparing function for each two values
    return let(F.sort_array(a), lambda s: F.when(F.size(s) > 0, (mid(s, F.floor((F.size(s) - 1) / 2)) + mid(s, F.floor(F.size(s) / 2))) / 2.0))


def _mend(a: Column, sigma: float) -> Column:
    """Values of one orbit (null or 0: unmeasured) with outliers replaced by the median."""

    def mended(med: Column, mad: Column) -> Column:
        return F.transform(a, lambda x: F.when((x != 0) & (mad > MAD_FLOOR) & (F.abs(x - med) > F.lit(float(sigma)) * mad), med).otherwise(x))

    spread = lambda known, med: F.lit(MAD_SCALE) * array_median(F.transform(known, lambda x: F.abs(x - med)))
    return let(F.filter(a, lambda x: x != 0), lambda k: let(array_median(k), lambda m: let(spread(k, m), lambda d: mended(m, d))))


def reject_outliers(volume: Volume, group: str, sigma: float = 3.0, n_iter: int = 1, strategy: str | None = None, full: bool = False) -> Volume:
    """Replace measured voxels that lie over ``sigma`` scaled MADs from the median of their equivalents by it.

    The result is dense and has a column ``replaced`` (how often a voxel was).
    A voxel whose median is 0 becomes 0 and is unmeasured in the next rounds.
    Equivalents of a voxel are at most 48 values, so an orbit is one short
    array: with commensurate axes all rounds take a single shuffle.  Otherwise
    each round gathers anew from the mended values.  ``full`` is that of
    ``symmetrize``.
    """
    strategy = strategy or ("orbit" if commensurate(volume.grid, group, full) else "gather")
    points = densify(volume).voxels.withColumn("val", F.nullif(F.col("val").cast("double"), F.lit(0.0)))
    if strategy == "orbit":
        at = F.struct(*DIMS, "val")
        o = points.withColumn("_o", orbit_key(volume.grid, group, full)).groupBy("vol", "_o").agg(F.collect_list(at).alias("at"))
        o = o.select("vol", "at", F.transform("at", lambda x: x["val"]).alias("a"), F.transform("at", lambda x: F.lit(0)).alias("r"))
        for _ in range(n_iter):
            o = o.withColumn("b", _mend(F.col("a"), sigma))
            changed = F.zip_with(F.zip_with("a", "b", lambda x, y: (x != y).cast("int")), "r", lambda c, r: F.coalesce(c, F.lit(0)) + r)
            o = o.select("vol", "at", F.col("b").alias("a"), changed.alias("r"))
        rows = o.select("vol", F.explode(F.arrays_zip("at", "a", "r")).alias("x"))
        out = rows.select("vol", *[F.col(f"x.at.{d}").alias(d) for d in DIMS], F.col("x.a").alias("val"), F.col("x.r").alias("replaced"))
    else:
        # a round reads its voxels twice, as targets and as sources: they are made once
        out = cut(points.withColumn("replaced", F.lit(0)))
        for i in range(n_iter):
            near = gather(volume.with_voxels(out.select("vol", *DIMS, "val")), group, full).groupBy("vol", *DIMS).agg(F.collect_list("val").alias("e"))
            spread = let(array_median(F.col("e")), lambda m: F.struct(m.alias("med"), (F.lit(MAD_SCALE) * array_median(F.transform("e", lambda x: F.abs(x - m)))).alias("mad")))
            near = near.select("vol", *DIMS, spread.alias("m")).select("vol", *DIMS, "m.*")
            bad = F.coalesce((F.col("val") != 0) & (F.col("mad") > MAD_FLOOR) & (F.abs(F.col("val") - F.col("med")) > F.lit(float(sigma)) * F.col("mad")), F.lit(False))
            out = out.join(near, ["vol", *DIMS], "left")
            out = out.select("vol", *DIMS, F.when(bad, F.col("med")).otherwise(F.col("val")).alias("val"), (F.col("replaced") + bad.cast("int")).alias("replaced"))
            if i < n_iter - 1:
                out = cut(out)
    return volume.with_voxels(out.withColumn("val", F.coalesce("val", F.lit(0.0))), dense=True)


def outlier_stats(volume: Volume, group: str) -> DataFrame:
    """Robust statistics of raw less symmetrised values by volume: non-zero residuals, unmeasured but filled voxels included."""
    sym = symmetrize(volume, group).voxels.withColumnRenamed("val", "sym")
    raw = densify(volume).voxels
    r = raw.join(sym, ["vol", *DIMS]).select("vol", (F.coalesce("val", F.lit(0)) - F.col("sym")).alias("r")).where("r <> 0")
    r = cut(r)
    size = volume.grid.points
    middle = lambda x, name: percentiles(r.select("vol", x.alias("x")), ["vol"], [0.5], size=size).select("vol", F.col("p")[0].alias(name))
    centre = middle(F.col("r"), "median")
    r = r.join(centre, "vol")
    spread = middle(F.abs(F.col("r") - F.col("median")), "mad")
    a = r.join(spread, "vol").withColumn("abs_r", F.abs("r")).withColumn("std", F.col("mad") * MAD_SCALE)
    out = a.groupBy("vol").agg(
        F.first("median").alias("median"),
        F.first("mad").alias("mad"),
        F.first("std").alias("robust_std"),
        F.max("abs_r").alias("max_abs"),
        *[F.count_if(F.col("abs_r") > k * F.col("std")).alias(f"n_over_{k}") for k in (2, 3, 5)],
        F.count("*").alias("n_total"),
    )
    out = out.join(percentiles(a.select("vol", F.col("abs_r").alias("x")), ["vol"], [0.9, 0.95, 0.99, 0.999], size=size), "vol")
    names = ("p90", "p95", "p99", "p99_9")
    return out.select("vol", "median", "mad", "robust_std", *[F.col("p")[i].alias(n) for i, n in enumerate(names)], "max_abs", "n_over_2", "n_over_3", "n_over_5", "n_total", (F.col("n_over_3") / F.col("n_total")).alias("share_over_3"))
