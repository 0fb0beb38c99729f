"""Smoothing, rescaling and iso-surface crossings of dense volumes."""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelmill.operators.ranking import percentiles
from voxelmill.operators.volume import DIMS, Grid, Volume, coordinate, positives


def kernel(sigma: float, truncate: float = 4.0) -> list[float]:
    """Normalised Gaussian weights of distance 0, 1, ... up to truncate * sigma."""
    r = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(r + 1)]
    total = w[0] + 2 * sum(w[1:])
    return [x / total for x in w]


def _reflected(at: Column, n: int) -> Column:
    """Index of a place up to n beyond the ends, reflected about the outer edges."""
    return F.when(at < 0, -1 - at).when(at >= n, 2 * n - 1 - at).otherwise(at)


def smooth(volume: Volume, sigma: float = 0.5) -> Volume:
    """Separable Gaussian with reflected edges: one window per dimension over its grid lines."""
    w, out = kernel(sigma), volume.voxels.withColumn("val", F.col("val").cast("double"))
    for d, name in enumerate(DIMS):
        n = volume.grid.shape[d]
        if n <= len(w) - 1:
            raise ValueError("an axis is shorter than the kernel")
        line = W.partitionBy("vol", *[x for x in DIMS if x != name]).orderBy(name)
        total = F.col("val") * w[0]
        for k in range(1, len(w)):
            for step in (-k, k):
                # a reflected neighbour is at a known distance of the point itself
                take = None
                for edge in range(k):
                    idx = edge if step < 0 else n - 1 - edge
                    mirror = (k - 1 - edge) if step < 0 else (n - k + edge)
                    value = F.lag("val", idx - mirror).over(line) if mirror != idx else F.col("val")
                    take = F.when(F.col(name) == idx, value) if take is None else take.when(F.col(name) == idx, value)
                total = total + w[k] * take.otherwise(F.lag("val", -step).over(line))
        out = out.withColumn("_s", total).select("vol", *DIMS, F.col("_s").alias("val"))
    return volume.with_voxels(out)


def rescale_uint16(voxels: DataFrame) -> DataFrame:
    """Per volume: values stretched to 0..65535 and truncated, if none is negative and the largest is below 65535."""
    ends = voxels.groupBy("vol").agg(F.min("val").alias("lo"), F.max("val").alias("hi"))
    fits = (F.col("hi") > 0) & (F.col("hi") < 65535) & (F.col("lo") >= 0)
    scaled = F.floor(F.col("val") * 65535.0 / F.col("hi")).cast("double")
    return voxels.join(ends, "vol").select("vol", *DIMS, F.when(fits, scaled).otherwise(F.col("val").cast("double")).alias("val"))


def default_iso(volume: Volume) -> DataFrame:
    """Median of the positive values of each volume."""
    return percentiles(positives(volume.voxels), ["vol"], [0.5], size=volume.grid.points).select("vol", F.col("p")[0].alias("iso"))


def slider_range(volume: Volume) -> DataFrame:
    """Logarithmic limits of an iso-value slider from percentiles of the positives."""
    p = percentiles(positives(volume.voxels), ["vol"], [0.5, 0.9999], size=volume.grid.points)
    return p.select("vol", (F.log10(F.greatest(F.col("p")[0], F.lit(0.5))) - 1).alias("log_low"), F.log10(F.greatest(F.col("p")[1], F.lit(1.0))).alias("log_high"))


def iso_crossings(volume: Volume, iso: DataFrame) -> DataFrame:
    """Where grid edges of a dense volume cross ``iso(vol, iso)``, one or more a volume: (vol, iso, dim, ih, ik, il, x, y, z).

    The indices are the edge's lower end; x, y, z are axis values of the linear crossing.
    """
    v = volume.voxels
    at = [coordinate(volume.grid, d) for d in range(3)]
    tasks = int(v.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = []
    for d, name in enumerate(DIMS):
        lines = ["vol", *[x for x in DIMS if x != name]]
        line = W.partitionBy(*lines).orderBy(name)
        # a fixed number of parts: voxels pack so well that small ones would be joined to millions of rows to sort in a task
        e = v.repartition(tasks, *lines).withColumn("nxt", F.lead("val").over(line)).where("nxt is not null").join(iso, "vol")
        e = e.where((F.col("val") < F.col("iso")) != (F.col("nxt") < F.col("iso")))
        t = (F.col("iso") - F.col("val")) / (F.col("nxt") - F.col("val"))
        place = [at[i] + t * F.lit(volume.grid.step(d)) if i == d else at[i] for i in range(3)]
        parts.append(e.select("vol", "iso", F.lit(d).alias("dim"), *DIMS, *[p.alias(n) for p, n in zip(place, "xyz", strict=True)]))
    return parts[0].union(parts[1]).union(parts[2])


#: The six tetrahedra of a cell, as corners (bit 0: next h, 1: next k, 2: next l): the paths from the first to the last corner.
#: Cells that share a face split it alike.
TETRAHEDRA = [(0, 1 << a, 1 << a | 1 << b, 7) for a, b, _ in permutations(range(3))]


def tetrahedron_cases() -> list[list[list[tuple[int, int]]]]:
    """Triangles by the bits of a tetrahedron's inner corners (values of the level or more): each three edges (inner, outer corner).

    For a tetrahedron of positive volume; seen from outside, edges run
    counterclockwise.  Made by rule: the edges between inner and outer corners
    form a ring, turned so that its normal points outwards, and cut in a fan.
    """
    at = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)]
    out = []
    for mask in range(16):
        inner = [i for i in range(4) if mask >> i & 1]
        outer = [i for i in range(4) if not mask >> i & 1]
        if len(inner) == 2:
            ring = [(inner[0], outer[0]), (inner[0], outer[1]), (inner[1], outer[1]), (inner[1], outer[0])]
        else:
            ring = [(i, o) for i in inner for o in outer]
        if not inner or not outer:
            out.append([])
            continue
        p, q, r = ([(at[i][d] + at[o][d]) / 2 for d in range(3)] for i, o in ring[:3])
        u, v = ([y[d] - p[d] for d in range(3)] for y in (q, r))
        normal = [u[(d + 1) % 3] * v[(d + 2) % 3] - u[(d + 2) % 3] * v[(d + 1) % 3] for d in range(3)]
        outward = sum(n * (sum(at[o][d] for o in outer) / len(outer) - sum(at[i][d] for i in inner) / len(inner)) for d, n in enumerate(normal))
        ring = ring if outward > 0 else ring[::-1]
        out.append([[ring[0], ring[i], ring[i + 1]] for i in range(1, len(ring) - 1)])
    return out


def _odd(tetrahedron: tuple[int, ...]) -> bool:
    """Whether its volume is negative: the axes of its path are an odd permutation."""
    axes = [(b ^ a).bit_length() - 1 for a, b in zip(tetrahedron, tetrahedron[1:], strict=False)]
    return sum(a > b for i, a in enumerate(axes) for b in axes[i + 1 :]) % 2 == 1


def cells(volume: Volume) -> DataFrame:
    """The cells of a dense volume that have all eight corners: (vol, ih, ik, il, v) with the corners' values.

    Each voxel is a corner of up to eight cells; what a task has of a cell
    comes together before the shuffle.
    """
    place = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), *[F.lit(c >> d & 1).alias(n) for d, n in enumerate(DIMS)]) for c in range(8)]))
    rows = volume.voxels.select("vol", *DIMS, F.col("val").cast("double").alias("val"), place.alias("o"))
    rows = rows.select("vol", *[(F.col(n) - F.col(f"o.{n}")).alias(n) for n in DIMS], F.col("o.c").alias("c"), "val")
    for n, size in zip(DIMS, volume.grid.shape, strict=True):
        rows = rows.where((F.col(n) >= 0) & (F.col(n) < size - 1))
    got = rows.groupBy("vol", *DIMS).agg(*[F.max(F.when(F.col("c") == c, F.col("val"))).alias(f"v{c}") for c in range(8)])
    return got.na.drop(subset=[f"v{c}" for c in range(8)]).select("vol", *DIMS, F.array(*[f"v{c}" for c in range(8)]).alias("v"))


def triangles(volume: Volume, iso: DataFrame) -> DataFrame:
    """The surface of a dense volume at ``iso(vol, iso)``: (vol, iso, e0, x0, y0, z0, e1, ... z2), a row for each triangle.

    Cells are split in six tetrahedra, which meet without gaps.  A vertex lies
    on an edge, whose number e stands for its lower end and direction, so that
    triangles share vertices by number: packed index of the lower end times 8,
    plus the bits of the steps to the other.  Inside are values of the level or
    more; triangles run counterclockwise seen from outside.  Closed surfaces
    have each edge in two triangles; a surface that leaves the grid is open.
    """
    (_, nk, nl) = volume.grid.shape
    cases = tetrahedron_cases()
    packed = lambda tri: sum((i | o << 2) << 4 * n for n, (i, o) in enumerate(tri))
    table = [[packed(t) for t in c] for c in cases] + [[packed(t[::-1]) for t in c] for c in cases]
    c = cells(volume).join(iso, "vol")
    c = c.where((F.array_min("v") < F.col("iso")) & (F.array_max("v") >= F.col("iso")))
    tets = F.array(*[F.struct(*[F.lit(x).alias(f"t{i}") for i, x in enumerate(t)], F.lit(16 * _odd(t)).alias("odd")) for t in TETRAHEDRA])
    c = c.select("vol", "iso", *DIMS, "v", F.explode(tets).alias("t"))
    value = lambda corner: F.get(F.col("v"), corner)
    mask = F.col("t.odd")
    for i in range(4):
        mask = mask + F.when(value(F.col(f"t.t{i}")) >= F.col("iso"), F.lit(1 << i)).otherwise(F.lit(0))
    c = c.select("vol", "iso", *DIMS, "v", F.array(*[f"t.t{i}" for i in range(4)]).alias("t"), F.explode(F.get(F.lit(table), mask)).alias("tri"))
    ends = []
    for n in range(3):
        one, two = (F.get(F.col("t"), F.shiftright(F.col("tri"), 4 * n + 2 * k).bitwiseAND(F.lit(3))) for k in (0, 1))
        ends += [F.least(one, two).alias(f"a{n}"), F.greatest(one, two).alias(f"b{n}")]
    c = c.select("vol", "iso", *DIMS, "v", *ends)
    out = []
    for n in range(3):
        low, high = F.col(f"a{n}"), F.col(f"b{n}")
        bit = lambda x, d: F.shiftright(x, d).bitwiseAND(F.lit(1))
        at = [F.col(name) + bit(low, d) for d, name in enumerate(DIMS)]
        t = (F.col("iso") - value(low)) / (value(high) - value(low))
        edge = ((at[0].cast("long") * nk + at[1]) * nl + at[2]) * 8 + low.bitwiseXOR(high)
        out += [edge.alias(f"e{n}"), *[(coordinate(volume.grid, d, at[d]) + t * F.lit(volume.grid.step(d)) * bit(low.bitwiseXOR(high), d)).alias(f"{x}{n}") for d, x in enumerate("xyz")]]
    return c.select("vol", "iso", *out)


def mesh(volume: Volume, iso: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The surface as ``vertices(vol, iso, edge, x, y, z)``, each once, and ``faces(vol, iso, e0, e1, e2)``."""
    t = triangles(volume, iso)
    each = F.explode(F.array(*[F.struct(F.col(f"e{n}").alias("edge"), *[F.col(f"{x}{n}").alias(x) for x in "xyz"]) for n in range(3)])).alias("p")
    vertices = t.select("vol", "iso", each).groupBy("vol", "iso", "p.edge").agg(*[F.first(f"p.{x}").alias(x) for x in "xyz"])
    return vertices, t.select("vol", "iso", "e0", "e1", "e2")


def face_lines(grid: Grid) -> list[list[int]]:
    """Integer grid lines on each axis of the box."""
    return [list(range(math.ceil(min(a)), math.floor(max(a)) + 1)) for a in grid.axes]
