"""Triangles of surfaces, and bricks of volumes."""

import collections
import glob

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from voxelmill.operators import slicing, surface, volume
from voxelmill.sources import store


def dense(spark, data, step=1.0):
    n = data.shape
    grid = volume.Grid(tuple(volume.affine(k, step, -(k - 1) * step / 2) for k in n))
    rows = [(0, *map(int, at), float(v)) for at, v in np.ndenumerate(data)]
    return volume.Volume(spark.createDataFrame(rows, "vol long, ih int, ik int, il int, val double"), grid)


def level(spark, *values):
    return spark.createDataFrame([(0, float(v)) for v in values], "vol long, iso double")


def distances(n):
    at = np.indices((n, n, n)) - (n - 1) / 2
    return np.sqrt((at**2).sum(0))


def topology(faces):
    """Vertices less edges plus triangles, and how often each directed edge is met."""
    edges = collections.Counter((a, b) for f in faces for a, b in ((f[0], f[1]), (f[1], f[2]), (f[2], f[0])))
    vertices = {v for f in faces for v in f}
    return len(vertices) - len({frozenset(e) for e in edges}) + len(faces), edges


@pytest.mark.parametrize("shape,euler", [("sphere", 2), ("torus", 0), ("two", 4), ("random", None)])
def test_closed_surfaces(spark, shape, euler):
    n = 11
    at = np.indices((n, n, n)) - (n - 1) / 2
    if shape == "sphere":
        data = 5 - distances(n)
    elif shape == "torus":
        data = 1.6 - np.sqrt((np.sqrt(at[0] ** 2 + at[1] ** 2) - 2.9) ** 2 + at[2] ** 2)
    elif shape == "two":
        data = 2.3 - np.minimum(*(np.sqrt((at[0] - x) ** 2 + at[1] ** 2 + at[2] ** 2) for x in (-2.6, 2.6)))
    else:
        data = np.zeros((n, n, n))
        data[1:-1, 1:-1, 1:-1] = np.random.default_rng(4).integers(-3, 4, (n - 2,) * 3)
        data -= 0.5
    v = dense(spark, data)
    rows = surface.triangles(v, level(spark, 0.25 if shape != "random" else 0.5)).collect()
    faces = [(r.e0, r.e1, r.e2) for r in rows]
    got, edges = topology(faces)
    assert faces and all(len(set(f)) == 3 for f in faces)
    # each edge is met once each way: closed, and turned alike everywhere
    assert set(edges.values()) == {1} and all((b, a) in edges for a, b in edges)
    assert euler is None or got == euler


def test_a_sphere_s_area_and_outward_normals(spark):
    rows = surface.triangles(dense(spark, 8 - distances(19), 0.5), level(spark, 1.0)).collect()
    p = np.array([[[r[f"{x}{n}"] for x in "xyz"] for n in range(3)] for r in rows])
    normal = np.cross(p[:, 1] - p[:, 0], p[:, 2] - p[:, 0]) / 2
    area, inside = np.linalg.norm(normal, axis=1).sum(), (normal * p.mean(1)).sum() / 3
    assert abs(np.linalg.norm(p, axis=2) - 3.5).max() < 0.05
    assert area == pytest.approx(4 * np.pi * 3.5**2, rel=0.02) and inside == pytest.approx(4 / 3 * np.pi * 3.5**3, rel=0.03)


def test_vertices_are_shared_by_edge_and_levels_are_apart(spark):
    v = dense(spark, 5 - distances(9))
    vertices, faces = surface.mesh(v, level(spark, 2.0, 3.0))
    got, used = {(r.iso, r.edge): (r.x, r.y, r.z) for r in vertices.collect()}, faces.collect()
    assert len(got) == vertices.count() and {(r.iso, e) for r in used for e in (r.e0, r.e1, r.e2)} == set(got)
    for iso in (2.0, 3.0):
        assert topology([(r.e0, r.e1, r.e2) for r in used if r.iso == iso])[0] == 2


def test_open_and_empty_surfaces(spark):
    data = np.arange(27.0).reshape(3, 3, 3)
    faces = [(r.e0, r.e1, r.e2) for r in surface.triangles(dense(spark, data), level(spark, 12.5)).collect()]
    _, edges = topology(faces)
    assert faces and any((b, a) not in edges for a, b in edges)
    assert surface.triangles(dense(spark, data), level(spark, 99, -1)).count() == 0
    assert surface.triangles(dense(spark, data[:, :, :1]), level(spark, 12)).count() == 0


@pytest.mark.parametrize("edge", [1, 3, 4, 16])
def test_bricks_hold_the_same_voxels(spark, edge):
    rng = np.random.default_rng(edge)
    v = dense(spark, rng.integers(0, 9, (7, 5, 9)))
    v = v.with_voxels(v.voxels.where("val > 1"))
    bricks = volume.to_bricks(v, edge)
    assert sorted(map(tuple, volume.from_bricks(bricks).collect())) == sorted(map(tuple, v.voxels.collect()))
    b = volume.Volume(volume.from_bricks(bricks), v.grid, v.meta, bricks)
    for ranges in ({1: (2, 2)}, {0: (3, 9), 2: (0, 1)}, {1: (4, 3)}, {}):
        assert sorted(map(tuple, b.within(ranges).collect())) == sorted(map(tuple, v.within(ranges).collect()))
    for view, plain in (("HK", slicing.native_slice(v, 0.0)[0]), ("HL", slicing.oblique_slab(v, "HL", 0.4)[0]), ("KL", slicing.oblique_slab(v, "KL", 0.4)[0])):
        got = slicing.native_slice(b, 0.0)[0] if view == "HK" else slicing.oblique_slab(b, view, 0.4)[0]
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def groups_met(path, dim, index):
    """Row groups of a stored volume, and those whose ranges meet one index of a dimension."""
    met = total = 0
    for f in glob.glob(f"{path}/brick/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        at = {meta.schema.column(i).name: i for i in range(len(meta.schema.names))}
        for g in range(meta.num_row_groups):
            low, high = (meta.row_group(g).column(at[f"{'hkl'[dim]}{e}"]).statistics for e in (0, 1))
            total += 1
            met += low.min <= index <= high.max
    return met, total


def test_slices_of_all_planes_read_their_part(spark, tmp_path):
    """With twice the edge a volume has eight times the row groups, a slice four times."""
    seen = {}
    for n in (32, 64):
        at = spark.range(n**3).select(F.lit(0).cast("long").alias("vol"), *[(F.floor(F.col("id") / n**k) % n).cast("int").alias(d) for k, d in zip((2, 1, 0), volume.DIMS, strict=True)], F.xxhash64("id").alias("val"))
        v = volume.Volume(at, volume.Grid((volume.affine(n, 1.0, 0.0),) * 3), {"s": 1.0})
        path = str(tmp_path / str(n))
        store.save_bricks(v, path, edge=2, group_bytes=1 << 12)
        got = store.load(spark, path)
        assert got.grid == v.grid and got.meta == v.meta and got.bricks is not None
        for dim in range(3):
            seen[n, dim] = groups_met(path, dim, n // 2 + 1)
            rows = got.within({dim: (n // 2 + 1,) * 2})
            assert rows.count() == n * n
            plan = rows._jdf.queryExecution().executedPlan().toString()
            assert f"{'hkl'[dim]}0" in plan.split("PushedFilters")[1] and f"{'hkl'[dim]}1" in plan.split("PushedFilters")[1]
        assert sorted(map(tuple, got.within({1: (3, 3)}).collect())) == sorted(map(tuple, v.within({1: (3, 3)}).collect()))
    for dim in range(3):
        (small, all_small), (large, all_large) = seen[32, dim], seen[64, dim]
        assert all_large > 5 * all_small and large < 6 * small and large < all_large / 3
