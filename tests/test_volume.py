import itertools
import struct

import numpy as np
import pytest

from voxelmill.functions import laue
from voxelmill.operators import slicing, symmetry, volume
from voxelmill.sources import frames, parameters, store

GRID = volume.Grid((volume.affine(4, 1.0, -1.5),) * 3)


def build(spark, data, grid=GRID):
    rows = [(0, *map(int, at), float(v)) for at, v in np.ndenumerate(data)]
    return volume.Volume(spark.createDataFrame([(r[0], *r[1:]) for r in rows], "vol long, ih int, ik int, il int, val double"), grid)


def array(v, shape=(4, 4, 4)):
    out = np.zeros(shape)
    for r in v.voxels.collect():
        out[r.ih, r.ik, r.il] = r.val
    return out


@pytest.mark.parametrize("group", list(laue.GENERATORS))
def test_groups_are_closed_and_of_the_right_order(group):
    ops = set(laue.operations(group))
    assert len(ops) == laue.ORDERS[group]
    assert all(laue.times(a, b) in ops for a, b in itertools.product(ops, ops))
    want = {"-3": 2, "-3m": 4, "6/m": 4, "6/mmm": 8}.get(group, laue.ORDERS[group])
    assert len(laue.usable(group)) == want


def test_unknown_group():
    with pytest.raises(ValueError, match="m-3m"):
        laue.operations("x")


@pytest.mark.parametrize("group", ["-1", "2/m", "m-3", "m-3m"])
def test_symmetrize_both_ways_and_by_brute_force(spark, group):
    rng = np.random.default_rng(1)
    data = np.where(rng.random((4, 4, 4)) < 0.2, 0, rng.normal(size=(4, 4, 4)))
    total, n = np.zeros_like(data), np.zeros_like(data)
    for op in laue.usable(group):
        for t in itertools.product(range(4), repeat=3):
            at = [0, 0, 0]
            for dim, (s, sign) in enumerate(op):
                at[s] = t[dim] if sign > 0 else 3 - t[dim]
            if data[tuple(at)]:
                total[t] += data[tuple(at)]
                n[t] += 1
    want = np.divide(total, n, out=np.zeros_like(total), where=n > 0)
    v = build(spark, data)
    once = symmetry.symmetrize(v, group, "orbit")
    assert np.allclose(array(once), want)
    assert np.allclose(array(symmetry.symmetrize(v, group, "gather")), want)
    assert np.allclose(array(symmetry.symmetrize(once, group)), want)


def test_reject_finds_a_hot_voxel_and_leaves_the_rest(spark):
    data = np.ones((4, 4, 4)) + np.random.default_rng(2).normal(scale=0.01, size=(4, 4, 4))
    data[0, 1, 2] = 99
    for strategy in ("orbit", "gather"):
        got = symmetry.reject_outliers(build(spark, data), "m-3m", 8.0, 1, strategy)
        assert abs(array(got)[0, 1, 2] - 1) < 0.1
        assert got.voxels.agg({"replaced": "sum"}).first()[0] == 1
    far = symmetry.reject_outliers(build(spark, data), "m-3m", 1e9)
    assert np.allclose(array(far), data)


@pytest.mark.parametrize("strategy", ["orbit", "gather"])
def test_voxels_mended_to_zero_are_neither_equivalents_nor_mended_again(spark, strategy):
    """Round one sends -1000 and -900 to their median 0; the median of round two is 10.5, without them."""
    grid = volume.Grid((volume.affine(2, 1.0, -0.5),) * 3)
    v = build(spark, np.array([-1000, -900, -10, 10, 11, 12, 0, 0], float).reshape(2, 2, 2), grid)
    for rounds, values, replaced in ((1, [0, 0, -10, 10, 11, 12, 0, 0], [1, 1, 0, 0, 0, 0, 0, 0]), (2, [0, 0, 10.5, 10, 11, 12, 0, 0], [1, 1, 1, 0, 0, 0, 0, 0]), (3, [0, 0, 10.5, 10, 11, 12, 0, 0], [1, 1, 1, 0, 0, 0, 0, 0])):
        rows = symmetry.reject_outliers(v, "mmm", 3.0, rounds, strategy).voxels.orderBy(*volume.DIMS).collect()
        assert [r.val for r in rows] == values and [r.replaced for r in rows] == replaced


def test_bins_floor_negative_means_and_drop_the_rest(spark):
    df = spark.createDataFrame([(0, i, 0, 0, v) for i, v in enumerate([-3, -4, 5, 6, 9])], "vol long, ih int, ik int, il int, val long")
    v = volume.Volume(df, volume.Grid((volume.affine(5, 1.0, 0.0), (0.0,), (0.0,))), {"s": 1.0})
    got = volume.bin_volume(v, 2, 1, 1)
    assert sorted((r.ih, r.val) for r in got.voxels.collect()) == [(0, -4), (1, 5)]
    assert got.grid.axes[0] == (0.5, 2.5) and got.meta["s"] == 2.0
    assert volume.bin_volume(v, 1, 1, 1) is v


def test_bilinear_is_exact_on_planes_and_zero_outside(spark):
    vals = spark.createDataFrame([(0, x, y, 2.0 * x - y) for x in range(5) for y in range(4)], "vol long, ix int, iy int, val double")
    pts = spark.createDataFrame([(0, 0, 1.25, 2.5), (0, 1, 4.0, 3.0), (0, 2, 4.01, 1.0), (0, 3, -0.1, 0.0)], "vol long, pid int, fx double, fy double")
    got = {r.pid: r.val for r in slicing.bilinear(vals, pts, (5, 4)).collect()}
    assert got == pytest.approx({0: 0.0, 1: 5.0, 2: 0.0, 3: 0.0})


def test_nearest_takes_the_lower_on_a_tie():
    assert GRID.nearest(0, 0.0) == 1
    assert GRID.window(0, 9.0, 0.5) == [3]


def test_volumes_survive_a_round_trip(spark, tmp_path):
    v = build(spark, np.arange(64.0).reshape(4, 4, 4)).with_voxels(build(spark, np.arange(64.0).reshape(4, 4, 4)).voxels, laue_group="mmm")
    store.save(v, str(tmp_path / "v"))
    got = store.load(spark, str(tmp_path / "v"))
    assert got.grid == v.grid and got.meta == v.meta and np.allclose(array(got), array(v))


def frame(path, l, pixels, nx=3, ny=2):
    head = bytearray(frames.HEADER_BYTES)
    for name, value in {"nx": nx, "ny": ny, "fixed_l": l, "x_h": 1.0, "y_k": 1.0, "d_min": 0.8, "wavelength": 0.7}.items():
        at, kind = frames.OFFSETS[name]
        struct.pack_into(kind, head, at, value)
    struct.pack_into("<9d", head, frames.UB_OFFSET, 0.1, 0, 0, 0, 0.1, 0, 0, 0, 0.1)
    path.write_bytes(bytes(head) + np.asarray(pixels, "<i4").tobytes())


def test_frames_round_trip(spark, tmp_path):
    frame(tmp_path / "a_1.img", 0.5, range(6))
    frame(tmp_path / "a_2.IMG", -0.5, range(10, 16))
    (tmp_path / "b_7.img").write_bytes((tmp_path / "a_1.img").read_bytes())
    (tmp_path / "note.img").write_bytes(b"x")
    from voxelmill.jobs.process import load_folder

    v = load_folder(spark, str(tmp_path))
    got = {(r.ih, r.ik, r.il): r.val for r in v.voxels.collect()}
    assert got[2, 1, 0] == 15 and got[0, 1, 1] == 3 and len(got) == 12
    assert v.grid.axes[2] == (-0.5, 0.5) and v.meta["n_files"] == 2


def test_binning_while_loading_and_cell_of_the_parameter_file(spark, tmp_path):
    from voxelmill.jobs.process import load_folder, read_any

    folder = tmp_path / "exp" / "unwarp"
    folder.mkdir(parents=True)
    rng = np.random.default_rng(3)
    for i in range(4):
        frame(folder / f"a_{i}.img", i / 2, rng.integers(-9, 99, 35), nx=7, ny=5)
    plain = load_folder(spark, str(folder))
    assert plain.meta["cell"]["a"] == pytest.approx(7) and plain.meta["cell"]["gamma"] == pytest.approx(90)
    (tmp_path / "exp" / "a.par").write_text("CELL 5 6 7 90 91 92\n")
    (tmp_path / "exp" / "z_cracker.par").write_text("? x\r\nCELL 8.5(2) 6 7 90 91 92\r\n")
    got = load_folder(spark, str(folder) + "/", 2, 2)
    assert got.meta["cell"] == dict(zip(parameters.CELL, (8.5, 6, 7, 90, 91, 92), strict=True))
    want = volume.bin_volume(volume.Volume(volume.bin_frames(plain.voxels, (7, 5), 2, 2), volume.Grid((plain.grid.axes[0][:3], plain.grid.axes[1][:2], plain.grid.axes[2]))), 1, 1, 2)
    assert sorted(map(tuple, got.voxels.collect())) == sorted(map(tuple, want.voxels.collect()))
    assert got.grid.shape == (3, 2, 2) and got.meta["bin_xy"] == 2 and got.meta["bin_z"] == 2 and got.meta["s"] == pytest.approx(2 * plain.meta["s"])
    assert read_any(spark, str(folder)).grid == plain.grid
    one = read_any(spark, str(folder / "a_1.img")).first()
    assert one.plane == "HK" and one.fixed_value == 0.5 and len(one.payload) == 35
    store.save(got, str(tmp_path / "v"))
    assert read_any(spark, str(tmp_path / "v")).meta == got.meta
    over = frames.read_layers(spark, str(folder / "a_*.img"), [0.2, 0, 0, 0, 0.2, 0, 0, 0, 0.2])
    assert over.count() == 4 and over.first().i00 == pytest.approx(one.i00 / 2)


def test_saved_volumes_tell_how_many_voxels_were_replaced(spark, tmp_path):
    from voxelmill.jobs.process import process

    rng = np.random.default_rng(8)
    data = 100 + rng.normal(size=(4, 4, 4))
    data[0, 1, 2] = data[3, 3, 1] = 9000
    v = build(spark, data)
    want = sum(r.replaced for r in symmetry.reject_outliers(v, "mmm", 5.0, 2).voxels.collect())
    store.save(process(v, "mmm", 5.0, 2), str(tmp_path / "v"))
    assert want >= 2 and store.load(spark, str(tmp_path / "v")).meta["n_outliers_replaced"] == want
    store.save_bricks(process(v, "mmm", 5.0, 2), str(tmp_path / "b"))
    assert store.load(spark, str(tmp_path / "b")).meta["n_outliers_replaced"] == want
    store.save(process(v, "mmm", None), str(tmp_path / "w"))
    assert "n_outliers_replaced" not in store.load(spark, str(tmp_path / "w")).meta


HEXAGONAL = volume.Grid((volume.affine(5, 1.0, -2.0), volume.affine(5, 1.0, -2.0), volume.affine(4, 1.0, -1.5)))


@pytest.mark.parametrize("group", ["-3", "-3m", "6/m", "6/mmm"])
@pytest.mark.parametrize("plane", ["HK", "HL"])
def test_all_operations_of_trigonal_and_hexagonal_groups(spark, group, plane):
    """Orbits and gathering agree with brute force where axes are commensurate; between points gathering takes the nearest, ties to even."""
    order = {"HK": (0, 1, 2), "HL": (0, 2, 1)}[plane]
    ops = laue.stored_operations(group, plane, True)
    assert len(ops) == laue.ORDERS[group] > len(laue.stored_operations(group, plane))
    for shift in (0.0, 0.5):
        axes = tuple(HEXAGONAL.axes[d] if d == 2 else tuple(x + shift for x in HEXAGONAL.axes[d]) for d in order)
        grid = volume.Grid(axes, plane)
        shape = grid.shape
        rng = np.random.default_rng(len(ops))
        data = np.where(rng.random(shape) < 0.2, 0, rng.integers(1, 99, shape)).astype(float)
        total, n = np.zeros(shape), np.zeros(shape)
        for op in ops:
            for t in itertools.product(*map(range, shape)):
                x = [axes[d][i] for d, i in enumerate(t)]
                at = tuple(int(np.rint((sum(m * v for m, v in zip(row, x, strict=True)) - axes[d][0]) / 1.0)) for d, row in enumerate(op))
                if all(0 <= i < k for i, k in zip(at, shape, strict=True)) and data[at]:
                    total[t] += data[at]
                    n[t] += 1
        want = np.divide(total, n, out=np.zeros(shape), where=n > 0)
        v = build(spark, data, grid)
        assert symmetry.commensurate(grid, group, True) == (shift == 0.0)
        assert np.allclose(array(symmetry.symmetrize(v, group, "gather", True), shape), want)
        if not shift:
            once = symmetry.symmetrize(v, group, full=True)
            assert np.allclose(array(once, shape), want) and once.meta["all_operations"]
            hot = lambda s: sorted((r.ih, r.ik, r.il, round(r.val, 9), r.replaced) for r in symmetry.reject_outliers(v, group, 1.5, 2, s, True).voxels.collect())
            assert hot("orbit") == hot("gather")


def test_maps_of_two_dimensions_join_alike_by_shuffle(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = build(spark, rng.integers(0, 9, HEXAGONAL.shape), HEXAGONAL)
    want = array(symmetry.symmetrize(v, "6/mmm", full=True), HEXAGONAL.shape)
    monkeypatch.setattr(symmetry, "BROADCAST_MAP", 0)
    assert np.allclose(array(symmetry.symmetrize(v, "6/mmm", "gather", True), HEXAGONAL.shape), want)


def test_plane_matrix_from_the_orientation_matrix():
    cubic = {"ub": [0.1, 0, 0, 0, 0.1, 0, 0, 0, 0.1], "wavelength": 0.7}
    assert np.allclose(slicing.plane_matrix(cubic, "KL"), np.eye(2) * 7)
    assert slicing.plane_matrix(cubic | {"m_inv": [[1, 0], [0, 1]]}, "HK") == [[1, 0], [0, 1]] and slicing.plane_matrix({}, "HK") == [[1.0, 0.0], [0.0, 1.0]]


def test_plane_of_a_volume_stored_otherwise_is_one_layer(spark):
    v = build(spark, np.arange(64.0).reshape(4, 4, 4), volume.Grid(GRID.axes, "HL"))
    image, at = slicing.extract_slice(v, "HK", 0.4, 5.0)
    assert at["n_slices"] == 1 and {(r.row, r.col): r.val for r in image.collect()}[1, 2] == 2 * 16 + 4 + 2
    assert slicing.extract_slice(v, "HL", 0.4, 5.0)[1]["n_slices"] == 4


def test_parameter_lines(spark):
    rows = [("x", 0, "? CELL 1 1 1 1 1 1"), ("x", 1, "CELL 6.0012(3) 7 8 90 90 120"), ("y", 0, "CELLINFORMATION 5"), ("y", 1, "CRYSTALLOGRAPHY UB 0.1 0 0 0 0.1 0 0 0 0.1"), ("y", 2, "CRYSTALLOGRAPHY WAVELENGTH 0.5"), ("z", 0, "CELL 6 x 7 8 9 9")]
    got = {r.file: r for r in parameters.parse_cells(spark.createDataFrame(rows, "file string, line_no int, line string")).collect()}
    assert got["x"].a == 6.0012 and got["x"].gamma == 120
    assert got["y"].a == pytest.approx(5) and got["y"].beta == pytest.approx(90)
    assert got["z"].a is None
