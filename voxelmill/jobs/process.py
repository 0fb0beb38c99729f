"""The batch job: load a folder of frames, bin, reject outliers, symmetrise, save.

    python -m voxelmill.jobs.process FOLDER --laue m-3m --sigma 3 --iter 1 --bin 2 --binl 1
"""

from __future__ import annotations

import argparse
import os
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from voxelmill.functions.laue import GENERATORS, slug
from voxelmill.operators import symmetry, volume


def process(v: volume.Volume, laue: str | None, sigma: float | None = 3.0, n_iter: int = 1, bin_xy: int = 1, bin_z: int = 1, full: bool = False) -> volume.Volume:
    """One lazy plan: bin, reject (no sigma: skip), symmetrise (no group: skip).

    How many voxels were replaced is counted as the plan runs; a saved volume
    has it in its metadata as n_outliers_replaced.
    """
    v = volume.bin_volume(v, bin_xy, bin_xy, bin_z)
    if laue and sigma:
        v = symmetry.reject_outliers(v, laue, sigma, n_iter, full=full)
        seen = Observation()
        counted = v.voxels.observe(seen, F.coalesce(F.sum("replaced"), F.lit(0)).alias("n_outliers_replaced"))
        v = replace(v.with_voxels(counted.drop("replaced")), observed=(*v.observed, seen))
    return symmetry.symmetrize(v, laue, full=full) if laue else v


def output_names(base: str, laue: str) -> tuple[str, str]:
    return f"{base}_raw", f"{base}_sym_{slug(laue)}"


def load_folder(spark: SparkSession, folder: str, bin_xy: int = 1, bin_z: int = 1) -> volume.Volume:
    """Frames of a folder with axes from their headers: layers at their fixed values, pixels by the first frame.

    Frames are binned while they are decoded.  The cell comes from the folder's
    parameter file, else from the first header.
    """
    from voxelmill.functions import geometry as G
    from voxelmill.sources import frames, parameters
    from voxelmill.sources.scratch import cut

    ub = [F.col("ub")[i] for i in range(9)]
    heads = cut(frames.scan_order(frames.read_headers(spark, folder)))
    inv = {p: G.plane_inverse(ub, F.col("wavelength"), p) for p in G.PLANES}
    pick = lambda n: F.when(F.col("plane") == "HL", inv["HL"][n]).when(F.col("plane") == "KL", inv["KL"][n]).otherwise(inv["HK"][n]).alias(n)
    cell = F.struct(*[c.alias(n) for n, c in G.cell_from_ub(ub, F.col("wavelength")).items()]).alias("cell")
    # one small row a frame
    rows = heads.select("layer_idx", "fixed_value", "plane", "nx", "ny", "d_min", "wavelength", "ub", pick("i00"), pick("i01"), pick("i11"), G.pixel_scale(F.col("d_min"), F.col("nx")).alias("s"), cell).orderBy("layer_idx").collect()
    if not rows:
        raise ValueError(f"no numbered frames in {folder}")
    m = rows[0]
    cx, cy = (m.nx + 1) // 2 + 0.5, (m.ny + 1) // 2 + 0.5
    full = volume.affine(m.nx, m.i00 * m.s, m.i00 * (1 - cx) * m.s), volume.affine(m.ny, m.i11 * m.s, m.i11 * (1 - cy) * m.s)
    axes = (*[volume.bin_axis(a, bin_xy) if bin_xy > 1 else a for a in full], tuple(r.fixed_value for r in rows))
    found = parameters.folder_cell(spark, folder) or m.cell.asDict()
    meta = {"s": m.s, "cx": cx, "cy": cy, "m_inv": [[m.i00, m.i01], [0.0, m.i11]], "wavelength": m.wavelength, "d_min": m.d_min, "ub": list(m.ub), "cell": found, "source_folder": folder, "n_files": len(rows), "bin_xy": bin_xy, "bin_z": 1}
    if bin_xy > 1:
        meta |= {"s": m.s * bin_xy, "cx": (len(axes[0]) + 1) / 2, "cy": (len(axes[1]) + 1) / 2}
    v = volume.Volume(frames.load_voxels(spark, folder, bin_xy=bin_xy, scanned=heads), volume.Grid(axes, m.plane), meta)
    return volume.bin_volume(v, 1, 1, bin_z)


def read_any(spark: SparkSession, path: str) -> volume.Volume | DataFrame:
    """A path by what it is: .img to a layer, .cbf to a frame by its pixels, a folder with a saved volume to that volume, any other folder to its frames."""
    from voxelmill.sources import frames, store

    if path.lower().endswith(".img"):
        return frames.read_layers(spark, path)
    if path.lower().endswith(".cbf"):
        return frames.read_cbf(spark, path)
    try:
        return store.load(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    return load_folder(spark, path)


def main(argv: list[str] | None = None) -> None:
    from voxelmill.sources import store

    p = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    p.add_argument("folder")
    p.add_argument("--out", help="where to write (default: the folder)")
    p.add_argument("--laue", default="m-3m", choices=list(GENERATORS))
    p.add_argument("--sigma", type=float, default=3.0)
    p.add_argument("--iter", type=int, default=1)
    p.add_argument("--bin", type=int, default=1)
    p.add_argument("--binl", type=int, default=1)
    p.add_argument("--full", action="store_true", help="all operations of trigonal and hexagonal groups")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("voxelmill").getOrCreate()
    v = load_folder(spark, a.folder, a.bin, a.binl)
    base = os.path.join(a.out or a.folder, os.path.basename(os.path.normpath(a.folder)))
    raw, sym = output_names(base, a.laue)
    store.save(v, raw)
    store.save(process(store.load(spark, raw), a.laue, a.sigma, a.iter, full=a.full), sym)


if __name__ == "__main__":
    main()
