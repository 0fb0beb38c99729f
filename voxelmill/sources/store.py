"""Volumes in Parquet."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from voxelmill.operators import volume as _volume


def save(volume: _volume.Volume, path: str) -> None:
    """Voxels partitioned by volume and sorted by layer, so that a slice reads few row groups; axes and metadata beside them."""
    v = volume.voxels
    v.repartition("vol", "il").sortWithinPartitions("vol", "il", "ih", "ik").write.mode("overwrite").option("compression", "zstd").partitionBy("vol").parquet(f"{path}/voxel")
    _beside(volume, path)


def save_bricks(volume: _volume.Volume, path: str, edge: int = _volume.EDGE, group_bytes: int = 1 << 20) -> None:
    """Voxels as arrays of boxes, by a curve that keeps boxes near in space in one file and row group; axes and metadata beside them.

    Each row group holds the ranges of its bricks on all three axes, so that
    HK, HL and KL slices all read the part that they meet.
    """
    b = _volume.to_bricks(volume, edge)
    b = b.repartitionByRange("vol", "z").sortWithinPartitions("vol", "z")
    b.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", group_bytes).option("parquet.page.size", max(1024, group_bytes // 8)).parquet(f"{path}/brick")
    _beside(volume, path)


def _beside(volume: _volume.Volume, path: str) -> None:
    _volume.axis_table(volume).coalesce(1).write.mode("overwrite").parquet(f"{path}/axis")
    counts = {k: v for o in volume.observed for k, v in o.get.items()}
    meta = json.dumps(volume.meta | counts | {"plane": volume.grid.plane}, sort_keys=True)
    volume.voxels.sparkSession.createDataFrame([(meta,)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load(spark: SparkSession, path: str) -> _volume.Volume:
    """What ``save`` or ``save_bricks`` wrote, metadata in full."""
    axes: dict[int, list[float]] = {0: [], 1: [], 2: []}
    for dim, _, coord in spark.read.parquet(f"{path}/axis").orderBy("dim", "idx").toLocalIterator():
        axes[dim].append(coord)
    meta = json.loads(spark.read.parquet(f"{path}/meta").first()[0])
    grid = _volume.Grid(tuple(tuple(axes[d]) for d in range(3)), meta.pop("plane"))
    try:
        bricks = spark.read.parquet(f"{path}/brick")
        return _volume.Volume(_volume.from_bricks(bricks), grid, meta, bricks)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    voxels = spark.read.parquet(f"{path}/voxel").select("vol", *_volume.DIMS, *[c for c in spark.read.parquet(f"{path}/voxel").columns if c not in ("vol", *_volume.DIMS)])
    return _volume.Volume(voxels, grid, meta)
