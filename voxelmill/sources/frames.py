"""Frame files: numbered names, headers, plane types and pixels."""

from __future__ import annotations

import glob
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.functions.geometry import centre, pixel_indices, pixel_scale, plane_inverse
from voxelmill.operators.ranking import ranked
from voxelmill.sources.codecs import HEADER_BYTES, cbf_pixels, frame_pixels
from voxelmill.sources.frame_source import HEADER_SCHEMA, OFFSETS, UB_OFFSET, FrameSource, filesystem, frame_row, frame_schema
from voxelmill.sources.scratch import cut

__all__ = ["HEADER_BYTES", "HEADER_SCHEMA", "OFFSETS", "UB_OFFSET"]


def numbered(paths: DataFrame) -> DataFrame:
    """Rows whose file name ends in a number and .img, of the most frequent prefix (ties: the smaller).

    Adds name, prefix and file_no.  The winner is one row, joined by broadcast.
    """
    paths = paths.drop("file_no")
    name = F.element_at(F.split("path", "/"), -1)
    rows = paths.withColumn("name", name).where(F.col("name").rlike(r"(?i)_\d+\.img$"))
    rows = rows.withColumn("prefix", F.regexp_extract("name", r"^(.*)_[^_]*$", 1)).withColumn("file_no", F.regexp_extract("name", r"(?i)_(\d+)\.img$", 1).cast("long"))
    best = rows.groupBy("prefix").agg(F.count("*").alias("n")).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("prefix"))).alias("b")).select(F.col("b.prefix").alias("prefix"))
    return rows.join(F.broadcast(best), "prefix", "left_semi")


def plane_type(fallback: str = "scan") -> Column:
    """Plane type from the axis flags of a header row.

    Without matching flags a folder scan says HK; a single layer ("layer") goes
    by its first non-zero fixed index in the order l, k, h.
    """
    on = lambda c: F.abs(F.col(c) - 1) < 0.01
    flagged = F.when(on("x_h") & on("y_k"), "HK").when(on("x_h") & on("y_l"), "HL").when(on("x_k") & on("y_l"), "KL")
    if fallback == "scan":
        return flagged.otherwise("HK")
    big = lambda c: F.abs(F.col(c)) > 1e-10
    return flagged.when(big("fixed_l"), "HK").when(big("fixed_k"), "HL").when(big("fixed_h"), "KL").otherwise("HK")


def fixed_value(plane: Column) -> Column:
    return F.when(plane == "HL", F.col("fixed_k")).when(plane == "KL", F.col("fixed_h")).otherwise(F.col("fixed_l"))


def scan_order(frames: DataFrame) -> DataFrame:
    """Layer index by (fixed value, file number) within a prefix; equal values are all kept."""
    rows = frames.withColumn("plane", plane_type()).withColumn("fixed_value", fixed_value(F.col("plane")))
    return ranked(rows, ["prefix"], ["fixed_value", "file_no", "path"], "layer_idx")


def folder_summary(scanned: DataFrame) -> DataFrame:
    """Count, first and last fixed value by file number, and the mean layer step."""
    g = scanned.groupBy("prefix").agg(
        F.count("*").alias("n_files"), F.min_by("fixed_value", "file_no").alias("first_value"), F.max_by("fixed_value", "file_no").alias("last_value"), F.min("fixed_value").alias("lo"), F.max("fixed_value").alias("hi")
    )
    return g.select("prefix", "n_files", "first_value", "last_value", ((F.col("hi") - F.col("lo")) / F.greatest(F.col("n_files") - 1, F.lit(1))).alias("l_step"))


def read_frames(spark: SparkSession, folder: str, payload: bool = False, bin_xy: int = 1, pattern: str = "*.img", codec: Callable = frame_pixels) -> DataFrame:
    """Rows of ``FrameSource``: with ``payload`` False the first 2,330 bytes of each file are read.

    Spark reads whole files where Python has no file system for the folder.
    """
    try:
        filesystem(folder)
    except ValueError:
        return _whole_frames(spark, folder, payload, bin_xy, pattern, codec)
    spark.dataSource.register(type("Frames", (FrameSource,), {"codec": staticmethod(codec)}))
    filters = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("frames").options(payload=str(payload).lower(), bin=bin_xy, pattern=pattern, filters=filters).load(folder)


def _whole_frames(spark: SparkSession, folder: str, payload: bool, bin_xy: int, pattern: str, codec: Callable) -> DataFrame:
    any_case = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in pattern)
    return frame_rows(spark.read.format("binaryFile").option("pathGlobFilter", any_case).load(folder).select("path", "content"), payload, bin_xy, codec)


#: Rows and pixels that a task gathers before it hands them on; one frame may have more pixels.
HELD_ROWS, HELD = 256, 1 << 20


def bounded(rows: Iterable[dict], schema) -> Iterator:
    """Rows as record batches of at most HELD_ROWS rows, each closed once it has HELD pixels."""
    import pyarrow as pa

    held, pixels = [], 0
    for row in rows:
        held.append(row)
        pixels += len(row.get("payload", ()))
        if len(held) == HELD_ROWS or pixels >= HELD:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, pixels = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def frame_rows(files: DataFrame, payload: bool = True, bin_xy: int = 1, codec: Callable = frame_pixels) -> DataFrame:
    """``files(path, content)`` of frames as rows of ``FrameSource``.

    Contents are taken out of a batch one by one, and rows handed on before
    they hold HELD pixels, so that a task keeps no copy of a whole batch.
    """

    def run(batches):
        for b in batches:
            rows = (frame_row(p.as_py(), c.as_py(), payload, bin_xy, codec) for p, c in zip(b.column(0), b.column(1), strict=True))
            yield from bounded(rows, frame_schema(payload))

    return files.mapInArrow(run, FrameSource({"payload": str(payload)}).schema())


def read_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Headers of the frames of a folder's most frequent prefix, written; only the header's bytes are read.

    ValueError where one of these files is too short for a header.
    """
    heads = cut(numbered(read_frames(spark, folder)))
    bad = heads.where("nx is null").agg(F.min("path")).first()[0]
    if bad:
        raise ValueError(f"{bad} is too short for a header")
    return heads


def layer_geometry(headers: DataFrame, override: Column | None = None) -> DataFrame:
    """Header rows with what a single layer needs: plane, fixed_value, thickness_min, thickness_max, i00, i01, i11, s, cx, cy, step1, step2.

    ``override`` (array of nine, null: none) stands for the header's orientation matrix.
    """
    rows = headers.withColumn("ub", F.coalesce(override, F.col("ub")) if override is not None else F.col("ub")).withColumn("plane", plane_type("layer"))
    ub = [F.col("ub")[i] for i in range(9)]

    def by_plane(pick: Callable[[str], Column]) -> Column:
        return F.when(F.col("plane") == "HL", pick("HL")).when(F.col("plane") == "KL", pick("KL")).otherwise(pick("HK"))

    fixed = {"HK": "l", "HL": "k", "KL": "h"}
    inverse = {p: plane_inverse(ub, F.col("wavelength"), p) for p in fixed}
    rows = rows.withColumns({n: by_plane(lambda p, n=n: inverse[p][n]) for n in ("i00", "i01", "i11")})
    ends = {f"thickness_{e}": by_plane(lambda p, e=e: F.col(f"{e}_{fixed[p]}")) for e in ("min", "max")}
    rows = rows.withColumns({"fixed_value": fixed_value(F.col("plane")), **ends, "s": pixel_scale(F.col("d_min"), F.col("nx")), "cx": centre(F.col("nx")), "cy": centre(F.col("ny"))})
    return rows.withColumns({"step1": F.col("s") * F.col("i00"), "step2": F.col("s") * F.abs("i11")})


def layer_pixels(layers: DataFrame, *keep: str) -> DataFrame:
    """Layers with their ``payload`` to pixels with Miller indices: (path, row, col, idx1, idx2, val), and the columns ``keep`` of their layer.

    What is kept goes with the pixels, so that no table of layers is joined to them.
    """
    layers = layers.select("path", "nx", "i00", "i01", "i11", "s", "cx", "cy", "payload", *keep)
    at = layers.select("*", F.posexplode("payload").alias("pos", "val"))
    at = at.withColumn("row", F.floor(F.col("pos") / F.col("nx")).cast("int")).withColumn("col", (F.col("pos") % F.col("nx")).cast("int"))
    inv = {"i00": F.col("i00"), "i01": F.col("i01"), "i10": F.lit(0.0), "i11": F.col("i11")}
    one, two = pixel_indices(inv, F.col("s"), F.col("col") + 1 - F.col("cx"), F.col("row") + 1 - F.col("cy"))
    return at.select("path", "row", "col", one.alias("idx1"), two.alias("idx2"), "val", *keep)


def read_layers(spark: SparkSession, path: str, ub: list[float] | None = None, codec: Callable = frame_pixels) -> DataFrame:
    """Layers (a file or a glob in a folder) with geometry and pixels in ``payload``, by the given orientation matrix if there is one."""
    folder, _, pattern = path.rpartition("/")
    return layer_geometry(read_frames(spark, folder or ".", True, pattern=pattern, codec=codec), F.array(*map(F.lit, ub)) if ub else None)


def load_voxels(spark: SparkSession, folder: str, codec: Callable = frame_pixels, vol: int = 0, bin_xy: int = 1, scanned: DataFrame | None = None) -> DataFrame:
    """A folder's pixels as voxels: layers by fixed value, ih along a frame's rows, ik across them.

    Each frame is opened once for its pixels, which are binned where they are
    decoded, so that full resolution never becomes rows.  ``scanned``: the
    frames in scan order, if headers were read before; there is one row a layer
    of the grid, which the driver holds as an axis, so they are broadcast.
    Raises ValueError for a folder without frames.  Frames of another size than
    their header says fail.
    """
    scanned = scan_order(read_headers(spark, folder)) if scanned is None else scanned
    first = scanned.select("prefix").first()
    if first is None:
        raise ValueError(f"no numbered frames in {folder}")
    frames = read_frames(spark, folder, True, bin_xy, glob.escape(first.prefix) + "_*.img", codec)
    frames = frames.select("path", "nx", "payload").join(F.broadcast(scanned.select("path", "layer_idx")), "path")
    width = F.floor(F.col("nx") / bin_xy)
    pixels = frames.select("layer_idx", width.alias("nx"), F.posexplode("payload").alias("pos", "val"))
    return pixels.select(F.lit(vol).cast("long").alias("vol"), (F.col("pos") % F.col("nx")).cast("int").alias("ih"), F.floor(F.col("pos") / F.col("nx")).cast("int").alias("ik"), F.col("layer_idx").alias("il"), "val")


def read_cbf(spark: SparkSession, path: str) -> DataFrame:
    """CBF frames (a file or a glob) as ``(path, nx, ny, payload)``, pixels as doubles; ValueError for a damaged file."""
    return cbf_frames(spark.read.format("binaryFile").load(path).select("path", "content"))


def cbf_frames(files: DataFrame) -> DataFrame:
    """``files(path, content)`` of CBF frames as ``(path, nx, ny, payload)``."""

    def row(path, content):
        x = cbf_pixels(content)
        return {"path": path, "nx": x.shape[1], "ny": x.shape[0], "payload": x.ravel().astype(float)}

    def run(batches):
        import pyarrow as pa

        kinds = pa.schema([("path", pa.string()), ("nx", pa.int32()), ("ny", pa.int32()), ("payload", pa.list_(pa.float64()))])
        for b in batches:
            yield from bounded((row(p.as_py(), c.as_py()) for p, c in zip(b.column(0), b.column(1), strict=True)), kinds)

    return files.mapInArrow(run, "path string, nx int, ny int, payload array<double>")


def frame_image(frames: DataFrame) -> DataFrame:
    """Frames with nx and ``payload`` to pixels by their own axes: (path, row, col, val)."""
    at = frames.select("path", "nx", F.posexplode("payload").alias("pos", "val"))
    return at.select("path", F.floor(F.col("pos") / F.col("nx")).cast("int").alias("row"), (F.col("pos") % F.col("nx")).cast("int").alias("col"), "val")
