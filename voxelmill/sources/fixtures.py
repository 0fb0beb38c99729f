"""Volumes, frames, cells and parameter lines derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.operators.volume import Grid, Volume, affine, densify

EMB_GRID = Grid((affine(8, 2.0, -7.0),) * 3)
LI_GRID = Grid((affine(50, 0.5, -12.25), affine(11, 1.0, -5.0), affine(9, 1.0, -4.0)))

#: Points at whole indices, so that threefold and sixfold images of points are points; l is at half ones.
HEX_GRID = Grid((affine(8, 1.0, -3.0), affine(8, 1.0, -3.0), affine(8, 1.0, -3.5)))
WIDE_GRID = Grid((affine(50, 1.0, -24.0), affine(50, 1.0, -24.0), affine(11, 1.0, -5.0)))


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_voxels(spark: SparkSession, sf_dir: str, hot: bool = False, floats: bool = False) -> Volume:
    """Each embedding is an 8x8 layer, eight make a volume; some voxels unmeasured, with ``hot`` some far too bright."""
    e = _read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    x = F.col("x").cast("double") if floats else F.rint(F.col("x").cast("double") * 1e6).cast("bigint")
    val = F.when((F.col("vec_id") * 7 + F.col("pos")) % 11 == 0, F.lit(0).cast("double" if floats else "bigint")).otherwise(x)
    if hot:
        val = F.when((F.col("vec_id") * 13 + F.col("pos") * 5) % 97 == 0, val * 50).otherwise(val)
    at = (F.floor(F.col("vec_id") / 8).cast("bigint").alias("vol"), F.floor(F.col("pos") / 8).cast("int").alias("ih"), (F.col("pos") % 8).cast("int").alias("ik"), (F.col("vec_id") % 8).cast("int").alias("il"))
    return Volume(e.select(*at, val.alias("val")), EMB_GRID, {"bin_xy": 1, "bin_z": 1, "s": 2.0, "m_inv": [[1.0, 0.25], [0.0, 1.0]]})


def dense_hot(spark: SparkSession, sf_dir: str) -> Volume:
    return densify(embedding_voxels(spark, sf_dir, hot=True))


def lineitem_voxels(spark: SparkSession, sf_dir: str) -> Volume:
    """Order lines counted by quantity, discount and tax: a volume with unequal axes."""
    at = ((F.col("l_quantity").cast("int") - 1).alias("ih"), F.rint(F.col("l_discount") * 100).cast("int").alias("ik"), F.rint(F.col("l_tax") * 100).cast("int").alias("il"))
    return Volume(_read(spark, sf_dir, "lineitem").groupBy(F.lit(0).cast("bigint").alias("vol"), *at).agg(F.count("*").alias("val")), LI_GRID)


def hexagonal_voxels(spark: SparkSession, sf_dir: str) -> Volume:
    """The embedding volumes on the points of a hexagonal lattice."""
    v = embedding_voxels(spark, sf_dir, hot=True)
    return Volume(v.voxels, HEX_GRID, v.meta)


def wide_voxels(spark: SparkSession, sf_dir: str) -> Volume:
    """Order lines counted by quantity, part and discount: 50 x 50 x 11 points of a hexagonal lattice."""
    at = ((F.col("l_quantity").cast("int") - 1).alias("ih"), (F.col("l_partkey") % 50).cast("int").alias("ik"), F.rint(F.col("l_discount") * 100).cast("int").alias("il"))
    return Volume(_read(spark, sf_dir, "lineitem").groupBy(F.lit(0).cast("bigint").alias("vol"), *at).agg(F.count("*").alias("val")), WIDE_GRID)


def frame_files(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Every embedding as a file of 8 x 8 pixels: (path, content), ``kind`` compressed or cbf."""
    from voxelmill.sources import codecs, frame_source
    from voxelmill.sources.frames import HELD_ROWS

    pixels = F.transform("embedding", lambda x: F.rint(x.cast("double") * 1e6).cast("int"))
    rows = _read(spark, sf_dir, "embeddings").select(F.concat(F.lit("v_"), F.col("vec_id").cast("string"), F.lit(".cbf" if kind == "cbf" else ".img")).alias("path"), pixels.alias("pixels"))

    def content(x):
        import struct

        import numpy as np

        if kind == "cbf":
            return codecs.encode_cbf(np.array(x).reshape(8, 8))
        body, short, long = codecs.encode_differences(x)
        head = bytearray(codecs.HEADER_BYTES)
        text = f"OD SAPPHIRE  4.0\r\nCOMPRESSION=TY1\r\nNX=   8 NY=   8 OI={short:7d} OL={long:7d} \r\n".encode()
        head[: len(text)] = text
        for name, value in (("nx", 8), ("ny", 8)):
            at, kind_ = frame_source.OFFSETS[name]
            struct.pack_into(kind_, head, at, value)
        return bytes(head) + body

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, len(b), HELD_ROWS):
                part = b.slice(at, HELD_ROWS)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(content, part.column(1).to_pylist()), pa.binary())], names=["path", "content"])

    # vectors are small and files some 5,000 bytes more: dealt over all tasks before they are files
    return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path").mapInArrow(run, "path string, content binary")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit cells, wavelengths and orientation matrices (u11..u33) from part keys."""
    k = F.col("p_partkey")
    p = _read(spark, sf_dir, "part").select(
        k.alias("id"), (5 + F.col("p_size") * 0.1).alias("a"), (6 + k % 40 * 0.1).alias("b"), (7 + k % 30 * 0.1).alias("c"), (80 + k % 21).cast("double").alias("alpha"), (85 + k % 25).cast("double").alias("beta"), (75 + k % 31).cast("double").alias("gamma"), (0.7 + k % 10 * 0.05).alias("wl"), (0.6 + k % 5 * 0.1).alias("d_min"), (1670 + k % 12).cast("int").alias("nx"), (1470 + k % 7).cast("int").alias("ny")
    )
    p = p.withColumns({n: f(F.radians(x)) for x, m in (("alpha", "a"), ("beta", "b"), ("gamma", "g")) for n, f in ((f"c{m}", F.cos), (f"s{m}", F.sin))})
    p = p.withColumn("v", F.sqrt(1 - F.col("ca") * F.col("ca") - F.col("cb") * F.col("cb") - F.col("cg") * F.col("cg") + 2 * F.col("ca") * F.col("cb") * F.col("cg")))
    p = p.withColumn("cgr", (F.col("ca") * F.col("cb") - F.col("cg")) / (F.col("sa") * F.col("sb"))).withColumn("cbr", (F.col("ca") * F.col("cg") - F.col("cb")) / (F.col("sa") * F.col("sg")))
    w = F.col("wl")
    ar, br, cr = F.col("sa") / (F.col("a") * F.col("v")), F.col("sb") / (F.col("b") * F.col("v")), F.col("sg") / (F.col("c") * F.col("v"))
    z = F.lit(0.0)
    m = [ar * w, br * F.col("cgr") * w, cr * F.col("cbr") * w, z, br * F.sqrt(1 - F.col("cgr") * F.col("cgr")) * w, -cr * F.sqrt(1 - F.col("cbr") * F.col("cbr")) * F.col("ca") * w, z, z, w / F.col("c")]
    return p.select("id", "a", "b", "c", "alpha", "beta", "gamma", "wl", "d_min", "nx", "ny", *[x.alias(f"u{i // 3 + 1}{i % 3 + 1}") for i, x in enumerate(m)])


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame names and header flags from orders."""
    k = F.col("o_orderkey")
    ext = F.when(k % 7 == 0, ".IMG").otherwise(".img")
    number = F.when(k % 11 == 0, F.lit("x")).otherwise(k.cast("string"))
    on = lambda *r: (k % 4).isin(*r).cast("double")
    return _read(spark, sf_dir, "orders").select(
        F.concat(F.lit("/data/run"), (k % 5).cast("string"), F.lit("_"), number, ext).alias("path"),
        (k % 3 * 0.5).cast("double").alias("fixed_h"), (k % 2 * 0.25).cast("double").alias("fixed_k"), (((k % 601) * 2 - 600) / 100.0).cast("double").alias("fixed_l"),
        on(0, 1).alias("x_h"), on(2).alias("x_k"), on(0).alias("y_k"), on(1, 2).alias("y_l"),
    )


def parameter_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a parameter file for every part."""
    k = F.col("p_partkey")
    p = _read(spark, sf_dir, "part").select(F.concat(F.lit("f"), k.cast("string")).alias("file"), "p_partkey", "p_size")
    ub = F.concat(F.lit("  CRYSTALLOGRAPHY UB 0."), (100 + k % 50).cast("string"), F.lit(" 0 0 0 0.11 0 0 0.01 0.09"))
    wl = F.when(k % 5 == 0, F.lit("CRYSTALLOGRAPHY WAVELENGTH none")).otherwise(F.concat(F.lit("CRYSTALLOGRAPHY WAVELENGTH 0.7"), (k % 10).cast("string")))
    cell = F.concat(F.lit("CELL "), F.col("p_size").cast("string"), F.lit(".25(3) 6.5 7.125(12) 90 9"), (k % 10).cast("string"), F.lit(".5 90"))
    cell = F.when(k % 3 == 0, cell).when(k % 3 == 1, F.lit("CELLINFORMATION CELL 5 5 5 90 90 90")).otherwise(F.lit("? CELL 4 4 4 90 90 90"))
    lines = F.array(F.lit("? comment"), ub, wl, cell)
    return p.select("file", F.posexplode(lines).alias("line_no", "line"))


def layer_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layer lists asked for, from suppliers."""
    k = F.col("s_suppkey")
    return _read(spark, sf_dir, "supplier").select(F.concat(F.lit("list"), k.cast("string")).alias("name"), (-(k % 7)).cast("double").alias("l_min"), (k % 5 + 1).cast("double").alias("l_max"), F.when(k % 2 == 0, 0.02).otherwise(0.025).alias("l_step"))


def run_folders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A folder of frames for every order, some with a slash at the end, and parameter files in or above some of them."""
    k = F.col("o_orderkey")
    top = F.concat(F.lit("/exp/s"), (k % 97).cast("string"))
    runs = _read(spark, sf_dir, "orders").select(k.alias("k"), top.alias("top"), F.concat(top, F.lit("/run"), k.cast("string")).alias("run"))
    folders = runs.select(F.concat("run", F.lit("/unwarp"), F.when(F.col("k") % 2 == 0, "/").otherwise("")).alias("folder"))
    n = F.col("k")
    names = [("run", "/r_cracker.par", n % 4 == 0), ("run", "/a.par", n % 3 == 0), ("run", "/unwarp/b.par", n % 5 == 0), ("run", "/unwarp/x_cracker.par", n % 7 == 0), ("run", "/.h.par", n % 2 == 1), ("run", "/notes.txt", n > 0), ("top", "/g_cracker.par", n % 97 < 30), ("top", "/c.par", n % 97 < 60)]
    paths = F.array_compact(F.array(*[F.when(on, F.concat(at, F.lit(name))) for at, name, on in names]))
    return folders, runs.select(F.explode(paths).alias("path")).distinct()


def single_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header rows of layers of 4 x 3 pixels with their payload; some with another orientation matrix to use."""
    k = F.col("id")
    on = lambda *r: (k % 4).isin(*r).cast("double")
    fixed = {"h": F.lit(1.5), "k": F.when(k % 8 == 3, 0.5).otherwise(0.0), "l": F.lit(0.0)}
    ub = [F.col(f"u{i}{j}") for i in (1, 2, 3) for j in (1, 2, 3)]
    # parts are small rows in few files: dealt over all tasks before the geometry of each
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return cells(spark, sf_dir).repartition(tasks, "id").select(
        F.concat(F.lit("layer"), k.cast("string"), F.lit(".img")).alias("path"), F.lit(4).alias("nx"), F.lit(3).alias("ny"), "d_min", F.col("wl").alias("wavelength"), F.array(*ub).alias("ub"),
        F.when(k % 6 == 0, F.array(*[2 * u for u in ub])).alias("other_ub"), on(0, 1).alias("x_h"), on(2).alias("x_k"), on(0).alias("y_k"), on(1, 2).alias("y_l"),
        *[c.alias(f"fixed_{n}") for n, c in fixed.items()], *[(c - 0.25).alias(f"min_{n}") for n, c in fixed.items()], *[(c + 0.25).alias(f"max_{n}") for n, c in fixed.items()],
        F.transform(F.sequence(F.lit(0), F.lit(11)), lambda p: ((k + p) % 17).cast("int")).alias("payload"),
    )
