"""Parameter files and layer lists as text tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.functions.geometry import cell_from_ub

NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"
CELL = ("a", "b", "c", "alpha", "beta", "gamma")
#: Layers that a layer list holds at most.
LAYERS_PER_FILE = 500


def _after(key: str, n: int) -> Column:
    """The n fields after the field ``key`` of a line as doubles, null unless all are there and numbers."""
    f = F.filter(F.split(F.trim("line"), r"\s+"), lambda x: x != "")
    got = F.slice(f, F.array_position(f, key).cast("int") + 1, n)
    ok = (F.array_position(f, key) > 0) & (F.size(got) == n) & F.forall(got, lambda x: x.rlike(NUMBER))
    return F.when(ok, F.transform(got, lambda x: x.try_cast("double")))


def parse_cells(lines: DataFrame) -> DataFrame:
    """``lines(file, line_no, line)`` to a unit cell per file.

    The first usable CELL line (six numbers, esds in brackets dropped, a over 1)
    wins; else the cell comes from the last orientation matrix and the last
    wavelength; else it is null.  Lines that start with ? are comments.
    """
    rows = lines.where(~F.trim("line").startswith("?"))
    plain = rows.withColumn("line", F.regexp_replace("line", r"\([^)]*\)", ""))
    cell = F.when(F.col("line").contains("CELL ") & ~F.col("line").contains("NUMOFCELL") & ~F.col("line").contains("INFORMATION"), _after("CELL", 6))
    cells = plain.select("file", "line_no", cell.alias("cell")).where("cell is not null and cell[0] > 1").groupBy("file").agg(F.min_by("cell", "line_no").alias("cell"))
    ub = F.when(F.col("line").contains("CRYSTALLOGRAPHY UB "), _after("UB", 9))
    wl = F.when(F.col("line").contains("CRYSTALLOGRAPHY WAVELENGTH"), _after("WAVELENGTH", 1))
    found = rows.select("file", "line_no", ub.alias("ub"), wl.alias("wl"))
    ubs = found.groupBy("file").agg(F.max_by("ub", F.when(F.col("ub").isNotNull(), F.col("line_no"))).alias("ub"), F.max_by("wl", F.when(F.col("wl").isNotNull(), F.col("line_no"))).alias("wl"))
    from_ub = cell_from_ub([F.col("ub")[i] for i in range(9)], F.col("wl")[0])
    files = lines.select("file").distinct().join(cells, "file", "left").join(ubs, "file", "left")
    return files.select("file", *[F.coalesce(F.col("cell")[i], from_ub[n]).alias(n) for i, n in enumerate(CELL)])


def find_files(folders: DataFrame, files: DataFrame) -> DataFrame:
    """``folders(folder)`` and ``files(path)`` to the parameter file of each folder: (folder, path), null if there is none.

    The parent is searched first, then the folder, then the parent's parent; in
    each a name ending in _cracker.par comes before other .par files, then the
    smallest path wins.  Hidden files do not count.  A directory's files are cut
    to its best one before the join, so that one directory of many folders stays a row.
    """
    name = F.element_at(F.split("path", "/"), -1)
    place = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    rank = F.struct((~name.endswith("_cracker.par")).alias("plain"), F.col("path"))
    best = files.where(name.endswith(".par") & ~name.startswith(".")).groupBy(place.alias("place")).agg(F.min(rank).alias("best"))
    up = lambda c: F.regexp_replace(c, r"/[^/]*$", "")
    home = F.regexp_replace("folder", r"/+$", "")
    places = F.array(up(home), home, up(up(home)))
    wanted = folders.select("folder").distinct().select("folder", F.posexplode(places).alias("turn", "place"))
    got = wanted.join(best, "place", "left").groupBy("folder").agg(F.min_by("best.path", F.when(F.col("best").isNotNull(), F.col("turn"))).alias("path"))
    return got.select("folder", "path")


def override_cells(cells: DataFrame, parsed: DataFrame) -> DataFrame:
    """Cells from headers, ``(file, a .. gamma)``, replaced as a whole where the parameter file of that name gives one; from_par says which."""
    par = parsed.where("a is not null").select("file", *[F.col(c).alias(f"par_{c}") for c in CELL])
    rows = cells.select("file", *CELL).join(par, "file", "left")
    found = F.col("par_a").isNotNull()
    return rows.select("file", *[F.when(found, F.col(f"par_{c}")).otherwise(F.col(c)).alias(c) for c in CELL], found.alias("from_par"))


def folder_cell(spark: SparkSession, folder: str) -> dict | None:
    """The cell of a folder's parameter file, found as in ``find_files``; None without a file or a cell in it."""
    home = folder.rstrip("/")
    parent = home.rpartition("/")[0]
    for place in (parent, home, parent.rpartition("/")[0]):
        for name in ("*_cracker.par", "*.par"):
            try:
                files = spark.read.format("binaryFile").load(f"{place}/{name}")
            except AnalysisException as e:
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
                continue
            first = files.select(F.min("path").alias("file"))
            text = files.join(F.broadcast(first), files["path"] == first["file"]).select("file", F.decode("content", "ISO-8859-1").alias("text"))
            row = parse_cells(text.select("file", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line"))).first()
            return row and row["a"] is not None and {n: row[n] for n in CELL} or None
    return None


def first_orientation(lines: DataFrame) -> DataFrame:
    """The first orientation matrix of each file; an error for a file without one."""
    ub = F.when(F.trim("line").startswith("CRYSTALLOGRAPHY UB "), _after("UB", 9))
    got = lines.select("file", "line_no", ub.alias("ub")).groupBy("file").agg(F.min_by("ub", F.when(F.col("ub").isNotNull(), F.col("line_no"))).alias("ub"))
    return got.select("file", F.coalesce("ub", F.raise_error(F.concat(F.lit("no orientation matrix in "), "file")).cast("array<double>")).alias("ub"))


def layer_rows(requests: DataFrame) -> DataFrame:
    """``requests(name, l_min, l_max, l_step)`` to one row per layer: (name, file_idx, row_no, l, n_files).

    Values run from l_min to l_max in steps, rounded to six digits; a file holds
    LAYERS_PER_FILE rows, and row numbers start anew in each.
    """
    n = F.ceil((F.col("l_max") + F.col("l_step") * 0.5 - F.col("l_min")) / F.col("l_step"))
    last = F.floor((F.col("n") - 1) / LAYERS_PER_FILE).cast("int")
    files = requests.withColumn("n", n).where("n > 0").select("name", "l_min", "l_step", "n", F.explode(F.sequence(F.lit(0), last)).alias("file_idx"))
    # requests are few and small: dealt over all tasks as files before they become rows
    files = files.repartition(int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions")), "name", "file_idx")
    held = F.least(F.lit(LAYERS_PER_FILE), F.col("n") - F.col("file_idx") * LAYERS_PER_FILE).cast("int")
    rows = files.withColumn("row_no", F.explode(F.sequence(F.lit(1), held)))
    i = F.col("file_idx") * LAYERS_PER_FILE + F.col("row_no") - 1
    return rows.select(
        "name",
        "file_idx",
        "row_no",
        (F.rint((F.col("l_min") + i * F.col("l_step")) * 1e6) / 1e6 + F.lit(0.0)).alias("l"),
        F.ceil(F.col("n") / LAYERS_PER_FILE).cast("int").alias("n_files"),
    )


def layer_lines(rows: DataFrame, resolution: float = 0.8) -> DataFrame:
    """Text of each layer row and the file it belongs to: (file, row_no, line).

    Zeros and ones, which are the same in all lines, are formatted once, here.
    """
    file = F.when(F.col("n_files") == 1, F.format_string("%s.dcunwarp", "name")).otherwise(F.format_string("%s_%03d.dcunwarp", "name", F.col("file_idx") + 1))
    zero, one = f"{0:10.6f}", f"{1:10.6f}"
    pattern = f'"%d"   {zero}   {zero}  %10.6f     {one}   {zero}   {zero}     {zero}   {one}   {zero}        %10.6f       0       0'
    return rows.select(file.alias("file"), "row_no", F.format_string(pattern, "row_no", "l", F.lit(float(resolution))).alias("line"))


def write_layer_lists(rows: DataFrame, folder: str, resolution: float = 0.8) -> None:
    """One folder per list file, its rows in order, lines ending in CRLF."""
    lines = layer_lines(rows, resolution)
    lines.repartition("file").sortWithinPartitions("file", "row_no").select("file", "line").write.mode("overwrite").partitionBy("file").option("lineSep", "\r\n").text(folder)
