"""Registered queries over the driver's tables, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.functions import geometry as G
from voxelmill.functions.laue import GENERATORS, operations, slug, stored_operations, usable
from voxelmill.operators import display, matching, slicing, surface, symmetry
from voxelmill.operators import volume as V
from voxelmill.sources import fixtures as X
from voxelmill.sources import frames as S
from voxelmill.sources import parameters as P

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SIGMA = 3.0


def tidy(df: DataFrame) -> DataFrame:
    """Integers as bigint, floating point rounded to six digits: what the SQL gives, too."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind in ("int", "bigint", "smallint", "tinyint"):
            c = c.cast("bigint")
        elif kind in ("double", "float") or kind.startswith("decimal"):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        out.append(c.alias(name))
    return df.select(*out)


def query(sql: str, ints: str = "", doubles: str = "", strings: str = "", name: str | None = None):
    """Register a function under its name with ``sql``, whose columns are listed by kind."""

    def register(f):
        key = name or f.__name__
        cols = [f"{c}::BIGINT AS {c}" for c in ints.split()] + [f"round({c}::DOUBLE, 6) + 0.0 AS {c}" for c in doubles.split()] + [f"{c}::VARCHAR AS {c}" for c in strings.split()]
        head, _, tail = sql.rpartition("\n--\n")
        QUERIES[key] = lambda spark, sf_dir: tidy(f(spark, sf_dir))
        ORACLES[key] = f"{'WITH ' + head if head.strip() else ''} SELECT {', '.join(cols)} FROM ({tail})"
        return f

    return register


# --- SQL of the derived tables ---------------------------------------------------------------


def emb_sql(hot: bool = False, floats: bool = False) -> str:
    x = "x::DOUBLE" if floats else "round_even(x::DOUBLE * 1e6, 0)::BIGINT"
    val = f"CASE WHEN (vec_id * 7 + pos) % 11 = 0 THEN 0 ELSE {x} END"
    if hot:
        val = f"({val}) * CASE WHEN (vec_id * 13 + pos * 5) % 97 = 0 THEN 50 ELSE 1 END"
    return f"""emb AS (SELECT vec_id // 8 AS vol, pos // 8 AS ih, pos % 8 AS ik, vec_id % 8 AS il, {val} AS val
  FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings))"""


DENSE = """dense AS (SELECT v.vol, h.i AS ih, k.i AS ik, l.i AS il, coalesce(e.val, 0) AS val
  FROM (SELECT DISTINCT vol FROM emb) v CROSS JOIN range(8) h(i) CROSS JOIN range(8) k(i) CROSS JOIN range(8) l(i)
  LEFT JOIN emb e ON e.vol = v.vol AND e.ih = h.i AND e.ik = k.i AND e.il = l.i)"""
LI = """li AS (SELECT 0 AS vol, l_quantity::INT - 1 AS ih, round_even(l_discount * 100, 0)::INT AS ik, round_even(l_tax * 100, 0)::INT AS il, count(*) AS val
  FROM lineitem GROUP BY ALL)"""


def ops_sql(group: str) -> str:
    """For each operation and source dimension the target dimension it comes from, and the sign."""
    rows = []
    for i, op in enumerate(usable(group)):
        back = {s: (t, sign) for t, (s, sign) in enumerate(op)}
        rows.append(f"({i}, {', '.join(f'{t}, {g}' for t, g in (back[s] for s in range(3)))})")
    return f"ops AS (SELECT * FROM (VALUES {', '.join(rows)}) o(op, t0, s0, t1, s1, t2, s2))"


def source_sql(table: str = "dense") -> str:
    """Each target's source on the 8x8x8 grid, by operation."""
    pick = lambda s: f"(CASE t{s} WHEN 0 THEN ih WHEN 1 THEN ik ELSE il END)"
    at = ", ".join(f"CASE WHEN s{s} > 0 THEN {pick(s)} ELSE 7 - {pick(s)} END AS x{s}" for s in range(3))
    return f"src AS (SELECT vol, ih, ik, il, op, {at} FROM {table}, ops)"


EQUIV = """eq AS (SELECT s.vol, s.ih, s.ik, s.il, e.val FROM src s JOIN dense e ON e.vol = s.vol AND e.ih = s.x0 AND e.ik = s.x1 AND e.il = s.x2 WHERE e.val <> 0)"""
SYM = "sym AS (SELECT d.vol, d.ih, d.ik, d.il, coalesce(m.m, 0) AS val FROM dense d LEFT JOIN (SELECT vol, ih, ik, il, avg(val) AS m FROM eq GROUP BY ALL) m USING (vol, ih, ik, il))"


def full_source_sql(group: str, grid: V.Grid, table: str = "dense") -> str:
    """Each target's source on a grid by all operations of a group, by operation; nearest points, ties to even."""
    ops = ", ".join(f"({i}, {', '.join(str(x) for row in op for x in row)})" for i, op in enumerate(stored_operations(group, grid.plane, full=True)))
    start, step = [[float(a[0]) for a in grid.axes], [float(grid.step(d)) for d in range(3)]]
    image = lambda t: " + ".join(f"m{t}{d} * ({start[d]}::DOUBLE + {step[d]}::DOUBLE * {n})" for d, n in enumerate(("ih", "ik", "il")))
    at = ", ".join(f"round_even(({image(t)} - ({start[t]}::DOUBLE)) / {step[t]}::DOUBLE, 0)::INT AS x{t}" for t in range(3))
    names = ", ".join(f"m{t}{d}" for t in range(3) for d in range(3))
    return f"src AS (SELECT vol, ih, ik, il, op, {at} FROM {table}, (VALUES {ops}) o(op, {names}))"


def reject_sql(src: str, out: str, tag: str, source: Callable[[str], str] = source_sql) -> str:
    """One round of outlier rejection from table ``src`` (vol, ih, ik, il, val, replaced)."""
    s = source(src).replace("src AS", f"s{tag} AS", 1)
    return f"""{s},
e{tag} AS (SELECT s.vol, s.ih, s.ik, s.il, e.val FROM s{tag} s JOIN {src} e ON e.vol = s.vol AND e.ih = s.x0 AND e.ik = s.x1 AND e.il = s.x2 WHERE e.val <> 0),
m{tag} AS (SELECT vol, ih, ik, il, median(val::DOUBLE) AS med FROM e{tag} GROUP BY ALL),
d{tag} AS (SELECT e.vol, e.ih, e.ik, e.il, med, 1.4826 * median(abs(val - med)) AS mad FROM e{tag} e JOIN m{tag} USING (vol, ih, ik, il) GROUP BY ALL),
{out} AS MATERIALIZED (SELECT r.vol, r.ih, r.ik, r.il, CASE WHEN bad THEN med ELSE val END AS val, replaced + bad::INT AS replaced
  FROM (SELECT r.*, med, coalesce(r.val <> 0 AND mad > 1e-10 AND abs(r.val - med) > {SIGMA} * mad, false) AS bad FROM {src} r LEFT JOIN d{tag} USING (vol, ih, ik, il)) r)"""


START = "r0 AS (SELECT vol, ih, ik, il, val::DOUBLE AS val, 0 AS replaced FROM dense)"
IDX = "vol ih ik il"

# --- voxels and bins -------------------------------------------------------------------------


@query(emb_sql() + "\n--\nSELECT * FROM emb", IDX + " val")
def voxelize_embeddings(spark, sf):
    return X.embedding_voxels(spark, sf).voxels


@query(LI + "\n--\nSELECT * FROM li", IDX + " val")
def voxelize_lineitem(spark, sf):
    return X.lineitem_voxels(spark, sf).voxels


@query(emb_sql() + ", " + DENSE + "\n--\nSELECT * FROM dense", IDX + " val")
def densify(spark, sf):
    return V.densify(X.embedding_voxels(spark, sf)).voxels


FLOOR = "((s - ((s % n + n) % n)) // n)"


@query(emb_sql() + f"\n--\nSELECT vol, ih, ik, il, {FLOOR} AS val FROM (SELECT vol, ih // 2 AS ih, ik // 3 AS ik, il, sum(val)::BIGINT AS s, 6 AS n FROM emb WHERE ik < 6 GROUP BY ALL)", IDX + " val")
def bin2d_floor_mean(spark, sf):
    return V.bin_frames(X.embedding_voxels(spark, sf).voxels, (8, 8), 3, 2)


@query("""m AS (SELECT dim, i // b AS idx, avg(x0 + dx * i) AS coord FROM (VALUES (0, 50, 3, -12.25, 0.5), (1, 11, 2, -5.0, 1.0), (2, 9, 4, -4.0, 1.0)) a(dim, n, b, x0, dx), range(50) r(i) WHERE i < n // b * b GROUP BY ALL)
--
SELECT m.dim, m.idx, m.coord, (SELECT count(*) FROM lineitem) AS n_rows FROM m""", "dim idx n_rows", "coord")
def bin1d_axis(spark, sf):
    v = X.lineitem_voxels(spark, sf)
    n = v.voxels.agg(F.sum("val").alias("n_rows"))
    axes = V.Volume(v.voxels, V.Grid(tuple(V.bin_axis(a, b) for a, b in zip(v.grid.axes, (3, 2, 4), strict=True))))
    return V.axis_table(axes).join(F.broadcast(n))


@query(emb_sql() + f"\n--\nSELECT vol, ih, ik, il, {FLOOR} AS val FROM (SELECT vol, ih // 3 AS ih, ik // 2 AS ik, il // 2 AS il, sum(val)::BIGINT AS s, 12 AS n FROM emb WHERE ih < 6 GROUP BY ALL)", IDX + " val")
def bin_volume_int(spark, sf):
    return V.bin_volume(X.embedding_voxels(spark, sf), 3, 2, 2).voxels


@query(emb_sql(floats=True) + "\n--\nSELECT vol, ih // 2 AS ih, ik // 2 AS ik, il // 2 AS il, sum(val) / 8.0 AS val FROM emb GROUP BY ALL", IDX, "val")
def bin_volume_float(spark, sf):
    return V.bin_volume(X.embedding_voxels(spark, sf, floats=True), 2, 2, 2).voxels


@query(LI + f"\n--\nSELECT vol, ih, ik, il, {FLOOR} AS val FROM (SELECT vol, ih // 4 AS ih, ik // 2 AS ik, il // 3 AS il, sum(val)::BIGINT AS s, 24 AS n FROM li WHERE ih < 48 AND ik < 10 GROUP BY ALL)", IDX + " val")
def bin_volume_lineitem(spark, sf):
    return V.bin_volume(X.lineitem_voxels(spark, sf), 4, 2, 3).voxels


@query(emb_sql() + f""", a AS (SELECT vol, ih, ik, il, {FLOOR} AS val FROM (SELECT vol, ih // 2 AS ih, ik // 2 AS ik, il, sum(val)::BIGINT AS s, 4 AS n FROM emb GROUP BY ALL))
--
SELECT vol, ih, ik, il, {FLOOR} AS val FROM (SELECT vol, ih, ik, il // 2 AS il, sum(val)::BIGINT AS s, 2 AS n FROM a GROUP BY ALL)""", IDX + " val")
def bin_double_floor(spark, sf):
    v = X.embedding_voxels(spark, sf)
    return V.bin_volume(V.bin_volume(v, 2, 2, 1), 1, 1, 2).voxels


@query(LI + "\n--\nSELECT vol, ih - 5 AS ih, ik - 3 AS ik, il, val FROM li WHERE -12.25 + 0.5 * ih BETWEEN -10 AND 3 AND -5.0 + ik BETWEEN -2 AND 4", IDX + " val")
def crop_range(spark, sf):
    return V.crop(X.lineitem_voxels(spark, sf), {0: (-10.0, 3.0), 1: (-2.0, 4.0)}).voxels


@query(LI + "\n--\nSELECT vol, ih, ik - 2 AS ik, il - 1 AS il, val FROM li WHERE abs(-5.0 + ik) <= 3 AND abs(-4.0 + il) <= 3.5", IDX + " val")
def clip_symmetric(spark, sf):
    return V.clip_symmetric(X.lineitem_voxels(spark, sf), {0: 12.25, 1: 3.0, 2: 3.5}).voxels


@query(emb_sql() + "\n--\nSELECT vol, min(val) AS min_val, max(val) AS max_val, count(*) FILTER (val <> 0) AS n_measured, 100.0 * count(*) FILTER (val <> 0) / 512 AS percent FROM emb GROUP BY vol", "vol min_val max_val n_measured", "percent")
def volume_info(spark, sf):
    return V.info(X.embedding_voxels(spark, sf).voxels, 512)


@query(emb_sql() + "\n--\nSELECT vol, quantile_cont(val, 0.01) AS p1, quantile_cont(val, 0.5) AS p50, quantile_cont(val, 0.99) AS p99, quantile_cont(val, 0.995) AS p99_5, quantile_cont(val, 0.9999) AS p99_99 FROM emb WHERE val > 0 GROUP BY vol", "vol", "p1 p50 p99 p99_5 p99_99")
def positive_percentiles(spark, sf):
    return V.positive_percentiles(X.embedding_voxels(spark, sf), [0.01, 0.5, 0.99, 0.995, 0.9999])


# --- symmetry --------------------------------------------------------------------------------


def _multiplicity_sql() -> str:
    rows = ", ".join(f"('{g}', {', '.join(str(x) for r in op for x in r)})" for g in GENERATORS for op in operations(g))
    return f"""ops AS (SELECT * FROM (VALUES {rows}) o(laue_group, a, b, c, d, e, f, g, h, i)),
pts AS (SELECT DISTINCT l_linenumber AS x, l_quantity::INT % 5 AS y, round_even(l_discount * 100, 0)::INT % 4 AS z FROM lineitem)
--
SELECT laue_group, x, y, z, count(*) AS n_ops, count(DISTINCT (a * x + b * y + c * z, d * x + e * y + f * z, g * x + h * y + i * z)) AS n_equivalents FROM ops, pts GROUP BY ALL"""


@query(_multiplicity_sql(), "x y z n_ops n_equivalents", "", "laue_group")
def laue_multiplicity(spark, sf):
    """Distinct equivalents of reflections under every group, all operations included."""
    pts = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_linenumber").alias("x"), (F.col("l_quantity").cast("int") % 5).alias("y"), (F.rint(F.col("l_discount") * 100).cast("int") % 4).alias("z")).distinct()
    image = lambda op: F.struct(*[(op[i][0] * F.col("x") + op[i][1] * F.col("y") + op[i][2] * F.col("z")).alias("xyz"[i]) for i in range(3)])
    groups = F.array(*[F.struct(F.lit(g).alias("g"), F.lit(len(operations(g))).alias("n"), F.size(F.array_distinct(F.array(*map(image, operations(g))))).alias("m")) for g in GENERATORS])
    return pts.select("x", "y", "z", F.explode(groups).alias("r")).select(F.col("r.g").alias("laue_group"), "x", "y", "z", F.col("r.n").alias("n_ops"), F.col("r.m").alias("n_equivalents"))


def _register_groups() -> None:
    for g in GENERATORS:
        key = slug(g)
        base = ", ".join((emb_sql(hot=True), DENSE, ops_sql(g)))
        query(f"{base}, {source_sql()}, {EQUIV}, {SYM}\n--\nSELECT * FROM sym", IDX, "val", name=f"symmetrize_{key}")(lambda spark, sf, g=g: symmetry.symmetrize(X.embedding_voxels(spark, sf, hot=True), g).voxels)
        query(f"{base}, {START}, {reject_sql('r0', 'r1', '1')}\n--\nSELECT * FROM r1", IDX + " replaced", "val", name=f"reject_outliers_{key}")(
            lambda spark, sf, g=g: symmetry.reject_outliers(X.embedding_voxels(spark, sf, hot=True), g, SIGMA).voxels
        )


_register_groups()


def _register_full() -> None:
    """Trigonal and hexagonal groups with all their operations: on lattice points by orbits, between points by maps of two dimensions."""
    emb = ", ".join((emb_sql(hot=True), DENSE))
    for g in ("-3", "-3m", "6/m", "6/mmm"):
        key = slug(g)
        query(f"{emb}, {full_source_sql(g, X.HEX_GRID)}, {EQUIV}, {SYM}\n--\nSELECT * FROM sym", IDX, "val", name=f"symmetrize_full_{key}")(
            lambda spark, sf, g=g: symmetry.symmetrize(X.hexagonal_voxels(spark, sf), g, full=True).voxels
        )
        query(f"{emb}, {START}, {reject_sql('r0', 'r1', '1', lambda t, g=g: full_source_sql(g, X.EMB_GRID, t))}\n--\nSELECT * FROM r1", IDX + " replaced", "val", name=f"reject_outliers_full_{key}")(
            lambda spark, sf, g=g: symmetry.reject_outliers(X.embedding_voxels(spark, sf, hot=True), g, SIGMA, full=True).voxels
        )
    query(f"{emb}, {full_source_sql('6/mmm', X.EMB_GRID)}, {EQUIV}, {SYM}\n--\nSELECT * FROM sym", IDX, "val", name="symmetrize_full_gather_6mmm")(
        lambda spark, sf: symmetry.symmetrize(X.embedding_voxels(spark, sf, hot=True), "6/mmm", full=True).voxels
    )
    query(f"{emb}, {START}, {reject_sql('r0', 'r1', '1', lambda t: full_source_sql('6/mmm', X.HEX_GRID, t))}, {reject_sql('r1', 'r2', '2', lambda t: full_source_sql('6/mmm', X.HEX_GRID, t))}\n--\nSELECT * FROM r2", IDX + " replaced", "val", name="reject_outliers_full_iter2_6mmm")(
        lambda spark, sf: symmetry.reject_outliers(X.hexagonal_voxels(spark, sf), "6/mmm", SIGMA, 2, full=True).voxels
    )
    for plane, group in (("KL", "4/m"), ("HL", "4/mmm"), ("KL", "6/m")):
        grid = V.Grid(X.HEX_GRID.axes if group == "6/m" else X.EMB_GRID.axes, plane)
        query(f"{emb}, {full_source_sql(group, grid)}, {EQUIV}, {SYM}\n--\nSELECT * FROM sym", IDX, "val", name=f"symmetrize_{plane.lower()}_stack_{slug(group)}")(
            lambda spark, sf, grid=grid, group=group: symmetry.symmetrize(V.Volume(X.embedding_voxels(spark, sf, hot=True).voxels, grid), group, full=True).voxels
        )
    wide = """emb AS (SELECT 0 AS vol, l_quantity::INT - 1 AS ih, l_partkey % 50 AS ik, round_even(l_discount * 100, 0)::INT AS il, count(*) AS val FROM lineitem GROUP BY ALL),
dense AS (SELECT 0 AS vol, h.i AS ih, k.i AS ik, l.i AS il, coalesce(e.val, 0) AS val FROM range(50) h(i) CROSS JOIN range(50) k(i) CROSS JOIN range(11) l(i) LEFT JOIN emb e ON e.ih = h.i AND e.ik = k.i AND e.il = l.i)"""
    query(f"{wide}, {full_source_sql('6/mmm', X.WIDE_GRID)}, {EQUIV}, {SYM}\n--\nSELECT * FROM sym", IDX, "val", name="symmetrize_full_wide_6mmm")(
        lambda spark, sf: symmetry.symmetrize(X.wide_voxels(spark, sf), "6/mmm", full=True).voxels
    )


_register_full()
MMM = ", ".join((emb_sql(hot=True), DENSE, ops_sql("mmm")))
M3M = ", ".join((emb_sql(hot=True), DENSE, ops_sql("m-3m")))


@query(f"{M3M}, {source_sql()}, {EQUIV}, {SYM}\n--\nSELECT * FROM sym", IDX, "val")
def symmetrize_gather_m3m(spark, sf):
    return symmetry.symmetrize(X.embedding_voxels(spark, sf, hot=True), "m-3m", strategy="gather").voxels


@query(f"{MMM}, {START}, {reject_sql('r0', 'r1', '1')}, {reject_sql('r1', 'r2', '2')}\n--\nSELECT * FROM r2", IDX + " replaced", "val")
def reject_outliers_iter2(spark, sf):
    return symmetry.reject_outliers(X.embedding_voxels(spark, sf, hot=True), "mmm", SIGMA, 2).voxels


@query(f"{MMM}, {START}, {reject_sql('r0', 'r1', '1')}, {reject_sql('r1', 'r2', '2')}\n--\nSELECT * FROM r2", IDX + " replaced", "val")
def reject_outliers_gather_iter2(spark, sf):
    return symmetry.reject_outliers(X.embedding_voxels(spark, sf, hot=True), "mmm", SIGMA, 2, strategy="gather").voxels


def _unequal_sql() -> str:
    """Images of the 4,950 points by packed places, in integer quarter units; one join on one integer, one aggregation."""
    quarter, start, step, size = {0: "2 * ih - 49", 1: "4 * ik - 20", 2: "4 * il - 16"}, (-49, -20, -16), (2, 4, 4), (50, 11, 9)
    ops = ", ".join(f"({i}, {', '.join(str(x) for row in op for x in row)})" for i, op in enumerate(stored_operations("m-3m")))
    names = ", ".join(f"m{t}{d}" for t in range(3) for d in range(3))
    image = lambda t: " + ".join(f"m{t}{d} * ({quarter[d]})" for d in range(3))
    at = ", ".join(f"round_even(({image(t)} - ({start[t]})) / {step[t]}.0, 0)::INT AS x{t}" for t in range(3))
    inside = " AND ".join(f"x{t} BETWEEN 0 AND {n - 1}" for t, n in enumerate(size))
    return f"""{LI}, lp AS MATERIALIZED (SELECT (ih * 99 + ik * 9 + il)::BIGINT AS p, val FROM li),
pts AS MATERIALIZED (SELECT i::BIGINT AS t, i // 99 AS ih, i // 9 % 11 AS ik, i % 9 AS il FROM range(4950) r(i)),
img AS MATERIALIZED (SELECT t, (x0 * 99 + x1 * 9 + x2)::BIGINT AS p FROM (SELECT t, {at} FROM pts, (VALUES {ops}) o(op, {names})) WHERE {inside}),
eq AS MATERIALIZED (SELECT t, avg(val) AS m FROM img JOIN lp ON lp.p = img.p GROUP BY t)
--
SELECT 0 AS vol, ih, ik, il, coalesce(m, 0) AS val FROM pts LEFT JOIN eq ON eq.t = pts.t"""


@query(_unequal_sql(), IDX, "val")
def symmetrize_unequal_axes_m3m(spark, sf):
    return symmetry.symmetrize(X.lineitem_voxels(spark, sf), "m-3m").voxels


STATS = """r AS (SELECT vol, d.val - s.val AS r FROM dense d JOIN sym s USING (vol, ih, ik, il) WHERE d.val - s.val <> 0),
c AS (SELECT vol, median(r) AS med FROM r GROUP BY vol), m AS (SELECT vol, med, median(abs(r - med)) AS mad FROM r JOIN c USING (vol) GROUP BY ALL)
--
SELECT vol, med AS median, mad, floor(mad * 1.4826 * 1e6 + 0.5) / 1e6 AS robust_std, quantile_cont(abs(r), 0.9) AS p90, quantile_cont(abs(r), 0.95) AS p95, quantile_cont(abs(r), 0.99) AS p99,
 quantile_cont(abs(r), 0.999) AS p99_9, max(abs(r)) AS max_abs, count(*) FILTER (abs(r) > 2 * mad * 1.4826) AS n_over_2, count(*) FILTER (abs(r) > 3 * mad * 1.4826) AS n_over_3,
 count(*) FILTER (abs(r) > 5 * mad * 1.4826) AS n_over_5, count(*) AS n_total, count(*) FILTER (abs(r) > 3 * mad * 1.4826) / count(*) AS share_over_3 FROM r JOIN m USING (vol) GROUP BY vol, med, mad"""


@query(f"{MMM}, {source_sql()}, {EQUIV}, {SYM}, {STATS}", "vol n_over_2 n_over_3 n_over_5 n_total", "median mad robust_std p90 p95 p99 p99_9 max_abs share_over_3")
def outlier_stats(spark, sf):
    s = symmetry.outlier_stats(X.embedding_voxels(spark, sf, hot=True), "mmm")
    # six digits by one arithmetic on both sides: ties round alike
    return s.withColumn("robust_std", F.floor(F.col("robust_std") * 1e6 + 0.5) / 1e6)


# --- geometry --------------------------------------------------------------------------------

UB = """p0 AS (SELECT p_partkey AS id, 5 + p_size * 0.1::DOUBLE AS a, 6 + p_partkey % 40 * 0.1::DOUBLE AS b, 7 + p_partkey % 30 * 0.1::DOUBLE AS c, radians(80 + p_partkey % 21) AS al, radians(85 + p_partkey % 25) AS be,
 radians(75 + p_partkey % 31) AS ga, 0.7::DOUBLE + p_partkey % 10 * 0.05::DOUBLE AS wl, 0.6::DOUBLE + p_partkey % 5 * 0.1::DOUBLE AS d_min, 1670 + p_partkey % 12 AS nx, 1470 + p_partkey % 7 AS ny FROM part),
p1 AS (SELECT *, cos(al) AS ca, cos(be) AS cb, cos(ga) AS cg, sin(al) AS sa, sin(be) AS sb, sin(ga) AS sg FROM p0),
p2 AS (SELECT *, sqrt(1 - ca*ca - cb*cb - cg*cg + 2*ca*cb*cg) AS v, (ca*cb - cg) / (sa*sb) AS cgr, (ca*cg - cb) / (sa*sg) AS cbr FROM p1),
ub AS (SELECT *, sa/(a*v) AS ar, sb/(b*v) AS br, sg/(c*v) AS cr FROM p2),
inv AS (SELECT *, 1/ar AS hk00, -br*cgr/(ar*br*sqrt(1-cgr*cgr)) AS hk01, 1/(br*sqrt(1-cgr*cgr)) AS hk11,
 1/ar AS hl00, -cr*cbr/(ar*cr*sqrt(1-cbr*cbr)) AS hl01, 1/(cr*sqrt(1-cbr*cbr)) AS hl11, (ca_r) AS car,
 1/br AS kl00, -cr*ca_r/(br*cr*sqrt(1-ca_r*ca_r)) AS kl01, 1/(cr*sqrt(1-ca_r*ca_r)) AS kl11, 2/(d_min*nx) AS s, (nx+1)//2 + 0.5 AS cx, (ny+1)//2 + 0.5 AS cy
 FROM (SELECT *, (cb*cg - ca) / (sb*sg) AS ca_r FROM ub))"""
U = [f"u{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)]


def _cells(spark, sf) -> tuple[DataFrame, list[Column]]:
    return X.cells(spark, sf), [F.col(u) for u in U]


@query(UB + "\n--\nSELECT id, a, b, c, degrees(al) AS alpha, degrees(be) AS beta, degrees(ga) AS gamma FROM ub", "id", "a b c alpha beta gamma")
def cell_from_ub(spark, sf):
    df, u = _cells(spark, sf)
    return df.select("id", *[c.alias(n) for n, c in G.cell_from_ub(u, F.col("wl")).items()])


def _register_planes() -> None:
    for plane in ("HK", "HL", "KL"):
        p = plane.lower()

        def run(spark, sf, plane=plane):
            df, u = _cells(spark, sf)
            return df.select("id", *[c.alias(n) for n, c in G.plane_inverse(u, F.col("wl"), plane).items()])

        query(UB + f"\n--\nSELECT id, {p}00 AS i00, {p}01 AS i01, 0 AS i10, {p}11 AS i11 FROM inv", "id", "i00 i01 i10 i11", name=f"plane_m_inv_{p}")(run)


_register_planes()


def _inverse(spark, sf) -> tuple[DataFrame, dict]:
    df, u = _cells(spark, sf)
    m = G.plane_inverse(u, F.col("wl"), "HK")
    df = df.select("id", "d_min", "nx", "ny", *[c.alias(n) for n, c in m.items()], G.pixel_scale(F.col("d_min"), F.col("nx")).alias("s"))
    return df, {n: F.col(n) for n in m}


PIX = "[1, 419, 838, 1257, 1470]"


@query(UB + f", g AS (SELECT *, i - cx AS x, j - cy AS y FROM inv, (SELECT unnest({PIX}) AS i), (SELECT unnest({PIX}) AS j))\n--\nSELECT id, i, j, s * (hk00 * x + hk01 * y) AS idx1, s * hk11 * y AS idx2 FROM g", "id i j", "idx1 idx2")
def pixel_index_grid(spark, sf):
    df, m = _inverse(spark, sf)
    steps = F.array(*map(F.lit, (1, 419, 838, 1257, 1470)))
    g = df.withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps))
    a, b = G.pixel_indices(m, F.col("s"), F.col("i") - G.centre(F.col("nx")), F.col("j") - G.centre(F.col("ny")))
    return g.select("id", "i", "j", a.alias("idx1"), b.alias("idx2"))


@query(UB + "\n--\nSELECT id, i, hk00 * (i - cx) * s AS h, hk11 * (i - cy) * s AS k FROM inv, (SELECT unnest(range(1, 1471, 100)) AS i)", "id i", "h k")
def axes_1d(spark, sf):
    df, m = _inverse(spark, sf)
    g = df.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(1470), F.lit(100))))
    return g.select("id", "i", G.axis_value(m["i00"], F.col("s"), F.col("i"), F.col("nx")).alias("h"), G.axis_value(m["i11"], F.col("s"), F.col("i"), F.col("ny")).alias("k"))


@query(UB + ", g AS (SELECT *, 1.5 + id % 3 AS i1, id % 7 - 3 AS i2 FROM inv)\n--\nSELECT id, (i1 - hk01 * (i2 / hk11)) / hk00 AS x, i2 / hk11 AS y, i1 AS back1, i2 AS back2 FROM (SELECT * FROM g)", "id", "x y back1 back2")
def miller_to_cart(spark, sf):
    df, m = _inverse(spark, sf)
    x, y = G.to_cartesian(m, 1.5 + F.col("id") % 3, (F.col("id") % 7 - 3).cast("double"))
    b1, b2 = G.to_miller(m, F.col("x"), F.col("y"))
    return df.withColumn("x", x).withColumn("y", y).select("id", "x", "y", b1.alias("back1"), b2.alias("back2"))


@query(UB + "\n--\nSELECT id, (0.5 - cx) * s AS x_low, (nx + 0.5 - cx) * s AS x_high, (0.5 - cy) * s AS y_low, (ny + 0.5 - cy) * s AS y_high FROM inv", "id", "x_low x_high y_low y_high")
def slice_extent(spark, sf):
    df, _ = _inverse(spark, sf)
    x, y = G.extent(F.col("nx"), F.col("s")), G.extent(F.col("ny"), F.col("s"))
    return df.select("id", x[0].alias("x_low"), x[1].alias("x_high"), y[0].alias("y_low"), y[1].alias("y_high"))


@query(UB + ", g AS (SELECT id, hk00 * (0.5 - cx) * s / 8 AS lo, hk00 * (nx + 0.5 - cx) * s / 8 AS hi FROM inv)\n--\nSELECT id, unnest(range(ceil(lo)::BIGINT, floor(hi)::BIGINT + 1)) AS tick FROM g", "id tick")
def grid_ticks(spark, sf):
    df, m = _inverse(spark, sf)
    lo, hi = G.extent(F.col("nx"), F.col("s"))
    return df.select("id", F.explode(G.integer_ticks(m["i00"] * lo / 8, m["i00"] * hi / 8)).alias("tick"))


@query(UB + ", g AS (SELECT id, (2 + 3 * abs(hk01 / hk11)) / hk00 AS x, 3 / hk11 AS y FROM inv)\n--\nSELECT id, -x AS x_low, x AS x_high, -y AS y_low, y AS y_high FROM g", "id", "x_low x_high y_low y_high")
def axis_corners(spark, sf):
    df, m = _inverse(spark, sf)
    r = G.corner_range(m, F.lit(2.0), F.lit(3.0))
    return df.select("id", *[c.alias(n) for c, n in zip(r, ("x_low", "x_high", "y_low", "y_high"), strict=True)])


# --- frames and text -------------------------------------------------------------------------

FRAMES = """fr AS (SELECT '/data/run' || o_orderkey % 5 || '_' || CASE WHEN o_orderkey % 11 = 0 THEN 'x' ELSE o_orderkey::VARCHAR END || CASE WHEN o_orderkey % 7 = 0 THEN '.IMG' ELSE '.img' END AS path,
 (o_orderkey % 3) * 0.5 AS fixed_h, (o_orderkey % 2) * 0.25 AS fixed_k, ((o_orderkey % 601) * 2 - 600) / 100.0 AS fixed_l, o_orderkey % 4 AS q FROM orders),
nm AS (SELECT *, regexp_extract(path, '([^/]*)_[^_/]*$', 1) AS prefix, regexp_extract(lower(path), '_(\\d+)\\.img$', 1)::BIGINT AS file_no FROM fr WHERE regexp_matches(lower(path), '_\\d+\\.img$')),
best AS (SELECT prefix FROM nm GROUP BY prefix ORDER BY count(*) DESC, prefix LIMIT 1),
sc AS (SELECT *, CASE q WHEN 1 THEN 'HL' WHEN 2 THEN 'KL' ELSE 'HK' END AS plane FROM nm WHERE prefix IN (SELECT prefix FROM best)),
sv AS (SELECT *, CASE plane WHEN 'HL' THEN fixed_k WHEN 'KL' THEN fixed_h ELSE fixed_l END AS fixed_value FROM sc)"""


@query(FRAMES + "\n--\nSELECT path, prefix, file_no FROM nm WHERE prefix IN (SELECT prefix FROM best)", "file_no", "", "path prefix")
def frame_prefix_mode(spark, sf):
    return S.numbered(X.frames(spark, sf)).select("path", "prefix", "file_no")


@query(FRAMES + "\n--\nSELECT path, fixed_value, row_number() OVER (ORDER BY fixed_value, file_no, path) - 1 AS layer_idx FROM sv", "layer_idx", "fixed_value", "path")
def frame_scan_order(spark, sf):
    return S.scan_order(S.numbered(X.frames(spark, sf))).select("path", "fixed_value", "layer_idx")


@query(FRAMES + "\n--\nSELECT prefix, count(*) AS n_files, arg_min(fixed_value, file_no) AS first_value, arg_max(fixed_value, file_no) AS last_value, (max(fixed_value) - min(fixed_value)) / greatest(count(*) - 1, 1) AS l_step FROM sv GROUP BY prefix", "n_files", "first_value last_value l_step", "prefix")
def folder_summary(spark, sf):
    return S.folder_summary(S.scan_order(S.numbered(X.frames(spark, sf))))


@query(FRAMES + """
--
SELECT path, CASE q WHEN 1 THEN 'HL' WHEN 2 THEN 'KL' ELSE 'HK' END AS scan_plane,
 CASE WHEN q = 0 THEN 'HK' WHEN q = 1 THEN 'HL' WHEN q = 2 THEN 'KL' WHEN abs(fixed_l) > 1e-10 THEN 'HK' WHEN abs(fixed_k) > 1e-10 THEN 'HL' WHEN abs(fixed_h) > 1e-10 THEN 'KL' ELSE 'HK' END AS layer_plane FROM fr""", "", "", "path scan_plane layer_plane")
def plane_type_detect(spark, sf):
    return X.frames(spark, sf).select("path", S.plane_type("scan").alias("scan_plane"), S.plane_type("layer").alias("layer_plane"))


@query("\n--\nSELECT 'f' || p_partkey AS file, (0.1 + (p_partkey % 50) * 0.001)::DOUBLE AS u11, 0.11 AS u22, 0.01 AS u32, 0.09 AS u33, 0 AS others FROM part", "others", "u11 u22 u32 u33", "file")
def par_orientation(spark, sf):
    """Orientation matrices of parameter files."""
    u = lambda i: F.col("ub")[i]
    rest = F.abs(u(1)) + F.abs(u(2)) + F.abs(u(3)) + F.abs(u(5)) + F.abs(u(6))
    return P.first_orientation(X.parameter_lines(spark, sf)).select("file", u(0).alias("u11"), u(4).alias("u22"), u(7).alias("u32"), u(8).alias("u33"), rest.cast("int").alias("others"))


@query("""u AS (SELECT p_partkey AS k, p_size, (0.1 + (p_partkey % 50) * 0.001)::DOUBLE AS x, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE (0.7 + (p_partkey % 10) * 0.01)::DOUBLE END AS wl FROM part)
--
SELECT 'f' || k AS file, CASE WHEN k % 3 = 0 THEN p_size + 0.25 ELSE wl / x END AS a, CASE WHEN k % 3 = 0 THEN 6.5 ELSE wl / 0.11 END AS b,
 CASE WHEN k % 3 = 0 THEN 7.125 ELSE wl / 0.09 * sqrt(1 + (0.01 / 0.11) ** 2) END AS c FROM u""", "", "a b c", "file")
def par_cell_parse(spark, sf):
    return P.parse_cells(X.parameter_lines(spark, sf)).select("file", "a", "b", "c")


SEARCH = """fo AS (SELECT '/exp/s' || o_orderkey % 97 || '/run' || o_orderkey AS run, '/exp/s' || o_orderkey % 97 AS top, o_orderkey AS k FROM orders),
pa AS (SELECT run || '/unwarp' || CASE WHEN k % 2 = 0 THEN '/' ELSE '' END AS folder, run, top, k FROM fo),
tops AS (SELECT top, bool_or(k % 97 < 30) AS hot, bool_or(k % 97 < 60) AS warm FROM fo GROUP BY top)"""


@query(SEARCH + """
--
SELECT folder, CASE WHEN k % 4 = 0 THEN run || '/r_cracker.par' WHEN k % 3 = 0 THEN run || '/a.par' WHEN k % 7 = 0 THEN run || '/unwarp/x_cracker.par' WHEN k % 5 = 0 THEN run || '/unwarp/b.par'
 WHEN hot THEN top || '/g_cracker.par' WHEN warm THEN top || '/c.par' END AS path FROM pa JOIN tops USING (top)""", "", "", "folder path")
def par_search(spark, sf):
    return P.find_files(*X.run_folders(spark, sf))


@query(UB + """, u AS (SELECT p_partkey AS id, p_size, (0.1 + (p_partkey % 50) * 0.001)::DOUBLE AS x, (0.7 + (p_partkey % 10) * 0.01)::DOUBLE AS w, p_partkey % 3 = 0 OR p_partkey % 5 <> 0 AS own FROM part)
--
SELECT 'f' || id AS file, own AS from_par, CASE WHEN id % 3 = 0 THEN p_size + 0.25 WHEN own THEN w / x ELSE a END AS a, CASE WHEN id % 3 = 0 THEN 6.5 WHEN own THEN w / 0.11 ELSE b END AS b,
 CASE WHEN id % 3 = 0 THEN 7.125 WHEN own THEN w / 0.09 * sqrt(1 + (0.01 / 0.11) ** 2) ELSE c END AS c FROM ub JOIN u USING (id)""", "from_par", "a b c", "file")
def cell_coalesce(spark, sf):
    df, u = _cells(spark, sf)
    heads = df.select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("file"), *[c.alias(n) for n, c in G.cell_from_ub(u, F.col("wl")).items()])
    got = P.override_cells(heads, P.parse_cells(X.parameter_lines(spark, sf)))
    return got.select("file", F.col("from_par").cast("int").alias("from_par"), "a", "b", "c")


@query(UB + """, ly AS (SELECT *, 2 / (d_min * 4) AS sc, CASE WHEN id % 6 = 0 THEN 2 ELSE 1 END AS f, CASE id % 4 WHEN 0 THEN 'HK' WHEN 1 THEN 'HL' WHEN 2 THEN 'KL' ELSE CASE WHEN id % 8 = 3 THEN 'HL' ELSE 'KL' END END AS plane FROM inv),
m AS (SELECT *, CASE plane WHEN 'HK' THEN hk00 WHEN 'HL' THEN hl00 ELSE kl00 END / f AS i00, CASE plane WHEN 'HK' THEN hk01 WHEN 'HL' THEN hl01 ELSE kl01 END / f AS i01, CASE plane WHEN 'HK' THEN hk11 WHEN 'HL' THEN hl11 ELSE kl11 END / f AS i11,
 CASE plane WHEN 'HK' THEN 0.0 WHEN 'HL' THEN CASE WHEN id % 8 = 3 THEN 0.5 ELSE 0.0 END ELSE 1.5 END AS fixed_value FROM ly)
--
SELECT 'layer' || id || '.img' AS path, plane, fixed_value, fixed_value - 0.25 AS thickness_min, fixed_value + 0.25 AS thickness_max, sc * i00 AS step1, sc * i11 AS step2, pos // 4 AS row, pos % 4 AS col,
 sc * (i00 * (pos % 4 + 1 - 2.5) + i01 * (pos // 4 + 1 - 2.5)) AS idx1, sc * i11 * (pos // 4 + 1 - 2.5) AS idx2, (id + pos) % 17 AS val FROM m, range(12) r(pos)""", "row col val", "fixed_value thickness_min thickness_max step1 step2 idx1 idx2", "path plane")
def layer_read(spark, sf):
    layers = S.layer_geometry(X.single_layers(spark, sf), F.col("other_ub"))
    return S.layer_pixels(layers, "plane", "fixed_value", "thickness_min", "thickness_max", "step1", "step2")


LAYERS = """req AS (SELECT 'list' || s_suppkey AS name, (-(s_suppkey % 7))::DOUBLE AS l_min, (s_suppkey % 5 + 1)::DOUBLE AS l_max, CASE WHEN s_suppkey % 2 = 0 THEN 0.02 ELSE 0.025 END::DOUBLE AS st FROM supplier),
n AS (SELECT *, ceil((l_max + st * 0.5 - l_min) / st)::BIGINT AS n FROM req), rows AS (SELECT name, n, unnest(range(n)) AS i, l_min, st FROM n)"""


@query(LAYERS + "\n--\nSELECT name, i // 500 AS file_idx, i % 500 + 1 AS row_no, round_even((l_min + i * st) * 1e6, 0) / 1e6 AS l, ceil(n / 500.0) AS n_files FROM rows", "file_idx row_no n_files", "l", "name")
def layer_list(spark, sf):
    return P.layer_rows(X.layer_requests(spark, sf))


@query(LAYERS + """
--
SELECT CASE WHEN n <= 500 THEN name || '.dcunwarp' ELSE name || '_' || printf('%03d', i // 500 + 1) || '.dcunwarp' END AS file, i % 500 + 1 AS row_no,
 printf('"%d"   %10.6f   %10.6f  %10.6f     %10.6f   %10.6f   %10.6f     %10.6f   %10.6f   %10.6f        %10.6f       0       0', i % 500 + 1, 0.0::DOUBLE, 0.0::DOUBLE, round_even((l_min + i * st) * 1e6, 0) / 1e6 + 0.0, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 0.8::DOUBLE) AS line FROM rows""", "row_no", "", "file line")
def layer_list_text(spark, sf):
    return P.layer_lines(P.layer_rows(X.layer_requests(spark, sf)))


# --- slices ----------------------------------------------------------------------------------


@query(emb_sql() + "\n--\nSELECT vol, ik AS row, ih AS col, sum(val) AS val FROM emb WHERE il = 3 GROUP BY ALL", "vol row col val")
def slice_native(spark, sf):
    return slicing.native_slice(X.embedding_voxels(spark, sf), 0.0)[0]


@query(emb_sql() + "\n--\nSELECT vol, ik AS row, ih AS col, sum(val) AS val FROM emb WHERE il = 4 GROUP BY ALL", "vol row col val")
def slice_hk_of_kl_stack(spark, sf):
    """HK of frames stored as KL: the one nearest layer, whatever the width."""
    v = X.embedding_voxels(spark, sf)
    return slicing.extract_slice(V.Volume(v.voxels, V.Grid(v.grid.axes, "KL"), v.meta), "HK", 0.6, 5.0)[0]


@query(LI + "\n--\nSELECT vol, ik AS row, ih AS col, sum(val) AS val FROM li WHERE -4.0 + il BETWEEN -1.5 AND 2.5 GROUP BY ALL", "vol row col val")
def slice_native_integrated(spark, sf):
    return slicing.native_slice(X.lineitem_voxels(spark, sf), 0.5, 2.0)[0]


@query(LI + "\n--\nSELECT vol, ik AS row, ih AS col, sum(val) AS val FROM li WHERE il = 8 GROUP BY ALL", "vol row col val")
def slice_empty_window_fallback(spark, sf):
    return slicing.native_slice(X.lineitem_voxels(spark, sf), 9.75, 0.5)[0]


@query(emb_sql() + "\n--\nSELECT vol, -7.0::DOUBLE + 2 * ih AS h, -7.0::DOUBLE + 2 * ik AS k, -7.0::DOUBLE + 2 * il AS l, val FROM emb WHERE val <> 0", "vol val", "h k l")
def measured_points(spark, sf):
    """Measured voxels by their axis values."""
    v = X.embedding_voxels(spark, sf)
    return v.voxels.where("val <> 0").select("vol", *[V.coordinate(v.grid, d).alias(n) for d, n in enumerate("hkl")], "val")


@query(LI + "\n--\nSELECT vol, -12.25::DOUBLE + 0.5 * ih AS h, -5.0::DOUBLE + ik AS k, -4.0::DOUBLE + il AS l, val FROM li WHERE ik = 7", "vol val", "h k l")
def bricks_of_one_plane(spark, sf):
    """Voxels of one k by their axis values, from bricks that meet it."""
    v = X.lineitem_voxels(spark, sf)
    b = V.to_bricks(v, 4)
    rows = V.Volume(V.from_bricks(b), v.grid, v.meta, b).within({1: (7, 7)})
    return rows.select("vol", *[V.coordinate(v.grid, d).alias(n) for d, n in enumerate("hkl")], "val")


@query("SELECT 'v_' || vec_id || '.img' AS path, pos // 8 AS row, pos % 8 AS col, round_even(x::DOUBLE * 1e6, 0)::BIGINT AS val FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)".join(("\n--\n", "")), "row col val", "", "path")
def compressed_frame_pixels(spark, sf):
    """Pixels of compressed frames, by their headers."""
    return S.frame_image(S.frame_rows(X.frame_files(spark, sf, "compressed")))


@query("SELECT 'v_' || vec_id || '.cbf' AS path, pos // 8 AS row, pos % 8 AS col, round_even(x::DOUBLE * 1e6, 0) AS val FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)".join(("\n--\n", "")), "row col", "val", "path")
def cbf_frame_pixels(spark, sf):
    return S.frame_image(S.cbf_frames(X.frame_files(spark, sf, "cbf")))


def _slab_sql(view: str, values: list[float]) -> str:
    # s = 2, inverse [[1, 0.25], [0, 1]]: cross term 0.5; cy = 4.5
    at = [f"(({v}) - 0.5 * (ik + 1 - 4.5) + 7) / 2.0" if view == "KL" else f"(({v}) + 7) / 2.0" for v in values]
    i = "ih" if view == "KL" else "ik"
    w = " + ".join(f"CASE WHEN {a} BETWEEN 0 AND 7 THEN greatest(0, 1 - abs({i} - {a})) ELSE 0 END" for a in at)
    x = "ik" if view == "KL" else "ih"
    return f"slab AS (SELECT vol, {x} AS ix, il AS iy, sum(val * ({w})) AS val FROM emb GROUP BY ALL)"


def _regrid_sql(shift: float) -> str:
    return f"""pts AS (SELECT v.vol, r.i AS row, c.i AS col, ((2.0 * (c.i - 3.5) + 0.5 * (r.i - 3.5)) - ({-7 + shift})) / 2.0 AS fx, (2.0 * (r.i - 3.5) + 7) / 2.0 AS fy FROM (SELECT DISTINCT vol FROM slab) v, range(8) r(i), range(8) c(i))
--
SELECT p.vol, p.row, p.col, coalesce(sum(s.val * greatest(0, 1 - abs(s.ix - fx)) * greatest(0, 1 - abs(s.iy - fy))), 0) AS val FROM pts p LEFT JOIN slab s
 ON s.vol = p.vol AND fx BETWEEN 0 AND 7 AND fy BETWEEN 0 AND 7 AND abs(s.ix - fx) < 1 AND abs(s.iy - fy) < 1 GROUP BY ALL"""


@query(emb_sql() + ", " + _slab_sql("HL", [0.6]) + "\n--\nSELECT * FROM slab", "vol ix iy", "val")
def slice_hl(spark, sf):
    return slicing.oblique_slab(X.embedding_voxels(spark, sf), "HL", 0.6)[0]


@query(emb_sql() + ", " + _slab_sql("KL", [0.6]) + "\n--\nSELECT * FROM slab", "vol ix iy", "val")
def slice_kl(spark, sf):
    return slicing.oblique_slab(X.embedding_voxels(spark, sf), "KL", 0.6)[0]


@query(emb_sql() + ", " + _slab_sql("KL", [-1.0, 1.0, 3.0]) + "\n--\nSELECT * FROM slab", "vol ix iy", "val")
def slice_integrated_kl(spark, sf):
    return slicing.oblique_slab(X.embedding_voxels(spark, sf), "KL", 1.0, 2.0)[0]


@query(emb_sql() + ", " + _slab_sql("HL", [0.6]) + ", " + _regrid_sql(0.5 * ((0.6 + 7) / 2 + 1 - 4.5)), "vol row col", "val")
def regrid_hl(spark, sf):
    return slicing.extract_slice(X.embedding_voxels(spark, sf), "HL", 0.6)[0]


@query(emb_sql() + ", " + _slab_sql("KL", [0.6]) + ", " + _regrid_sql(0.0), "vol row col", "val")
def regrid_kl(spark, sf):
    return slicing.extract_slice(X.embedding_voxels(spark, sf), "KL", 0.6)[0]


@query(emb_sql() + "\n--\nSELECT vol, ih AS idx, val FROM emb WHERE ik = 5 AND il = 3", "vol idx val")
def line_profile_h(spark, sf):
    return slicing.axis_profile(X.embedding_voxels(spark, sf), 0, {1: 2.9, 2: 0.0})


@query(emb_sql() + "\n--\nSELECT vol, ik AS idx, val FROM emb WHERE ih = 0 AND il = 7", "vol idx val")
def line_profile_k(spark, sf):
    return slicing.axis_profile(X.embedding_voxels(spark, sf), 1, {0: -9.0, 2: 7.5})


@query(emb_sql() + """, im AS (SELECT vol, ih AS ix, ik AS iy, val FROM emb WHERE il = 3),
pts AS (SELECT v.vol, t.i AS sample, -1.0 + t.i / 99.0 * 8.5 AS fx, 0.5 + t.i / 99.0 * 6.0 AS fy FROM (SELECT DISTINCT vol FROM im) v, range(100) t(i))
--
SELECT p.vol, p.sample, CASE WHEN fx >= 0 AND fx < 7 AND fy >= 0 AND fy < 7 THEN coalesce(sum(s.val * (1 - abs(s.ix - fx)) * (1 - abs(s.iy - fy))), 0) END AS val
FROM pts p LEFT JOIN im s ON s.vol = p.vol AND abs(s.ix - fx) < 1 AND abs(s.iy - fy) < 1 GROUP BY p.vol, p.sample, fx, fy""", "vol sample", "val")
def line_profile_free(spark, sf):
    image = slicing.native_slice(X.embedding_voxels(spark, sf), 0.0)[0]
    return slicing.line_profile(image, (8, 8), (-1.0, 0.5), (7.5, 6.5), 100)


@query(emb_sql() + """, t AS (SELECT DISTINCT user_id % 8 AS grp, round_even(value, 1) AS target FROM events), ax AS (SELECT g.i AS grp, i.i AS idx, -7.0 + 2 * i.i + g.i * 0.5 AS coord FROM range(8) g(i), range(8) i(i)),
n AS (SELECT grp, target, idx, row_number() OVER (PARTITION BY grp, target ORDER BY abs(coord - target), idx) AS r FROM t JOIN ax USING (grp))
--
SELECT n.grp, n.target, n.idx FROM n WHERE r = 1""".replace("round_even(value, 1)", "(user_id % 37 - 18)::DOUBLE"), "grp idx", "target")
def nearest_lookup(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select((F.col("user_id") % 8).alias("grp"), (F.col("user_id") % 37 - 18).cast("double").alias("target")).distinct()
    axis = e.select("grp").distinct().withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return matching.nearest_rows(axis.select("grp", "idx", (F.lit(-7.0) + 2 * F.col("idx") + F.col("grp") * 0.5).alias("coord")), e)


@query(emb_sql() + """, m AS (SELECT vol, t.target, ik AS row, ih AS col, val FROM emb JOIN (VALUES (-6.0, 0), (0.0, 3), (5.5, 6)) t(target, i) ON il = t.i)
--
SELECT m.vol, m.target, m.row, m.col, m.val, v.vmax FROM m LEFT JOIN (SELECT vol, target, quantile_cont(val, 0.99) AS vmax FROM m WHERE val > 0 GROUP BY ALL) v USING (vol, target)""", "vol row col val", "target vmax")
def slice_montage_p99(spark, sf):
    return slicing.montage(X.embedding_voxels(spark, sf), [-6.0, 0.0, 5.5])


@query(emb_sql() + "\n--\nSELECT vol, coalesce(quantile_cont(val, 0.01) FILTER (val > 0), 0) AS vmin, quantile_cont(val, 0.995) AS vmax FROM emb WHERE il = 3 GROUP BY vol", "vol", "vmin vmax")
def auto_range(spark, sf):
    return slicing.auto_range(slicing.native_slice(X.embedding_voxels(spark, sf), 0.0)[0], 64)


@query(emb_sql() + ", r AS (SELECT vol, max(val) AS hi FROM emb GROUP BY vol)\n--\nSELECT vol, ih, ik, il, CASE WHEN val > 0 THEN ln(val / 0.1) / ln(hi / 0.1) END AS norm FROM emb JOIN r USING (vol)", IDX, "norm")
def log_norm(spark, sf):
    v = X.embedding_voxels(spark, sf).voxels
    top = v.groupBy("vol").agg(F.max("val").cast("double").alias("hi"))
    return v.join(top, "vol").select("vol", *V.DIMS, G.log_norm(F.col("val"), F.lit(0.0), F.col("hi")).alias("norm"))


@query("""ax AS (SELECT s_suppkey AS grp, i AS idx, s_suppkey % 9 - 6.0 + i * (0.5 + s_suppkey % 3 * 0.25) AS coord FROM supplier, range(20) r(i) WHERE i < 5 + s_suppkey % 12),
e AS (SELECT grp, arg_min(coord, idx) AS lo, arg_max(coord, idx) AS hi, count(*) // 2 AS mid FROM ax GROUP BY grp),
t AS (SELECT grp, CASE WHEN lo <= 0 AND hi >= 0 THEN 0.0 ELSE coord END AS target FROM e JOIN ax USING (grp) WHERE idx = mid)
--
SELECT grp, target, arg_min(idx, (abs(coord - target), idx)) AS idx FROM ax JOIN t USING (grp) GROUP BY grp, target""", "grp idx", "target")
def default_slice_value(spark, sf):
    k = F.col("s_suppkey")
    axis = spark.read.parquet(f"{sf}/supplier.parquet").select(k.alias("grp"), F.explode(F.sequence(F.lit(0), (4 + k % 12).cast("int"))).alias("idx"))
    grp = F.col("grp")
    return display.default_slice(axis.select("grp", "idx", (grp % 9 - 6.0 + F.col("idx") * (0.5 + grp % 3 * 0.25)).alias("coord")))


@query(UB + """, q AS (SELECT id, hk00, hk01, hk11, 0.4 AS x1, 0.3 AS y1, 0.4 * hk00 + 0.3 * abs(hk01) AS r1, 0.3 * hk11 AS r2 FROM inv)
--
SELECT id, 1 AS family, n, CASE WHEN abs(hk01) > 1e-12 THEN -x1 ELSE n / hk00 END AS x0, CASE WHEN abs(hk01) > 1e-12 THEN (n + hk00 * x1) / hk01 ELSE -y1 END AS y0,
 CASE WHEN abs(hk01) > 1e-12 THEN x1 ELSE n / hk00 END AS x_end, CASE WHEN abs(hk01) > 1e-12 THEN (n - hk00 * x1) / hk01 ELSE y1 END AS y_end FROM (SELECT *, unnest(range(floor(-r1)::BIGINT, ceil(r1)::BIGINT + 1)) AS n FROM (SELECT * REPLACE (CASE WHEN abs(hk01) < 1e-3 THEN 0 ELSE hk01 END AS hk01) FROM q))
UNION ALL SELECT id, 2, n, -x1, n / hk11, x1, n / hk11 FROM (SELECT *, unnest(range(floor(-r2)::BIGINT, ceil(r2)::BIGINT + 1)) AS n FROM q)""", "id family n", "x0 y0 x_end y_end")
def grid_line_ends(spark, sf):
    df, m = _inverse(spark, sf)
    m["i01"] = F.when(F.abs(m["i01"]) < 1e-3, 0.0).otherwise(m["i01"])
    lines = display.grid_lines(m, (F.lit(-0.4), F.lit(0.4)), (F.lit(-0.3), F.lit(0.3)))
    return df.select("id", F.explode(lines).alias("l")).select("id", "l.*").withColumnsRenamed({"x1": "x_end", "y1": "y_end"})


@query(emb_sql() + """, pt AS (SELECT event_id AS pid, user_id % 4 AS vol, (event_id * 7 % 1000) / 50.0 - 10.013 AS x, (event_id * 11 % 1000) / 50.0 - 9.987 AS y FROM events),
px AS (SELECT *, round_even((x + 8) / 16 * 8 - 0.5, 0)::INT AS col, round_even((y + 8) / 16 * 8 - 0.5, 0)::INT AS row FROM pt)
--
SELECT px.vol, pid, row, col, x + 0.25 * y AS idx1, y AS idx2, coalesce(val, 0) AS val FROM px LEFT JOIN emb e ON e.vol = px.vol AND e.il = 3 AND e.ik = px.row AND e.ih = px.col WHERE row BETWEEN 0 AND 7 AND col BETWEEN 0 AND 7""", "vol pid row col val", "idx1 idx2")
def point_readout(spark, sf):
    e = F.col("event_id")
    pts = spark.read.parquet(f"{sf}/events.parquet").select((F.col("user_id") % 4).alias("vol"), e.alias("pid"), (e * 7 % 1000 / 50.0 - 10.013).alias("x"), (e * 11 % 1000 / 50.0 - 9.987).alias("y"))
    image = slicing.native_slice(X.embedding_voxels(spark, sf), 0.0)[0]
    return display.readout(image, pts, (8, 8), (-8.0, 8.0, -8.0, 8.0), [[1.0, 0.25], [0.0, 1.0]])


@query("""ax AS (SELECT s_suppkey % 10 AS grp, s_suppkey AS idx, (s_suppkey * 37 % 101) / 4.0::DOUBLE AS coord FROM supplier),
w AS (SELECT o_orderkey AS wid, o_custkey % 12 AS grp, (o_orderkey * 13 % 449) / 16.0::DOUBLE AS target, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE (o_orderkey % 7) / 8.0::DOUBLE END AS width FROM orders),
f AS (SELECT w.grp, wid, idx FROM w JOIN ax ON ax.grp = w.grp AND width > 1e-6 AND coord BETWEEN target - width AND target + width),
n AS (SELECT w.grp, wid, idx, row_number() OVER (PARTITION BY w.grp, wid ORDER BY abs(coord - target), idx) AS r FROM w JOIN ax USING (grp) WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.grp = w.grp AND f.wid = w.wid))
--
SELECT * FROM f UNION ALL SELECT grp, wid, idx FROM n WHERE r = 1""", "grp wid idx")
def window_lookup(spark, sf):
    """Windows of orders on axes of suppliers, with the nearest value where a window is empty."""
    k, o = F.col("s_suppkey"), F.col("o_orderkey")
    axis = spark.read.parquet(f"{sf}/supplier.parquet").select((k % 10).alias("grp"), k.alias("idx"), (k * 37 % 101 / 4.0).alias("coord"))
    width = F.when(o % 5 == 0, 0.0).otherwise(o % 7 / 8.0)
    windows = spark.read.parquet(f"{sf}/orders.parquet").select(o.alias("wid"), (F.col("o_custkey") % 12).alias("grp"), (o * 13 % 449 / 16.0).alias("target"), width.alias("width"))
    return matching.window_rows(axis, windows)


# --- surfaces --------------------------------------------------------------------------------


def _smooth_sql() -> str:
    w = surface.kernel(0.5)
    out, src = [], "dense"
    for n, d in enumerate(("ih", "ik", "il")):
        rest = [x for x in ("ih", "ik", "il") if x != d]
        terms = ", ".join(f"({k}, {w[abs(k)]!r}::DOUBLE)" for k in range(-len(w) + 1, len(w)))
        mirror = "CASE WHEN a.{d} + k < 0 THEN -1 - a.{d} - k WHEN a.{d} + k > 7 THEN 15 - a.{d} - k ELSE a.{d} + k END".format(d=d)
        out.append(f"g{n} AS (SELECT a.vol, a.ih, a.ik, a.il, sum(w * b.val) AS val FROM {src} a CROSS JOIN (VALUES {terms}) t(k, w) JOIN {src} b ON b.vol = a.vol AND b.{rest[0]} = a.{rest[0]} AND b.{rest[1]} = a.{rest[1]} AND b.{d} = {mirror} GROUP BY ALL)")
        src = f"g{n}"
    return ", ".join(out)


FLOATS = emb_sql(floats=True) + ", " + DENSE


@query(f"{FLOATS}, {_smooth_sql()}\n--\nSELECT * FROM g2", IDX, "val")
def gaussian_smooth(spark, sf):
    return surface.smooth(V.densify(X.embedding_voxels(spark, sf, floats=True))).voxels


@query(LI + ", r AS (SELECT vol, min(val) AS lo, max(val) AS hi FROM li GROUP BY vol)\n--\nSELECT vol, ih, ik, il, CASE WHEN hi > 0 AND hi < 65535 AND lo >= 0 THEN floor(val * 65535.0::DOUBLE / hi) ELSE val END AS val FROM li JOIN r USING (vol)", IDX, "val")
def uint16_rescale(spark, sf):
    return surface.rescale_uint16(X.lineitem_voxels(spark, sf).voxels)


@query(emb_sql() + "\n--\nSELECT vol, median(val) AS iso FROM emb WHERE val > 0 GROUP BY vol", "vol", "iso")
def iso_default(spark, sf):
    return surface.default_iso(X.embedding_voxels(spark, sf))


@query(emb_sql() + "\n--\nSELECT vol, log10(greatest(quantile_cont(val, 0.5), 0.5)) - 1 AS log_low, log10(greatest(quantile_cont(val, 0.9999), 1.0)) AS log_high FROM emb WHERE val > 0 GROUP BY vol", "vol", "log_low log_high")
def iso_slider_range(spark, sf):
    return surface.slider_range(X.embedding_voxels(spark, sf))


def _iso_sql() -> str:
    parts = []
    for n, d in enumerate(("ih", "ik", "il")):
        at = ", ".join(f"-7.0 + 2 * d.{x}" + (" + 2 * (iso - d.val) / (e.val - d.val)" if x == d else "") + f" AS {a}" for x, a in zip(("ih", "ik", "il"), "xyz", strict=True))
        on = " AND ".join(f"e.{x} = d.{x}" + (" + 1" if x == d else "") for x in ("ih", "ik", "il"))
        parts.append(f"SELECT d.vol, {n} AS dim, d.ih, d.ik, d.il, {at} FROM dense d JOIN dense e ON e.vol = d.vol AND {on} JOIN iso i ON i.vol = d.vol WHERE (d.val < iso) <> (e.val < iso)")
    return f"{FLOATS}, iso AS (SELECT vol, median(val) AS iso FROM dense WHERE val > 0 GROUP BY vol)\n--\n" + " UNION ALL ".join(parts)


@query(_iso_sql(), "vol dim ih ik il", "x y z")
def iso_edge_vertices(spark, sf):
    v = V.densify(X.embedding_voxels(spark, sf, floats=True))
    return surface.iso_crossings(v, surface.default_iso(v)).drop("iso")


def _triangles_sql() -> str:
    """The tetrahedra of every cell with all corners, by tables of their corners and cases."""
    corner = lambda c: " AND ".join(f"c{c}.{n} = d.{n} + {c >> i & 1}" for i, n in enumerate(("ih", "ik", "il")))
    joins = " ".join(f"JOIN dense c{c} ON c{c}.vol = d.vol AND {corner(c)}" for c in range(1, 8))
    tets = ", ".join(f"({int(surface._odd(t))}, [{', '.join(map(str, t))}])" for t in surface.TETRAHEDRA)
    cases = [(odd, mask, *sum(tri[::-1] if odd else tri, ())) for odd in (0, 1) for mask, tris in enumerate(surface.tetrahedron_cases()) for tri in tris]
    inside = " + ".join(f"{1 << i} * (v[t[{i + 1}] + 1] >= iso)::INT" for i in range(4))
    ends = ", ".join(f"least(t[i{n} + 1], t[o{n} + 1]) AS a{n}, greatest(t[i{n} + 1], t[o{n} + 1]) AS b{n}" for n in range(3))
    out = []
    for n in range(3):
        at = [f"({name} + (a{n} >> {d} & 1))" for d, name in enumerate(("ih", "ik", "il"))]
        out.append(f"(({at[0]} * 8 + {at[1]}) * 8 + {at[2]}) * 8 + xor(a{n}, b{n}) AS e{n}")
        out += [f"-7.0::DOUBLE + 2 * {at[d]} + 2 * (iso - v[a{n} + 1]) / (v[b{n} + 1] - v[a{n} + 1]) * (xor(a{n}, b{n}) >> {d} & 1) AS {x}{n}" for d, x in enumerate("xyz")]
    return f"""{FLOATS}, iso AS (SELECT vol, median(val) AS iso FROM dense WHERE val > 0 GROUP BY vol),
cell AS (SELECT d.vol, d.ih, d.ik, d.il, [d.val, {', '.join(f'c{c}.val' for c in range(1, 8))}] AS v FROM dense d {joins}),
tet AS (SELECT * FROM (VALUES {tets}) t(odd, t)), cs AS (SELECT * FROM (VALUES {', '.join(map(str, cases))}) c(odd, mask, i0, o0, i1, o1, i2, o2)),
hit AS (SELECT vol, iso, ih, ik, il, v, t, odd, {inside} AS mask FROM cell JOIN iso USING (vol), tet),
tri AS (SELECT hit.*, {ends} FROM hit JOIN cs USING (odd, mask))
--
SELECT vol, {', '.join(out)} FROM tri"""


@query(_triangles_sql(), "vol e0 e1 e2", "x0 y0 z0 x1 y1 z1 x2 y2 z2")
def iso_triangles(spark, sf):
    v = V.densify(X.embedding_voxels(spark, sf, floats=True))
    return surface.triangles(v, surface.default_iso(v)).drop("iso")


def _isosurface_sql(iso: str) -> str:
    """The vertices above, within h >= -4 and k <= 3, for other levels."""
    head, _, tail = _iso_sql().rpartition("\n--\n")
    head = head.rpartition(", iso AS (")[0] + f", cut AS (SELECT vol, ih - 2 AS ih, ik, il, val FROM dense WHERE ih >= 2 AND ik <= 5), iso AS ({iso})"
    tail = tail.replace("JOIN dense e", "JOIN cut e").replace("FROM dense d", "FROM cut d").replace("-7.0 + 2 * d.ih", "-3.0 + 2 * d.ih").replace("SELECT d.vol,", "SELECT d.vol, iso,")
    return f"{head}\n--\n{tail}"


@query(_isosurface_sql("SELECT vol, unnest([0.02, 0.1]::DOUBLE[]) AS iso FROM (SELECT DISTINCT vol FROM cut)"), "vol dim ih ik il", "iso x y z")
def isosurface_levels(spark, sf):
    return display.isosurface(V.densify(X.embedding_voxels(spark, sf, floats=True)), [0.02, 0.1], {0: (-4.0, 99.0), 1: (-99.0, 3.0)})


@query(_isosurface_sql("SELECT vol, coalesce(median(val) FILTER (val > 0), 1.0) AS iso FROM cut GROUP BY vol"), "vol dim ih ik il", "iso x y z")
def isosurface_default(spark, sf):
    return display.isosurface(V.densify(X.embedding_voxels(spark, sf, floats=True)), None, {0: (-4.0, 99.0), 1: (-99.0, 3.0)})


# --- the whole way ---------------------------------------------------------------------------


def _pipeline_sql() -> str:
    binned = f"emb2 AS (SELECT vol, ih, ik, il, {FLOOR} AS val FROM (SELECT vol, ih, ik // 1 AS ik, il, sum(val)::BIGINT AS s, 1 AS n FROM emb GROUP BY ALL))"
    return ", ".join((emb_sql(hot=True), binned, DENSE, ops_sql("m-3m"), START, reject_sql("r0", "r1", "1"), source_sql("r1"), EQUIV.replace("JOIN dense e", "JOIN r1 e"), SYM.replace("FROM dense d", "FROM r1 d"))) + "\n--\nSELECT * FROM sym"


@query(_pipeline_sql(), IDX, "val")
def pipeline_full(spark, sf):
    from voxelmill.jobs.process import process

    return process(X.embedding_voxels(spark, sf, hot=True), laue="m-3m", sigma=SIGMA, n_iter=1).voxels


@query(emb_sql() + f""", b AS (SELECT vol, ih, ik, il, {FLOOR} AS val FROM (SELECT vol, ih // 2 AS ih, ik // 2 AS ik, il, sum(val)::BIGINT AS s, 4 AS n FROM emb GROUP BY ALL)),
o AS (SELECT vol, greatest(abs(2 * ih - 3), abs(2 * ik - 3)) AS p, least(abs(2 * ih - 3), abs(2 * ik - 3)) AS q, abs(2 * il - 7) AS r, avg(nullif(val, 0)) AS m FROM b GROUP BY ALL),
g AS (SELECT v.vol, h.i AS ih, k.i AS ik, 3 AS il FROM (SELECT DISTINCT vol FROM b) v, range(4) h(i), range(4) k(i))
--
SELECT g.vol, g.ik AS row, g.ih AS col, coalesce(m, 0) AS val FROM g LEFT JOIN o ON o.vol = g.vol AND p = greatest(abs(2 * ih - 3), abs(2 * ik - 3)) AND q = least(abs(2 * ih - 3), abs(2 * ik - 3)) AND r = abs(2 * il - 7)""", "vol row col", "val")
def flagship(spark, sf):
    """Bin, symmetrise under 4/mmm and take the layer next to 0."""
    v = V.bin_volume(X.embedding_voxels(spark, sf), 2, 2, 1)
    return slicing.native_slice(symmetry.symmetrize(v, "4/mmm"), 0.0)[0]
