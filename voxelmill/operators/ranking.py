"""Places and exact percentiles within groups of any size: no group is sorted or held by one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelmill.sources.scratch import cut

#: Rows of the largest group up to which one task may have a group whole (some 20 MB).
WHOLE = 1_000_000


def largest(rows: DataFrame, group: list[str]) -> int:
    """Rows of the largest group."""
    return rows.groupBy(*group).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def _ranges(rows: DataFrame, group: list[str], order: list[str], weight: Column) -> tuple[DataFrame, DataFrame]:
    """``rows`` in ranges ``_part`` of (group, order), and for each group and range the weight ``_before`` it, its own ``_own`` and the group's ``_all``.

    The second table has a row for each group and each further range it is in:
    few for a group, however large.
    """
    dealt = cut(rows.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy(*group, "_part").agg(F.sum(weight).alias("_own"))
    line = W.partitionBy(*group).orderBy("_part")
    sizes = sizes.withColumn("_before", F.sum("_own").over(line) - F.col("_own")).withColumn("_all", F.sum("_own").over(W.partitionBy(*group)))
    return dealt, sizes


def ranked(rows: DataFrame, group: list[str], order: list[str], name: str, whole: int = WHOLE) -> DataFrame:
    """``rows`` with their place (int, from 0) by ``order`` within ``group``; nulls first, ties in ``order`` in any order.

    Groups of over ``whole`` rows are dealt in ranges: a place is the rows of
    earlier ranges and the place in its own.
    """
    if largest(rows, group) <= whole:
        return rows.withColumn(name, F.row_number().over(W.partitionBy(*group).orderBy(*order)) - 1)
    dealt, sizes = _ranges(rows, group, order, F.lit(1))
    at = F.row_number().over(W.partitionBy(*group, "_part").orderBy(*order)) - 1
    keys = [F.col(g).alias(f"_{g}") for g in group]
    same = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group]
    on = sizes.select(*keys, F.col("_part").alias("_p"), "_before")
    out = dealt.withColumn("_at", at).join(on, [*same, F.col("_part") == F.col("_p")])
    return out.select(*rows.columns, (F.col("_before") + F.col("_at")).cast("int").alias(name))


def percentiles(values: DataFrame, group: list[str], shares: Sequence[float], whole: int = WHOLE, size: int | None = None) -> DataFrame:
    """``values(*group, x)`` to ``(*group, p)``: exact percentiles with linear interpolation, an array in the order of ``shares``.

    Groups of nulls only get a null array; groups without rows are absent.
    Where a group has over ``whole`` rows (``size``: the largest one's, if known), equal values are counted first and
    dealt in ranges by value; running counts of whole ranges tell which hold
    the wanted places, and only those (two a share and group at most) are sorted.
    """
    if (largest(values, group) if size is None else size) <= whole:
        return values.groupBy(*group).agg(F.percentile("x", F.array(*[F.lit(float(s)) for s in shares])).alias("p"))
    counts = values.where("x is not null").groupBy(*group, F.col("x").cast("double").alias("x")).agg(F.count("*").alias("_n"))
    dealt, sizes = _ranges(counts, group, ["x"], F.col("_n"))
    keys = [F.col(g).alias(f"_{g}") for g in group]
    same = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group]
    place = F.explode(F.array(*[F.struct(F.lit(i).alias("_i"), (F.lit(float(s)) * (F.col("_all") - 1)).alias("_at")) for i, s in enumerate(shares)]))
    ends = F.explode(F.array(F.struct(F.floor("_at").alias("_r"), F.lit(False).alias("_up")), F.struct(F.ceil("_at").alias("_r"), F.lit(True).alias("_up"))))
    want = sizes.withColumn("_w", place).select(*group, "_part", "_before", "_own", "_w.*").withColumn("_e", ends).select(*group, "_part", "_before", "_own", "_i", "_at", "_e.*")
    want = cut(want.where("_r >= _before and _r < _before + _own").select(*keys, F.col("_part").alias("_p"), "_before", "_i", "_at", "_r", "_up"))
    parts = want.select(*[f"_{g}" for g in group], "_p", "_before").distinct()
    line = W.partitionBy(*group, "_part").orderBy("x")
    run = dealt.join(parts, [*same, F.col("_part") == F.col("_p")]).select(*group, "_part", "x", "_n", "_before").withColumn("_to", F.col("_before") + F.sum("_n").over(line))
    got = run.drop("_before").join(want, [*same, F.col("_part") == F.col("_p"), F.col("_r") < F.col("_to"), F.col("_r") >= F.col("_to") - F.col("_n")])
    low, high = F.max(F.when(~F.col("_up"), F.col("x"))), F.max(F.when(F.col("_up"), F.col("x")))
    at, lower = F.first("_at"), F.floor(F.first("_at"))
    value = F.when(low == high, low).otherwise((lower + 1 - at) * low + (at - lower) * high)
    each = got.groupBy(*group, "_i").agg(value.alias("v"))
    found = each.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "v"))), lambda s: s["v"]).alias("p"))
    all_ = values.select(*keys).distinct()
    return all_.join(found, same, "left").select(*[F.col(f"_{g}").alias(g) for g in group], "p")


def rank_error(k: int) -> float:
    """The rank error that a sketch of size ``k`` keeps in 99 of 100 cases, as a share of the values."""
    return 2.296 / k**0.9723


def sketches(values: DataFrame, group: list[str], k: int = 400) -> DataFrame:
    """``values(*group, x)`` to one quantile sketch (KLL) for each group: (*group, sketch).

    One pass, of bounded memory in a group of any size; nulls do not count.
    """
    return values.where("x is not null").groupBy(*group).agg(F.kll_sketch_agg_double(F.col("x").cast("double"), F.lit(k)).alias("sketch"))


def merged(parts: DataFrame, group: list[str]) -> DataFrame:
    """Sketches of parts, as stored from earlier runs, to one for each group."""
    return parts.groupBy(*group).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_percentiles(values: DataFrame, group: list[str], shares: Sequence[float], k: int = 400) -> DataFrame:
    """``percentiles`` within ``rank_error(k)`` of the wanted ranks, in one pass: (*group, p).

    Values are some of the group's own, not interpolated.  For displays; the
    exact operator stays the default everywhere.
    """
    p = F.array(*[F.kll_sketch_get_quantile_double("sketch", F.lit(float(s))) for s in shares])
    return sketches(values, group, k).select(*group, p.alias("p"))
