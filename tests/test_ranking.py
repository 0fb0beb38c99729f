"""Places and percentiles of large groups against those of whole ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelmill.operators import ranking


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(3)
    # a hot group, one with a single value many times, small ones, a null key, nulls only, infinities
    rows = [(1, float(x)) for x in np.round(rng.normal(0, 3, 3000), 2)] + [(2, 7.5)] * 800 + [(3, 1.0), (3, None)] + [(None, float(x)) for x in range(11)]
    rows += [(4, None)] + [(5, 2.0)] * 50 + [(5, x) for x in (-1.0, float("inf"), float("-inf"), 0.0, -0.0)] + [(6, float(2**60)), (6, 1e-300)]
    return spark.createDataFrame(rows, "vol long, x double").repartition(7).cache()


def test_percentiles_of_large_groups(spark, values):
    shares = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]
    a, b = ({r.vol: r.p for r in ranking.percentiles(values, ["vol"], shares, whole=w).collect()} for w in (10**6, 0))
    assert a.keys() == b.keys() == {1, 2, 3, 4, 5, 6, None} and a[4] is None and b[4] is None
    for k, p in a.items():
        assert p == b[k] if k != 1 else np.allclose(p, b[k], atol=1e-12, rtol=0)
    x = np.array([r.x for r in values.where("vol = 1").collect()])
    assert np.allclose(b[1], np.quantile(x, shares))
    assert ranking.percentiles(values.where("vol = 99"), ["vol"], shares, whole=-1).count() == 0


def test_percentiles_of_pairs_of_columns(spark, values):
    two = values.where("x is not null").withColumn("k", F.pmod(F.floor("x"), F.lit(3)))
    a, b = (sorted(map(str, ranking.percentiles(two, ["vol", "k"], [0.5], whole=w).select("vol", "k", F.round(F.col("p")[0], 9)).collect())) for w in (10**6, 0))
    assert a == b


def test_places_of_large_groups(spark, values):
    rows = values.withColumn("id", F.monotonically_increasing_id())
    a, b = (sorted(ranking.ranked(rows, ["vol"], ["x", "id"], "at", whole=w).select("id", "at").collect()) for w in (10**6, 0))
    assert a == b and len(a) == rows.count()
    assert ranking.ranked(rows.limit(0), ["vol"], ["x"], "at", whole=-1).count() == 0
