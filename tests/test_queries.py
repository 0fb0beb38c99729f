"""Registered queries against DuckDB on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from voxelmill import catalog

SF = "/root/testdata/sf0.001"
SOME = ["flagship", "densify", "bin_volume_int", "bin_double_floor", "symmetrize_6mmm", "symmetrize_unequal_axes_m3m", "reject_outliers_mmm", "outlier_stats", "cell_from_ub", "pixel_index_grid", "frame_scan_order", "par_cell_parse", "layer_list_text", "slice_integrated_kl", "regrid_hl", "line_profile_free", "gaussian_smooth", "iso_edge_vertices", "pipeline_full", "par_search", "cell_coalesce", "layer_read", "default_slice_value", "grid_line_ends", "point_readout", "isosurface_levels", "isosurface_default", "symmetrize_full_6mmm", "reject_outliers_full_bar3m", "iso_triangles", "bricks_of_one_plane", "compressed_frame_pixels", "cbf_frame_pixels", "window_lookup", "nearest_lookup"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "supplier part orders lineitem events embeddings".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


@pytest.mark.parametrize("name", SOME)
def test_query(spark, con, name):
    a, b = catalog.QUERIES[name](spark, SF).toPandas(), con.execute(catalog.ORACLES[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (a, b))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=0, atol=2e-6)


@pytest.mark.parametrize("name", ["reject_outliers_iter2", "reject_outliers_gather_iter2", "reject_outliers_full_iter2_6mmm"])
def test_voxels_mended_to_zero_are_unmeasured_in_the_next_round(spark, tmp_path, name):
    """Small whole numbers, whose medians are often 0, against the SQL."""
    rng = np.random.default_rng(4)
    values = rng.choice([-3, -1, 1, 3], (80, 64)) * np.where(rng.random((80, 64)) < 0.15, 20, 1) * 1e-6
    table = pa.table({"vec_id": range(80), "embedding": pa.array(values.tolist(), pa.list_(pa.float32())), "label": [0] * 80})
    pq.write_table(table, tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet')")
    want = con.execute(catalog.ORACLES[name]).df()
    cols = sorted(want.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (catalog.QUERIES[name](spark, str(tmp_path)).toPandas(), want))
    assert ((b["val"] == 0) & (b["replaced"] > 0)).any()
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=0, atol=2e-6)
