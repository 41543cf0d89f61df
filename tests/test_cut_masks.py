"""Mask, window and candidate queries against their SQL where the table ends inside a field or has holes."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from test_cut_fields import compare, cut  # noqa: F401

NAMES = (
    "g02_fill_holes", "g02_remove_small_holes", "g07_refine_fused", "e03_thickness",
    "h05_near_duplicate_clusters", "h06_family_balance_weights", "e10_measurement_window_qc",
)


@pytest.fixture(scope="module")
def gaps(spark, tmp_path_factory):
    """A field of 50 rows without rows 18 to 22, one without rows 6 and 7 that ends with row 31."""
    folder = str(tmp_path_factory.mktemp("gaps"))
    v = np.random.default_rng(6).normal(0.0, 0.13, (82, 64)).astype(np.float32)
    ids = [i for i in range(82) if i not in (18, 19, 20, 21, 22, 56, 57)]
    df = spark.createDataFrame([(i, [float(x) for x in v[i]], 0) for i in ids], "vec_id bigint, embedding array<float>, label int")
    df.write.parquet(f"{folder}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    return folder, con


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("table", ["cut", "gaps"])
def test_cut_field_equals_sql(spark, request, table, name):
    folder, con = request.getfixturevalue(table)
    assert compare(spark, con, folder, name)[0].startswith("ok")
