"""Raster and depth queries against their SQL where the table ends inside a field."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))
from check_oracles import compare  # noqa: E402

DEPTH = ("c02_project_z", "c04_select_active_z", "c08_check_z_windows", "b18_check_catalog")
FOCAL = (
    "d01_gaussian", "d04_white_tophat", "d05_gradient_energy", "d06_ridge_response", "d07_branch_features", "d09_distance_to",
    "d09_inside_distance", "d10_nearest_label", "d12_shell", "b05_structural_map", "b09_threshold_sauvola",
)


@pytest.fixture(scope="module")
def cut(spark, tmp_path_factory):
    """82 vectors: a field of 50 rows and one of 32, three stacks of 25 planes and one of 7."""
    folder = str(tmp_path_factory.mktemp("cut"))
    v = np.random.default_rng(5).normal(0.0, 0.13, (82, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in r], 0) for i, r in enumerate(v)], "vec_id bigint, embedding array<float>, label int")
    df.write.parquet(f"{folder}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    return folder, con


@pytest.mark.parametrize("name", [*DEPTH, *FOCAL])
def test_cut_field_equals_sql(spark, cut, name):
    assert compare(spark, cut[1], cut[0], name)[0].startswith("ok")
