import pytest
from llm_samples import SCHEMA, sample_rows


@pytest.fixture(scope="session")
def rows():
    return sample_rows()


@pytest.fixture(scope="session")
def folder(spark, rows, tmp_path_factory):
    """The sample as a documents table, with labels for some of it."""
    at = tmp_path_factory.mktemp("llm")
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{at}/documents.parquet")
    marks = [(i, 0 if (t or "").startswith("abc") or i in (7, 4) else 1, 0) for i, t, *_ in rows if i is not None]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    """Tables without rows."""
    at = tmp_path_factory.mktemp("none")
    tables = {
        "documents": SCHEMA, "labels": "doc_id long, quality int, toxic int", "embeddings": "vec_id long, embedding array<float>, label int",
        "pages": "page_id long, url string, html string",
    }
    for name, schema in tables.items():
        spark.createDataFrame([], schema).write.parquet(f"{at}/{name}.parquet")
    return str(at)
