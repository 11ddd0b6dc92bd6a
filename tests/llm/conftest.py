import pytest
from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LABELS = "doc_id bigint, quality int, toxic int"
SMALL = "/root/testdata/sf0.001"
#: Names that the operators use inside or return themselves.
CLASHING = ("kept", "score", "_id", "_text", "length", "slot", "group_size", "component_id", "x", "topic", "probability", "_n", "spans", "content")


@pytest.fixture(scope="session")
def docs_of(spark):
    """`documents` from (doc_id, text[, lang, source]) rows; `extra` adds columns with clashing names."""

    def make(rows, extra=False):
        df = spark.createDataFrame([(*(r if len(r) == 4 else (*r, "en", "s")), 0) for r in rows], DOCS)
        return df.withColumns({name: F.lit("?") for name in CLASHING}) if extra else df

    return make


@pytest.fixture(scope="session")
def texts():
    """doc_id and text of the smallest given table."""
    import duckdb

    return duckdb.connect().execute(f"SELECT doc_id, text, lang, source FROM '{SMALL}/documents.parquet'").fetchall()
