import pytest
from pyspark.sql import SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark: SparkSession):
    """(doc_id, text[, source]) rows as documents, with columns whose names clash."""

    def make(rows, extra=True):
        df = spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "web", len(r[1] or "")) for r in rows], DOCS)
        if extra:
            for name in ("_key", "component", "fp", "_text", "words", "n", "bucket", "id", "vec", "rank", "token", "held", "score"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return make
