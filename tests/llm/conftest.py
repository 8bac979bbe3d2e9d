import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, lang[, source]]) rows, with columns whose names clash with results'."""

    def docs(rows, clash=False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None if r[1] is None else len(r[1])) for r in rows]
        d = spark.createDataFrame(full, DOCS)
        if clash:
            for c in ("_k1", "_row", "n_removed", "n_lines", "kept", "class_id", "size", "target", "copy", "position", "_bad", "_id", "_v", "found"):
                d = d.selectExpr("*", f"cast(7 as int) as {c}")
        return d

    return docs


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
