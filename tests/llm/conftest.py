import pytest

ROWS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Makes a documents table from (doc_id, text) or (doc_id, text, source) rows, spread over some partitions."""

    def make(rows, schema=ROWS, partitions=3):
        full = [(*r[:2], "en", r[2] if len(r) > 2 else "src1", len(r[1] or "")) for r in rows] if schema == ROWS else rows
        return spark.createDataFrame(full, schema).repartition(partitions)

    return make
