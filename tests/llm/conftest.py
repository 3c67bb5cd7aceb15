import pyarrow.parquet as pq
import pytest


@pytest.fixture(scope="session")
def documents(small):
    return pq.read_table(f"{small}/documents.parquet").to_pylist()


#: doc_id, text, and columns whose names clash with those that operators make.
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, score double, node string, digest string, _file string, _row long, shard int"


@pytest.fixture
def frame(spark):
    """Documents from (id, text[, source]) with extra columns of clashing names."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 0.5, "n", "d", "f", 1, 2) for r in rows]
        return spark.createDataFrame(full, EXTRA)

    return make
