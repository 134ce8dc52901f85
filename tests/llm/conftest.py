import pytest

from weekcast.llm.common import read_table

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture
def docs_of(spark):
    """A documents frame with clashing extra columns from texts (or (id, text) pairs)."""

    def build(texts, start=0):
        rows = [t if isinstance(t, tuple) else (start + i, t) for i, t in enumerate(texts)]
        extra = "lang string, source string, n_chars long, fp long, cell long, u long, part long, length long"
        return spark.createDataFrame([(i, t, None, "src0", None, 1, 2, 3, 4, 5) for i, t in rows], f"doc_id long, text string, {extra}")

    return build


@pytest.fixture(scope="session")
def documents(spark):
    return read_table(spark, SF_SMALL, "documents")
