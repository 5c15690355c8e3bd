import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def table(spark):
    def make(texts, repeat=()):
        """documents with these texts, ids from 0, and further rows that repeat those at the given places."""
        rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows + [rows[i] for i in repeat], SCHEMA)

    return make


#: Columns whose names the operators use inside themselves.
CLASHING = ("row", "node", "fp", "digest", "h", "kept", "length", "rank", "_found", "best", "score", "component", "copies")


@pytest.fixture
def clash():
    """A frame with further columns whose names operators use inside."""
    return lambda df: df.withColumns({c: F.lit("x") for c in CLASHING})
