import pytest
import public_tokenizers


@pytest.fixture(scope="session")
def tokenizer():
    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture
def documents(spark):
    """A maker of document tables with an extra column of a clashing name."""

    def make(*rows):
        """Rows ``(doc_id, text)`` or ``(doc_id, text, lang)``."""
        full = [(*r, None)[:3] for r in rows]
        df = spark.createDataFrame(full, "doc_id bigint, text string, lang string")
        return df.selectExpr("*", "'x' AS source", "1L AS n", "'y' AS node", "2 AS score", "3L AS row")

    return make
