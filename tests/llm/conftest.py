import pytest

from genolith.llm.shared import ship


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empties, repeats and clashing names."""
    rows = [(1, None, "en"), (2, "", None), (None, "a b c", "en"), (3, "a b c", "en"), (3, "a b c", "en"), (4, "A b  c", None), (None, None, None), (5, "word", "fr"), (6, "  \n\t ", "fr")]
    schema = "doc_id long, text string, lang string, key string, kind string, spans string, cid long, comp long, shard int, cell int, length long, rank long"
    return spark.createDataFrame([(*r, "k", "x", "s", 1, 1, 1, 1, 1, 1) for r in rows], schema)
