import pytest

#: doc_id, text, lang, source, n_chars, and columns whose names the operators use themselves.
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, n int, text_hash string, shard string, __id int, __text string, score string, accepted string, held_out string, component_id string"


@pytest.fixture(scope="session")
def nasty(spark):
    """Nulls, empty and blank texts, a very long one, repeated rows, one id with two texts, signs beyond the basic plane."""
    prose = "the quick brown fox jumps over the lazy dog while the old man reads his paper in the garden of the house "
    texts = [
        (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, prose * 2), (5, prose * 2), (6, prose * 2), (7, "Ünïcödé ǅ ſtraße İstanbul \U0001f600\U0001f600   end"), (8, prose * 4000), (None, "no id at all"), (None, None),
        (9, "one"), (9, "two"), (10, "x" * 5000), (11, "\n".join(["same line here now ok"] * 5)), (12, prose[:-1].upper()), (13, "a" * 199), (14, "a" * 401), (15, "\x1c\x1d\x85\xa0 nbsp \x0b vt"),
    ]
    rows = [(i, t, None if k % 5 == 0 else ("en", "fr")[k % 2], None, None, k, "key", None, "h", "s", None, None, "x", "y", "z", "c") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
