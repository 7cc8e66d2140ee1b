import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, set long, row string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, repeated rows, equal texts, and clashing names of columns."""
    long = "\n".join(f"word{k} another thing, stands here again. And {k * 7} more!" for k in range(6000))
    rows = [
        (1, "a quick brown fox jumps over the lazy dog again and again", "en", "s", 1, 0.5, 3, "r"),
        (2, "A quick brown fox jumps over the lazy dog again and again", None, None, None, None, None, None),
        (3, None, "en", "s", 0, 1.0, 1, "r"),
        (4, "", "en", "s", 0, 1.0, 1, "r"),
        (5, long, "en", "s", len(long), 1.0, 1, "r"),
        (6, "two  spaces \t\n and é中\U0001f600 <|endoftext|> here ", "en", "s", 1, 1.0, 1, "r"),
        (6, "two  spaces \t\n and é中\U0001f600 <|endoftext|> here ", "en", "s", 1, 1.0, 1, "r"),
        (None, "no id here at all", None, None, None, None, None, None),
        (7, "  \n\t ", "en", "s", 5, 1.0, 1, "r"),
        (8, "one", "en", "s", 3, 1.0, 1, "r"),
        (9, "é \x1c\x85 　wide   <|startoftext|>", "en", "s", 3, 1.0, 1, "r"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
