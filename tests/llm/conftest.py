import pytest

#: Rows that every operator must survive: nulls, empty and long texts, ties,
#: repeated rows, and extra columns whose names clash with internal ones.
AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog again and again today", "en", "h", 1),
    (1, "The quick brown fox jumps over the lazy dog again and again today", "en", "h", 1),
    (2, "The quick  brown fox jumps over the lazy dog again and again\ttoday", None, "fp", 2),
    (3, None, None, None, None),
    (4, "", "en", "x", 0),
    (5, " \t\n ", "de", "uid", 3),
    (None, "null id", "en", "id", 7),
    (6, "ein Wort ßäü € 漢字 <|endoftext|> tail", "de", "n", 9),
    (7, "x" * 30_000 + " long " * 2000, "en", "u", 5),
    (8, "'re 's  \n\n \x85 \xa0 1234 !!! ??", "fr", "k", 2),
]
SCHEMA = "doc_id long, text string, lang string, h string, n long"


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def vocab():
    import public_tokenizers
    return public_tokenizers.path
