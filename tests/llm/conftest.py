import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"

LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(6000))
PASSAGE = " ".join(f"shared{k}" for k in range(40))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, shared passages."""
    texts = [
        (1, "Ein Text mit  fünf Wörtern\tund mehr.", "de", "a"),
        (2, "Ein Text mit fünf Wörtern und mehr.", "de", None),
        (3, None, None, "a"),
        (4, "", "en", "a"),
        (5, LONG, "en", "b"),
        (6, LONG + " end", "en", "b"),
        (7, f"before {PASSAGE} after one", "en", "b"),
        (8, f"{PASSAGE} {PASSAGE}", None, "b"),
        (9, " \n\t ", "en", "c"),
        (10, "word " * 30, "en", "c"),
        (11, "it's <|endoftext|> a TEST's 12 ½ 日本 é́ 😀", "en", "c"),
        (11, "it's <|endoftext|> a TEST's 12 ½ 日本 é́ 😀", "en", "c"),
        (12, "other text of the same id as the next", "en", "c"),
        (12, "another text of the same id", "en", "c"),
        (None, f"no id but {PASSAGE}", "en", "c"),
        (13, "it’s " + PASSAGE.upper(), "fr", "d"),
    ]
    rows = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in texts]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)
