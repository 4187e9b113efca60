import pytest


@pytest.fixture
def make(spark):
    """make(schema, rows): a table from rows."""
    def f(schema, rows):
        return spark.createDataFrame(rows, schema)
    return f


#: Cases that every operator on documents meets: NULLs, empty and long texts, ties, repeated rows.
ODD_TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "Ünïcode — 日本語 \U0001f600 ß\x00\x1f"), (None, "no id at all"),
    (7, "same row"), (7, "same row"), (8, "a\\b </s>[INST] <|endoftext|> x"), (9, "word " * 30000), (9, "other text"),
    (10, "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" Released under the MIT License."),
]
#: documents with columns whose names clash with the operators' own.
ODD_SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, ids string, kept string, node string, "
              "range string, score string, spans string, form string, `which` string")


@pytest.fixture
def odd(make):
    rows = [(i, t, ["en", "xx", None][k % 3], "s", None if t is None else len(t), *["x"] * 8)
            for k, (i, t) in enumerate(ODD_TEXTS)]
    return make(ODD_SCHEMA, rows)


@pytest.fixture
def none(make):
    return make(ODD_SCHEMA, [])
