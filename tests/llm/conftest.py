import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, node long, rid long, canon string, n int, th long, shard int, place int, ids string, score double"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang) rows, with further columns whose names the operators use themselves."""

    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", None if r[1] is None else len(r[1]), "h", 1, 2, "c", 3, 4, 5, 6, "i", 0.5) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build


ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "Same text here, with a few more words to it."), (6, "Same text here, with a few more words to it."), (6, "Same text here, with a few more words to it."),
    (None, "no id at all but words enough for shingles"), (7, "é ＡＢＣ ﬁ ß   日本語 \U0001f600"), (8, "x" * 50_000), (9, "long words " * 20_000),
]


@pytest.fixture(scope="session")
def odd(make):
    return make(ODD)


@pytest.fixture(scope="session")
def none(make):
    return make([(1, "a")]).where("false")
