import pytest


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text, lang, source), with the columns of the table."""

    def made(*rows, extra=""):
        kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint" + extra
        return spark.createDataFrame([(*r, *[None] * (4 - len(r)), len(r[1]) if r[1] is not None else None, *["x"] * extra.count(",")) for r in rows], kinds)

    return made


#: Texts that every operator must take: null, empty, blank, symbols, repeats, very long, and of other scripts.
ODD = [(1, None), (2, ""), (3, " \n\t\n "), (4, "a"), (5, "### $$$ |||"), (6, "word " * 30_000), (7, "x" * 60_000), (8, "Ünïcödé 漢字    emoji 😀😀 end"), (9, "a"), (9, "a"), (None, "a b c d e f"), (10, "one two three four five six seven eight nine ten eleven twelve"), (11, "one two three four five six seven eight nine ten eleven twelve")]


@pytest.fixture(scope="session")
def odd_texts():
    return ODD


@pytest.fixture
def odd(docs):
    return docs(*[(i, t, None, None) for i, t in ODD], extra=", fp string, score string, rank string, copies string, kept string, _row string")


@pytest.fixture
def none(docs):
    return docs((1, "a", "en", "s")).where("doc_id < 0")
