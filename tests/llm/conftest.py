import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id string, shard string, h int"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from texts: ids from 0 (or given), and extra columns whose names the operators use inside."""

    def make(texts, langs=None, ids=None):
        ids = list(range(len(texts))) if ids is None else ids
        langs = langs or ["en"] * len(texts)
        rows = [(i, t, lang, "s", len(t or ""), "x", "y", 1) for i, t, lang in zip(ids, texts, langs)]
        return spark.createDataFrame(rows, COLUMNS)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    long = " ".join(f"w{i}" for i in range(30_000))
    return [
        None,
        "",
        " ",
        "one",
        "one",
        "\n\n",
        "é ß 日本語 😀",
        "a  b\tc ",
        long,
        long + " end",
        "x" * 5000,
        "▁mark ▁",
        "!!! ???",
        "\x00\x01",
        "The the THE",
    ]
