import pytest

from stepfield.llm import common

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, score double"


@pytest.fixture
def docs(spark):
    """Edge cases: nulls, an empty text, a very long text, ties, repeated rows, columns of clashing names."""
    long = " ".join(f"word{i % 977}" for i in range(40_000))
    texts = ["Plain text here, with words.", "", None, long, "Plain text here, with words.", "one", "é ü 漢字 \U0001f600", "A\nB\n\nC", " \t\n "]
    rows = [(i, t, "en", "s", len(t or ""), "x", 0.5) for i, t in enumerate(texts)]
    rows += [rows[0], (None, "null id", None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def shared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "_local_folder", lambda: f"file://{tmp_path}")
    return tmp_path
