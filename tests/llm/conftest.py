import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans string, n_words long"


def make_docs(spark, texts, **more):
    """Documents with extra columns whose names clash with those the operators add."""
    rows = [(more.get("ids", range(len(texts)))[i], t, "en", f"s{i % 2}", 0, "x", -1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture
def docs_of(spark):
    return lambda texts, **more: make_docs(spark, texts, **more)
