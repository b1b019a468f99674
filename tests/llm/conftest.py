import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, row_key long, row_text string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table from (doc_id, text) or (doc_id, text, lang) rows, with extra columns of clashing names."""

    def make(rows, parts=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, None if r[1] is None else len(r[1]), 7, "clash") for r in rows]
        return spark.createDataFrame(full, DOC).repartition(parts)

    return make


ODD = [(1, None), (2, ""), (None, "a null id. it has two sentences here, and then some more words follow."), (3, "  \n\t "), (4, "!!! ... ???"), (5, "é\x00ü 🙂"), (6, "word"), (6, "word")]


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls, empty and repeated rows, and one very long text."""
    return make_docs([*ODD, (7, "long words here. " * 40_000)])
