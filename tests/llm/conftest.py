import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) pairs, in the columns of the table."""

    def build(pairs):
        return spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t)) for i, t in pairs], DOC)

    return build


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two"), (5, "one two"), (None, "no id here"), (6, "a b c d " * 20000), (7, None)]
