import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (id, text) pairs, with the columns of the documents table and clashing ones."""
    def build(rows, extra=False):
        full = [(i, t, None, "s", None if t is None else len(t)) for i, t in rows]
        docs = spark.createDataFrame(full, SCHEMA)
        if extra:
            for name in ("kept", "n", "length", "words", "spans", "component", "lang_pred", "_text", "digest", "hash", "signature", "node"):
                docs = docs.selectExpr("*", f"'x' AS `{name}`")
        return docs

    return build
