import pytest


@pytest.fixture(scope="session")
def table_of(spark):
    """A table of documents with a clashing and a nested extra column, from (doc_id, text) or (doc_id, text, lang, source) rows."""
    def build(rows, ids="long"):
        full = [(*r, *[None] * (4 - len(r)), 1, {"digest": "x"}) for r in rows]
        return spark.createDataFrame(full, f"doc_id {ids}, text string, lang string, source string, node long, digest map<string,string>")
    return build


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
