import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text) rows, with the other columns of the table and columns whose names may clash."""

    def make(rows, extra=False):
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        if not extra:
            return df
        return df.selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "cast(length(text) as bigint) as n_chars", "1 as id", "2 as n", "3 as key", "4 as p", "5 as h", "'x' as line")

    return make
