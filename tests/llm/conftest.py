import pytest

import __spark_entry__  # noqa: F401  kernels travel by value

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    def make(rows, extra=""):
        """Documents from (doc_id, text, source) rows; ``extra`` names further columns, all NULL."""
        filled = [(i, text, "en", source, None if text is None else len(text)) for i, text, source in rows]
        df = spark.createDataFrame(filled, DOCUMENT)
        for name in extra.split():
            df = df.selectExpr("*", f"cast(null as string) as {name}")
        return df

    return make
