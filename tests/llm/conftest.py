import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) pairs, with extra columns of names that operators use themselves."""

    def make(rows, extra=True):
        df = spark.createDataFrame([(i, t, "en", "s0", len(t or "")) for i, t in rows], SCHEMA)
        if extra:
            for name in ("fp", "component", "x", "score", "t", "th", "gone", "n_tokens", "w", "at", "keep"):
                df = df.selectExpr("*", f"'clash' AS {name}")
        return df

    return make
