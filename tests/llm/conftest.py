import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    def build(rows, extra=""):
        """Documents of (doc_id, text); with clashing extra columns on request."""
        full = [(i, t, "en", "s", len(t or "")) for i, t in rows]
        if extra:
            return spark.createDataFrame([(*r, "x") for r in full], f"{DOCS}, {extra} string")
        return spark.createDataFrame(full, DOCS)

    return build


def rows_of(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


@pytest.fixture(scope="session")
def rows():
    return rows_of


@pytest.fixture(scope="session")
def table(spark, request):
    def read(name, sf="sf0.01"):
        return spark.read.parquet(f"/root/testdata/{sf}/{name}.parquet")

    return read
