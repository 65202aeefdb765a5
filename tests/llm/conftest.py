import pytest

FOLDER = "/root/testdata/sf0.001"
#: Names that the operators use inside, to clash with.
EXTRA = "digest key bucket host page_key drops kept score row_id u size fp text_key n_hit_words dropped_lines spans items html found"


@pytest.fixture(scope="session")
def documents(spark):
    """Nulls, blanks, a very long text, ties, repeated rows and columns with clashing names."""
    words = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [
        (1, "alpha beta gamma delta epsilon zeta", "en", "a"), (2, "alpha beta gamma delta epsilon zeta", "en", "b"), (3, None, None, None), (4, "", "en", "a"),
        (None, "only null id", "en", "a"), (5, words, "en", "b"), (6, "x", None, None), (6, "x", None, None), (7, " \t\n ", "de", "c"), (None, "only null id", "en", "c"),
        (8, "Ünï cödé   text\nshared line\nlast", "de", "a"), (9, "shared line\nother", "de", "a"),
    ]
    extra = EXTRA.split()
    full = [(*r, None if r[1] is None else len(r[1]), *[f"e{i}" for i in range(len(extra))]) for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra)
    return spark.createDataFrame(full, schema)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.read.parquet(f"{FOLDER}/benchmark.parquet")
