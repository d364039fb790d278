import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_tokens string, p string, steps string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids and texts, an empty and a long text, ties, repeated rows, columns with clashing names."""
    words = "the quick brown fox of a lazy dog and its friends was here for the day"
    rows = [
        (1, words, "en", "s0"),
        (1, words, "en", "s0"),
        (2, words, None, None),
        (3, None, "en", "s0"),
        (None, words + " again", "fr", "s1"),
        (None, None, None, None),
        (4, "", "fr", "s1"),
        (5, "... !!!\n\n \t", "fr", "s1"),
        (6, "\n".join(f"{words} {i}" for i in range(3000)), "en", "s0"),
        (6, "another text of the same id", "en", "s0"),
    ]
    rows = [(*r, None if r[1] is None else len(r[1]), "x", "y", "z") for r in rows]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


@pytest.fixture
def rows_at(spark):
    """The rows of a query, in order, under some number of shuffle partitions."""

    def rows(partitions, make):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        try:
            return sorted(map(tuple, make().collect()), key=repr)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)

    return rows
