import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) pairs, with columns of clashing names on request."""

    def make(pairs, **extra):
        rows = [(i, t, "en", f"s{(i or 0) % 3}", None if t is None else len(t), *extra.values()) for i, t in pairs]
        kinds = "".join(f", {k} string" for k in extra)
        return spark.createDataFrame(rows, DOCS + kinds)

    return make


def words(rng, n, vocabulary=5000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))
