import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    def make(texts, langs=None, sources=None, ids=None):
        rows = [
            (i if ids is None else ids[i], t, langs[i] if langs else "en", sources[i] if sources else "s", None if t is None else len(t))
            for i, t in enumerate(texts)
        ]
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture
def sentence():
    import random

    def make(seed, n=60, words=400):
        r = random.Random(seed)
        return " ".join(f"w{r.randrange(words)}" for _ in range(n))

    return make
