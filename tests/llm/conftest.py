import random

import pytest

#: names that the operators use inside; an extra column of such a name must do no harm
CLASHES = ("id", "size", "fingerprint", "score", "bucket", "key", "kind", "label", "words", "_text", "_id", "sid", "h")


@pytest.fixture(scope="session")
def corpus(spark):
    """Makes a table of documents of (doc_id, text, lang, source) rows, with further columns of clashing names."""
    def make(rows):
        rows = [(i, t, lang, s, None if t is None else len(t), *["x"] * len(CLASHES)) for i, t, lang, s in rows]
        names = ", ".join(f"`{c}` string" for c in CLASHES)
        return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {names}")

    return make


def invented(seed, words, vocabulary=400):
    r = random.Random(seed)
    parts = [a + b for a in "ka lo mi ru te vo sa ne du pi".split() for b in "ban cor dil fen gos hul jar kit".split()]
    names = [r.choice(parts) + r.choice(parts) for _ in range(vocabulary)]
    return " ".join(r.choice(names) for _ in range(words))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and blank texts, ties, repeated rows, equal ids, a very long text, other scripts."""
    base = invented(1, 300)
    rows = [(i, invented(i + 10, 40 + 7 * i), "en", f"s{i % 4}") for i in range(24)]
    rows += [(100, None, "en", "s1"), (101, "", "en", "s1"), (102, " \t\n\x0b\f\r ", None, "s2"), (None, base, None, None),
             (None, None, None, None), (103, base, "de", None), (103, base, "de", None), (104, base, "de", "s0"),
             (105, base + " tail", "de", "s0"), (105, base.upper(), "de", "s0"), (106, "né ß 日本 😀 " * 20, "xx", "é"),
             (107, invented(5, 30_000), "en", "s0"), (108, "aaaa" * 300, "en", "s0"), (109, "a", "en", "s3"),
             (-5, base[:700], "en", "s0"), (110, "\x00nul \x00" + base[500:900], "en", "s2")]
    return rows


@pytest.fixture(scope="session")
def odd(corpus, odd_rows):
    return corpus(odd_rows)


@pytest.fixture(scope="session")
def nothing(corpus):
    return corpus([])


@pytest.fixture(scope="session")
def tiny(spark):
    """The smallest documents as (doc_id, text) pairs."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").toPandas()
