import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table from (doc_id, text) pairs, with extra columns whose names operators use inside."""

    def make(rows, extra=True):
        df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)
        for name in ("score", "digest", "ids", "size", "key", "shard", "class_id", "fold", "bucket", "p_toxic", "turn") if extra else ():
            df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, ties, repeated rows, a repeated and a missing doc_id, a very long text, other scripts."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(200_000))
    return [(0, None), (1, ""), (2, "   \n "), (3, "one"), (4, "one"), (5, "Ünïcödé 日本語 😀 ½ <|endoftext|> İ Σς"), (6, long), (6, long), (7, "a\x1cb\x00c"), (8, "x" * 70_000), (None, "no id at all"), (9, "same id"), (9, "another text of the same id")]


@pytest.fixture(scope="session")
def prose():
    """Distinct texts of random words, by seed."""

    def make(n, words=120, seed=0):
        r = random.Random(seed)
        vocabulary = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(3000)]
        return [" ".join(r.choice(vocabulary) for _ in range(words)) for _ in range(n)]

    return make
