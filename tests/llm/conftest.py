import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])

PROSE = "the quick brown fox jumps over the lazy dog while many small birds sing in the old green tree near a quiet river and nobody minds the gentle rain"


def _words(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def words():
    return _words


@pytest.fixture(scope="session")
def corpus():
    """Small rows with nulls, empty and odd texts, ties, copies, a long text, repeated passages and repeated rows."""
    passage = _words(1, 60)
    rows = [
        (1, PROSE, "en", "a"), (2, PROSE + " end", "en", "a"), (3, PROSE, "en", "b"), (4, None, "en", None), (5, "", None, "b"),
        (6, " \t\n ", "de", "c"), (7, "one two three", "de", "c"), (8, _words(2, 40) + " " + passage + " " + _words(3, 30), "fr", "a"),
        (9, passage + "\n" + _words(4, 50), "fr", "b"), (10, _words(5, 20_000), "en", "a"), (11, _words(6, 30) + "\n" + passage, None, None),
        (12, "same line here\n" * 30, "en", "d"), (13, "été ÀÉ ñ <|endoftext|>   x́ Ǆ 中文 12345 it's", "es", "d"), (14, "a" * 400, "en", "d"),
        (15, PROSE.upper(), "en", "c"), (16, "### *** || && $$ %% " * 20, "en", "c"), (1, PROSE, "en", "a"), (17, "x " * 100, "en", "a"), (-5, PROSE + " end", "en", "b"),
    ]
    return [(i, t, l, s, len(t or "")) for i, t, l, s in rows]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark, corpus):
    """Null ids, and extra columns named like those that operators make."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(None, PROSE, "en", "a", 1), (None, None, None, None, None), *corpus[:9]], SCHEMA)
    for name in ("chunk", "bits", "bucket", "ledger", "copies", "size", "rate", "taken", "first_id", "mixed_id", "mixed_times", "step", "kept", "u", "v"):
        df = df.withColumn(name, F.lit(name))
    return df
