import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
        # Names that operators use for their own columns.
        T.StructField("size", T.StringType()), T.StructField("score", T.StringType()), T.StructField("row", T.StringType()),
        T.StructField("key", T.StringType()),
    ]
)


def words(n, start=0):
    """n different words."""
    return " ".join(f"w{start + i}" for i in range(n))


def cases():
    """Nulls, empties, repeated rows, copies, near copies, a long text, shared passages and ties."""
    passage = words(60, 5000)
    texts = [
        (0, words(40)), (1, words(40)), (2, words(40) + " other end"), (3, None), (4, ""), (5, " \n\t "), (6, "one"), (6, "one"),
        (7, words(30, 100) + " " + passage + " " + words(30, 200)), (8, words(30, 300) + " " + passage + " " + words(30, 400)),
        (9, "ä ö ü ß é " * 30), (None, words(40)), (None, None), (10, words(3000, 10_000)), (11, "line one here\n" * 9 + words(30, 700)),
        (12, "x" * 900), (13, words(40, 800)), (13, words(40, 900)),
    ]
    return [(i, t, "en", None if k % 5 == 4 else f"s{k % 3}", None if t is None else len(t), "z", "z", "z", "z") for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(cases(), DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
