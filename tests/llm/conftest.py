import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("size", T.StringType()), T.StructField("h", T.LongType()), T.StructField("kept", T.StringType())])


def some_texts() -> list[tuple]:
    """Documents with nulls, blanks, copies, near copies, passages, a very long text and repeated words."""
    rng = random.Random(5)
    words = ["".join(rng.choice("aeiounrst") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = prose(120), prose(60)
    texts = [None, "", "   ", "\n\n", "one", "One  two", base, base, base.upper(), base.replace(base.split()[50], "zzz", 1), " ".join(base.split()[:110])]
    texts += [f"{prose(30)}. {passage} {prose(20)}" for _ in range(4)] + [f"{prose(25)}\n{passage}\n{prose(10)}" for _ in range(3)]
    texts += ["la la la la la la la la la la la la la", "Ünïcödé ßtraße " * 9, "日本語 " * 30, prose(4000), "x" * 300, "<|endoftext|> and 'tis  it's\ttabbed"]
    texts += [f"{prose(40)}\nAll rights reserved by all of them.\n{prose(12)}" for _ in range(24)]
    texts += [prose(rng.randint(5, 80)) for _ in range(20)]
    return [(i * 7 % 101, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def edge_rows():
    rows = [(i, t, [None, "en", "de"][i % 3], None if i % 11 == 0 else f"s{i % 13:02d}") for i, t in some_texts()]
    return [(i, t, la, s, len(t or ""), "clash", 1, "clash") for i, t, la, s in rows]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def odd_docs(spark, edge_rows):
    """The same with a null id and with repeated rows."""
    row = edge_rows[6]
    return spark.createDataFrame([*edge_rows, row, row, (None, *row[1:])], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
