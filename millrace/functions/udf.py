"""Functions of one's own for what has no built-in form, over Arrow batches, and their names in SQL."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def shout(texts: pd.Series) -> pd.Series:
    """Texts with a capital first letter and a mark at the end."""
    return texts.str.slice(0, 1).str.upper() + texts.str.slice(1) + "!"


@F.pandas_udf(T.DoubleType())
def exp_mean(sums: pd.Series, numbers: pd.Series) -> float:
    """exp of the mean, from partial sums and counts."""
    return math.exp(sums.sum() / numbers.sum())


@F.udtf(returnType=T.StructType([T.StructField("piece", T.StringType())]))
class Pieces:
    """A row for each piece of a text between separators; none for a null."""

    def eval(self, text: str, between: str) -> Iterator[tuple[str]]:
        if text is not None:
            for piece in text.split(between):
                yield (piece,)


def register(spark: SparkSession) -> None:
    """Names the functions in SQL: millrace_shout, millrace_pieces."""
    spark.udf.register("millrace_shout", shout)
    spark.udtf.register("millrace_pieces", Pieces)
