import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    rows = [
        (1, "one two three four five six seven eight nine ten eleven twelve", "en", "a"), (1, "one two three four five six seven eight nine ten eleven twelve", "en", "a"),
        (2, "one two three four five six seven eight nine ten eleven twelve", None, None), (3, None, "en", "a"), (4, "", None, "b"), (None, "no id here at all but some words", "en", None),
        (5, " \n\t ", "de", "b"), (6, long, "en", "a"), (7, "z" * 5000, "en", "c"), (8, "é ü\x85x \x1c y", "fr", "c"), (None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    names = "key node fp h kept score batch item n doc rows picked bad row own _doc _rows _bad _spans _keepers _words_cut spans keepers words_cut first root".split()
    for extra in names:
        df = df.withColumn(extra, F.lit("x"))
    return df


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
