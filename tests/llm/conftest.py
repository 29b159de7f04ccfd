import random

import duckdb
import pytest

from tests.conftest import spark  # noqa: F401
from tests.oracle_check import TABLES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def odd_texts():
    """Null, empty, blank, letterless, one word, and a very long text."""
    return [None, "", " \n\t ", "!!! 123 ...", "single", "äö 中文 \x00 tail", "long " * 60_000]


def odd_documents(spark, extra=()):
    """Odd texts with null ids, sources and languages, repeated rows, and columns whose names the
    operators use themselves."""
    rows = [(i, t, None, None, None) for i, t in enumerate(odd_texts())]
    rows += [(None, "no id here", "en", "s", 1), (None, None, None, None, None), (50, "same row", "en", "s", 1),
             (50, "same row", "en", "s", 1), (50, "same id, other text", "en", "s", 1), *extra]
    clash = ["score", "predicted", "size", "copies", "copy", "_row", "_t", "_h", "_d", "_gone", "taken", "kept",
             "labels", "n_words", "lang_pred", "target", "_source", "rep", "a", "b"]
    df = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F
    return df.select("*", *[F.lit(f"mine-{c}").alias(c) for c in clash]), clash


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def rng():
    return random.Random(11)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con
