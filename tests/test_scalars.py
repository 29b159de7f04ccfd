import pytest
from pyspark.sql import functions as F

from walkloom.functions import scalars as X
from walkloom.operators import calibration as C
from walkloom.operators import joins as J


def one(spark, expr, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("z,seven,thirty", [
    (1.5, "z10", "z10"), (-1.6, "z15", "z10"), (1.0, "z05", "z10"), (0.5, "z00", "z05"),
    (0.3, "z00", "z03"), (0.29, "z00", "z00"), (0.0, "z00", "z00")])
def test_bucket_edges(spark, z, seven, thirty):
    assert one(spark, X.z_bucket7(F.col("z")), z=z) == seven
    assert one(spark, X.z_bucket30(F.col("z")), z=z) == thirty


@pytest.mark.parametrize("rev,bucket", [(-2.1, 0), (-2.0, 1), (-1.0, 2), (-0.5, 3), (0.49, 3),
                                        (0.5, 4), (1.0, 5), (2.0, 5), (9.0, 5)])
def test_reversion_buckets(spark, rev, bucket):
    assert one(spark, X.rev_bucket(F.col("r")), r=rev) == bucket
    assert one(spark, X.rev_bucket(F.lit(None).cast("double")), r=rev) == -1


def test_confidence_curve(spark):
    rate = {"z00": F.lit(0.6), "z05": F.lit(0.7), "z10": F.lit(0.75), "z15": F.lit(0.95)}
    conf = lambda z: one(spark, X.confidence7(F.col("z"), rate), z=z)
    assert conf(0.0) == 0.6 and conf(0.25) == 0.65 and conf(0.5) == 0.7
    assert conf(9.0) == 0.85
    sparse = {"z00": F.lit(0.5), "z03": F.lit(None).cast("double"), "z05": F.lit(0.6), "z10": F.lit(0.8)}
    assert one(spark, X.confidence30(F.col("z"), sparse), z=0.25) == pytest.approx(0.55)
    assert one(spark, X.confidence30(F.col("z"), sparse), z=0.75) == pytest.approx(0.7)
    assert one(spark, X.confidence30(F.col("z"), sparse), z=1.2) == pytest.approx(0.8)


def test_anchor_displacement(spark):
    disp = lambda p, c, h: one(spark, X.anchor_displacement(F.col("p"), F.col("c"), F.col("h")), p=p, c=c, h=h)
    assert disp(1, 0.54, 30) == 0.0
    assert disp(1, 1.0, 7) == pytest.approx(0.0161)
    assert disp(0, 0.7, 28) == pytest.approx(-0.0161 * 0.4 * 2)
    assert one(spark, X.anchor_displacement(F.lit(None).cast("int"), F.col("c"), F.lit(7)), c=0.9) == 0.0


def test_lexicon_counts_whole_words(spark):
    score = lambda t: one(spark, X.lexicon_score(F.col("t"), ["rise", "deal"], ["war", "deal"]), t=t)
    assert score("Rise rise WAR x") == pytest.approx(0.25)
    assert score("warfare arise") == 0.0
    assert score("deal, deal") == 0.0
    assert score("123 -- 456") == 0.0


def test_feed_dates(spark):
    run = F.lit("2020-02-02").cast("date")
    parse = lambda t: str(one(spark, X.parse_feed_date(F.col("t"), run), t=t))
    assert parse("Mon, 05 Jan 2015 10:11:12 GMT") == "2015-01-05"
    assert parse("2015-01-06T10:11:12") == "2015-01-06"
    assert parse(" 2015-01-07 ") == "2015-01-07"
    assert parse("yesterday") == "2020-02-02"


def test_ternary_boundary_is_flat(spark):
    assert one(spark, X.ternary_label(F.col("r")), r=0.01) == 0
    assert one(spark, X.ternary_label(F.col("r")), r=-0.0101) == -1


RATE = "series_id string, horizon int, bucket string, hits bigint, n bigint, rate double"


def pooled(spark, cells):
    df = spark.createDataFrame([("s", 7, b, h, n, r) for b, h, n, r in cells], RATE)
    return {r["bucket"]: r["rate"] for r in C.pool_monotonic(df).collect()}


def test_pooling_merges_indistinguishable_neighbours(spark):
    out = pooled(spark, [("z00", 60, 100, .6), ("z05", 58, 100, .58), ("z10", 70, 100, .7), ("z15", 75, 100, .75)])
    assert out == {"z00": .59, "z05": .59, "z10": .7, "z15": .75}


def test_pooling_keeps_real_differences_and_small_samples(spark):
    out = pooled(spark, [("z00", 900, 1000, .9), ("z05", 500, 1000, .5), ("z10", 5, 10, .65), ("z15", 80, 100, .8)])
    assert out == {"z00": .9, "z05": .5, "z10": .65, "z15": .8}


def test_measured_needs_twenty_cases(spark):
    df = spark.createDataFrame([("s", 7, "z15", 15, 20), ("s", 7, "z10", 15, 19)],
                               "series_id string, horizon int, bucket string, hits bigint, n bigint")
    got = {r["bucket"]: r["rate"] for r in J.measured_or_default(
        df, C.default_rates(spark), ["horizon", "bucket"]).collect()}
    assert got == {"z15": 0.75, "z10": 0.72}
