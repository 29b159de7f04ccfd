"""Scalar expressions: buckets, confidence curves, tiers, displacement, text scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from walkloom import params as P


def clip(x: Column, lo: float, hi: float) -> Column:
    """Null-safe clip (greatest/least would skip a NULL argument)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def safe_div(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def spread(market: Column, official: Column) -> Column:
    """ln(market) - ln(official), only where the market price is positive."""
    return F.when(market > 0, F.log(market) - F.log(official))


def intraday_range(close: Column, high: Column, low: Column) -> Column:
    """(high - low) / close, NULL when any of the three is missing or zero."""
    usable = (close != 0) & (high != 0) & (low != 0)
    return F.when(usable, (high - low) / close)


def z_bucket7(z: Column) -> Column:
    """Exclusive |z| bins with strict lower edges."""
    az = F.abs(z)
    return (F.when(az > 1.5, "z15").when(az > 1.0, "z10").when(az > 0.5, "z05")
            .when(az.isNotNull(), "z00"))


def z_bucket30(z: Column) -> Column:
    """|z| bins with inclusive lower edges."""
    az = F.abs(z)
    return (F.when(az >= 1.0, "z10").when(az >= 0.5, "z05").when(az >= 0.3, "z03")
            .when(az.isNotNull(), "z00"))


def rev_bucket(rev: Column) -> Column:
    """Seven left-closed reversion bins folded onto six ids; -1 marks a missing value.

    Bin 2 is [-1, -.5), bin 3 is [-.5, .5), bin 4 is [.5, 1); both bins from 1
    upwards share id 5.
    """
    return (F.when(rev.isNull(), -1)
            .when(rev < -2.0, 0).when(rev < -1.0, 1).when(rev < -0.5, 2)
            .when(rev < 0.5, 3).when(rev < 1.0, 4).otherwise(5))


def rev_bucket_name(bucket: Column) -> Column:
    names = F.array(*[F.lit(n) for n in P.REV_BUCKETS])
    return F.when(bucket >= 0, F.element_at(names, bucket + 1))


def sign_of(x: Column) -> Column:
    return F.when(x > 0, 1).when(x < 0, -1).when(x == 0, 0)


def curve(az: Column, knots: list[tuple[float, Column]]) -> Column:
    """Piecewise-linear curve through the knots, flat outside them."""
    first_x, first_y = knots[0]
    out = F.when(az <= first_x, first_y)
    for (x0, y0), (x1, y1) in zip(knots, knots[1:]):
        out = out.when(az < x1, y0 + (y1 - y0) * (az - x0) / (x1 - x0))
    return out.when(az.isNotNull(), knots[-1][1])


def confidence7(az: Column, rate: dict[str, Column]) -> Column:
    """Confidence from the four |z| bucket rates, clamped to [.5, .85], 3 digits."""
    knots = [(0.0, rate["z00"]), (0.5, rate["z05"]), (1.0, rate["z10"]), (1.5, rate["z15"])]
    return F.round(clip(curve(az, knots), 0.5, 0.85), 3)


def confidence30(az: Column, rate: dict[str, Column]) -> Column:
    """Same idea with knots at 0/.3/.5/1 where knots without a rate are skipped.

    Interpolates between the nearest rated knots around |z|; above the last rated
    knot, or with fewer than two rated knots, the bucket's own rate is used.
    """
    xs = {"z00": 0.0, "z03": 0.3, "z05": 0.5, "z10": 1.0}
    points = F.filter(
        F.array(*[F.struct(F.lit(xs[b]).alias("x"), rate[b].alias("y")) for b in P.Z30_BUCKETS]),
        lambda p: p["y"].isNotNull())
    below = F.element_at(F.filter(points, lambda p: p["x"] <= az), -1)
    above = F.get(F.filter(points, lambda p: p["x"] > az), F.lit(0))
    usable = (F.size(points) >= 2) & (F.size(F.filter(points, lambda p: p["x"] > az)) > 0) \
        & (F.size(F.filter(points, lambda p: p["x"] <= az)) > 0)
    own = reduce(lambda acc, b: acc.when(z_bucket30(az) == b, rate[b]),
                 P.Z30_BUCKETS[1:], F.when(z_bucket30(az) == P.Z30_BUCKETS[0],
                                           rate[P.Z30_BUCKETS[0]]))
    lin = below["y"] + (above["y"] - below["y"]) * (az - below["x"]) / (above["x"] - below["x"])
    return F.when(usable, lin).otherwise(own)


def prob_up(pred: Column, conf: Column) -> Column:
    return F.round(F.when(pred == 1, conf).when(pred == 0, 1 - conf), 3)


def prob_down(pred: Column, conf: Column) -> Column:
    return F.round(1 - F.when(pred == 1, conf).when(pred == 0, 1 - conf), 3)


def confidence_tier(conf: Column) -> Column:
    return F.when(conf >= 0.65, "high").when(conf >= 0.55, "mid").when(conf.isNotNull(), "low")


def anchor_displacement(pred: Column, conf: Column, horizon: Column) -> Column:
    """Signed log displacement at the horizon; 0 when abstained or confidence < .55."""
    size = clip((conf - 0.5) * 2, 0.0, 1.0) * F.sqrt(F.greatest(horizon, F.lit(1)) / 7.0)
    signed = F.when(pred == 0, -size).otherwise(size) * P.ANCHOR_SCALE
    return F.when(pred.isin(0, 1) & (conf >= 0.55), signed).otherwise(0.0)


def simple_return(p0: Column, p1: Column) -> Column:
    return safe_div(p1 - p0, p0)


def ternary_label(r: Column, half_width: float = P.FLAT_HALF_WIDTH) -> Column:
    return F.when(r > half_width, 1).when(r < -half_width, -1).when(r.isNotNull(), 0)


def binary_label(r: Column) -> Column:
    return F.when(r > 0, 1).when(r.isNotNull(), 0)


def lexicon_score(text: Column, positive: list[str], negative: list[str]) -> Column:
    """(positive - negative) / words over runs of [a-z]; 0 for a text without words.

    The text is first reduced to its words with single blanks between them, so words are
    counted from lengths and only lexicon hits are materialised, not the token list. The
    reduced text appears several times without a branch around it, which lets the generated
    code compute it once.
    """
    words_only = F.trim(F.regexp_replace(F.lower(text), "[^a-z]+", " "))
    padded = F.concat(F.lit(" "), words_only, F.lit(" "))

    def hits(lexicon: list[str]) -> Column:
        return F.regexp_count(padded, F.lit(f" (?:{'|'.join(sorted(lexicon))})(?= )"))

    blanks = F.length(words_only) - F.length(F.replace(words_only, F.lit(" "), F.lit("")))
    words = blanks + (F.length(words_only) > 0).cast("int")
    return F.coalesce(F.try_divide(hits(positive) - hits(negative), words), F.lit(0.0))


def parse_feed_date(text: Column, run_date: Column) -> Column:
    """Feed dates in one of four formats, tried in order; the run date otherwise."""
    # fixed values: formats of the first 25 characters of the stamp; the weekday name carries
    # no information and is stripped before parsing
    formats = ("dd MMM yyyy HH:mm:ss z", "dd MMM yyyy HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss",
               "yyyy-MM-dd")
    head = F.regexp_replace(F.substring(F.trim(text), 1, 25),
                            "^(Mon|Tue|Wed|Thu|Fri|Sat|Sun), ", "")
    return F.coalesce(*[F.to_date(F.try_to_timestamp(head, F.lit(f))) for f in formats], run_date)


def decimal_comma(text: Column) -> Column:
    return F.regexp_replace(text, ",", ".").try_cast("double")


def long_badge(conf: Column, gate_passed: Column) -> Column:
    """Badge of the long horizons: high only for a rule that passed its gate."""
    return (F.when(conf.isNull(), "neutral").when(conf < 0.55, "low")
            .when(gate_passed, "high").otherwise("mid"))
