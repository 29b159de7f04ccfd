"""Label diagnostics, single-factor tests, range algorithms and snapshot audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from walkloom import params as P
from walkloom.functions import scalars as X
from walkloom.functions.frames import SERIES, series_window
from walkloom.operators import backtest as B
from walkloom.operators import chunks
from walkloom.operators import joins as J
from walkloom.operators import signals as S
from walkloom.operators.medians import expanding_median

QUANTILES = (0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)
PROB_SLICES = 4096
LAYERS = ("year", "era", "vol_regime", "trend_regime", "market_at_t")


# ------------------------------------------------------------------ label diagnostics

def labels(df: DataFrame, horizon: int = P.LABEL_HORIZON, by=SERIES) -> DataFrame:
    """r (simple return over the horizon), y3 in {-1, 0, 1}, y2 in {0, 1}; NULL when unknown."""
    later = F.lead("price", horizon).over(series_window(by))
    df = df.withColumn("r_fwd", X.simple_return(F.col("price"), later))
    return df.withColumns({"y3": X.ternary_label(F.col("r_fwd")),
                           "y2": X.binary_label(F.col("r_fwd"))})


def label_rows(df: DataFrame, market: DataFrame | None = None, horizon: int = P.LABEL_HORIZON,
               split_year: int = 2021, jump: float = P.JUMP_THRESHOLD, by=SERIES) -> DataFrame:
    """Labelable rows with contamination flag and layers: year, era, regimes, market."""
    out = S.trend_regime(S.high_vol(S.jumps(df, by, jump), by), by)
    out = J.interval_contaminated(labels(out, horizon, by), F.col("edge"), horizon, by)
    vol = F.when((F.col("t") < P.REGIME_WINDOW) | F.col("vol20p").isNull(), "unknown_warmup") \
        .when(F.col("high_vol"), "high_vol").otherwise("normal_vol")
    out = out.withColumns({
        "year": F.year("date"), "vol_regime": vol, "clean": ~F.col("contaminated"),
        "era": F.when(F.year("date") >= split_year, f"modern_{split_year}plus")
                .otherwise(f"pre{split_year}"),
        "market_at_t": F.when(F.col("close").isNotNull(), "yes").otherwise("no")})
    return out.where(F.col("r_fwd").isNotNull())


def _label_stats(r: Column, y3: Column) -> list[Column]:
    n = F.count(F.lit(1))
    up, flat, down = (F.count_if(y3 == v) for v in (1, 0, -1))
    bin_up = F.count_if(r > 0)
    share = lambda a, b: F.round(F.try_divide(a, b), 4)
    return [n.alias("n"), up.alias("up"), flat.alias("flat"), down.alias("down"),
            share(up, n).alias("up_pct"), share(flat, n).alias("flat_pct"),
            share(down, n).alias("down_pct"),
            share(F.greatest(up, flat, down), n).alias("ternary_purity"),
            bin_up.alias("binary_up"),
            share(F.greatest(bin_up, n - bin_up), n).alias("binary_purity"),
            (up + down).alias("nonflat_n"),
            share(F.greatest(up, down), up + down).alias("nonflat_purity"),
            F.round(F.avg(r), 6).alias("mean_r"),
            F.round(F.percentile(r, F.lit(0.5)), 6).alias("median_r")]


def label_layers(rows: DataFrame, by=SERIES) -> DataFrame:
    """Counts, shares and purity overall and per layer, in one pass of grouping sets."""
    keys = [F.col(c) for c in by]
    sets = [keys] + [[*keys, F.col(c)] for c in LAYERS]
    cols = [*keys, *[F.col(c) for c in LAYERS]]
    marks = [F.grouping(c).alias(f"_g_{c}") for c in LAYERS]
    out = rows.groupingSets(sets, *cols).agg(*_label_stats(F.col("r_fwd"), F.col("y3")), *marks)
    layer, key = F.lit("overall"), F.lit("all")
    for c in LAYERS:
        layer = F.when(F.col(f"_g_{c}") == 0, c).otherwise(layer)
        key = F.when(F.col(f"_g_{c}") == 0, F.col(c).cast("string")).otherwise(key)
    stats = [c for c in out.columns if c not in (*by, *LAYERS) and not c.startswith("_g_")]
    return out.select(*by, layer.alias("layer"), key.alias("layer_key"), *stats)


def distribution(rows: DataFrame, by=SERIES) -> DataFrame:
    r = F.col("r_fwd")
    q = F.percentile(r, F.array(*[F.lit(x) for x in QUANTILES]))
    share = lambda c: F.round(F.count_if(c) / F.count(F.lit(1)), 4)
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(r), 6).alias("mean"),
        F.round(F.stddev_samp(r), 6).alias("std"), F.round(F.min(r), 6).alias("min"),
        F.round(F.max(r), 6).alias("max"), q.alias("_q"), share(r > 0).alias("share_positive"),
        share(F.abs(r) <= P.FLAT_HALF_WIDTH).alias("share_flat"),
        F.round(F.avg(F.abs(r)), 6).alias("mean_abs"))
    return out.select(*[c for c in out.columns if c != "_q"], *[
        F.round(F.col("_q")[i], 6).alias(f"q{round(x * 100):02d}") for i, x in enumerate(QUANTILES)])


def missing_labels(df: DataFrame, horizon: int = P.LABEL_HORIZON, by=SERIES) -> DataFrame:
    """Unlabelable rows by first applicable reason."""
    w = series_window(by)
    has_future = F.lead(F.lit(1), horizon).over(w).isNotNull()
    later = F.lead("price", horizon).over(w)
    reason = (F.when(~has_future, "no_future").when(F.col("price").isNull(), "price")
              .when(later.isNull(), "price_later").otherwise("labelable"))
    return df.withColumn("_reason", reason).groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_rows"),
        *[F.count_if(F.col("_reason") == k).alias(v) for k, v in (
            ("no_future", "no_future_trailing"), ("price", "null_price"),
            ("price_later", "null_price_later"), ("labelable", "labelable"))])


def jump_summary(df: DataFrame, by=SERIES) -> DataFrame:
    """Number of flagged edges and the largest move that is not flagged."""
    flagged = F.coalesce("edge", F.lit(False))
    return df.groupBy(*by).agg(
        F.count_if(flagged).alias("edges"),
        F.round(F.exp(F.max(F.when(~flagged, F.abs("next_move")))) - 1, 6)
        .alias("largest_unflagged_move"))


# ------------------------------------------------------------------ single factors

def factor_decisions(long: DataFrame, horizon: int = P.LABEL_HORIZON, start: int = P.WARMUP,
                     min_n: int = 30, by=SERIES) -> DataFrame:
    """Predictions of the two rules per (series, feature, row).

    ``long`` carries (by, date, t, y2, feature, value). The threshold of the median rule
    is the median of values whose outcome is known at the row; both rules wait for 30 such
    values.
    """
    keys = [*by, "feature"]
    df = expanding_median(long, keys, "t", "value", "threshold", lag=horizon, start=start,
                          min_n=min_n, keep=["date", "y2", "value"])
    value = F.col("value")
    rules = F.array(
        F.struct(F.lit("median").alias("rule"),
                 F.when(value > F.col("threshold"), 1).otherwise(0).alias("pred")),
        F.struct(F.lit("sign").alias("rule"), F.when(value > 0, 1).otherwise(0).alias("pred")))
    usable = ((F.col("t") >= start) & value.isNotNull() & F.col("threshold").isNotNull()
              & F.col("y2").isNotNull())
    return (df.where(usable).withColumn("_r", F.explode(rules))
            .select(*keys, "date", "t", "y2", "threshold", "_r.*")
            .withColumn("hit", (F.col("pred") == F.col("y2")).cast("int")))


def factor_report(decisions: DataFrame, eras=P.DEFAULT_ERAS, by=SERIES) -> DataFrame:
    era = B.era_of(F.col("date"), eras)
    cols = []
    for i, (name, _, _) in enumerate(eras, 1):
        cols += [F.count_if(era == name).alias(f"era{i}_n"),
                 F.round(F.avg(F.when(era == name, F.col("hit"))), 4).alias(f"era{i}_hit")]
    return decisions.groupBy(*by, "feature", "rule").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("hit"), 4).alias("hit"),
        F.round(F.avg("pred"), 4).alias("up_share"), *cols)


def factor_ranking(report: DataFrame, last_era: int = 3, by=SERIES) -> DataFrame:
    """Better of the two rules per feature (median on ties) and the rank by last-era hit."""
    # max_by over (hit, is_median): equal hits resolve to the median rule
    order = F.struct(F.coalesce("hit", F.lit(0.0)), (F.col("rule") == "median").cast("int"))
    pick = F.max_by(F.struct("rule", "hit", "n", f"era{last_era}_hit"), order)
    best = report.groupBy(*by, "feature").agg(pick.alias("b"))
    return best.select(*by, "feature", F.col("b.rule").alias("best_rule"),
                       F.col("b.hit").alias("best_hit"), F.col("b.n").alias("best_n"),
                       F.col(f"b.era{last_era}_hit").alias("best_last_era_hit"))


# ------------------------------------------------------------------ range algorithms

def range_decisions(df: DataFrame, horizons=P.HORIZONS, by=SERIES) -> DataFrame:
    """(by, date, t, horizon, algo, pred, actual) of the five range algorithms."""
    algos = ("A", "B", "C", "D", "E")
    df = J.forward_outcome(S.range_algorithms(df, horizons, by), horizons, by)
    rows = F.array(*[F.struct(F.lit(n).alias("horizon"), F.lit(a).alias("algo"),
                              F.col(f"{a}_{n}").alias("pred"), F.col(f"actual_{n}").alias("actual"))
                     for n in horizons for a in algos])
    return (df.where(F.col("t") >= P.WARMUP).select(*by, "date", "t", F.explode(rows).alias("d"))
            .select(*by, "date", "t", "d.*").where(F.col("actual").isNotNull()))


def range_report(decisions: DataFrame, sizes: DataFrame, late_share: float = 0.6,
                 by=SERIES) -> DataFrame:
    """Hit, coverage and late-period hit. ``sizes`` is (by, rows): the series lengths."""
    df = decisions.join(sizes, list(by))
    hit = (F.col("pred") == F.col("actual")).cast("double")
    emitted = F.col("pred").isNotNull()
    late = emitted & (F.col("t") >= F.col("rows") * late_share)
    return df.groupBy(*by, "horizon", "algo").agg(
        F.count_if(emitted).alias("n"), F.round(F.avg(F.when(emitted, hit)), 4).alias("hit"),
        F.count_if(late).alias("n_late"), F.round(F.avg(F.when(late, hit)), 4).alias("hit_late"),
        F.round(F.count_if(emitted) / F.count(F.lit(1)), 3).alias("coverage"))


# ------------------------------------------------------------------ class metrics

def class_metrics(scored: DataFrame, keys: list[str]) -> DataFrame:
    """n, hit, ROC-AUC and Brier per group of (y, prob).

    The AUC is the rank-sum statistic with average ranks. Equal probabilities are counted
    first; ranks are made in two levels, inside slices of the probability range and over one
    row per slice, so a group of any size never sits in a single task.
    """
    p, y = F.col("prob"), F.col("y")
    basic = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg((F.when(p >= 0.5, 1).otherwise(0) == y).cast("double")), 6).alias("hit"),
        F.round(F.avg((p - y) * (p - y)), 6).alias("brier"))
    ties = (scored.groupBy(*keys, "prob").agg(F.count(F.lit(1)).alias("c"), F.sum("y").alias("pos"))
            .withColumn("_slice", F.floor(p * PROB_SLICES)))
    per_slice = ties.groupBy(*keys, "_slice").agg(F.sum("c").alias("rows"))
    ties = ties.join(chunks.offsets(per_slice, keys, "_slice", ["rows"]), [*keys, "_slice"])
    w = Window.partitionBy(*keys, "_slice").orderBy("prob")
    inside = F.coalesce(F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = ties.withColumn("avg_rank", F.col("_before_rows") + inside + (F.col("c") + 1) / 2.0)
    pos, neg = F.sum("pos"), F.sum(F.col("c") - F.col("pos"))
    auc = F.try_divide(F.sum(F.col("avg_rank") * F.col("pos")) - pos * (pos + 1) / 2.0, pos * neg)
    return basic.join(ranked.groupBy(*keys).agg(F.round(auc, 6).alias("auc")), keys)


# ------------------------------------------------------------------ snapshot audit

def audit_summary(old: DataFrame, new: DataFrame, by=SERIES) -> DataFrame:
    """Per series: rows, date-set equality, changed rows, how many ratios they have and between which
    bounds (``changed_ratios`` lists them), edges before/after."""
    both = J.snapshot_compare(old, new, by).withColumn("_ratio", F.when(F.col("changed"), F.col("ratio")))
    # one row per ratio first: distinct ratios are counted without gathering them in a cell
    present = F.col("old_price").isNotNull() & F.col("new_price").isNotNull()
    per_ratio = both.groupBy(*by, "_ratio").agg(
        F.count("old_price").alias("old"), F.count("new_price").alias("new"),
        F.bool_and(present).alias("both"), F.count_if("changed").alias("changed"))
    changes = per_ratio.groupBy(*by).agg(
        F.sum("old").alias("rows_old"), F.sum("new").alias("rows_new"), F.bool_and("both").alias("dates_identical"),
        F.sum("changed").alias("changed_rows"), F.count("_ratio").alias("n_ratios"),
        F.min("_ratio").alias("ratio_min"), F.max("_ratio").alias("ratio_max"))
    edges = [jump_summary(S.jumps(x, by), by).select(*by, F.col("edges").alias(n))
             for x, n in ((old, "edges_old"), (new, "edges_new"))]
    return reduce(lambda a, b: a.join(b, list(by), "left"), edges, changes)


def changed_ratios(changes: DataFrame, by=SERIES) -> DataFrame:
    """The distinct new/old ratios of changed rows with their number of rows, one row per ratio;
    rows without a ratio (a missing or zero old price) count under NULL."""
    return changes.where("changed").groupBy(*by, "ratio").agg(F.count(F.lit(1)).alias("changed_rows"))


def changed_by_year(compared: DataFrame, by=SERIES) -> DataFrame:
    return (compared.where("changed").groupBy(*by, F.year("date").alias("year"))
            .agg(F.count(F.lit(1)).alias("changed_rows")))


def top_moves(df: DataFrame, k: int = 8, by=SERIES) -> DataFrame:
    """The k largest absolute day-to-day log moves over all series, with the signed move."""
    moves = S.jumps(df, by).where(F.col("next_move").isNotNull())
    order = [F.abs("next_move").desc(), *[F.col(c) for c in by], F.col("date")]
    return moves.orderBy(*order).limit(k).select(
        *by, F.col("date").alias("from_date"), F.col("next_date").alias("to_date"),
        F.round(F.exp("next_move") - 1, 6).alias("move"))

