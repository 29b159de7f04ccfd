import numpy as np
import pytest
from pyspark.sql import functions as F

from walkloom.operators import features as feat
from walkloom.operators import learn, yearly
from walkloom.operators import signals as S
from walkloom.session import materialise

NAMES = ["rev", "mom20", "vol20", "pos60", "rsi14"]
BY = ["series_id"]


@pytest.fixture(scope="module")
def data(aligned):
    df = S.reversion(feat.build(aligned, keep=NAMES))
    return materialise(learn.dataset(df, NAMES), "test-learn")


@pytest.fixture(scope="module")
def known(data):
    """All rows in pandas, with the hash that sampling uses."""
    pdf = data.withColumn("h", F.xxhash64("series_id", "date")).toPandas()
    pdf["h"] = pdf["h"].to_numpy().astype(np.uint64)
    pdf["cohort"] = [d.year for d in pdf["known_on"]]
    return pdf


@pytest.fixture(scope="module")
def years(data):
    return yearly.years_of(data, NAMES, 1, 100)


@pytest.fixture(scope="module")
def rdd(data):
    return yearly.blocks(data, NAMES, BY).repartition(3).cache()


def training(known, year):
    part = known[known.cohort < year]
    return part["h"].to_numpy(), part[NAMES].to_numpy(float), part["y"].to_numpy(int)


def test_training_never_sees_the_predicted_year(data):
    late = data.where(F.month("date") == 12).where(F.year("known_on") > F.col("year"))
    assert late.count() > 0
    assert data.where(F.col("known_on").isNull()).count() == 0


def test_years_describe_their_training_rows(known, years):
    assert sorted(years) == [2015, 2016]
    for year, about in years.items():
        _, x, y = training(known, year)
        assert (about.n, about.positive) == (len(y), y.sum())
        for i in range(len(NAMES)):
            column = np.sort(x[:, i][~np.isnan(x[:, i])])
            at = lambda s: column[max(0, int(np.ceil(s * len(column))) - 1)]
            assert about.medians[i] == at(0.5)
            assert about.edges[i].tolist() == sorted({at((k + 1) / yearly.BINS) for k in range(yearly.BINS - 1)})


def test_logistic_is_the_minimum(known, years, rdd):
    for year, (mean, scale, beta) in yearly.fit_logistic(rdd, years).items():
        _, x, y = training(known, year)
        x = np.where(np.isnan(x), years[year].medians, x)
        assert np.allclose(mean, x.mean(axis=0)) and np.allclose(scale, x.std(axis=0))
        z = np.column_stack([np.ones(len(x)), (x - x.mean(axis=0)) / x.std(axis=0)])
        w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
        gradient = z.T @ (w * (1 / (1 + np.exp(-z @ beta)) - y)) + np.r_[0, beta[1:]]
        assert np.abs(gradient).max() < 1e-7


def grow(bins, stats, features_at, depth, gain, leaf, least):
    """One tree by the book: (value of each row), every split tried with sums over its rows."""
    value, level = np.zeros(len(bins)), [np.arange(len(bins))]
    for at in range(depth + 1):
        features, below = features_at(at, len(level)) if at < depth else None, []
        for slot, rows in enumerate(level):
            whole, best = stats[rows].sum(axis=0), (least, None)
            if at < depth:
                for f in features[slot]:
                    for edge in range(yearly.BINS - 1):
                        go = bins[rows, f] <= edge
                        won = gain(stats[rows[go]].sum(axis=0), stats[rows[~go]].sum(axis=0), whole)
                        if won > best[0] * (1 + 1e-12):
                            best = (won, (f, edge))
            if best[1]:
                go = bins[rows, best[1][0]] <= best[1][1]
                below += [rows[go], rows[~go]]
            else:
                value[rows] = leaf(whole)
        level = below
    return value


def test_forest_matches_one_tree_at_a_time(known, years, rdd):
    trees, depth, least = 3, 3, 20
    fitted = yearly.fit_forest(rdd, years, trees=trees, depth=depth, min_leaf=least, at_once=2)
    year = 2015
    h, x, y = training(known, year)
    about = years[year]
    bins, w = about.bins(x), np.array(about.weights)

    def gain(left, right, whole):
        if min(left.sum(), right.sum()) < least:
            return -np.inf
        part = lambda c: (c * w @ (c * w)) / (c * w).sum()
        return part(left) + part(right) - part(whole)

    total = 0
    for t in range(trees):
        times = yearly.drawn(h, t)
        stats = np.column_stack([times * (y == 0), times * (y == 1)])
        features = lambda at, n, t=t: yearly.node_features(len(NAMES), year, t, at, n)
        drawn = times > 0
        want = np.full(len(y), np.nan)
        want[drawn] = grow(bins[drawn], stats[drawn], features, depth, gain, lambda c: c[1] * w[1] / (c @ w), 1e-12)
        got = fitted[year][t]
        assert np.allclose(got.value[got.walk(bins)][drawn], want[drawn])
        total += len(set(want[drawn]))
    assert total > 6


def test_boosted_matches_one_tree_at_a_time(known, years, rdd):
    trees, depth = 5, 2
    year = 2015
    for driver in (yearly.DRIVER_BYTES, 1):  # both ways to add histograms
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(yearly, "DRIVER_BYTES", driver)
            fitted = yearly.fit_boosted(rdd, years, trees=trees, depth=depth, renew=2)
        h, x, y = training(known, year)
        bins, margin = years[year].bins(x), np.zeros(len(y))

        def gain(left, right, whole):
            part = lambda s: s[0]**2 / (s[1] + 1)
            return part(left) + part(right) - part(whole) if min(left[1], right[1]) >= 1 else -np.inf

        for t in range(trees):
            p = 1 / (1 + np.exp(-margin))
            drawn = yearly.unit(h, 2 * t) < 0.8
            some = np.sort(np.random.default_rng([yearly.SEED, t]).choice(len(NAMES), 4, replace=False))
            value = grow(bins[drawn], np.column_stack([p - y, p * (1 - p)])[drawn], lambda at, n: [some] * n, depth, gain,
                         lambda s: -0.05 * s[0] / (s[1] + 1), 1e-6)
            got = fitted[year][t].value[fitted[year][t].walk(bins)]
            assert np.allclose(got[drawn], value)
            margin = margin + got
        assert len(set(margin)) > 5


def test_draws_are_even(known):
    h = known["h"].to_numpy()
    assert abs(yearly.unit(h, 5).mean() - 0.5) < 0.05
    assert abs(np.mean([yearly.drawn(h, t).mean() for t in range(20)]) - 1) < 0.05


@pytest.mark.parametrize("model", learn.MODELS)
def test_a_feature_without_values_is_left_out(data, model):
    empty = data.withColumn("pos60", F.when(F.col("year") >= 2015, F.col("pos60")))
    settings = {} if model == "LR" else {"trees": 2, "depth": 2}
    out = learn.walk_forward(empty, NAMES, model, skip_years=1, **settings).toPandas()
    assert out["prob"].between(0, 1).all() and set(d.year for d in out["date"]) == {2015, 2016}


def test_report_has_models_and_baselines(data):
    rep = learn.report(data, NAMES, models=("LR",)).toPandas()
    assert set(rep["model"]) == {"LR", "baseline_rev_sign", "baseline_majority"}
    lr = rep[(rep.model == "LR") & (rep.era == "all")].iloc[0]
    assert 0 <= lr.hit <= 1 and 0 <= lr.auc <= 1 and 0 < lr.brier < 1
    assert lr.n == data.where("year >= 2016").count()


def test_no_year_with_enough_rows(data):
    with pytest.raises(ValueError):
        learn.walk_forward(data.limit(0), NAMES, "LR")


def test_every_model_is_registered(aligned, monkeypatch):
    from walkloom.plans import learning, registry
    ran = []
    monkeypatch.setattr(learning, "full_base", lambda *_: aligned)
    monkeypatch.setattr(learn, "report", lambda data, names, models, eras: ran.extend(models))
    for name, query in registry.QUERIES.items():
        if name.startswith("exp_ml_walkforward"):
            query(None, "")
    assert sorted(set(ran)) == sorted(learn.MODELS) == ["GBT", "LR", "RF"]
