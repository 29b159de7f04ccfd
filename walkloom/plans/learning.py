"""Registered classifier walk-forwards (no SQL counterpart)."""

from __future__ import annotations

from walkloom.operators import features as feat
from walkloom.operators import learn
from walkloom.operators import signals as S
from walkloom.plans.registry import full_base, query
from walkloom.plans.reports import ERAS


def _walkforward(spark, d, model):
    names = [*feat.ALL, "rev"]
    df = S.reversion(feat.build(full_base(spark, d)))
    return learn.report(learn.dataset(df, names), names, models=(model,), eras=ERAS)


@query("exp_ml_walkforward")
def exp_ml_walkforward(spark, d):
    """Logistic model, refitted every year; the forest and the boosted trees take longer and are queries of their own."""
    return _walkforward(spark, d, "LR")


@query("exp_ml_walkforward_forest")
def exp_ml_walkforward_forest(spark, d):
    """Random forest, refitted every year on all labelled rows."""
    return _walkforward(spark, d, "RF")


@query("exp_ml_walkforward_boosted")
def exp_ml_walkforward_boosted(spark, d):
    """Boosted trees, refitted every year on all labelled rows."""
    return _walkforward(spark, d, "GBT")
