"""Registered model queries do the whole job of their operators."""

import inspect

from platewise.operators import models
from platewise.plans.registry import QUERIES

from conftest import SF_SMALL


def test_train_all_searches_with_the_operators_budget(spark, monkeypatch):
    signature = inspect.signature(models.train_all)
    asked = []

    def seen(*args, **kwargs):
        call = signature.bind(*args, **kwargs)
        call.apply_defaults()
        asked.append(call.arguments["n_trials"])
        return call.arguments["venues"]

    monkeypatch.setattr(models, "train_all", seen)
    QUERIES["train_all"](spark, SF_SMALL)
    assert asked == [20]


def test_trees_tell_200_codes_apart(spark):
    rows = spark.range(20000).selectExpr("cast(id % 200 as double) AS label")
    rows = rows.selectExpr(
        "label",
        *[f"{'label' if c == 'city_code' else '0.0'} AS {c}" for c in models.RATING_FEATURES],
    )
    fitted = models._rating_pipeline(1, 10, 42).fit(rows)
    wrong = fitted.transform(rows).where("abs(prediction - label) > 1e-9").count()
    assert wrong == 0
