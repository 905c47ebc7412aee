"""The model queries ask for as many trees, rounds and depths as the operators' defaults have."""

import inspect
from types import SimpleNamespace

import pytest

from staylens.operators import models
from staylens.plans import catalog


@pytest.fixture
def asked(monkeypatch):
    """What a query asks its operators for, without a fit."""
    seen = {}
    table = SimpleNamespace(drop=lambda *names: None, unpersist=lambda: None)
    for name, size in (("forest", "num_trees"), ("boosted", "rounds")):
        default = inspect.signature(getattr(models, name)).parameters[size].default
        monkeypatch.setattr(models, name, lambda size=size, default=default, **given: seen.update(size=given.get(size, default)))
    monkeypatch.setattr(models, "grid_search", lambda data, family, depths, **given: seen.update(depths=list(depths)) or SimpleNamespace(scores=table))
    monkeypatch.setattr(models, "depth_sweep", lambda data, family, depths, *given: seen.update(depths=list(depths)) or table)
    monkeypatch.setattr(models, "cv_scores", lambda data, family, depths, **given: seen.update(depths=list(depths)) or table)
    monkeypatch.setattr(models, "fit_depth", lambda data, family, depth: seen.update(depths=[depth]))
    monkeypatch.setattr(models, "predict", lambda data, model: None)
    monkeypatch.setattr(catalog.evaluate, "confusion_matrix", lambda *given: None)
    monkeypatch.setattr(catalog, "_model_data", lambda spark, d: table)
    return seen


def test_rf_grid_search(asked):
    catalog.rf_grid_search(None, "")
    assert asked == {"size": 100, "depths": list(range(27, 38))}


def test_gbt_depth_sweep(asked):
    catalog.gbt_depth_sweep(None, "")
    assert asked == {"size": 100, "depths": list(range(1, 16))}


def test_gbt_final(asked):
    catalog.gbt_final(None, "")
    assert asked == {"size": 100, "depths": [10]}


def test_gbt_cv_scores(asked):
    catalog.gbt_cv_scores(None, "")
    assert asked == {"size": 100, "depths": list(range(1, 16))}
    assert f"unnest({list(range(1, 16))})" in catalog.ORACLES["gbt_cv_scores"]


def test_a_limit_that_no_tree_reaches_needs_no_fit():
    fitted = []

    def fit(depths):
        fitted.extend(depths)
        return {d: (d, None if d <= 5 else (5, "grown")) for d in depths}

    found = models._fit_apart(range(1, 16), fit)
    assert sorted(fitted) == [1, 2, 3, 4, 5, 15]
    assert [found[d][0] for d in range(1, 16)] == [1, 2, 3, 4, 5, *[15] * 10]
