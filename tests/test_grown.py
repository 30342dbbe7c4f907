"""Trees of many folds and parameters grown together, and forests from them."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from ecospark.operators import forests as Fo
from ecospark.operators import grown
from ecospark.operators import models as Mo

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    """Few values with zeros, many values with gaps, more rows than MLlib takes thresholds from."""
    rng = np.random.default_rng(0)
    n = 16_000
    a, b, x = rng.integers(0, 50, n).astype(float), rng.normal(size=n), rng.integers(0, 7, n).astype(float)
    y = 3 * a + 10 * np.sin(3 * b) + 5 * rng.normal(size=n)
    b[::97] = np.nan
    return spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "c": x, "label": y})).repartition(4).cache()


def counted(monkeypatch, cls):
    fits, fit = [], cls._fit
    monkeypatch.setattr(cls, "_fit", lambda self, df: fits.append(1) or fit(self, df))
    return fits


def test_trees_are_those_of_mllib(data):
    """Every candidate's score is that of a fit of its own."""
    est = Mo.estimator("tree")
    maps = [{est.maxDepth: d, est.minInstancesPerNode: m} for d, m in ((1, 1), (5, 1), (9, 40), (10, 200))]
    scores = Mo._tree_scores(data, COLS, est, maps, 2, 42, "label", {})
    drawn = data.withColumn("_drawn", F.rand(42))
    for score, m in zip(scores, maps):
        own = []
        for held in (F.col("_drawn") < 0.5, F.col("_drawn") >= 0.5):
            model = Mo.chain(COLS, est.copy(m)).fit(drawn.filter(~held))
            own.append(Mo.evaluate(model, drawn.filter(held)).first()["mse"])
        assert score == pytest.approx(np.mean(own), rel=1e-9)


def test_searches_fit_no_model_per_candidate(data, monkeypatch):
    """only the best tree is fitted on its own."""
    fits = counted(monkeypatch, DecisionTreeRegressor)
    space = {"maxDepth": ("int", 1, 5), "minInstancesPerNode": ("int", 1, 50)}
    _, res = Mo.adaptive_search(data, COLS, Mo.estimator("tree"), space, n=6, batch=3, startup=3, folds=2)
    assert res.count() == 6 and len(fits) == 1


def test_forest_grids_are_grown_in_shared_passes(data, monkeypatch):
    """F1, F2: no fit per fold, a pass per level for all folds and trees, and scores like MLlib's up to the bootstrap's draws."""
    fits, passes, one = counted(monkeypatch, RandomForestRegressor), [], grown.Table._pass
    monkeypatch.setattr(grown.Table, "_pass", lambda self, asked, level: passes.append(level) or one(self, asked, level))
    grid = {"numTrees": [1, 12], "maxDepth": [2, 6]}
    best, res = Fo.forest_grid_search(data, COLS, grid, folds=2)
    assert not fits and passes == list(range(6)) and best == {"numTrees": 12, "maxDepth": 6}
    monkeypatch.setattr(grown, "DEEPEST", 1)
    _, other = Fo.forest_grid_search(data, COLS, grid, folds=2)
    assert len(fits) == 2
    for x, y in zip(res.collect(), other.collect()):
        assert x["params"] == y["params"] and x["mse"] == pytest.approx(y["mse"], rel=0.1)


def test_forests_are_saved_and_loaded(spark, data, tmp_dir):
    forest = grown.Forest(COLS, num_trees=5, max_depth=6, least=3).fit(data)
    assert Mo.evaluate(forest, data).first()["r2"] > 0.9
    forest.save(spark, f"{tmp_dir}/f")
    x = np.array([[3.0, np.nan, 1.0], [40.0, 0.5, 6.0]])
    assert np.array_equal(grown.Forest.load(spark, f"{tmp_dir}/f").predict(x), forest.predict(x))
    with pytest.raises(ValueError, match="deeper"):
        grown.Forest(COLS, max_depth=30)


def test_missing_labels_and_constant_inputs(spark):
    df = spark.createDataFrame([(1.0, float(i % 3), float(i)) for i in range(30)], "a double, b double, label double")
    forest = grown.Forest(["a", "b"], num_trees=3, max_depth=4).fit(df)
    assert all(len(set(feature[kids[::2] != np.arange(len(feature))])) <= 1 for feature, _, kids, _ in forest.trees)
    with pytest.raises(ValueError, match="labels"):
        grown.Table(df.withColumn("label", F.when(F.col("label") > 3, F.col("label"))), ["a", "b"], "label")
