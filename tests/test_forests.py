"""Forest grids from cut trees, families of a run, saved support-vector models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ecospark.operators import forests as Fo
from ecospark.operators import models as Mo


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3))
    y = x[:, 0] * 3 + np.sin(3 * x[:, 1]) + 0.1 * rng.normal(size=300)
    return spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "id int, a double, b double, c double, label double")


def test_cut_trees_equal_shallower_fits(spark, data):
    cols, depths = ["a", "b", "c"], [0, 2, 4, 30]
    deep = Mo.chain(cols, Mo.estimator("forest", numTrees=6, maxDepth=12), scale=None).fit(data)
    rows = deep.transform(data).orderBy("id").collect()
    x = np.stack([r["features"].toArray() for r in rows])
    trees = Fo.Trees(deep.stages[-1], spark)
    mean = sum(trees.staged(x, depths)) / 6
    assert np.allclose(mean[3], [r["prediction"] for r in rows])
    for i, d in enumerate(depths[:3]):
        flat = Mo.chain(cols, Mo.estimator("forest", numTrees=6, maxDepth=d), scale=None).fit(data)
        assert np.allclose(mean[i], [r["prediction"] for r in flat.transform(data).orderBy("id").collect()])


def test_grid_scores_every_combination(data):
    grid = {"numTrees": [2, 5], "maxDepth": [1, 6], "minInstancesPerNode": [1, 20]}
    best, res = Fo.forest_grid_search(data, ["a", "b", "c"], grid, folds=2)
    rows = res.collect()
    assert len(rows) == 8 and [r["candidate"] for r in rows] == list(range(8))
    by = {r["params"]: r["mse"] for r in rows}
    assert by[str(best)] == min(by.values()) and best["maxDepth"] == 6


def test_run_tunes_families_and_saves_the_pick(spark, data, tmp_dir):
    base = data.select("id", "a", "b", F.col("label").alias("t"))
    other = data.select("id", "c")
    families = {"forest": (Mo.estimator("forest"), {"numTrees": [3], "maxDepth": [2, 5]}), "linear": (Mo.estimator("linear"), {}),
                "svr": ("svr", {"c_reg": [0.1, 10], "kernel": ["linear", "rbf"]})}
    out = Mo.run(base, [other], "id", "t", path=f"{tmp_dir}/m", families=families, folds=2).first()
    assert out["family"] in families and out["r2"] > 0.7
    pick, model, table = Mo.compare_families(data, ["a", "b", "c"], {"svr": families["svr"]}, folds=2, key=["id"])
    assert pick == "svr" and table.count() == 4
    model.save(spark, f"{tmp_dir}/s")
    again = Mo.SVRegressor.load(spark, f"{tmp_dir}/s")
    a, b = (m.transform(data).agg(F.sum("prediction")).first()[0] for m in (model, again))
    assert a == pytest.approx(b, abs=1e-9)
    assert set(Mo.families_of_the_workflow()) == {"forest", "boosting", "svr"}
