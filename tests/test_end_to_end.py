"""The whole workflow run: every family, the saved pick."""

from pyspark.sql import functions as F

from ecospark.operators import models as Mo


def test_end_to_end_run_has_every_step(spark, monkeypatch, tmp_path):
    """boosting and both kernels are tuned, and the pick is saved."""
    from ecospark.plans import q_models

    seen = {}
    monkeypatch.setattr(q_models.Mo, "run", lambda *a, **k: seen.update(k) or spark.range(1).select(F.lit("x").alias("family"), F.lit(1.0).alias("r2")))
    spark.createDataFrame([(1, 1.0, 0.1, 0.2, 3.0)], "l_partkey long, l_quantity double, l_discount double, l_tax double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 2, 3.0)], "p_partkey long, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    q_models.m15(spark, str(tmp_path))
    assert set(seen["families"]) >= set(Mo.families_of_the_workflow()) and seen["path"]
    assert set(seen["families"]["svr"][1]["kernel"]) == {"linear", "rbf"}


def test_run_scores_the_saved_model(spark, tmp_dir):
    """what is scored is what was saved, for every kind of model."""
    rows = [(i, float(i % 10), float(i % 7), 2.0 * (i % 10) + (i % 7)) for i in range(200)]
    base = spark.createDataFrame(rows, "id int, a double, b double, t double")
    for name, family in {"forest": (Mo.estimator("forest"), {"numTrees": [3], "maxDepth": [4]}), "linear": (Mo.estimator("linear"), {}),
                         "boosting": (Mo.estimator("gbt", maxIter=2), {"maxIter": [1, 2]}), "svr": ("svr", {"c_reg": [1], "kernel": ["linear"]})}.items():
        out = Mo.run(base, [], "id", "t", path=f"{tmp_dir}/{name}", families={name: family}, folds=2).first()
        assert out["family"] == name and out["n"] > 0 and out["r2"] > 0
