"""The adaptive sampler: reproducible, within its space, better than random draws."""

import math
import random

from pyspark.sql import functions as F

from ecospark.operators import models as Mo
from ecospark.operators import sampler as S

SPACE = {"depth": ("int", 1, 30), "rate": ("log", 1e-3, 1e1), "share": ("float", 0.0, 1.0), "kind": ("choice", ["a", "b", "c"])}


def surface(p):
    return (p["depth"] - 21) ** 2 / 100 + (math.log10(p["rate"]) + 1) ** 2 + 3 * (p["share"] - 0.3) ** 2 + {"a": 1.0, "b": 0.0, "c": 0.7}[p["kind"]]


def best(trials):
    return min(s for _, s in trials)


def test_reproducible_and_within_the_space():
    runs = [S.search(lambda ps: [surface(p) for p in ps], SPACE, n=20, seed=7) for _ in range(2)]
    assert runs[0] == runs[1] and len(runs[0]) == 20
    assert runs[0] != S.search(lambda ps: [surface(p) for p in ps], SPACE, n=20, seed=8)
    for p, _ in runs[0]:
        assert isinstance(p["depth"], int) and 1 <= p["depth"] <= 30 and 1e-3 <= p["rate"] <= 1e1 and 0 <= p["share"] <= 1 and p["kind"] in "abc"


def test_beats_random_draws():
    own, other = [], []
    for seed in range(40):
        own.append(best(S.search(lambda ps: [surface(p) for p in ps], SPACE, n=20, seed=seed)))
        rng = random.Random(seed)
        other.append(best([(None, surface(S.draw(SPACE, rng))) for _ in range(20)]))
    assert sum(own) / 40 < 0.8 * sum(other) / 40
    assert sum(a < b for a, b in zip(own, other)) > 24


def test_single_points_and_batches():
    space = {"x": ("int", 3, 3), "k": ("choice", [None])}
    sizes = []
    trials = S.search(lambda ps: sizes.append(len(ps)) or [0.0] * len(ps), space, n=10, batch=4)
    assert sizes == [4, 4, 2] and all(p == {"x": 3, "k": None} for p, _ in trials)


def test_searches_over_spark_models(spark):
    rows = [(i, float(i % 10) / 10, float(i % 7) / 7) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, a double, b double").withColumn("label", 2 * F.col("a") - F.col("b"))
    model, res = Mo.adaptive_search(df, ["a", "b"], Mo.estimator("ridge"), {"regParam": ("log", 1e-3, 1e2)}, n=6, batch=3, startup=3, folds=2)
    got = res.orderBy("candidate").collect()
    assert [r["candidate"] for r in got] == list(range(6)) and Mo.evaluate(model, df).first()["r2"] > 0.9
    svr = Mo.svr_adaptive_search(df, ["a", "b"], {"c_reg": ("log", 1e-2, 1e2), "kernel": ("choice", ["linear", "rbf"])}, ["id"], n=6, batch=3, startup=3, folds=2)
    assert svr.count() == 6 and svr.agg(F.min("mse")).first()[0] < 0.05
