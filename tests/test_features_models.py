import math

from pyspark.sql import functions as F
from ecospark.operators import features as X
from ecospark.operators import models as Mo


def _wide(spark):
    rows = []
    for i in range(10):
        rows.append((float(i), None, 0.0, 0.0 if i != 3 else None, 1.0, 7.0, float(i) * 2 + 1, 0.001 * (i % 2),
                     float((i * 7) % 10), None if i < 6 else 1.0))
    return spark.createDataFrame(rows, "a double, all_null double, all_zero double, zeros_one_null double, all_one double, "
                                       "seven double, collinear double, low_var double, other double, sixty_null double")


def test_pruning_reports(spark):
    df = _wide(spark)
    f1 = {r.column for r in X.uninformative_report(df, 0.5).filter("drop").collect()}
    assert f1 == {"all_null", "all_zero", "all_one", "sixty_null"}  # zeros with one null is kept
    f2 = {r.column for r in X.constant_report(df).filter("drop").collect()}
    assert f2 == {"all_zero", "all_one", "zeros_one_null", "sixty_null"}
    f3 = {r.column for r in X.variance_report(df, 0.01).filter("drop").collect()}
    assert f3 == {"all_null", "all_zero", "zeros_one_null", "all_one", "seven", "low_var", "sixty_null"}
    f4 = {r.column for r in X.sparse_report(df, 0.9).filter("drop").collect()}
    assert f4 == {"all_null", "all_zero", "zeros_one_null", "all_one", "seven", "sixty_null"}
    f7 = {r.column for r in X.drop_collinear_report(df, 0.9, ["a", "collinear", "other"]).filter("drop").collect()}
    assert f7 == {"collinear"}
    pruned = X.drop_uninformative(df, 0.5)
    assert pruned.columns == ["a", "zeros_one_null", "seven", "collinear", "low_var", "other"]


def test_split_is_disjoint_and_stable(spark):
    df = spark.range(0, 5000)
    tr, te = X.split(df, "id", 0.2, 42)
    a, b = {r.id for r in tr.collect()}, {r.id for r in te.collect()}
    assert not a & b and len(a | b) == 5000 and 800 < len(b) < 1200
    tr2, _ = X.split(df.repartition(7), "id", 0.2, 42)
    assert {r.id for r in tr2.collect()} == a


def test_linear_fit_is_exact(spark):
    rows = [(float(i % 17), float((i * 7) % 13), float((i * 3) % 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, noise double").withColumn("label", 2 * F.col("a") - 3 * F.col("b") + 1)
    m = Mo.chain(["a", "b", "noise"], Mo.estimator("linear"), scale=None).fit(df)
    ev = Mo.evaluate(m, df).first()
    assert ev.r2 > 1 - 1e-9 and ev.mse < 1e-9
    coef = m.stages[-1].coefficients.toArray()
    assert math.isclose(coef[0], 2, abs_tol=1e-6) and math.isclose(coef[1], -3, abs_tol=1e-6)
    lasso = {r.feature: r.selected for r in X.by_lasso(df, "label", ["a", "b", "noise"], 0.01).collect()}
    assert lasso["a"] and lasso["b"]


def test_encodings_and_scaling(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 2.0), ("c", 3.0), ("a", 4.0)], "t string, x double")
    oh = X.encode(df, ["t"], "one-hot")
    assert oh.columns == ["x", "t_b", "t_c"]
    lab = sorted((r.x, r.t) for r in X.encode(df, ["t"], "label").collect())
    assert lab == [(1.0, 1.0), (2.0, 0.0), (3.0, 2.0), (4.0, 0.0)]
    st = [r.x for r in X.standardize(df, ["x"]).collect()]
    assert math.isclose(sum(st), 0, abs_tol=1e-12) and math.isclose(sum(v * v for v in st) / 4, 1.0)
    mm = sorted(r.x for r in X.min_max(df, ["x"]).collect())
    assert mm[0] == 0.0 and mm[-1] == 1.0


def test_svr_learns_linear_signal(spark):
    rows = [(float(i % 10) / 10, float(i % 7) / 7) for i in range(300)]
    df = spark.createDataFrame(rows, "a double, b double").withColumn("label", 3 * F.col("a") - F.col("b"))
    svr = Mo.SVRegressor(["a", "b"], epsilon=0.01).fit(df)
    p = svr.transform(df)
    mse = p.agg(F.avg((F.col("label") - F.col("prediction")) ** 2)).first()[0]
    var = df.agg(F.var_pop("label")).first()[0]
    assert mse < 0.2 * var


def test_ridge_reg_param_matches_closed_form(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 3))
    y = x @ np.array([1.5, -2.0, 0.5]) + rng.normal(scale=0.3, size=120)
    alpha = 5.0
    # scikit-learn Ridge with intercept: centre, then solve (X'X + alpha I) w = X'y
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ yc)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, label double")
    reg = Mo.ridge_reg_param(df, "label", alpha)
    m = Mo.chain(["a", "b", "c"], Mo.estimator("ridge", regParam=reg), impute=False, scale=None).fit(df)
    got = m.stages[-1].coefficients.toArray()
    assert np.allclose(got, w, atol=1e-6)


def test_svr_grid_search_orders_by_mse(spark):
    rows = [(i, float(i % 10) / 10, float(i % 7) / 7) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, a double, b double").withColumn("label", 2 * F.col("a") - F.col("b"))
    res = Mo.svr_grid_search(df, ["a", "b"], {"c_reg": [0.01, 1.0]}, ["id"], folds=2).collect()
    assert len(res) == 2 and res[0].mse <= res[1].mse
    assert "'c_reg': 1.0" in res[0].params


def test_permutation_importance_ranks_signal(spark):
    rows = [(float(i % 17), float((i * 7) % 13), float((i * 3) % 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "a double, b double, noise double").withColumn("label", 2 * F.col("a") - 3 * F.col("b") + 1)
    m = Mo.chain(["a", "b", "noise"], Mo.estimator("linear"), scale=None).fit(df)
    imp = {r.feature: r.importance for r in X.permutation_importance(m, df, "label", ["a", "b", "noise"]).collect()}
    assert imp["b"] > 0.5 and imp["a"] > 0.2 and abs(imp["noise"]) < 0.05


def test_pca_ratios_and_cumulative(spark):
    rows = [(float(i), 2.0 * i + 1.0, float(i % 3)) for i in range(50)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    proj, ev = X.pca(df, ["a", "b", "c"], 2)
    r = ev.orderBy("component").collect()
    assert r[0].ratio > 0.99 and math.isclose(r[1].cumulative, r[0].ratio + r[1].ratio)
    assert proj.count() == 50 and len(proj.first().pca) == 2


def test_missing_values_and_wide_integers(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, nan, 2**53, 3.0), (2, nan, 2**53 + 1, None), (3, nan, 2**53, 5.0)], "k int, allnan double, big long, x double")
    drop = lambda r: {x["column"]: x["drop"] for x in r.collect()}
    assert drop(X.uninformative_report(df))["allnan"] and drop(X.variance_report(df))["allnan"]
    sparse = drop(X.sparse_report(df))
    assert sparse["allnan"] and not sparse["big"]
    from ecospark.operators import profile as P

    assert {r["column"]: r["missing"] for r in P.missing(df).collect()} == {"allnan": 3, "x": 1, "big": 0, "k": 0}
    assert {r["column"]: r["variance"] for r in P.variances(df, ["allnan", "x"]).collect()} == {"allnan": None, "x": 1.0}


def test_wide_frames_use_the_same_path(spark):
    n = 800
    df = spark.range(20).selectExpr(*[f"CAST(IF({i} % 4 = 0, 0, id % ({i % 7} + 2)) AS DOUBLE) AS c{i}" for i in range(n)])
    got = {r["column"]: r["drop"] for r in X.constant_report(df).collect()}
    assert len(got) == n and all(got[f"c{i}"] == (i % 4 == 0) for i in range(n))


def test_quantiles_are_exact_and_skip_missing(spark):
    import numpy as np

    from ecospark.functions import clean as K
    from ecospark.operators import profile as P

    rng = np.random.default_rng(3)
    v = [float(x) for x in rng.integers(0, 50, 400)] + [1e9, None, float("nan")]
    df = spark.createDataFrame([(i, x, x if i % 2 else None) for i, x in enumerate(v)], "k int, v double, w double")
    clean = np.array([x for x in v if x is not None and x == x])
    odd = np.array([x for i, x in enumerate(v) if i % 2 and x is not None and x == x])
    got = {(r.column, r.q): r.value for r in P.exact_quantiles(df, ["v", "w"], [0.0, 0.1, 0.5, 0.99, 1.0]).collect()}
    for q in (0.0, 0.1, 0.5, 0.99, 1.0):
        assert abs(got["v", q] - np.quantile(clean, q)) < 1e-6 and abs(got["w", q] - np.quantile(odd, q)) < 1e-6
    out = {r.k: r.v for r in K.clip_upper(df, "v", 0.5).collect()}
    assert out[401] is None and out[402] != out[402] and out[400] == np.quantile(clean, 0.5)


def test_mutual_information_drops_missing_rows(spark):
    rows = [(float(i), float(i % 10), float(i)) for i in range(200)] + [(None, 5.0, None)] * 300
    df = spark.createDataFrame(rows, "x double, noise double, y double")
    mi = {r.feature: r.mi for r in X.mutual_info(df, "y", 1, bins=10, cols=["x", "noise"]).collect()}
    assert abs(mi["x"] - math.log(10)) < 0.05 and mi["noise"] < 0.5


def test_constant_target_has_no_r2(spark):
    df = spark.createDataFrame([(float(i), 2.0) for i in range(10)], "x double, label double")
    m = Mo.chain(["x"], Mo.estimator("linear")).fit(df)
    assert Mo.evaluate(m, df).first()["r2"] is None


def test_families_are_compared_by_cross_validation(spark):
    rows = [(float(i), float(i % 7), 3.0 * i + 1.0) for i in range(120)]
    df = spark.createDataFrame(rows, "x double, z double, label double")
    pick, model, table = Mo.compare_families(df, ["x", "z"], {"linear": (Mo.estimator("linear"), {}), "tree": (Mo.estimator("tree"), {"maxDepth": [2, 3]})}, folds=5)
    assert pick == "linear" and table.count() == 3 and table.first()["family"] == "linear"
    assert Mo.evaluate(model, df).first()["mse"] < 1e-6
    assert Mo.cv_score(df, ["x", "z"], Mo.estimator("linear"), metric="r2") > 0.99


def test_preparation_is_fitted_once_per_fold(spark, monkeypatch):
    """candidates of a search share the preparation of their fold; only the best is refitted on all rows."""
    from pyspark.ml.feature import Imputer

    from ecospark.operators import models as Mo

    fits, fit = [], Imputer._fit
    monkeypatch.setattr(Imputer, "_fit", lambda self, df: fits.append(1) or fit(self, df))
    df = spark.createDataFrame([(float(i % 7), float(i), float(3 * (i % 7))) for i in range(60)], "a double, b double, label double")
    _, res = Mo.grid_search(df, ["a", "b"], Mo.estimator("tree"), {"maxDepth": [1, 2, 4]}, folds=2)
    assert res.count() == 3 and len(fits) == 3


def test_features_are_dealt_to_few_tasks(spark, tmp_path):
    """Tasks follow the rows and cores, not the shuffle setting, and the halves share one written table."""
    from ecospark.plans.q_models import data

    rows = [(i, i % 3, i % 5, float(i % 7), float(i), 0.1, 0.2) for i in range(40)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i, i, 1.0 * i, "x") for i in range(4)], "p_partkey long, p_size int, p_retailprice double, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        train, test = data(spark, str(tmp_path))
        assert train.rdd.getNumPartitions() == test.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert train.count() + test.count() == 40 and 0 < test.count() < 40


def test_score_matrix_scores_a_sets_models_together(spark, monkeypatch):
    """M5: one preparation per feature set and one pass per half; the scores are those of every chain by itself."""
    df = spark.range(300).selectExpr("double(id % 17) a", "double(id % 5) b", "if(id % 11 = 0, null, double(id % 7)) c",
                                     "double(id % 17) * 3 - double(id % 5) + double(id % 3) label")
    train, test = df.filter("a < 12"), df.filter("a >= 12")
    sets, ests = {"two": ["a", "b"], "all": ["a", "b", "c"]}, {"linear": Mo.estimator("linear"), "tree": Mo.estimator("tree", maxDepth=3)}
    want = {(s, n): [Mo.r2(m, x) for x in (train, test)] for s, cols in sets.items() for n, e in ests.items()
            for m in [Mo.chain(cols, e.copy()).fit(train)]}
    monkeypatch.setattr(Mo, "r2", lambda *a, **k: 1 / 0)
    for r in Mo.score_matrix(train, test, sets, ests).collect():
        assert all(math.isclose(x, y, abs_tol=1e-9) for x, y in zip((r.train_r2, r.test_r2), want.pop((r.feature_set, r.model))))
    assert not want
