"""Analogue queries for models, tuning and scoring: features of lineitem joined
to part, target l_extendedprice, hash split 80/20. Least-squares models are checked by SQL that
solves the normal equations (Gauss-Jordan elimination in a recursive query); the other models are
rows-only checks (tests hold closed forms)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ecospark.operators import features as X
from ecospark.operators import models as Mo
from ecospark.plans.least_squares import FEATURES, HALVES_SQL, TARGET, least_squares_sql, predicted_sql, scored, scores_sql
from ecospark.plans.q_features import dealt_features
from ecospark.plans.registry import register, rounded

SMALL_FOREST = {"numTrees": 20, "maxDepth": 6}
SMALL_GBT = {"maxIter": 20, "maxDepth": 3}


def data(spark, d):
    """Train/test halves of the feature table, which is joined, dealt and written once for both."""
    mark = X.in_test(["l_orderkey", "l_linenumber", "l_partkey"], 0.2, 42)
    ft = dealt_features(spark, d, F.col(TARGET).cast("double").alias("label"), mark.alias("_test"))
    return ft.filter("NOT _test").drop("_test"), ft.filter("_test").drop("_test")


def _scores(name, est, halves, cols=FEATURES, scale="standard"):
    train, test = halves
    m = Mo.chain(cols, est, scale=scale).fit(train)
    tr = Mo.evaluate(m, train).select(F.lit(name).alias("model"), F.lit("train").alias("part"), "r2", "mse", "n")
    te = Mo.evaluate(m, test).select(F.lit(name).alias("model"), F.lit("test").alias("part"), "r2", "mse", "n")
    return scored(tr.unionByName(te))


@register("M1_linear_and_ridge", f"""WITH RECURSIVE {HALVES_SQL}, {least_squares_sql()}, {least_squares_sql(alpha=1.0, name='ridge')}
    {scores_sql('linear')} UNION ALL {scores_sql('ridge', 'ridge')}""")
def m1_closed(spark, d):
    halves = data(spark, d)
    ridge = Mo.estimator("ridge", regParam=Mo.ridge_reg_param(halves[0], "label", 1.0))
    return _scores("linear", Mo.estimator("linear"), halves).unionByName(_scores("ridge", ridge, halves))


@register("M1_linear_ridge_lasso")
def m1(spark, d):
    halves = data(spark, d)
    ridge = Mo.estimator("ridge", regParam=Mo.ridge_reg_param(halves[0], "label", 1.0))  # scikit-learn's default alpha
    out = _scores("linear", Mo.estimator("linear"), halves).unionByName(_scores("ridge", ridge, halves))
    return out.unionByName(_scores("lasso", Mo.estimator("lasso", regParam=0.01), halves))


@register("M2_tree_and_forest")
def m2(spark, d):
    halves = data(spark, d)
    return _scores("tree", Mo.estimator("tree", maxDepth=6), halves, scale=None).unionByName(
        _scores("forest", Mo.estimator("forest", **SMALL_FOREST), halves, scale=None))


@register("M3_gradient_boosting")
def m3(spark, d):
    return _scores("gbt", Mo.estimator("gbt", **SMALL_GBT), data(spark, d), scale=None)


@register("M4_support_vector_regression")
def m4(spark, d):
    train, test = data(spark, d)
    rows = None
    for kernel in ("linear", "rbf"):
        svr = Mo.SVRegressor(FEATURES, "label", epsilon=0.1, c_reg=1.0, kernel=kernel).fit(train)
        for part, df in (("train", train), ("test", test)):
            p = svr.transform(df)
            y, yh = F.col("label"), F.col("prediction")
            r = p.agg((1 - F.try_divide(F.sum((y - yh) * (y - yh)), F.count(y) * F.var_pop(y))).alias("r2"),
                      F.avg((y - yh) * (y - yh)).alias("mse"), F.count(y).alias("n")).select(
                F.lit(f"svr_{kernel}").alias("model"), F.lit(part).alias("part"), "r2", "mse", "n")
            rows = r if rows is None else rows.unionByName(r)
    return rounded(rows)


@register("M5_score_matrix")
def m5(spark, d):
    """Four feature sets by five models."""
    train, test = data(spark, d)
    sets = {"all": FEATURES, "top3": ["l_quantity", "p_retailprice", "p_size"], "order": ["l_quantity", "l_discount", "l_tax", "l_linenumber"], "part": ["p_size", "p_retailprice"]}
    ests = {"linear": Mo.estimator("linear"), "ridge": Mo.estimator("ridge"), "lasso": Mo.estimator("lasso"), "tree": Mo.estimator("tree", maxDepth=5),
            "forest": Mo.estimator("forest", numTrees=10, maxDepth=5)}
    return rounded(Mo.score_matrix(train, test, sets, ests))


@register("M6_grid_search")
def m6(spark, d):
    """Twelve combinations, five folds, five fits."""
    train, _ = data(spark, d)
    _, res = Mo.forest_grid_search(train, FEATURES, {"numTrees": [5, 10, 20], "maxDepth": [3, 5, 8, 10]}, folds=5)
    return rounded(res)


@register("M6_support_vector_grid")
def m6_svr(spark, d):
    """The notebook's penalties and tolerances for the linear kernel: nine combinations, five folds, solved in the same passes."""
    train, _ = data(spark, d)
    grid = {k: v for k, v in Mo.SVR_GRID_NOTEBOOK.items() if k != "kernel"} | {"kernel": ["linear"]}
    return rounded(Mo.svr_grid_search(train, FEATURES, grid, ["l_orderkey", "l_linenumber", "l_partkey"], folds=5))


@register("M7_random_search")
def m7(spark, d):
    """Twenty draws, the later ones from the densities of good and bad earlier ones."""
    train, _ = data(spark, d)
    space = {"maxDepth": ("int", 1, 12), "minInstancesPerNode": ("int", 1, 200)}
    _, res = Mo.adaptive_search(train, FEATURES, Mo.estimator("tree"), space, n=20, batch=5, folds=5)
    return rounded(res)


@register("M8_cross_validated_score")
def m8(spark, d):
    train, _ = data(spark, d)
    return rounded(spark.createDataFrame([("linear", Mo.cv_score(train, FEATURES, Mo.estimator("linear"), folds=5))],
                                         "model string, mse double"))


@register("M9_M14_best_model")
def m9(spark, d):
    """Families compared by 5-fold CV MSE on the training half only."""
    train, _ = data(spark, d)
    families = {"linear": (Mo.estimator("linear"), {}), "lasso": (Mo.estimator("lasso"), {"regParam": [0.01, 1.0]}),
                "tree": (Mo.estimator("tree"), {"maxDepth": [5]}), "forest": (Mo.estimator("forest"), {"numTrees": [10, 20], "maxDepth": [5, 10]}),
                "svr": ("svr", {"c_reg": [0.1, 1, 10], "kernel": ["linear"]})}
    _, _, scores = Mo.compare_families(train, FEATURES, families, key=["l_orderkey", "l_linenumber", "l_partkey"])
    return rounded(scores)


@register("M10_evaluate", f"WITH RECURSIVE {HALVES_SQL}, {least_squares_sql()} {scores_sql('linear')}")
def m10(spark, d):
    return _scores("linear", Mo.estimator("linear"), data(spark, d))


@register("M11_impute_scale_poly_pipeline")
def m11(spark, d):
    train, test = data(spark, d)
    m = Mo.chain(FEATURES, Mo.estimator("linear"), impute=True, scale="standard", poly=True).fit(train)
    return scored(Mo.evaluate(m, test))


@register("M11_impute_scale_pipeline", f"""WITH RECURSIVE {HALVES_SQL}, {least_squares_sql()}
    SELECT r2, mse, n FROM ({scores_sql('linear', parts=('test',))})""")
def m11_plain(spark, d):
    """Imputation and scaling fitted on the training half change no unregularised fit."""
    train, test = data(spark, d)
    return scored(Mo.evaluate(Mo.chain(FEATURES, Mo.estimator("linear"), impute=True, scale="standard").fit(train), test))


@register("M11_selection_and_pca_pipeline")
def m11_selection(spark, d):
    """Training with selection and PCA inside the fitted pipeline; the test half passes through the same stages."""
    train, test = data(spark, d)
    m = Mo.chain(FEATURES, Mo.estimator("linear"), top_k=4, components=3).fit(train)
    return scored(Mo.evaluate(m, test))


@register("M12_predict_new_data", f"""WITH RECURSIVE {HALVES_SQL}, {least_squares_sql()}
    SELECT l_orderkey, l_linenumber, round({predicted_sql()}) AS prediction FROM rows, w WHERE part = 'test'
    AND {" AND ".join(f"{x} IS NOT NULL" for x in FEATURES)}""")
def m12(spark, d):
    train, test = data(spark, d)
    m = Mo.chain(FEATURES, Mo.estimator("linear")).fit(train)
    return rounded(Mo.predict(m, test, FEATURES).select("l_orderkey", "l_linenumber", "prediction"), 0)


@register("M13_actual_predicted_residual", f"""WITH RECURSIVE {HALVES_SQL}, {least_squares_sql()}
    SELECT l_orderkey, l_linenumber, round(y) AS actual, round(p) AS predicted, round(y - p) AS residual FROM (
      SELECT l_orderkey, l_linenumber, y, {predicted_sql()} AS p FROM rows, w WHERE part = 'test')""")
def m13(spark, d):
    train, test = data(spark, d)
    m = Mo.chain(FEATURES, Mo.estimator("linear")).fit(train)
    return rounded(Mo.predictions(m, test, keys=["l_orderkey", "l_linenumber"]), 0)


@register("M15_end_to_end_run")
def m15(spark, d):
    """Every family of the workflow and the linear one, both kernels; the pick is saved and scored as read back."""
    from ecospark.session import new_folder, table

    li = table(spark, d, "lineitem").select("l_partkey", "l_quantity", "l_discount", "l_tax", TARGET)
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size", "p_retailprice")
    families = {"linear": (Mo.estimator("linear"), {}), "forest": (Mo.estimator("forest"), {"numTrees": [10, 20], "maxDepth": [4, 6, 8]}),
                "boosting": (Mo.estimator("gbt"), {"maxIter": [10, 20], "stepSize": [0.1]}),
                "svr": ("svr", {"c_reg": [0.1, 1, 10], "kernel": ["linear", "rbf"]})}
    return rounded(Mo.run(li, [part], "l_partkey", TARGET, path=new_folder(spark, "model"), families=families, folds=5))
