"""Regressors, tuning and scoring with Spark MLlib.

Every fit is an MLlib job over the whole DataFrame; tuning fits the preparation once per fold and ``parallelism``
candidates at a time on it. The support-vector regressor (M4) has no MLlib counterpart and is solved in
:mod:`ecospark.operators.svr`.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import PCA, Imputer, UnivariateFeatureSelector
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ecospark.functions.cols import c
from ecospark.operators import grown, sampler
from ecospark.operators.features import stages as prep_stages
from ecospark.operators.forests import forest_grid_search
from ecospark.operators.svr import SVRegressor, svr_grid_search, svr_scores  # noqa: F401
from ecospark.session import cut_lineage


def estimator(name: str, label: str = "label", features: str = "features", **params):
    """M1-M3: a configured MLlib regressor. Ridge uses the normal-equation solver with the L2
    strength the caller passes (see SURVEY M1 for matching scikit-learn's alpha)."""
    common = {"labelCol": label, "featuresCol": features}
    if name == "linear":
        return LinearRegression(**common, **params)
    if name == "ridge":
        return LinearRegression(**common, elasticNetParam=0.0, solver="normal", standardization=False,
                                **{"regParam": 1.0, **params})
    if name == "lasso":
        return LinearRegression(**common, elasticNetParam=1.0, standardization=False, **{"regParam": 0.01, **params})
    if name == "tree":
        return DecisionTreeRegressor(**common, **{"seed": 42, **params})
    if name == "forest":
        # scikit-learn defaults: 100 trees, all features per split, unbounded depth (MLlib's maximum is 30)
        return RandomForestRegressor(**common, **{"numTrees": 100, "featureSubsetStrategy": "all", "maxDepth": 30,
                                                  "seed": 42, **params})
    if name == "gbt":
        return GBTRegressor(**common, **{"maxIter": 100, "maxDepth": 3, "stepSize": 0.1, "seed": 42, **params})
    raise ValueError(f"unknown estimator {name}")


def ridge_reg_param(df: DataFrame, label: str, alpha: float) -> float:
    """M1: MLlib ``regParam`` equivalent to scikit-learn ``Ridge(alpha)`` for ``estimator('ridge')``
    (normal solver, no standardisation): ``alpha * stddev_pop(y) / n`` (one aggregate)."""
    r = df.agg(F.stddev_pop(c(label)).alias("s"), F.count(c(label)).alias("n")).first()
    return float(alpha * r["s"] / r["n"]) if r["n"] else float(alpha)


# Fixed values that must equal the reference's: tuning grids and search spaces, named with the MLlib
# parameter each maps to. ``None`` depth becomes MLlib's maximum 30 (and falls
# together with the grids' own 30); depths above 30 in the search space end at 30 for the same reason; scikit-learn's ``min_samples_split``
# has no MLlib counterpart and is left out; ``min_samples_leaf`` maps to ``minInstancesPerNode``.
FOREST_GRID_NOTEBOOK = {"numTrees": [100, 200, 300], "maxDepth": [10, 20, 30], "minInstancesPerNode": [1, 2, 4]}
SVR_GRID_NOTEBOOK = {"c_reg": [0.1, 1, 10], "epsilon": [0.01, 0.1, 1], "kernel": ["linear", "rbf"]}
FOREST_GRID_WORKFLOW = {"numTrees": [50, 100, 200], "maxDepth": [30, 10, 20]}
BOOSTING_GRID_WORKFLOW = {"maxIter": [50, 100, 200], "stepSize": [0.01, 0.1, 0.2]}
SVR_GRID_WORKFLOW = {"c_reg": [0.1, 1, 10], "kernel": ["linear", "rbf"]}
FOREST_SPACE = {"numTrees": ("int", 100, 500), "maxDepth": ("int", 5, 30), "minInstancesPerNode": ("int", 1, 10)}
SVR_SPACE = {"c_reg": ("log", 1e-2, 1e2), "epsilon": ("log", 1e-3, 1e1), "kernel": ("choice", ["linear", "rbf"])}


def chain(cols: Sequence[str], est, impute: bool = True, scale: str | None = "standard", poly: bool = False,
          top_k: int | None = None, components: int | None = None) -> Pipeline:
    """Impute -> (scale) -> (poly) -> (top-k by univariate F-test) -> (PCA) -> model, fitted as one MLlib Pipeline,
    so that prediction reuses every fitted stage."""
    out = est.getFeaturesCol()
    stages = prep_stages(cols, impute, scale, poly, out="_prepared" if top_k or components else out)
    if top_k:
        stages.append(UnivariateFeatureSelector(featuresCol="_prepared", outputCol="_selected" if components else out, labelCol=est.getLabelCol())
                      .setFeatureType("continuous").setLabelType("continuous").setSelectionMode("numTopFeatures").setSelectionThreshold(top_k))
    if components:
        stages.append(PCA(k=components, inputCol="_selected" if top_k else "_prepared", outputCol=out))
    return Pipeline(stages=[*stages, est])


def evaluate(model, df: DataFrame, label: str = "label") -> DataFrame:
    """R2 (null for a constant target) and MSE as one aggregate over the scored rows."""
    p = model.transform(df)
    y, yh = F.col(label).cast("double"), F.col("prediction")
    return p.agg(
        (1 - F.try_divide(F.sum((y - yh) * (y - yh)), F.count(y) * F.var_pop(y))).alias("r2"),
        F.avg((y - yh) * (y - yh)).alias("mse"),
        F.count(y).alias("n"),
    )


def r2(model, df: DataFrame, label: str = "label") -> float:
    return RegressionEvaluator(labelCol=label, predictionCol="prediction", metricName="r2").evaluate(model.transform(df))


def residual(y: Column, yhat: Column) -> Column:
    """B34."""
    return y - yhat


def predictions(model, df: DataFrame, label: str = "label", keys: Sequence[str] = ()) -> DataFrame:
    """Actual / predicted / residual."""
    p = model.transform(df)
    return p.select(*[c(k) for k in keys], F.col(label).alias("actual"), F.col("prediction").alias("predicted"),
                    residual(F.col(label), F.col("prediction")).alias("residual"))


def predict(model: PipelineModel, df: DataFrame, feature_cols: Sequence[str]) -> DataFrame:
    """Batch prediction on new data with the same feature columns; rows with a null feature
    are dropped; every fitted stage (imputer, scaler, PCA) is reused, never refitted (Q11)."""
    return model.transform(df.dropna(subset=list(feature_cols)))


def score_matrix(train: DataFrame, test: DataFrame, feature_sets: dict[str, Sequence[str]], estimators: dict,
                 label: str = "label") -> DataFrame:
    """M5: feature set x model -> (feature_set, model, train_r2, test_r2). The preparation is fitted once per feature set, and a
    set's models are scored together in one pass over either half."""
    rows = []
    for fs, cols in feature_sets.items():
        prepared = Pipeline(stages=chain(cols, next(iter(estimators.values()))).getStages()[:-1]).fit(train) if estimators else None
        models = {name: est.copy().fit(prepared.transform(train)).setPredictionCol(f"_prediction_{i}") for i, (name, est) in enumerate(estimators.items())}
        scores = [_r2_of_all(prepared.transform(df), list(models.values()), label) for df in (train, test)] if models else [[], []]
        rows += [(fs, name, *map(float, x)) for name, *x in zip(models, *scores, strict=True)]
    return train.sparkSession.createDataFrame(rows, "feature_set string, model string, train_r2 double, test_r2 double")


def _r2_of_all(df: DataFrame, models: Sequence, label: str) -> list[float]:
    """:func:`r2` of several models over the same rows, one aggregate."""
    y, sums = c(label).cast("double"), []
    for m in models:
        df = m.transform(df)
        error = y - c(m.getPredictionCol())
        sums.append(F.sum(error * error))
    n, spread, *errors = df.agg(F.count(y), F.var_pop(y) * F.count(y), *sums).first()
    if not n:
        raise ValueError("no rows to score")
    return [1 - e / spread if spread else float("nan") if e == 0 else float("-inf") for e in errors]


def grid_search(df: DataFrame, cols: Sequence[str], est, grid: dict, folds: int = 5, seed: int = 42,
                parallelism: int = 4, label: str = "label", metric: str = "mse"):
    """M6: exhaustive grid, k-fold; lowest MSE or highest R2 wins. Returns (best PipelineModel, results DataFrame)."""
    refit, res = _cv(df, chain(cols, est), _grid(est, grid), folds, seed, parallelism, label, metric)
    return refit(), res


def _grid(est, grid: dict) -> list[dict]:
    b = ParamGridBuilder()
    for pname, values in grid.items():
        b = b.addGrid(est.getParam(pname), list(values))
    return b.build()


def random_search(df: DataFrame, cols: Sequence[str], est, space: dict, n: int = 20, folds: int = 5, seed: int = 42,
                  parallelism: int = 4, label: str = "label", metric: str = "mse"):
    """M7, its baseline: n seeded random draws from the space, k-fold CV."""
    from ecospark.operators.features import random_params

    pipe = chain(cols, est)
    maps = [{est.getParam(k): v for k, v in p.items()} for p in random_params(space, n, seed)]
    refit, res = _cv(df, pipe, maps, folds, seed, parallelism, label, metric)
    return refit(), res


def adaptive_search(df: DataFrame, cols: Sequence[str], est, space: dict, n: int = 20, batch: int = 4, startup: int = 8, folds: int = 5,
                    seed: int = 42, label: str = "label", metric: str = "mse"):
    """M7: ``n`` trials chosen by :mod:`ecospark.operators.sampler` from the results of earlier ones, a batch of trials per
    round k-fold with that parallelism. Returns (best PipelineModel, results in order of trial)."""
    pipe, sign, best_of, kept = chain(cols, est), -1.0 if metric == "r2" else 1.0, [], {}

    def evaluate_batch(asked: list[dict]) -> list[float]:
        refit, res = _cv(df, pipe, [{est.getParam(k): v for k, v in p.items()} for p in asked], folds, seed, batch, label, metric, kept)
        losses = [sign * r[metric] for r in res.orderBy("candidate").collect()]
        best_of.append((min(losses), refit))
        return losses

    trials = sampler.search(evaluate_batch, space, n, batch, startup, seed)
    rows = [(i, str(p), sign * s) for i, (p, s) in enumerate(trials)]
    return min(best_of, key=lambda x: x[0])[1](), df.sparkSession.createDataFrame(rows, f"candidate int, params string, {metric} double")


def svr_adaptive_search(df: DataFrame, cols: Sequence[str], space: dict, key: Sequence[str], n: int = 20, batch: int = 4, startup: int = 8,
                        folds: int = 5, seed: int = 42, label: str = "label", **fixed) -> DataFrame:
    """M7 for the SVR: as :func:`adaptive_search`; a round's batch and folds are solved in the same passes. (candidate, params, mse)."""
    def evaluate_batch(asked: list[dict]) -> list[float]:
        return svr_scores(df, cols, asked, key, folds, seed, label, **fixed)

    trials = sampler.search(evaluate_batch, space, n, batch, startup, seed)
    return df.sparkSession.createDataFrame([(i, str(p), float(s)) for i, (p, s) in enumerate(trials)], "candidate int, params string, mse double")


def cv_score(df: DataFrame, cols: Sequence[str], est, folds: int = 5, seed: int = 42, label: str = "label", metric: str = "mse") -> float:
    """M8: k-fold mean score of one configuration (no tuning)."""
    _, res = _cv(df, chain(cols, est), [{}], folds, seed, 1, label, metric)
    return float(res.first()[metric])


def _cv(df, pipe, maps, folds, seed, parallelism, label, metric="mse", kept=None):
    """The k-fold mean score of every parameter map of the pipeline's last stage, on the folds of MLlib's ``CrossValidator``. The stages before it
    are fitted once per fold, on the rows learned from, and not once per map; ``parallelism`` maps are fitted at a time. Trees are
    grown for all folds and maps in the same passes (:mod:`ecospark.operators.grown`); ``kept`` carries them to the next call on the same rows.
    Returns (a function that refits the pipeline with the best map on all rows, results)."""
    ev = RegressionEvaluator(labelCol=label, predictionCol="prediction", metricName=metric)
    *prep, est = pipe.getStages()
    if metric == "mse" and _grown_together(prep, est, maps, folds):
        scores = _tree_scores(df, prep[0].getInputCols(), est, maps, folds, seed, label, {} if kept is None else kept)
        return _results(df, pipe, maps, scores, metric, ev)
    used = list(dict.fromkeys([label, *(x for s in prep for n in ("inputCols", "inputCol") if s.hasParam(n) and s.isSet(n)
                               for x in ([s.getOrDefault(n)] if n == "inputCol" else s.getOrDefault(n)) if x in df.columns)]))
    scores, drawn = np.zeros(len(maps)), df.withColumn("_drawn", F.rand(seed))
    for k in range(folds):
        held = (F.col("_drawn") >= k * (1.0 / folds)) & (F.col("_drawn") < (k + 1) * (1.0 / folds))
        learn, rest = (x.select(*[c(n) for n in used]) for x in (drawn.filter(~held), drawn.filter(held)))
        fitted = Pipeline(stages=prep).fit(learn)
        learn, rest = (fitted.transform(x).select(label, est.getFeaturesCol()).persist() for x in (learn, rest))

        def score(i: int) -> tuple[int, float]:
            return i, ev.evaluate(est.fit(learn, maps[i]).transform(rest))  # noqa: B023

        with ThreadPoolExecutor(max(1, min(parallelism, len(maps)))) as pool:
            for i, s in pool.map(inheritable_thread_target(df.sparkSession)(score), range(len(maps))):
                scores[i] += s / folds
        learn.unpersist()
        rest.unpersist()
    return _results(df, pipe, maps, scores, metric, ev)


def _results(df, pipe, maps, scores, metric, ev):
    rows = [(i, str({p.name: v for p, v in pm.items()}), float(s)) for i, (pm, s) in enumerate(zip(maps, scores))]
    res = df.sparkSession.createDataFrame(rows, f"candidate int, params string, {metric} double")
    best = maps[int(np.argmax(scores) if ev.isLargerBetter() else np.argmin(scores))]
    return lambda: pipe.fit(df, best), res


def _grown_together(prep, est, maps, folds: int) -> bool:
    """Whether the models are plain trees over inputs that the preparation only imputes, shifts and scales."""
    if not isinstance(est, DecisionTreeRegressor) or folds < 2 or len(prep) != 4 or not isinstance(prep[0], Imputer) or prep[-1].getDegree() != 1:
        return False
    plain = est.getMaxBins() == grown.BINS and not est.getMinInfoGain() and not est.getMinWeightFractionPerNode() and not est.isSet(est.weightCol)
    return plain and all({p.name for p in m} <= {"maxDepth", "minInstancesPerNode"} and _of(est, m, "maxDepth") <= grown.DEEPEST for m in maps)


def _of(est, params, name: str) -> int:
    return int(params.get(est.getParam(name), est.getOrDefault(name)))


def _tree_scores(df, cols, est, maps, folds: int, seed: int, label: str, kept: dict) -> np.ndarray:
    """Mean MSE over the folds of :func:`_cv` for every map."""
    if "table" not in kept:
        drawn = df.withColumn("_drawn", F.rand(seed))
        fold = sum((F.col("_drawn") >= k * (1.0 / folds)).cast("int") for k in range(1, folds))
        kept["table"] = grown.Table(drawn, cols, label, fold, folds, est.getSeed())
    table, asked = kept["table"], [(_of(est, m, "minInstancesPerNode"), _of(est, m, "maxDepth")) for m in maps]
    depths = sorted({d for _, d in asked})
    table.grow([(k, grown.PLAIN, *a) for k in range(folds) for a in asked])
    errors = table.errors([(k, [grown.PLAIN], least) for least, _ in asked for k in range(folds)], [1], depths)
    return np.array([np.mean([errors[i * folds + k][0, depths.index(d)] for k in range(folds)]) for i, (_, d) in enumerate(asked)])


def compare_families(df: DataFrame, cols: Sequence[str], families: dict[str, tuple], folds: int = 5, seed: int = 42,
                     parallelism: int = 4, label: str = "label", metric: str = "mse", key: Sequence[str] | None = None):
    """Tune each family (name -> (estimator, grid)) by k-fold cross-validation on ``df`` alone and pick the
    best cross-validated score; no test row takes part. A forest's grid over trees and depths takes one fit per fold
    (:mod:`ecospark.operators.forests`); the estimator ``"svr"`` stands for the support-vector regressor, whose grid and folds share
    their passes (folds by ``key``). Both are scored by MSE. Returns (best family, its refitted model, table of
    ``(family, candidate, params, score)`` best first)."""
    found, table = {}, None
    for name, (est, grid) in families.items():
        if isinstance(est, str):
            combos = [dict(zip(grid, x, strict=True)) for x in itertools.product(*grid.values())]
            scores = svr_scores(df, cols, combos, key or df.columns, folds, seed, label)
            res = df.sparkSession.createDataFrame([(i, str(p), s) for i, (p, s) in enumerate(zip(combos, scores, strict=True))], "candidate int, params string, mse double")
            top = combos[min(range(len(combos)), key=lambda i: scores[i])]  # noqa: B023
            found[name] = lambda p=top: SVRegressor(cols, label, seed=seed, **p).fit(df)
        elif isinstance(est, RandomForestRegressor) and metric == "mse" and grid:
            top, res = forest_grid_search(df, cols, grid, folds, seed, label)
            found[name] = lambda e=est, p=top: _refitted_forest(df, cols, e.copy({e.getParam(k): v for k, v in p.items()}), p, label)
        else:
            found[name], res = _cv(df, chain(cols, est), _grid(est, grid), folds, seed, parallelism, label, metric)
        res = res.select(F.lit(name).alias("family"), *[c(x) for x in res.columns])
        table = res if table is None else table.unionByName(res)
    order = F.col(metric).desc() if metric == "r2" else F.col(metric).asc()
    table = table.orderBy(order, "family", "candidate")
    pick = table.first()["family"]
    return pick, found[pick](), table


def _refitted_forest(df: DataFrame, cols: Sequence[str], est, params: dict, label: str):
    """The picked forest on all rows, grown as its search grew it."""
    if est.getMaxDepth() > grown.DEEPEST or not set(params) <= {"numTrees", "maxDepth", "minInstancesPerNode"}:
        return chain(cols, est).fit(df)
    return grown.Forest(cols, label, est.getNumTrees(), est.getMaxDepth(), est.getMinInstancesPerNode(), est.getSeed()).fit(df)


def best(results: DataFrame, metric: str = "mse") -> DataFrame:
    """Results ordered by the metric (lowest first); the first row is the pick."""
    return results.orderBy(F.col(metric).asc(), *[x for x in results.columns if x != metric])


def save(model, path: str) -> None:
    """A21."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    """A21."""
    return PipelineModel.load(path)


def families_of_the_workflow(label: str = "label") -> dict[str, tuple]:
    """The families and full grids that the workflow tunes."""
    return {"forest": (estimator("forest", label=label), FOREST_GRID_WORKFLOW), "boosting": (estimator("gbt", label=label), BOOSTING_GRID_WORKFLOW),
            "svr": ("svr", SVR_GRID_WORKFLOW)}


def run(base: DataFrame, others: Sequence[DataFrame], key: str, target: str, path: str | None = None,
        sparse_ratio: float = 0.9, min_present: float = 0.9, families: dict[str, tuple] | None = None, folds: int = 5, seed: int = 42) -> DataFrame:
    """Merge (J3) -> drop sparse columns (F4) -> keep rows with enough values (B12) -> split
    (F22) -> tune every family and pick the best by cross-validation (M9) -> save (A21) -> evaluate on test (M10).
    ``families`` as in :func:`compare_families`, by default all with the workflow's full grids. With a ``path`` the pick is
    saved there, and scored as read back. Returns the pick with its test scores: (family, r2, mse, n)."""
    from ecospark.functions.clean import drop_missing, min_present_ratio
    from ecospark.operators.features import drop_sparse, split
    from ecospark.operators.joins import star

    merged = star(base, others, key)
    pruned = drop_sparse(merged, sparse_ratio, keep=[key, target])
    rows = drop_missing(pruned, min_present=min_present_ratio(pruned, min_present))
    num = [f.name for f in rows.schema.fields if f.name not in (key, target)
           and f.dataType.typeName() in ("double", "integer", "long", "float", "short")]
    data = rows.withColumn("label", c(target).cast("double")).filter(F.col("label").isNotNull())
    train, test = (cut_lineage(x) for x in split(data, key, 0.2, seed))
    pick, model, _ = compare_families(train, num, families or families_of_the_workflow(), folds, seed, key=[key, *num])
    if path and isinstance(model, (SVRegressor, grown.Forest)):
        model.save(train.sparkSession, path)
        model = type(model).load(train.sparkSession, path)
    elif path:
        save(model, path)
        model = load(path)
    return evaluate(model, test).select(F.lit(pick).alias("family"), "*")
