"""Feature pruning, selection and preparation.

Pruning is two-phase: one aggregate over the data yields a per-column report (one row per
column, so its size is bounded by the schema, not the data); the survivors are then selected
on the same lazy DataFrame. Aggregates run over column blocks (``BLOCK`` columns per pass) so
very wide tables never produce one giant plan.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    PCA,
    Imputer,
    MinMaxScaler,
    PolynomialExpansion,
    StandardScaler,
    VectorAssembler,
)
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ecospark.functions.cols import c, numeric
from ecospark.operators import profile as P
from ecospark.session import cut_lineage

BLOCK = 100


def _blocks(cols: Sequence[str]) -> list[list[str]]:
    cols = list(cols)
    return [cols[i:i + BLOCK] for i in range(0, len(cols), BLOCK)] or [[]]


def _report(df: DataFrame, cols: Sequence[str], stats, target: str | None = None) -> DataFrame:
    """Long-form per-column statistics ``(column, n, <stat>...)``. ``stats(col)`` returns
    ``[(name, sql)]`` with ``{v}`` standing for the column (and ``{t}`` for ``target``).

    One global aggregate per block of ``BLOCK`` columns (each scans only its columns), whatever the width, so no plan
    holds more than a few hundred aggregate expressions. NaN is missing, like null."""
    cols = list(cols)
    df = P.nan_to_null(df, [*cols, target] if target else cols)
    tcol = _q(target) if target else None
    out = None
    for block in _blocks(cols):
        if not block:
            continue
        names = [n for n, _ in stats(block[0])]
        aggs = ["count(1) AS _n"] + [f"{e.format(v=_q(x), t=tcol)} AS `{n}__{i}`" for i, x in enumerate(block) for n, e in stats(x)]
        one = df.selectExpr(*aggs)
        structs = ", ".join(
            "named_struct('column', " + _sql_str(x) + ", 'n', _n, "
            + ", ".join(f"'{n}', `{n}__{i}`" for n in names) + ")" for i, x in enumerate(block))
        rows = one.selectExpr(f"inline(array({structs}))")
        out = rows if out is None else out.unionByName(rows)
    return out


def _sql_str(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _q(x: str) -> str:
    return "`" + x.replace("`", "``") + "`"


def _kept(report: DataFrame, df: DataFrame, drop_col: str = "drop") -> list[str]:
    dropped = {r["column"] for r in report.filter(F.col(drop_col)).select("column").collect()}
    return [x for x in df.columns if x not in dropped]


# ---------------------------------------------------------------- F1-F4: uninformative columns


def uninformative_report(df: DataFrame, ratio: float = 0.5, cols: Sequence[str] | None = None) -> DataFrame:
    """per column: missing, zeros, ones, and ``drop`` when all null, all 0, all 1, or more than
    ``ratio * n`` null (a column of zeros with one null is not all zero)."""
    cols = list(cols) if cols else df.columns
    num = set(numeric(df))

    def stats(x):
        eq0 = "count_if({v} = 0)" if x in num else "CAST(0 AS BIGINT)"
        eq1 = "count_if({v} = 1)" if x in num else "CAST(0 AS BIGINT)"
        return [("missing", "count_if({v} IS NULL)"), ("zeros", eq0), ("ones", eq1)]

    r = _report(df, cols, stats)
    drop = ((F.col("missing") == F.col("n")) | (F.col("zeros") == F.col("n")) | (F.col("ones") == F.col("n"))
            | (F.col("missing") > F.col("n") * F.lit(ratio)))
    return r.withColumn("drop", drop)


def drop_uninformative(df: DataFrame, ratio: float = 0.5, keep: Sequence[str] = ()) -> DataFrame:
    cols = [x for x in df.columns if x not in set(keep)]
    return df.select(*[c(x) for x in _kept(uninformative_report(df, ratio, cols), df)])


def constant_report(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """a column with one distinct non-null value that is 0 or 1 (min == max in {0, 1})."""
    cols = list(cols) if cols else numeric(df)
    r = _report(df, cols, lambda x: [("lo", "CAST(min({v}) AS DOUBLE)"), ("hi", "CAST(max({v}) AS DOUBLE)")])
    return r.withColumn("drop", F.coalesce((F.col("lo") == F.col("hi")) & F.col("lo").isin(0.0, 1.0), F.lit(False)))


def drop_constant(df: DataFrame) -> DataFrame:
    return df.select(*[c(x) for x in _kept(constant_report(df), df)])


def variance_report(df: DataFrame, threshold: float = 0.01, cols: Sequence[str] | None = None) -> DataFrame:
    """population variance (nulls ignored); ``drop`` unless variance > threshold (all-null
    columns have no variance and go too). Non-numeric columns are not judged."""
    cols = list(cols) if cols else numeric(df)
    r = _report(df, cols, lambda x: [("variance", "var_pop(CAST({v} AS DOUBLE))")])
    return r.withColumn("drop", ~F.coalesce(F.col("variance") > threshold, F.lit(False)))


def drop_low_variance(df: DataFrame, threshold: float = 0.01) -> DataFrame:
    return df.select(*[c(x) for x in _kept(variance_report(df, threshold), df)])


def sparse_report(df: DataFrame, ratio: float = 0.9, cols: Sequence[str] | None = None) -> DataFrame:
    """drop all-null, single-valued (one distinct non-null value, compared in the column's own type) and
    > ratio null columns. ``(column, n, missing, single, drop)``."""
    cols = list(cols) if cols else df.columns

    def stats(x):
        return [("missing", "count_if({v} IS NULL)"), ("single", "coalesce(min({v}) = max({v}), false)")]

    r = _report(df, cols, stats)
    return r.withColumn("drop", (F.col("missing") == F.col("n")) | F.col("single")
                        | (F.col("missing") > F.col("n") * F.lit(ratio)))


def drop_sparse(df: DataFrame, ratio: float = 0.9, keep: Sequence[str] = ()) -> DataFrame:
    cols = [x for x in df.columns if x not in set(keep)]
    return df.select(*[c(x) for x in _kept(sparse_report(df, ratio, cols), df)])


# ---------------------------------------------------------------- F5-F7: correlation rules


def weak_report(df: DataFrame, target: str, threshold: float = 0.01, cols: Sequence[str] | None = None) -> DataFrame:
    """Spearman rho with the target; ``drop`` when abs(rho) < threshold (null rho is kept)."""
    cols = [x for x in (cols or numeric(df)) if x != target]
    return P.spearman(df, target, cols).withColumn("drop", F.coalesce(F.abs("rho") < threshold, F.lit(False)))


def drop_weak(df: DataFrame, target: str, threshold: float = 0.01) -> DataFrame:
    r = weak_report(df, target, threshold).withColumnRenamed("feature", "column")
    return df.select(*[c(x) for x in _kept(r, df)])


def weak_and_collinear_report(df: DataFrame, target: str, low: float = 0.1, high: float = 0.9,
                              cols: Sequence[str] | None = None) -> DataFrame:
    """drop features with abs(Pearson vs target) < low, and both members of any feature pair
    with abs(r) > high. ``(column, r_target, collinear, drop)``."""
    cols = [x for x in (cols or numeric(df)) if x != target]
    found = cut_lineage(P.pearson(df, [*cols, target]))  # one pass over the data for both rules
    rt = found.filter(F.col("b") == target).select(F.col("a").alias("column"), F.col("r").alias("r_target"))
    pairs = found.filter((F.col("b") != target) & (F.abs("r") > high))
    members = pairs.select(F.explode(F.array("a", "b")).alias("column")).distinct().withColumn("collinear", F.lit(True))
    names = df.sparkSession.createDataFrame([(x,) for x in cols], "column string")
    out = names.join(rt, "column", "left").join(members, "column", "left")
    out = out.withColumn("collinear", F.coalesce("collinear", F.lit(False)))
    return out.withColumn("drop", F.coalesce(F.abs("r_target") < low, F.lit(False)) | F.col("collinear"))


def drop_collinear_report(df: DataFrame, threshold: float = 0.9, cols: Sequence[str] | None = None) -> DataFrame:
    """for each pair i < j (column order) with abs(r) > threshold, drop the later column j."""
    cols = list(cols) if cols else numeric(df)
    pairs = P.pearson(df, cols).filter(F.abs("r") > threshold)
    dropped = pairs.select(F.col("b").alias("column")).distinct().withColumn("drop", F.lit(True))
    names = df.sparkSession.createDataFrame([(x,) for x in cols], "column string")
    return names.join(dropped, "column", "left").select("column", F.coalesce("drop", F.lit(False)).alias("drop"))


def drop_collinear(df: DataFrame, threshold: float = 0.9) -> DataFrame:
    return df.select(*[c(x) for x in _kept(drop_collinear_report(df, threshold), df)])


# ---------------------------------------------------------------- F8, F9: univariate scores


def f_test(df: DataFrame, target: str, k: int, cols: Sequence[str] | None = None) -> DataFrame:
    """F8: univariate regression F statistic per feature, F = r^2 / (1 - r^2) * (n - 2) over the
    pairwise-complete rows; the k best are ``selected`` (ties by name)."""
    cols = [x for x in (cols or numeric(df)) if x != target]
    corr = P.SAFE_CORR_SQL.format(a="CAST({v} AS DOUBLE)", b="CAST({t} AS DOUBLE)")
    stats = _report(df, cols, lambda x: [("r", corr),
                                          ("m", "count_if({v} IS NOT NULL AND {t} IS NOT NULL)")], target=target)
    fv = F.try_divide(F.col("r") * F.col("r"), 1 - F.col("r") * F.col("r")) * (F.col("m") - 2)
    scored = stats.select(F.col("column").alias("feature"), fv.alias("f_value"))
    top = scored.filter(F.col("f_value").isNotNull()).orderBy(F.col("f_value").desc(), "feature").limit(k).select(
        "feature", F.lit(True).alias("selected"))
    return scored.join(F.broadcast(top), "feature", "left").select(
        "feature", "f_value", F.coalesce("selected", F.lit(False)).alias("selected"))


def mutual_info(df: DataFrame, target: str, k: int, bins: int = 10, cols: Sequence[str] | None = None) -> DataFrame:
    """F9 (re-aimed): mutual information between quantile-binned feature and target (nats), from one
    ``groupBy(feature, bin_x, bin_y).count``; the k best are ``selected``. A value's bin is the number of inner
    quantile edges (1/bins, 2/bins, ...) below it, so an outlier moves no edge. Rows where either side is missing
    (null or NaN) don't count for that feature."""
    cols = [x for x in (cols or numeric(df)) if x != target]
    use = [*cols, target]
    df = P.nan_to_null(df, use)
    inner = [i / bins for i in range(1, bins)]
    edges: dict[str, list[float]] = {}
    for r in P.exact_quantiles(df, use, inner).orderBy("column", "q").collect():  # columns x (bins - 1) rows
        edges.setdefault(r["column"], []).append(r["value"])

    def binned(x):
        v = c(x).cast("double")
        return F.when(v.isNotNull(), sum((F.when(v > F.lit(e), 1).otherwise(0) for e in edges.get(x, [])), F.lit(0)))

    long = df.select(binned(target).alias("by"), F.explode(F.array(*[F.struct(F.lit(x).alias("feature"), binned(x).alias("bx"))
                                                                     for x in cols])).alias("r")).select("by", "r.*")
    long = long.filter(F.col("bx").isNotNull() & F.col("by").isNotNull())
    joint = long.groupBy("feature", "bx", "by").agg(F.count(F.lit(1)).alias("nxy"))
    tot = joint.groupBy("feature").agg(F.sum("nxy").alias("n"))
    px = joint.groupBy("feature", "bx").agg(F.sum("nxy").alias("nx"))
    py = joint.groupBy("feature", "by").agg(F.sum("nxy").alias("ny"))
    terms = joint.join(tot, "feature").join(px, ["feature", "bx"]).join(py, ["feature", "by"])
    mi = terms.groupBy("feature").agg(F.sum(F.col("nxy") / F.col("n") * F.log(F.col("nxy") * F.col("n") / (F.col("nx") * F.col("ny"))))
                                      .alias("mi"))
    top = mi.orderBy(F.col("mi").desc(), "feature").limit(k).select("feature", F.lit(True).alias("selected"))
    return mi.join(F.broadcast(top), "feature", "left").select("feature", "mi", F.coalesce("selected", F.lit(False)).alias("selected"))


# ---------------------------------------------------------------- F10-F15: model-based selection


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="skip").transform(df)


def rfe(df: DataFrame, target: str, cols: Sequence[str], k: int, step: int = 1, seed: int = 42,
        num_trees: int = 20, max_depth: int = 8) -> DataFrame:
    """recursive elimination with a forest: refit, drop the ``step`` least important, until
    ``k`` remain. ``(feature, rank)``: 1 for kept, larger for earlier eliminated."""
    data = df.select(*[c(x).cast("double").alias(x) for x in cols], c(target).cast("double").alias("label")).dropna().cache()
    remaining, ranks, rnd = list(cols), {}, 0
    while len(remaining) > k:
        rnd += 1
        model = RandomForestRegressor(numTrees=num_trees, maxDepth=max_depth, seed=seed).fit(assemble(data, remaining))
        imp = model.featureImportances.toArray()
        order = sorted(range(len(remaining)), key=lambda i: (imp[i], remaining[i]))
        n_drop = min(step, len(remaining) - k)
        for i in order[:n_drop]:
            ranks[remaining[i]] = rnd
        remaining = [x for i, x in enumerate(remaining) if i not in set(order[:n_drop])]
    data.unpersist()
    last = rnd + 1
    rows = [(x, 1) for x in remaining] + [(x, last - r + 1) for x, r in ranks.items()]
    return df.sparkSession.createDataFrame(rows, "feature string, rank int")


def by_lasso(df: DataFrame, target: str, cols: Sequence[str], alpha: float = 0.01, tol: float = 1e-5) -> DataFrame:
    """Lasso (L1, regParam = alpha, unstandardised), keep features with abs(coef) > tol."""
    data = assemble(df.select(*[c(x).cast("double").alias(x) for x in cols], c(target).cast("double").alias("label")), cols)
    m = LinearRegression(elasticNetParam=1.0, regParam=alpha, standardization=False, maxIter=200).fit(data)
    coef = m.coefficients.toArray()
    return df.sparkSession.createDataFrame([(x, float(w), bool(abs(w) > tol)) for x, w in zip(cols, coef)],
                                           "feature string, coefficient double, selected boolean")


def by_forest(df: DataFrame, target: str, cols: Sequence[str], seed: int = 42, num_trees: int = 20, max_depth: int = 8) -> DataFrame:
    """forest importances; keep features with importance >= mean importance."""
    data = assemble(df.select(*[c(x).cast("double").alias(x) for x in cols], c(target).cast("double").alias("label")), cols)
    imp = RandomForestRegressor(numTrees=num_trees, maxDepth=max_depth, seed=seed).fit(data).featureImportances.toArray()
    mean = float(sum(imp) / len(imp)) if len(imp) else 0.0
    return df.sparkSession.createDataFrame([(x, float(v), bool(v >= mean)) for x, v in zip(cols, imp)],
                                           "feature string, importance double, selected boolean")


def linear_importance(df: DataFrame, target: str, cols: Sequence[str], n: int = 10) -> DataFrame:
    """abs(linear coefficient) per feature (rows with nulls dropped), top n."""
    data = assemble(df.select(*[c(x).cast("double").alias(x) for x in cols], c(target).cast("double").alias("label")).dropna(), cols)
    coef = LinearRegression(maxIter=100, standardization=False).fit(data).coefficients.toArray()
    imp = df.sparkSession.createDataFrame([(x, float(abs(w))) for x, w in zip(cols, coef)], "feature string, importance double")
    return imp.orderBy(F.col("importance").desc(), "feature").limit(n)


def permutation_importance(model: PipelineModel, df: DataFrame, target: str, cols: Sequence[str], seed: int = 42,
                           metric: str = "r2") -> DataFrame:
    """F14 (re-aimed from tree explainers): drop in R2 (or rise in MSE) when one feature is permuted.

    One job: rows are scattered to random partitions; each task emits, for every feature, a copy
    of its rows with that feature shuffled among them (a random permutation within random blocks)
    plus the unpermuted rows; all copies are scored by one ``transform`` and one aggregate grouped
    by the permuted feature. No row order and no single task is involved."""
    import numpy as np

    tagged_schema = T.StructType([*df.schema.fields, T.StructField("_permuted", T.StringType())])
    names = list(cols)

    def copies(it):
        from pyspark import TaskContext

        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        for pdf in it:
            yield pdf.assign(_permuted="")
            for x in names:
                out = pdf.copy()
                out[x] = rng.permutation(out[x].to_numpy())
                yield out.assign(_permuted=x)

    scattered = df.repartition(max(df.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism),
                               F.rand(seed))
    scored = model.transform(scattered.mapInPandas(copies, tagged_schema))
    y, yh = c(target).cast("double"), F.col("prediction")
    per = scored.groupBy("_permuted").agg(
        (1 - F.try_divide(F.sum((y - yh) * (y - yh)), F.count(y) * F.var_pop(y))).alias("r2"), F.avg((y - yh) * (y - yh)).alias("mse"))
    base = per.filter(F.col("_permuted") == "").select(F.col("r2").alias("_r2"), F.col("mse").alias("_mse"))
    change = (F.col("_r2") - F.col("r2")) if metric == "r2" else (F.col("mse") - F.col("_mse"))
    # ``base`` is one row: the cross product with the per-feature rows is bounded by the feature count
    return per.filter(F.col("_permuted") != "").join(F.broadcast(base), how="inner").select(
        F.col("_permuted").alias("feature"), change.alias("importance"))


def pca(df: DataFrame, cols: Sequence[str], k: int) -> tuple[DataFrame, DataFrame]:
    """centred PCA to k components (mean imputation first). Returns the projected rows
    (``pca`` vector) and ``(component, ratio, cumulative)`` explained-variance ratios."""
    tmp = [f"__p{i}" for i in range(len(cols))]
    x = df.withColumns({t: c(n).cast("double") for t, n in zip(tmp, cols)})
    stages = [Imputer(strategy="mean", inputCols=tmp, outputCols=tmp), VectorAssembler(inputCols=tmp, outputCol="_v"),
              StandardScaler(withMean=True, withStd=False, inputCol="_v", outputCol="_c"),
              PCA(k=k, inputCol="_c", outputCol="pca")]
    model = Pipeline(stages=stages).fit(x)
    out = model.transform(x).drop(*tmp, "_v", "_c")
    ratios = [float(r) for r in model.stages[-1].explainedVariance.toArray()]
    # k ratios (k = number of components, a parameter): the running total is computed right here
    rows = [(i + 1, r, float(sum(ratios[:i + 1]))) for i, r in enumerate(ratios)]
    return out, df.sparkSession.createDataFrame(rows, "component int, ratio double, cumulative double")


# ---------------------------------------------------------------- F16-F22: preparation


def standardize(df: DataFrame, cols: Sequence[str], population: bool = True) -> DataFrame:
    """F17 as columns: (x - mean) / sd with the population SD (the reference's scaler)."""
    sd = F.stddev_pop if population else F.stddev_samp
    st = df.agg(*[F.avg(c(x)).alias(f"m{i}") for i, x in enumerate(cols)], *[sd(c(x)).alias(f"s{i}") for i, x in enumerate(cols)]).first()
    return df.withColumns({x: (c(x) - F.lit(st[f"m{i}"])) / F.lit(st[f"s{i}"]) if st[f"s{i}"] else F.lit(0.0)
                           for i, x in enumerate(cols)})


def min_max(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """F18 as columns: (x - min) / (max - min); constant columns -> 0.5 (as MLlib's MinMaxScaler)."""
    st = df.agg(*[F.min(c(x)).alias(f"lo{i}") for i, x in enumerate(cols)], *[F.max(c(x)).alias(f"hi{i}") for i, x in enumerate(cols)]).first()
    out = {}
    for i, x in enumerate(cols):
        lo, hi = st[f"lo{i}"], st[f"hi{i}"]
        out[x] = (c(x) - F.lit(lo)) / F.lit(float(hi - lo)) if hi is not None and hi != lo else F.lit(0.5)
    return df.withColumns(out)


def poly2(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """F21 as columns: degree-2 expansion without bias: x_i and x_i * x_j for i <= j."""
    extra = {f"{a}*{b}": c(a) * c(b) for i, a in enumerate(cols) for b in cols[i:]}
    return df.withColumns(extra)


def stages(cols: Sequence[str], impute: bool = True, scale: str | None = "standard", poly: bool = False,
           out: str = "features") -> list:
    """F16/F17/F18/F21 as MLlib stages fitted on train only: Imputer -> assemble -> scaler -> poly.
    (MLlib's StandardScaler divides by the sample SD; a uniform factor sqrt(n/(n-1)) from the
    reference's population SD, which changes no unregularised fit.)"""
    tmp = [f"__s{i}" for i in range(len(cols))]
    st: list = []
    src = list(cols)
    if impute:
        st.append(Imputer(strategy="mean", inputCols=list(cols), outputCols=tmp))
        src = tmp
    st.append(VectorAssembler(inputCols=src, outputCol="_raw", handleInvalid="keep"))
    cur = "_raw"
    if scale == "standard":
        st.append(StandardScaler(withMean=True, withStd=True, inputCol=cur, outputCol="_scaled"))
        cur = "_scaled"
    elif scale == "minmax":
        st.append(MinMaxScaler(inputCol=cur, outputCol="_scaled"))
        cur = "_scaled"
    st.append(PolynomialExpansion(degree=2 if poly else 1, inputCol=cur, outputCol=out))
    return st


#: levels that one-hot encoding makes columns of
MAX_LEVELS = 10_000


def encode(df: DataFrame, cols: Sequence[str], method: str = "one-hot") -> DataFrame:
    """F19 one-hot with the first (alphabetical) level dropped; F20 label codes in sorted order.

    A null level is no level: null (and only null) in every dummy column, and code = number of levels. F19 turns
    levels into columns, so a column with more than ``MAX_LEVELS`` levels is refused, before any level is collected.
    F20 counts the levels, ranks them by the distributed prefix sum and joins the codes on (nothing is collected)."""
    out = df
    for x in cols:
        levels = df.select(c(x).alias("_level")).filter("_level IS NOT NULL").groupBy("_level").agg(F.lit(1).alias("_one"))
        if method == "label":
            codes = P.prefix_sum(levels, ["_level"], "_one", out="_upto").select("_level", (F.col("_upto") - 1).cast("double").alias("_code"))
            code = F.coalesce("_code", F.lit(float(codes.count()))).alias(x)
            out = out.join(codes, c(x) == F.col("_level"), "left").select(*[c(n) for n in out.columns if n != x], code)
            continue
        names = sorted(r[0] for r in levels.select("_level").limit(MAX_LEVELS + 1).collect())
        if len(names) > MAX_LEVELS:
            raise ValueError(f"{x} has more than {MAX_LEVELS} levels: use label codes")
        out = out.withColumns({f"{x}_{v}": (c(x) == F.lit(v)).cast("double") for v in names[1:]}).drop(x)
    return out


def split(df: DataFrame, key: Sequence[str] | str, test: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """deterministic train/test split by a digest of the seed and the key (joined by ``|``, the first 32 bits of
    its md5): stable under any repartitioning and engine, no shuffle, disjoint by construction."""
    marked = df.withColumn("_test", in_test(key, test, seed))
    return marked.filter("NOT _test").drop("_test"), marked.filter("_test").drop("_test")


def in_test(key: Sequence[str] | str, test: float = 0.2, seed: int = 42) -> Column:
    """whether :func:`split` puts a row into the test half."""
    keys = [key] if isinstance(key, str) else list(key)
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[c(k).cast("string") for k in keys]))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(1_000_000)) / 1_000_000.0 < test


def random_params(space: dict, n: int, seed: int = 42) -> list[dict]:
    """M7 helper: n seeded draws from a space of ('int', lo, hi) / ('log', lo, hi) / ('choice', [...])."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        p = {}
        for name, spec in space.items():
            kind = spec[0]
            if kind == "int":
                p[name] = rng.randint(spec[1], spec[2])
            elif kind == "log":
                p[name] = math.exp(rng.uniform(math.log(spec[1]), math.log(spec[2])))
            else:
                p[name] = rng.choice(spec[1])
        out.append(p)
    return out
