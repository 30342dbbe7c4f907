"""Analogue queries for feature pruning, selection and preparation: numeric
columns of ``lineitem`` joined to ``part``, target ``l_extendedprice``. F1-F4 add constant, zero
and null-heavy columns in the query; each pruning rule is checked through its per-column report."""

from __future__ import annotations

from pyspark.sql import functions as F

from ecospark.operators import features as X
from ecospark.plans.least_squares import FEATURES, HALVES_SQL, TARGET, least_squares_sql
from ecospark.plans.registry import register, rounded
from ecospark.session import table


_EXTRA = {
    "zero_col": ("0.0", lambda: F.lit(0.0)),
    "one_col": ("1.0", lambda: F.lit(1.0)),
    "const7": ("7.0", lambda: F.lit(7.0)),
    "null_col": ("NULL::DOUBLE", lambda: F.lit(None).cast("double")),
    "mostly_null": ("CASE WHEN l_linenumber = 1 THEN l_tax END", lambda: F.when(F.col("l_linenumber") == 1, F.col("l_tax"))),
    "zeros_some_null": ("CASE WHEN l_linenumber = 3 THEN NULL ELSE 0.0 END",
                        lambda: F.when(F.col("l_linenumber") == 3, F.lit(None).cast("double")).otherwise(F.lit(0.0))),
    "qty_copy": ("l_quantity * 2 + 1", lambda: F.col("l_quantity") * 2 + 1),
}
WIDE_COLS = ["l_quantity", "l_discount", "l_tax", "l_returnflag", *_EXTRA]
WIDE_SQL = ("(SELECT l_quantity, l_discount, l_tax, l_returnflag, "
            + ", ".join(f"{sql} AS {n}" for n, (sql, _) in _EXTRA.items()) + " FROM lineitem)")


def wide(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("l_quantity", "l_discount", "l_tax", "l_returnflag", *[e().alias(n) for n, (_, e) in _EXTRA.items()])


def feature_table(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax", TARGET)
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size", "p_retailprice", "p_type")
    return li.join(p, "l_partkey", "left")


#: rows of a task in a fit
TASK_ROWS = 1_000_000


def dealt_features(spark, d, *extra):
    """The numeric columns of the feature table (and ``extra`` ones), dealt over all tasks by a hash of the rows' key and written once to the
    checkpoint folder, so that every MLlib pass reads it instead of the join. A tree fit's task sends the histograms of a
    whole level, however few rows it holds: there are two tasks a core, or one per ``TASK_ROWS``."""
    from ecospark.session import cut_lineage

    key = ["l_orderkey", "l_linenumber", "l_partkey"]
    cores = spark.sparkContext.defaultParallelism
    wanted = max(2 * cores, -(-table(spark, d, "lineitem").count() // TASK_ROWS))
    parts = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), cores), wanted)
    return cut_lineage(feature_table(spark, d).drop("p_type").select("*", *extra).repartition(parts, *key))


def materialized_features(spark, d):
    """The feature table for model-based selection (several MLlib passes)."""
    return dealt_features(spark, d)


FT_SQL = """(SELECT l.l_orderkey, l.l_linenumber, l.l_quantity, l.l_discount, l.l_tax, l.l_extendedprice, p.p_size,
    p.p_retailprice, p.p_type FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey)"""
NUM_WIDE = [x for x in WIDE_COLS if x != "l_returnflag"]


def _f1_row(x):
    num = x != "l_returnflag"
    z = f"count(CASE WHEN {x} = 0 THEN 1 END)" if num else "0::BIGINT"
    o = f"count(CASE WHEN {x} = 1 THEN 1 END)" if num else "0::BIGINT"
    m = f"count(*) FILTER (WHERE {x} IS NULL)"
    return (f"SELECT '{x}' AS column, count(*) AS n, {m} AS missing, {z} AS zeros, {o} AS ones, "
            f"({m} = count(*) OR {z} = count(*) OR {o} = count(*) OR {m} > count(*) * 0.5) AS drop FROM {WIDE_SQL}")


@register("F1_uninformative_columns", " UNION ALL ".join(_f1_row(x) for x in WIDE_COLS))
def f1(spark, d):
    return X.uninformative_report(wide(spark, d), 0.5)


@register("F2_constant_columns", " UNION ALL ".join(
    f"SELECT '{x}' AS column, count(*) AS n, min({x})::DOUBLE AS lo, max({x})::DOUBLE AS hi, "
    f"coalesce(min({x}) = max({x}) AND min({x})::DOUBLE IN (0.0, 1.0), false) AS drop FROM {WIDE_SQL}" for x in NUM_WIDE))
def f2(spark, d):
    return rounded(X.constant_report(wide(spark, d)))


@register("F3_low_variance", " UNION ALL ".join(
    f"SELECT '{x}' AS column, count(*) AS n, round(var_pop({x}::DOUBLE), 6) AS variance, "
    f"NOT coalesce(var_pop({x}::DOUBLE) > 0.01, false) AS drop FROM {WIDE_SQL}" for x in NUM_WIDE))
def f3(spark, d):
    return rounded(X.variance_report(wide(spark, d), 0.01))


def _f4_row(x):
    v = f"{x}::DOUBLE" if x != "l_returnflag" else x
    m = f"count(*) FILTER (WHERE {x} IS NULL)"
    single = f"coalesce(min({v}) = max({v}), false)"
    return (f"SELECT '{x}' AS column, count(*) AS n, {m} AS missing, {single} AS single, "
            f"({m} = count(*) OR {single} OR {m} > count(*) * 0.9) AS drop FROM {WIDE_SQL}")


@register("F4_sparse_columns", " UNION ALL ".join(_f4_row(x) for x in WIDE_COLS))
def f4(spark, d):
    return X.sparse_report(wide(spark, d), 0.9)


_RANK = "(rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0)"
F5_COLS = ["l_quantity", "l_discount", "l_tax", "p_size", "p_retailprice"]


@register("F5_weak_spearman", " UNION ALL ".join(
    f"""SELECT '{x}' AS feature, round(rho, 6) AS rho, coalesce(abs(rho) < 0.01, false) AS drop FROM (
      SELECT corr(rx, ry) AS rho FROM (SELECT {_RANK.format(x=x)} AS rx, {_RANK.format(x=TARGET)} AS ry FROM {FT_SQL}
      WHERE {x} IS NOT NULL AND {TARGET} IS NOT NULL))""" for x in F5_COLS))
def f5(spark, d):
    return rounded(X.weak_report(feature_table(spark, d), TARGET, 0.01, F5_COLS))


F6_COLS = ["l_quantity", "l_discount", "l_tax", "qty_copy"]
F6_SQL_SRC = f"(SELECT l_quantity, l_discount, l_tax, l_quantity * 2 + 1 AS qty_copy, {TARGET} FROM lineitem)"


def _f6_sql():
    pairs = [(a, b) for i, a in enumerate(F6_COLS) for b in F6_COLS[i + 1:]]
    pr = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM {F6_SQL_SRC}" for a, b in pairs)
    rt = " UNION ALL ".join(f"SELECT '{x}' AS column, corr({x}, {TARGET}) AS r_target FROM {F6_SQL_SRC}" for x in F6_COLS)
    return f"""WITH pr AS ({pr}), rt AS ({rt}),
      m AS (SELECT a AS column FROM pr WHERE abs(r) > 0.9 UNION SELECT b FROM pr WHERE abs(r) > 0.9)
      SELECT rt.column, round(r_target, 6) AS r_target, m.column IS NOT NULL AS collinear,
             coalesce(abs(r_target) < 0.1, false) OR m.column IS NOT NULL AS drop FROM rt LEFT JOIN m ON rt.column = m.column"""


def _f6_df(spark, d):
    return table(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax", (F.col("l_quantity") * 2 + 1).alias("qty_copy"), TARGET)


@register("F6_weak_and_collinear", _f6_sql())
def f6(spark, d):
    return rounded(X.weak_and_collinear_report(_f6_df(spark, d), TARGET, 0.1, 0.9, F6_COLS))


@register("F7_drop_later_collinear", " UNION ALL ".join(
    f"""SELECT '{b}' AS column, coalesce(bool_or(abs(r) > 0.9), false) AS drop FROM ("""
    + (" UNION ALL ".join(f"SELECT corr({a}, {b}) AS r FROM {F6_SQL_SRC}" for a in F6_COLS[:j]) or f"SELECT NULL::DOUBLE AS r")
    + ")" for j, b in enumerate(F6_COLS)))
def f7(spark, d):
    return X.drop_collinear_report(_f6_df(spark, d), 0.9, F6_COLS)


F8_COLS = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "p_size", "p_retailprice"]


@register("F8_f_test_top_k", f"""WITH s AS ({" UNION ALL ".join(
    f"SELECT '{x}' AS feature, corr({x}, {TARGET}) AS r, count(*) FILTER (WHERE {x} IS NOT NULL AND {TARGET} IS NOT NULL) AS m FROM {FT_SQL}" for x in F8_COLS)}),
    f AS (SELECT feature, r * r / nullif(1 - r * r, 0) * (m - 2) AS f_value FROM s),
    t AS (SELECT feature FROM f WHERE f_value IS NOT NULL ORDER BY f_value DESC, feature LIMIT 3)
    SELECT f.feature, round(f_value, 6) AS f_value, t.feature IS NOT NULL AS selected FROM f LEFT JOIN t ON f.feature = t.feature""")
def f8(spark, d):
    return rounded(X.f_test(feature_table(spark, d), TARGET, 3, F8_COLS))


MI_COLS = ["l_quantity", "l_discount", "l_tax", "p_size"]


def _mi_sql(bins=10):
    qs = "[" + ", ".join(str(i / bins) for i in range(1, bins)) + "]"
    mm = ", ".join(f"quantile_cont({x}, {qs}) AS q_{x}" for x in [*MI_COLS, TARGET])

    def b(x):
        return f"len(list_filter(q_{x}, lambda e: {x} > e))"

    long = " UNION ALL ".join(f"SELECT '{x}' AS feature, {b(x)} AS bx, {b(TARGET)} AS yb FROM {FT_SQL}, mm WHERE {x} IS NOT NULL AND {TARGET} IS NOT NULL" for x in MI_COLS)
    return f"""WITH mm AS (SELECT {mm} FROM {FT_SQL}), l AS ({long}),
      j AS (SELECT feature, bx, yb, count(*) AS nxy FROM l GROUP BY 1, 2, 3),
      t AS (SELECT feature, sum(nxy) AS n FROM j GROUP BY 1),
      px AS (SELECT feature, bx, sum(nxy) AS nx FROM j GROUP BY 1, 2),
      py AS (SELECT feature, yb, sum(nxy) AS ny FROM j GROUP BY 1, 2),
      mi AS (SELECT j.feature, sum(nxy / n * ln(nxy * n / (nx * ny))) AS mi FROM j JOIN t ON j.feature = t.feature
             JOIN px ON j.feature = px.feature AND j.bx = px.bx JOIN py ON j.feature = py.feature AND j.yb = py.yb GROUP BY 1),
      top AS (SELECT feature FROM mi ORDER BY mi DESC, feature LIMIT 2)
      SELECT mi.feature, round(mi.mi, 6) AS mi, top.feature IS NOT NULL AS selected FROM mi LEFT JOIN top ON mi.feature = top.feature"""


@register("F9_mutual_information", _mi_sql())
def f9(spark, d):
    return rounded(X.mutual_info(feature_table(spark, d), TARGET, 2, 10, MI_COLS))


@register("F9_neighbour_mutual_information")
def f9_neighbours(spark, d):
    """The nearest-neighbour estimate (3 neighbours) over all rows."""
    from ecospark.operators import neighbour_mi

    ft = materialized_features(spark, d).select(*MI_COLS, TARGET)
    return rounded(neighbour_mi.mutual_info(ft, TARGET, 2, 3, MI_COLS))


@register("F10_recursive_elimination")
def f10(spark, d):
    return X.rfe(materialized_features(spark, d), TARGET, FEATURES, k=3, step=1, num_trees=20, max_depth=8)


@register("F11_lasso_selection")
def f11(spark, d):
    return rounded(X.by_lasso(materialized_features(spark, d), TARGET, FEATURES, alpha=0.01))


@register("F12_forest_selection")
def f12(spark, d):
    return rounded(X.by_forest(materialized_features(spark, d), TARGET, FEATURES, num_trees=50, max_depth=8))


_NAMES_SQL = "[" + ", ".join(f"'{x}'" for x in FEATURES) + "]"


@register("F13_linear_importance", f"""WITH RECURSIVE {HALVES_SQL}, {least_squares_sql(where="true")}
    SELECT feature, round(importance, 2) AS importance FROM (SELECT unnest({_NAMES_SQL}) AS feature, abs(unnest(w)) AS importance FROM w)
    ORDER BY importance DESC, feature LIMIT 4""")
def f13(spark, d):
    return rounded(X.linear_importance(materialized_features(spark, d), TARGET, FEATURES, n=4), 2)


@register("F14_permutation_importance")
def f14(spark, d):
    from ecospark.operators import models as Mo

    ft = feature_table(spark, d).withColumn("label", F.col(TARGET))
    model = Mo.chain(FEATURES, Mo.estimator("linear")).fit(ft)
    return rounded(X.permutation_importance(model, ft, "label", FEATURES))


@register("F14_tree_attribution")
def f14_trees(spark, d):
    """Mean absolute share of each input in a forest's predictions, over all rows."""
    from ecospark.operators import attribution
    from ecospark.operators import models as Mo

    ft = materialized_features(spark, d).withColumn("label", F.col(TARGET).cast("double"))
    model = Mo.chain(FEATURES, Mo.estimator("forest", numTrees=20, maxDepth=6), scale=None).fit(ft)
    return rounded(attribution.importance(model, ft, FEATURES))


@register("F15_pca_explained_variance")
def f15(spark, d):
    _, ev = X.pca(materialized_features(spark, d), FEATURES, 3)
    return rounded(ev)


_COV2 = f"""SELECT covar_pop(l_quantity, l_quantity) AS a, covar_pop(l_quantity, p_retailprice) AS b, covar_pop(p_retailprice, p_retailprice) AS c
    FROM {FT_SQL} WHERE p_retailprice IS NOT NULL"""


@register("F15_pca_two_columns", f"""SELECT component, round(ratio, 6) AS ratio, round(sum(ratio) OVER (ORDER BY component), 6) AS cumulative FROM (
    SELECT unnest([1, 2]) AS component, unnest([((a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b)) / (a + c),
      ((a + c) / 2 - sqrt((a - c) * (a - c) / 4 + b * b)) / (a + c)]) AS ratio FROM ({_COV2}))""")
def f15_two(spark, d):
    """Explained variance where the eigenvalues have a closed form."""
    _, ev = X.pca(materialized_features(spark, d), ["l_quantity", "p_retailprice"], 2)
    return rounded(ev)


_F16_SRC = "(SELECT l_quantity, l_linenumber, CASE WHEN l_linenumber = 1 THEN l_tax END AS mostly_null FROM lineitem)"


@register("F16_mean_imputation", f"""SELECT l_quantity, l_linenumber,
    round(coalesce(mostly_null, (SELECT avg(mostly_null) FROM {_F16_SRC})), 6) AS mostly_null FROM {_F16_SRC}""")
def f16(spark, d):
    from ecospark.functions.clean import fill_mean

    w = table(spark, d, "lineitem").select("l_quantity", "l_linenumber", _EXTRA["mostly_null"][1]().alias("mostly_null"))
    return rounded(fill_mean(w, ["mostly_null"]))


@register("F17_standard_scaling", f"""SELECT l_orderkey, l_linenumber, {", ".join(
    f"round(({x} - avg({x}) OVER ()) / stddev_pop({x}) OVER (), 6) AS {x}" for x in ["l_quantity", "l_discount", "p_size"])}
    FROM {FT_SQL}""")
def f17(spark, d):
    ft = feature_table(spark, d).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "p_size")
    return rounded(X.standardize(ft, ["l_quantity", "l_discount", "p_size"]))


@register("F18_min_max_scaling", f"""SELECT l_orderkey, l_linenumber, {", ".join(
    f"round(({x} - min({x}) OVER ()) / (max({x}) OVER () - min({x}) OVER ()), 6) AS {x}" for x in ["l_quantity", "l_discount", "p_size"])}
    FROM {FT_SQL}""")
def f18(spark, d):
    ft = feature_table(spark, d).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "p_size")
    return rounded(X.min_max(ft, ["l_quantity", "l_discount", "p_size"]))


P_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@register("F19_one_hot_drop_first", "SELECT p_partkey, " + ", ".join(
    f"(p_type = '{v}')::DOUBLE AS p_type_{v}" for v in P_TYPES[1:]) + " FROM part")
def f19(spark, d):
    return X.encode(table(spark, d, "part").select("p_partkey", "p_type"), ["p_type"], "one-hot")


@register("F20_label_encoding", "SELECT p_partkey, (dense_rank() OVER (ORDER BY p_type) - 1)::DOUBLE AS p_type FROM part")
def f20(spark, d):
    return X.encode(table(spark, d, "part").select("p_partkey", "p_type"), ["p_type"], "label")


@register("F21_polynomial_degree2", "SELECT l_orderkey, l_linenumber, round(l_quantity, 6) AS l_quantity, round(l_discount, 6) AS l_discount, "
          "round(l_quantity * l_quantity, 6) AS \"l_quantity*l_quantity\", round(l_quantity * l_discount, 6) AS \"l_quantity*l_discount\", "
          "round(l_discount * l_discount, 6) AS \"l_discount*l_discount\" FROM lineitem")
def f21(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return rounded(X.poly2(li, ["l_quantity", "l_discount"]))


@register("F22_hash_split", f"""SELECT l_orderkey, l_linenumber, CASE WHEN (('0x' || substr(md5('42|' || l_orderkey || '|' || l_linenumber
    || '|' || l_partkey), 1, 8))::BIGINT % 1000000) / 1000000.0 < 0.2 THEN 'test' ELSE 'train' END AS part FROM lineitem""")
def f22(spark, d):
    ft = feature_table(spark, d)
    train, test = X.split(ft, ["l_orderkey", "l_linenumber", "l_partkey"], 0.2, 42)
    return train.select("l_orderkey", "l_linenumber", F.lit("train").alias("part")).unionByName(
        test.select("l_orderkey", "l_linenumber", F.lit("test").alias("part")))


@register("workflow_descriptor_preparation")
def workflow_descriptor_preparation(spark, d):
    """§3.2 analogue: main table = lineitem; descriptor tables = part (with its attributes) and a
    supplier table widened with constant and null-heavy columns; target = l_extendedprice."""
    from ecospark.plans.workflows import descriptor_preparation

    main = table(spark, d, "lineitem").select("l_partkey", "l_quantity", "l_discount", "l_tax", TARGET)
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size", "p_retailprice", "p_type",
                                          F.lit(0.0).alias("p_zero"), F.lit(None).cast("double").alias("p_null"),
                                          F.when(F.col("p_size") > 45, F.col("p_size")).alias("p_sparse"),
                                          F.lit(1.0).alias("p_one"), (F.col("p_size") * 0.001).alias("p_low_var"))
    features, _, _ = descriptor_preparation(main, [part], "l_partkey", TARGET)
    return rounded(features)
