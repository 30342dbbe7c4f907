"""Correlations, ranks and pruning of wide tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ecospark.operators import features as X
from ecospark.operators import gram
from ecospark.operators import profile as P


def frame(n, w, seed, gaps=0.1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, w)) * 10.0 ** rng.integers(-3, 4, w) + 10.0 ** rng.integers(-2, 4, w)
    x[:, 1] = x[:, 0] * 2 + 1
    x[:, 2] = 7.3  # constant
    x[:, 3] = np.where(rng.random(n) < 0.5, 0.0, x[:, 3])
    data = pd.DataFrame(x, columns=[f"x {i}" if i % 2 else f"d.{i}" for i in range(w)])
    for i in range(4, w, 3):
        data.loc[rng.random(n) < gaps, data.columns[i]] = np.nan
    data.iloc[:, 5] = np.nan
    return data


def to_spark(spark, data, parts=4):
    return spark.createDataFrame(data.astype(object).where(data.notna(), None), ", ".join(f"`{x}` double" for x in data.columns)).repartition(parts)


def expected(data):
    out = data.corr(min_periods=1).to_numpy()
    flat = data.nunique().to_numpy() < 2
    out[flat, :] = out[:, flat] = np.nan
    return out


def matrix(rows, cols):
    out = np.full((len(cols), len(cols)), np.nan)
    at = {x: i for i, x in enumerate(cols)}
    for r in rows:
        if r["r"] is not None:
            out[at[r["a"]], at[r["b"]]] = r["r"]
    return out


def test_800_columns_with_gaps(spark, tmp_dir):
    data = frame(400, 800, 1)
    data.to_parquet(f"{tmp_dir}/wide.parquet")
    df = spark.read.parquet(f"{tmp_dir}/wide.parquet")
    cols = list(data.columns)
    out = P.pearson(df, cols)
    plan = df.sparkSession._jvm.PythonSQLUtils.explainString(gram.moments(df, cols[:500], cols[:500])._jdf.queryExecution(), "formatted")
    assert plan.count("sum(") < 200 and plan.count("corr") == 0
    rows = out.collect()
    assert len(rows) == 800 * 799 // 2
    got, want = matrix(rows, cols), expected(data)
    upper = np.triu_indices(800, 1)
    assert np.array_equal(np.isnan(got[upper]), np.isnan(want[upper]))
    assert np.nanmax(np.abs(got[upper] - want[upper])) < 1e-9


def test_blocks_and_pairs(spark, monkeypatch):
    monkeypatch.setattr(gram, "BLOCK", 3)
    data = frame(60, 8, 2, gaps=0.4)
    df, cols = to_spark(spark, data), list(data.columns)
    want = expected(data)
    got = matrix(P.pearson(df, cols).collect(), cols)
    upper = np.triu_indices(8, 1)
    assert np.allclose(got[upper], want[upper], equal_nan=True)
    pairs = [(cols[0], cols[7]), (cols[7], cols[0]), (cols[4], cols[1]), (cols[3], cols[3])]
    found = {(r["a"], r["b"]): r["r"] for r in P.pearson(df, cols, pairs).collect()}
    assert set(found) == set(pairs) and found[pairs[3]] == pytest.approx(1.0) and found[pairs[0]] == pytest.approx(found[pairs[1]]) == pytest.approx(want[0, 7])


def test_awkward_values(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 2.0, nan, inf, 1e15), (2, None, 1.0, 1.0, 1e15 + 2), (3, 5.0, nan, 2.0, 1e15 + 4), (4, 7.0, None, 3.0, 1e15 + 9), (None, 1.0, None, 4.0, 1e15)]
    df = spark.createDataFrame(rows, "a int, b double, c double, d double, e double")
    got = {(r["a"], r["b"]): r["r"] for r in P.pearson(df, ["a", "b", "c", "d", "e"]).collect()}
    assert got["a", "b"] == pytest.approx(np.corrcoef([1, 3, 4], [2, 5, 7])[0, 1])
    assert got["a", "e"] == pytest.approx(np.corrcoef([1, 2, 3, 4], [0, 2, 4, 9])[0, 1])
    assert all(got[k] is None for k in (("a", "c"), ("b", "c"), ("a", "d"), ("d", "e")))
    empty = df.filter("a > 100")
    assert [r["r"] for r in P.pearson(empty, ["a", "b"]).collect()] in ([], [None])


def test_pruning_at_width(spark, tmp_dir):
    """F6 and F7 over more columns than an expression per pair could hold."""
    data = frame(300, 150, 4)
    data["t"] = data.iloc[:, 0] / data.iloc[:, 0].std() + np.random.default_rng(1).normal(size=300)
    data.to_parquet(f"{tmp_dir}/wide.parquet")
    df = spark.read.parquet(f"{tmp_dir}/wide.parquet")
    cols = list(data.columns[:-1])
    want = expected(data)
    high = np.abs(np.nan_to_num(want[:150, :150])) > 0.9
    np.fill_diagonal(high, False)
    f6 = {r["column"]: r for r in X.weak_and_collinear_report(df, "t", 0.1, 0.9, cols).collect()}
    assert {x for x in cols if f6[x]["collinear"]} == {cols[i] for i in np.flatnonzero(high.any(axis=1))}
    weak = np.abs(want[:150, 150]) < 0.1
    assert [f6[x]["drop"] for x in cols] == list(weak | high.any(axis=1))
    f7 = {r["column"]: r["drop"] for r in X.drop_collinear_report(df, 0.9, cols).collect()}
    assert [f7[x] for x in cols] == [bool(high[:i, i].any()) for i in range(150)]


def test_empty_table_reports(spark):
    df = spark.createDataFrame([], "a double, b double, t double")
    assert [r["drop"] for r in X.drop_collinear_report(df, 0.9, ["a", "b"]).collect()] == [False, False]
    assert sorted((r["column"], r["drop"]) for r in X.weak_and_collinear_report(df, "t", cols=["a", "b"]).collect()) == [("a", False), ("b", False)]


def spearman_of(data, target):
    return {x: data[[x, target]].dropna().rank().corr().iloc[0, 1] if x != target else 1.0 for x in data.columns}


@pytest.mark.parametrize("broadcast", [True, False])
def test_spearman_of_sparse_columns(spark, monkeypatch, broadcast):
    """Half of the rows zero, ties in the target, columns with gaps; joins by broadcast and by shuffle."""
    from ecospark.operators import joins

    if not broadcast:
        monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    data = frame(500, 12, 5, gaps=0.3)
    rng = np.random.default_rng(6)
    data["zeros"] = np.where(rng.random(500) < 0.5, 0.0, rng.normal(size=500))
    data["t"] = np.round(data["zeros"].fillna(0) + rng.normal(size=500), 1)
    data.loc[rng.random(500) < 0.05, "t"] = np.nan
    df = to_spark(spark, data)
    got = {r["feature"]: r["rho"] for r in P.spearman(df, "t", list(data.columns)).collect()}
    want = spearman_of(data, "t")
    assert set(got) == set(want)
    for x in want:
        assert got[x] is None if not want[x] == want[x] else got[x] == pytest.approx(want[x], abs=1e-9), x


def test_spearman_has_no_hot_task(spark, tmp_dir):
    """Rows that any task reads while ranking: a value that half of all rows hold is folded before the shuffle."""
    n = 40_000
    df = spark.range(n).repartition(8).select(F.when(F.col("id") % 2 == 0, 0.0).otherwise(F.rand(1)).alias("x"), F.rand(2).alias("t"))
    counts = df.groupBy(F.lit("x").alias("feature"), F.col("x").alias("value")).agg(F.count(F.lit(1)).alias("_cnt"))
    sizes = sorted(r["n"] for r in counts.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    assert sizes[-1] <= 3 * sizes[len(sizes) // 2]
    ranks = P.value_ranks(df, [], "x")
    hot = ranks.filter("x = 0").first()
    assert hot["_cnt"] == n // 2 and hot["rank"] == (n // 2 + 1) / 2
    assert abs(P.spearman(df, "t", ["x"]).first()["rho"]) < 0.05


def test_counted_lookup_keeps_hot_keys_out_of_the_shuffle(spark):
    from ecospark.operators.joins import counted_lookup

    rows = spark.createDataFrame([(9, i) for i in range(12_000)] + [(i, -i) for i in range(5)] + [(None, 7)], "k int, v int")
    side = rows.filter("k IS NOT NULL AND k <> 3").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    want = sorted((r["v"], r["k"] if r["k"] is not None else -1, {9: 12_000, 3: 0, None: 0}.get(r["k"], 1)) for r in rows.collect())
    for limit in (0, 100):
        out = counted_lookup(rows, side, ["k"], "n", limit)
        assert sorted((r["v"], r["k"] if r["k"] is not None else -1, r["n"] or 0) for r in out.collect()) == want
