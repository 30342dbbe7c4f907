"""SQL that fits, applies and scores least-squares models (the oracles of the linear model queries): the normal equations of the
training half, solved by Gauss-Jordan elimination in a recursive query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TARGET = "l_extendedprice"
FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "p_size", "p_retailprice"]

HALVES_SQL = """rows AS (SELECT l.l_orderkey, l.l_linenumber, l.l_quantity, l.l_discount, l.l_tax, l.l_extendedprice::DOUBLE AS y, p.p_size, p.p_retailprice,
    CASE WHEN (('0x' || substr(md5('42|' || l.l_orderkey || '|' || l.l_linenumber || '|' || l.l_partkey), 1, 8))::BIGINT % 1000000) / 1000000.0 < 0.2
         THEN 'test' ELSE 'train' END AS part FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey)"""


def least_squares_sql(cols: list[str] = FEATURES, alpha: float = 0.0, name: str = "w", where: str = "part = 'train'") -> str:
    """CTEs that end in ``name`` (w: the coefficients of ``cols`` in order, b: the intercept) fitted on the rows of ``where``: the normal equations
    of standardised inputs, ``alpha`` on their diagonal, eliminated column by column."""
    p = len(cols)
    z = lambda x: f"(({x} - avg({x}) OVER ()) / stddev_samp({x}) OVER ())"
    std = ", ".join(f"{z(x)} AS z{i}" for i, x in enumerate(cols))
    cell = lambda i, j: f"covar_pop(z{i}, z{j})" + (f" + {alpha} / count(*)" if i == j and alpha else "")
    rows = ", ".join("[" + ", ".join([*(cell(i, j) for j in range(p)), f"covar_pop(z{i}, y)"]) + "]" for i in range(p))
    back = ", ".join(f"w[{i + 1}] / stddev_samp({x})" for i, x in enumerate(cols))
    return f"""{name}_z AS (SELECT y, {std} FROM rows WHERE {where}), {name}_g(k, m) AS (SELECT 0, [{rows}] FROM {name}_z UNION ALL
      SELECT k + 1, list_transform(m, lambda r, i: CASE WHEN i = k + 1 THEN list_transform(r, lambda v: v / m[k + 1][k + 1])
        ELSE list_transform(r, lambda v, j: v - r[k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END) FROM {name}_g WHERE k < {p}),
      {name}_s AS (SELECT list_transform(m, lambda r: r[{p + 1}]) AS w FROM {name}_g WHERE k = {p}),
      {name}_u AS (SELECT [{back}] AS w, avg(y) AS my, [{", ".join(f"avg({x})" for x in cols)}] AS mx FROM rows, (SELECT w FROM {name}_s) WHERE {where} GROUP BY w),
      {name} AS (SELECT w, my - list_sum(list_transform(w, lambda v, i: v * mx[i])) AS b FROM {name}_u)"""


def predicted_sql(cols: list[str] = FEATURES, name: str = "w") -> str:
    return f"({name}.b + " + " + ".join(f"{name}.w[{i + 1}] * {x}" for i, x in enumerate(cols)) + ")"


def scores_sql(model: str, name: str = "w", parts: tuple = ("train", "test")) -> str:
    """One row per part: r2 and mse of the fitted ``name``."""
    return " UNION ALL ".join(f"""SELECT '{model}' AS model, '{part}' AS part, round(1 - sum((y - p) * (y - p)) / (count(y) * var_pop(y)), 6) AS r2,
      round(avg((y - p) * (y - p)) / 1000) * 1000 AS mse, count(y) AS n FROM (SELECT y, {predicted_sql(name=name)} AS p FROM rows, {name} WHERE part = '{part}')""" for part in parts)


def scored(df: DataFrame) -> DataFrame:
    """Scores rounded so that the last digits of a solver don't show: r2 to 1e-6, mse (in squared cents of prices) to thousands."""
    return df.withColumns({"r2": F.round(F.col("r2") * 1e6) / 1e6, "mse": F.round(F.col("mse") / 1000) * 1000})
