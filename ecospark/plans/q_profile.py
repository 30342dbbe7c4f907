"""Analogue queries for aggregation, profiling, sorts and set operations (SURVEY G*, O*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ecospark.operators import profile as P
from ecospark.plans.registry import register, rounded
from ecospark.session import table

LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@register("G1_value_counts", "SELECT p_type, count(*) AS count FROM part WHERE p_type IS NOT NULL GROUP BY p_type")
def g1(spark, d):
    return P.value_counts(table(spark, d, "part"), "p_type")


@register("G2_group_size", "SELECT o_orderstatus, o_orderpriority, count(*) AS count FROM orders GROUP BY 1, 2")
def g2(spark, d):
    return P.size(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@register("G3_distinct_per_group",
          "SELECT o_custkey, count(DISTINCT o_orderpriority) AS nunique FROM orders GROUP BY o_custkey")
def g3(spark, d):
    return P.nunique(table(spark, d, "orders"), ["o_custkey"], "o_orderpriority")


@register("G4_having_count", """SELECT l_suppkey, count(*) AS count FROM lineitem WHERE l_suppkey IS NOT NULL
    GROUP BY l_suppkey HAVING count(*) > 600""")
def g4(spark, d):
    return P.value_counts(table(spark, d, "lineitem"), "l_suppkey", min_count=600)


@register("G7_count_pivot", "SELECT o.o_orderstatus, o.o_orderpriority, "
          + ", ".join(f"count(*) FILTER (WHERE c.c_mktsegment = '{s}') AS {s.lower()}" for s in SEGMENTS)
          + " FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1, 2")
def g7(spark, d):
    o = table(spark, d, "orders").join(
        table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey", "left")
    return P.count_pivot(o, "o_orderstatus", "o_orderpriority", "c_mktsegment", SEGMENTS, [s.lower() for s in SEGMENTS])


_DL_COLS = ["doc_id", "lang", "source", "n_chars", "quality", "toxic"]
_DL = "(SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


@register("G9_missing_values", " UNION ALL ".join(
    f"SELECT '{x}' AS column, count(*) FILTER (WHERE {x} IS NULL) AS missing, round(count(*) FILTER (WHERE {x} IS NULL) * 100.0 / count(*), 6) AS percent FROM {_DL}"
    for x in _DL_COLS))
def g9(spark, d):
    df = table(spark, d, "documents").drop("text").join(table(spark, d, "labels"), "doc_id", "left")
    return rounded(P.missing(df, _DL_COLS))


@register("G10_describe", " UNION ALL ".join(
    f"""SELECT '{x}' AS column, count({x}) AS count, round(avg({x}), 6) AS mean, round(stddev_samp({x}), 6) AS std,
    round(min({x}), 6) AS min, round(quantile_cont({x}, 0.25), 6) AS p25, round(quantile_cont({x}, 0.5), 6) AS p50,
    round(quantile_cont({x}, 0.75), 6) AS p75, round(max({x}), 6) AS max FROM lineitem""" for x in LI_NUM))
def g10(spark, d):
    return rounded(P.describe(table(spark, d, "lineitem"), LI_NUM))


@register("G11_describe_text", " UNION ALL ".join(
    f"""SELECT '{x}' AS column, sum(freq)::BIGINT AS count, count(*) AS unique, arg_min(v, (-freq, v)) AS top, max(freq) AS freq
    FROM (SELECT {x} AS v, count(*) AS freq FROM part WHERE {x} IS NOT NULL GROUP BY {x})"""
    for x in ["p_name", "p_brand", "p_type"]))
def g11(spark, d):
    return P.describe_text(table(spark, d, "part"), ["p_name", "p_brand", "p_type"])


_TYPES = {"l_linenumber": "int", "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
          **dict.fromkeys(["l_orderkey", "l_partkey", "l_suppkey"], "bigint"), **dict.fromkeys(LI_NUM, "double")}


@register("G12_schema_report", " UNION ALL ".join(f"SELECT '{x}' AS column, '{t}' AS type, count({x}) AS non_null FROM lineitem" for x, t in _TYPES.items()))
def g12(spark, d):
    return P.schema(table(spark, d, "lineitem"))


@register("G13_quantile", "SELECT round(quantile_cont(l_extendedprice, 0.99), 6) AS quantile FROM lineitem")
def g13(spark, d):
    return rounded(P.quantile(table(spark, d, "lineitem"), "l_extendedprice", 0.99))


@register("G14_range_per_group",
          "SELECT l_suppkey, round(max(l_extendedprice) - min(l_extendedprice), 6) AS range FROM lineitem GROUP BY l_suppkey")
def g14(spark, d):
    return rounded(P.spread(table(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice"))


_PAIRS = [(a, b) for i, a in enumerate(LI_NUM) for b in LI_NUM[i + 1:]]


@register("G15_pearson_pairs", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a, b in _PAIRS))
def g15(spark, d):
    return rounded(P.pearson(table(spark, d, "lineitem"), LI_NUM))


_RANK = "(rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0)"
SPEARMAN_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


@register("G16_spearman_with_target", " UNION ALL ".join(
    f"""SELECT '{x}' AS feature, round(corr(rx, ry), 6) AS rho FROM (SELECT {_RANK.format(x=x)} AS rx,
    {_RANK.format(x='l_extendedprice')} AS ry FROM lineitem WHERE {x} IS NOT NULL AND l_extendedprice IS NOT NULL)"""
    for x in SPEARMAN_FEATURES))
def g16(spark, d):
    return rounded(P.spearman(table(spark, d, "lineitem"), "l_extendedprice", SPEARMAN_FEATURES))


@register("G17_target_correlation", " UNION ALL ".join(
    f"SELECT '{x}' AS feature, round(corr({x}, l_extendedprice), 6) AS r FROM lineitem"
    for x in ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"]))
def g17(spark, d):
    return rounded(P.target_correlation(table(spark, d, "lineitem"), "l_extendedprice"))


@register("G18_population_variance", " UNION ALL ".join(
    f"SELECT '{x}' AS column, round(var_pop({x}), 6) AS variance FROM lineitem" for x in LI_NUM))
def g18(spark, d):
    return rounded(P.variances(table(spark, d, "lineitem"), LI_NUM))


@register("G19_distinct_per_column", " UNION ALL ".join(
    f"SELECT '{x}' AS column, count(DISTINCT {x}) AS nunique FROM part" for x in
    ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]))
def g19(spark, d):
    return P.distinct(table(spark, d, "part"))


@register("G22_histogram", """WITH b AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 50 AS w FROM lineitem)
    SELECT bin, round(lo + bin * w, 6) AS lo, round(lo + (bin + 1) * w, 6) AS hi, count(*) AS count FROM (
      SELECT least(floor((l_extendedprice - lo) / w)::INT, 49) AS bin, lo, w FROM lineitem, b WHERE l_extendedprice IS NOT NULL)
    GROUP BY bin, lo, w""")
def g22(spark, d):
    return rounded(P.histogram(table(spark, d, "lineitem"), "l_extendedprice", 50))


@register("G23_running_total", """SELECT ship_day, n, (sum(n) OVER (ORDER BY ship_day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS cumulative
    FROM (SELECT strftime(l_shipdate, '%Y-%m-%d') AS ship_day, count(*) AS n FROM lineitem GROUP BY 1)""")
def g23(spark, d):
    daily = table(spark, d, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM-dd").alias("ship_day")).agg(
        F.count(F.lit(1)).alias("n"))
    return P.cumulative(daily, ["ship_day"], "n")


@register("O1_sort_descending", "SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM orders")
def o1(spark, d):
    return rounded(P.sorted_by(table(spark, d, "orders").select("o_orderkey", "o_totalprice"),
                               ["o_totalprice", "o_orderkey"], descending=True))


@register("O2_sort_by_group_key", "SELECT c_nationkey, count(*) AS count FROM customer GROUP BY c_nationkey")
def o2(spark, d):
    """Group counts sorted by the group key."""
    return P.sorted_by(P.size(table(spark, d, "customer"), ["c_nationkey"]), ["c_nationkey"])


@register("O3_top_n", """SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM orders
    ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 10""")
def o3(spark, d):
    return rounded(P.top(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 10))


@register("O4_union_rows", """SELECT c_name AS name, c_nationkey AS nation, NULL::BIGINT AS s_suppkey FROM customer
    UNION ALL SELECT s_name AS name, s_nationkey AS nation, s_suppkey FROM supplier""")
def o4(spark, d):
    cu = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    su = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), "s_suppkey")
    return P.stack_rows(cu, su)


@register("O5_unique_values", "SELECT DISTINCT o_orderpriority FROM orders")
def o5(spark, d):
    return P.unique(table(spark, d, "orders"), "o_orderpriority")
