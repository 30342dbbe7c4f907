"""Analogue queries for scans and sinks. Each writes what it derives from the
driver's tables to a fresh scratch folder under the session's checkpoint directory and reads
it back, so the round trip is checked against SQL over the original table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ecospark.plans import q_molgraph  # noqa: F401  (A14's oracle reuses the D12/D13 oracles)
from ecospark.plans.least_squares import FEATURES, HALVES_SQL, least_squares_sql, scored, scores_sql
from ecospark.plans.registry import register, rounded
from ecospark.sources import io as IO
from ecospark.session import table

PART_SCHEMA = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


@register("A1_A11_csv_round_trip", "SELECT p_partkey, p_name, p_brand, p_type, p_size, round(p_retailprice, 6) AS p_retailprice FROM part")
def a1(spark, d):
    path = IO.scratch(spark, "part_csv")
    IO.write_csv(table(spark, d, "part"), path)
    return rounded(IO.scan_csv(spark, path, PART_SCHEMA))


@register("A2_csv_custom_delimiter", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def a2(spark, d):
    path = IO.scratch(spark, "customer_psv")
    table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment").write.option("header", True).option("sep", "|").csv(path)
    return IO.scan_csv(spark, path, "c_custkey long, c_name string, c_mktsegment string", sep="|")


@register("A3_row_limit", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 100")
def a3(spark, d):
    return IO.limit_rows(table(spark, d, "orders").select("o_orderkey", "o_custkey"), 100, ["o_orderkey"])


@register("A4_A6_partitioned_scan", "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 6) AS qty FROM lineitem GROUP BY 1")
def a4(spark, d):
    path = IO.scratch(spark, "lineitem_csv")
    li = table(spark, d, "lineitem").select("l_returnflag", "l_quantity")
    li.repartition(8).write.option("header", True).csv(path)
    back = IO.scan_csv(spark, path, "l_returnflag string, l_quantity double")
    return rounded(back.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty")))


@register("A5_schema_width", "SELECT (SELECT count(*) FROM (DESCRIBE lineitem)) AS width, count(*) AS rows FROM lineitem")
def a5(spark, d):
    """Width probe (schema only) beside the scan's row count."""
    li = table(spark, d, "lineitem")
    return li.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(IO.width(li)).cast("long").alias("width"), "rows")


@register("A7_A8_line_list_by_position", "SELECT c_custkey, c_name, upper(c_name) AS line FROM customer")
def a7(spark, d):
    cust = table(spark, d, "customer").select("c_custkey", "c_name")
    path = IO.scratch(spark, "names_txt")
    cust.orderBy("c_custkey").select(F.upper("c_name").alias("value")).write.text(path)
    lines = IO.scan_lines(spark, path)
    return IO.attach_by_position(cust, lines, "line", order=["c_custkey"])


def _sdf_round_trip(spark, d):
    from ecospark.plans.q_molgraph import atoms, bonds

    at = atoms(spark, d).withColumn("element", F.upper(F.substring("element", 1, 1)))
    mb = IO.molblocks(at, bonds(spark, d))
    tagged = mb.join(table(spark, d, "conversations").groupBy(F.col("conv_id").alias("mol_id")).agg(
        F.count(F.lit(1)).alias("turns")), "mol_id").withColumn("Status", F.lit("Passed"))
    path = IO.scratch(spark, "molecules_sdf")
    IO.write_sdf(tagged, path, tags=["turns", "Status"])
    return IO.scan_sdf(spark, path)


@register("A9_A10_sdf_round_trip", """SELECT conv_id::VARCHAR AS name, count(*)::INT AS n_atoms, (count(*) - 1)::INT AS n_bonds,
    count(*)::VARCHAR AS turns, 'Passed' AS status, count(*) FILTER (WHERE role = 'user') AS user_atoms FROM conversations GROUP BY conv_id""")
def a9(spark, d):
    records, atoms_, bonds_ = _sdf_round_trip(spark, d)
    ua = atoms_.groupBy("mol_id").agg(F.count_if(F.col("element") == "U").alias("user_atoms"))
    return records.join(ua, records.record_id == ua.mol_id).select(
        "name", "n_atoms", "n_bonds", F.col("tags")["turns"].alias("turns"), F.col("tags")["Status"].alias("status"), "user_atoms")


@register("A12_A13_split_sink", "SELECT o_orderkey, o_orderpriority, round(o_totalprice, 6) AS o_totalprice FROM orders")
def a12(spark, d):
    path = IO.scratch(spark, "orders_by_priority")
    IO.write_split(table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), path, "o_orderpriority")
    return rounded(spark.read.parquet(path).select("o_orderkey", "o_orderpriority", "o_totalprice"))


def _a14_sql():
    from ecospark.plans.registry import ORACLES

    d12, d13 = ORACLES["D12_atom_pair_fingerprint"], ORACLES["D13_torsion_fingerprint"]
    return f"""SELECT family, count(*) AS molecules, sum(len(on_bits))::BIGINT AS bits FROM ({d12} UNION ALL {d13}) GROUP BY family"""


@register("A14_fingerprint_family_fanout", _a14_sql())
def a14(spark, d):
    from ecospark.operators import molgraph as G
    from ecospark.plans.q_molgraph import atoms, bonds

    at, bo = atoms(spark, d), bonds(spark, d)
    fps = G.torsion(at, bo).unionByName(G.atom_pair(at, bo))
    path = IO.scratch(spark, "fingerprints")
    IO.write_split(fps, path, "family")
    return spark.read.parquet(path).groupBy("family").agg(F.count(F.lit(1)).alias("molecules"), F.sum(F.size("on_bits")).alias("bits"))


@register("A15_counters_json", "SELECT o_orderstatus AS outcome, count(*) AS count FROM orders GROUP BY 1")
def a15(spark, d):
    path = IO.scratch(spark, "counts_json")
    IO.write_counts(table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("outcome")).agg(F.count(F.lit(1)).alias("count")), path)
    return spark.read.schema("outcome string, count long").json(path)


@register("A16_summary_file", " UNION ALL ".join(
    f"SELECT '{x}' AS column, count({x}) AS count, round(avg({x}), 6) AS mean, round(max({x}), 6) AS max FROM lineitem"
    for x in ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
def a16(spark, d):
    path = IO.scratch(spark, "summary")
    IO.write_summary(table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax"), path)
    back = IO.scan_csv(spark, f"{path}/describe", "column string, count long, mean double, std double, min double, p25 double, "
                                                   "p50 double, p75 double, max double")
    return rounded(back.select("column", "count", "mean", "max"))


def _a17_sql():
    from ecospark.plans.q_features import WIDE_SQL

    # all-zero, all-one, all-null and more than 70 % null columns go
    return f"SELECT l_quantity, l_discount, l_tax, l_returnflag, const7, zeros_some_null, qty_copy FROM {WIDE_SQL}"


@register("A17_prune_and_rewrite", _a17_sql())
def a17(spark, d):
    from ecospark.plans.q_features import wide

    src = IO.scratch(spark, "wide_src")
    wide(spark, d).write.parquet(src)
    return IO.prune_file(spark, src, IO.scratch(spark, "wide_pruned"), 0.7)


@register("A18_json_payload_field", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def a18(spark, d):
    return IO.json_field(table(spark, d, "events").select("event_id", "props"), "props", "$.k", "k", "int").drop("props")


@register("A19_csv_payload_columns", """SELECT p_partkey, p_name AS name, p_size AS size, round(p_retailprice, 6) AS price FROM part""")
def a19(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat_ws(",", "p_name", "p_size", "p_retailprice").alias("payload"))
    return rounded(IO.csv_fields(p, "payload", "name string, size int, price double").drop("payload"))


@register("A20_html_labelled_field", """SELECT page_id, nullif(trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)), '') AS title FROM pages""")
def a20(spark, d):
    return IO.html_field(table(spark, d, "pages").select("page_id", "html"), "html", r"(?s)<title>(.*?)</title>", "title").drop("html")


@register("A21_model_save_load", f"""WITH RECURSIVE {HALVES_SQL}, {least_squares_sql()}
    SELECT r2, mse, n FROM ({scores_sql('linear', parts=('test',))})""")
def a21(spark, d):
    from ecospark.operators import models as Mo
    from ecospark.plans.q_models import data

    train, test = data(spark, d)
    path = IO.scratch(spark, "model")
    Mo.save(Mo.chain(FEATURES, Mo.estimator("linear")).fit(train), path)
    return scored(Mo.evaluate(Mo.load(path), test))


@register("A22_pairwise_runs", """SELECT c.c_custkey, c.c_nationkey, o.n, 'orders' AS pair FROM customer c
    LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON c.c_custkey = o.o_custkey
    UNION ALL SELECT c.c_custkey, c.c_nationkey, e.n, 'events' AS pair FROM customer c
    LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) e ON c.c_custkey = e.user_id""")
def a22(spark, d):
    base = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    others = {
        "orders": table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n")),
        "events": table(spark, d, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n")),
    }
    out = IO.scratch(spark, "pairs")
    paths = IO.run_pairs(base, others, lambda a, b: a.join(b, "c_custkey", "left"), out, "customer")
    parts = [IO.scan_csv(spark, p, "c_custkey long, c_nationkey int, n long").withColumn("pair", F.lit(k)) for k, p in paths.items()]
    return parts[0].unionByName(parts[1])


@register("J9_positional_join", "SELECT s_suppkey, s_name, lower(s_name) AS line FROM supplier")
def j9(spark, d):
    sup = table(spark, d, "supplier").select("s_suppkey", "s_name")
    path = IO.scratch(spark, "supplier_lines")
    sup.orderBy("s_suppkey").select(F.lower("s_name").alias("value")).write.text(path)
    return IO.attach_by_position(sup, IO.scan_lines(spark, path), "line", order=["s_suppkey"])
