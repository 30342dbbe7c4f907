"""Analogue queries for projections, filters and scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ecospark.functions import clean as K
from ecospark.functions import cols as C
from ecospark.plans.registry import register, rounded
from ecospark.session import table


def _docs_labels(spark, d):
    return table(spark, d, "documents").drop("text").join(table(spark, d, "labels"), "doc_id", "left")


_DL = "(SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


@register("B1_keep_columns", "SELECT p_partkey, p_name, round(p_retailprice, 6) AS p_retailprice FROM part")
def b1(spark, d):
    return rounded(C.keep(table(spark, d, "part"), ["p_partkey", "p_name", "p_retailprice"]))


@register("B2_drop_columns", "SELECT c_custkey, c_nationkey, round(c_acctbal, 6) AS c_acctbal FROM customer")
def b2(spark, d):
    return rounded(C.discard(table(spark, d, "customer"), ["c_name", "c_mktsegment", "no_such_column"]))


@register("B3_by_position", "SELECT p_partkey, p_size, round(p_retailprice, 6) AS p_retailprice FROM part")
def b3(spark, d):
    return rounded(C.by_position(table(spark, d, "part"), 0, 3, drop=["p_brand"]))


@register("B4_canonical_key", "SELECT c_custkey, upper(c_name) AS c_name FROM customer")
def b4(spark, d):
    cu = table(spark, d, "customer").select("c_custkey", "c_name", F.upper("c_name").alias("c_name_clean"))
    return C.canonical_key(cu, "c_name_clean", "c_name").select("c_custkey", "c_name")


@register("B5_rename_map", "SELECT p_partkey, p_name AS name, p_size AS size FROM part")
def b5(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    return C.rename(p, {"p_name": "name", "p_size": "size", "unknown": "x"})


_SEGMENTS = [("BUILDING", "construction"), ("MACHINERY", "industry"), ("AUTOMOBILE", "industry")]


@register("B5_rename_values", "SELECT c_custkey, CASE c_mktsegment " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _SEGMENTS)
          + " ELSE c_mktsegment END AS c_mktsegment FROM customer")
def b5_values(spark, d):
    rules = spark.createDataFrame(_SEGMENTS, "old string, new string")
    return C.rename_values(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", rules)


@register("B6_exclude_names",
          "SELECT p_partkey, p_type FROM part WHERE p_type IS NULL OR p_type NOT IN ('PROMO', 'SMALL', 'ECONOMY', 'MEDIUM')")
def b6(spark, d):
    return K.where_not_in(table(spark, d, "part").select("p_partkey", "p_type"), "p_type",
                          ["PROMO", "SMALL", "ECONOMY", "MEDIUM"])


@register("B7_numeric_columns", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_quantity, 6) AS l_quantity,
    round(l_extendedprice, 6) AS l_extendedprice, round(l_discount, 6) AS l_discount, round(l_tax, 6) AS l_tax FROM lineitem""")
def b7(spark, d):
    li = table(spark, d, "lineitem")
    return rounded(C.keep(li, C.numeric(li)))


@register("B8_where_eq", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'")
def b8(spark, d):
    return K.where_eq(table(spark, d, "orders"), "o_orderstatus", "F").select("o_orderkey", "o_custkey")


@register("B9_where_not_in",
          "SELECT p_partkey FROM part WHERE p_type IS NULL OR p_type NOT IN ('PROMO', 'SMALL')")
def b9(spark, d):
    return K.where_not_in(table(spark, d, "part"), "p_type", ["PROMO", "SMALL"]).select("p_partkey")


@register("B10_drop_missing_subset", f"SELECT * FROM {_DL} WHERE quality IS NOT NULL")
def b10(spark, d):
    return K.drop_missing(_docs_labels(spark, d), subset=["quality"])


@register("B11_drop_any_missing",
          f"SELECT * FROM {_DL} WHERE doc_id IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL AND n_chars IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
def b11(spark, d):
    return K.drop_missing(_docs_labels(spark, d))


@register("B12_drop_below_present_ratio", f"""SELECT * FROM {_DL} WHERE
    (doc_id IS NOT NULL)::INT + (lang IS NOT NULL)::INT + (source IS NOT NULL)::INT + (n_chars IS NOT NULL)::INT
    + (quality IS NOT NULL)::INT + (toxic IS NOT NULL)::INT >= 5""")
def b12(spark, d):
    df = _docs_labels(spark, d)
    return K.drop_missing(df, min_present=K.min_present_ratio(df, 0.9))


@register("B13_where_present", f"SELECT * FROM {_DL} WHERE toxic IS NOT NULL")
def b13(spark, d):
    return K.where_present(_docs_labels(spark, d), "toxic")


@register("B14_merge_values",
          "SELECT p_partkey, CASE WHEN p_type IN ('PROMO', 'SMALL') THEN 'OTHER' ELSE p_type END AS p_type FROM part")
def b14(spark, d):
    return K.merge_values(table(spark, d, "part").select("p_partkey", "p_type"), "p_type", ["PROMO", "SMALL"], "OTHER")


@register("B15_to_number", """SELECT event_id, round(TRY_CAST(CASE WHEN event_type = 'error' THEN 'n/a'
    ELSE replace(replace(props, '{"k": ', ''), '}', '') END AS DOUBLE), 6) AS k FROM events""")
def b15(spark, d):
    e = table(spark, d, "events")
    raw = F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(
        F.replace(F.replace("props", F.lit('{"k": '), F.lit("")), F.lit("}"), F.lit("")))
    return rounded(e.select("event_id", K.to_number(raw).alias("k")))


@register("B16_to_key",
          "SELECT p_partkey::VARCHAR AS key, printf('%.4f', p_retailprice) AS price_key FROM part")
def b16(spark, d):
    p = table(spark, d, "part")
    return p.select(K.to_key("p_partkey").alias("key"), K.to_key("p_retailprice", 4).alias("price_key"))


@register("B17_fill_constant",
          f"SELECT doc_id, lang, source, n_chars, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic FROM {_DL}")
def b17(spark, d):
    return K.fill(_docs_labels(spark, d), 0, subset=["quality", "toxic"])


@register("B18_fill_mean", f"""SELECT doc_id, round(coalesce(quality::DOUBLE, (SELECT avg(quality) FROM {_DL})), 6) AS quality,
    round(coalesce(toxic::DOUBLE, (SELECT avg(toxic) FROM {_DL})), 6) AS toxic FROM {_DL}""")
def b18(spark, d):
    return rounded(K.fill_mean(_docs_labels(spark, d), ["quality", "toxic"]).select("doc_id", "quality", "toxic"))


@register("B19_species_name",
          "SELECT p_partkey, split_part(replace(p_type || '/' || p_name || ';' || p_brand, '/', '&'), ';', 1) AS species FROM part")
def b19(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", K.species_name(F.concat("p_type", F.lit("/"), "p_name", F.lit(";"), "p_brand")).alias("species"))


# unit analogue: event_type plays the unit, value the concentration, the supplier balance of the
# user the molar mass (users without a supplier row have no mass)
EVENT_RULES = {"view": (1.0, False), "click": (1 / 1000, False), "purchase": (1 / 1000, True), "signup": (1000.0, True)}


@register("B20_standardise_units", """SELECT e.event_id,
    round(CASE WHEN e.event_type = 'view' THEN e.value
               WHEN e.event_type = 'click' THEN e.value * 0.001
               WHEN e.event_type = 'purchase' AND s.s_acctbal IS NOT NULL THEN e.value * s.s_acctbal * 0.001
               WHEN e.event_type = 'signup' AND s.s_acctbal IS NOT NULL THEN e.value * s.s_acctbal * 1000.0
               ELSE e.value END, 6) AS value,
    CASE WHEN e.event_type IN ('view', 'click') THEN 'mg/L'
         WHEN e.event_type IN ('purchase', 'signup') AND s.s_acctbal IS NOT NULL THEN 'mg/L'
         ELSE e.event_type END AS unit
    FROM events e LEFT JOIN supplier s ON e.user_id = s.s_suppkey""")
def b20(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "value", F.col("event_type").alias("unit"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("user_id"), "s_acctbal")
    out = K.standardise_units(e.join(s, "user_id", "left"), "value", "unit", "s_acctbal", rules=EVENT_RULES)
    return rounded(out.select("event_id", "value", "unit"))


_B22 = "(SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 3 THEN l_extendedprice END AS price FROM lineitem)"


@register("B22_clip_upper", f"""WITH v AS {_B22}, q AS (SELECT quantile_cont(price, 0.99) AS q FROM v)
    SELECT l_orderkey, l_linenumber, round(CASE WHEN price > q THEN q ELSE price END, 6) AS price FROM v, q""")
def b22(spark, d):
    """Prices, missing for every third line: a missing value must stay missing."""
    price = F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice")).alias("price")
    return rounded(K.clip_upper(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", price), "price", 0.99))


@register("B23_log1p", "SELECT l_orderkey, l_linenumber, round(ln(1 + l_quantity), 6) AS lq FROM lineitem")
def b23(spark, d):
    li = table(spark, d, "lineitem")
    return rounded(li.select("l_orderkey", "l_linenumber", K.log1p("l_quantity").alias("lq")))


@register("B24_format_cas", """SELECT o_orderkey, CASE WHEN length(s) > 0 THEN
    substr(s, 1, greatest(length(s) - 3, 0)) || '-' || substr(s, greatest(length(s) - 2, 1), least(2, length(s) - 1))
    || '-' || substr(s, length(s), 1) END AS cas FROM (SELECT o_orderkey, o_orderkey::VARCHAR AS s FROM orders)""")
def b24(spark, d):
    return table(spark, d, "orders").select("o_orderkey", K.format_cas("o_orderkey").alias("cas"))


_NAMED = "(SELECT p_partkey, CASE WHEN p_size > 25 THEN p_name || ' (' || p_brand || ')' ELSE p_name END AS nm FROM part)"


@register("B25_split_name", f"""SELECT p_partkey,
    CASE WHEN hit THEN substr(nm, 1, length(nm) - length(lastp) - 1) ELSE nm END AS name,
    CASE WHEN hit THEN trim(lastp, '()') END AS candidate
    FROM (SELECT *, contains(nm, ' ') AND contains(lastp, '(') AND contains(lastp, ')') AS hit
          FROM (SELECT *, string_split(nm, ' ')[-1] AS lastp FROM {_NAMED}))""")
def b25(spark, d):
    p = table(spark, d, "part")
    nm = F.when(F.col("p_size") > 25, F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).otherwise(F.col("p_name"))
    name, cand = K.split_name(nm)
    return p.select("p_partkey", name.alias("name"), cand.alias("candidate"))


@register("B26_mentions", "SELECT doc_id, coalesce(contains(lower(text), 'the'), false) AS hit FROM documents")
def b26(spark, d):
    return table(spark, d, "documents").select("doc_id", K.mentions("text", "The").alias("hit"))


@register("B27_substring_count", """SELECT doc_id, (length(text) - length(replace(text, 'the', ''))) / 3 > 5 AS biologic
    FROM documents""")
def b27(spark, d):
    return table(spark, d, "documents").select("doc_id", K.is_biologic("text", "the", 5).alias("biologic"))


@register("B28_contains_separator", "SELECT doc_id, contains(text, '!') AS mixture FROM documents")
def b28(spark, d):
    return table(spark, d, "documents").select("doc_id", K.is_mixture("text", "!").alias("mixture"))


@register("B29_status_trail", """SELECT doc_id,
    CASE WHEN n_chars > 5000 THEN 'long; ' ELSE '' END || 'checked; ' AS Status FROM documents""")
def b29(spark, d):
    df = table(spark, d, "documents").select("doc_id", "n_chars")
    df = K.add_status(df, "long", F.col("n_chars") > 5000)
    return K.add_status(df, "checked").select("doc_id", "Status")


@register("B30_status_text", """SELECT doc_id, CASE WHEN NOT coalesce(lang <> 'de', false) THEN 'SMILES conversion failed'
    WHEN n_chars > 1000 THEN 'SMILES conversion successful, Passed initial filtering'
    ELSE 'SMILES conversion successful, Failed initial filtering' END AS status FROM documents""")
def b30(spark, d):
    df = table(spark, d, "documents")
    return df.select("doc_id", K.filter_status(F.col("lang") != "de", F.col("n_chars") > 1000).alias("status"))


_METALS_SQL = "[" + ", ".join(f"'{m}'" for m in K.METALS) + "]"
_ELEMENTS_SQL = r"""list_distinct(list_transform(regexp_extract_all(text, '(\[[0-9]*[A-Za-z][a-z]?|Cl|Br|[BCNOPSFIbcnops])', 1),
      lambda t: upper(substr(regexp_replace(t, '[\[0-9]', '', 'g'), 1, 1)) || lower(substr(regexp_replace(t, '[\[0-9]', '', 'g'), 2))))"""


@register("B31_is_organic", f"""SELECT doc_id, NOT list_has_any(el, {_METALS_SQL}) AND list_contains(el, 'C') AND len(el) > 1 AS organic,
    len(el)::INT AS n_elements FROM (SELECT doc_id, {_ELEMENTS_SQL} AS el FROM documents)""")
def b31(spark, d):
    df = C.evaluate_once(table(spark, d, "documents"), "el", K.element_set("text"))
    return df.select("doc_id", K.is_organic(F.col("el")).alias("organic"), F.size("el").alias("n_elements"))


_FORMULA = "'C' || p_size || 'H' || (2 * p_size + 2) || 'N' || (p_size % 3) || 'O' || 'Cl' || (p_size % 4)"
_MASSES_SQL = "(VALUES " + ", ".join(f"('{k}', {v})" for k, v in K.ATOMIC_MASS.items()) + ") AS m(sym, w)"


@register("B32_molar_mass", f"""WITH f AS (SELECT p_partkey, {_FORMULA} AS formula FROM part),
    t AS (SELECT p_partkey, unnest(regexp_extract_all(formula, '([A-Z][a-z]?[0-9]*)', 1)) AS tok FROM f),
    w AS (SELECT p_partkey, m.w * coalesce(TRY_CAST(regexp_extract(tok, '([0-9]+)$', 1) AS DOUBLE), 1.0) AS x
          FROM t LEFT JOIN {_MASSES_SQL} ON regexp_extract(tok, '^([A-Z][a-z]?)', 1) = m.sym)
    SELECT f.p_partkey, round(sum(x), 6) AS mass, sum(x) < 100 AS counterion FROM f JOIN w ON f.p_partkey = w.p_partkey
    GROUP BY f.p_partkey""")
def b32(spark, d):
    p = table(spark, d, "part")
    formula = F.concat(F.lit("C"), "p_size", F.lit("H"), F.col("p_size") * 2 + 2, F.lit("N"), F.col("p_size") % 3,
                       F.lit("O"), F.lit("Cl"), F.col("p_size") % 4)
    out = p.select("p_partkey", K.molar_mass(formula).alias("mass"))
    return rounded(out.withColumn("counterion", F.col("mass") < 100))


@register("B33_compound_filter", f"""WITH x AS (SELECT doc_id, {_ELEMENTS_SQL} AS el, n_chars,
      (length(text) - length(replace(text, 'C(=O)N', ''))) / 6 > 5 AS bio, contains(text, '!') AS mix FROM documents),
    r AS (SELECT doc_id, list_filter([CASE WHEN NOT (NOT list_has_any(el, {_METALS_SQL}) AND list_contains(el, 'C') AND len(el) > 1) THEN 'Not organic' END,
           CASE WHEN n_chars < 100 THEN 'Is counterion' END, CASE WHEN bio THEN 'Is biologic' END,
           CASE WHEN mix THEN 'Is mixture' END], lambda z: z IS NOT NULL) AS failure_reasons FROM x)
    SELECT doc_id, failure_reasons, 'Passed Initial Structural Checks; ' AS Status FROM r WHERE len(failure_reasons) = 0""")
def b33(spark, d):
    df = table(spark, d, "documents").select("doc_id", F.col("text").alias("smiles"), "n_chars")
    out = K.compound_filter(df, "smiles", mass="n_chars", mixture_sep="!")
    return out.select("doc_id", "failure_reasons", "Status")


@register("B34_residual", """SELECT l.l_orderkey, l.l_linenumber, l.l_partkey,
    round(l.l_extendedprice - l.l_quantity * p.p_retailprice, 6) AS residual
    FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey""")
def b34(spark, d):
    li = table(spark, d, "lineitem")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    out = li.join(p, "l_partkey", "left").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        K.residual("l_extendedprice", F.col("l_quantity") * F.col("p_retailprice")).alias("residual"))
    return rounded(out)


FLAG_RULES = {"A": (1000.0, False), "N": (0.001, True)}


@register("O6_row_function_two_columns", """SELECT l_orderkey, l_linenumber,
    round(CASE WHEN l_returnflag = 'A' THEN l_quantity * 1000.0 WHEN l_returnflag = 'N' AND l_tax IS NOT NULL
               THEN l_quantity * l_tax * 0.001 ELSE l_quantity END, 6) AS value,
    CASE WHEN l_returnflag = 'A' OR (l_returnflag = 'N' AND l_tax IS NOT NULL) THEN 'mg/L' ELSE l_returnflag END AS unit
    FROM lineitem""")
def o6(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("value"),
                                            F.col("l_returnflag").alias("unit"), "l_tax")
    return rounded(K.standardise_units(li, "value", "unit", "l_tax", rules=FLAG_RULES).drop("l_tax"))


@register("O7_row_scalar_function", """SELECT l_orderkey, l_linenumber,
    round(CASE WHEN l_extendedprice / l_quantity * 1000 > 0 THEN -log10(l_extendedprice / l_quantity * 1000) END, 6) AS p
    FROM lineitem""")
def o7(spark, d):
    from ecospark.operators.sensitivity import p_endpoint

    li = table(spark, d, "lineitem")
    return rounded(li.select("l_orderkey", "l_linenumber", p_endpoint("l_extendedprice", "l_quantity").alias("p")))
