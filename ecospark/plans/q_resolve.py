"""Analogue queries for identity resolution.

Service answers come from ``conversations``, every row one answer: key = ``conv_id`` (the "chemical"), service = the
turn (``t0``, ``t1``, ...; priority in turn order), candidate value = md5 of the turn's text, validity = at least
100 characters, structure = the text's word set (for similarities). The fallback chain resolves customers against
supplier names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ecospark.operators import resolve as R
from ecospark.plans.registry import register, rounded
from ecospark.session import table

SERVICES = ["t0", "t1", "t2"]


def word_set(col):
    return F.array_distinct(F.split(col, r"\s+"))


def lookup(spark, d):
    cv = table(spark, d, "conversations")
    return cv.select(F.col("conv_id").alias("key"), F.concat(F.lit("t"), "turn").alias("source"), F.col("turn").alias("priority"),
                     F.md5("text").alias("value"), (F.length("text") >= 100).alias("valid"), word_set(F.col("text")).alias("bits"))


LK = """lk AS (SELECT conv_id AS key, 't' || turn AS source, turn AS priority, md5(text) AS value, length(text) >= 100 AS valid,
      list_distinct(string_split_regex(text, '\\s+')) AS bits FROM conversations),
  u AS (SELECT * FROM lk WHERE valid AND value IS NOT NULL)"""
SIM = "(len(list_intersect({a}, {b})) / nullif(len(list_distinct(list_concat({a}, {b}))), 0))"


def keys(spark, d):
    return table(spark, d, "conversations").select(F.col("conv_id").alias("key")).distinct()


@register("R1_unique_keys", """SELECT DISTINCT lang, source FROM documents WHERE coalesce(lang, source) IS NOT NULL""")
def r1(spark, d):
    return R.unique_keys(table(spark, d, "documents"), "lang", "source")


R2_SQL = f"""WITH {LK}, b AS (SELECT key, arg_min(value, priority) AS value, arg_min(source, priority) AS source FROM u GROUP BY key)
    SELECT k.key, b.value, b.source FROM (SELECT DISTINCT conv_id AS key FROM conversations) k LEFT JOIN b ON k.key = b.key"""


@register("R2_priority_resolution", R2_SQL)
def r2(spark, d):
    return R.by_priority(keys(spark, d), lookup(spark, d))


@register("R3_consensus", f"""WITH {LK}, b AS (SELECT key, count(value) AS n, count(DISTINCT value) AS nd, min(value) AS v FROM u GROUP BY key)
    SELECT k.key, CASE WHEN n > 1 AND nd = 1 THEN v WHEN n = 1 THEN v END AS value
    FROM (SELECT DISTINCT key FROM lk) k LEFT JOIN b ON k.key = b.key""")
def r3(spark, d):
    return R.consensus(lookup(spark, d))


R4_CTE = f"""{LK},
  agg AS (SELECT key, count(*) AS n, count(DISTINCT value) AS nd, arg_min(value, priority) AS value,
          '[''' || string_agg(source, ''', ''' ORDER BY priority) || ''']' AS srcs FROM u GROUP BY key),
  pairs AS (SELECT a.key, avg(coalesce({SIM.format(a='a.bits', b='b.bits')}, 0)) AS sim
            FROM u a JOIN u b ON a.key = b.key AND a.priority < b.priority GROUP BY a.key),
  res AS (SELECT agg.*, CASE WHEN nd > 1 THEN pairs.sim WHEN n > 1 THEN 1.0 END AS similarity
          FROM agg LEFT JOIN pairs ON agg.key = pairs.key),
  r4 AS (SELECT k.key, res.value,
      CASE WHEN res.key IS NULL THEN 'No valid InChI found'
           WHEN n > 1 AND nd = 1 THEN 'Match from multiple sources: ' || srcs
           WHEN n > 1 AND similarity = 1.0 THEN 'Structural match from multiple sources after comparison'
           WHEN n > 1 THEN 'Structure mismatch (average similarity: ' || printf('%.2f', similarity) || ')'
           ELSE '' END AS notes, res.similarity
    FROM (SELECT DISTINCT key FROM lk) k LEFT JOIN res ON k.key = res.key)"""


@register("R4_consensus_with_status", f"WITH {R4_CTE} SELECT key, value, notes, round(similarity, 6) AS similarity FROM r4")
def r4(spark, d):
    return rounded(R.consensus_status(lookup(spark, d)))


def _wide_sql(sources):
    cols = []
    for s in sources:
        cols += [f"max(value) FILTER (WHERE source = '{s}') AS {s}_value",
                 f"bool_or(valid) FILTER (WHERE source = '{s}') AS {s}_valid",
                 f"first(bits) FILTER (WHERE source = '{s}') AS {s}_bits"]
    return f"w AS (SELECT key, {', '.join(cols)} FROM lk GROUP BY key)"


def _r5_sql(a, b, t):
    sab, sac, sbc = (SIM.format(a=f"{x}_bits", b=f"{y}_bits") for x, y in ((a, b), (a, t), (b, t)))
    both = f"{a}_value IS NOT NULL AND {b}_value IS NOT NULL"
    oka, okb, okc = (f"coalesce({s}_valid, false)" for s in (a, b, t))
    vc = f"{t}_value IS NOT NULL"
    return f"""SELECT key,
      CASE WHEN {both} AND {oka} AND {okb} AND {vc} AND NOT coalesce({sab} = 1.0, false)
                AND coalesce({sac} = 1.0 OR {sbc} = 1.0, false) THEN {t}_value
           ELSE coalesce({a}_value, {b}_value, {t}_value) END AS value,
      CASE WHEN {both} AND {a}_value = {b}_value AND {oka} THEN 'Match and validated'
           WHEN {both} AND {a}_value = {b}_value THEN 'Match but validation failed'
           WHEN {both} AND {oka} AND {okb} AND {sab} = 1.0 THEN 'Structural match after comparison'
           WHEN {both} AND {oka} AND {okb} AND {vc} AND {sac} = 1.0 THEN '{t} matches {a} structure'
           WHEN {both} AND {oka} AND {okb} AND {vc} AND {sbc} = 1.0 THEN '{t} matches {b} structure'
           WHEN {both} AND {oka} AND {okb} AND {vc} THEN '{t} structure mismatch'
           WHEN {both} AND {oka} AND {okb} THEN 'Structure mismatch (similarity: ' || printf('%.2f', {sab}) || ')'
           WHEN {both} AND {oka} THEN 'Mismatch; {a} value is valid'
           WHEN {both} AND {okb} THEN 'Mismatch; {b} value is valid'
           WHEN {both} THEN 'Mismatch; both values failed validation'
           WHEN {a}_value IS NOT NULL AND {oka} THEN 'Found only in {a} and validated'
           WHEN {a}_value IS NOT NULL THEN 'Found only in {a} but validation failed'
           WHEN {b}_value IS NOT NULL AND {okb} THEN 'Found only in {b} and validated'
           WHEN {b}_value IS NOT NULL THEN 'Found only in {b} but validation failed'
           WHEN {t}_value IS NOT NULL AND {okc} THEN 'Found only in {t} and validated'
           WHEN {t}_value IS NOT NULL THEN 'Found only in {t} but validation failed'
           ELSE 'No value found' END AS notes
    FROM w"""


@register("R5_two_source_decision", f"WITH {LK}, {_wide_sql(SERVICES)} {_r5_sql(*SERVICES)}")
def r5(spark, d):
    return R.two_source(R.wide_candidates(lookup(spark, d), SERVICES), *SERVICES)


@register("R6_synonym_expansion", f"""WITH {LK},
    syn AS (SELECT DISTINCT conv_id AS name, turn AS rank, conv_id || '/t' || turn AS synonym FROM conversations),
    lk2 AS (SELECT key || '/' || source AS synonym, value FROM u),
    hits AS (SELECT s.name AS key, arg_min(l.value, s.rank) AS value, arg_min(s.synonym, s.rank) AS synonym
             FROM syn s JOIN lk2 l ON s.synonym = l.synonym GROUP BY s.name)
    SELECT k.key, hits.value, hits.synonym FROM (SELECT DISTINCT conv_id AS key FROM conversations) k LEFT JOIN hits ON k.key = hits.key""")
def r6(spark, d):
    cv = table(spark, d, "conversations")
    syn = cv.select(F.col("conv_id").alias("name"), F.col("turn").alias("rank"),
                    F.concat("conv_id", F.lit("/t"), "turn").alias("synonym")).distinct()
    lk = lookup(spark, d)
    lk2 = lk.select(F.concat("key", F.lit("/"), "source").alias("key"), F.lit(0).alias("priority"), "value", "valid")
    return R.via_synonyms(keys(spark, d), syn, lk2)


@register("R7_fallback_chain", """WITH att AS (
      SELECT c_custkey AS key, c_name AS probe, 0 AS st, 'name' AS stage FROM customer
      UNION ALL SELECT c_custkey, replace(c_name, 'Customer#', 'Supplier#'), 1, 'formatted name' FROM customer
      UNION ALL SELECT c_custkey, 'Supplier#' || lpad(c_nationkey::VARCHAR, 9, '0'), 2, 'nation key' FROM customer),
    best AS (SELECT a.key, arg_min(s.s_suppkey, a.st) AS value, arg_min(a.stage, a.st) AS stage
             FROM att a JOIN supplier s ON a.probe = s.s_name GROUP BY a.key)
    SELECT k.key, best.value, coalesce(best.stage, 'unresolved') AS stage
    FROM (SELECT DISTINCT c_custkey AS key FROM customer) k LEFT JOIN best ON k.key = best.key""")
def r7(spark, d):
    cu = table(spark, d, "customer").withColumnRenamed("c_custkey", "key")
    ref = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("value"))
    stages = [("name", F.col("c_name")),
              ("formatted name", F.replace("c_name", F.lit("Customer#"), F.lit("Supplier#"))),
              ("nation key", F.concat(F.lit("Supplier#"), F.lpad(F.col("c_nationkey").cast("string"), 9, "0")))]
    return R.fallback_chain(cu, ref, stages)


def _propagated(spark, d, drop):
    rows = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), F.col("conv_id").alias("key"))
    return R.propagate(rows, R.by_priority(keys(spark, d), lookup(spark, d)), "key", "value", drop_unresolved=drop)


@register("R8_propagate", f"""WITH r2 AS ({R2_SQL})
    SELECT DISTINCT d.conv_id * 1000 + d.turn AS row_id, d.conv_id AS key, r2.value FROM conversations d JOIN r2 ON d.conv_id = r2.key WHERE r2.value IS NOT NULL""")
def r8(spark, d):
    return _propagated(spark, d, True)


@register("R9_outcome_counters", f"WITH {R4_CTE} SELECT notes, count(*) AS count FROM r4 GROUP BY notes")
def r9(spark, d):
    return R.outcomes(R.consensus_status(lookup(spark, d)), "notes")


WORDS = ["the", "und", "les", "los"]


@register("R10_source_keyword_counts", " UNION ALL ".join(
    f"SELECT '{w}' AS source, count(*) FILTER (WHERE coalesce(contains(lower(text), '{w}'), false)) AS count FROM documents" for w in WORDS))
def r10(spark, d):
    return R.source_counts(table(spark, d, "documents"), "text", WORDS)


@register("R11_top_statuses_with_rest", """WITH c AS (SELECT l_suppkey, count(*) AS cnt FROM lineitem WHERE l_suppkey IS NOT NULL GROUP BY 1),
    r AS (SELECT *, row_number() OVER (ORDER BY cnt DESC, l_suppkey) AS rn FROM c)
    SELECT CASE WHEN rn <= 5 THEN l_suppkey::VARCHAR ELSE 'Not validated' END AS l_suppkey, sum(cnt)::BIGINT AS count FROM r GROUP BY 1""")
def r11(spark, d):
    return R.top_with_rest(table(spark, d, "lineitem"), "l_suppkey", 5)


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@register("R12_property_enrichment", "SELECT c.c_custkey, c.c_name, " + ", ".join(
    f"round(max(CASE WHEN e.event_type = '{t}' THEN e.v END), 6) AS {t}" for t in EVENT_TYPES)
    + """ FROM customer c LEFT JOIN (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY 1, 2) e
    ON c.c_custkey = e.user_id GROUP BY c.c_custkey, c.c_name""")
def r12(spark, d):
    props = table(spark, d, "events").groupBy(F.col("user_id").alias("c_custkey"), "event_type").agg(F.avg("value").alias("v"))
    cu = table(spark, d, "customer").select("c_custkey", "c_name")
    return rounded(R.enrich(cu, props, "c_custkey", ("event_type", "v", EVENT_TYPES)))


@register("R13_molar_mass_lookup", """SELECT o.o_orderkey, o.o_custkey, round(c.c_acctbal, 6) AS mw
    FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey""")
def r13(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    mass = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("mw"))
    return rounded(R.add_mass(o, mass, "o_custkey"))


@register("R14_coverage", f"""WITH r2 AS ({R2_SQL}), p AS (SELECT d.conv_id AS key, r2.value FROM conversations d LEFT JOIN r2 ON d.conv_id = r2.key)
    SELECT count(DISTINCT key) AS unique_names, count(DISTINCT CASE WHEN value IS NOT NULL THEN key END) AS resolved_names,
           count(*) AS rows, count(value) AS resolved_rows FROM p""")
def r14(spark, d):
    return R.coverage(_propagated(spark, d, False), "key", "value")


@register("R15_key_verification", f"""WITH {LK}, {_wide_sql(SERVICES)}
    SELECT key,
      CASE WHEN t0_value = t1_value AND t2_value = t0_value THEN t0_value WHEN t2_value IS NOT NULL THEN t2_value
           ELSE coalesce(t0_value, t1_value) END AS verified_key,
      CASE WHEN t0_value = t1_value AND t2_value = t0_value THEN 'Sources and regenerated key match'
           WHEN t2_value IS NOT NULL THEN 'Regenerated key used'
           WHEN t0_value IS NOT NULL OR t1_value IS NOT NULL THEN 'Single source key used' ELSE 'No key found' END AS verification,
      CASE WHEN t0_value IS NOT NULL AND t1_value IS NULL THEN 'first only'
           WHEN t0_value IS NULL AND t1_value IS NOT NULL THEN 'second only' END AS "case"
    FROM w""")
def r15(spark, d):
    w = R.wide_candidates(lookup(spark, d), SERVICES)
    return R.verify_keys(w, "t0_value", "t1_value", "t2_value").select("key", "verified_key", "verification", "case")
