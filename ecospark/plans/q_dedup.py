"""Analogue queries for deduplication, similarity and clustering.
Structures are the word sets of ``documents.text`` (whole texts)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ecospark.operators import dedup as D
from ecospark.operators.resolve import tanimoto
from ecospark.plans.registry import register, rounded
from ecospark.session import table

WORDS_SQL = "list_distinct(string_split_regex(text, '\\s+'))"


def words(col="text"):
    return F.split(F.col(col), r"\s+")


@register("C1_exact_dedup", "SELECT DISTINCT text FROM documents UNION ALL SELECT DISTINCT text FROM benchmark")
def c1(spark, d):
    return D.exact(table(spark, d, "documents").select("text")).unionByName(D.exact(table(spark, d, "benchmark").select("text")))


@register("C2_first_per_key", """SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars, doc_id) AS rn
    FROM documents) WHERE rn = 1""")
def c2(spark, d):
    return D.first_by(table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), ["lang", "source"], ["n_chars", "doc_id"]).select("doc_id", "lang", "source")


@register("C3_compound_dedup", """SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang, md5(text) ORDER BY doc_id) AS rn
    FROM documents) WHERE rn = 1""")
def c3(spark, d):
    # only the key and order columns enter the aggregate; the text itself is never shuffled
    docs = table(spark, d, "documents").select("doc_id", "lang", F.md5("text").alias("canon"))
    return D.compounds(docs, "lang", "canon", ["doc_id"]).select("doc_id", "lang")


@register("C4_repeated_keys", "SELECT md5(text) AS canon, count(*) AS count FROM documents GROUP BY 1 HAVING count(*) > 1")
def c4(spark, d):
    return D.repeated_keys(table(spark, d, "documents").select(F.md5("text").alias("canon")), "canon")


PAIRS_SQL = f"""s AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
  t AS (SELECT doc_id, unnest(w) AS tok FROM s),
  n AS (SELECT doc_id, len(w) AS sz FROM s),
  i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM t a JOIN t b ON a.tok = b.tok AND a.doc_id < b.doc_id GROUP BY 1, 2),
  pairs AS (SELECT i.a, i.b, inter / (na.sz + nb.sz - inter) AS similarity FROM i JOIN n na ON i.a = na.doc_id JOIN n nb ON i.b = nb.doc_id
            WHERE inter / (na.sz + nb.sz - inter) >= 0.5)"""


def classes_sql(src: str, key: str, least: float) -> str:
    """CTEs ``k`` (id, rep, class_size), ``pairs`` (a, b, similarity) between representatives and ``links`` (id, rep, class_size, n_links)."""
    return f"""s AS (SELECT {key} AS id, {WORDS_SQL} AS w FROM {src}),
  k AS (SELECT id, w, min(id) OVER (PARTITION BY list_sort(w)) AS rep, count(*) OVER (PARTITION BY list_sort(w)) AS class_size FROM s WHERE len(w) > 0),
  t AS (SELECT id, unnest(w) AS tok FROM k WHERE id = rep), n AS (SELECT id, len(w) AS sz, class_size FROM k WHERE id = rep),
  i AS (SELECT a.id AS a, b.id AS b, count(*) AS inter FROM t a JOIN t b ON a.tok = b.tok AND a.id < b.id GROUP BY 1, 2),
  pairs AS (SELECT i.a, i.b, inter / (na.sz + nb.sz - inter) AS similarity FROM i JOIN n na ON i.a = na.id JOIN n nb ON i.b = nb.id
            WHERE inter / (na.sz + nb.sz - inter) >= {least}),
  links AS (SELECT k.id, k.rep, k.class_size, k.class_size - 1 + coalesce((SELECT sum(n.class_size) FROM (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs) p
            JOIN n ON n.id = p.b WHERE p.a = k.rep), 0)::BIGINT AS n_links FROM k)"""


@register("C5_similar_pairs", f"WITH {PAIRS_SQL} SELECT a AS id_a, b AS id_b, round(similarity, 6) AS similarity FROM pairs")
def c5(spark, d):
    return rounded(D.similar_pairs(table(spark, d, "documents"), "doc_id", words(), 0.5))


@register("C5_representative_pairs", f"WITH {classes_sql('documents', 'doc_id', 0.5)} SELECT a, b, round(similarity, 6) AS similarity FROM pairs")
def c5_pairs(spark, d):
    """Pairs between representatives of equal sets; ``C5_similar_links`` holds the membership."""
    return rounded(D.similar_representatives(table(spark, d, "documents"), "doc_id", words(), 0.5)[0])


@register("C5_similar_links", f"WITH {classes_sql('documents', 'doc_id', 0.5)} SELECT id AS doc_id, rep, class_size, n_links FROM links")
def c5_links(spark, d):
    """Every document with its class and its number of links."""
    return D.similar_links(table(spark, d, "documents"), "doc_id", words(), 0.5).withColumnRenamed("id", "doc_id")


@register("S1_pair_tanimoto", f"""SELECT a.conv_id, a.turn, round(len(list_intersect(wa, wb)) / nullif(len(list_distinct(list_concat(wa, wb))), 0), 6) AS similarity
    FROM (SELECT conv_id, turn, {WORDS_SQL} AS wa FROM conversations) a
    JOIN (SELECT conv_id, turn, {WORDS_SQL} AS wb FROM conversations) b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def s1(spark, d):
    cv = table(spark, d, "conversations").select("conv_id", "turn", F.array_distinct(words()).alias("w"))
    nxt = cv.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("w2"))
    return rounded(cv.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", tanimoto(F.col("w"), F.col("w2")).alias("similarity")))


CLUSTER_SQL = f"""{PAIRS_SQL},
  e AS (SELECT a, b FROM pairs WHERE 1 - similarity <= 0.5 UNION SELECT b, a FROM pairs WHERE 1 - similarity <= 0.5),
  reach(node, lab) AS (SELECT a, a FROM e UNION SELECT a, b FROM e UNION SELECT r.node, e.b FROM reach r JOIN e ON r.lab = e.a),
  comp AS (SELECT node, min(lab) AS label FROM reach GROUP BY node),
  numbered AS (SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS cluster FROM (SELECT DISTINCT label FROM comp)),
  clusters AS (SELECT d.doc_id, coalesce(n.cluster, -1)::BIGINT AS cluster FROM documents d
               LEFT JOIN comp c ON d.doc_id = c.node LEFT JOIN numbered n ON c.label = n.label)"""
CLUSTER_SQL = "RECURSIVE " + CLUSTER_SQL


def clusters(spark, d):
    docs = table(spark, d, "documents")
    pairs, members = D.similar_representatives(docs, "doc_id", words(), 0.5)
    return D.cluster(pairs, docs.select(F.col("doc_id").alias("id")), 0.5, members=members).withColumnRenamed("id", "doc_id")


@register("C6_similarity_clusters", f"WITH {CLUSTER_SQL} SELECT doc_id, cluster FROM clusters")
def c6(spark, d):
    return clusters(spark, d)


@register("C7_activity_cliffs", f"""WITH {CLUSTER_SQL},
  x AS (SELECT c.doc_id, c.cluster, d.n_chars / 1000.0 AS v FROM clusters c JOIN documents d ON c.doc_id = d.doc_id),
  hits AS (SELECT * FROM x WHERE cluster IN (SELECT cluster FROM x WHERE cluster <> -1 GROUP BY cluster HAVING max(v) - min(v) >= 0.2))
  SELECT doc_id, cluster, round(v, 6) AS v FROM hits UNION ALL SELECT doc_id, cluster, round(v, 6) AS v FROM x WHERE NOT EXISTS (SELECT 1 FROM hits)""")
def c7(spark, d):
    x = clusters(spark, d).join(table(spark, d, "documents").select("doc_id", (F.col("n_chars") / 1000.0).alias("v")), "doc_id")
    return rounded(D.activity_cliffs(x, "cluster", "v", 0.2))


@register("C8_stereo_check", """SELECT d.doc_id, len(regexp_extract_all(d.text, '(@@?)', 1))::INT AS stereo_centres,
    'Passed Stereochemistry Verification; ' AS Status
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE len(regexp_extract_all(d.text, '(@@?)', 1)) = l.quality""")
def c8(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    ref = table(spark, d, "labels").select("doc_id", F.col("quality").alias("ref_count"))
    return D.stereo_check(docs, "text", ref, "doc_id", keep=False).select("doc_id", "stereo_centres", "Status")


def _c9_sql():
    from ecospark.plans.q_clean import _ELEMENTS_SQL, _METALS_SQL

    organic = f"(NOT list_has_any(el, {_METALS_SQL}) AND list_contains(el, 'C') AND len(el) > 1)"
    return f"""WITH RECURSIVE
  x AS (SELECT doc_id, text, lang, n_chars, md5(text) AS canon, {_ELEMENTS_SQL} AS el FROM documents),
  passed AS (SELECT * FROM x WHERE {organic} AND NOT n_chars < 100
             AND NOT (length(text) - length(replace(text, 'C(=O)N', ''))) / 6 > 5 AND NOT contains(text, '!')),
  dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, canon ORDER BY doc_id) AS rn FROM passed) WHERE rn = 1),
  st AS (SELECT dd.doc_id, dd.text, dd.lang, dd.n_chars,
           CASE WHEN l.quality IS NULL THEN true ELSE len(regexp_extract_all(dd.text, '(@@?)', 1)) <> l.quality END AS manual
         FROM dd LEFT JOIN labels l ON dd.doc_id = l.doc_id),
  s AS (SELECT doc_id, {WORDS_SQL} AS w FROM st),
  t AS (SELECT doc_id, unnest(w) AS tok FROM s),
  n AS (SELECT doc_id, len(w) AS sz FROM s),
  i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM t a JOIN t b ON a.tok = b.tok AND a.doc_id < b.doc_id GROUP BY 1, 2),
  pairs AS (SELECT i.a, i.b FROM i JOIN n na ON i.a = na.doc_id JOIN n nb ON i.b = nb.doc_id
            WHERE 1 - inter / (na.sz + nb.sz - inter) <= 0.5),
  e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
  reach(node, lab) AS (SELECT a, a FROM e UNION SELECT a, b FROM e UNION SELECT r.node, e.b FROM reach r JOIN e ON r.lab = e.a),
  comp AS (SELECT node, min(lab) AS label FROM reach GROUP BY node),
  numbered AS (SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS cluster FROM (SELECT DISTINCT label FROM comp)),
  y AS (SELECT st.doc_id, st.lang, coalesce(nb.cluster, -1)::BIGINT AS cluster, st.n_chars / 1000.0 AS v,
          'Passed Initial Structural Checks; ' || CASE WHEN manual THEN 'Manual Curation Required; '
          ELSE 'Passed Stereochemistry Verification; ' END AS Status
        FROM st LEFT JOIN comp c ON st.doc_id = c.node LEFT JOIN numbered nb ON c.label = nb.label),
  hits AS (SELECT * FROM y WHERE cluster IN (SELECT cluster FROM y WHERE cluster <> -1 GROUP BY cluster HAVING max(v) - min(v) >= 0.2))
  SELECT doc_id, lang, cluster, round(v, 6) AS v, Status FROM hits
  UNION ALL SELECT doc_id, lang, cluster, round(v, 6) AS v, Status FROM y WHERE NOT EXISTS (SELECT 1 FROM hits)"""


@register("C9_curation_chain", _c9_sql())
def c9(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "n_chars", F.md5("text").alias("canon"),
                                                (F.col("n_chars") / 1000.0).alias("v"))
    ref = table(spark, d, "labels").select("doc_id", F.col("quality").alias("ref_count"))
    out = D.curate(docs, "doc_id", "text", "n_chars", "lang", "canon", ["doc_id"], words(), "v", stereo_ref=ref,
                   keep_manual=True, mixture_sep="!")
    return rounded(out.select("doc_id", "lang", "cluster", "v", "Status"))


def _turns(spark, d):
    return table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")


@register("J8_similarity_self_join", """WITH s AS (SELECT conv_id * 1000 + turn AS id, list_distinct(string_split_regex(text, '\\s+')) AS w FROM conversations),
  t AS (SELECT id, unnest(w) AS tok FROM s), n AS (SELECT id, len(w) AS sz FROM s),
  i AS (SELECT a.id AS a, b.id AS b, count(*) AS inter FROM t a JOIN t b ON a.tok = b.tok AND a.id < b.id GROUP BY 1, 2)
  SELECT a AS id_a, b AS id_b, round(inter / (na.sz + nb.sz - inter), 6) AS similarity
  FROM i JOIN n na ON i.a = na.id JOIN n nb ON i.b = nb.id WHERE inter / (na.sz + nb.sz - inter) >= 0.2""")
def j8(spark, d):
    """Self-join of every conversation turn against every other by word-set similarity >= 0.2."""
    return rounded(D.similar_pairs(_turns(spark, d), "id", words(), 0.2))


@register("J8_similar_links", f"WITH {classes_sql('conversations', 'conv_id * 1000 + turn', 0.2)} SELECT id, rep, class_size, n_links FROM links")
def j8_links(spark, d):
    """Every turn with its class and its number of links."""
    return D.similar_links(_turns(spark, d), "id", words(), 0.2)


@register("J8_representative_pairs", f"WITH {classes_sql('conversations', 'conv_id * 1000 + turn', 0.2)} SELECT a, b, round(similarity, 6) AS similarity FROM pairs")
def j8_pairs(spark, d):
    return rounded(D.similar_representatives(_turns(spark, d), "id", words(), 0.2)[0])


@register("O8_map_over_unique_keys", """WITH u AS (SELECT DISTINCT text FROM documents),
  f AS (SELECT text, (length(text) - length(replace(text, 'C(=O)N', ''))) / 6 > 5 OR contains(text, '!') AS flagged FROM u)
  SELECT d.doc_id, f.flagged FROM documents d JOIN f ON d.text = f.text""")
def o8(spark, d):
    """Evaluate a per-structure function once per distinct key, then join the result back to all rows."""
    from ecospark.functions.clean import is_biologic, is_mixture

    # the key is a digest and the length, so that no text is shuffled or compared; one text stands for each key
    docs = table(spark, d, "documents").select("doc_id", "text", F.sha2("text", 256).alias("key"), F.length("text").alias("n"))
    flagged = (is_biologic("text") | is_mixture("text", "!")).alias("flagged")
    per_key = docs.filter("text IS NOT NULL").select("key", "n", flagged).groupBy("key", "n").agg(F.first("flagged").alias("flagged"))
    return docs.select("doc_id", "key", "n").join(per_key, ["key", "n"]).select("doc_id", "flagged")
