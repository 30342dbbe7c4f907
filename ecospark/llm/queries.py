"""Queries of the llm operators over the driver's tables: ``opN_<name>`` and ``pipeline``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ecospark.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PIECES, WORDS = "piece_bpe_32k.model", "word_bpe_49k.json"


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer(name: str) -> str:
    """Path of a public tokenizer file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query
def op1_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ecospark.llm import minhash

    return minhash.near_duplicates(table(spark, sf_dir, "documents"), n=3, num=85, den=100)


ORACLES["op1_superminhash"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
     'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
     ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS s FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
 e AS (SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id
     GROUP BY x.doc_id, y.doc_id) p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
 r(doc_id, node) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN (SELECT doc_id, min(node) AS component_id FROM r GROUP BY doc_id) c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ecospark.llm import quality

    out = quality.quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *quality.FIELDS, "base_failed", "kept", "distance")


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ecospark.llm import packing

    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer(WORDS)).drop("tokens")


@query
def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ecospark.llm import licenses

    return licenses.scan(table(spark, sf_dir, "documents"))


@query
def op5_embedding_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ecospark.llm import embeddings

    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op6_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ecospark.llm import lm

    return lm.score(table(spark, sf_dir, "documents"))


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ecospark.llm import langid

    return langid.identify(table(spark, sf_dir, "documents"), tokenizer(PIECES))


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ecospark.llm import linededup

    out = linededup.line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", F.size("deleted").cast("long").alias("n_deleted"),
                      F.array_join(F.col("deleted").cast("array<string>"), ",").alias("deleted"), "text")


ORACLES["op8_line_dedup"] = r"""
WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
 l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM split),
 w AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS nw FROM l),
 c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS j,
         sum(nw) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM w WHERE nw > 0),
 run AS (SELECT a.doc_id, a.j AS s, min(b.j) AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.j >= a.j AND b.j < a.j + 50
           AND b.upto - a.upto + a.nw >= 50 GROUP BY a.doc_id, a.j
         UNION SELECT b.doc_id, max(a.j), b.j FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.j >= a.j AND b.j < a.j + 50
           AND b.upto - a.upto + a.nw >= 50 GROUP BY b.doc_id, b.j),
 body AS (SELECT r.doc_id, r.s, r.e, string_agg(c.line, chr(10) ORDER BY c.j) AS body FROM run r
          JOIN c ON c.doc_id = r.doc_id AND c.j BETWEEN r.s AND r.e GROUP BY r.doc_id, r.s, r.e),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, s) AS k FROM body),
 gone AS (SELECT DISTINCT c.doc_id, c.pos FROM ranked r JOIN c ON c.doc_id = r.doc_id AND c.j BETWEEN r.s AND r.e WHERE r.k > 1)
SELECT d.doc_id, len(d.ls) AS n_lines, count(g.pos) AS n_deleted, coalesce(string_agg(CAST(g.pos AS VARCHAR), ',' ORDER BY g.pos), '') AS deleted,
  coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL), '') AS text
FROM split d JOIN l ON l.doc_id = d.doc_id LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY d.doc_id, d.ls
"""


@query
def op9_sentencepiece_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ecospark.llm import transducer

    return transducer.round_trip(table(spark, sf_dir, "documents"), tokenizer(PIECES))


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ecospark.llm import tokencount

    return tokencount.count_tokens(table(spark, sf_dir, "documents"), tokenizer(PIECES))


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ecospark.llm import filteraudit

    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op11_filter_audit"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
     FROM documents),
 f AS (SELECT w.doc_id, part, CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
     + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END
     + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
     + CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS bits FROM w),
 l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
 cells AS (SELECT part, bits, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic
     FROM f LEFT JOIN l ON l.doc_id = f.doc_id GROUP BY part, bits),
 letter AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(name, bit)),
 o(ord, used) AS (SELECT '', 0 UNION ALL SELECT ord || name, used + bit FROM o, letter WHERE used & bit = 0),
 s AS (SELECT o.ord, k.step, l.bit, coalesce((SELECT sum(b.bit) FROM letter b WHERE strpos(o.ord, b.name) < k.step), 0) AS before
     FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step) k, letter l WHERE length(o.ord) = 5 AND l.name = substr(o.ord, k.step, 1))
SELECT c.part, s.ord AS filter_order, CAST(s.step AS INTEGER) AS step,
  CAST(sum(CASE WHEN c.bits & CAST(s.before + s.bit AS INTEGER) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
  CAST(sum(CASE WHEN c.bits & CAST(s.before AS INTEGER) = 0 AND c.bits & s.bit <> 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN c.bits & CAST(s.before AS INTEGER) <> 0 AND c.bits & s.bit <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
  CAST(sum(CASE WHEN c.bits = s.bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN c.bits & CAST(s.before AS INTEGER) = 0 AND c.bits & s.bit <> 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
  CAST(sum(CASE WHEN c.bits & CAST(s.before AS INTEGER) = 0 AND c.bits & s.bit <> 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
  CAST(sum(CASE WHEN c.bits & s.bit <> 0 THEN n * 120 // bit_count(c.bits) ELSE 0 END) AS BIGINT) AS shapley
FROM cells c, s GROUP BY c.part, s.ord, s.step
"""


@query
def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ecospark.llm import warc
    from ecospark.llm.tables import stored
    from ecospark.session import new_folder

    path = new_folder(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path, at_least=0)
    records = stored(warc.read_archives(spark, path).drop("payload"))  # the archives are read once; their digests were taken then
    return warc.page_rows(warc.captures(records, keep=())).drop("url")


ORACLES["op12_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
 b AS (SELECT page_id, h, min(page_id) OVER (PARTITION BY h) AS first, list_reduce(list_transform(string_split(sha1(h), ''),
       lambda x: lpad(bin(strpos('0123456789abcdef', x) - 1), 4, '0')), lambda x, y: x || y) AS bits FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, list_reduce(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST(list_sum(list_transform([1, 2, 3, 4, 5], lambda i: CAST(substr(bits, CAST(5 * k + i AS BIGINT), 1) AS INT) * (1 << (5 - i)))) AS INT), 1)),
    lambda x, y: x || y) AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM b
"""


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ecospark.llm import negatives

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return negatives.hard_negatives(vectors, anchor=F.col("id") % 100 == 0)


ORACLES["op13_hard_negatives"] = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
     list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
     WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
     FROM e a JOIN e b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id),
 p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
 n AS (SELECT p.a, p.b, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS rank, s.b AS neg, p.score AS ps, s.score AS ns
     FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT a AS anchor_id, b AS positive_id, CAST(rank AS INTEGER) AS rank, neg AS negative_id, ps AS positive_score, ns AS negative_score
FROM n WHERE rank <= 5
"""


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
