"""Line dedup (operator 8): repeated line runs from a suffix array over line-ID sequences.  [native]

A line is named by its ID (two independent hashes); lines without a word are passed over and always kept. Documents
in (doc_id, text hash) order form one sequence of line IDs, and a run of lines never crosses documents. Wanted are the runs of
consecutive lines with at least ``min_words`` words that occur again later: the first occurrence in (doc_id, line)
order stays, every line that lies in a later occurrence of such a run is deleted.

1. Lines that occur once can't lie in a repeated run. The others, cut into *segments* of neighbours, are the suffixes.
2. Distributed prefix doubling sorts them: ``rank_0`` is the order of the line IDs, ``rank_k+1`` the order of the
   pairs (``rank_k`` here, ``rank_k`` 2^k lines on). Only distinct pairs are sorted (counted in every task first, so
   a line that holds a third of all rows is one row), by a range-partitioned prefix sum. A rank is the first place of
   its interval in the suffix array: suffixes of one rank share their first 2^k lines.
3. A maximal run is the union of its *shortest* sub-runs that still hold ``min_words`` words, from every line on and
   up to every line. Such a sub-run has at most ``min_words`` lines, so log2(min_words) doublings suffice for
   documents of any length. The suffixes that share a sub-run of m lines are the LCP interval of length m, and its
   name is (m, rank_k here, rank_k m - 2^k lines on) with 2^k <= m < 2^(k+1).
4. In each interval the smallest position is the first occurrence; the lines of the other sub-runs go.

All of it is DataFrame operations. Only IDs and positions are shuffled, texts once at the end, beside their deletions.

Null texts stay null; empty texts stay empty. Rows that repeat both doc_id and text share one decision (they are one
document). Null ids come first in the order. Extra columns are carried; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ecospark.llm.tables import column, stored
from ecospark.operators.profile import prefix_sum

WORD = r"[^\x20\x09-\x0D]+"
#: a document: whether it has an id, the id (0 for null), the text's hash; no part is null, so plain equi-joins find all
KEY = ["o", "d", "th"]
#: places of deleted lines that a broadcast may hold
BROADCAST_PLACES = 4_000_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _keyed(docs: DataFrame) -> DataFrame:
    keyed = docs.select(column(docs, "doc_id", "long").alias("d"), column(docs, "text", "string").alias("t")).withColumn("th", F.xxhash64("t"))
    return keyed.withColumn("o", F.col("d").isNotNull()).withColumn("d", F.coalesce("d", F.lit(0)))


def suffixes(docs: DataFrame) -> DataFrame:
    """``(o, d, th, at, j, seg, h, h2, nw)``: the lines that occur more than once; ``at`` is the place among all lines of
    the document, ``j`` among its lines with a word; ``seg`` names its segments of neighbours."""
    placed = F.transform(_lines(F.col("t")), lambda x, i: F.struct(i.alias("at"), x.alias("line")))
    worded = F.filter(placed, lambda x: x["line"].rlike(r"[^\x20\x09-\x0D]"))
    lines = _keyed(docs).select(*KEY, F.posexplode(worded).alias("j", "x"))
    lines = lines.select(*KEY, "j", F.col("x.at").alias("at"), F.xxhash64("x.line").alias("h"), F.hash("x.line").alias("h2"),
                         F.regexp_count("x.line", F.lit(WORD)).cast("int").alias("nw"))
    # rows that repeat a document fall together here
    lines = stored(lines.groupBy(*KEY, "j").agg(*[F.first(x).alias(x) for x in ("at", "h", "h2", "nw")]))
    often = lines.groupBy("h", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h", "h2")
    kept = lines.join(often, ["h", "h2"])
    return kept.withColumn("seg", F.col("j") - F.row_number().over(Window.partitionBy(*KEY).orderBy("j")))


def ranked(keys: DataFrame, by: list[str]) -> DataFrame:
    """Distinct ``by`` with ``rank``: the number of rows of ``keys`` before them in their order."""
    counted = keys.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return prefix_sum(counted, by, "n", out="_upto").select(*by, (F.col("_upto") - F.col("n")).alias("rank"))


def short_runs(s: DataFrame, min_words: int) -> DataFrame:
    """Adds ``ahead`` and ``back``: lines of the shortest run of ``min_words`` words from here on and up to here within the
    segment (null: there is none)."""
    part = Window.partitionBy(*KEY, "seg")
    s = s.withColumn("before", F.coalesce(F.sum("nw").over(part.orderBy("j").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("total", F.sum("nw").over(part)).withColumn("upto", F.col("before") + F.col("nw"))
    # lines of the rest that begin before the run is long enough
    more = F.count(F.lit(1)).over(part.orderBy("before").rangeBetween(1, min_words - 1))
    less = F.count(F.lit(1)).over(part.orderBy("upto").rangeBetween(1 - min_words, -1))
    return (s.withColumn("ahead", F.when(F.col("total") - F.col("before") >= min_words, more + 1))
            .withColumn("back", F.when(F.col("upto") >= min_words, less + 1)).drop("before", "total", "upto"))


def deletions(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """``(d, th, gone)``: per document with deleted lines their places among all its lines."""
    s = stored(short_runs(suffixes(docs), min_words))
    longest = s.agg(F.max(F.greatest("ahead", "back"))).first()[0]
    if longest is None:  # no segment holds enough words
        return s.select("d", "th", F.array("at").alias("gone")).limit(0)
    top = longest.bit_length() - 1
    s = s.join(ranked(s, ["h", "h2"]), ["h", "h2"]).withColumnRenamed("rank", "r0").drop("h", "h2")
    line = Window.partitionBy(*KEY, "seg").orderBy("j")
    for k in range(top):
        s = stored(s.withColumn("next", F.lead(f"r{k}", 2**k).over(line)))
        pairs = ranked(s.filter("next IS NOT NULL"), [f"r{k}", "next"]).withColumnRenamed("rank", f"r{k + 1}")
        s = s.join(pairs, [f"r{k}", "next"], "left").drop("next")
    s = stored(s.select(*KEY, "seg", "j", "at", "ahead", "back", F.array(*[f"r{k}" for k in range(top + 1)]).alias("r")))
    fore = s.filter("ahead IS NOT NULL").select(*KEY, "seg", "j", F.col("ahead").alias("m"))
    rear = s.filter("back IS NOT NULL").select(*KEY, "seg", (F.col("j") - F.col("back") + 1).alias("j"), F.col("back").alias("m"))
    # the name of a run: its length and the ranks of its first and last 2^k lines, 2^k <= m < 2^(k + 1)
    power = F.expr("int(length(bin(m))) - 1")
    runs = fore.unionByName(rear).distinct().withColumn("k", power).withColumn("tail", F.expr("j + m - shiftleft(1, k)"))
    at = lambda name: s.select(*KEY, "seg", F.col("j").alias(name), F.col("r").alias(f"r_{name}"))
    runs = runs.join(at("j"), [*KEY, "seg", "j"]).join(at("tail"), [*KEY, "seg", "tail"])
    runs = stored(runs.select(*KEY, "j", "m", F.expr("r_j[k]").alias("a"), F.expr("r_tail[k]").alias("b")))
    first = runs.groupBy("m", "a", "b").agg(F.min(F.struct(*KEY, "j")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    later = runs.join(first, ["m", "a", "b"]).filter(~F.struct(*KEY, "j").eqNullSafe(F.col("first")))
    gone = later.select(*KEY, F.explode(F.expr("sequence(j, int(j + m - 1))")).alias("j")).distinct()
    s = s.select(*KEY, "j", "at")
    places = gone.join(s, [*KEY, "j"]).groupBy(*KEY).agg(F.sort_array(F.collect_list("at")).alias("gone"))
    return places.select(F.when(F.col("o"), F.col("d")).alias("d"), "th", "gone")


def _marked(docs: DataFrame, min_words: int) -> DataFrame:
    """``docs`` with ``_llm_gone``: the places of the lines to delete (null: none). The deletions are broadcast if they are
    counted to be few; beyond that the join shuffles."""
    gone = stored(deletions(docs, min_words).select(F.col("d").alias("_llm_d"), F.col("th").alias("_llm_th"), F.col("gone").alias("_llm_gone")))
    size = gone.agg(F.coalesce(F.sum(F.size("_llm_gone") + 4), F.lit(0))).first()[0]
    same = column(docs, "doc_id", "long").eqNullSafe(F.col("_llm_d")) & (F.xxhash64(column(docs, "text", "string")) == F.col("_llm_th"))
    return docs.join(F.broadcast(gone) if size <= BROADCAST_PLACES else gone, same, "left").drop("_llm_d", "_llm_th")


def _left(text: Column, gone: Column) -> Column:
    """The text without the lines at ``gone``."""
    lines = F.filter(F.transform(_lines(text), lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda x: ~F.array_contains(gone, x["i"]))
    return F.when(gone.isNull(), text).otherwise(F.array_join(F.transform(lines, lambda x: x["x"]), "\n"))


def line_dedup(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """``(doc_id, n_lines, deleted, text)``: lines of the text as given (null: 0), places of the deleted ones, and the
    text that is left."""
    base = docs.select(column(docs, "doc_id", "long"), column(docs, "text", "string"))
    out = _marked(base, min_words)
    return out.select("doc_id", F.coalesce(F.size(_lines(F.col("text"))), F.lit(0)).cast("long").alias("n_lines"),
                      F.coalesce("_llm_gone", F.array().cast("array<int>")).alias("deleted"), _left(F.col("text"), F.col("_llm_gone")).alias("text"))


def without_repeats(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """All rows of ``docs``, all columns, with the repeated runs deleted from ``text`` (a document may become empty)."""
    out = _marked(docs, min_words)
    return out.withColumn("text", _left(F.col("text"), F.col("_llm_gone"))).select(*docs.columns)
