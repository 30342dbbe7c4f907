"""Chemical identity resolution as joins against reference tables.

The reference calls four web services per unique (name, CAS) pair from a thread pool. Here the
service answers are a table ``lookup(key, source, priority, value, valid[, bits])`` with at most
one row per (key, source); every rule below is a join, an aggregate or a row-local expression.
Candidates per key are bounded by the number of sources (a fixed parameter), which is what makes
the in-row pairwise comparisons of R4/R5 safe: no group ever grows with the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ecospark.functions.cols import c


def unique_keys(df: DataFrame, name: str, cas: str | None = None) -> DataFrame:
    """Distinct (name, CAS) pairs with at least one of them present."""
    cols = [name] + ([cas] if cas else [])
    out = df.select(*[c(x) for x in cols]).distinct()
    return out.filter(F.coalesce(*[c(x) for x in cols]).isNotNull()) if len(cols) > 1 else out.filter(c(name).isNotNull())


def _usable(lookup: DataFrame) -> DataFrame:
    return lookup.filter(F.col("value").isNotNull() & F.coalesce(F.col("valid"), F.lit(False)))


def by_priority(keys: DataFrame, lookup: DataFrame, key: str = "key") -> DataFrame:
    """R2: per key, the value of the first source in priority order holding a valid value.
    ``(key, value, source)``; keys without any valid value get nulls."""
    best = (_usable(lookup).groupBy(c(key))
            .agg(F.min(F.struct("priority", "source", "value")).alias("_b"))
            .select(c(key), F.col("_b.value").alias("value"), F.col("_b.source").alias("source")))
    return keys.select(c(key)).join(best, key, "left")


def consensus(lookup: DataFrame, key: str = "key") -> DataFrame:
    """All valid values agree (>1 source) -> value; exactly one valid source -> value; else null."""
    agg = _usable(lookup).groupBy(c(key)).agg(
        F.count("value").alias("n"), F.count_distinct("value").alias("nd"), F.min("value").alias("v"))
    all_keys = lookup.select(c(key)).distinct()
    return all_keys.join(agg, key, "left").select(
        c(key), F.when((F.col("n") > 1) & (F.col("nd") == 1), F.col("v")).when(F.col("n") == 1, F.col("v")).alias("value"))


def tanimoto(a: Column, b: Column) -> Column:
    """|A n B| / |A u B| of two on-bit (or token) arrays; null when both are empty."""
    inter = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    return F.when(a.isNotNull() & b.isNotNull() & (union > 0), inter / union)


def _pairwise_avg(cands: Column) -> Column:
    """Mean Tanimoto over all i < j of an in-row array of candidates with ``bits`` (bounded size)."""
    n = F.size(cands)
    sims = F.flatten(F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.transform(
            F.filter(F.sequence(F.lit(0), n - 1), lambda j: j > i),
            lambda j: tanimoto(F.element_at(cands, i + 1)["bits"], F.element_at(cands, j + 1)["bits"]))))
    return F.aggregate(sims, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0))) / F.size(sims)


def consensus_status(lookup: DataFrame, key: str = "key") -> DataFrame:
    """Value (first valid in priority order) with a note: all agree / structural match (mean
    pairwise similarity 1) / mismatch with the mean similarity / single source / none.
    ``(key, value, notes, similarity)``."""
    per_key = _usable(lookup).groupBy(c(key)).agg(
        F.array_sort(F.collect_list(F.struct("priority", "source", "value", "bits"))).alias("_c"),
        F.count_distinct("value").alias("_nd"))
    n = F.size("_c")
    sim = F.when(n > 1, _pairwise_avg(F.col("_c")))
    srcs = F.concat(F.lit("['"), F.array_join(F.transform("_c", lambda x: x["source"]), "', '"), F.lit("']"))
    notes = (F.when(n == 0, F.lit("No valid InChI found"))
             .when((n > 1) & (F.col("_nd") == 1), F.concat(F.lit("Match from multiple sources: "), srcs))
             .when((n > 1) & (F.col("_sim") == 1.0), F.lit("Structural match from multiple sources after comparison"))
             .when(n > 1, F.concat(F.lit("Structure mismatch (average similarity: "),
                                   F.format_number(F.col("_sim"), 2), F.lit(")")))
             .otherwise(F.lit("")))
    res = per_key.withColumn("_sim", F.when(F.col("_nd") > 1, sim).when(n > 1, F.lit(1.0)))
    res = res.select(c(key), F.element_at("_c", 1)["value"].alias("value"), notes.alias("notes"),
                     F.col("_sim").alias("similarity"))
    missing = lookup.select(c(key)).distinct().join(res.select(c(key)), key, "left_anti").select(
        c(key), F.lit(None).cast("string").alias("value"), F.lit("No valid InChI found").alias("notes"),
        F.lit(None).cast("double").alias("similarity"))
    return res.unionByName(missing)


def wide_candidates(lookup: DataFrame, sources: Sequence[str], key: str = "key") -> DataFrame:
    """Pivot the (bounded) candidates of the named sources to one row per key:
    ``{s}_value, {s}_valid, {s}_bits`` for each source ``s``."""
    aggs = []
    for s in sources:
        hit = F.col("source") == F.lit(s)
        aggs += [F.max(F.when(hit, F.col("value"))).alias(f"{s}_value"),
                 F.max(F.when(hit, F.col("valid"))).alias(f"{s}_valid"),
                 F.first(F.when(hit, F.col("bits")), ignorenulls=True).alias(f"{s}_bits")]
    return lookup.groupBy(c(key)).agg(*aggs)


def two_source(wide: DataFrame, a: str, b: str, tiebreak: str, key: str = "key") -> DataFrame:
    """The two-source decision table (10 outcomes) with a third source as tie-break.
    Input from :func:`wide_candidates`; output ``(key, value, notes)``."""
    va, vb, vc = F.col(f"{a}_value"), F.col(f"{b}_value"), F.col(f"{tiebreak}_value")
    oka, okb, okc = [F.coalesce(F.col(f"{s}_valid"), F.lit(False)) for s in (a, b, tiebreak)]
    sim_ab = tanimoto(F.col(f"{a}_bits"), F.col(f"{b}_bits"))
    sim_ac = tanimoto(F.col(f"{a}_bits"), F.col(f"{tiebreak}_bits"))
    sim_bc = tanimoto(F.col(f"{b}_bits"), F.col(f"{tiebreak}_bits"))
    both = va.isNotNull() & vb.isNotNull()
    notes = (
        F.when(both & (va == vb) & oka, F.lit("Match and validated"))
        .when(both & (va == vb), F.lit("Match but validation failed"))
        .when(both & oka & okb & (sim_ab == 1.0), F.lit("Structural match after comparison"))
        .when(both & oka & okb & vc.isNotNull() & (sim_ac == 1.0), F.lit(f"{tiebreak} matches {a} structure"))
        .when(both & oka & okb & vc.isNotNull() & (sim_bc == 1.0), F.lit(f"{tiebreak} matches {b} structure"))
        .when(both & oka & okb & vc.isNotNull(), F.lit(f"{tiebreak} structure mismatch"))
        .when(both & oka & okb, F.concat(F.lit("Structure mismatch (similarity: "), F.format_number(sim_ab, 2), F.lit(")")))
        .when(both & oka, F.lit(f"Mismatch; {a} value is valid"))
        .when(both & okb, F.lit(f"Mismatch; {b} value is valid"))
        .when(both, F.lit("Mismatch; both values failed validation"))
        .when(va.isNotNull() & oka, F.lit(f"Found only in {a} and validated"))
        .when(va.isNotNull(), F.lit(f"Found only in {a} but validation failed"))
        .when(vb.isNotNull() & okb, F.lit(f"Found only in {b} and validated"))
        .when(vb.isNotNull(), F.lit(f"Found only in {b} but validation failed"))
        .when(vc.isNotNull() & okc, F.lit(f"Found only in {tiebreak} and validated"))
        .when(vc.isNotNull(), F.lit(f"Found only in {tiebreak} but validation failed"))
        .otherwise(F.lit("No value found"))
    )
    tie_wins = (both & oka & okb & vc.isNotNull() & ~F.coalesce(sim_ab == 1.0, F.lit(False))
                & F.coalesce((sim_ac == 1.0) | (sim_bc == 1.0), F.lit(False)))
    value = F.when(tie_wins, vc).otherwise(F.coalesce(va, vb, vc))
    return wide.select(c(key), value.alias("value"), notes.alias("notes"))


def via_synonyms(keys: DataFrame, synonyms: DataFrame, lookup: DataFrame, key: str = "key") -> DataFrame:
    """Retry a name under each alias ``synonyms(name, rank, synonym)``; the first valid hit by
    alias rank (then source priority) wins. ``(key, value, synonym)``."""
    hits = (synonyms.join(_usable(lookup).withColumnRenamed(key, "synonym"), "synonym")
            .groupBy(F.col("name").alias(key))
            .agg(F.min(F.struct("rank", "priority", "value", "synonym")).alias("_b"))
            .select(c(key), F.col("_b.value").alias("value"), F.col("_b.synonym").alias("synonym")))
    return keys.select(c(key)).join(hits, key, "left")


def fallback_chain(keys: DataFrame, reference: DataFrame, stages: Sequence[tuple[str, Column]],
                   key: str = "key", ref_key: str = "name", ref_value: str = "value") -> DataFrame:
    """Try lookup keys stage by stage (e.g. name, parenthesised candidate, formatted name,
    formatted CAS); the first stage that resolves wins, with its stage name as provenance.

    All stages are tried in one union + join + aggregate (no per-stage round trip)."""
    attempts = None
    for i, (label, expr) in enumerate(stages):
        a = keys.select(c(key), expr.alias("_probe"), F.lit(i).alias("_stage"), F.lit(label).alias("stage"))
        attempts = a if attempts is None else attempts.unionByName(a)
    ref = reference.select(c(ref_key).alias("_probe"), c(ref_value).alias("_value"))
    best = (attempts.filter(F.col("_probe").isNotNull()).join(ref, "_probe")
            .groupBy(c(key)).agg(F.min(F.struct("_stage", "stage", "_value")).alias("_b"))
            .select(c(key), F.col("_b._value").alias("value"), F.col("_b.stage").alias("stage")))
    return keys.select(c(key)).distinct().join(best, key, "left").withColumn(
        "stage", F.coalesce(F.col("stage"), F.lit("unresolved")))


def propagate(df: DataFrame, resolved: DataFrame, key: str, value: str = "value", out: str | None = None,
              drop_unresolved: bool = False) -> DataFrame:
    """Attach the resolved value to every row (left join on the key); the older reference
    versions then drop unresolved rows and duplicates (``drop_unresolved``)."""
    out = out or value
    r = resolved.select(c(key), c(value).alias(out))
    j = df.join(r, key, "left")
    return j.filter(c(out).isNotNull()).distinct() if drop_unresolved else j


def outcomes(df: DataFrame, status: str, name: str = "count") -> DataFrame:
    """Outcome counters."""
    return df.groupBy(c(status)).agg(F.count(F.lit(1)).alias(name))


def source_counts(df: DataFrame, col: str, words: Sequence[str]) -> DataFrame:
    """Rows whose text mentions each keyword (case-insensitive), long form ``(source, count)``."""
    one = df.agg(*[F.count_if(F.coalesce(F.lower(c(col)).contains(w.lower()), F.lit(False))).alias(f"n{i}")
                   for i, w in enumerate(words)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(w).alias("source"), F.col(f"n{i}").alias("count"))
                                          for i, w in enumerate(words)])).alias("r")).select("r.*")


def top_with_rest(df: DataFrame, col: str, n: int = 5, label: str = "Not validated") -> DataFrame:
    """The n most frequent values (ties by value) and the rest summed under ``label``.
    The top n come from a distributed take-ordered (n rows, a proven bound for the broadcast)."""
    counts = df.filter(c(col).isNotNull()).groupBy(c(col)).agg(F.count(F.lit(1)).alias("count"))
    top = counts.orderBy(F.col("count").desc(), c(col)).limit(n).select(c(col), F.lit(True).alias("_top"))
    marked = counts.join(F.broadcast(top), col, "left")
    return marked.groupBy(F.when(F.col("_top"), c(col).cast("string")).otherwise(F.lit(label)).alias(col)).agg(
        F.sum("count").alias("count"))


def enrich(df: DataFrame, props: DataFrame, key: str, long_form: tuple[str, str, Sequence[str]] | None = None) -> DataFrame:
    """Add property columns by key. ``props`` is wide, or long when ``long_form =
    (name_col, value_col, names)``: then it is pivoted to one column per declared name first."""
    if long_form:
        name_col, value_col, names = long_form
        props = props.groupBy(c(key)).agg(*[F.first(F.when(c(name_col) == F.lit(n), c(value_col)), ignorenulls=True)
                                            .alias(n) for n in names])
    return df.join(props, key, "left")


def add_mass(df: DataFrame, mass: DataFrame, key: str, mw: str = "mw") -> DataFrame:
    """Molar mass by key (left join; the mass is cast to double, Q1)."""
    return df.join(mass.select(c(key), c(mw).cast("double").alias(mw)), key, "left")


def coverage(df: DataFrame, name: str, value: str) -> DataFrame:
    """Unique names vs resolved names, rows vs resolved rows; one aggregate."""
    return df.agg(
        F.count_distinct(c(name)).alias("unique_names"),
        F.count_distinct(F.when(c(value).isNotNull(), c(name))).alias("resolved_names"),
        F.count(F.lit(1)).alias("rows"),
        F.count(c(value)).alias("resolved_rows"),
    )


def verify_keys(df: DataFrame, a: str, b: str, regenerated: str) -> DataFrame:
    """Key-pair tracking with four verification labels; absent stays null (Q18)."""
    va, vb, vr = c(a), c(b), c(regenerated)
    both_same = va.isNotNull() & vb.isNotNull() & (va == vb)
    label = (F.when(both_same & (vr == va), F.lit("Sources and regenerated key match"))
             .when(vr.isNotNull(), F.lit("Regenerated key used"))
             .when(va.isNotNull() | vb.isNotNull(), F.lit("Single source key used"))
             .otherwise(F.lit("No key found")))
    value = F.when(both_same & (vr == va), va).when(vr.isNotNull(), vr).otherwise(F.coalesce(va, vb))
    case = (F.when(va.isNotNull() & vb.isNull(), F.lit("first only"))
            .when(va.isNull() & vb.isNotNull(), F.lit("second only")))
    return df.withColumns({"verified_key": value, "verification": label, "case": case})
