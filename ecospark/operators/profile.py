"""Profiling aggregates, sorts and set ops.

Whole-table statistics are single aggregates (one pass, partial aggregation per task). Results are
returned in long form ``(column, value...)`` so plans stay narrow however wide the input is.
Ranks and running totals use a distributed prefix sum (range partitioning + per-partition offsets)
instead of an un-partitioned window, so no single task ever holds the whole column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ecospark.functions.cols import c, numeric
from ecospark.operators.joins import counted_lookup
from ecospark.session import cut_lineage

# ---------------------------------------------------------------- counts


def value_counts(df: DataFrame, col: str | Sequence[str], min_count: int | None = None, name: str = "count") -> DataFrame:
    """G1 (+G4 with ``min_count``): counts per non-null value (or value combination of several
    columns, rows with any null excluded), descending, ties by value."""
    cols = [col] if isinstance(col, str) else list(col)
    present = F.lit(True)
    for x in cols:
        present = present & c(x).isNotNull()
    out = df.filter(present).groupBy(*[c(x) for x in cols]).agg(F.count(F.lit(1)).alias(name))
    if min_count is not None:
        out = out.filter(F.col(name) > min_count)
    return out.orderBy(F.col(name).desc(), *[c(x) for x in cols])


def size(df: DataFrame, by: Sequence[str], name: str = "count") -> DataFrame:
    """Rows per group (null keys form their own group, like ``groupby(dropna=False).size``)."""
    return df.groupBy(*[c(b) for b in by]).agg(F.count(F.lit(1)).alias(name))


def nunique(df: DataFrame, by: Sequence[str], col: str, name: str = "nunique") -> DataFrame:
    """Distinct non-null values of ``col`` per group."""
    return df.groupBy(*[c(b) for b in by]).agg(F.count_distinct(c(col)).alias(name))


def count_pivot(
    df: DataFrame, species: str, stage: str, endpoint: str, values: Sequence[str], names: Sequence[str] | None = None
) -> DataFrame:
    """Rows per (species, stage) x endpoint, missing cells 0; the endpoint list is declared."""
    names = list(names) if names else list(values)
    return df.groupBy(c(species), c(stage)).agg(
        *[F.count_if(c(endpoint) == F.lit(v)).alias(n) for v, n in zip(values, names)]
    )


# ---------------------------------------------------------------- column profiles


def _long(row_exprs: list[Column]) -> Column:
    return F.explode(F.array(*row_exprs))


def nan_to_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The one rule for missing numbers: NaN is missing, like null (as ``dropna`` and pandas treat it)."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))} & set(cols)
    return df.withColumns({x: F.nanvl(c(x), F.lit(None).cast(df.schema[x].dataType)) for x in floating}) if floating else df


def missing(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Null (and NaN) count and percentage per column, sorted by count desc then name."""
    cols = list(cols) if cols else df.columns
    df = nan_to_null(df.select(*[c(x) for x in cols]), cols)
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(c(x).isNull()).alias(f"_m{i}") for i, x in enumerate(cols)])
    rows = one.select(
        _long([F.struct(F.lit(x).alias("column"), F.col(f"_m{i}").alias("missing"), F.col("_n").alias("n"))
               for i, x in enumerate(cols)]).alias("r")
    ).select("r.*")
    return rows.select(
        "column", "missing", F.try_divide(F.col("missing") * 100.0, F.col("n")).alias("percent")
    ).orderBy(F.col("missing").desc(), "column")


def exact_quantiles(df: DataFrame, cols: Sequence[str], qs: Sequence[float]) -> DataFrame:
    """Exact quantiles (linear interpolation, as pandas) of numeric columns, nulls and NaN left out: ``(column, q, value)``,
    one row per column with values and quantile.

    Distributed: distinct values are counted (folded per task), a range-partitioned prefix sum gives each value its
    ranks, and the two values at the ranks next to ``q * (n - 1)`` are picked. No task sees a whole column."""
    values = melt(nan_to_null(df, cols), cols, name="column").filter("value IS NOT NULL")
    counts = values.groupBy("column", "value").agg(F.count(F.lit(1)).alias("_cnt"))
    cum = prefix_sum(counts, ["value"], "_cnt", out="_cum", by=["column"])
    n = cum.groupBy("column").agg(F.max("_cum").alias("_n"))  # one row per column
    ranks = n.select("column", F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q"), "_n")
    ranks = ranks.withColumn("_at", F.col("q") * (F.col("_n") - 1))
    both = cum.join(F.broadcast(ranks), "column")
    holds = lambda k: (F.col("_cum") - F.col("_cnt") <= k) & (k < F.col("_cum"))
    low, high = F.floor("_at"), F.ceil("_at")
    picked = both.filter(holds(low) | holds(high)).groupBy("column", "q", "_at").agg(
        F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    return picked.select("column", "q", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_at") - F.floor("_at"))).alias("value"))


def describe(df: DataFrame, cols: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Count, mean, std (sample), min, quartiles (linear), max per numeric column, long form
    ``(column, count, mean, std, min, p25, p50, p75, max)``. NaN counts as missing. ``exact=False``: approximate
    quartiles in one pass."""
    cols = list(cols) if cols else numeric(df)
    df = nan_to_null(df.select(*[c(x) for x in cols]), cols)
    aggs = []
    for i, x in enumerate(cols):
        v = c(x).cast("double")
        stats = [F.lit(x).alias("column"), F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
                 F.min(v).alias("min"), F.max(v).alias("max")]
        if not exact:
            stats.append(F.percentile_approx(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(100000)).alias("_q"))
        aggs.append(F.struct(*stats).alias(f"s{i}"))
    rows = df.agg(*aggs).select(_long([F.col(f"s{i}") for i in range(len(cols))]).alias("r")).select("r.*")
    if exact:
        quart = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
        at = lambda q: F.max(F.when(F.col("q") == q, F.col("value")))
        rows = rows.join(quart.groupBy("column").agg(F.array(at(0.25), at(0.5), at(0.75)).alias("_q")), "column", "left")
    return rows.select("column", "count", "mean", "std", "min", F.col("_q")[0].alias("p25"),
                       F.col("_q")[1].alias("p50"), F.col("_q")[2].alias("p75"), "max")


def describe_text(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, unique, top, freq per text column (top ties broken by the smallest value).

    Long form: each column is unpivoted to (column, value) rows and counted per (column, value)
    with one shuffle, instead of one job per column."""
    melted = df.select(_long([F.struct(F.lit(x).alias("column"), c(x).cast("string").alias("value")) for x in cols])
                       .alias("r")).select("r.*").filter(F.col("value").isNotNull())
    per_value = melted.groupBy("column", "value").agg(F.count(F.lit(1)).alias("freq"))
    return per_value.groupBy("column").agg(
        F.sum("freq").alias("count"),
        F.count(F.lit(1)).alias("unique"),
        F.min(F.struct((-F.col("freq")).alias("nf"), F.col("value").alias("v"))).alias("_t"),
    ).select("column", "count", "unique", F.col("_t.v").alias("top"), (-F.col("_t.nf")).alias("freq"))


def schema(df: DataFrame) -> DataFrame:
    """Column, type and non-null count (``DataFrame.info``)."""
    one = df.agg(*[F.count(c(f.name)).alias(f"n{i}") for i, f in enumerate(df.schema.fields)])
    return one.select(_long([
        F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"),
                 F.col(f"n{i}").alias("non_null"))
        for i, f in enumerate(df.schema.fields)]).alias("r")).select("r.*")


def variances(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Population variance per column (nulls and NaN ignored, like ``np.nanvar``)."""
    cols = list(cols) if cols else numeric(df)
    df = nan_to_null(df, cols)
    one = df.agg(*[F.var_pop(c(x).cast("double")).alias(f"v{i}") for i, x in enumerate(cols)])
    return one.select(_long([F.struct(F.lit(x).alias("column"), F.col(f"v{i}").alias("variance"))
                             for i, x in enumerate(cols)]).alias("r")).select("r.*")


def distinct(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Distinct non-null values per column; unpivoted and counted with one shuffle."""
    cols = list(cols) if cols else df.columns
    melted = df.select(_long([F.struct(F.lit(x).alias("column"), c(x).cast("string").alias("value")) for x in cols])
                       .alias("r")).select("r.*").filter(F.col("value").isNotNull())
    counts = melted.distinct().groupBy("column").agg(F.count(F.lit(1)).alias("nunique"))
    names = df.sparkSession.createDataFrame([(x,) for x in cols], "column string")
    return names.join(counts, "column", "left").select("column", F.coalesce("nunique", F.lit(0)).alias("nunique"))


# ---------------------------------------------------------------- quantiles, ranges


def quantile(df: DataFrame, col: str, q: float, exact: bool = True) -> DataFrame:
    """One-row quantile (linear interpolation, as pandas; null for a column without values)."""
    if not exact:
        return nan_to_null(df, [col]).agg(F.percentile_approx(c(col), F.lit(q), F.lit(100000)).alias("quantile"))
    return exact_quantiles(df, [col], [q]).agg(F.max("value").alias("quantile"))


def spread(df: DataFrame, by: Sequence[str], col: str, name: str = "range") -> DataFrame:
    """Max - min per group."""
    return df.groupBy(*[c(b) for b in by]).agg((F.max(c(col)) - F.min(c(col))).alias(name))


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """Equal-width bins between min and max (the last bin closed); ``(bin, lo, hi, count)``."""
    mm = df.agg(F.min(c(col)).alias("lo"), F.max(c(col)).alias("hi")).first()
    lo, hi = mm["lo"], mm["hi"]
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, lo double, hi double, count long")
    width = (hi - lo) / bins if hi > lo else 1.0
    b = F.least(F.floor((c(col) - F.lit(lo)) / F.lit(width)).cast("int"), F.lit(bins - 1))
    return (df.filter(c(col).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
            .select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lo"),
                    (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("hi"), "count"))


# ---------------------------------------------------------------- prefix sums, ranks


def prefix_sum(df: DataFrame, order: Sequence[str], value: str, out: str = "cumulative",
               by: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """Running total of ``value`` in ``order`` (within ``by`` groups), inclusive of the current row.

    Distributed: rows are range-partitioned on (by, order); each task sums its slice; the per-slice
    totals (at most partitions + groups rows, so bounded) give each slice its starting offset.
    ``order`` must be unique within ``by`` for a deterministic result."""
    by = list(by)
    n_parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*by, *order]
    # the partition id of a row must be the same for the running sums and the per-partition
    # totals: range bounds come from sampling, so the assignment is materialised once
    ranged = cut_lineage(df.repartitionByRange(n_parts, *[c(k) for k in keys]).withColumn("_pid", F.spark_partition_id()))
    local = Window.partitionBy("_pid", *[c(b) for b in by]).orderBy(*[c(o) for o in order]).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    ranged = ranged.withColumn("_local", F.sum(c(value)).over(local))
    totals = ranged.groupBy("_pid", *[c(b) for b in by]).agg(F.sum(c(value)).alias("_tot"))
    before = Window.partitionBy(*[c(b) for b in by]).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_off", F.coalesce(F.sum("_tot").over(before), F.lit(0))).drop("_tot")
    # without groups the offsets table has one row per partition (bounded): broadcast it; with
    # groups it has up to partitions + groups rows, so the planner (AQE) chooses the join
    joined = ranged.join(offsets if by else F.broadcast(offsets), on=["_pid", *by], how="left")
    return joined.withColumn(out, F.col("_off") + F.col("_local")).drop("_pid", "_local", "_off")


def average_rank(df: DataFrame, by: Sequence[str], value: str, out: str = "rank") -> DataFrame:
    """Average rank (ties share the mean of their positions, 1-based) of ``value`` within ``by``.

    Distinct values are counted first (one shuffle), ranked by a distributed prefix sum of the
    counts, then joined back to the rows, frequent values without a shuffle."""
    by = list(by)
    return counted_lookup(df, value_ranks(df, by, value, out), [*by, value], "_cnt").drop("_cnt")


def value_ranks(df: DataFrame, by: Sequence[str], value: str, out: str = "rank", sums: Sequence[Column] = ()) -> DataFrame:
    """(by..., value, ``_cnt``, ``out``) per distinct value: its number of rows and average rank within ``by``, plus further
    aggregates. Rows of one value are folded per task, so a value that half of all rows hold is one row per task, and
    values are ranked by the distributed prefix sum of their counts."""
    counts = df.groupBy(*[c(b) for b in by], c(value)).agg(F.count(F.lit(1)).alias("_cnt"), *sums)
    cum = prefix_sum(counts, [value], "_cnt", out="_cum", by=by)
    return cum.withColumn(out, F.col("_cum") - F.col("_cnt") + (F.col("_cnt") + 1) / 2.0).drop("_cum")


def cumulative(df: DataFrame, order: Sequence[str], value: str, out: str = "cumulative") -> DataFrame:
    """Running total in ``order`` (unique)."""
    return prefix_sum(df, order, value, out)


# ---------------------------------------------------------------- correlations


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson r over the rows where both sides are present; null (not an error) when either side
    is constant. (``corr`` divides by zero on a constant column under ANSI mode.)"""
    both = x.isNotNull() & y.isNotNull()
    return F.try_divide(F.covar_pop(x, y),
                        F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y)))


SAFE_CORR_SQL = ("try_divide(covar_pop({a}, {b}), stddev_pop(CASE WHEN {b} IS NOT NULL THEN {a} END) "
                 "* stddev_pop(CASE WHEN {a} IS NOT NULL THEN {b} END))")


def pearson(df: DataFrame, cols: Sequence[str], pairs: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """Pairwise-complete Pearson r for each pair (all i < j by default), long form (a, b, r).

    Rows where either side is null or NaN don't count for a pair (the pandas pairwise rule); r is null when either side is
    constant over the pair's rows or a column holds an infinity. Any width: see :mod:`ecospark.operators.gram`."""
    from ecospark.operators import gram

    return gram.correlations(df, list(cols)) if pairs is None else gram.correlations_of(df, list(pairs))


def melt(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = (), name: str = "feature", value: str = "value") -> DataFrame:
    """Unpivot ``cols`` (cast to double) to long form, keeping ``keep`` columns."""
    return df.select(*[c(k) for k in keep], _long(
        [F.struct(F.lit(x).alias(name), c(x).cast("double").alias(value)) for x in cols]).alias("_r")
    ).select(*[c(k) for k in keep], "_r.*")


def spearman(df: DataFrame, target: str, cols: Sequence[str]) -> DataFrame:
    """Spearman rho of each column with ``target`` over the pairwise-complete rows:
    average ranks within each feature's complete rows, then Pearson of the ranks. ``(feature, rho)``; null without two
    different values on either side.

    The target is ranked once per set of rows: once for all features without gaps (one pre-check counts them), and per
    feature with gaps. Then a feature needs no ranked rows: rows are folded to (feature, value, rows, sums of the
    target's ranks), which a task does before anything is shuffled, the values are ranked by their counts, and
    the sums of products follow from ``rank * sum of target ranks`` per value. So the zeros of a sparse descriptor are one
    row per task and no row is joined to its rank."""
    y = c(target).cast("double")
    valid = lambda e: e.isNotNull() & ~F.isnan(e)
    names = df.sparkSession.createDataFrame([(x,) for x in cols], "feature string")
    base = df.filter(valid(y)).select(*[c(x).cast("double").alias(x) for x in dict.fromkeys(cols) if x != target], y.alias("_y"))
    source = lambda x: "_y" if x == target else x
    seen = base.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(valid(c(x))).alias(f"g{i}") for i, x in enumerate(map(source, cols))]).first()
    whole = [x for i, x in enumerate(cols) if seen[f"g{i}"] == seen["n"]]
    parts = []
    if whole:
        ranked = average_rank(base, [], "_y", "_ry")
        parts.append(_melt_as(ranked, {x: source(x) for x in whole}, "_ry"))
    gaps = [x for x in cols if x not in whole]
    if gaps:
        long = _melt_as(base, {x: source(x) for x in gaps}, "_y").filter(valid(F.col("value")))
        parts.append(average_rank(long, ["feature"], "_y", "_ry").select("feature", "value", "_ry"))
    found = None
    for part in parts:
        folded = value_ranks(part, ["feature"], "value", "_rx", [F.sum("_ry").alias("_sy"), F.sum(F.col("_ry") * F.col("_ry")).alias("_qy")])
        n, rx, sy = F.col("_cnt"), F.col("_rx"), F.col("_sy")
        one = folded.groupBy("feature").agg(
            F.sum(n).alias("n"), F.count(F.lit(1)).alias("values"), F.sum(n * rx).alias("sx"), F.sum(n * rx * rx).alias("qx"), F.sum(sy).alias("sy"),
            F.sum("_qy").alias("qy"), F.sum(rx * sy).alias("p"))
        found = one if found is None else found.unionByName(one)
    if found is None:
        return names.select("feature", F.lit(None).cast("double").alias("rho"))
    mean = (F.col("n") + 1) / 2.0  # of average ranks
    vx, vy = F.col("qx") - F.col("n") * mean * mean, F.col("qy") - F.col("n") * mean * mean
    flat = (F.col("values") < 2) | (vy <= F.lit(1e-12) * F.col("qy"))
    rho = F.try_divide(F.col("p") - F.col("n") * mean * mean, F.sqrt(vx) * F.sqrt(vy))
    found = found.select("feature", F.when(~flat, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), rho))).alias("rho"))
    return names.join(found, "feature", "left")


def _melt_as(df: DataFrame, sources: dict[str, str], keep: str) -> DataFrame:
    """(feature, value, keep): one row per row and named source column."""
    pairs = F.array(*[F.struct(F.lit(name).alias("feature"), c(x).alias("value")) for name, x in sources.items()])
    return df.select(c(keep), F.explode(pairs).alias("_r")).select("_r.*", c(keep))


def target_correlation(df: DataFrame, target: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Pearson r of each numeric column with the target, nulls dropped, descending."""
    cols = [x for x in (cols or numeric(df)) if x != target]
    r = pearson(df, cols, [(x, target) for x in cols])
    return r.filter(F.col("r").isNotNull() & ~F.isnan("r")).select(F.col("a").alias("feature"), "r").orderBy(
        F.col("r").desc(), "feature")


# ---------------------------------------------------------------- sorts, sets


def sorted_by(df: DataFrame, by: Sequence[str], descending: bool = False) -> DataFrame:
    """O1/O2: total order; Spark range-partitions then sorts each partition."""
    return df.orderBy(*[(c(b).desc() if descending else c(b).asc()) for b in by])


def top(df: DataFrame, by: Sequence[str], n: int, descending: bool = True) -> DataFrame:
    """O3: top n rows (TakeOrderedAndProject: each task keeps n, the driver merges n x tasks)."""
    return sorted_by(df, by, descending).limit(n)


def stack_rows(*dfs: DataFrame) -> DataFrame:
    """Union by column name (missing columns become null)."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def unique(df: DataFrame, col: str) -> DataFrame:
    """Distinct values of a column."""
    return df.select(c(col)).distinct()
