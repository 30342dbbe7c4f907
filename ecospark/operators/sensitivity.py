"""Species-sensitivity summary per chemical.

Shape of the flagship plan: one hash aggregate on (chemical, species) with map-side partial
aggregation, a window count over the already reduced (chemical, species) rows, a left join for the
molar mass, then a pivot grouped on the chemical key (no further shuffle: the data is already
clustered on it). A chemical holding a third of all records is folded by the partial aggregate
before any shuffle, so no task ever sees more than one row per (chemical, species) and map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ecospark.functions.cols import c, safe_name


def p_endpoint(conc: Column | str, mw: Column | str, scale: float = 1000.0) -> Column:
    """``-log10(conc / mw * scale)``; null when the argument is not positive or undefined (Q2)."""
    conc = c(conc) if isinstance(conc, str) else conc
    mw = c(mw) if isinstance(mw, str) else mw
    x = F.try_divide(conc, mw) * F.lit(scale)
    return F.when(x > 0, -F.log10(x))


def eligible(df: DataFrame, chem: str, species: str, k: int = 3) -> DataFrame:
    """Rows of chemicals tested on at least ``k`` distinct (non-null) species groups."""
    keys = (
        df.filter(c(species).isNotNull())
        .groupBy(c(chem))
        .agg(F.count_distinct(c(species)).alias("_n"))
        .filter(F.col("_n") >= k)
        .select(c(chem))
    )
    return df.join(keys, on=chem, how="left_semi")


def most_sensitive(df: DataFrame, chem: str, species: str, conc: str, order: Sequence[str] = ()) -> DataFrame:
    """Per (chemical, species), the whole row with the minimum concentration; ties broken by
    ``order`` (Q8). Null keys and null concentrations are excluded, as ``groupby().idxmin()`` does.

    ``min(struct(conc, *order, *rest))`` is an ordinary aggregate, so Spark combines it map-side."""
    rest = [n for n in df.columns if n not in {chem, species, conc, *order}]
    fields = [conc, *order, *rest]
    packed = F.struct(*[c(n).alias(f"f{i}") for i, n in enumerate(fields)])
    best = (
        df.filter(c(chem).isNotNull() & c(species).isNotNull() & c(conc).isNotNull())
        .groupBy(c(chem), c(species))
        .agg(F.min(packed).alias("_m"))
    )
    return best.select(c(chem), c(species), *[F.col(f"_m.f{i}").alias(n) for i, n in enumerate(fields)]).select(
        *[c(n) for n in df.columns]
    )


def most_sensitive_eligible(
    df: DataFrame, chem: str, species: str, conc: str, order: Sequence[str] = (), k: int = 3
) -> DataFrame:
    """G5 + G6 fused: the minimum row per (chemical, species) for chemicals with >= k species.

    One partial/final hash aggregate on (chemical, species) keeps a row per group *including*
    groups whose concentrations are all null (they count for eligibility, as ``nunique`` does);
    the species count is then a window over those few rows per chemical."""
    rest = [n for n in df.columns if n not in {chem, species, conc, *order}]
    fields = [conc, *order, *rest]
    if len(fields) == 1:
        # only the minimum itself is needed: a fixed-width buffer, so Spark uses a hash aggregate
        packed = c(conc)
    else:
        packed = F.when(c(conc).isNotNull(), F.struct(*[c(n).alias(f"f{i}") for i, n in enumerate(fields)]))
    per_group = (
        df.filter(c(chem).isNotNull() & c(species).isNotNull())
        .groupBy(c(chem), c(species))
        .agg(F.min(packed).alias("_m"))
        .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(c(chem))))
        .filter((F.col("_n") >= k) & F.col("_m").isNotNull())
    )
    if len(fields) == 1:
        return per_group.select(c(chem), c(species), F.col("_m").alias(conc)).select(*[c(n) for n in df.columns])
    return per_group.select(c(chem), c(species), *[F.col(f"_m.f{i}").alias(n) for i, n in enumerate(fields)]).select(
        *[c(n) for n in df.columns]
    )


def pivot(
    df: DataFrame,
    index: Sequence[str],
    species: str,
    value: str,
    values: Sequence[str],
    prefix: str = "p_",
    names: Sequence[str] | None = None,
) -> DataFrame:
    """One row per index tuple, one column per declared species value (``aggfunc='first'``).

    Like ``pivot_table`` it drops rows with a null index key and rows whose cells are all null.
    The value list is always passed, so the schema never depends on the data."""
    names = list(names) if names else [safe_name(v, prefix) for v in values]
    keyed = df.filter(_all_not_null(index))
    out = keyed.groupBy(*[c(i) for i in index]).agg(
        *[F.first(F.when(c(species) == F.lit(v), c(value)), ignorenulls=True).alias(n) for v, n in zip(values, names)]
    )
    return out.filter(_any_not_null(names))


def _all_not_null(names: Sequence[str]) -> Column:
    cond = F.lit(True)
    for n in names:
        cond = cond & c(n).isNotNull()
    return cond


def _any_not_null(names: Sequence[str]) -> Column:
    cond = F.lit(False)
    for n in names:
        cond = cond | c(n).isNotNull()
    return cond


def mean_sd(df: DataFrame, cols: Sequence[str], mean: str = "p_mean", sd: str = "p_sd") -> DataFrame:
    """Row-wise mean and sample SD over fixed columns, null counted as 0 (n = len(cols))."""
    xs = [F.coalesce(c(n).cast("double"), F.lit(0.0)) for n in cols]
    n = len(cols)
    m = sum(xs[1:], xs[0]) / F.lit(float(n))
    out = df.withColumn(mean, m)
    dev = [(x - F.col(mean)) * (x - F.col(mean)) for x in xs]
    return out.withColumn(sd, F.sqrt(sum(dev[1:], dev[0]) / F.lit(float(n - 1))) if n > 1 else F.lit(None).cast("double"))


def consistent(df: DataFrame, keys: Sequence[str], conc: str, max_ratio: float = 3.0) -> DataFrame:
    """G21 (documented rule, never coded in the reference): drop groups whose max/min ratio of the
    concentration exceeds ``max_ratio``. Groups with a non-positive minimum are dropped too."""
    bad = (
        df.groupBy(*[c(k) for k in keys])
        .agg((F.max(c(conc)) / F.min(c(conc))).alias("_r"), F.min(c(conc)).alias("_lo"))
        .filter((F.col("_lo") <= 0) | (F.col("_r") > max_ratio))
        .select(*[c(k) for k in keys])
    )
    return df.join(bad, on=list(keys), how="left_anti")


def summary(
    records: DataFrame,
    masses: DataFrame,
    chem: str,
    name: str,
    species: str,
    conc: str,
    mass_key: str,
    mass: str,
    species_values: Sequence[str],
    order: Sequence[str] = (),
    k: int = 3,
    scale: float = 1000.0,
    prefix: str = "p_",
    names: Sequence[str] | None = None,
) -> DataFrame:
    """Flagship: eligible chemicals -> most sensitive record per species -> molar mass -> p(Endpoint)
    -> pivot -> mean/SD. ``masses`` holds ``(mass_key, name, mass)``; it is joined, not broadcast
    blindly: AQE turns the join into a broadcast when the measured side is small."""
    # ties on the minimum do not change p(Endpoint), so the tie-break columns need not travel
    best = most_sensitive_eligible(records.select(chem, species, conc), chem, species, conc, (), k)
    m = masses.select(c(mass_key).alias(chem), c(name), c(mass))
    with_p = best.join(m, on=chem, how="left").withColumn("_p", p_endpoint(c(conc), c(mass), scale))
    names = list(names) if names else [safe_name(v, prefix) for v in species_values]
    wide = pivot(with_p, [chem, name], species, "_p", species_values, names=names)
    return mean_sd(wide, names, mean=f"{prefix}mean", sd=f"{prefix}sd")
