"""Joins. Spark picks the strategy: AQE turns a sort-merge join into a
broadcast join when the *measured* side is under ``spark.sql.adaptive.autoBroadcastJoinThreshold``.
We hint ``broadcast`` only for sides that are counted to be small."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ecospark.functions.cols import c
from ecospark.session import cut_lineage


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def left(a: DataFrame, b: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Left equi-join (rows of ``a`` repeat per matching ``b`` row)."""
    return a.join(b, on=_keys(key), how="left")


#: rows of a lookup table that may be broadcast
BROADCAST_ROWS = 100_000


def lookup(df: DataFrame, small: DataFrame, key: str | Sequence[str], bounded: bool = False) -> DataFrame:
    """Dictionary lookup as a left join. ``bounded=True`` says that ``small`` is meant to be a small table (e.g. a
    literal rule table): it is broadcast if it is counted to hold at most ``BROADCAST_ROWS`` rows, else joined like
    any other table. By default AQE decides from runtime size."""
    hint = bounded and small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(small) if hint else small, on=_keys(key), how="left")


def left_coalescing(a: DataFrame, b: DataFrame, key: str | Sequence[str], suffix: str = "_dup") -> DataFrame:
    """Left join; for a column present on both sides keep ``a``'s unless it is null in every
    row of ``a``, then take ``b``'s; then drop duplicate rows (as the reference does).

    One aggregate finds the all-null overlapping columns of ``a`` (a bounded result, one flag per column). Duplicates go
    before the join, from either side's remaining columns: all of them are in a joined row, so two joined rows are equal only
    if both their sides are, and the join's output needs no shuffle. Rows of a key with many of them on both sides are cut
    into pieces that meet pairwise, so that no task joins a whole hot key."""
    keys = _keys(key)
    overlap = [x for x in b.columns if x in a.columns and x not in keys]
    flags = a.agg(*[F.count(c(x)).alias(f"n{i}") for i, x in enumerate(overlap)]).first() if overlap else None
    take_b = {x for i, x in enumerate(overlap) if flags[f"n{i}"] == 0}
    left_side = a.select(*[c(x) for x in a.columns if x not in take_b]).distinct()
    right_side = b.select(*[c(x) for x in b.columns if x in keys or x in take_b or x not in a.columns]).distinct()
    cols = [*a.columns, *[x for x in b.columns if x not in a.columns]]
    return _join_in_pieces(left_side, right_side, keys).select(*[c(x) for x in cols])


#: rows of a hot key on either side of a join that meet in one piece
PIECE = 2000


def _join_in_pieces(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of two tables of distinct rows. The rows of keys with over ``PIECE`` squared joined rows are cut into pieces by a
    hash on both sides, and every piece of one meets every piece of the other under a key of its own."""
    on = [c(k) for k in keys]
    sizes = a.groupBy(*on).agg(F.count(F.lit(1)).alias("_na")).join(b.groupBy(*on).agg(F.count(F.lit(1)).alias("_nb")), keys)
    pieces = lambda n: F.ceil(c(n) / PIECE).cast("long")
    hot = cut_lineage(sizes.filter(F.col("_na").cast("double") * F.col("_nb") > float(PIECE) ** 2)
                      .select(*on, (F.col("_na") + F.col("_nb")).alias("_n"), pieces("_na").alias("_ga"), pieces("_nb").alias("_gb")))
    total = hot.agg(F.sum(F.col("_ga") * F.col("_gb")).alias("n")).first()["n"]
    if not total:
        return a.join(b, keys, "left")

    def cut(df: DataFrame, own: str, other: str) -> DataFrame:
        of = {"_xa": "_ga", "_xb": "_gb"}
        rows = counted_lookup(df, hot, keys, "_n").filter("_n IS NOT NULL").withColumn(own, F.pmod(F.xxhash64(*[c(x) for x in df.columns]), c(of[own])))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), c(of[other]) - 1))).select(*[c(x) for x in df.columns], "_xa", "_xb")

    # a partition count of its own: the work of a piece is its joined rows, not its bytes
    parts = min(4096, max(2 * int(total), int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    meet = [*keys, "_xa", "_xb"]
    pa, pb = (x.repartition(parts, *[c(k) for k in meet]) for x in (cut(a, "_xa", "_xb"), cut(b, "_xb", "_xa")))
    names = hot.select(*on)
    rest = a.join(names, keys, "left_anti").join(b.join(names, keys, "left_anti"), keys, "left")
    return pa.join(pb, meet).drop("_xa", "_xb").unionByName(rest)


def star(base: DataFrame, others: Sequence[DataFrame], key: str | Sequence[str]) -> DataFrame:
    """Chained left joins of feature tables onto a base table (sides pre-deduplicated)."""
    out = base
    for o in others:
        out = out.join(o, on=_keys(key), how="left")
    return out


def left_distinct(a: DataFrame, b: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Left join then exact row dedup."""
    return a.join(b, on=_keys(key), how="left").distinct()


def first_per_key(df: DataFrame, key: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    """C2 helper: the first row per key in ``order`` (ascending, nulls first like a sort).

    An aggregate ``min(struct(order..., rest...))`` rather than a ranking window: it combines
    map-side, so a key holding a third of all rows is reduced in every task before the shuffle
    instead of being sorted by one task. Remaining ties are broken by the other columns."""
    keys = _keys(key)
    rest = [x for x in df.columns if x not in keys and x not in order]
    fields = [*order, *rest]
    packed = F.struct(*[c(x).alias(f"f{i}") for i, x in enumerate(fields)])
    best = df.groupBy(*[c(k) for k in keys]).agg(F.min(packed).alias("_m"))
    return best.select(*[c(k) for k in keys], *[F.col(f"_m.f{i}").alias(x) for i, x in enumerate(fields)]).select(
        *[c(x) for x in df.columns])


def left_first(a: DataFrame, b: DataFrame, key: str | Sequence[str], order: Sequence[str],
               require: Sequence[str] = ()) -> DataFrame:
    """Dedup ``b`` to its first row per key, left join, then drop rows missing ``require``."""
    out = a.join(first_per_key(b, key, order), on=_keys(key), how="left")
    return out.dropna(subset=list(require)) if require else out


def semi(df: DataFrame, keys: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Rows whose key is in a computed key set."""
    return df.join(keys, on=_keys(key), how="left_semi")


def anti(df: DataFrame, other: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Rows whose key is absent from ``other``."""
    return df.join(other, on=_keys(key), how="left_anti")


def chain(base: DataFrame, steps: Sequence[tuple[DataFrame, str | Sequence[str]]]) -> DataFrame:
    """J3 with per-table keys: left-join each ``(table, key)`` in turn."""
    out = base
    for o, k in steps:
        out = out.join(o, on=_keys(k), how="left")
    return out


# ---------------------------------------------------------------- hot keys

def counted_lookup(rows: DataFrame, side: DataFrame, on: Sequence[str], weight: str, limit: int | None = None) -> DataFrame:
    """``rows`` left-joined to ``side`` (one row per key; its column ``weight`` counts the rows of that key) without a hot
    task: a side counted to hold at most ``limit`` rows is broadcast; of a larger one only the heaviest keys are (those
    over 1/100,000 of all rows and 10,000 rows: 100,000 keys at most, whatever the data), while the others are
    shuffled. ``side`` should be materialised (it is counted first); with a large side ``rows`` is read twice. Null keys
    find nothing, as in any join."""
    on = list(on)
    n, total = side.agg(F.count(F.lit(1)), F.sum(c(weight))).first()
    if n <= (BROADCAST_ROWS if limit is None else limit):
        return rows.join(F.broadcast(side), on, "left")
    heavy = c(weight) > F.lit(max(10_000, int(total) // 100_000))
    hot, cold = side.filter(heavy), side.filter(~heavy)
    at_hot = rows.join(F.broadcast(hot), on)
    rest = rows.join(F.broadcast(hot.select(*[c(x) for x in on])), on, "left_anti").join(cold, on, "left")
    return at_hot.unionByName(rest)
