"""Pairwise-complete moments of wide tables as blocked Gram sums (SURVEY G15, F6, F7 at the reference's width).

For columns i, j the rows where both are present give ``n``, the sums and sums of squares of both sides and the sum of
products. With missing values as zeros and a 0/1 indicator matrix these are products of two matrices, so every task folds
its rows, a slice at a time, into one set of square arrays; an indicator product is only needed against columns that
miss values in the slice. A task returns one row of arrays per column, however many rows it read; ``Summarizer`` adds
these per column (with map-side combine), and the pairs are read off the sums. No plan holds an expression per pair or
per column, and nothing is shuffled per input row.

Values are taken relative to a value of their own column (the median of a few first rows), which keeps the differences
of sums exact to rounding and a constant column exactly zero. Columns go in blocks of ``BLOCK``: a job reads two blocks at
most, so a task's arrays stay bounded (about 100 MB) however wide the table is.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ecospark.functions.cols import c

#: columns in a block, rows folded at once, and first rows that give a column its origin
BLOCK, SLICE, ORIGIN_ROWS = 512, 2048, 64
#: share of a sum of squares under which a variance is rounding noise
NOISE = 1e-13
#: per pair (i, j): rows, sum of i, of j, of i^2, of j^2, of i*j
PARTS = 6


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The batch as doubles, NaN where missing."""
    out = np.empty((batch.num_rows, batch.num_columns))
    for i, x in enumerate(batch.columns):
        out[:, i] = pa.compute.cast(x, pa.float64(), safe=False).to_numpy(zero_copy_only=False)
    return out


def _origins(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """For each column a value near its bulk: the median of its values in a few first rows (any value gives the same
    correlations; this one keeps rounding small), 0 if they are all missing."""
    head = df.select(*[c(x).cast("double") for x in cols]).limit(ORIGIN_ROWS).collect()
    out = np.zeros(len(cols))
    for i in range(len(cols)):
        values = sorted(r[i] for r in head if r[i] is not None and np.isfinite(r[i]))
        if values:
            out[i] = values[len(values) // 2]
    return out


def _fold(batches: Iterator[pa.RecordBatch], left: np.ndarray, right: np.ndarray, origin: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The task's sums: one row (i, PARTS x len(right) numbers) per left column."""
    sums = np.zeros((PARTS, len(left), len(right)))
    n, si, sj, qi, qj, p = sums
    seen = False
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            seen = True
            x = _matrix(batch.slice(start, SLICE)) - origin
            gaps = np.isnan(x)
            x[gaps] = 0.0
            a, b = x[:, left], x[:, right]
            square = x * x
            missing_a, missing_b = gaps[:, left].any(axis=0), gaps[:, right].any(axis=0)
            here_a, here_b = ~gaps[:, left], ~gaps[:, right]
            p += a.T @ b
            # against a column without gaps a pair's rows are the other side's own rows
            full_a, full_b = here_a.sum(axis=0), here_b.sum(axis=0)
            n += np.where(missing_b[None, :], 0, full_a[:, None])
            si += np.where(missing_b[None, :], 0, a.sum(axis=0)[:, None])
            qi += np.where(missing_b[None, :], 0, square[:, left].sum(axis=0)[:, None])
            sj += np.where(missing_a[:, None], 0, b.sum(axis=0)[None, :])
            qj += np.where(missing_a[:, None], 0, square[:, right].sum(axis=0)[None, :])
            if missing_b.any():
                m = here_b[:, missing_b].astype(np.float64)
                si[:, missing_b] += a.T @ m
                qi[:, missing_b] += square[:, left].T @ m
                n[:, missing_b] += here_a.T.astype(np.float64) @ m
            if missing_a.any():
                m = here_a[:, missing_a].astype(np.float64)
                sj[missing_a] += m.T @ b
                qj[missing_a] += m.T @ square[:, right]
    if seen:
        for start in range(0, len(left), 64):
            rows = sums[:, start : start + 64].transpose(1, 0, 2).reshape(-1, PARTS * len(right))
            lists = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], rows.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(start, start + len(rows), dtype=np.int32)), lists], ["i", "sums"])


def moments(df: DataFrame, left: Sequence[str], right: Sequence[str]) -> DataFrame:
    """(i, j, n, si, sj, qi, qj, p) over the rows where left column i and right column j are both present, values relative
    to their column's origin; one block of columns on either side at most."""
    names = list(dict.fromkeys([*left, *right]))
    at = {x: i for i, x in enumerate(names)}
    l, r = (np.array([at[x] for x in side], np.int64) for side in (left, right))
    origin = _origins(df, names)
    values = df.select(*[c(x).alias(f"c{i}") for i, x in enumerate(names)])
    with np.errstate(invalid="ignore", over="ignore"):
        folded = values.mapInArrow(lambda b: _fold(b, l, r, origin), "i int, sums array<double>")
    total = folded.groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("s"))
    w = len(right)
    part = lambda k, j: F.element_at("s", F.lit(k * w + 1) + j)
    out = total.select("i", "s", F.explode(F.sequence(F.lit(0), F.lit(w - 1))).alias("j"))
    return out.select("i", "j", *[part(k, F.col("j")).alias(x) for k, x in enumerate(["n", "si", "sj", "qi", "qj", "p"])])


def _r() -> Column:
    """Pearson r of a row of :func:`moments`; null without a spread on both sides, or with an infinity."""
    n = F.col("n")
    vi, vj = F.col("qi") - F.try_divide(F.col("si") * F.col("si"), n), F.col("qj") - F.try_divide(F.col("sj") * F.col("sj"), n)
    flat = (vi <= F.lit(NOISE) * F.col("qi")) | (vj <= F.lit(NOISE) * F.col("qj"))
    r = F.try_divide(F.col("p") - F.try_divide(F.col("si") * F.col("sj"), n), F.sqrt(vi) * F.sqrt(vj))
    return F.nanvl(F.when(~flat, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))), F.lit(None).cast("double"))


def _block_correlations(df: DataFrame, left: Sequence[str], right: Sequence[str], later_only: bool) -> DataFrame:
    found = moments(df, left, right)
    if later_only:
        found = found.filter(F.col("j") > F.col("i"))
    names = lambda side, k: F.element_at(F.array(*[F.lit(x) for x in side]), F.col(k) + 1)
    return found.select(names(left, "i").alias("a"), names(right, "j").alias("b"), _r().alias("r"))


def correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """r of every pair i < j of ``cols``: (a, b, r). A table without rows has no pairs."""
    blocks = [cols[k : k + BLOCK] for k in range(0, len(cols), BLOCK)]
    out = None
    for i, left in enumerate(blocks):
        for j in range(i, len(blocks)):
            one = _block_correlations(df, left, blocks[j], later_only=i == j)
            out = one if out is None else out.unionByName(one)
    return out if out is not None else df.sparkSession.createDataFrame([], "a string, b string, r double")


def correlations_of(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """r of the given pairs: (a, b, r). Computed per block of first by block of second columns."""
    spark = df.sparkSession
    firsts, seconds = (list(dict.fromkeys(p[k] for p in pairs)) for k in (0, 1))
    asked, out = set(pairs), None
    for i in range(0, len(firsts), BLOCK):
        for j in range(0, len(seconds), BLOCK):
            left, right = firsts[i : i + BLOCK], seconds[j : j + BLOCK]
            here = [(a, b) for a in left for b in right if (a, b) in asked]
            if not here:
                continue
            one = _block_correlations(df, left, right, later_only=False)
            if len(here) < len(left) * len(right):  # as many rows as the caller's own list of pairs
                one = one.join(F.broadcast(spark.createDataFrame(here, "a string, b string")), ["a", "b"], "left_semi")
            out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "a string, b string, r double")
