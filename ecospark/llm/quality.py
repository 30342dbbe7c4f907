"""Quality rules (operator 2): base rules, then robust multivariate outliers per language and source.

Each document becomes a vector of transformed statistics (``FEATURES``). Per (lang, source) group a
minimum-covariance-determinant estimate of centre and scatter is computed by concentration steps: take the half of the
group's documents with the smallest Mahalanobis distances, use their mean and covariance, and again, until the
determinant of no group falls any more. Every group is started three times (from coordinatewise medians and spreads,
from all its documents, and from the half nearest to the median in the scaled features) and keeps the estimate with the
smallest determinant. A step is one grouped aggregate of moments, folded in every task, after a look-up of the group's
model row, so a group with a third of all rows is no hot key. Every document takes part. A document is rejected when
its squared distance, under the consistency-corrected estimate, exceeds the chi-square quantile ``TAIL``.

The estimate uses the documents that pass the base rules. Groups of fewer than ``LEAST`` of them (five for each feature,
the usual least for this estimate) are estimated together as one group. The scatter is at least that of the floors in every
direction: a statistic that is constant in most documents (no repeated line, no symbol) then has a scale, and
where documents vary more than that, the floor has no part in the verdict. In features with a bad side only deviations to that
side count against a document.

Null texts have no words and fail the base rules; very long texts are read whole; null ``lang`` or ``source`` forms a group like any other value;
repeated rows count as often as they occur; ties in distance at the half's edge are all taken. Missing columns
``lang`` or ``source`` read as null; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ecospark.llm.stats import FIELDS, text_stats
from ecospark.llm.tables import column, slices, small, small_batches, stored

#: name -> (expression over the statistics, least spread, side: -1 low values are bad, 1 high ones, 0 both)
FEATURES: dict[str, tuple[str, float, int]] = {
    "word_length": ("ln(word_chars / n_words)", 0.04, 0),
    "symbols": ("sqrt(n_symbols / word_chars)", 0.02, 1),
    "dup_lines": ("sqrt(n_dup_lines * 10 / (n_words + 10))", 0.1, 1),
    "repeat_words": ("asin(sqrt(n_repeat_words / n_words))", 0.12, 1),
}
NAMES = list(FEATURES)
P = len(NAMES)
STEPS = 30
LEAST = 5 * P
STARTS = 3
#: chi-square quantile for 4 degrees of freedom at 1 - 1e-6
TAIL = 33.38
#: the covariance of the nearer half of a normal sample of 4 dimensions is this much too small
CONSISTENCY = 0.5 / 0.2347


def statistics(docs: DataFrame, text_col: str = "text", keep: dict[str, str] | None = None) -> DataFrame:
    """Columns ``keep`` (name -> type) and the statistics of every whole text."""
    keep = keep or {"doc_id": "long", "lang": "string", "source": "string"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            rows = np.array([text_stats(t) for t in b.column(len(keep)).to_pylist()], dtype=np.int64).reshape(-1, len(FIELDS))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *(pa.array(rows[:, i]) for i in range(len(FIELDS)))],
                                             names=[*keep, *FIELDS])

    rows = small_batches(docs).select(*[column(docs, n, t) for n, t in keep.items()], column(docs, text_col, "string").alias("_text"))
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], *[T.StructField(f, T.LongType()) for f in FIELDS]]))


def base_failed() -> Column:
    return F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")


def features(stats: DataFrame) -> DataFrame:
    """Adds the vector; a text without words is the zero vector (it fails the base rules anyway)."""
    return stats.withColumns({f"x_{n}": F.when(F.col("n_words") > 0, F.expr(e).cast("double")).otherwise(0.0) for n, (e, _, _) in FEATURES.items()})


def _moments() -> list[Column]:
    out = [F.count(F.lit(1)).alias("m")]
    out += [F.avg(f"x_{a}").alias(f"mu_{i}") for i, a in enumerate(NAMES)]
    return out + [F.covar_pop(f"x_{NAMES[i]}", f"x_{NAMES[j]}").alias(f"c_{i}_{j}") for i, j in UPPER]


UPPER = [(i, j) for i in range(P) for j in range(i, P)]
MEANS = [f"mu_{i}" for i in range(P)]
WEIGHTS = [f"w_{i}_{j}" for i in range(P) for j in range(P)]


def at_least(cov: np.ndarray) -> np.ndarray:
    """Covariances (groups x P x P) whose variance is, in units of the floors, at least one in every direction."""
    floor = np.array([f for _, f, _ in FEATURES.values()])
    unit = cov / floor[:, None] / floor
    value, vector = np.linalg.eigh(unit)
    return np.einsum("gik,gk,gjk->gij", vector, np.maximum(value, 1.0), vector) * floor[:, None] * floor


def _model(rows: DataFrame, factor: float) -> DataFrame:
    """Per group and start: centre ``mu_i``, inverse scatter ``w_i_j`` and log-determinant ``det``, with ``factor`` on the
    covariances and variances of at least the floors. One row each; the inverses of P x P matrices are a helper in
    the tasks."""

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cov = np.zeros((b.num_rows, P, P))
            for i, j in UPPER:
                cov[:, i, j] = cov[:, j, i] = factor * np.nan_to_num(b.column(f"c_{i}_{j}").to_numpy(zero_copy_only=False).astype(float))
            cov = at_least(cov)
            inverse = np.linalg.inv(cov).reshape(-1, P * P)
            yield pa.RecordBatch.from_arrays([b.column("grp"), b.column("start"), *(b.column(n) for n in MEANS), pa.array(np.linalg.slogdet(cov)[1]),
                                              *(pa.array(np.ascontiguousarray(w)) for w in inverse.T)], names=["grp", "start", *MEANS, "det", *WEIGHTS])

    return rows.select("grp", "start", *MEANS, *[f"c_{i}_{j}" for i, j in UPPER]).mapInArrow(
        invert, "grp string, start int, " + ", ".join(f"{n} double" for n in [*MEANS, "det", *WEIGHTS]))


def _distance(sided: bool = False) -> Column:
    """Squared Mahalanobis distance; ``sided``: of the vector moved to the centre in the features that deviate to their
    good side."""
    diff = []
    for i, (n, (_, _, side)) in enumerate(FEATURES.items()):
        d = F.col(f"x_{n}") - F.col(f"mu_{i}")
        diff.append(F.greatest(d * side, F.lit(0.0)) * side if sided and side else d)
    return sum((diff[i] * diff[j] * F.col(f"w_{i}_{j}") for i in range(P) for j in range(P)), F.lit(0.0))


def _grouped(stats: DataFrame, sizes: DataFrame) -> DataFrame:
    """Adds ``grp``: the (lang, source) pair, or the empty string for the small groups."""
    return (stats.withColumn("_key", F.to_json(F.struct("lang", "source"))).join(small(sizes), "_key", "left")
            .withColumn("grp", F.when(F.col("_n") >= LEAST, F.col("_key")).otherwise("")).drop("_key", "_n"))


def fit(stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Minimum-covariance-determinant models ``(grp, mu, det, w)`` and the group sizes that assign a document's group,
    from a written table of statistics."""
    good = stats.filter(~base_failed())
    sizes = stored(good.groupBy(F.to_json(F.struct("lang", "source")).alias("_key")).agg(F.count(F.lit(1)).alias("_n")))
    x = stored(features(_grouped(good, sizes)).select("grp", *[f"x_{n}" for n in NAMES]))
    middle = x.groupBy("grp").agg(*[F.percentile_approx(f"x_{n}", F.array(*map(F.lit, (0.25, 0.5, 0.75))), 2000).alias(f"q_{i}")
                                    for i, n in enumerate(NAMES)])
    spread = lambda i: (F.col(f"q_{i}")[2] - F.col(f"q_{i}")[0]) / 1.349
    plain = stored(middle.select("grp", F.lit(0).alias("start"), *[F.col(f"q_{i}")[1].alias(f"mu_{i}") for i in range(P)], *[
        (F.pow(spread(i), F.lit(2.0)) if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i, j in UPPER]))
    # the nearer half to the median, each feature in units of its spread (the floor where that is none)
    scaled = [F.pow((F.col(f"x_{n}") - F.col(f"mu_{i}")) / F.greatest(F.sqrt(f"c_{i}_{i}"), F.lit(FEATURES[n][1])), F.lit(2.0)) for i, n in enumerate(NAMES)]
    d = x.join(small(plain), "grp").select("grp", *[f"x_{n}" for n in NAMES], sum(scaled, F.lit(0.0)).alias("_d"))
    nearer = _half(d, ["grp"]).groupBy("grp").agg(*_moments()).withColumn("start", F.lit(2))
    every = x.groupBy("grp").agg(*_moments()).withColumn("start", F.lit(1))
    first = _model(plain, 1.0).unionByName(_model(every, 1.0)).unionByName(_model(nearer, CONSISTENCY))
    model, key = stored(first), ["grp", "start"]
    starts = x.withColumn("start", F.explode(F.array(*[F.lit(k) for k in range(STARTS)])))
    for _ in range(STEPS):
        d = starts.join(small(model), key).select(*key, *[f"x_{n}" for n in NAMES], _distance().alias("_d"))
        new = stored(_model(_half(d, key).groupBy(*key).agg(*_moments()), CONSISTENCY))
        fell = new.join(small(model.select(*key, F.col("det").alias("_before"))), key).agg(F.max(F.col("_before") - F.col("det"))).first()[0]
        model = new
        if fell is None or fell <= 1e-6:
            break
    best = model.groupBy("grp").agg(F.min(F.struct("det", "start")).alias("_b")).select("grp", F.col("_b.start").alias("start"))
    return stored(model.join(small(stored(best)), key).drop("start")), sizes


def _half(d: DataFrame, key: list[str]) -> DataFrame:
    """The rows of each group up to the median of ``_d`` (ties at it are all taken)."""
    half = stored(d.groupBy(*key).agg(F.percentile_approx("_d", 0.5, 5000).alias("_half")))
    return d.join(small(half), key).filter(F.col("_d") <= F.col("_half"))


def verdicts(stats: DataFrame, model: DataFrame, sizes: DataFrame) -> DataFrame:
    """Adds ``base_failed``, ``distance`` (squared, null if there is no model) and ``kept``."""
    joined = features(_grouped(stats, sizes)).join(small(model), "grp", "left")
    out = joined.select(*stats.columns, base_failed().alias("base_failed"), _distance(sided=True).alias("distance"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= TAIL))


def quality(docs: DataFrame) -> DataFrame:
    """``(doc_id, lang, source, statistics, base_failed, distance, kept)`` of every document."""
    stats = stored(statistics(docs))
    return verdicts(stats, *fit(stats))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, all columns as they are. The statistics are computed once for the estimate and
    once beside the rows, so no join by id is needed and repeated rows and null ids stay what they are."""
    model, sizes = fit(stored(statistics(docs)))
    rows = docs.select(F.struct("*").alias("_row"), column(docs, "lang", "string"), column(docs, "source", "string"),
                       column(docs, "text", "string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            stats = np.array([text_stats(t) for t in b.column(3).to_pylist()], dtype=np.int64).reshape(-1, len(FIELDS))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(stats[:, i]) for i in range(len(FIELDS)))],
                                             names=["_row", "lang", "source", *FIELDS])

    schema = T.StructType([*rows.schema.fields[:3], *[T.StructField(f, T.LongType()) for f in FIELDS]])
    stats = rows.mapInArrow(run, schema)
    return verdicts(stats, model, sizes).filter("kept").select("_row.*")
