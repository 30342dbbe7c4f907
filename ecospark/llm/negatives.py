"""Operator 13: hard-negative mining by length buckets and sorted coordinate lists.

An anchor's positives are the rows of its label with the largest inner products; for each positive, its hard negatives are
the best rows of other labels whose product lies in a given share of the positive's. Both are searches for large inner
products, pruned by coordinates:

* The rows are written once, range-partitioned and sorted by (label, length descending, id), so a label that holds a
  third of all rows spans many partitions. A task cuts its rows into buckets of one label and of lengths within a tenth.
* A product of ``theta`` needs a cosine of ``theta / (|anchor| * longest row)`` in a bucket. That bounds every
  coordinate of the unit vector: with angle ``a`` between anchor and axis and ``b`` the largest angle to the anchor, the
  row's angle to the axis lies in ``[a - b, a + b]``. For the anchor's focus coordinates (the largest ones) these ranges
  are looked up in the bucket's sorted coordinate lists; a bucket with an empty range is skipped, else the shortest run
  is intersected with the others.
* What is left is verified by its exact integer product. ``theta`` is the anchor's least useful product: the last of
  the best so far in this task, and for negatives at least the positives' lower limit.

Anchors go through in chunks of bounded bytes, each broadcast (``ANCHOR_BYTES``), against all rows in blocks; a task
returns its best few per anchor, so what is shuffled doesn't grow with buckets or copies of a vector.

Rows: those with a null label, null vector, null or non-finite component or null id take no part. One row speaks for an
id: of rows with the same id the one with the smallest (label, vector); full repeats count once. Vectors of different
lengths are compared as if the shorter one went on with zeros; an empty or zero vector has product 0 with any. Ties in
score go to the smaller id. Components are limited to +-2^62 after scaling and scores to a long; products are exact (in
doubles, longs or Python's integers, by size). Texts play no part; extra columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ecospark.functions.cols import c
from ecospark.llm.tables import stored

#: bytes of anchor components in one broadcast
ANCHOR_BYTES = 16_000_000
#: rows in a bucket, and the share of its longest row's length that its shortest one has at least
BUCKET_ROWS, BUCKET_LENGTH = 2048, 0.9
#: coordinates of an anchor whose ranges are intersected
FOCUS = 5
#: slack of the pruning bounds, far above the rounding of unit vectors
SLACK = 1e-9
LIMIT = 1 << 62

_POSITIVES = "anchor_id long, other_id long, score long"
_NEGATIVES = "anchor_id long, positive_id long, positive_score long, other_id long, score long"


@dataclass
class Anchors:
    """A chunk of anchors: ids, labels, exact components, lengths, focus coordinates and their angles."""

    ids: np.ndarray
    labels: np.ndarray
    exact: np.ndarray
    length: np.ndarray
    focus: np.ndarray
    angle: np.ndarray

    @classmethod
    def of(cls, ids: list[int], labels: list[int], vectors: np.ndarray) -> Anchors:
        wide = vectors.astype(np.float64)
        length = np.sqrt((wide * wide).sum(axis=1))
        unit = wide / np.where(length > 0, length, 1)[:, None]
        focus = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :FOCUS]
        angle = np.arccos(np.clip(np.take_along_axis(unit, focus, axis=1), -1, 1))
        return cls(np.array(ids, np.int64), np.array(labels, np.int64), vectors, length, focus, angle)


class Bucket:
    """Rows of one label and similar lengths, longest first, with sorted lists of their unit vectors' coordinates."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.exact = ids, vectors
        wide = vectors.astype(np.float64)
        length = np.sqrt((wide * wide).sum(axis=1))
        self.longest, self.shortest = float(length.max()), float(length.min())
        self.unit = wide / np.where(length > 0, length, 1)[:, None]
        self.order = np.argsort(self.unit, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.unit, self.order, axis=0)

    def candidates(self, anchors: Anchors, asked: np.ndarray, theta: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(anchor, places of the rows that may reach its ``theta``) for the anchors at ``asked``; none if none can."""
        reach = anchors.length[asked]
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(theta > 0, theta / (reach * self.longest), theta / (reach * self.shortest))
        local = np.where(np.isnan(local), np.where(theta > 0, np.inf, -1.0), local)  # 0 / 0 and infinities
        near = local <= 1 + SLACK
        if not near.any():
            return
        asked, local = asked[near], np.clip(local[near], -1, 1)
        spread = np.arccos(local)[:, None]
        angle, focus = anchors.angle[asked], anchors.focus[asked]
        low = np.cos(np.minimum(np.pi, angle + spread)) - SLACK
        high = np.cos(np.maximum(0.0, angle - spread)) + SLACK
        free = (local <= -1)[:, None] | ~(reach[near] > 0)[:, None] | (self.shortest <= 0)  # no direction to prune by
        low, high = np.where(free, -np.inf, low), np.where(free, np.inf, high)
        begin, end = np.zeros(focus.shape, np.int64), np.zeros(focus.shape, np.int64)
        for f in np.unique(focus):
            at = focus == f
            begin[at] = np.searchsorted(self.sorted[:, f], low[at], "left")
            end[at] = np.searchsorted(self.sorted[:, f], high[at], "right")
        some = (begin < end).all(axis=1) if focus.shape[1] else np.ones(len(asked), bool)
        for i in np.flatnonzero(some):
            if not focus.shape[1]:
                yield int(asked[i]), np.arange(len(self.ids))
                continue
            k = int(np.argmin(end[i] - begin[i]))
            found = self.order[begin[i, k] : end[i, k], focus[i, k]]
            for j in range(focus.shape[1]):
                if j != k and end[i, j] - begin[i, j] < len(self.ids):
                    x = self.unit[found, focus[i, j]]
                    found = found[(x >= low[i, j]) & (x <= high[i, j])]
            if len(found):
                yield int(asked[i]), found


def _vectors(arrays: pa.Array, width: int, kind: type) -> np.ndarray:
    """List column as a matrix of ``width`` columns, shorter vectors padded with zeros."""
    size = arrays.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(arrays), width), kind)
    out[np.repeat(np.arange(len(arrays)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = arrays.flatten().to_numpy(zero_copy_only=False)
    return out


def _buckets(batches: Iterator[pa.RecordBatch], width: int, kind: type) -> Iterator[tuple[int, Bucket]]:
    """(label, bucket) of rows that come sorted by label and falling length; a break in the order starts a bucket."""
    for batch in batches:
        labels, ids, length = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        vectors = _vectors(batch.column(3), width, kind)
        start = 0
        for i in range(1, len(ids) + 1):
            if i == len(ids) or i - start == BUCKET_ROWS or labels[i] != labels[start] or not BUCKET_LENGTH * length[start] <= length[i] <= length[start]:
                yield int(labels[start]), Bucket(ids[start:i], vectors[start:i])
                start = i


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` by score descending, then id."""
    at = np.arange(len(scores))
    if scores.dtype == object:  # Python's integers
        return np.array(sorted(at.tolist(), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    if len(scores) > 4 * k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _clip(x: int) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, x))


def _product(bucket: Bucket, found: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact products, limited to a long."""
    out = bucket.exact[found] @ q
    return np.array([_clip(x) for x in out], object) if out.dtype == object else out.astype(np.int64)


def positives(batches: Iterator[pa.RecordBatch], anchors: Anchors, k: int) -> Iterator[tuple[int, int, int]]:
    """This task's ``k`` best rows of each anchor's label, the anchor itself left out: (anchor, id, score)."""
    width, kind = anchors.exact.shape[1], anchors.exact.dtype
    best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    theta = np.full(len(anchors.ids), -np.inf)
    for label, bucket in _buckets(batches, width, kind):
        asked = np.flatnonzero(anchors.labels == label)
        for a, found in bucket.candidates(anchors, asked, theta[asked]):
            scores, ids = _product(bucket, found, anchors.exact[a]), bucket.ids[found]
            use = ids != anchors.ids[a]
            if a in best and len(best[a][0]) == k:
                use &= scores >= best[a][0][-1]
            scores, ids = scores[use], ids[use]
            if a in best:
                scores, ids = np.concatenate([best[a][0], scores]), np.concatenate([best[a][1], ids])
            at = _best(scores, ids, k)
            best[a] = scores[at], ids[at]
            if len(at) == k:
                theta[a] = float(scores[at[-1]]) if scores[at[-1]] > -(1 << 63) else -np.inf
    for a, (scores, ids) in best.items():
        for s, i in zip(scores.tolist(), ids.tolist(), strict=True):
            yield int(anchors.ids[a]), i, int(s)


def negatives(batches: Iterator[pa.RecordBatch], anchors: Anchors, given: dict[int, list[tuple[int, int]]], k: int, low: int, high: int,
              of: int) -> Iterator[tuple[int, int, int, int, int]]:
    """This task's ``k`` best rows of other labels for each anchor (by place) and positive (id, score) given, with products
    s of ``low * score <= of * s <= high * score``: (anchor, positive, its score, id, score)."""
    width, kind = anchors.exact.shape[1], anchors.exact.dtype
    window = {a: [(-(-low * p // of), high * p // of) for _, p in pos] for a, pos in given.items()}
    floor = {a: [lo for lo, _ in w] for a, w in window.items()}
    best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    need = lambda a: min((float(f) for f, (lo, hi) in zip(floor[a], window[a], strict=True) if lo <= hi), default=np.inf)
    theta = np.full(len(anchors.ids), np.inf)
    for a in given:
        theta[a] = need(a)
    for label, bucket in _buckets(batches, width, kind):
        asked = np.flatnonzero((anchors.labels != label) & (theta < np.inf))
        for a, found in bucket.candidates(anchors, asked, theta[asked]):
            scores, ids = _product(bucket, found, anchors.exact[a]), bucket.ids[found]
            for j, (_, hi) in enumerate(window[a]):
                use = (scores >= floor[a][j]) & (scores <= hi)
                if not use.any():
                    continue
                s, i = scores[use], ids[use]
                if (a, j) in best:
                    s, i = np.concatenate([best[a, j][0], s]), np.concatenate([best[a, j][1], i])
                at = _best(s, i, k)
                best[a, j] = s[at], i[at]
                if len(at) == k:
                    floor[a][j] = max(floor[a][j], int(s[at[-1]]))
            theta[a] = need(a)
    for (a, j), (scores, ids) in best.items():
        for s, i in zip(scores.tolist(), ids.tolist(), strict=True):
            yield int(anchors.ids[a]), given[a][j][0], given[a][j][1], i, int(s)


def _arrow(rows: Iterator[tuple], schema: T.StructType) -> Iterator[pa.RecordBatch]:
    names = schema.fieldNames()
    while True:
        block = [x for x, _ in zip(rows, range(20_000), strict=False)]
        if not block:
            return
        yield pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in zip(*block, strict=True)], names)


def usable(df: DataFrame, id: str = "vec_id", label: str = "label", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(label, id, length, v): the rows that take part, one per id, with components ``floor(scale * x)``."""
    finite = F.forall(c(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(c(vector), lambda x: F.floor(F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), x.cast("double") * scale))).cast("long"))
    rows = df.filter(c(id).isNotNull() & c(label).isNotNull() & c(vector).isNotNull() & finite).select(
        c(id).cast("long").alias("id"), F.struct(c(label).cast("long").alias("label"), whole.alias("v")).alias("row"))
    one = rows.groupBy("id").agg(F.min("row").alias("row")).select("row.label", "id", "row.v")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return one.select("label", "id", F.sqrt(square).alias("length"), "v")


def hard_negatives(df: DataFrame, anchor: Column, id: str = "vec_id", label: str = "label", vector: str = "embedding", scale: float = 256.0,
                   n_positives: int = 5, n_negatives: int = 5, low: int = 80, high: int = 100, of: int = 100) -> DataFrame:
    """For each row where ``anchor`` (a condition on the column ``id``) holds and each of its ``n_positives`` best rows of the same label,
    the first ``n_negatives`` rows of other labels with ``low * positive_score <= of * negative_score <= high * positive_score``:
    (anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col("label"), F.col("length").desc(), F.col("id")]
    rows = stored(usable(df, id, label, vector, scale).repartitionByRange(parts, *keys).sortWithinPartitions(*keys))
    extent = F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v")))
    width, most = rows.agg(F.max(F.size("v")), F.max(extent)).first()
    out_schema = T.StructType.fromDDL("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if width is None:
        return spark.createDataFrame([], out_schema)
    bound = (most or 0) ** 2 * max(1, width)
    kind = np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 62 else object
    asking = rows.filter(anchor)
    chunks = max(1, -(-asking.count() * max(1, width) * 8 // ANCHOR_BYTES))
    found, (p_schema, n_schema) = [], (T.StructType.fromDDL(x) for x in (_POSITIVES, _NEGATIVES))
    for chunk in range(chunks):
        mine = asking.filter(F.pmod(F.xxhash64("id"), F.lit(chunks)) == chunk).select("id", "label", "v").collect()  # ANCHOR_BYTES at most, about
        vectors = np.zeros((len(mine), width), kind)
        for i, r in enumerate(mine):
            vectors[i, : len(r["v"])] = r["v"]
        anchors = spark.sparkContext.broadcast(Anchors.of([r["id"] for r in mine], [r["label"] for r in mine], vectors))
        near = stored(_first(rows.mapInArrow(lambda b, x=anchors: _arrow(positives(b, x.value, n_positives), p_schema), p_schema),
                             ["anchor_id"], n_positives))
        place = {r["id"]: i for i, r in enumerate(mine)}
        given: dict[int, list[tuple[int, int]]] = {}
        for r in near.collect():  # n_positives rows for each anchor of the chunk
            given.setdefault(place[r["anchor_id"]], []).append((r["other_id"], r["score"]))
        pairs = spark.sparkContext.broadcast(given)
        far = rows.mapInArrow(lambda b, x=anchors, y=pairs: _arrow(negatives(b, x.value, y.value, n_negatives, low, high, of), n_schema), n_schema)
        found.append(stored(_first(far, ["anchor_id", "positive_id", "positive_score"], n_negatives)))
        anchors.unpersist()
        pairs.unpersist()
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _first(df: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first ``k`` rows per group by score, then id, out of the tasks' best (at most ``k`` per task and group)."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), "other_id"))
    return df.withColumn("rank", rank).filter(F.col("rank") <= k)
