"""MinHash near-dedup (operator 1): SuperMinHash signatures, banding, exact verification, union into components.

*SuperMinHash.* Every element of a set draws, from its hash, a random permutation of the signature's places and one
random number per rank; the element with rank j at a place offers ``j + r`` there, and the signature keeps the
smallest offer. Ranks of one element are correlated (each place gets a different one), which lowers the variance
against independent hash functions, and ranks above the largest value kept so far can't change anything, so drawing
stops early. The elements of many texts are drawn together, rank by rank.

*Banding.* A signature is kept as one byte per place; bands of ``ROWS`` places are bucket keys. The number of bands
is derived from the threshold so that a pair at the threshold is missed with probability ``MISS``.

*No pair explosion.* Texts with equal shingle sets are one class. In every bucket only pairs with the bucket's
most central class (the one that meets most others over all bands) are verified first; that joins large groups of
near copies at linear cost. Then only buckets that still hold several components are looked at: their members outside
the largest component are compared, in blocks of bounded size inside the tasks, with all members; pairs inside one
component, pairs met in an earlier band and pairs whose estimate lies 4 standard deviations under the threshold are
passed over. No link that could join two components is left out (up to ``MISS``). Links count only when the full shingle sets confirm
them in integers.

Null texts and texts without a word have an empty set and are linked with nothing. Rows that repeat a doc_id are
rows of their own with equal results. Null ids take part, but a component is named by its smallest id that isn't
null; a row with a null id is kept only if its component has none. Extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ecospark.llm import words as W
from ecospark.llm.tables import column, lookup, slices, small, small_batches, stored
from ecospark.operators.dedup import connected_components

#: places of a signature; probability of missing a pair at the threshold
PLACES, MISS = 256, 1e-5
#: members of a bucket compared at once, and shingles they may hold together (expected)
BLOCK, BLOCK_SHINGLES = 256, 250_000
_U = np.uint64


def banding(t: float) -> tuple[int, int]:
    """(bands, rows): the most rows whose bands fit into the signature at the allowed miss."""
    for rows in range(6, 1, -1):
        bands = math.ceil(math.log(MISS) / math.log1p(-(t**rows)))
        if bands * rows <= PLACES * 5 // 8:
            return bands, rows
    return PLACES // 2, 2


# ---------------------------------------------------------------- sets and signatures of a batch


def sets(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``n``-word shingle hashes of all texts, ascending within each, and the bounds of each text's part."""
    raw = [W.text_bytes(t) for t in texts]
    size = np.array([len(x) for x in raw], dtype=np.int64)
    gap = np.array([0x0A], dtype=np.uint8)
    data = np.concatenate([y for x in raw for y in (x, gap)]) if raw else gap[:0]
    first = np.cumsum(size + 1) - size - 1
    start, end = W.word_spans(data)
    word, owner = W.span_hashes(data, start, end), np.searchsorted(first, start, side="right") - 1
    shingle = W.chain(word, n)
    whole = owner[: len(shingle)] == owner[n - 1 : n - 1 + len(shingle)] if len(shingle) else np.zeros(0, bool)
    shingle, of = shingle[whole], owner[: len(whole)][whole]
    count = np.bincount(owner, minlength=len(texts))
    place = np.cumsum(count) - count
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):  # the whole sequence is one shingle
        shingle = np.concatenate([shingle, *(W.chain(word[place[i] : place[i] + count[i]], int(count[i])) for i in short.tolist())])
        of = np.concatenate([of, short])
    order = np.argsort(shingle, kind="stable")
    order = order[np.argsort(of[order], kind="stable")]
    shingle, of = shingle[order], of[order]
    new = np.ones(len(shingle), dtype=bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (of[1:] != of[:-1])
    shingle, of = shingle[new], of[new]
    return shingle, np.searchsorted(of, np.arange(len(texts) + 1))


def _uniform(x: np.ndarray) -> np.ndarray:
    return (x >> _U(11)).astype(np.float64) * 2.0**-53


def signatures(shingle: np.ndarray, bound: np.ndarray, places: int = PLACES) -> np.ndarray:
    """SuperMinHash values, texts x places (infinite for empty sets)."""
    n = len(bound) - 1
    of = np.repeat(np.arange(n), np.diff(bound))
    out = np.full(n * places, np.inf)
    element, order = shingle, None
    for j in range(places):
        if j:
            open_ = out.reshape(n, places).max(axis=1) > j  # rank j offers at least j
            stay = open_[of]
            if not stay.any():
                break
            if not stay.all():
                element, of = element[stay], of[stay]
                order = order[stay]
        draw = W.mix(element + _U((2 * j + 1) * 0x9E3779B97F4A7C15 % 2**64))
        k = j + (_uniform(W.mix(draw + _U(0x632BE59BD9B4E019))) * (places - j)).astype(np.int64)
        if order is None:  # the permutation so far: the identity with places 0 and k swapped
            at = k
            np.minimum.at(out, of * places + at, _uniform(draw) + j)
            stay = (out.reshape(n, places).max(axis=1) > 1)[of]
            element, of, k = element[stay], of[stay], k[stay]
            order = np.tile(np.arange(places, dtype=np.uint8), (len(element), 1))
            order[np.arange(len(k)), k] = 0
            order[:, 0] = k
            continue
        row = np.arange(len(element))
        at = order[row, k].astype(np.int64)
        order[row, k] = order[:, j]
        order[:, j] = at
        np.minimum.at(out, of * places + at, _uniform(draw) + j)
    return out.reshape(n, places)


def _bytes_of(values: np.ndarray) -> np.ndarray:
    return (W.mix(values.view(_U)) >> _U(56)).astype(np.uint8)


def _names(shingle: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """64-bit names of the sets: equal sets have equal names."""
    total = np.concatenate([np.zeros(1, _U), np.cumsum(W.mix(shingle + _U(0xA0761D6478BD642F)))])
    size = np.diff(bound)
    return W.mix(total[bound[1:]] - total[bound[:-1]] + size.astype(_U) * _U(0xE7037ED1A0B428DB)).view(np.int64)


def signed(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n, cls, sig)`` of every row: set size, name of the set, signature bytes (null for empty sets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1_000_000):
            shingle, bound = sets(b.column(1).to_pylist(), n)
            size, sig = np.diff(bound), _bytes_of(signatures(shingle, bound))
            none = size == 0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), pa.array(_names(shingle, bound), mask=none),
                                              pa.array([s.tobytes() for s in sig], pa.binary(), mask=none)], names=["id", "n", "cls", "sig"])

    return small_batches(docs).select(column(docs, id_col, "long").alias("id"), column(docs, text_col, "string").alias("text")).mapInArrow(
        run, "id long, n long, cls long, sig binary")


def full_sets(docs: DataFrame, classes: DataFrame, n: int, text_col: str = "text") -> DataFrame:
    """``(cls, members)``: the full sets of ``classes``, once each, as sorted little-endian 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1_000_000):
            shingle, bound = sets(b.column(0).to_pylist(), n)
            yield pa.RecordBatch.from_arrays([pa.array(_names(shingle, bound)), pa.array(
                [shingle[a:z].tobytes() for a, z in zip(bound[:-1], bound[1:], strict=True)], pa.binary())], names=["cls", "members"])

    every = docs.select(column(docs, text_col, "string").alias("text")).mapInArrow(run, "cls long, members binary")
    return every.join(small(classes), "cls", "left_semi").groupBy("cls").agg(F.first("members").alias("members"))


# ---------------------------------------------------------------- candidates


def buckets(classes: DataFrame, t: float) -> DataFrame:
    """``(band, key, cls, n, size)`` of the bands that more than one class shares."""
    bands, rows = banding(t)
    keys = F.array(*[F.struct(F.lit(b).alias("band"), F.xxhash64(F.substring("sig", b * rows + 1, rows), F.lit(b)).alias("key")) for b in range(bands)])
    every = classes.select("cls", "n", F.inline(keys))
    shared = every.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    return every.join(shared, ["band", "key"])


def estimate_least(t: float) -> float:
    return t - 4.0 * math.sqrt(t * (1.0 - t) / PLACES)


def _agreement(equal: np.ndarray) -> np.ndarray:
    """Similarity estimate from the share of equal bytes (different values share a byte once in 256)."""
    return (equal - 1.0 / 256) / (1.0 - 1.0 / 256)


def _similar(pairs: DataFrame, classes: DataFrame, t: float) -> DataFrame:
    """The pairs ``(a, b)`` whose estimate allows a link."""
    least = estimate_least(t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), dtype=np.uint8).reshape(-1, PLACES) for i in (2, 3))
            yield b.select(["a", "b"]).filter(pa.array(_agreement((x == y).mean(axis=1)) >= least))

    side = lambda k: classes.select(F.col("cls").alias(k), F.col("sig").alias(f"s{k}"), F.col("n").alias(f"n{k}"))
    close = (F.col("na") >= F.col("nb") * t) & (F.col("nb") >= F.col("na") * t)
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(close).select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _central(m: DataFrame) -> DataFrame:
    """Pairs of every bucket's most central class with the others, each once."""
    score = m.groupBy("cls").agg(F.sum("size").alias("score"))
    lead = m.join(score, "cls").groupBy("band", "key").agg(F.max(F.struct("score", "cls")).alias("top"))
    pairs = m.join(lead, ["band", "key"]).select(F.col("top.cls").alias("a"), F.col("cls").alias("b")).filter("a != b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _overlap(p: np.ndarray, q: np.ndarray) -> int:
    """Common elements of two sets."""
    both = np.concatenate([p, q])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def _across(m: DataFrame, label: DataFrame, classes: DataFrame, members: DataFrame, num: int, den: int) -> DataFrame:
    """Links ``(a, b)`` between different components in the buckets that hold several: for every class outside a
    bucket's largest component and every other component one confirmed link at most. The comparisons stay in the
    tasks, block against block; pairs are never rows."""
    t = num / den
    bands, rows = banding(t)
    least = estimate_least(t)
    known = label.select(F.col("node").alias("cls"), F.col("label").alias("comp"))
    u = m.join(known, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    parts = u.groupBy("band", "key", "comp").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"),
                                                 F.sum(F.xxhash64("cls").cast("decimal(38,0)")).alias("s"))
    mixed = parts.groupBy("band", "key").agg(F.max(F.struct("k", "comp")).alias("top"), F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n"),
                                             F.sum("k").alias("size"), F.sum("s").alias("s")).filter("parts > 1")
    # buckets with the same members: the one of the first band stands for all
    mixed = mixed.groupBy("s", "size", "n").agg(F.min(F.struct("band", "key", "top")).alias("x"))
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("n") / BLOCK_SHINGLES))
    mixed = mixed.select("x.band", "x.key", F.col("x.top.comp").alias("main"), blocks.alias("blocks"))
    u = stored(u.drop("size", "n").join(mixed, ["band", "key"]))
    body = u.join(classes.select("cls", "sig"), "cls").join(members, "cls").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    fields = ("cls", "comp", "sig", "members")
    packed = lambda rows_, p: rows_.groupBy("band", "key", "main", "block").agg(
        F.collect_list(F.struct(*fields)).alias(p)).select("band", "key", "main", p)
    both = packed(body.filter("comp <> main"), "y").join(packed(body, "x"), ["band", "key", "main"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                band, main = b.column("band")[i].as_py(), b.column("main")[i].as_py()
                y, x = (list(zip(*((r[f] for f in fields) for r in b.column(p)[i].as_py()), strict=True)) for p in "yx")
                ys, xs = (np.frombuffer(b"".join(s[2]), dtype=np.uint8).reshape(-1, PLACES) for s in (y, x))
                yn, xn = (np.array([len(k) // 8 for k in s[3]]) for s in (y, x))
                yc, xc = (np.array(s[1]) for s in (y, x))
                equal = ys[:, None, :] == xs[None, :, :]
                met = equal[:, :, : bands * rows].reshape(len(ys), len(xs), bands, rows).all(axis=3)
                like = _agreement(equal.mean(axis=2))
                ok = (met.argmax(axis=2) == band) & (like >= least) & (yc[:, None] != xc[None])
                ok &= (yn[:, None] * den >= num * xn[None]) & (xn[None] * den >= num * yn[:, None])
                ok &= (xc[None] == main) | (np.array(y[0])[:, None] < np.array(x[0])[None])  # two outsiders meet twice
                p, q = np.nonzero(ok)
                order = np.argsort(-like[p, q], kind="stable")  # likely links first
                done, found = set(), []
                for j, k in zip(p[order].tolist(), q[order].tolist(), strict=True):
                    if (j, x[1][k]) in done:
                        continue
                    common = _overlap(np.frombuffer(y[3][j], dtype=_U), np.frombuffer(x[3][k], dtype=_U))
                    if den * common >= num * (int(yn[j] + xn[k]) - common):
                        done.add((j, x[1][k]))
                        found.append((y[0][j], x[0][k]))
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long").distinct()


def _confirmed(pairs: DataFrame, members: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs with ``den * intersection >= num * union`` on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), dtype=_U), np.frombuffer(y.as_buffer(), dtype=_U)
                common = _overlap(p, q)
                keep.append(den * common >= num * (len(p) + len(q) - common))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda k: members.select(F.col("cls").alias(k), F.col("members").alias(f"m{k}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ma", "mb").mapInArrow(run, "a long, b long")


# ---------------------------------------------------------------- components


def near_duplicates(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_shingles, component_id, kept)`` of every row; texts whose ``n``-word shingle sets have a Jaccard
    similarity of ``num / den`` or more are linked."""
    t = num / den
    flat = stored(signed(docs, n, id_col, text_col))
    classes = stored(flat.filter("n > 0").groupBy("cls").agg(F.first("n").alias("n"), F.first("sig").alias("sig")))
    m = stored(buckets(classes, t))
    members = stored(full_sets(docs, stored(m.select("cls").distinct()), n, text_col))
    links = stored(_confirmed(_similar(_central(m), classes, t), members, num, den))
    label = stored(connected_components(links))
    more = stored(_across(m, label, classes, members, num, den))
    if not more.isEmpty():
        label = stored(connected_components(links.unionByName(more)))
    # sets and components that many rows share are looked up where the rows are
    by_set = stored(label.select(F.col("node").alias("cls"), F.col("label").alias("_comp")).join(
        flat.filter("n > 0").groupBy("cls").agg(F.count(F.lit(1)).alias("_rows")), "cls"))
    rows = lookup(flat.select("id", "n", "cls"), by_set, "cls", "_rows").drop("_rows")
    rows = stored(rows.withColumn("comp", F.coalesce("_comp", "cls")).drop("_comp", "cls"))
    least = stored(rows.filter("comp IS NOT NULL").groupBy("comp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("_rows")).filter("_rows > 1"))
    out = lookup(rows, least, "comp", "_rows").withColumn("component_id", F.when(F.col("_rows").isNull(), F.col("id")).otherwise(F.col("least")))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull())
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs``, all columns, one of each component: the one with the smallest doc_id (null ids come last, and of
    rows with one id any). Decided per row, so rows that share an id but not their text don't decide for each other."""
    rows = stored(docs.withColumn("_llm_row", F.monotonically_increasing_id()))
    found = near_duplicates(rows.select("_llm_row", column(rows, "text", "string")), n, num, den, id_col="_llm_row").select("_llm_row", "component_id")
    ids = rows.select("_llm_row", column(rows, "doc_id", "long").alias("id"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "_llm_row")
    stays = found.join(ids, "_llm_row").groupBy("component_id").agg(F.min(order)["_llm_row"].alias("_llm_row"))  # folded per task
    gone = stored(found.select("_llm_row").join(stays.select("_llm_row"), "_llm_row", "left_anti"))
    return rows.join(small(gone), "_llm_row", "left_anti").drop("_llm_row")
