"""Compound deduplication, structural similarity and clustering.

* Similarity (C5) is an exact set-similarity join. Identical sets are collapsed to one
  representative first; candidates come from *prefix filtering* (a pair with Jaccard >= t must
  share one of the first ``|A| - ceil(t|A|) + 1`` tokens of each set under a global order: tokens outside the most
  frequent ones by code, then those, rarest first), and every candidate is verified exactly. Tokens are 62-bit codes under a
  seed for which no two tokens of the table share one. Sets are written once, in blocks, and the blocks meet pairwise in a product
  whose tasks count in memory: disk grows with the tokens, the counting is still quadratic.
* Clustering (C6) is DBSCAN with ``min_samples = 2``: a cluster is a connected component (size
  >= 2) of the graph ``1 - sim <= eps``. Components come from alternating large-star and small-star
  rounds, each checkpointed to the shared checkpoint folder.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType

from ecospark.functions.cols import c, evaluate_once
from ecospark.operators import joins as J
from ecospark.operators.profile import prefix_sum
from ecospark.operators.resolve import tanimoto  # noqa: F401  (S1 lives with the set helpers)
from ecospark.session import cut_lineage

# ---------------------------------------------------------------- exact dedup


def exact(df: DataFrame) -> DataFrame:
    """Exact row dedup."""
    return df.distinct()


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first row per key subset in a declared order."""
    return J.first_per_key(df, list(keys), list(order))


def compounds(df: DataFrame, inchi: str, canonical: str, order: Sequence[str]) -> DataFrame:
    """First row per (standardised identifier, canonical structure) (Q3: the documented rule)."""
    return first_by(df, [inchi, canonical], order)


def repeated_keys(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """C4: keys occurring more than once, with their counts."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*[c(k) for k in keys]).agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") > 1)


# ---------------------------------------------------------------- similarity join


def token_sets(df: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """``(id, toks)`` with ``toks`` the distinct, sorted tokens of each row (tokenised once per row,
    even when later filters test the set)."""
    return evaluate_once(df.select(c(id_col).alias("id"), tokens.alias("_raw")), "toks",
                         F.array_sort(F.array_distinct("_raw"))).drop("_raw")


def _collapse(sets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``sets`` with ``n`` and the digest ``sig`` of the set; the distinct sets ``(sig, rep, size)``, ``rep`` the smallest id; and the members
    ``(sig, id, rep)``. Only digests are written. A set that very many rows share is folded per task and looked up where its rows are."""
    sig = F.sha2(F.array_join(F.col("toks"), "\u0001"), 256)
    sets = sets.withColumn("n", F.size("toks")).withColumn("sig", F.concat_ws(":", F.col("n").cast("string"), sig))
    keyed = cut_lineage(sets.select("id", "sig"))
    names = cut_lineage(keyed.groupBy("sig").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size")))
    members = J.counted_lookup(keyed, names, ["sig"], "size").drop("size")
    return sets, names, members


#: sets in a block on average, and so entries of a token's posting list there
POSTINGS = 1 << 14
#: tokens in a block on average; cells and matches that a task counts at once
BLOCK_TOKENS, CELLS, MATCHES = 1 << 22, 1 << 22, 1 << 22
#: partitions that the blocks lie in at most; every two of them are a task
PARTS = 512
#: most frequent tokens that every task knows, bits of a token's code, rows from which a set's copies are folded before they are dealt
FREQUENT, CODE_BITS, COPIES = 1 << 17, 62, 1000
#: pairs in a row or an Arrow batch of the pairs found
FOUND = 1 << 16
#: distinct sets whose representatives are marked in a broadcast table of longs
REPRESENTATIVES = 1_000_000


def _code(token: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), token).bitwiseAND((1 << CODE_BITS) - 1)


def _frequent(sets: DataFrame) -> tuple[int, np.ndarray]:
    """The seed under which no two tokens of the table share a code, and the codes of the ``FREQUENT`` most frequent tokens (by whole
    classes of frequency), rarest first. A code with two tokens shows in a second hash of them."""
    for seed in range(20):
        coded = sets.select(F.explode("toks").alias("tok")).select(_code(F.col("tok"), seed).alias("code"), F.hash("tok").alias("other"))
        counts = coded.groupBy("code").agg(F.count(F.lit(1)).alias("df"), F.min("other").alias("low"), F.max("other").alias("high"))
        kept = cut_lineage(counts.filter("df > 4 OR low <> high"))
        if kept.filter("low <> high").isEmpty():
            break
    else:
        raise RuntimeError("tokens share codes under every seed")
    level = F.floor(F.log2("df") * 8).cast("int")
    least, total = None, 0
    for r in sorted(kept.groupBy(level.alias("level")).count().collect(), reverse=True):  # some hundreds of rows at most
        total += r["count"]
        if total > FREQUENT:
            break
        least = r["level"]
    top = [] if least is None else kept.filter(level >= least).select("df", "code").collect()  # FREQUENT rows at most
    return seed, np.array([r["code"] for r in sorted(top)], np.int64)


def _blocks(sets: DataFrame, names: DataFrame, t: float, members: bool = False) -> DataFrame:
    """The distinct sets as one row per block, ``(block, upto, reps, weights, ids, sizes, codes, places)``: the last block that it
    meets, its sets' representatives, numbers of rows and (with ``members``) all their rows' ids, their sizes, the codes of its tokens
    in the global order (tokens outside the frequent ones by code, then those, rarest first), and every set's tokens as ascending
    places among them.

    Sets of one size class (a class spans sizes up to a factor of ``1 / t``) are dealt to the class's blocks by a hash; a pair with
    Jaccard >= t lies in one class or in two classes next to each other, so a block meets its own class and the next one."""
    spark = sets.sparkSession
    width = max(0.1, -math.log(t)) + 1e-6  # a little more than a factor of 1 / t: rounding never parts a pair by two classes
    k = F.floor(F.log("n") / F.lit(width))
    n = F.substring_index("sig", ":", 1).cast("long")
    classes = names.filter("rep IS NOT NULL").withColumn("n", n).groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("tokens"))
    found = {r["k"]: r for r in classes.collect()}  # one row per size class, some hundreds at most
    first, blocks, at = {}, {}, 0
    for x in sorted(found):
        first[x], blocks[x] = at, max(1, -(-found[x]["sets"] // POSTINGS), -(-found[x]["tokens"] // BLOCK_TOKENS))
        at += blocks[x]
    rows = [(x, first[x], blocks[x], first.get(x + 1, first[x]) + blocks.get(x + 1, blocks[x]) - 1) for x in sorted(found)]
    side = spark.createDataFrame(rows, "k long, first long, blocks long, upto long")
    seed, frequent = _frequent(sets)
    order = np.argsort(frequent)
    shared = spark.sparkContext.broadcast((frequent[order], order))

    coded = sets.select("id", "sig", "n", F.transform("toks", lambda x: _code(x, seed)).alias("codes"))
    kind = sets.schema["id"].dataType.simpleString()
    if names.count() <= REPRESENTATIVES:  # a set's tokens travel with its representative, its copies without any or not at all
        marked = names.select(F.xxhash64("sig", "rep").alias("_mark"), "rep", F.col("size").alias("rows"))
        at_rep = (F.xxhash64("sig", "id") == F.col("_mark")) & (F.col("id") == F.col("rep"))
        coded = coded.join(F.broadcast(marked), at_rep, "left" if members else "inner").withColumn("codes", F.when(F.col("rep").isNotNull(), F.col("codes")))
        coded = coded.select("id", "sig", "n", "codes", F.lit(1).cast("long").alias("rows") if members else F.col("rows"))
    else:
        many = cut_lineage(names.filter(F.col("size") > COPIES).select("sig"))
        folded = coded.join(F.broadcast(many), "sig", "left_semi").groupBy("sig").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("codes").alias("codes"))
        coded = coded.join(F.broadcast(many), "sig", "left_anti").unionByName(folded).withColumn("rows", F.lit(0).cast("long"))
        # a set's number of rows, or all their ids, in rows without tokens
        own = sets.select("id", "sig", "n", F.lit(1).cast("long").alias("rows")) if members else names.select(
            F.lit(None).cast(kind).alias("id"), "sig", n.alias("n"), F.col("size").alias("rows"))
        coded = coded.unionByName(own, allowMissingColumns=True)
    coded = coded.withColumn("k", k)
    dealt = coded.join(F.broadcast(side), "k").withColumn("block", F.col("first") + F.pmod(F.xxhash64("sig"), F.col("blocks")))
    whole = sum(max(r["sets"] / POSTINGS, r["tokens"] / BLOCK_TOKENS) for r in found.values())
    parts = max(1, min(at, PARTS, max(8, math.ceil(2 * whole))))  # small blocks share a partition
    dealt = dealt.repartitionById(parts, F.pmod("block", F.lit(parts)).cast("int"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's copies become one set with the smallest id, and its codes their places in the order."""
        known, rank = shared.value
        held: dict[int, tuple] = {}
        for b in batches:
            sets = b.column("codes")
            for i, (block, upto, sig, rep, rows) in enumerate(zip(*(b.column(x).to_pylist() for x in ("block", "upto", "sig", "id", "rows")), strict=True)):
                _, own = held.setdefault(block, (upto, {}))
                x = own.setdefault(sig, [None, None, 0, []])  # representative, codes, rows, ids
                if rows and members:
                    x[2] += rows
                    x[3].append(rep)
                elif rows:
                    x[2] = rows
                if not sets[i].is_valid:
                    continue
                if x[1] is None:
                    x[1] = sets[i].values.to_numpy().copy()
                if rep is not None and (x[0] is None or rep < x[0]):
                    x[0] = rep
        for block in list(held):
            upto, own = held.pop(block)
            own = [x for x in own.values() if x[0] is not None]
            if not own:
                continue
            codes, sizes = np.concatenate([x[1] for x in own]), np.array([len(x[1]) for x in own], np.int32)
            if len(known):
                at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
                codes = np.where(known[at] == codes, (1 << CODE_BITS) + rank[at], codes)
            codes, places = np.unique(codes, return_inverse=True)
            places = np.concatenate([np.sort(x) for x in np.split(places.astype(np.int32), np.cumsum(sizes)[:-1])])
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([upto], pa.int64()), pa.array([[x[0] for x in own]], reps),
                                              pa.array([np.array([x[2] for x in own], np.int64).tobytes()]), pa.array([[x[3] for x in own]], pa.list_(reps)),
                                              *[pa.array([x.tobytes()]) for x in (sizes, codes, places)]],
                                             ["block", "upto", "reps", "weights", "ids", "sizes", "codes", "places"])

    reps = to_arrow_type(ArrayType(sets.schema["id"].dataType))
    folded = dealt.select("block", "upto", "sig", "id", "rows", "codes").mapInArrow(
        fold, f"block long, upto long, reps array<{kind}>, weights binary, ids array<array<{kind}>>, sizes binary, codes binary, places binary")
    return cut_lineage(folded)


def _overlaps(a: Sequence[np.ndarray], b: Sequence[np.ndarray], t: float, same: bool) -> Iterator[tuple[int, int, float]]:
    """Positions ``(i, j)`` and similarity of the pairs of two lists of sets (``same``: of one, i < j) with Jaccard >= t.

    Two such sets share a token of their prefixes (the first ``n - ceil(t n) + 1`` tokens). All shared prefix tokens are counted;
    a common token that is not among them comes after the lower of the two prefixes' last tokens, so ``overlap <= m + what either
    set has after that token``. Pairs whose bound is below the overlap that t requires are dropped, the others compared in full."""
    na, nb = (np.array([len(x) for x in s], np.int64) for s in (a, b))
    pa, pb = (n - np.ceil(n * t - 1e-9).astype(np.int64) + 1 for n in (na, nb))
    pa, pb = np.minimum(pa, na), np.minimum(pb, nb)
    last_a, last_b = (np.array([x[p - 1] for x, p in zip(s, q)], np.int64) for s, q in ((a, pa), (b, pb)))
    token_b = np.concatenate([x[:p] for x, p in zip(b, pb)])
    order = np.argsort(token_b, kind="stable")
    token_b, column = token_b[order], np.repeat(np.arange(len(b)), pb)[order]
    token_a, row = np.concatenate([x[:p] for x, p in zip(a, pa)]), np.repeat(np.arange(len(a)), pa)
    left = np.searchsorted(token_b, token_a, "left")
    hits = np.searchsorted(token_b, token_a, "right") - left
    least = 1 if same else 0  # in one list every token meets itself
    token_a, row, left, hits = (x[hits > least] for x in (token_a, row, left, hits))

    def need(n: np.ndarray, k: np.ndarray) -> np.ndarray:
        return np.ceil((n + k) * (t / (1.0 + t)) - 1e-9)

    def beyond(keys: np.ndarray, sizes: np.ndarray, at: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Tokens of the sets ``at`` that come after ``token``."""
        return np.cumsum(sizes)[at] - np.searchsorted(keys, at * span + token, "right")

    span = int(max(max(x[-1] for x in a), max(x[-1] for x in b))) + 1
    key_a, key_b = (np.repeat(np.arange(len(s)) * span, n) + np.concatenate(s) for s, n in ((a, na), (b, nb)))
    step = max(1, CELLS // len(b))
    for start in range(0, len(a), step):
        stop = min(start + step, len(a))
        begin, end = (int(x) for x in np.searchsorted(row, [start, stop]))
        if begin == end:
            continue
        count, upto, e = np.zeros((stop - start) * len(b), np.int32), np.cumsum(hits[begin:end]), begin
        while e < end:
            done = upto[e - begin - 1] if e > begin else 0
            f = max(e + 1, begin + int(np.searchsorted(upto, done + MATCHES, "right")))
            n = hits[e:f]
            at = np.repeat(left[e:f] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            cell = np.repeat((row[e:f] - start) * len(b), n) + column[at]
            count += np.bincount(cell, minlength=len(count)).astype(np.int32)
            e = f
        met = np.flatnonzero(count)
        i, j, m = met // len(b) + start, met % len(b), count[met]
        keep = (nb[j] >= na[i] * t - 1e-9) & (na[i] >= nb[j] * t - 1e-9)
        keep &= m + np.where(last_a[i] <= last_b[j], na[i] - pa[i], nb[j] - pb[j]) >= need(na[i], nb[j])
        if same:
            keep &= i < j
        i, j, m = i[keep], j[keep], m[keep]
        side = last_a[i] <= last_b[j]
        after = np.where(side, beyond(key_b, nb, j, last_a[i]), beyond(key_a, na, i, last_b[j]))
        keep = m + after >= need(na[i], nb[j])
        for x, y in zip(i[keep].tolist(), j[keep].tolist()):
            inter = len(np.intersect1d(a[x], b[y]))
            similarity = inter / (len(a[x]) + len(b[y]) - inter)
            if similarity >= t:
                yield x, y, similarity


def _meet(packed: DataFrame, t: float, emit: Callable[[dict, bool, Iterator[tuple[int, int, float]]], Iterator[pa.RecordBatch]],
          schema: str) -> DataFrame:
    """The blocks of :func:`_blocks` meet in a product that reads them where they lie, and a task counts the shared prefix tokens of two
    blocks in its memory: no match of two sets on a token, no candidate and no copy of a set is shuffled, so disk holds a set
    once, however many blocks its block meets. ``emit`` gets the two blocks' columns (``lo_`` and
    ``hi_``), whether they are one block, and the positions and similarity of the pairs with Jaccard >= t."""
    names = ["block", "reps", "weights", "ids", "sizes", "codes", "places"]
    low = packed.select(*[c(x).alias(f"lo_{x}") for x in names], "upto")
    high = packed.select(*[c(x).alias(f"hi_{x}") for x in names]).hint("shuffle_replicate_nl")
    met = low.join(high, (F.col("lo_block") <= F.col("hi_block")) & (F.col("hi_block") <= F.col("upto")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                get = {n: x[i] for n, x in zip(batch.schema.names, batch.columns, strict=True)}
                read = lambda n, kind: np.frombuffer(get[n].as_buffer(), kind)  # noqa: B023, E731
                same = get["lo_block"] == get["hi_block"]
                codes = read("lo_codes", np.int64)
                every = codes if same else np.unique(np.concatenate([codes, read("hi_codes", np.int64)]))

                def sets(side: str) -> list[np.ndarray]:
                    places = np.searchsorted(every, read(f"{side}_codes", np.int64))[read(f"{side}_places", np.int32)]  # noqa: B023
                    return np.split(places, np.cumsum(read(f"{side}_sizes", np.int32))[:-1])  # noqa: B023

                a = sets("lo")
                yield from emit(get, same, _overlaps(a, a if same else sets("hi"), t, same))

    return met.mapInArrow(run, schema)


def _pieces(found: Iterator[tuple[int, int, float]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Positions and similarities of the pairs found, ``FOUND`` at a time."""
    while some := list(itertools.islice(found, FOUND)):
        x, y, similarity = zip(*some, strict=True)
        yield np.array(x), np.array(y), np.array(similarity, float)


def _similar(packed: DataFrame, t: float) -> DataFrame:
    """``(a, b, similarity)``, a < b, of all pairs of sets of :func:`_blocks` with Jaccard >= t. The pairs found are dealt in pieces of
    ``FOUND``, so that two blocks with very many links leave no long task to what follows."""
    kind = packed.schema["reps"].dataType.elementType.simpleString()

    def emit(get: dict, same: bool, found: Iterator[tuple[int, int, float]]) -> Iterator[pa.RecordBatch]:
        for piece, (x, y, similarity) in enumerate(_pieces(found)):
            rows = [get["lo_reps"].values.take(pa.array(x)), get["hi_reps"].values.take(pa.array(y)), pa.array(similarity)]
            yield pa.RecordBatch.from_arrays([pa.array([v.as_py() if isinstance(v, pa.Scalar) else v], pa.int64()) for v in (get["lo_block"], get["hi_block"], piece)]
                                             + [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), v) for v in rows],
                                             ["lo", "hi", "piece", "x", "y", "similarity"])

    def rows(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[["x", "y", "similarity"]].explode(["x", "y", "similarity"])

    found = _meet(packed, t, emit, f"lo long, hi long, piece long, x array<{kind}>, y array<{kind}>, similarity array<double>")
    out = found.groupBy("lo", "hi", "piece").applyInPandas(rows, f"x {kind}, y {kind}, similarity double")
    return out.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")


def _linked(packed: DataFrame, t: float) -> DataFrame:
    """``(rep, n)``: the rows of other sets that a set of :func:`_blocks` has Jaccard >= t with. Two blocks that meet give a row per
    set with links, not one per pair."""
    kind = packed.schema["reps"].dataType.elementType.simpleString()

    def emit(get: dict, same: bool, found: Iterator[tuple[int, int, float]]) -> Iterator[pa.RecordBatch]:
        reps = [get[f"{s}_reps"].values for s in ("lo", "hi")]
        weights = [np.frombuffer(get[f"{s}_weights"].as_buffer(), np.int64) for s in ("lo", "hi")]
        n = [np.zeros(len(w), np.int64) for w in weights]
        for x, y, _ in _pieces(found):
            apart = pa.compute.not_equal(reps[0].take(pa.array(x)), reps[1].take(pa.array(y))).to_numpy(zero_copy_only=False)
            x, y = x[apart], y[apart]
            np.add.at(n[0], x, weights[1][y])
            np.add.at(n[1], y, weights[0][x])
        for own, count in zip(reps, n, strict=True):
            has = np.flatnonzero(count)
            if len(has):
                yield pa.RecordBatch.from_arrays([own.take(pa.array(has)), pa.array(count[has])], ["rep", "n"])

    return _meet(packed, t, emit, f"rep {kind}, n long").groupBy("rep").agg(F.sum("n").alias("n"))


def _expanded(packed: DataFrame, t: float) -> DataFrame:
    """``(x, y, similarity)``: the pairs of rows of two sets with Jaccard >= t, and of rows with different ids of one set with at most
    ``COPIES`` rows. A task writes them from the blocks' ids; none is shuffled."""
    kind = packed.schema["reps"].dataType.elementType.simpleString()

    def emit(get: dict, same: bool, found: Iterator[tuple[int, int, float]]) -> Iterator[pa.RecordBatch]:
        reps = [get[f"{s}_reps"].values for s in ("lo", "hi")]
        flat = [get[f"{s}_ids"].values.flatten() for s in ("lo", "hi")]
        size = [np.frombuffer(get[f"{s}_weights"].as_buffer(), np.int64) for s in ("lo", "hi")]
        first = [np.cumsum(n) - n for n in size]

        def batch(parts: list[tuple[np.ndarray, np.ndarray, float]], other: int, apart: bool) -> pa.RecordBatch:
            x, y = (flat[s].take(pa.array(np.concatenate([p[i] for p in parts]))) for i, s in ((0, 0), (1, other)))
            out = pa.RecordBatch.from_arrays([x, y, pa.array(np.repeat([p[2] for p in parts], [len(p[0]) for p in parts]))], ["x", "y", "similarity"])
            return out.filter(pa.compute.not_equal(x, y)) if apart else out  # unknown ids differ from none

        def across() -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
            for x, y, similarity in _pieces(found):
                apart = pa.compute.not_equal(reps[0].take(pa.array(x)), reps[1].take(pa.array(y))).to_numpy(zero_copy_only=False)
                for i, j, s in zip(x[apart].tolist(), y[apart].tolist(), similarity[apart].tolist(), strict=True):
                    right = np.arange(first[1][j], first[1][j] + size[1][j])
                    step = max(1, FOUND // len(right))
                    for at in range(0, int(size[0][i]), step):
                        left = np.arange(first[0][i] + at, first[0][i] + min(at + step, int(size[0][i])))
                        yield np.repeat(left, len(right)), np.tile(right, len(left)), s

        def within() -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
            for i in np.flatnonzero((size[0] > 1) & (size[0] <= COPIES)).tolist():
                low, high = np.triu_indices(size[0][i], 1)
                yield first[0][i] + low, first[0][i] + high, 1.0

        for pairs, other, apart in ((across(), 1, False), (within() if same else iter(()), 0, True)):
            parts, rows = [], 0
            for p in pairs:
                parts.append(p)
                rows += len(p[0])
                if rows >= FOUND:
                    yield batch(parts, other, apart)
                    parts, rows = [], 0
            if parts:
                yield batch(parts, other, apart)

    return _meet(packed, t, emit, f"x {kind}, y {kind}, similarity double")


def _copies(sets: DataFrame, names: DataFrame) -> DataFrame:
    """``(id_a, id_b)``, id_a < id_b, of the rows of sets with over ``COPIES`` rows: their ids are cut into chunks that meet pairwise, so
    that chunks are shuffled and not pairs."""
    many = cut_lineage(names.filter(F.col("size") > COPIES).select("sig", F.ceil(F.col("size") / COPIES).cast("long").alias("chunks")))
    own = sets.select("id", "sig").join(F.broadcast(many), "sig").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")))
    own = cut_lineage(own.groupBy("sig", "chunk").agg(F.collect_list("id").alias("ids")))
    met = own.select("sig", F.col("chunk").alias("i"), F.col("ids").alias("x")).join(own.select("sig", F.col("chunk").alias("j"), F.col("ids").alias("y")), "sig")
    parts = max(1, min(4096, many.agg(F.sum(F.col("chunks") * F.col("chunks"))).first()[0] or 1))
    met = met.filter("i <= j").repartition(parts, "sig", "i", "j")
    rows = met.select("i", "j", F.explode("x").alias("x"), "y").select("i", "j", "x", F.explode("y").alias("y"))
    return rows.filter("x < y OR (i < j AND x > y)").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def similar_representatives(df: DataFrame, id_col: str, tokens: Column, min_sim: float) -> tuple[DataFrame, DataFrame]:
    """Compressed C5: pairs of distinct-set representatives ``(a, b, similarity)`` plus the
    ``(sig, id, rep)`` membership of every row. Output size never exceeds distinct-set pairs."""
    sets, names, members = _collapse(token_sets(df, id_col, tokens).filter(F.size("toks") > 0))
    return _similar(_blocks(sets, names, min_sim), min_sim), members


def similar_pairs(df: DataFrame, id_col: str, tokens: Column, min_sim: float = 0.5) -> DataFrame:
    """Every pair ``(id_a < id_b)`` with Jaccard/Tanimoto similarity >= ``min_sim``, for inputs whose pairs are wanted as
    rows; ``similar_representatives`` and ``similar_links`` hold the same links without growing with the square of a group.

    Pairs of sets are expanded to pairs of rows where they are found; rows with identical sets
    pair with similarity 1. Both expansions are exactly the requested output."""
    sets, names, _ = _collapse(token_sets(df, id_col, tokens).filter(F.size("toks") > 0))
    found = _expanded(_blocks(sets, names, min_sim, members=True), min_sim).select(
        F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "similarity")
    if names.filter(F.col("size") > COPIES).isEmpty():
        return found
    return found.unionByName(_copies(sets, names).withColumn("similarity", F.lit(1.0)))


def similar_links(df: DataFrame, id_col: str, tokens: Column, min_sim: float) -> DataFrame:
    """``(id, rep, class_size, n_links)`` of every row, counted where the pairs are found: as :func:`link_counts` of
    :func:`similar_representatives`, but no pair leaves its task."""
    sets, names, members = _collapse(token_sets(df, id_col, tokens).filter(F.size("toks") > 0))
    return _with_links(_linked(_blocks(sets, names, min_sim), min_sim), members)


def link_counts(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``(id, rep, class_size, n_links)``: each row's class (its set's smallest id), that class's rows, and the other rows that it is
    linked with, from the compressed form of :func:`similar_representatives`."""
    sizes = members.groupBy(F.col("rep").alias("b")).agg(F.count(F.lit(1)).alias("class_size"))
    both = pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
    return _with_links(both.join(sizes, "b").groupBy(F.col("a").alias("rep")).agg(F.sum("class_size").alias("n")), members)


def _with_links(linked: DataFrame, members: DataFrame) -> DataFrame:
    """``(id, rep, class_size, n_links)`` from the numbers ``(rep, n)`` of linked rows of other sets."""
    sizes = members.groupBy("rep").agg(F.count(F.lit(1)).alias("class_size"))
    side = cut_lineage(sizes.join(linked, "rep", "left").select("rep", "class_size", (F.coalesce("n", F.lit(0)) + F.col("class_size") - 1).alias("n_links")))
    return J.counted_lookup(members.select("id", "rep"), side, ["rep"], "class_size")


# ---------------------------------------------------------------- components


def connected_components(edges: DataFrame, max_rounds: int = 500, group: Sequence[str] = ()) -> DataFrame:
    """Connected components of an undirected edge list ``(*group, a, b)`` by alternating star rounds.

    A *large-star* round hangs every larger neighbour of a node on the smallest node of its neighbourhood; a
    *small-star* round does so with the smaller neighbours and the node itself. The edges shrink to one star per
    component, whose centre is the smallest node. No join has a component's label as its key: rows meet on nodes,
    minima are folded in every task first, and only a hub's own edges share a key (which an adaptive skew join
    splits). Every round is a reliable checkpoint, so executor loss never replays the loop. With ``group`` columns
    (e.g. a molecule id) components never cross groups. Returns ``(*group, node, label)`` of the nodes with an edge
    to another node; raises if ``max_rounds`` don't suffice."""
    g = list(group)

    def pairs(df: DataFrame, u: Column, v: Column) -> DataFrame:
        return df.select(*g, F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u <> v")

    def size(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*g, "u", "v").cast("decimal(38,0)"))).first())

    e = cut_lineage(pairs(edges, F.col("a"), F.col("b")).distinct())
    before = size(e)
    for _ in range(max_rounds):
        both = e.unionByName(e.select(*g, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(*g, "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        e = pairs(both.filter("v > u").join(low, [*g, "u"]), F.col("v"), F.col("m")).distinct()
        low = e.groupBy(*g, "u").agg(F.min("v").alias("m"))
        hung = e.join(low, [*g, "u"])
        e = pairs(hung, F.col("v"), F.col("m")).unionByName(pairs(low, F.col("u"), F.col("m"))).distinct()
        e = cut_lineage(e)
        now = size(e)
        if now == before:
            centres = e.select(*g, F.col("v").alias("node")).distinct().withColumn("label", F.col("node"))
            return e.select(*g, F.col("u").alias("node"), F.col("v").alias("label")).unionByName(centres)
        before = now
    raise RuntimeError(f"connected components did not converge in {max_rounds} rounds")


def cluster(pairs: DataFrame, ids: DataFrame, eps: float = 0.5, id_col: str = "id",
            members: DataFrame | None = None) -> DataFrame:
    """DBSCAN(eps, min_samples=2) over precomputed ``1 - similarity``.

    ``pairs`` hold ``(a, b, similarity)``; ``ids`` every point. With ``members`` (from
    :func:`similar_representatives`), pairs are between representatives and every member joins
    its representative's component (identical sets are at distance 0, hence neighbours).
    Labels are 0, 1, ... in order of each cluster's smallest id (DBSCAN numbers clusters in the
    order it meets them); noise is -1. Returns ``(id, cluster)``."""
    close = pairs.filter((F.lit(1.0) - F.col("similarity")) <= F.lit(eps)).select("a", "b")
    if members is not None:
        # members hang off their representative (distance 0); representatives are linked by pairs
        rep_edges = members.filter(F.col("id") != F.col("rep")).select(F.col("rep").alias("a"), F.col("id").alias("b"))
        close = close.unionByName(rep_edges)
    comp = connected_components(close)
    mins = comp.groupBy("label").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= 2).select(
        "label", F.lit(1).alias("_one"))
    numbered = prefix_sum(mins, ["label"], "_one", out="_k").select("label", (F.col("_k") - 1).alias("cluster"))
    lab = comp.join(numbered, "label").select(F.col("node").alias(id_col), "cluster")
    return ids.select(c(id_col)).distinct().join(lab, id_col, "left").select(
        c(id_col), F.coalesce("cluster", F.lit(-1)).cast("long").alias("cluster"))


def activity_cliffs(df: DataFrame, cluster_col: str, value: str, min_range: float = 0.2) -> DataFrame:
    """Rows of clusters (not noise) whose value range >= ``min_range``; all rows if none."""
    # three passes read ``df``: materialised once, so that the join chain behind it runs once
    df = cut_lineage(df)
    ranges = (df.filter(c(cluster_col) != -1).groupBy(c(cluster_col))
              .agg((F.max(c(value)) - F.min(c(value))).alias("_r")).filter(F.col("_r") >= min_range)
              .select(c(cluster_col)))
    hits = cut_lineage(df.join(ranges, cluster_col, "left_semi"))
    return df if hits.isEmpty() else hits


def stereo_centres(smiles: Column) -> Column:
    """Count of chirality marks (``@`` or ``@@``) in a SMILES string."""
    return F.size(F.regexp_extract_all(smiles, F.lit("(@@?)"), 1))


def stereo_check(df: DataFrame, smiles: str, ref: DataFrame | None, key: str, ref_count: str = "ref_count",
                 keep: bool = True, missing_is_manual: bool = True, status: str = "Status", centres: DataFrame | None = None) -> DataFrame:
    """Detected stereo centres vs a reference count per key -> manual-curation flag and a
    status note; with ``keep=False`` flagged rows are dropped (Q4). ``centres`` (key, stereo_centres) brings the centres found in the
    molecules' graphs (``molgraph.stereocentres``: assigned and unassigned); without it the string's chirality marks count."""
    out = df.withColumn("stereo_centres", stereo_centres(c(smiles))) if centres is None else df.join(centres.select(c(key), "stereo_centres"), key, "left")
    if ref is not None:
        out = out.join(ref.select(c(key), c(ref_count).alias("_ref")), key, "left")
    else:
        out = out.withColumn("_ref", F.lit(None).cast("int"))
    manual = F.when(F.col("_ref").isNull(), F.lit(missing_is_manual)).otherwise(F.col("stereo_centres") != F.col("_ref"))
    out = out.withColumn("manual_curation", manual).drop("_ref")
    cur = F.coalesce(c(status), F.lit("")) if status in df.columns else F.lit("")
    out = out.withColumn(status, F.concat(cur, F.when(F.col("manual_curation"), F.lit("Manual Curation Required; "))
                                          .otherwise(F.lit("Passed Stereochemistry Verification; "))))
    return out if keep else out.filter(~F.col("manual_curation"))


def curate(df: DataFrame, id_col: str, smiles: str, mass: str | None, inchi: str, canonical: str, order: Sequence[str],
           tokens: Column, value: str, stereo_ref: DataFrame | None = None, keep_manual: bool = True,
           eps: float = 0.5, min_range: float = 0.2, **filter_options) -> DataFrame:
    """Compound filter -> dedup -> stereo check -> similarity clusters -> activity cliffs."""
    from ecospark.functions.clean import compound_filter

    step = compound_filter(df, smiles, mass=mass, **filter_options)
    step = compounds(step, inchi, canonical, order)
    step = stereo_check(step, smiles, stereo_ref, id_col, keep=keep_manual)
    # the survivors feed the similarity join, the cluster ids and the cliff test: materialise once
    step = cut_lineage(step)
    pairs, members = similar_representatives(step, id_col, tokens, 1.0 - eps - 1e-9)
    clusters = cluster(pairs, step.select(c(id_col).alias("id")), eps, members=members)
    with_cluster = step.join(clusters.withColumnRenamed("id", id_col), id_col, "left")
    return activity_cliffs(with_cluster, "cluster", value, min_range)
