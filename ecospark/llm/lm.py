"""LM scoring (operator 6): a probabilistic suffix tree beside an add-one word model.

*Suffix tree.* Symbols are the bytes of a text's lower-cased words joined by one space, and an end symbol. A context is
the last k <= ``DEPTH`` symbols (a pad symbol before the text's first). All training texts are counted. A context is
retained when it was seen ``LEAST`` times and its next-symbol counts diverge from those of its own suffix (the
context without its oldest symbol): sum of n * ln(p(s | context) / p(s | suffix)) >= ``DIVERGENCE``; suffixes of
retained contexts are retained too. A state's distribution is smoothed towards its suffix's:
(n(s) + ``PULL`` * p(s | suffix)) / (n + ``PULL``), the root's is add-one. A symbol is scored in the longest retained
suffix of what stands before it; ``score`` is the sum of log10 probabilities.

*Word model.* ``base_score`` adds log10((c + 1) / (N + V + 1)) over the words and one end per text. Words are named by
64-bit hashes. A fixed number of words that are frequent in a sample are counted in every task and looked up by
broadcast (which words those are changes the cost, not the result); the rest is counted by one shuffle on the word,
so no word's rows are many, and folded per document before the next.

The tree's counts are folded in every task and by a grouped sum; the retained part, whose size is checked, is
broadcast in one or more shards by the symbol before (one pass over the texts per shard).

Null texts are empty: one end token. Rows with a null id are never held out and so teach. Rows that repeat id and
text get equal scores and each teaches; ties don't occur. Extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ecospark.llm import words as W
from ecospark.llm.tables import column, slices, small_batches, stored

DEPTH, LEAST, DIVERGENCE, PULL = 4, 16, 20.0, 4.0
#: bytes that no UTF-8 text holds
END, PAD = 0xFE, 0xFF
#: rows of the tree that one broadcast shard may hold (24 bytes each)
SHARD_ROWS = 3_000_000
#: words looked up by broadcast; rows of the sample that proposes them (expected)
FREQUENT, SAMPLE = 50_000, 4000
FOLDS, HELD = 7, 2
_U = np.uint64


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD, F.lit(False))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(column(docs, "doc_id", "long").alias("d"), held_out(column(docs, "doc_id", "long")).alias("held"),
                       column(docs, "text", "string").alias("text"))


class Batch:
    """The words and symbols of a slice of texts."""

    def __init__(self, texts: list[str | None]) -> None:
        joined = [b" ".join(W.text_bytes(t).tobytes().split()) for t in texts]  # ASCII white space
        self.n = len(texts)
        size = np.array([len(x) + 1 for x in joined], dtype=np.int64)
        self.first = np.cumsum(size) - size
        self.data = np.frombuffer(b"\n".join([*joined, b""]), dtype=np.uint8)  # a line feed ends each text
        start, end = W.word_spans(self.data)
        self.word = W.span_hashes(self.data, start, end)
        self.owner = np.searchsorted(self.first, start, side="right") - 1
        self.names = W.span_hashes(self.data, self.first, self.first + size - 1).view(np.int64)
        self.n_words = np.bincount(self.owner, minlength=self.n)

    def grams(self) -> np.ndarray:
        """For every symbol: the DEPTH symbols before it and itself, one byte each, oldest highest."""
        symbol = self.data.copy()
        symbol[np.append(self.first[1:], len(symbol)) - 1] = END
        out, fresh = symbol.astype(_U), np.zeros(len(symbol), dtype=np.int64)
        fresh[self.first] = self.first
        back = np.arange(len(symbol)) - np.maximum.accumulate(fresh)  # symbols of the text before this one
        for k in range(1, DEPTH + 1):
            before = np.full(len(symbol), PAD, dtype=_U)
            if k < len(symbol):
                before[k:] = symbol[:-k]
            before[back < k] = PAD
            out |= before << _U(8 * k)
        return out


# ---------------------------------------------------------------- suffix tree


def _gram_counts(docs: DataFrame) -> DataFrame:
    """``(code, n)`` of the training texts, folded per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, counts = [np.zeros(0, _U)], [np.zeros(0, np.int64)]

        def fold() -> tuple[np.ndarray, np.ndarray]:
            code, place = np.unique(np.concatenate(kept), return_inverse=True)
            return code, np.bincount(place, weights=np.concatenate(counts), minlength=len(code)).astype(np.int64)

        for b in slices(batches, "text"):
            code, n = np.unique(Batch(b.column(0).to_pylist()).grams(), return_counts=True)
            kept.append(code)
            counts.append(n)
            if len(kept) > 8:
                code, n = fold()
                kept, counts = [code], [n]
                if len(code) > 1_000_000:  # bounded memory: hand on what was counted
                    yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(n)], names=["code", "n"])
                    kept, counts = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
        code, n = fold()
        yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(n)], names=["code", "n"])

    teach = _rows(docs).filter("NOT held").select("text")
    return teach.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def suffix_tree(docs: DataFrame) -> DataFrame:
    """``(k, ctx, s, n)``: next-symbol counts of the retained contexts and of the root (k = 0)."""
    mask = lambda k: f"(shiftleft(1L, int(8 * ({k}))) - 1)"
    levels = F.array(*[F.struct(F.lit(k).alias("k"), F.expr(f"code & {mask(k + 1)}").alias("key")) for k in range(DEPTH + 1)])
    nodes = _gram_counts(docs).select("n", F.inline(levels)).groupBy("k", "key").agg(F.sum("n").alias("n"))
    nodes = stored(nodes.withColumn("ctx", F.expr("shiftright(key, 8)")))
    total = nodes.groupBy("k", "ctx").agg(F.sum("n").alias("m"))
    p = nodes.join(total, ["k", "ctx"])
    upper = p.select((F.col("k") + 1).alias("k"), F.col("key").alias("up"), (F.col("n") / F.col("m")).alias("p_up"))
    diverge = (p.filter("k > 0").withColumn("up", F.expr(f"key & {mask('k')}")).join(upper, ["k", "up"]).groupBy("k", "ctx", "m")
               .agg(F.sum(F.col("n") * F.log(F.col("n") / F.col("m") / F.col("p_up"))).alias("gain")))
    passed = diverge.filter((F.col("m") >= LEAST) & (F.col("gain") >= DIVERGENCE))
    closed = passed.select("ctx", F.explode(F.sequence(F.lit(1), "k")).alias("k")).select("k", F.expr(f"ctx & {mask('k')}").alias("ctx")).distinct()
    root = nodes.filter("k = 0")
    return nodes.join(closed, ["k", "ctx"], "left_semi").unionByName(root).select("k", "ctx", F.expr("int(key & 255)").alias("s"), "n")


class Tree:
    """Retained contexts of a shard as sorted arrays."""

    def __init__(self, table: pd.DataFrame) -> None:
        self.levels = []
        for k in range(DEPTH + 1):
            t = table[table["k"] == k]
            key = (t["ctx"].to_numpy(np.int64).astype(_U) << _U(8)) | t["s"].to_numpy(np.int64).astype(_U)
            order = np.argsort(key)
            key, n = key[order], t["n"].to_numpy(np.int64)[order].astype(float)
            ctx, first = np.unique(key >> _U(8), return_index=True)
            self.levels.append((key, n, ctx, np.add.reduceat(n, first) if len(n) else n))
        self.known, self.logs = np.zeros(0, _U), np.zeros(0)

    @staticmethod
    def _find(table: np.ndarray, values: np.ndarray, x: np.ndarray) -> np.ndarray:
        if not len(table):
            return np.zeros(len(x))
        at = np.minimum(np.searchsorted(table, x), len(table) - 1)
        return np.where(table[at] == x, values[at], 0.0)

    def _log10(self, code: np.ndarray) -> np.ndarray:
        key, n, _, total = self.levels[0]
        p = (self._find(key, n, code & _U(255)) + 1.0) / ((total[0] if len(total) else 0.0) + 257.0)
        inside = np.ones(len(code), dtype=bool)
        for k in range(1, DEPTH + 1):
            key, n, ctx, total = self.levels[k]
            part = code & _U((1 << 8 * (k + 1)) - 1)
            m = self._find(ctx, total, part >> _U(8))
            inside &= m > 0
            p = np.where(inside, (self._find(key, n, part) + PULL * p) / (m + PULL), p)
        return np.log10(p)

    def log10(self, code: np.ndarray) -> np.ndarray:
        """log10 probabilities of the last symbols of ``code``; those met before are remembered, up to a bound."""
        unique, place = np.unique(code, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, unique), max(len(self.known) - 1, 0))
        old = self.known[at] == unique if len(self.known) else np.zeros(len(unique), bool)
        logs = np.empty(len(unique))
        logs[old] = self.logs[at[old]] if len(self.known) else 0.0
        fresh = unique[~old]
        if len(fresh):
            logs[~old] = self._log10(fresh)
            if len(self.known) + len(fresh) > 2_000_000:
                self.known, self.logs = np.zeros(0, _U), np.zeros(0)
            merged = np.concatenate([self.known, fresh])
            order = np.argsort(merged, kind="stable")
            self.known, self.logs = merged[order], np.concatenate([self.logs, logs[~old]])[order]
        return logs[place]


def _shards(tree: DataFrame) -> list[list[int]]:
    """Symbols before (the contexts' newest), grouped so that a group's rows stay within the bound."""
    sizes = tree.filter("k > 0").groupBy(F.expr("int(ctx & 255)").alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()  # 256 rows at most
    groups, used = [[]], 0
    rows = {r["c"]: r["n"] for r in sizes}
    for c in range(256):
        if used and used + rows.get(c, 0) > SHARD_ROWS:
            groups, used = [*groups, []], 0
        groups[-1].append(c)
        used += rows.get(c, 0)
    return groups


# ---------------------------------------------------------------- word model


def _frequent(docs: DataFrame) -> np.ndarray:
    """Hashes of at most ``FREQUENT`` words, the most frequent of a sample of rows."""
    share = SAMPLE / max(docs.count(), 1)
    draw = F.pmod(F.xxhash64("d", F.length("text")), F.lit(1 << 20)) / float(1 << 20)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            w, n = np.unique(Batch(b.column(0).to_pylist()).word, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n)], names=["w", "n"])

    words = _rows(docs).filter(draw < share).select("text").mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))
    top = words.filter("n > 1").orderBy(F.desc("n"), "w").limit(FREQUENT).toPandas()
    return np.sort(top["w"].to_numpy(np.int64).view(_U))


def _place(frequent: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Places of words among the frequent ones, -1 for others."""
    if not len(frequent):
        return np.full(len(word), -1)
    at = np.minimum(np.searchsorted(frequent, word), len(frequent) - 1)
    return np.where(frequent[at] == word, at, -1)


def score(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every document."""
    sc = docs.sparkSession.sparkContext
    rows = _rows(small_batches(docs))
    frequent = sc.broadcast(_frequent(docs))

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Training counts of the frequent words (one row each), and of all tokens and texts (places -1, -2)."""
        n, tokens, texts = np.zeros(len(frequent.value), np.int64), 0, 0
        for b in slices(batches, "text"):
            batch = Batch(b.column(0).to_pylist())
            at = _place(frequent.value, batch.word)
            n += np.bincount(at[at >= 0], minlength=len(n))
            tokens, texts = tokens + len(batch.word) + batch.n, texts + batch.n
        hit = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(hit, [-1, -2])), pa.array(np.append(n[hit], [tokens, texts]))], names=["i", "n"])

    counts = rows.filter("NOT held").select("text").mapInArrow(often, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toPandas()
    counts = dict(zip(counts["i"], counts["n"], strict=True))  # at most FREQUENT + 2 rows
    train, ends = int(counts.pop(-1, 0)), int(counts.pop(-2, 0))
    c = np.zeros(len(frequent.value))
    c[list(counts)] = list(counts.values())

    def seldom(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text's other words with their counts."""
        for b in slices(batches, "text"):
            batch = Batch(b.column(2).to_pylist())
            other = _place(frequent.value, batch.word) < 0
            word, owner = batch.word[other], batch.owner[other]
            order = np.lexsort((word, owner))
            word, owner = word[order], owner[order]
            new = np.ones(len(word), bool)
            new[1:] = (word[1:] != word[:-1]) | (owner[1:] != owner[:-1])
            at = np.flatnonzero(new)
            own = owner[at]
            d, held = b.column(0).take(pa.array(own)), b.column(1).take(pa.array(own))
            yield pa.RecordBatch.from_arrays([d, pa.array(batch.names[own]), held, pa.array(word[at].view(np.int64)),
                                              pa.array(np.diff(np.append(at, len(word))).astype(np.int32))], names=["d", "th", "held", "w", "n"])

    other = rows.select("d", "held", "text").mapInArrow(seldom, "d long, th long, held boolean, w long, n int")
    by = Window.partitionBy("w")
    seen = other.withColumn("c", F.sum(F.when(F.col("held"), 0).otherwise(F.col("n"))).over(by)).withColumn(
        "first", F.row_number().over(by.orderBy("w")) == 1)
    part = seen.groupBy("d", "th").agg(
        F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("logs"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known"),
        F.sum("n").alias("n"), F.sum((F.col("first") & (F.col("c") > 0)).cast("long")).alias("types"))
    part = stored(part)
    types = (part.agg(F.sum("types")).first()[0] or 0) + int((c > 0).sum()) + (ends > 0)

    tree = stored(suffix_tree(docs))
    logs_c = sc.broadcast(np.log10(c + 1.0))
    end_log = float(np.log10(ends + 1.0))
    out, names = None, ["d", "held", "th", "n_tokens", "other", "n_known", "base", "score"]
    shards = _shards(tree)
    for group in shards:
        shard = tree.filter((F.col("k") == 0) | F.expr("int(ctx & 255)").isin(group)).toPandas() if len(shards) > 1 else tree.toPandas()
        shared = sc.broadcast(Tree(shard))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, group=group, all_=len(shards) == 1) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            ours = np.isin(np.arange(256), group)
            for b in slices(batches, "text"):
                batch = Batch(b.column(2).to_pylist())
                code = batch.grams()
                if all_:
                    logs = shared.value.log10(code)
                else:
                    mine = ours[((code >> _U(8)) & _U(255)).astype(np.int64)]
                    logs = np.zeros(len(code))
                    logs[mine] = shared.value.log10(code[mine])
                total = np.add.reduceat(logs, batch.first) if batch.n else np.zeros(0)
                at = _place(frequent.value, batch.word)
                own = at >= 0
                weight, hits = logs_c.value[at[own]] if own.any() else np.zeros(0), (c[at[own]] > 0) if own.any() else np.zeros(0, bool)
                base = np.bincount(batch.owner[own], weights=weight, minlength=batch.n) + end_log
                known = np.bincount(batch.owner[own], weights=hits, minlength=batch.n).astype(np.int64) + (ends > 0)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(batch.names), pa.array(batch.n_words + 1),
                                                  pa.array(batch.n_words - np.bincount(batch.owner[own], minlength=batch.n)), pa.array(known),
                                                  pa.array(base), pa.array(total)], names=names)

        one = rows.select("d", "held", "text").mapInArrow(run, "d long, held boolean, th long, n_tokens long, other long, n_known long, base double, score double")
        out = one if out is None else out.unionByName(one)
    if len(shards) > 1:  # a row per text and shard: add the shards, then give every copy of a text its row again
        copies = F.count(F.lit(1)) / len(shards)
        same = [F.first(x).alias(x) for x in names[3:7]]
        out = out.groupBy("d", "held", "th").agg(*same, (F.sum("score") / copies).alias("score"), copies.cast("int").alias("copies"))
        out = out.withColumn("_", F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
    # ``part`` adds the copies of a text; a copy's share of it is known from its number of other words
    p = part.select(F.col("d").alias("_d"), F.col("th").alias("_th"), "logs", "known", "n")
    joined = out.join(p, F.col("d").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_th")), "left")
    share = F.coalesce(F.col("other") / F.col("n"), F.lit(0.0))
    base = F.col("base") + F.coalesce("logs", F.lit(0.0)) * share - F.col("n_tokens") * F.lit(float(np.log10(train + types + 1.0)))
    known = F.col("n_known") + F.round(F.coalesce("known", F.lit(0)) * share).cast("long")
    return joined.select(F.col("d").alias("doc_id"), F.col("held").alias("held_out"), "n_tokens", known.alias("n_known"),
                         F.lit(train).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
