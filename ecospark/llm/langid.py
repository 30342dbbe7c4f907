"""Language ID (operator 7): segmentation-marginalised unigrams over a fixed public piece vocabulary.

A language is a distribution over the vocabulary's pieces; the probability of a word is the sum, over all ways to
cut it into pieces, of the product of their probabilities (forward algorithm). A text's log-probability is the sum
over its words (lower-cased runs of letters, a visible space in front); the prediction is the most probable language
(ties: the alphabetically first) and ``score`` its posterior under a uniform prior.

Training: expectation-maximisation (forward-backward counts) over the words of a sample of the labelled rows whose
crc32(doc_id as text) mod 5 isn't 0. The sample is bounded: about ``SAMPLE`` rows per language, taken by a hash of
the row's id. Prediction reads every whole text. Characters outside the vocabulary cost the same in all languages.

Null texts and texts without a letter are ``und`` with score 0. Rows with a null ``lang`` (or null id: its crc32 is
null) don't teach. Without any labelled row every text is ``und``. Rows are predicted one by one: repeated rows, null
ids and extra columns change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ecospark.llm.pieces import SPACE, normal_pieces
from ecospark.llm.tables import column, kept, slices, small, small_batches, stored


#: runs of letters, with number signs (fractions, superscripts, Roman numerals) that ``\\w`` also holds
WORDLIKE = re.compile(r"[^\W\d_]+")
#: labelled rows per language that teach (expected number); a documented bound on a sample of labelled rows
SAMPLE = 2000
ROUNDS = 3
#: words remembered within a task before it starts anew
CACHE = 300_000
#: longest words taken through the arrays; longer ones are scaled letter by letter, in training and prediction
LONG = 40
#: pseudo-count of every piece; probability of a character outside the vocabulary
PRIOR, OTHER = 0.05, 1e-7


class Lattice:
    """The pieces as a letter tree in arrays: all words of a batch are walked together."""

    def __init__(self, path: str) -> None:
        self.pieces = normal_pieces(path)
        inside = sorted({x for p in self.pieces if len(p) > 1 for x in p})
        alone = sorted({x for p in self.pieces for x in p} - set(inside))
        self.letter = {x: i + 1 for i, x in enumerate([*inside, *alone])}  # 0: any other character
        self.width = len(inside) + 1
        heads = {"": 0}
        for p in self.pieces:
            for n in range(1, len(p)):
                heads.setdefault(p[:n], len(heads))
        inner, leaves = len(heads), {}
        for p in self.pieces:
            if p not in heads:
                leaves[p] = inner + len(leaves)
        node = heads | leaves
        #: next node by (inner node, letter of longer pieces), first node by any letter; the last node is the dead end
        self.dead, self.inner = len(node), inner
        self.table = np.full((inner, self.width), self.dead, dtype=np.int32)
        self.first = np.full(len(self.letter) + 1, self.dead, dtype=np.int32)
        for p, k in node.items():
            if len(p) > 1:
                self.table[node[p[:-1]], self.letter[p[-1]]] = k
            elif p:
                self.first[self.letter[p]] = k
        #: the piece that ends at a node (-1: none)
        self.piece = np.full(len(node) + 1, -1, dtype=np.int32)
        for i, p in enumerate(self.pieces):
            self.piece[node[p]] = i
        self.longest = max(map(len, self.pieces), default=1)

    def codes(self, words: list[str]) -> np.ndarray:
        """Letters of words of one length, words x letters."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(words), -1)
        known, place = np.unique(points, return_inverse=True)
        return np.array([self.letter.get(chr(x), 0) for x in known], dtype=np.int32)[place].reshape(points.shape)

    def steps(self, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Every piece of the words: (start, end, word rows, piece ids; -1 for a lone character outside the
        vocabulary), in order of the start."""
        n, next_ = codes.shape[1], np.where(codes < self.width, codes, 0)
        for start in range(n):
            rows = np.arange(len(codes))
            at = self.first[codes[:, start]]
            for end in range(start + 1, min(n, start + self.longest) + 1):
                if end > start + 1:
                    at = self.table[at, next_[rows, end - 1]]
                piece = self.piece[at]
                hit = np.flatnonzero(piece >= 0) if end > start + 1 else np.arange(len(rows))
                if len(hit):
                    yield start, end, rows[hit], piece[hit]
                alive = at < self.inner
                rows, at = rows[alive], at[alive]
                if not len(rows):
                    break

    def forward(self, codes: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Summed probabilities of every prefix, words x (letters + 1) x languages; ``p``: (pieces + 1) x languages,
        the last row for other characters."""
        out = np.zeros((len(codes), codes.shape[1] + 1, p.shape[1]))
        out[:, 0] = 1.0
        for start, end, rows, piece in self.steps(codes):
            out[rows, end] += out[rows, start] * p[piece]
        return out

    def log_words(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """Log-probabilities, words x languages."""
        out = np.empty((len(words), p.shape[1]))
        sizes = np.array([len(w) for w in words])
        for n in np.unique(sizes).tolist():
            place = np.flatnonzero(sizes == n)
            if n > LONG:
                for i in place.tolist():
                    out[i] = self._log_long(words[i], p)
                continue
            for cut in range(0, len(place), 20_000):
                part = place[cut : cut + 20_000]
                out[part] = np.log(self.forward(self.codes([words[i] for i in part.tolist()]), p)[:, -1])
        return out

    def _log_long(self, word: str, p: np.ndarray) -> np.ndarray:
        """One long word: the forward sums of a sliding window of positions, rescaled as they go."""
        codes = self.codes([word])[0]
        next_ = np.where(codes < self.width, codes, 0)
        ahead = np.zeros((self.longest + 1, p.shape[1]))
        ahead[0], scale = 1.0, np.zeros(p.shape[1])
        for start in range(len(codes)):
            here, at = ahead[0], 0
            for k in range(min(self.longest, len(codes) - start)):
                at = self.table[at, next_[start + k]] if k else self.first[codes[start]]
                if self.piece[at] >= 0 or k == 0:
                    ahead[k + 1] += here * p[self.piece[at]]
                if at >= self.inner:
                    break
            ahead = np.vstack([ahead[1:], np.zeros((1, p.shape[1]))])
            top = ahead.max(axis=0)
            ahead, scale = ahead / top, scale + np.log(top)
        return np.log(ahead[0]) + scale

    def expected(self, words: list[str], weight: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected number of uses of every piece in the words (each ``weight`` times) under one language."""
        total = np.zeros(len(self.pieces))
        sizes = np.array([len(w) for w in words])
        for n in np.unique(sizes[sizes <= LONG]).tolist():
            place = np.flatnonzero(sizes == n)
            for cut in range(0, len(place), 20_000):
                part = place[cut : cut + 20_000]
                codes = self.codes([words[i] for i in part.tolist()])
                ahead = self.forward(codes, p)[:, :, 0]
                arcs = list(self.steps(codes))
                behind = np.zeros_like(ahead)
                behind[:, -1] = weight[part] / ahead[:, -1]
                for start, end, rows, piece in reversed(arcs):
                    use = p[piece, 0] * behind[rows, end]
                    behind[rows, start] += use
                    known = piece >= 0
                    np.add.at(total, piece[known], (ahead[rows, start] * use)[known])
        for i in np.flatnonzero(sizes > LONG).tolist():
            self._expect_long(words[i], float(weight[i]), p, total)
        return total

    def _expect_long(self, word: str, weight: float, p: np.ndarray, total: np.ndarray) -> None:
        """Adds one long word's expected uses; forward and backward sums are kept as logarithms, so that neither leaves the
        range of doubles however long the word is."""
        codes = self.codes([word])
        n, arcs = codes.shape[1], [(a, z, int(piece[0]), float(p[piece[0], 0])) for a, z, _, piece in self.steps(codes)]
        log = np.full(n + 1, -np.inf)
        log[0] = 0.0
        for a, z, _, q in arcs:  # in order of the start: all sums up to the start are complete
            log[z] = np.logaddexp(log[z], log[a] + np.log(q))
        back = np.full(n + 1, -np.inf)
        back[n] = 0.0
        for a, z, piece, q in reversed(arcs):
            way = np.log(q) + back[z]
            back[a] = np.logaddexp(back[a], way)
            if piece >= 0:
                total[piece] += weight * np.exp(log[a] + way - log[n])


def lattice(path: str) -> Lattice:
    return kept(Lattice, path)


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters (Unicode category L)."""
    words = WORDLIKE.findall(text.lower()) if text else []
    if all(map(str.isalpha, words)):
        return words
    return [run for w in words for run in ([w] if w.isalpha() else "".join(x if x.isalpha() else " " for x in w).split())]


def teaches(doc_id: Column, lang: Column) -> Column:
    return lang.isNotNull() & (F.crc32(doc_id.cast("string")) % 5 != 0)


def _counts(docs: DataFrame) -> DataFrame:
    """``(lang, word, n)`` of the sampled teaching rows."""
    rows = docs.select(column(docs, "doc_id", "long").alias("id"), column(docs, "lang", "string").alias("lang"),
                       column(docs, "text", "string").alias("text")).filter(teaches(F.col("id"), F.col("lang")))
    # one row per language, counted before it is broadcast: the texts stay where they are
    share = small(stored(rows.groupBy("lang").agg((F.lit(float(SAMPLE)) / F.count(F.lit(1))).alias("share"))))
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    taken = rows.withColumn("draw", draw).join(share, "lang").filter("draw < share").select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        for b in slices(batches, "text"):
            count: Counter = Counter()
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                count.update((lang, SPACE + w) for w in words_of(text))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in count], pa.string()), pa.array([k[1] for k in count], pa.string()),
                                              pa.array(list(count.values()), pa.int64())], names=["lang", "word", "n"])

    return taken.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, model: str) -> tuple[list[str], np.ndarray]:
    """Languages and their piece probabilities ((pieces + 1) x languages)."""
    counts = stored(_counts(docs))
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
    n_pieces = len(normal_pieces(model))
    p = np.full((n_pieces + 1, len(langs)), 1.0 / n_pieces)
    p[-1] = OTHER
    for _ in range(ROUNDS if langs else 0):

        def run(batches: Iterator[pa.RecordBatch], p: np.ndarray = p) -> Iterator[pa.RecordBatch]:
            lat = lattice(model)
            for b in batches:
                lang = np.array(b.column(0).to_pylist(), dtype=object)
                words, n = np.array(b.column(1).to_pylist(), dtype=object), b.column(2).to_numpy(zero_copy_only=False).astype(float)
                for i, name in enumerate(langs):
                    own = np.flatnonzero(lang == name)
                    if len(own):
                        uses = lat.expected(words[own].tolist(), n[own], p[:, i : i + 1])
                        hit = np.flatnonzero(uses)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), i, dtype=np.int32)), pa.array(hit.astype(np.int32)),
                                                          pa.array(uses[hit])], names=["lang", "piece", "uses"])

        uses = np.full((n_pieces, len(langs)), PRIOR)
        # at most languages x pieces rows: the model itself
        for r in counts.mapInArrow(run, "lang int, piece int, uses double").groupBy("lang", "piece").agg(F.sum("uses").alias("uses")).collect():
            uses[r["piece"], r["lang"]] += r["uses"]
        p = np.vstack([uses / uses.sum(axis=0), np.full((1, len(langs)), OTHER)])
    return langs, p


class Scorer:
    """Log-probabilities of words under all languages, with a bounded cache."""

    def __init__(self, path: str, p: np.ndarray) -> None:
        self.lattice, self.p, self.known = lattice(path), p, {}
        self.rows = np.zeros((0, p.shape[1]))

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Number of words and log-probabilities (texts x languages)."""
        split = [words_of(t) for t in texts]
        fresh = list({w for ws in split for w in ws if w not in self.known})
        if len(self.known) + len(fresh) > CACHE:
            self.known, self.rows = {}, self.rows[:0]
            fresh = list({w for ws in split for w in ws})
        base = len(self.known)
        self.known.update((w, base + i) for i, w in enumerate(fresh))
        if fresh:
            self.rows = np.vstack([self.rows[:base], self.lattice.log_words([SPACE + w for w in fresh], self.p)])
        n = np.array([len(ws) for ws in split])
        out = np.zeros((len(texts), self.p.shape[1]))
        for i, ws in enumerate(split):
            if ws:
                out[i] = self.rows[[self.known[w] for w in ws]].sum(axis=0)
        return n, out


def _predict(n: np.ndarray, logs: np.ndarray, langs: list[str]) -> tuple[list[str], np.ndarray]:
    if not langs:
        return ["und"] * len(n), np.zeros(len(n))
    best = logs.argmax(axis=1)
    score = 1.0 / np.exp(np.maximum(logs - logs.max(axis=1, keepdims=True), -700)).sum(axis=1)
    return [langs[b] if k else "und" for b, k in zip(best.tolist(), n.tolist(), strict=True)], np.where(n > 0, score, 0.0)


def identify(docs: DataFrame, model: str, keep_rows: bool = False) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every document; with ``keep_rows`` ``(_row, lang_pred, score)``, the
    whole row in a struct."""
    langs, p = fit(small_batches(docs), model)
    shared = docs.sparkSession.sparkContext.broadcast(p)  # languages x pieces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model, shared.value)
        for b in slices(batches, "_text", 4_000_000):
            lang, score = _predict(*scorer.texts(b.column(1).to_pylist()), langs)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                             names=["_row", "lang_pred", "score"])

    carried = F.struct("*") if keep_rows else column(docs, "doc_id", "long")
    rows = docs.select(carried.alias("_row"), column(docs, "text", "string").alias("_text"))
    out = rows.mapInArrow(run, T.StructType([rows.schema["_row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    if keep_rows:
        return out
    held = F.coalesce(F.crc32(F.col("_row").cast("string")) % 5 == 0, F.lit(False))
    return out.select(F.col("_row").alias("doc_id"), held.alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, model: str, least: float = 0.5) -> DataFrame:
    """The rows whose language is identified with a posterior of at least ``least``, all columns as they are."""
    return identify(docs, model, keep_rows=True).filter((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("_row.*")
