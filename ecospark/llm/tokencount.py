"""Token counts (operator 10): exact SentencePiece token counts of every prefix of a text by dynamic programming.

For a normalised chunk ``s`` the table holds, for each prefix ``s[:i]``, its exact token count and its last token.
Exactly one piece ending at ``i`` is consistent with the last token of the prefix before it (see ``pieces``), so
``count[i] = count[i - len(piece)] + cost(piece)``: one pass, no encoding per prefix. Counts of a text's prefixes are
the chunks' tables shifted by the tokens before them; budget and truncation questions are look-ups in them.

Null and empty texts count 0 tokens and 0 bytes. Rows are independent: ties, repeated rows, null ids and extra
columns change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ecospark.llm.pieces import Vocabulary, vocabulary
from ecospark.llm.tables import column, slices

#: chunks (words) remembered by a Python worker before it starts anew
CACHE = 700_000


def chunk_table(vocab: Vocabulary, s: str) -> array:
    """``out[i - 1]``: exact token count of ``s[:i]``."""
    return array("I", vocab.relax(s)[1][1:])


class Counter:
    """Prefix tables of chunks; the totals of chunks seen before come from a bounded cache."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab, self.totals = vocab, {}

    def table(self, chunk: str) -> array:
        return chunk_table(self.vocab, chunk)

    def total(self, text: str) -> int:
        totals, n = self.totals, 0
        for chunk in self.vocab.chunks(text):
            k = totals.get(chunk)
            if k is None:
                if len(totals) >= CACHE:
                    totals.clear()
                k = totals[chunk] = self.vocab.relax(chunk)[1][-1]
            n += k
        return n

    def prefixes(self, text: str) -> array:
        """Exact token count of ``text[:i]`` for i = 1..len(text)."""
        out, before = array("I"), 0
        for chunk in self.vocab.chunks(text):
            t = self.table(chunk)
            out.extend(x + before for x in t)
            before += t[-1]
        return out[1:] if self.vocab.prefix and text else out  # the normaliser's own space is no character of the text

    def longest_prefix(self, text: str, budget: int) -> int:
        """Characters of the longest prefix whose every shorter prefix and itself have at most ``budget`` tokens."""
        counts, top = self.prefixes(text), 0
        for i in range(len(counts)):  # running maximum: adding a letter can lower the count
            top = counts[i] = max(top, counts[i])
        return bisect_right(counts, budget)


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(vocabulary(path))
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` of every whole text, as the library at ``model`` (a path) counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model)
        for b in slices(batches, "text"):
            texts = b.column(1).to_pylist()
            n = [count.total(t) if t else 0 for t in texts]
            size = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()),
                                              pa.array([x > limit for x in n], pa.bool_())], names=names)

    names = ["id", "n_bytes", "n_tokens", "over_limit"]
    out = docs.select(column(docs, id_col, "long").alias("id"), column(docs, text_col, "string").alias("text")).mapInArrow(
        run, "id long, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)


def prefix_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, counts)``: ``counts[i]`` is the exact token count of the text's first ``i + 1`` characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model)
        for b in slices(batches, "text"):
            rows = [list(count.prefixes(t)) if t else [] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.int32()))], names=["id", "counts"])

    return docs.select(column(docs, id_col, "long").alias("id"), column(docs, text_col, "string").alias("text")).mapInArrow(
        run, "id long, counts array<int>").withColumnRenamed("id", id_col)


def truncate(docs: DataFrame, model: str, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text, n_chars)``: the longest prefix of each text up to which the token count stays within ``budget``
    (null stays null), found in the prefix counts without encoding anything again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model)
        for b in slices(batches, "text"):
            texts = b.column(1).to_pylist()
            cut = [t if not t else t[: count.longest_prefix(t, budget)] for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cut, pa.string()),
                                              pa.array([len(t or "") for t in cut], pa.int64())], names=["id", "text", "n_chars"])

    return docs.select(column(docs, id_col, "long").alias("id"), column(docs, text_col, "string").alias("text")).mapInArrow(
        run, "id long, text string, n_chars long").withColumnsRenamed({"id": id_col, "text": text_col})
