"""Operator 11: filter interaction audit over a sparse document-term matrix.

The texts become compressed sparse rows: each shard (a bounded slice of documents) counts its words exactly, word bytes
as keys, and stores them as CSR arrays whose columns are the shard's terms, named by global ids. The global dictionary
numbers every word of the corpus once: its id is a 63-bit hash, the dictionary (one aggregate over the shards' distinct
words) proves that no two words share one, and words that do get ids of their own (negative), which the shards then
take over. So ids are exact, and neither texts nor matrix are shuffled. A document's words are its row's sum, its
distinct words the row's non-zero count. Those two decide filters A and B; flags taken from the text's bytes while it was read
decide C and D, and the smallest ``doc_id`` with the same text decides E.

What an order of filters removes depends only on how many documents fail which set of filters, so the audit folds the
documents to counts per (part, set of failed filters) before anything is shuffled: a source that holds a third of all
rows is 32 counts per task. All orders and steps follow from these cells.

Rows: a null text is an empty one; a null part is the empty string; a null ``doc_id`` has no smaller id and no label;
repeated rows count each, and rows with one id and one text aren't copies of a smaller id; labels that repeat an id
count if any of them is 1. Very long texts are read whole, alone in a shard. Ties have no effect (counts only). Extra
columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ecospark.functions.cols import c
from ecospark.llm.tables import column, lookup, slices, small, small_batches, stored
from ecospark.llm.words import word_hashes

#: bytes of text in a shard (one document at least)
SHARD_BYTES = 4_000_000
UPPER = bytes(range(0x41, 0x5B))
SYMBOLS = b"#$%&*|"
#: bytes that continue a UTF-8 character: the others start one
_CONTINUE = bytes(range(0x80, 0xC0))
#: shards are long rows: pages and row groups are closed by size from the first rows on
_LONG_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.max": "4",
              "parquet.block.size.row.check.max": "4", "parquet.block.size": str(32 << 20), "compression": "zstd"}

_DOCUMENTS = "doc_id array<long>, part array<string>, same array<binary>, upper array<long>, points array<long>, symbols array<boolean>"
_CSR = "terms binary, indptr binary, indices binary, data binary"
_ROWS = "doc_id long, part string, same binary, n_words long, n_distinct long, upper long, points long, symbols boolean"


@dataclass
class Matrix:
    """``dictionary``: (id long, word binary, shards long), one row per word of the corpus. ``shards``: one row per shard with the
    documents' columns as arrays and the CSR arrays as bytes: ``indptr`` (int64), ``indices`` (int32, places in ``terms``), ``data`` (int32)
    and ``terms`` (int64, the dictionary's ids). ``documents``: the documents' columns alone."""

    dictionary: DataFrame
    shards: DataFrame
    documents: DataFrame


def _word_ids(words: list[bytes], bits: int) -> np.ndarray:
    """Non-negative 64-bit hashes of words (words hold no white space, so one text holds them all)."""
    return (word_hashes(np.frombuffer(b" ".join(words), np.uint8)) >> np.uint64(64 - bits)).astype(np.int64)


def _shards(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """One row per slice of documents: distinct words, CSR arrays, flags of the texts."""
    lists = lambda x, kind: pa.array([x], type=pa.list_(kind))
    blob = lambda x: pa.array([x.tobytes()], type=pa.binary())
    for batch in slices(batches, "text", SHARD_BYTES):
        number: dict[bytes, int] = {}
        indices, data, indptr = [], [], [0]
        same, upper, points, symbols = [], [], [], []
        for text in batch.column(2):
            raw = text.as_py() or b""
            counts = Counter(raw.split())  # bytes are split at [\x20\x09-\x0D] exactly
            indices.append(np.fromiter((number.setdefault(w, len(number)) for w in counts), np.int32, len(counts)))
            data.append(np.fromiter(counts.values(), np.int32, len(counts)))
            indptr.append(indptr[-1] + len(counts))
            same.append(hashlib.blake2b(raw, digest_size=16).digest())
            upper.append(len(raw) - len(raw.translate(None, UPPER)))
            points.append(len(raw.translate(None, _CONTINUE)))
            symbols.append(len(raw.translate(None, SYMBOLS)) < len(raw))
        words = list(number)
        yield pa.RecordBatch.from_arrays(
            [lists(batch.column(0).to_pylist(), pa.int64()), lists(batch.column(1).to_pylist(), pa.string()), lists(same, pa.binary()),
             lists(upper, pa.int64()), lists(points, pa.int64()), lists(symbols, pa.bool_()), lists(words, pa.binary()), blob(_word_ids(words, bits)),
             blob(np.array(indptr, np.int64)), blob(np.concatenate(indices)), blob(np.concatenate(data))],
            ["doc_id", "part", "same", "upper", "points", "symbols", "words", "terms", "indptr", "indices", "data"])


def _renamed(batches: Iterator[pa.RecordBatch], other: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """Shards whose terms take the ids of words that share a hash."""
    for batch in batches:
        at = batch.schema.names.index("terms")
        terms = []
        for words, old in zip(batch.column(batch.schema.names.index("words")).to_pylist(), batch.column(at).to_pylist(), strict=True):
            new = np.frombuffer(old, np.int64).copy()
            for i, w in enumerate(words):
                if w in other:
                    new[i] = other[w]
            terms.append(new.tobytes())
        yield batch.set_column(at, "terms", pa.array(terms, type=pa.binary())).drop_columns(["words"])


def matrix(docs: DataFrame, part: str = "source", bits: int = 63) -> Matrix:
    """The corpus as a document-term matrix with one dictionary. The shards are written once; of them only the distinct
    words are shuffled, folded per task first (a word that stands in every text comes once per task)."""
    base = small_batches(docs).select(column(docs, "doc_id", "long"), F.coalesce(column(docs, part, "string"), F.lit("")).alias("part"),
                       column(docs, "text", "string").cast("binary").alias("text"))
    made = stored(base.mapInArrow(lambda b: _shards(b, bits), f"{_DOCUMENTS}, words array<binary>, {_CSR}"), **_LONG_ROWS)
    # the ids are hashes computed beside the words; the dictionary proves them to be unique
    terms = made.mapInArrow(_terms, "id long, word binary, shards long")
    dictionary = stored(terms.groupBy("id", "word").agg(F.sum("shards").alias("shards")))
    shared = stored(dictionary.groupBy("id").agg(F.count(F.lit(1)).alias("words")).filter("words > 1"))
    texts = made.select("doc_id", "part", "same")
    if shared.isEmpty():
        return Matrix(dictionary, made.drop("words"), texts)
    # about n^2 / 2^64 words of n share a hash: a handful, whatever the corpus
    clash = dictionary.join(F.broadcast(shared), "id").select("word").orderBy("word").collect()
    other = {bytes(r["word"]): -1 - i for i, r in enumerate(clash)}
    named = docs.sparkSession.createDataFrame([(w, i) for w, i in other.items()], "word binary, own long")
    dictionary = dictionary.join(F.broadcast(named), "word", "left").select(F.coalesce("own", "id").alias("id"), "word", "shards")
    return Matrix(dictionary, made.mapInArrow(lambda b: _renamed(b, other), f"{_DOCUMENTS}, {_CSR}"), texts)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of a few shards with their ids and how many of these shards hold them."""
    for batch in batches:
        words, terms = (batch.column(batch.schema.names.index(n)) for n in ("words", "terms"))
        flat = pa.table({"id": np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in terms]), "word": words.flatten()})
        folded = flat.group_by(["id", "word"]).aggregate([([], "count_all")])
        yield from folded.rename_columns(["id", "word", "shards"]).to_batches(max_chunksize=100_000)


def _row_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: the sum of its row and its non-zero columns."""
    for batch in batches:
        col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        for i in range(batch.num_rows):
            read = lambda n, kind: np.frombuffer(col[n][i].as_py(), kind)  # noqa: B023, E731
            indptr, terms, indices, data = read("indptr", np.int64), read("terms", np.int64), read("indices", np.int32), read("data", np.int32)
            sums = np.concatenate([[0], np.cumsum(data, dtype=np.int64)])[indptr]
            # rows without a repeated column: a row's distinct ids are its length
            distinct = np.diff(indptr) if len(np.unique(terms)) == len(terms) else np.array(
                [len(np.unique(terms[indices[a:b]])) for a, b in zip(indptr[:-1], indptr[1:], strict=True)], np.int64)
            flat = {n: col[n][i].values for n in ("doc_id", "part", "same", "upper", "points", "symbols")}
            yield pa.RecordBatch.from_arrays(
                [flat["doc_id"], flat["part"], flat["same"], pa.array(np.diff(sums)), pa.array(distinct), flat["upper"], flat["points"],
                 flat["symbols"]], ["doc_id", "part", "same", "n_words", "n_distinct", "upper", "points", "symbols"])


def document_flags(docs: DataFrame, part: str = "source", min_words: int = 200) -> DataFrame:
    """One row per document: doc_id, part, n_words and n_distinct (from the matrix), and the filters it fails as booleans
    ``A`` (fewer than ``min_words`` words), ``B`` (distinct words under half of all), ``C`` (capital letters A-Z over 2 % of
    the characters), ``D`` (a symbol of ``#$%&*|``), ``E`` (the text of a smaller doc_id)."""
    terms = matrix(docs, part)
    rows = terms.shards.mapInArrow(_row_sums, _ROWS)
    flat = terms.documents.select(F.explode(F.arrays_zip("doc_id", "same")).alias("x")).select("x.*")
    firsts = stored(flat.groupBy("same").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")).filter("rows > 1"))
    out = lookup(rows, firsts, "same", "rows")
    return out.select(
        "doc_id", "part", "n_words", "n_distinct", (F.col("n_words") < min_words).alias("A"),
        (100 * F.col("n_distinct") < 50 * F.col("n_words")).alias("B"), (100 * F.col("upper") > 2 * F.col("points")).alias("C"),
        F.col("symbols").alias("D"), F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("E"))


def interactions(flags: DataFrame, filters: Sequence[str], part: str = "part", good: str = "good", toxic: str = "toxic") -> DataFrame:
    """What every order of ``filters`` (boolean columns named by one character, true: the document fails) removes, per part
    and step; ``good`` and ``toxic`` are boolean columns. Zeros are included. Up to six filters (720 orders)."""
    n = len(filters)
    if n > 6 or any(len(f) != 1 for f in filters):
        raise ValueError("interactions takes up to six filters with names of one character")
    bits = F.lit(0)
    for i, f in enumerate(filters):
        bits = bits + F.when(c(f), F.lit(1 << i)).otherwise(F.lit(0))
    count = lambda x: F.count_if(F.coalesce(x, F.lit(False)))
    cells = flags.groupBy(c(part).alias("part"), bits.alias("bits")).agg(F.count(F.lit(1)).alias("n"), count(c(good)).alias("good"), count(c(toxic)).alias("toxic"))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("cells"))  # at most 2^filters each
    orders = ",".join("".join(p) for p in permutations(filters))
    steps = parts.withColumn("filter_order", F.explode(F.split(F.lit(orders), ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    values = F.create_map(*[x for i, f in enumerate(filters) for x in (F.lit(f), F.lit(1 << i))])
    bit = lambda letter: values[letter]
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    before = F.aggregate(F.split(F.substring("filter_order", F.lit(1), F.col("step") - 1), ""), F.lit(0),
                         lambda a, x: a + F.when(x != "", bit(x)).otherwise(F.lit(0)))
    steps = steps.withColumn("bit", bit(letter)).withColumn("before", before)

    def total(keep, value=lambda x: x["n"]) -> Column:
        return F.aggregate(F.filter("cells", keep), F.lit(0).cast("long"), lambda a, x: a + value(x))

    passed = lambda x: x["bits"].bitwiseAND(F.col("before")) == 0
    fails = lambda x: x["bits"].bitwiseAND(F.col("bit")) != 0
    here = lambda x: passed(x) & fails(x)
    # a document that fails s filters is removed by each of them in a 1/s share of all orders
    return steps.select(
        "part", "filter_order", "step", total(lambda x: passed(x) & ~fails(x)).alias("kept"), total(here).alias("removed"),
        total(lambda x: fails(x) & ~passed(x)).alias("redundant"), total(lambda x: x["bits"] == F.col("bit")).alias("unique_fails"),
        total(here, lambda x: x["good"]).alias("good_lost"), total(here, lambda x: x["toxic"]).alias("toxic_lost"),
        total(fails, lambda x: (x["n"] * F.lit(factorial(n)) / F.bit_count(x["bits"])).cast("long")).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """The five filters of :func:`document_flags` in all 120 orders, per part; ``labels`` (doc_id, quality, toxic) covers
    any share of the documents."""
    marks = labels.groupBy(column(labels, "doc_id", "long").alias("_id")).agg(
        F.max(column(labels, "quality", "int") == 1).alias("good"), F.max(column(labels, "toxic", "int") == 1).alias("toxic")).filter("_id IS NOT NULL")
    flags = document_flags(docs, part)
    joined = flags.join(small(stored(marks)), F.col("doc_id") == F.col("_id"), "left")
    return interactions(joined, "ABCDE")
