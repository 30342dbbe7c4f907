"""SentencePiece encoding and decoding (operator 9) as a weighted finite-state transducer.

Three machines are compiled from a model file and composed with each input on the fly:

* the *normaliser* rewrites spaces and puts one in front of a text (``Vocabulary.normal``),
* the *lexicon* maps every piece to its id, and every character outside the vocabulary to the ids of its UTF-8
  bytes (byte fallback),
* the *grammar* weighs piece sequences in the tropical semiring: a unigram model's arcs cost ``-score``; a BPE
  model's state is the last piece, and an arc to the next piece exists (at cost 1 for each id) only if the merges
  leave the two side by side. A BPE input therefore has exactly one accepted path, the library's encoding.

The composition of an input is an acyclic graph over (position, grammar state); relaxing its arcs in order of
position gives the tropical shortest path. The input is first cut where no lexicon arc can span the cut, so paths
of chunks concatenate, and a chunk seen before is answered from a bounded cache.

Null and empty texts have no ids and decode to the empty text. Rows are independent: ties, repeated rows, null ids
and extra columns change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ecospark.llm.pieces import BPE, SPACE, Vocabulary, vocabulary
from ecospark.llm.tables import column, slices

CACHE = 300_000


class Transducer:
    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab, self.paths = vocab, {}
        #: what an id is on the output tape: its piece's bytes, or the byte it stands for
        self.output = [bytes([vocab.byte_of[i]]) if i in vocab.byte_of else t.encode("utf-8", "surrogatepass") for i, t in enumerate(vocab.text)]
        low = min(vocab.score.values(), default=0.0)
        self.fallback = 10.0 - low  # a unigram model's cost of a character outside the vocabulary, as the library's

    def arcs(self, s: str, at: int) -> list[tuple[str, float]]:
        """Arcs of a unigram model leaving ``at``: piece and weight."""
        v = self.vocab
        pieces = [s[at:end] for end in range(at + 1, min(len(s), at + v.longest) + 1)]
        out = [(piece, -v.score[piece]) for piece in pieces if piece in v.ids]
        return out if pieces[0] in v.ids else [(pieces[0], self.fallback), *out]

    def shortest(self, s: str) -> tuple[int, ...]:
        """Ids on the shortest path of one chunk."""
        v = self.vocab
        if v.kind == BPE:  # each position is reached in one grammar state: its weight is the path's number of ids
            last, out, at = v.relax(s)[0], [], len(s)
            while at:
                out.append(last[at])
                at -= len(last[at])
            return tuple(v.ids[p] for p in reversed(out)) if all(p in v.ids for p in out) else tuple(
                i for p in reversed(out) for i in v.piece_ids(p))
        best: list[tuple[float, str]] = [(0.0, "")] + [(float("inf"), "")] * len(s)
        for at in range(len(s)):
            for piece, cost in self.arcs(s, at):
                there, weight = at + len(piece), best[at][0] + cost
                if weight < best[there][0]:
                    best[there] = (weight, piece)
        out, at = [], len(s)
        while at:
            out.append(best[at][1])
            at -= len(best[at][1])
        return tuple(i for p in reversed(out) for i in v.piece_ids(p))

    def path(self, chunk: str) -> array:
        got = self.paths.get(chunk)
        if got is None:
            if len(self.paths) >= CACHE:
                self.paths.clear()
            got = self.paths[chunk] = array("I", self.shortest(chunk))
        return got

    def encode(self, text: str) -> array:
        out, paths = array("I"), self.paths
        if self.vocab.kind == BPE:
            for chunk in self.vocab.chunks(text):
                out += paths.get(chunk) or self.path(chunk)
        elif text:
            out.extend(self.shortest(self.vocab.normal(text)))
        return out

    def decode(self, ids: array) -> str:
        """The inverse machine: bytes of pieces and fallback bytes, visible spaces back, the front space gone.
        Bytes that aren't UTF-8 become U+FFFD."""
        text = b"".join(map(self.output.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.vocab.prefix and text.startswith(" ") else text


_MACHINES: dict[str, Transducer] = {}


def machine(path: str) -> Transducer:
    if path not in _MACHINES:
        _MACHINES[path] = Transducer(vocabulary(path))
    return _MACHINES[path]


def _little(ids: array) -> bytes:
    return ids.tobytes() if ids.itemsize == 4 else array("I", ids).tobytes()


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids array<int>)`` of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(model)
        for b in slices(batches, "text"):
            ids = [m.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([list(x) for x in ids], pa.list_(pa.int32()))], names=["id", "ids"])

    return docs.select(column(docs, id_col, "long").alias("id"), column(docs, text_col, "string").alias("text")).mapInArrow(
        run, "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``(id, text)`` of ids; a null array gives the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(model)
        for b in batches:
            texts = [m.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return encoded.select(column(encoded, id_col, "long").alias("id"), column(encoded, ids_col, "array<int>").alias("ids")).mapInArrow(
        run, "id long, text string").withColumnsRenamed({"id": id_col, "text": text_col})


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, ids_crc32, text_crc32, restored)``: digest of the ids (unsigned, little-endian 32-bit ids)
    and of the decoded text (UTF-8), and whether decoding gave the text back (visible spaces read as spaces)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(model)
        for b in slices(batches, "text"):
            n, crc, back, same = [], [], [], []
            for t in b.column(1).to_pylist():
                ids = m.encode(t or "")
                text = m.decode(ids)
                n.append(len(ids))
                crc.append(zlib.crc32(_little(ids)))
                back.append(zlib.crc32(text.encode("utf-8", "surrogatepass")))
                same.append(text == (t or "").replace(SPACE, " "))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()),
                                              pa.array(back, pa.int64()), pa.array(same, pa.bool_())], names=names)

    names = ["id", "n_tokens", "ids_crc32", "text_crc32", "restored"]
    return docs.select(column(docs, id_col, "long").alias("id"), column(docs, text_col, "string").alias("text")).mapInArrow(
        run, "id long, n_tokens long, ids_crc32 long, text_crc32 long, restored boolean").withColumnRenamed("id", id_col)
