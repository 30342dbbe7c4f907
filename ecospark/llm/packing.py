"""Packing (operator 3): minimum bin slack over token sequences.

Documents become token ids (one end id after each). A document of ``window`` ids or more gives full windows straight
away; what is left of it is a *piece* shorter than a window. Pieces are dealt to packing groups by a hash of their
row (group count in proportion to the pieces, so a group's size doesn't grow with the corpus) and each group is
filled window by window: a bitset subset-sum dynamic programme over the remaining multiset of lengths finds the sum
closest to the capacity, the counts of each length are backtracked from the stages of the programme, and pieces of
those lengths go into the window. Pieces may be cut: what a window still lacks, and a group's last sequences, which
are made powers of two long and so need no padding.

Null and empty texts are one piece holding the end id alone. Rows are packed one by one, so ties, repeated rows and
null ids are ordinary; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from unicodedata import normalize

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ecospark.llm.tables import column, kept, release, slices, small_batches, stored
from ecospark.llm.words import mix, word_spans

#: words remembered within a task before they are learnt anew, and places of their table (about 20 MB with their ids)
CACHE, SLOTS = 300_000, 1 << 19
#: new words that are merged at a time
BATCH = 1 << 16
#: ASCII punctuation after a word is a token run of its own; signs of contractions and special strings aren't cut off
TAIL = ".,;:!?&$*#%)]}\"/_-"
#: bytes of a word that fit its key; longer ones are remembered by a dictionary
KEY = 16
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)  # of the first bytes
#: pieces per packing group, and groups per task (expected)
GROUP, GROUPS_PER_TASK = 3000, 4


class Merges:
    """The merges of a byte-level BPE file with word-end symbols, over many words at once.

    Words of one length stand side by side, one column each. A round merges in every word its best pair (lowest rank,
    leftmost), so those that still merge keep a common length; a word that holds no pair any more is done."""

    NONE = 1 << 30  # more than any rank * 64 + place

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, pairs = model["vocab"], [tuple(x.split(" ") if isinstance(x, str) else x) for x in model["merges"]]
        seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves; the rest follows
        sign = {x: chr(x) for x in seen} | {x: chr(256 + i) for i, x in enumerate(x for x in range(256) if x not in seen)}
        self.inner = np.array([vocab[sign[x]] for x in range(256)], np.uint32)
        self.last = np.array([vocab[sign[x] + "</w>"] for x in range(256)], np.uint32)
        if len(vocab) > 1 << 16 or len(pairs) >= self.NONE >> 6:
            raise ValueError("too many symbols for the table")
        self.made = np.array([vocab[a + b] for a, b in pairs], np.uint32)
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.uint32)
        self.bits = max(10, (4 * len(keys)).bit_length())
        self.keys, self.ranks = np.zeros(1 << self.bits, np.uint32), np.full(1 << self.bits, -1, np.int32)
        slots = self._slot(keys)
        for i, (k, at) in enumerate(zip(keys.tolist(), slots.tolist(), strict=True)):
            while self.ranks[at] >= 0 and self.keys[at] != k:
                at = (at + 1) & (1 << self.bits) - 1
            self.keys[at], self.ranks[at] = k, i  # of equal pairs the last one counts, as in the library

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(2654435769) >> np.uint32(32 - self.bits)).astype(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``64 * rank`` of the pairs, ``NONE`` where there is no such merge."""
        keys = (a << np.uint32(16) | b).ravel()
        at = self._slot(keys)
        found = self.ranks[at]
        out = np.where(found >= 0, found << 6, self.NONE)
        open_ = np.flatnonzero((found >= 0) & (self.keys[at] != keys))
        while len(open_):  # another pair stands there: the next place
            at[open_] = (at[open_] + 1) & (1 << self.bits) - 1
            found = self.ranks[at[open_]]
            out[open_] = np.where(found >= 0, found << 6, self.NONE)
            open_ = open_[(found >= 0) & (self.keys[at[open_]] != keys[open_])]
        return out.reshape(a.shape)

    def encode(self, letters: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words as the normaliser leaves them, a column of bytes each, of ``size`` bytes (1 to 64): the number of every word's ids,
        and all ids one after another."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for n in np.unique(size).tolist():
            which = np.flatnonzero(size == n)
            ids = self.inner[letters[:n, which]]
            ids[-1] = self.last[letters[n - 1, which]]
            self._merge(ids, which, done)
        count = np.zeros(len(size), np.int64)
        for which, ids in done:
            count[which] = len(ids)
        begin, out = np.cumsum(count) - count, np.empty(int(count.sum()), np.uint32)
        for which, ids in done:
            out[begin[which] + np.arange(len(ids))[:, None]] = ids
        return count, out

    def _merge(self, ids: np.ndarray, which: np.ndarray, done: list[tuple[np.ndarray, np.ndarray]]) -> None:
        places = np.arange(len(ids), dtype=np.int32)[:, None]
        rank = self._rank(ids[:-1], ids[1:]).astype(np.int32) + places[:-1]
        while len(ids) > 1:
            n = len(ids)
            best = rank.min(axis=0)
            more = best < self.NONE >> 1
            if not more.all():
                end, go = np.flatnonzero(~more), np.flatnonzero(more)
                done.append((which[end], ids[:, end]))
                ids, rank, which, best = ids[:, go], rank[:, go], which[go], best[go]
            if not len(which):
                return
            at, new, column = best & 63, self.made[best >> 6], np.arange(len(which))
            ids = np.where(places[: n - 1] < at, ids[:-1], ids[1:])
            ids[at, column] = new
            rank = np.where(places[: n - 2] < at, rank[:-1], rank[1:] - 1)  # a place moves left by one
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < n - 2)
            rank[at[left] - 1, left] = self._rank(ids[at[left] - 1, left], new[left]) + at[left] - 1
            rank[at[right], right] = self._rank(new[right], ids[at[right] + 1, right]) + at[right]
        done.append((which, ids))


class Table:
    """Numbers of words by their bytes: up to ``KEY`` bytes as two exact 64-bit halves in an open-addressed table."""

    def __init__(self, slots: int = SLOTS) -> None:
        self.keys, self.number, self.last = np.zeros((2, slots), np.uint64), np.full(slots, -1, np.int32), slots - 1

    def reserve(self, words: int) -> None:
        """Room for ``words`` in all."""
        if 5 * words > 4 * len(self.number):
            keys, number = self.keys[:, self.number >= 0], self.number[self.number >= 0]
            self.__init__(1 << (2 * words).bit_length())
            self.add(keys, number)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (mix(key[0] ^ key[1] * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(self.last)).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The numbers of ``key`` (2 x words), -1 for one that isn't there."""
        out, which, at = np.empty(key.shape[1], np.int32), np.arange(key.shape[1]), self._slot(key)
        while len(which):
            got = self.number[at]
            other = (got >= 0) & ((self.keys[0, at] != key[0, which]) | (self.keys[1, at] != key[1, which]))
            out[which] = got
            which, at = which[other], (at[other] + 1) & self.last
        return out

    def add(self, key: np.ndarray, number: np.ndarray) -> None:
        """New and distinct ``key``."""
        which, at = np.arange(key.shape[1]), self._slot(key)
        while len(which):
            free = self.number[at] < 0
            self.number[at[free]] = number[which[free]]  # of those that want one place one gets it
            mine = self.number[at] == number[which]
            self.keys[:, at[mine]] = key[:, which[mine]]
            which, at = which[~mine], (at[~mine] + 1) & self.last


class WordTokenizer:
    """A ``tokenizers`` file whose normaliser lower-cases and whose pre-tokenizer drops white space and keeps letters and
    punctuation apart: the ids of a text are the ids of its space-separated words one after another, and a word's
    are those of its stem and of the punctuation after it. Words seen before in the task cost a look-up, all words of many texts at
    once; new stems of Latin letters go through :class:`Merges` together, all other words to the library. So do whole texts
    that could hold a special string. ``words=False`` encodes whole texts."""

    def __init__(self, path: str, words: bool = True) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.library, self.words = Tokenizer.from_file(path), words
        if words:
            self.merges = Merges(path)
            self.ends = np.array([(self.library.id_to_token(i) or "").endswith("</w>") for i in range(self.library.get_vocab_size())])
            self.tail = np.full(256, -1, np.int64)  # ids of punctuation
            for x, ids in zip(TAIL, self._encode(list(TAIL)), strict=True):
                if len(ids) == 4:
                    self.tail[ord(x)] = int.from_bytes(ids, "little")
        self.forget()

    def forget(self) -> None:
        """Give up what was remembered; the end of a task."""
        self.table: Table | None = None
        self.long: dict[bytes, int] = {}
        self.begin, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)  # of word i: ids[begin[i]:begin[i + 1]]

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, stems: list[str]) -> list[bytes]:
        """Ids of words made of letters, many to a text, told apart by their word-end tokens."""
        out: list[bytes] = []
        parts = [stems[i : i + 500] for i in range(0, len(stems), 500)]
        for part, e in zip(parts, self.library.encode_batch_fast([" ".join(x) for x in parts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype="<u4")
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(part) and cut[-1] == len(ids):
                raw, at = ids.tobytes(), (4 * cut).tolist()
                out += [raw[a:z] for a, z in zip([0, *at[:-1]], at, strict=True)]
            else:  # a letter that lower-cases to more than a letter
                out += self._encode(part)
        return out

    def _others(self, words: list[bytes]) -> list[bytes]:
        """Ids of words by the library."""
        texts = b"\n".join(words).decode("utf-8", "surrogatepass").split("\n") if words else []
        stems = [t.rstrip(TAIL) for t in texts]
        # what is encoded by itself: letters, unless the normaliser ends them in a mark, which joins the punctuation
        plain = [s if s.isalpha() and normalize("NFC", s).lower()[-1].isalpha() else t for s, t in zip(stems, texts, strict=True)]
        tails = [t[len(s) :] for s, t in zip(plain, texts, strict=True)]
        new = set(plain).union(tails)
        letters, other = [x for x in new if x.isalpha()], [x for x in new if not x.isalpha()]
        known = dict(zip(letters, self._letters(letters), strict=True))
        known.update(zip(other, self._encode(other), strict=True))
        return [known[s] + known[t] for s, t in zip(plain, tails, strict=True)]

    def _append(self, count: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Numbers of new words with so many of ``ids`` each."""
        first = len(self.begin) - 1
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(count)])
        self.ids = np.concatenate([self.ids, ids])
        return np.arange(first, len(self.begin) - 1, dtype=np.int32)

    def _append_others(self, words: list[bytes]) -> np.ndarray:
        found = self._others(words)
        return self._append(np.array([len(x) // 4 for x in found], np.int64), np.frombuffer(b"".join(found), "<u4"))

    def _learn(self, key: np.ndarray, size: np.ndarray) -> None:
        """Distinct new words of up to ``KEY`` bytes."""
        letters = np.ascontiguousarray(key.T).view(np.uint8).T  # a column a word
        # a-z, or the two bytes of one of the letters U+00DF to U+00FF: the normaliser leaves these as they are, alone and side by side
        low = (letters >= 0x9F) & (letters <= 0xBF) & (letters != 0xB7)
        lead = letters == 0xC3
        good = (letters >= 0x61) & (letters <= 0x7A)
        good[:-1] |= lead[:-1] & low[1:]
        good[1:] |= lead[:-1] & low[1:]
        stem = np.logical_and.accumulate(good, axis=0).sum(axis=0)
        after = self.tail[letters[np.minimum(stem, KEY - 1), np.arange(len(size))]]
        simple = (stem > 0) & ((stem == size) | ((stem == size - 1) & (after >= 0)))
        which = np.flatnonzero(simple)
        count, ids = self.merges.encode(letters[:, which], stem[which])
        tailed = np.flatnonzero(stem[which] < size[which])
        ids = np.insert(ids, np.cumsum(count)[tailed], after[which[tailed]].astype(np.uint32))
        count[tailed] += 1
        self.table.add(key[:, which], self._append(count, ids))
        rest = np.flatnonzero(~simple)
        raw = np.ascontiguousarray(letters[:, rest].T).tobytes()
        self.table.add(key[:, rest], self._append_others([raw[KEY * i : KEY * i + n] for i, n in enumerate(size[rest].tolist())]))

    def _numbers(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The number of every word of ``data`` (which ends in ``KEY`` bytes more); new words are learnt."""
        if self.table is None or len(self.begin) > CACHE:
            self.forget()
            self.table = Table()
        halves = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))  # the eight bytes from each place on
        key = np.stack([halves[start] & _MASK[np.minimum(size, 8)], halves[start + 8] & _MASK[np.clip(size - 8, 0, 8)]])
        zero = np.flatnonzero(data == 0)  # one in a word would look like its end
        short = np.flatnonzero((size <= KEY) & (np.searchsorted(zero, start) == np.searchsorted(zero, start + size)))
        out = np.full(len(start), -1, np.int32)
        key = key[:, short]
        out[short] = found = self.table.find(key)
        fresh = np.flatnonzero(found < 0)
        if len(fresh):
            fresh = fresh[np.lexsort(key[:, fresh])]
            same = (key[:, fresh[1:]] == key[:, fresh[:-1]]).all(axis=0)
            fresh = fresh[np.concatenate([[True], ~same])]
            self.table.reserve(len(self.begin) + len(fresh))
            for first in range(0, len(fresh), BATCH):
                self._learn(key[:, fresh[first : first + BATCH]], size[short[fresh[first : first + BATCH]]])
            out[short] = self.table.find(key)
        rest = np.flatnonzero(out < 0)
        if len(rest):
            raw, long = data.tobytes(), self.long
            words = [raw[a : a + n] for a, n in zip(start[rest].tolist(), size[rest].tolist(), strict=True)]
            if new := list(set(words).difference(long)):
                long.update(zip(new, self._append_others(new).tolist(), strict=True))
            out[rest] = [long[w] for w in words]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of every text."""
        if not self.words:
            return self._encode(texts)
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        special = [i for i, t in enumerate(raw) if b"<|" in t]  # A-Z can't be lower-cased first inside a special string
        library = dict(zip(special, self._encode([texts[i] for i in special]), strict=True))
        raw = [b"" if i in library else t for i, t in enumerate(raw)]
        data = np.frombuffer(b" ".join([*raw, bytes(KEY)]).lower(), np.uint8)
        start, end = word_spans(data[:-KEY])
        number = self._numbers(data, start, end - start)
        begin, count = self.begin[number], self.begin[number + 1] - self.begin[number]
        upto = np.concatenate([[0], np.cumsum(count)])
        ids = self.ids[np.repeat(begin - upto[:-1], count) + np.arange(upto[-1])].astype("<u4").tobytes()
        # the ids of a text are those of the words that start before its end
        at = [0, *(4 * upto[np.searchsorted(start, np.cumsum([len(t) + 1 for t in raw]))]).tolist()]
        return [library.get(i, ids[a:z]) for i, (a, z) in enumerate(zip(at[:-1], at[1:], strict=True))]


def word_tokenizer(path: str, words: bool = True) -> WordTokenizer:
    return kept(WordTokenizer, path, words)


def tokenised(docs: DataFrame, tokenizer: str, end_id: int, window: int, words: bool = True, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """``(id, tokens binary, n, slot, row)``: little-endian 32-bit ids with the end id, their number, a number for the
    first of the row's full windows and one for the row (both unique: task, then place in it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, end = word_tokenizer(tokenizer, words), np.array([end_id], dtype="<u4").tobytes()
        slot = row = TaskContext.get().partitionId() << 33
        for b in slices(batches, "text"):
            ids = [x + end for x in t.encode([x or "" for x in b.column(1).to_pylist()])]
            n = np.array([len(x) // 4 for x in ids], dtype=np.int64)
            full = n // window
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array(n), pa.array(slot + np.cumsum(full) - full),
                                              pa.array(row + np.arange(len(n)))], names=["id", "tokens", "n", "slot", "row"])
            slot, row = slot + int(full.sum()), row + len(n)
        t.forget()
        release()

    return small_batches(docs).select(column(docs, id_col, "long").alias("id"), column(docs, text_col, "string").alias("text")).mapInArrow(
        run, "id long, tokens binary, n long, slot long, row long")


# ---------------------------------------------------------------- minimum bin slack


def closest(lengths: list[int], stock: dict[int, list[int]], capacity: int) -> dict[int, int]:
    """The multiset of ``lengths`` (at most ``stock`` holds of each) whose sum is closest to ``capacity`` from below.

    Bit s of ``reach`` is set when some multiset sums to s. Lengths are added one after another (largest first,
    counts in powers of two), the bitset of every stage is kept, and the counts are read back from the last stage
    that reached the best sum. Adding stops as soon as the capacity itself is reached."""
    reach, mask, stages = 1, (1 << (capacity + 1)) - 1, []
    for n in lengths:
        left, step = min(len(stock[n]), capacity // n), 1
        while left:
            take = min(step, left)
            stages.append((n, take, reach))
            reach |= (reach << (n * take)) & mask
            left, step = left - take, step * 2
        if reach >> capacity:
            break
    at, used = reach.bit_length() - 1, {}
    for n, take, before in reversed(stages):
        if not before >> at & 1:
            used[n] = used.get(n, 0) + take
            at -= n * take
    return used


def pack(lengths: np.ndarray, window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of parts ``(piece, first, length)``. Every sequence but the last few is a window filled to the brim:
    the multiset closest to the capacity, and what it lacks is cut from the largest piece left. What remains in the
    end is cut into sequences whose lengths are powers of two."""
    stock: dict[int, list[tuple[int, int]]] = {}
    for i in np.argsort(-lengths, kind="stable").tolist():
        stock.setdefault(int(lengths[i]), []).append((i, 0))
    order, total, out = sorted(stock, reverse=True), int(lengths.sum()), []
    while total:
        goal = window if total >= window else 1 << (total.bit_length() - 1)
        used = closest(order, stock, goal)
        row = [(*stock[n].pop(), n) for n, k in used.items() for _ in range(k)]
        lack, total = goal - sum(n for _, _, n in row), total - goal
        if lack:  # no other piece is as short as what lacks
            n = next(n for n in order if stock[n])
            piece, first = stock[n].pop()
            row.append((piece, first, lack))
            stock.setdefault(n - lack, []).append((piece, first + lack))
            order = sorted((x for x, y in stock.items() if y), reverse=True)
        elif not all(stock[n] for n in used):
            order = [n for n in order if stock[n]]
        out.append(row)
    return out


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = 4096, words: bool = True,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every id of every document in exactly one piece of a sequence of at most ``window`` ids.

    One row per piece: ``(id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tokens)``; ``tokens`` are the
    piece's little-endian 32-bit ids. ``sequence_id`` is unique, not gapless: even for the full windows of long
    documents, odd for the sequences that the groups fill."""
    # the tokens and the numbers are fixed from here on
    flat = stored(tokenised(docs, tokenizer, end_id, window, words, id_col, text_col))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, tokens, n, slot in zip(*(x.to_pylist() for x in b.columns), strict=True):
                for k in range(n // window):
                    part = tokens[4 * k * window : 4 * (k + 1) * window]
                    rows.append((doc, k * window, window, zlib.crc32(part), n, 2 * (slot + k), 0, part))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)

    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tokens"]
    arrow = pa.schema([(x, pa.binary() if x == "tokens" else pa.int64()) for x in names])
    kind = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tokens binary"
    full = flat.filter(F.col("n") >= window).select("id", "tokens", "n", "slot").mapInArrow(whole, kind)
    rest = flat.filter(F.col("n") % window > 0).select(
        "id", "row", F.col("n").alias("doc_tokens"), (F.col("n") - F.col("n") % window).alias("start"),
        F.expr(f"substring(tokens, int(4 * (n - n % {window})) + 1, int(4 * (n % {window})))").alias("tokens"))
    groups = max(1, round(rest.count() / GROUP))

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("row", kind="stable").reset_index(drop=True)
        lengths = part["tokens"].map(len).to_numpy() // 4
        sequences = pack(lengths, window)
        index, first, size = np.array([part for s in sequences for part in s], dtype=np.int64).reshape(-1, 3).T
        place = np.repeat(np.arange(len(sequences)), [len(s) for s in sequences])
        out, before = part.iloc[index].reset_index(drop=True), np.cumsum(size) - size
        out["offset"] = before - before[np.searchsorted(place, place)]
        out["tokens"] = [t[4 * a : 4 * (a + n)] for t, a, n in zip(out["tokens"], first, size, strict=True)]
        out["start"], out["length"] = out["start"] + first, size
        out["sequence_id"] = 2 * ((out["group"].to_numpy() << 33) + place) + 1
        out["ids_crc32"] = [zlib.crc32(x) for x in out["tokens"]]
        return out[names]

    # as many partitions as keep a few groups in each, whatever the session's number
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-groups // GROUPS_PER_TASK))
    dealt = rest.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups))).repartition(parts, "group")
    packed = dealt.groupBy("group").applyInPandas(fill, kind)
    return full.unionByName(packed).withColumnRenamed("id", id_col)
