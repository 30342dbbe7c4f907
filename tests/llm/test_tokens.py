"""Operators 3, 9 and 10 against the libraries, piece by piece and over tables."""

import gc
import random
import weakref
import zlib
from collections import defaultdict

import numpy as np
import pytest

from ecospark.llm import langid, packing, tokencount, transducer
from ecospark.llm.pieces import UNIGRAM, Vocabulary

ALPHABET = list("abcdefghij  \n\t.,▁éß日<>0x'sXYZ|") + ["th", "ing", " the", "<|endoftext|>", "<s>", "  "]


def strings(n, seed):
    rng = random.Random(seed)
    return ["", " ", "  a  b", "▁x", "        ", "aaaaaaaa"] + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def library(pieces):
    return pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=pieces)


@pytest.fixture(scope="module")
def hf(words_file):
    return pytest.importorskip("tokenizers").Tokenizer.from_file(words_file)


def test_counts_and_ids_equal_the_library(library, pieces):
    count, machine = tokencount.counter(pieces), transducer.machine(pieces)
    for s in strings(1500, 1):
        ids = library.encode(s)
        assert count.total(s) == len(ids) and list(machine.encode(s)) == ids, s
        assert machine.decode(machine.encode(s)) == library.decode(ids), s


def test_every_prefix_is_exact(library, pieces):
    count = tokencount.counter(pieces)
    for s in strings(150, 2):
        assert list(count.prefixes(s)) == [len(library.encode(s[:i])) for i in range(1, len(s) + 1)], s


def test_unigram_shortest_path_is_the_best_segmentation():
    v = Vocabulary([("<unk>", 0.0, 2), ("a", -1.0, 1), ("b", -2.0, 1), ("ab", -2.5, 1), ("ba", -1.5, 1), ("▁", -1.0, 1)], kind=UNIGRAM)
    m = transducer.Transducer(v)

    def brute(s):
        if not s:
            return 0.0
        return max(v.score.get(s[:n], -m.fallback if n == 1 else -np.inf) + brute(s[n:]) for n in range(1, len(s) + 1))

    for s in ["ab", "aba", "bab", "abba", "axb", "babab"]:
        ids = m.shortest(s)
        assert sum(v.score.get(v.text[i], -m.fallback) for i in ids) == pytest.approx(brute(s))


def test_count_table(docs, rows, none, library, pieces):
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.count_tokens(docs, pieces).collect())
    want = [(str(d), len((t or "").encode()), len(library.encode(t or ""))) for d, t, *_ in rows]
    assert got == sorted((d, b, n, n > 4096) for d, b, n in want)
    assert tokencount.count_tokens(none, pieces).count() == 0


def test_prefix_table_and_truncation(docs, library, pieces):
    some = docs.filter("doc_id IN (74, 75, 77, 82, 85)")
    for r in tokencount.prefix_counts(some, pieces).join(some.select("doc_id", "text"), "doc_id").collect():
        assert r.counts == [len(library.encode(r.text[:i])) for i in range(1, len(r.text or "") + 1)]
    for r in tokencount.truncate(docs.filter("doc_id IS NOT NULL"), pieces, 12).collect():
        assert r.text is None or len(library.encode(r.text)) <= 12


def test_round_trip_table(docs, rows, none, library, pieces):
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_crc32, r.restored) for r in transducer.round_trip(docs, pieces).collect())
    crc = lambda t: zlib.crc32(np.array(library.encode(t or ""), dtype="<u4").tobytes())
    assert got == sorted((str(d), len(library.encode(t or "")), crc(t), True) for d, t, *_ in rows)
    back = transducer.decode(transducer.encode(docs.filter("doc_id = 82"), pieces), pieces).first()
    assert back.text == docs.filter("doc_id = 82").first().text
    assert transducer.round_trip(none, pieces).count() == 0


def test_words_equal_the_tokenizer(hf, words_file):
    w = packing.WordTokenizer(words_file)
    extra = ["Å ẠB İI ΑΣ ς", "don't we'll 's 'S", "<|ENDOFTEXT|> <|endoftext|>x", "a\x1cb\x85c d", "²³ ½ 12,3"]
    texts = strings(800, 4) + extra
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in hf.encode_batch(texts, add_special_tokens=False)]
    assert w.encode(texts) == want


def test_words_of_any_kind_equal_the_tokenizer(hf, words_file, monkeypatch):
    """Words longer than a key, zero bytes, letters that lower-case to a letter and a mark, and a full table that grows or is forgotten."""
    letters = [*"abcdefghijklmnopqrstuvwxyzéñßÿ÷ÀİΑΣςя日ºµ\x00\x85'.,;!?-0 \n\t  ", "the", "ing", "\u0307", "\u0958", "a" * 20, "ß" * 9, "<|endoftext|>"]
    rng = random.Random(9)
    w = packing.WordTokenizer(words_file)
    for cache, slots, batch in [(300_000, 1 << 19, 1 << 16), (100, 1 << 10, 64), (2000, 256, 50)]:
        monkeypatch.setattr(packing, "CACHE", cache)
        monkeypatch.setattr(packing, "SLOTS", slots)
        monkeypatch.setattr(packing, "BATCH", batch)
        monkeypatch.setattr(packing.Table.__init__, "__defaults__", (slots,))
        for _ in range(3):
            texts = ["", " ", "x" * 16, "x" * 17, "İ,", "a" * 15 + "."] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(300)]
            want = [np.array(e.ids, dtype="<u4").tobytes() for e in hf.encode_batch(texts, add_special_tokens=False)]
            assert w.encode(texts) == want
        w.forget()


def test_merges_of_many_words_at_once_equal_the_library(hf, words_file):
    """Stems go through array operations: the library is not asked for a word of Latin letters."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdeéinorstuß") for _ in range(rng.randint(1, 8))) for _ in range(3000)]
    w = packing.WordTokenizer(words_file)
    w._letters = w._encode = lambda texts: [] if not texts else pytest.fail(f"the library was asked for {texts[:3]}")
    assert w.encode([" ".join(words), "The end."]) == [np.array(hf.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes()
                                                       for x in (" ".join(words), "The end.")]


def test_a_worker_keeps_the_tables_of_one_stage(words_file, pieces):
    """Python workers outlive their stage: what the stages before it needed must go."""
    first = weakref.ref(langid.lattice(pieces))
    assert langid.lattice(pieces) is first()
    second = weakref.ref(packing.word_tokenizer(words_file))
    gc.collect()
    assert first() is None and packing.word_tokenizer(words_file) is second()
    langid.lattice(pieces)
    gc.collect()
    assert second() is None


def test_closest_is_the_best_subset_sum():
    rng = random.Random(5)
    for _ in range(200):
        lengths = [rng.randint(1, 30) for _ in range(rng.randint(1, 9))]
        cap = rng.randint(1, 60)
        stock = defaultdict(list)
        for i, n in enumerate(lengths):
            stock[n].append((i, 0))
        used = packing.closest(sorted(stock, reverse=True), stock, cap)
        sums = {0}
        for n in lengths:
            sums |= {s + n for s in sums if s + n <= cap}
        assert sum(n * k for n, k in used.items()) == max(sums)
        assert all(k <= len(stock[n]) for n, k in used.items())


def test_packing_covers_every_id_once(docs, rows, none, hf, words_file):
    window = 256
    got = packing.pack_documents(docs, words_file, end_id=2, window=window).collect()
    want = defaultdict(list)
    for d, t, *_ in rows:
        want[d].append(np.array([*hf.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4"))
    parts, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        parts[r.doc_id].append((r.start, r.length, r.doc_tokens, bytes(r.tokens)))
        sequences[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(bytes(r.tokens)) == r.ids_crc32 and len(r.tokens) == 4 * r.length
    for d, p in parts.items():
        assert sum(n for _, n, *_ in p) == sum(map(len, want[d]))
        for start, n, total, tokens in p:
            assert any(len(w) == total and w[start : start + n].tobytes() == tokens for w in want[d])
    pad = 0
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= window
        pad += 0 if at & (at - 1) == 0 else window - at
    assert pad == 0
    assert packing.pack_documents(none, words_file).count() == 0
