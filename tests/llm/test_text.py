"""Operators 1, 2, 4, 6, 7 and 8 against brute force on a small table."""

import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ecospark.llm import langid, licenses, linededup, lm, minhash, quality
from ecospark.llm.stats import text_stats
from ecospark.llm.words import chain, shingles, text_bytes, word_hashes

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingle_set(text, n):
    w = words((text or "").translate(AZ))
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def components(keys, linked):
    up = {k: k for k in keys}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in linked:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {k: top(k) for k in keys}


# ---------------------------------------------------------------- words, MinHash


def test_hashes_name_words_and_shingles():
    texts = ["", "a", "a b", "A  b\tc\nd a b c", "é ß 日本 é ß 日本", "x" * 70_000 + " y"]
    seen = {}
    for t in texts:
        for h, w in zip(word_hashes(text_bytes(t)).tolist(), words(t.translate(AZ)), strict=True):
            assert seen.setdefault(h, w) == w
        assert len(shingles(text_bytes(t), 3)) == len(shingle_set(t, 3))
    assert len(chain(word_hashes(text_bytes("a b")), 3)) == 0
    batch, bound = minhash.sets(texts, 3)
    for i, t in enumerate(texts):
        assert np.array_equal(batch[bound[i] : bound[i + 1]], shingles(text_bytes(t), 3))


def test_signature_is_superminhash_element_by_element():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (1, 3, 40, 900, 0)]
    bound = np.cumsum([0, *map(len, sets)])
    got = minhash.signatures(np.concatenate(sets), bound, 32)
    for s, h in zip(sets, got, strict=True):
        want = np.full(32, np.inf)
        for x in s:  # without early stopping, one element at a time
            order = list(range(32))
            for j in range(32):
                draw = minhash.W.mix(np.array([x]) + np.uint64((2 * j + 1) * 0x9E3779B97F4A7C15 % 2**64))
                k = j + int(minhash._uniform(minhash.W.mix(draw + np.uint64(0x632BE59BD9B4E019)))[0] * (32 - j))
                order[j], order[k] = order[k], order[j]
                want[order[j]] = min(want[order[j]], minhash._uniform(draw)[0] + j)
        assert np.allclose(h, want)


def test_estimates_follow_the_similarity():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    for share in (0.2, 0.5, 0.85):
        n = int(2000 * (1 - share) / (1 + share))
        a, b = np.sort(base[:2000]), np.sort(np.concatenate([base[n:2000], base[2000 : 2000 + n]]))
        sig = minhash._bytes_of(minhash.signatures(np.concatenate([a, b]), np.array([0, 2000, 4000])))
        assert abs(minhash._agreement((sig[0] == sig[1]).mean()) - share) < 0.1


@pytest.mark.parametrize(("n", "num"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, rows, none, n, num):
    ids = [(d, i) for i, (d, *_) in enumerate(rows)]
    sets = [shingle_set(t, n) for _, t, *_ in rows]
    linked = [(i, j) for i, j in combinations(range(len(rows)), 2) if sets[i] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    comp = components(range(len(rows)), linked)
    least = {}
    for d, i in ids:
        if d is not None:
            least[comp[i]] = min(d, least.get(comp[i], d))
    want = Counter((d, len(sets[i]), least.get(comp[i])) for d, i in ids)
    got = minhash.near_duplicates(docs, n, num).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id or r.component_id is None) for r in got)
    assert minhash.near_duplicates(none, n, num).count() == 0


def test_large_near_groups_meet_across_leaders(spark):
    """Variants of one text: many lie under the threshold from the centre but are linked with each other."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for k in range(120):
        w = list(base)
        for p in rng.choice(100, rng.integers(0, 6), replace=False):
            w[p] = f"x{k % 40}_{p}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [shingle_set(t, 3) for t in texts]
    linked = [(i, j) for i, j in combinations(range(len(texts)), 2) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    want = components(range(len(texts)), linked)
    assert len(set(want.values())) > 1
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, 3, 85).collect()}
    assert got == want


def test_one_of_each_keeps_all_columns(docs):
    out = minhash.one_of_each(docs)
    assert out.columns == docs.columns
    kept = {r.doc_id for r in out.collect()}
    assert {5, 8, 9} <= kept and not kept & {70, 71, 72, 73} and 74 in kept


def test_one_of_each_decides_per_row(spark):
    """Null ids, and two texts under one id: no clean row goes with a copy, one row of each component stays."""
    body = [" ".join(f"w{k}{i}" for i in range(40)) for k in range(4)]
    rows = [(None, body[0]), (None, body[0]), (1, body[0]), (5, body[1]), (5, body[2]), (4, body[1]), (None, body[3]), (None, body[3]), (None, None), (None, None), (7, ""), (7, "")]
    out = minhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter(
        {(1, body[0]): 1, (4, body[1]): 1, (5, body[2]): 1, (None, body[3]): 1, (None, None): 2, (7, ""): 2})


# ---------------------------------------------------------------- quality rules


def brute_stats(text):
    w = words(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeat = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if words(x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(repeat)


def test_statistics(docs, rows, none):
    assert text_stats(None) == (0, 0, 0, 0, 0)
    got = Counter(tuple(r[f] for f in ["doc_id", *quality.FIELDS]) + (r.base_failed,) for r in quality.quality(docs).collect())
    want = Counter()
    for d, t, *_ in rows:
        s = brute_stats(t)
        want[(d, *s, s[0] < 50 or 100 * s[4] > 50 * s[0])] += 1
    assert got == want
    assert quality.quality(none).count() == 0 and quality.keep_good(none).count() == 0


def test_outliers_go_and_the_rest_stays(spark):
    rng = np.random.default_rng(4)
    stock = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(3000)]
    rows = [(i, " ".join(rng.choice(stock, 120)), "en", f"s{i % 2}") for i in range(300)]
    rows += [(1000 + i, " ".join(f"{w}$$%" for w in rng.choice(stock, 120)), "en", f"s{i % 2}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality.keep_good(df).collect()}
    assert kept == set(range(300))


def brute_mcd(x, floors, factor, tries=300):
    """Concentration steps from many random starts: the estimate of smallest determinant."""
    rng, n, best = np.random.default_rng(1), len(x), None

    def scatter(c):
        value, vector = np.linalg.eigh(c / np.outer(floors, floors))
        return (vector * np.maximum(value, 1)) @ vector.T * np.outer(floors, floors)

    for _ in range(tries):
        near = x[rng.choice(n, x.shape[1] + 1, replace=False)]
        for _ in range(50):
            mu, cov = near.mean(axis=0), scatter(factor * np.cov(near.T, bias=True))
            d = np.einsum("ij,jk,ik->i", x - mu, np.linalg.inv(cov), x - mu)
            new = x[d <= np.sort(d)[(n + 1) // 2 - 1]]
            if len(new) == len(near) and np.allclose(new, near):
                break
            near = new
        det = np.linalg.slogdet(cov)[1]
        if best is None or det < best[0]:
            best = det, mu, cov
    return best


def single_outliers():
    """Two groups of texts, each with outliers in one feature only and ordinary texts that deviate a little."""
    rng = np.random.default_rng(8)
    stock = ["".join(rng.choice(list("abcdefgh"), k)) for k in rng.integers(3, 8, 3000)]
    rows = []
    for i in range(240):
        rows.append((i, "\n".join(" ".join(rng.choice(stock, 12)) for _ in range(int(rng.integers(8, 30)))), "en", f"s{i % 2}"))
    for i in range(8):
        w = lambda k: " ".join(rng.choice(stock, k))  # noqa: B023, E731
        rows += [(1000 + i, " ".join(a + b for a, b in zip(rng.choice(stock, 150), rng.choice(stock, 150))), "en", f"s{i % 2}"),  # words run together
                 (2000 + i, " ".join(x + "#" * (k % 5 == 0) for k, x in enumerate(rng.choice(stock, 150))), "en", f"s{i % 2}"),  # symbols
                 (3000 + i, "\n".join([w(7)] * 2 + [x for _ in range(8) for x in [w(3)] * 2]), "en", f"s{i % 2}"),  # repeated short lines
                 (4000 + i, w(110) + "\n" + " ".join([w(10)] * 9), "en", f"s{i % 2}"),  # repeated words in one line
                 (5000 + i, w(120) + " #1", "en", f"s{i % 2}"), (6000 + i, f"{(x := w(12))}\n{w(200)}\n{x}", "en", f"s{i % 2}")]  # ordinary
    return rows


def test_single_feature_outliers_against_brute_force_estimate(spark):
    rows = single_outliers()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    stats = quality.features(quality.statistics(df)).toPandas()
    got = quality.quality(df).toPandas().set_index("doc_id")
    floors = np.array([f for _, f, _ in quality.FEATURES.values()])
    sides = [s for *_, s in quality.FEATURES.values()]
    for source in ("s0", "s1"):
        own = stats[stats["source"] == source]
        passed = ~((own["n_words"] < 50) | (100 * own["n_repeat_words"] > 50 * own["n_words"]))
        x = own[[f"x_{n}" for n in quality.NAMES]].to_numpy()
        det, mu, cov = brute_mcd(x[passed.to_numpy()], floors, quality.CONSISTENCY)
        z = np.column_stack([(x[:, i] - mu[i]) if not s else s * np.maximum(s * (x[:, i] - mu[i]), 0) for i, s in enumerate(sides)])
        far = np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z) > quality.TAIL
        want = passed.to_numpy() & ~far
        assert list(got.loc[own["doc_id"], "kept"]) == list(want)
    kept = got["kept"]
    assert kept[[i for i, *_ in rows if i < 1000 or i >= 5000]].all()
    assert not kept[[i for i, *_ in rows if 1000 <= i < 5000]].any()


def test_keep_good_carries_all_columns(docs):
    out = quality.keep_good(docs)
    assert out.columns == docs.columns and out.count() > 0


# ---------------------------------------------------------------- licences


def test_base_phrases_and_labels(docs, rows, none):
    got = defaultdict(list)
    for r in licenses.scan(docs).collect():
        got[r.doc_id].append(r)
    for d, t, *_ in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(AZ))
        found = [(i, lab) for p, lab in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        want = (len(w), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found})))
        r = next(r for r in got[d] if r.n_words == len(w))
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert got[82][0].labels == "cc-by-nc,gpl" and got[81][0].labels == "apache,mit"
    assert licenses.scan(none).count() == 0


def test_templates_are_found_in_place_only(spark):
    bsd = licenses.TEMPLATES["bsd conditions"][1]
    shuffled = " ".join(sorted(bsd.split()))
    df = spark.createDataFrame([(1, f"x y {bsd.upper()} z"), (2, shuffled), (3, bsd.replace("binary", "other"))], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.scan(df).collect()}
    assert got == {1: "bsd", 2: "", 3: ""}


def test_several_notices_and_notices_in_long_prose(spark):
    """Every notice counts, whatever else its document holds."""
    prose = "a deal with the author of the files for a fee and a copy of the terms to publish in any form for the public use of this work "
    texts = {t: x for t, (_, x, _) in licenses.TEMPLATES.items()}
    six = ["mit grant", "bsd conditions", "isc grant", "mpl header", "unlicense", "cc0"]
    rows = [(0, ". ".join(texts[t] for t in six)), (1, "\n".join(texts.values()))]
    rows += [(i, prose * 30 + texts[t] + " " + prose) for i, t in enumerate(texts, 100)] + [(i, texts[t]) for i, t in enumerate(texts, 200)]
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == "bsd,cc0,isc,mit,mpl,unlicense"
    assert got[1] == ",".join(sorted({lab for lab, *_ in licenses.TEMPLATES.values()}))
    for i, (lab, *_) in enumerate(licenses.TEMPLATES.values()):
        assert got[100 + i] == got[200 + i] and lab in got[100 + i].split(",")


# ---------------------------------------------------------------- LM scoring


def test_scores(docs, rows, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 20)
    monkeypatch.setattr(lm, "LEAST", 5)
    monkeypatch.setattr(lm, "DIVERGENCE", 5.0)
    check_scores(docs, rows)


def test_scores_with_several_shards(docs, rows, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_ROWS", 500)
    check_scores(docs, rows)


def check_scores(docs, rows):
    text = [[x.translate(AZ).encode() for x in words(t)] + [None] for _, t, *_ in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, *_ in rows]
    count = Counter(w for t, h in zip(text, held, strict=True) if not h for w in t)
    n, v = sum(count.values()), len(count)
    symbols = [list(b" ".join(t[:-1])) + [0xFE] for t in text]
    gram = Counter()
    for s, h in zip(symbols, held, strict=True):
        s = [0xFF] * 4 + s
        for i in range(4, len(s) if not h else 0):
            for k in range(5):
                gram[tuple(s[i - k : i]), s[i]] += 1
    total, gain = Counter(), Counter()
    for (c, _), k in gram.items():
        total[c] += k
    for (c, x), k in gram.items():
        if c:
            gain[c] += k * math.log(k / total[c] / (gram[c[1:], x] / total[c[1:]]))
    keep = {c[k:] for c in gain if total[c] >= lm.LEAST and gain[c] >= lm.DIVERGENCE for k in range(len(c))}
    assert keep

    def p(c, x):
        q = (gram.get(((), x), 0) + 1) / (total[()] + 257)
        for k in range(1, 5):
            if c[4 - k :] not in keep:
                break
            q = (gram.get((c[4 - k :], x), 0) + lm.PULL * q) / (total[c[4 - k :]] + lm.PULL)
        return math.log10(q)

    got = defaultdict(list)
    for r in lm.score(docs).collect():
        got[r.doc_id].append((r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score))
    assert sum(map(len, got.values())) == len(rows)
    for (d, *_), t, s, h in zip(rows, text, symbols, held, strict=True):
        s = [0xFF] * 4 + s
        want = (h, len(t), sum(count[w] > 0 for w in t), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t),
                sum(p(tuple(s[i - 4 : i]), s[i]) for i in range(4, len(s))))
        assert any(g[:4] == want[:4] and g[4:] == pytest.approx(want[4:], rel=1e-9) for g in got[d]), d


def test_no_texts_no_scores(none):
    assert lm.score(none).count() == 0


# ---------------------------------------------------------------- language ID


def test_forward_sums_all_segmentations(pieces):
    lat = langid.lattice(pieces)
    p = np.random.default_rng(1).random((len(lat.pieces) + 1, 2)) / 100
    index = {x: i for i, x in enumerate(lat.pieces)}

    def brute(w):
        if not w:
            return np.ones(2)
        known = [n for n in range(1, min(len(w), lat.longest) + 1) if w[:n] in index or n == 1]
        return sum(p[index.get(w[:n], -1)] * brute(w[n:]) for n in known)

    for w in ["▁a", "▁the", "▁hello", "▁日x", "▁straße"]:
        assert np.allclose(lat.log_words([w], p)[0], np.log(brute(w))) and np.allclose(lat._log_long(w, p), np.log(brute(w)))


def test_long_words_teach_as_short_ones_do(pieces, monkeypatch):
    lat = langid.lattice(pieces)
    p = np.random.default_rng(3).random((len(lat.pieces) + 1, 1)) / 100
    words_, weight = ["▁thing", "▁straße日本", "▁a", "▁" + "xyzingthe" * 4], np.array([3.0, 1.0, 2.0, 5.0])
    want = lat.expected(words_, weight, p)
    monkeypatch.setattr(langid, "LONG", 0)
    assert np.allclose(lat.expected(words_, weight, p), want)
    far = lat.expected(["▁" + "the" * 20_000], np.array([1.0]), p)
    assert np.isfinite(far).all() and far.sum() > 10_000


def test_letters_are_unicode_letters():
    assert langid.words_of("½ ² ① Ⅷ 12 a½b x_1 ß日本") == ["a", "b", "x", "ß日本"] and langid.words_of("½ ² ①") == []


def test_expected_uses_are_forward_backward(pieces):
    lat = langid.lattice(pieces)
    p = np.random.default_rng(2).random((len(lat.pieces) + 1, 1)) / 100
    index = {x: i for i, x in enumerate(lat.pieces)}
    want = np.zeros(len(lat.pieces))

    def walk(rest, used, weight, total):
        if not rest:
            total.append((weight, used))
        for n in range(1, len(rest) + 1):
            if rest[:n] in index:
                walk(rest[n:], [*used, index[rest[:n]]], weight * p[index[rest[:n]], 0], total)
        return total

    paths = walk("▁thing", [], 1.0, [])
    z = sum(w for w, _ in paths)
    for w, used in paths:
        for i in used:
            want[i] += 3 * w / z
    assert np.allclose(lat.expected(["▁thing"], np.array([3.0]), p), want)


def test_languages(docs, rows, none, pieces):
    got = langid.identify(docs, pieces).collect()
    truth = {d: (t, lang) for d, t, lang, *_ in rows if d is not None}
    assert len(got) == len(rows)
    right = [r.lang_pred == truth[r.doc_id][1] for r in got if r.doc_id is not None and r.doc_id < 74]
    assert np.mean(right) > 0.95
    for r in got:
        assert 0 <= r.score <= 1 and r.lang_pred in ("en", "de", "und")
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if r.doc_id in (74, 75, 76, 78):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert langid.identify(none, pieces).count() == 0
    kept = langid.keep_identified(docs, pieces)
    assert kept.columns == docs.columns and not {74, 75, 76, 78} & {r.doc_id for r in kept.collect()}


# ---------------------------------------------------------------- line dedup


def brute_lines(rows, least):
    """Lines in a run of ``least`` words or more that occurred before, over all runs."""
    seen, out = {}, {}
    order = sorted({(d is not None, d or 0, zlib.crc32((t or "").encode()), d, t) for d, t, *_ in rows if t is not None}, key=lambda x: x[:3])
    for *_, d, t in order:
        lines = [(i, x) for i, x in enumerate(t.split("\n")) if words(x)]
        gone = set()
        for a in range(len(lines)):
            total, key = 0, ()
            for b in range(a, len(lines)):
                total, key = total + len(words(lines[b][1])), (*key, lines[b][1])
                if total >= least:
                    if key in seen:
                        gone |= {lines[k][0] for k in range(a, b + 1)}
                    else:
                        seen[key] = True
                    if len(key) > 60:
                        break
        out[d, t] = sorted(gone)
    return out


@pytest.mark.parametrize("least", [12, 50])
def test_lines(docs, rows, none, least):
    small = [r for r in rows if r[0] is not None and r[0] != 80]
    want = brute_lines(small, least)
    got = linededup.line_dedup(docs.filter("doc_id IS NOT NULL AND doc_id <> 80"), least).collect()
    assert len(got) == len(small)
    texts = {d: t for d, t, *_ in small}
    assert any(want.values())
    for r in got:
        t = texts[r.doc_id]
        gone = want.get((r.doc_id, t), [])
        assert r.deleted == gone, r.doc_id
        assert r.text == (None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone))
    assert linededup.line_dedup(none).count() == 0


def test_lines_of_documents_with_null_ids(spark):
    """Null ids come first in the order: their passages are the first occurrences, and later ones among them go."""
    run, other = ("\n".join(f"{w}{i} b c d e f g h i j k l" for i in range(6)) for w in "xy")
    rows = [(None, f"head\n{run}"), (0, f"{run}\nzero"), (1, f"one\n{run}\n{other}"), (None, f"{other}\nmid\n{other}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.text.split("\n")[0] if r.text else "": (r.doc_id, r.deleted) for r in linededup.line_dedup(df).collect()}
    later = list(range(7, 13))
    assert got == {"head": (None, []), "zero": (0, list(range(6))), "one": (1, [*range(1, 13)]), "y0 b c d e f g h i j k l": (None, later)}
    gone = linededup.line_dedup(df.select(F.lit(None).cast("long").alias("doc_id"), "text"))  # no ids at all
    assert sum(len(r.deleted) for r in gone.collect()) == 6 * 4


def test_runs_of_many_lengths(spark):
    """Short lines (runs of many lines), overlapping runs, runs within one document and a line that is everywhere."""
    rng = np.random.default_rng(6)
    lines = [" ".join(rng.choice(list("abcdefg"), 2)) for _ in range(30)]
    rows = []
    for i in range(25):
        body = [lines[k] for k in rng.integers(0, 30, 20)]
        if i % 3 == 0:
            body[3:3] = lines[5:25]
        rows.append((i, "\n".join(body) + "\n\n" + "\n".join(lines[:3])))
    rows += [(30, "\n".join(["x y z"] * 40)), (31, "\n".join(["x y z"] * 41))]
    want = brute_lines([(*r, 0) for r in rows], 9)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.deleted for r in linededup.line_dedup(df, 9).collect()}
    assert got == {d: gone for (d, _), gone in want.items()}


def test_whole_rows_keep_their_columns(docs):
    out = linededup.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.filter("text IS NULL").count() == docs.filter("text IS NULL").count()
