"""Operator 11 against brute force."""

import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from ecospark.llm import filteraudit as A
from ecospark.llm import tables


def failed(text, first, doc_id):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {f for f, bad in {
        "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
        "D": bool(re.search(r"[#$%&*|]", text)), "E": doc_id is not None and first.get(text, doc_id) < doc_id}.items() if bad}


def brute(rows, labels):
    first, docs = {}, []
    for d, t, _, s, *_ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    good, toxic = ({i for i, *x in labels if x[k] == 1} for k in (0, 1))
    for d, t, _, s, *_ in rows:
        docs.append((s or "", failed(t or "", first, d), d in good and d is not None, d in toxic and d is not None))
    out, shapley = defaultdict(Counter), Counter()
    for order in permutations("ABCDE"):
        for part, fails, is_good, is_toxic in docs:
            gone = None
            for k, f in enumerate(order, 1):
                cell = out[part, "".join(order), k]
                if f in fails:
                    if gone:
                        cell["redundant"] += 1
                    else:
                        gone = f
                        cell.update(removed=1, good_lost=is_good, toxic_lost=is_toxic)
                        shapley[part, f] += 1
                    cell["unique_fails"] += fails == {f}
                cell["kept"] += not gone
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    return {(*key, *[cell[n] for n in names], shapley[key[0], key[1][key[2] - 1]]) for key, cell in out.items()}


LABELS = [(1, 1, 0), (2, 0, 1), (70, 1, 1), (71, 1, None), (71, 0, 1), (None, 1, 1), (80, None, 1), (9999, 1, 1), (83, 1, 0), (83, 1, 0)]


def test_audit_equals_brute_force(spark, docs, rows):
    labels = spark.createDataFrame([(*x, "z") for x in LABELS], "doc_id long, quality int, toxic int, part string")
    got = [tuple(r) for r in A.audit(docs, labels).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, LABELS)


@pytest.mark.parametrize("bits", [63, 4])
def test_matrix_is_one_dictionary_and_exact_rows(spark, docs, rows, bits):
    """Also where nearly all words share a hash."""
    m = A.matrix(docs.repartition(5), bits=bits)
    words = m.dictionary.collect()
    ids = {bytes(r["word"]): r["id"] for r in words}
    assert len(words) == len(ids) == len(set(ids.values())) and (min(ids.values()) < 0) == (bits == 4)
    assert set(ids) == {w.encode() for r in rows for w in re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")}
    found = []
    for r in m.shards.collect():
        ptr, terms, idx, n = (np.frombuffer(r[k], kind) for k, kind in (("indptr", np.int64), ("terms", np.int64), ("indices", np.int32), ("data", np.int32)))
        for i in range(len(ptr) - 1):
            found.append((str(r["doc_id"][i]), tuple(sorted(zip(terms[idx[ptr[i] : ptr[i + 1]]].tolist(), n[ptr[i] : ptr[i + 1]].tolist())))))
    want = [(str(r[0]), tuple(sorted((ids[w.encode()], k) for w, k in Counter(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")).items()))) for r in rows]
    assert sorted(found) == sorted(want)


def test_empty_tables_and_missing_columns(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.audit(none, labels).count() == 0
    bare = spark.createDataFrame([(1,), (None,)], "doc_id long")
    out = A.audit(bare, labels)
    assert out.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r["part"], r["removed"]) for r in out.filter("filter_order = 'ABCDE' AND step = 1").collect()} == {("", 2)}


def test_interactions_of_other_filters(spark):
    flags = spark.createDataFrame([("p", True, None, True, False), ("p", True, True, None, True), ("p", False, False, None, None)],
                                  "part string, x boolean, y boolean, good boolean, toxic boolean")
    got = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["good_lost"], r["shapley"]) for r in A.interactions(flags, "xy").collect()}
    assert got == {("xy", 1): (1, 2, 0, 1, 3), ("xy", 2): (1, 0, 1, 0, 1), ("yx", 1): (2, 1, 0, 0, 1), ("yx", 2): (1, 1, 1, 1, 3)}
    with pytest.raises(ValueError):
        A.interactions(flags, ["long name"])


def test_lookup_splits_heavy_keys(spark, monkeypatch):
    monkeypatch.setattr(tables, "LOOKUP_ROWS", 1)
    rows = spark.createDataFrame([(i % 3 if i < 30 else 9, i) for i in range(11_000)] + [(None, -1)], "k int, v int")
    side = tables.stored(rows.filter("k <> 1").groupBy("k").count().withColumnRenamed("count", "n"))
    got = sorted((r["v"], r["n"]) for r in tables.lookup(rows, side, "k", "n").collect())
    want = {0: 10, 1: None, 2: 10, 9: 10_970, None: None}
    assert [v for v, _ in got] == list(range(-1, 11_000))
    assert [n for _, n in got] == [None, *(want[i % 3] for i in range(30)), *([10_970] * 10_970)]
