"""Operator 5 against brute force."""

import numpy as np
import pytest

from ecospark.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, node string, unit int, n_links int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", 1, 2) for i, v, lab in rows], SCHEMA)


def make_rows():
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        rows.append((i, rng.normal(size=16).tolist(), i % 3))
    for i in range(400, 520):  # a clump
        rows.append((i, (np.array(rows[7][1]) + rng.normal(size=16) * 0.08).tolist(), 1))
    rows += [(520 + i, rows[9][1], 0) for i in range(5)]
    rows += [(530, None, 1), (531, [0.0] * 16, 1), (532, [float("nan")] + [1.0] * 15, 1), (533, [None] + [1.0] * 15, 0), (534, rows[9][1], None),
             (535, [], 1), (536, [1.0, 2.0], 1), (537, [2.0, 4.0], 1), (538, [float("inf")] * 16, 0), (539, [2.0 * x for x in rows[9][1]], 0)]
    return rows


def brute(rows, least):
    unit = []
    for _, v, lab in rows:
        ok = v and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
        x = np.array(v, dtype=np.float32).astype(float) if ok else None
        unit.append(None if x is None else x / np.linalg.norm(x))
    near = [[j for j, y in enumerate(unit) if i != j and x is not None and y is not None and len(x) == len(y) and rows[i][2] == rows[j][2] and x @ y >= least]
            for i, x in enumerate(unit)]
    comp = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, k in enumerate(near):
            low = min([comp[i], *(comp[j] for j in k)])
            if low < comp[i]:
                comp[i], changed = low, True
    return [len(k) for k in near], [rows[c][0] for c in comp]


@pytest.mark.parametrize("cap", [2000, 40])
def test_links_and_components(spark, monkeypatch, cap):
    monkeypatch.setattr(embeddings, "CAP", cap)
    monkeypatch.setattr(embeddings, "CLUSTER", 100)
    rows = make_rows()
    n, comp = brute(rows, 0.95)
    got = {r.vec_id: r for r in embeddings.near_duplicates(table(spark, rows), 0.95).collect()}
    assert len(got) == len(rows)
    found = [got[r[0]].n_links for r in rows]
    assert all(f <= t for f, t in zip(found, n, strict=True)) and sum(found) >= 0.9 * sum(n) > 0
    same = np.mean([got[r[0]].component_id == k for r, k in zip(rows, comp, strict=True)])
    assert same >= 0.98
    for i in range(530, 535):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[536].n_links == 1 and got[537].component_id == 536


def test_repeated_and_null_ids_and_empty_table(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0), (1, v, 0), (None, v, 0), (None, [3.0, -1.0, 0.0], 0), (4, [9.0, 1.0, 1.0], 0)]
    got = embeddings.near_duplicates(table(spark, rows)).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got) == [
        ("1", 2, "1", True), ("1", 2, "1", True), ("4", 0, "4", True), ("None", 0, "None", True), ("None", 2, "1", False)]
    assert embeddings.near_duplicates(table(spark, [])).count() == 0


def test_audit_needs_evidence_and_sees_lost_pairs(spark, monkeypatch):
    """Each linked node counts once: a lost pair shows beside a clump; nodes without links are no evidence."""
    monkeypatch.setattr(embeddings, "EVIDENCE", 1)
    rng = np.random.default_rng(4)
    v = rng.normal(size=16)
    rows = [(i, (v + rng.normal(size=16) * 1e-3).tolist(), 0) for i in range(30)] + [(30 + i, rng.normal(size=16).tolist(), 0) for i in range(30)]
    rows += [(60, rows[40][1], 0), (61, (np.array(rows[41][1]) * (1 + 1e-4 * np.arange(16))).tolist(), 0)]
    _, nodes = embeddings.nodes_of(table(spark, rows), "vec_id", "label", "embedding")
    n, _ = brute(rows, 0.98)
    node = {r["node"]: r for r in nodes.collect()}
    full = spark.createDataFrame([(k, 29 if r["weight"] == 1 else 0) for k, r in node.items()], "node long, n long")
    recall, evidence = embeddings.audit(nodes, full, 0.98)
    assert (recall, evidence) == (1.0, 32) and sum(x > 0 for x in n) == 34  # equal vectors are one node
    lost = full.filter("n > 0").limit(0)
    assert embeddings.audit(nodes, lost, 0.98) == (0.0, 32)
    alone = nodes.limit(0)
    assert embeddings.audit(alone, full, 0.98)[1] == 0


def test_search_costs_what_it_meets(monkeypatch):
    """A query is compared with a part of the shard's nodes and finds all in range that the graph leads to."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1200, 16))
    x[600:] = x[:600] + rng.normal(size=(600, 16)) * 0.02
    x /= np.linalg.norm(x, axis=1)[:, None]
    a, b = embeddings.pruned(x)
    edges = np.unique(np.concatenate([a * 1200 + b, b * 1200 + a]))
    near = (np.searchsorted(edges // 1200, np.arange(1201)), edges % 1200)
    met, real = [], np.einsum
    monkeypatch.setattr(embeddings.np, "einsum", lambda how, p, q: met.append(len(p)) or real(how, p, q))
    who, to = embeddings._range_search(x, x, near, 0.98)
    monkeypatch.undo()
    want = set(zip(*(v.tolist() for v in np.nonzero(x @ x.T >= 0.98)), strict=True))
    got = set(zip(who.tolist(), to.tolist(), strict=True))
    assert got <= want and len(got) == len(who) and len(got) >= 0.95 * len(want) and sum(met) < 0.6 * 1200 * 1200
