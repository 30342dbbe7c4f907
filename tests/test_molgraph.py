import random

import pytest

from ecospark.operators import molecule
from ecospark.operators import molgraph as G


def _mols(spark):
    atoms, bonds = [], []
    for i in range(5):  # path of 5 atoms
        atoms.append(("path", i, "C", False, 0.1 * i))
    bonds += [("path", i, i + 1, 1.0, False) for i in range(4)]
    for i in range(6):  # aromatic 6-ring
        atoms.append(("ring", i, "C", True, -0.1))
    bonds += [("ring", i, i + 1, 1.5, True) for i in range(5)] + [("ring", 0, 5, 1.5, True)]
    atoms += [("star", i, "C" if i == 0 else "Cl", False, 0.0) for i in range(5)]
    bonds += [("star", 0, i, 1.0, False) for i in range(1, 5)]
    atoms.append(("single", 0, "O", False, None))
    a = spark.createDataFrame(atoms, "mol_id string, atom_id int, element string, aromatic boolean, charge double")
    b = spark.createDataFrame(bonds, "mol_id string, a int, b int, bond_order double, aromatic boolean")
    return a, b


def test_indices(spark):
    a, b = _mols(spark)
    t = {r.mol_id: r for r in G.topological_indices(a, b).collect()}
    n = 5
    assert t["path"].WienerIndex == n * (n * n - 1) / 6 == 20
    assert t["ring"].WienerIndex == 27
    assert t["star"].WienerIndex == 4 * 1 + 6 * 2
    assert t["single"].WienerIndex == 0 and t["single"].BalabanJ == 0.0
    z = {r.mol_id: (r.FirstZagrebIndex, r.SecondZagrebIndex) for r in G.zagreb(a, b).collect()}
    assert z["path"] == (1 + 4 + 4 + 4 + 1, 2 + 4 + 4 + 2)
    assert z["star"] == (16 + 4, 16)


def test_rings_counts_charges(spark):
    a, b = _mols(spark)
    rings = {r.mol_id: (r.NumAromaticRings, r.NumAliphaticRings) for r in G.rings(a, b).collect()}
    assert rings == {"path": (0, 0), "ring": (1, 0), "star": (0, 0), "single": (0, 0)}
    cnt = {r.mol_id: (r.NumAtoms, r.NumBonds, r.NumAromaticAtoms) for r in G.counts(a, b).collect()}
    assert cnt["ring"] == (6, 6, 6) and cnt["single"] == (1, 0, 0)
    ch = {r.mol_id: r for r in G.charge_extremes(a).collect()}
    assert abs(ch["path"].MaxPartialCharge - 0.4) < 1e-12
    bc = {r.mol_id: (r.BCUT2D_MWLOW, r.BCUT2D_MWUP) for r in G.bcut(a, b).collect()}
    assert bc["single"] == (None, None)  # missing charge
    assert abs(bc["ring"][0] - (-0.2)) < 1e-9 and abs(bc["ring"][1] - 0.2) < 1e-9


def test_fingerprints(spark):
    a, b = _mols(spark)
    tor = {r.mol_id: r.on_bits for r in G.torsion(a, b).collect()}
    assert len(tor["path"]) == 1  # C-C-C-C only
    ap = {r.mol_id: r.on_bits for r in G.atom_pair(a, b).collect()}
    assert len(ap["path"]) == 4  # distances 1..4
    mg = {r.mol_id: r.on_bits for r in G.morgan(a, b).collect()}
    assert all(0 <= x < 2048 for x in mg["ring"])
    assert len(mg["ring"]) == 3  # one environment per round in a symmetric ring
    pf = {r.mol_id: r.on_bits for r in G.paths(a, b, max_bonds=3).collect()}
    assert len(pf["path"]) == 3


def test_rings_from_distances_match(spark):
    a, b = _mols(spark)
    # add a second fragment to the path molecule: two components
    extra_a = spark.createDataFrame([("path", 10, "C", False, 0.0), ("path", 11, "C", False, 0.0), ("path", 12, "C", False, 0.0)],
                                    a.schema)
    extra_b = spark.createDataFrame([("path", 10, 11, 1.0, False), ("path", 11, 12, 1.0, False), ("path", 10, 12, 1.0, False)], b.schema)
    a2, b2 = a.unionByName(extra_a), b.unionByName(extra_b)
    plain = {r.mol_id: (r.NumAromaticRings, r.NumAliphaticRings) for r in G.rings(a2, b2).collect()}
    via = {r.mol_id: (r.NumAromaticRings, r.NumAliphaticRings) for r in G.rings(a2, b2, G.reach(a2, b2)).collect()}
    assert plain == via and plain["path"] == (0, 1)


def _graphs(spark, seed=1):
    """Random connected and broken graphs with rings, gaps in the ids, bonds to nowhere and repeated rows."""
    rng = random.Random(seed)
    atoms, bonds = [], []
    for m in range(12):
        n = rng.randint(1, 14)
        ids = sorted(rng.sample(range(100), n))
        atoms += [(m, i, rng.choice(["C", "N", "O"]), rng.random() < 0.5, rng.uniform(-1, 1)) for i in ids]
        chosen = {tuple(sorted(rng.sample(ids, 2))) for _ in range(rng.randint(0, n + 2))} if n > 1 else set()
        bonds += [(m, a, b, 1.0, rng.random() < 0.5) for a, b in chosen]
    a = spark.createDataFrame(atoms, "mol_id int, atom_id int, element string, aromatic boolean, charge double")
    b = spark.createDataFrame(bonds, "mol_id int, a int, b int, bond_order double, aromatic boolean")
    return a, b


@pytest.mark.parametrize("seed", [1, 2])
def test_within_the_row_equals_the_layered_joins(spark, monkeypatch, seed):
    a, b = _graphs(spark, seed)
    jobs = {"dist": lambda: G.distances(a, b), "index": lambda: G.topological_indices(a, b), "rings": lambda: G.rings(a, b),
            "pairs": lambda: G.atom_pair(a, b), "paths": lambda: G.paths(a, b, 4)}
    norm = lambda df: sorted(str([round(x, 9) if isinstance(x, float) else x for x in r]) for r in df.collect())
    own = {k: norm(f()) for k, f in jobs.items()}
    assert norm(G.layered_distances(a, b)) == own["dist"]
    monkeypatch.setattr(molecule, "ATOMS", 6)  # larger molecules by joins
    assert {k: norm(f()) for k, f in jobs.items()} == own
    back = {r["mol_id"]: r for r in G.rings(a, b).collect()}
    edges, nodes = b.collect(), a.collect()
    for m, r in back.items():
        up = {x["atom_id"]: x["atom_id"] for x in nodes if x["mol_id"] == m}

        def top(i):
            while up[i] != i:
                i = up[i]
            return i

        own_edges = [(e["a"], e["b"]) for e in edges if e["mol_id"] == m]
        closing = 0
        for x, y in own_edges:
            x, y = top(x), top(y)
            closing += x == y
            up[x] = y
        assert r["NumAromaticRings"] + r["NumAliphaticRings"] == closing
