"""SMILES strings against known formulas, rings, charges; stereocentres and structure keys."""

import random

import pytest
from pyspark.sql import functions as F

from ecospark.functions import smiles as S
from ecospark.operators import molgraph as G

KNOWN = {  # string: (formula, rings, aromatic bonds, sum of charges)
    "C": ("CH4", 0, 0, 0), "CCO": ("C2H6O", 0, 0, 0), "C=C": ("C2H4", 0, 0, 0), "C#N": ("CHN", 0, 0, 0), "CC(C)(C)C": ("C5H12", 0, 0, 0),
    "c1ccccc1": ("C6H6", 1, 6, 0), "c1ccc2ccccc2c1": ("C10H8", 2, 11, 0), "c1ccccc1c1ccccc1": ("C12H10", 2, 12, 0), "c1ccccc1-c2ccccc2": ("C12H10", 2, 12, 0),
    "CC(=O)Oc1ccccc1C(=O)O": ("C9H8O4", 1, 6, 0), "Cn1cnc2c1c(=O)n(C)c(=O)n2C": ("C8H10N4O2", 2, 10, 0), "[nH]1cccc1": ("C4H5N", 1, 5, 0), "c1ccoc1": ("C4H4O", 1, 5, 0),
    "[Na+].[Cl-]": ("ClNa", 0, 0, 0), "C[N+](C)(C)C": ("C4H12N", 0, 0, 1), "[O-]S(=O)(=O)[O-]": ("O4S", 0, 0, -2), "OP(=O)(O)O": ("H3O4P", 0, 0, 0), "CS(C)=O": ("C2H6OS", 0, 0, 0),
    "C%12CCCC%12": ("C5H10", 1, 0, 0), "C1CC2CCC1C2": ("C7H12", 2, 0, 0), "F/C=C\\F": ("C2H2F2", 0, 0, 0), "N[C@@H](C)C(=O)O": ("C3H7NO2", 0, 0, 0),
    "[13CH4]": ("CH4", 0, 0, 0), "[Fe++]": ("Fe", 0, 0, 2), "[Cu+2]": ("Cu", 0, 0, 2), "BrC(Cl)(F)I": ("CBrClFI", 0, 0, 0), "C1=CC=CC=C1": ("C6H6", 1, 0, 0),
    "C(=O)(O)C(=O)O": ("C2H2O4", 0, 0, 0), "C1CCCCC1C1CCCCC1": ("C12H22", 2, 0, 0), "[H]O[H]": ("H2O", 0, 0, 0), "C=1CCCCC=1": ("C6H10", 1, 0, 0), "C-1CCCCC1": ("C6H12", 1, 0, 0),
}
BAD = ["", None, "C(", "C)", "C1CC", "(C)", "C(C", "1CC1", "CX", "C==C", "[C", "C1C1C1", "=C", "C=", "hello world", "[xyz]", "C11"]


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame([(i, s, "x") for i, s in enumerate([*KNOWN, *BAD])], "id int, smiles string, f string")
    return S.parse(df, "id", "smiles")


def formula(atoms):
    n = {}
    for a in atoms:
        n[a["element"]] = n.get(a["element"], 0) + 1
        n["H"] = n.get("H", 0) + a["hydrogens"]
    order = sorted(n, key=lambda e: (e != "C", e != "H" or "C" not in n, e))
    return "".join(f"{e}{n[e] if n[e] > 1 else ''}" for e in order if n[e])


def test_known_molecules(spark, parsed):
    atoms, bonds = S.tables(parsed)
    rings = {r["mol_id"]: r["NumAromaticRings"] + r["NumAliphaticRings"] for r in G.rings(atoms, bonds).collect()}
    for r in parsed.filter(f"mol_id < {len(KNOWN)}").collect():
        s = list(KNOWN)[r["mol_id"]]
        want = KNOWN[s]
        assert r["ok"], s
        got = (formula(r["atoms"]), rings[r["mol_id"]], sum(b["aromatic"] for b in r["bonds"]), sum(a["charge"] for a in r["atoms"]))
        assert got == want, s


def test_malformed_strings(parsed):
    rows = parsed.filter(f"mol_id >= {len(KNOWN)}").collect()
    assert len(rows) == len(BAD)
    assert [BAD[r["mol_id"] - len(KNOWN)] for r in rows if r["ok"] or r["atoms"] or r["bonds"]] == []


def test_feeds_the_graph_jobs(spark, parsed):
    atoms, bonds = S.tables(parsed)
    at = {s: i for i, s in enumerate(KNOWN)}
    counts = {r["mol_id"]: r for r in G.counts(atoms, bonds).collect()}
    r = counts[at["c1ccccc1"]]
    assert (r["NumAtoms"], r["NumBonds"], r["NumAromaticAtoms"]) == (6, 6, 6)
    bits = {r["mol_id"]: r["on_bits"] for r in G.morgan(atoms, bonds).collect()}
    assert bits[at["c1ccccc1"]] != bits[at["C1=CC=CC=C1"]] and bits[at["c1ccccc1c1ccccc1"]] == bits[at["c1ccccc1-c2ccccc2"]]


def shuffled(atoms, bonds, seed):
    """The same molecules under other atom numbers."""
    rng = random.Random(seed)
    new = {}
    for a in atoms:
        new.setdefault(a["mol_id"], []).append(a["atom_id"])
    maps = {m: dict(zip(ids, rng.sample(range(10, 10 + 3 * len(ids)), len(ids)))) for m, ids in new.items()}
    moved = [(f"{a['mol_id']}'", maps[a["mol_id"]][a["atom_id"]], *a[2:]) for a in atoms]
    ends = [(f"{b['mol_id']}'", *sorted((maps[b["mol_id"]][b["a"]], maps[b["mol_id"]][b["b"]])), *b[3:]) for b in bonds]
    return moved, ends


def test_canonical_key_is_invariant_under_renumbering(spark, parsed):
    atoms, bonds = S.tables(parsed)
    a, b = atoms.collect(), bonds.collect()
    keys = {r["mol_id"]: r["structure"] for r in G.canonical_keys(atoms, bonds).collect()}
    for seed in (1, 2, 3):
        moved, ends = shuffled(a, b, seed)
        ma = spark.createDataFrame(moved, "mol_id string, atom_id int, element string, aromatic boolean, charge double, hydrogens int, isotope string, chirality string")
        mb = spark.createDataFrame(ends, "mol_id string, a int, b int, bond_order double, aromatic boolean")
        again = {r["mol_id"]: r["structure"] for r in G.canonical_keys(ma, mb).collect()}
        assert {f"{m}'": k for m, k in keys.items()} == again
    at = {s: i for i, s in enumerate(KNOWN)}
    assert keys[at["c1ccccc1c1ccccc1"]] == keys[at["c1ccccc1-c2ccccc2"]] and len(set(keys.values())) == len(keys) - 1


def test_two_writings_are_one_structure(spark):
    pairs = [("OCC", "CCO"), ("C(C)(C)(C)Br", "BrC(C)(C)C"), ("c1cc(O)ccc1N", "Nc1ccc(O)cc1"), ("C1CC1C2CC2", "C1(CC1)C1CC1"), ("CC(C)(C)c1cc(C(C)(C)C)cc(C(C)(C)C)c1", "c1(C(C)(C)C)cc(C(C)(C)C)cc(C(C)(C)C)c1")]
    other = ["CCN", "C1CC1CC2CC2", "c1cc(N)cc(O)c1", "C1CCC2CC2C1"]
    # equal neighbourhoods everywhere, different graphs: two rings of three and one of six
    regular = ["C1CC1.C1CC1", "C1CCCCC1"]
    rows = [(i, s) for i, s in enumerate([x for p in pairs for x in p] + other + regular)]
    atoms, bonds = S.tables(S.parse(spark.createDataFrame(rows, "id int, smiles string"), "id", "smiles"))
    keys = {r["mol_id"]: r["structure"] for r in G.canonical_keys(atoms, bonds).collect()}
    for i in range(0, 2 * len(pairs), 2):
        assert keys[i] == keys[i + 1], rows[i]
    assert len(set(keys.values())) == len(pairs) + len(other) + len(regular)


CENTRES = {  # string: (assigned, unassigned)
    "C": (0, 0), "CC(O)CC": (0, 1), "C[C@H](O)CC": (1, 0), "CC(O)C": (0, 0), "C[C@H](O)C": (0, 0), "N[C@@H](C)C(=O)O": (1, 0), "NC(C)C(=O)O": (0, 1),
    "C1CCCCC1O": (0, 0), "OC1CCCC(C)C1": (0, 2), "FC(Cl)(Br)I": (0, 1), "CS(=O)CC": (0, 1), "CS(=O)C": (0, 0), "C[C@H](O)C(O)CC": (1, 1), "CC(Cl)C(F)(F)F": (0, 1),
    "C[N+](CC)(CCC)CCCC": (0, 1), "CN(CC)CCC": (0, 0), "CC=CC": (0, 0), "CC([2H])O": (0, 1), "CP(=O)(O)CC": (0, 1), "OC(C1CC1)C1CC1": (0, 0),
}


def test_stereocentres(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(CENTRES)], "id int, smiles string")
    atoms, bonds = S.tables(S.parse(df, "id", "smiles"))
    got = {r["mol_id"]: (r["assigned"], r["unassigned"]) for r in G.stereocentres(atoms, bonds).collect()}
    assert {s: got[i] for i, s in enumerate(CENTRES)} == CENTRES


def test_stereo_check_takes_centres(spark):
    from ecospark.operators import dedup as D

    df = spark.createDataFrame([(1, "CC(O)CC"), (2, "C[C@H](O)C"), (3, "CCO")], "id int, smiles string")
    atoms, bonds = S.tables(S.parse(df, "id", "smiles"))
    centres = G.stereocentres(atoms, bonds).select(F.col("mol_id").alias("id"), F.col("centres").alias("stereo_centres"))
    ref = spark.createDataFrame([(1, 1), (2, 1)], "id int, ref_count int")
    got = {r["id"]: (r["stereo_centres"], r["manual_curation"]) for r in D.stereo_check(df, "smiles", ref, "id", centres=centres).collect()}
    assert got == {1: (1, False), 2: (0, True), 3: (0, True)}
