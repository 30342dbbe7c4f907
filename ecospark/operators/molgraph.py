"""Molecular-graph descriptors and fingerprints as Spark jobs over ``atoms`` and ``bonds``
(SURVEY D1-D16). The reference computes them per molecule with a chemistry library; here a
molecule is rows of two tables:

* ``atoms(mol_id, atom_id, element, aromatic, charge)``
* ``bonds(mol_id, a, b, bond_order, aromatic)``, undirected, ``a < b``

Topological distances, fragments and paths are found within the molecule's row
(:mod:`ecospark.operators.molecule`); molecules of more than ``molecule.ATOMS`` atoms go through layered
joins instead, whose rounds need the two previous layers only. Fingerprint features are
folded to bits with ``pmod(int(md5(feature)[0:8], 16), n_bits)``; the bit positions therefore
differ from the reference's library (documented), the features do not.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ecospark.operators import molecule
from ecospark.session import cut_lineage

M = "mol_id"


def fold(feature: Column, n_bits: int = 2048) -> Column:
    """Feature string -> bit position in [0, n_bits)."""
    return F.pmod(F.conv(F.substring(F.md5(feature), 1, 8), 16, 10).cast("long"), F.lit(n_bits)).cast("int")


def directed(bonds: DataFrame) -> DataFrame:
    """Both directions of every bond: ``(mol_id, src, dst, bond_order, aromatic)``."""
    fwd = bonds.select(M, F.col("a").alias("src"), F.col("b").alias("dst"), "bond_order", "aromatic")
    rev = bonds.select(M, F.col("b").alias("src"), F.col("a").alias("dst"), "bond_order", "aromatic")
    return fwd.unionByName(rev)


# ---------------------------------------------------------------- counts, degrees


def counts(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """NumAtoms, NumBonds, NumAromaticAtoms per molecule (molecules without bonds get 0)."""
    a = atoms.groupBy(M).agg(F.count(F.lit(1)).alias("NumAtoms"),
                             F.count_if(F.coalesce("aromatic", F.lit(False))).alias("NumAromaticAtoms"))
    b = bonds.groupBy(M).agg(F.count(F.lit(1)).alias("NumBonds"))
    return a.join(b, M, "left").select(M, "NumAtoms", F.coalesce("NumBonds", F.lit(0)).alias("NumBonds"),
                                       "NumAromaticAtoms")


def degrees(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """``(mol_id, atom_id, degree)``; isolated atoms have degree 0."""
    ends = directed(bonds).groupBy(M, F.col("src").alias("atom_id")).agg(F.count(F.lit(1)).alias("degree"))
    return atoms.select(M, "atom_id").join(ends, [M, "atom_id"], "left").select(
        M, "atom_id", F.coalesce("degree", F.lit(0)).alias("degree"))


def zagreb(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """First Zagreb (sum deg^2 over atoms) and second (sum deg(a)*deg(b) over bonds)."""
    deg = degrees(atoms, bonds)
    first = deg.groupBy(M).agg(F.sum(F.col("degree") * F.col("degree")).alias("FirstZagrebIndex"))
    da = deg.select(M, F.col("atom_id").alias("a"), F.col("degree").alias("da"))
    db = deg.select(M, F.col("atom_id").alias("b"), F.col("degree").alias("db"))
    second = bonds.select(M, "a", "b").join(da, [M, "a"]).join(db, [M, "b"]).groupBy(M).agg(
        F.sum(F.col("da") * F.col("db")).alias("SecondZagrebIndex"))
    return first.join(second, M, "left").select(M, "FirstZagrebIndex",
                                                F.coalesce("SecondZagrebIndex", F.lit(0)).alias("SecondZagrebIndex"))


def charge_extremes(atoms: DataFrame) -> DataFrame:
    """max/min partial charge, signed and absolute."""
    q = F.col("charge")
    return atoms.groupBy(M).agg(F.max(F.abs(q)).alias("MaxAbsPartialCharge"), F.min(F.abs(q)).alias("MinAbsPartialCharge"),
                                F.max(q).alias("MaxPartialCharge"), F.min(q).alias("MinPartialCharge"))


# ---------------------------------------------------------------- distances


def distances(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """All-pairs topological distance within each molecule, ordered pairs with ``src != dst``:
    ``(mol_id, src, dst, dist)``. Unreachable pairs (other fragments) are absent."""
    packed, giants = molecule.split_by_size(atoms, bonds)
    out = molecule.distances(molecule.with_reach(packed))
    return out if giants is None else out.unionByName(layered_distances(*giants))


def layered_distances(atoms: DataFrame, bonds: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """D4 for molecules of any size: breadth-first search from every atom at once, layer d+1 = neighbours of layer d minus
    layers d and d-1. Each layer is checkpointed; the loop ends when a layer is empty."""
    adj = cut_lineage(directed(bonds).select(M, F.col("src").alias("u"), F.col("dst").alias("v")).distinct())
    prev = None
    cur = cut_lineage(atoms.select(M, F.col("atom_id").alias("src"), F.col("atom_id").alias("dst")).distinct())
    layers = []
    for d in range(1, max_rounds + 1):
        nxt = cur.join(adj.withColumnRenamed("u", "dst"), [M, "dst"]).select(M, "src", F.col("v").alias("dst")).distinct()
        nxt = nxt.join(cur, [M, "src", "dst"], "left_anti")
        if prev is not None:
            nxt = nxt.join(prev, [M, "src", "dst"], "left_anti")
        nxt = cut_lineage(nxt)
        if nxt.limit(1).count() == 0:
            break
        layers.append(nxt.withColumn("dist", F.lit(d)))
        prev, cur = cur, nxt
    else:
        raise RuntimeError("distance search did not finish")
    if not layers:
        return atoms.sparkSession.createDataFrame([], f"{M} {atoms.schema[M].dataType.simpleString()}, src int, dst int, dist int")
    out = layers[0]
    for x in layers[1:]:
        out = out.unionByName(x)
    return out


def topological_indices(atoms: DataFrame, bonds: DataFrame, reached: tuple | None = None) -> DataFrame:
    """WienerIndex = sum(d)/2, HararyIndex = sum(1/d)/2, and the reference's Balaban-style
    index: 0 when there are no bonds or at most 2 atoms, else
    (bonds / (atoms - 1)) * (1 / diameter) * sum over ordered pairs of 1/d. ``reached``: a :func:`reach` to reuse."""
    rows, far = reached or reach(atoms, bonds)
    agg = molecule.sums(rows)
    if far is not None:
        agg = agg.unionByName(far[0].groupBy(M).agg(F.sum("dist").alias("_s"), F.sum(1.0 / F.col("dist")).alias("_h"), F.max("dist").alias("_diam")))
    cnt = counts(atoms, bonds)
    j = cnt.join(agg, M, "left")
    balaban = F.when((F.col("NumBonds") == 0) | (F.col("NumAtoms") <= 2), F.lit(0.0)).otherwise(
        (F.col("NumBonds") / (F.col("NumAtoms") - 1)) * (1.0 / F.col("_diam")) * F.col("_h"))
    return j.select(M, (F.coalesce("_s", F.lit(0)) / 2.0).alias("WienerIndex"),
                    balaban.alias("BalabanJ"), (F.coalesce("_h", F.lit(0.0)) / 2.0).alias("HararyIndex"))


def reach(atoms: DataFrame, bonds: DataFrame) -> tuple[DataFrame, tuple[DataFrame, DataFrame] | None]:
    """What several descriptors share: (packed molecules with their distance lists, (distances, atoms) of giants or None)."""
    packed, giants = molecule.split_by_size(atoms, bonds)
    return molecule.with_reach(packed), None if giants is None else (layered_distances(*giants), giants[0])


# ---------------------------------------------------------------- eigenvalues

_BCUT_SCHEMA = "mol_id {t}, BCUT2D_MWLOW double, BCUT2D_MWUP double"


def bcut(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """min/max eigenvalue of diag(charge) x adjacency per molecule (real parts; eigenvalues are
    ordered as numpy orders complex numbers). Null when any charge is missing or not finite.

    An eigen-decomposition needs the whole (small, molecule-sized) matrix, so each molecule is
    one ``applyInPandas`` group; atoms and bonds are co-grouped on the molecule id."""
    key_type = atoms.schema[M].dataType.simpleString()

    def per_molecule(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        mol = key[0]
        q = a["charge"].to_numpy(dtype=float, na_value=np.nan)
        if len(a) == 0 or not np.all(np.isfinite(q)):
            return pd.DataFrame({"mol_id": [mol], "BCUT2D_MWLOW": [None], "BCUT2D_MWUP": [None]})
        index = {int(x): i for i, x in enumerate(a["atom_id"].to_numpy())}
        adj = np.zeros((len(a), len(a)))
        for x, y in zip(b["a"].to_numpy(), b["b"].to_numpy()):
            i, j = index.get(int(x)), index.get(int(y))
            if i is not None and j is not None:
                adj[i, j] = adj[j, i] = 1.0
        ev = np.linalg.eigvals(np.diag(q) @ adj)
        order = np.lexsort((ev.imag, ev.real))
        return pd.DataFrame({"mol_id": [mol], "BCUT2D_MWLOW": [float(ev[order[0]].real)],
                             "BCUT2D_MWUP": [float(ev[order[-1]].real)]})

    return (atoms.select(M, "atom_id", "charge").groupBy(M)
            .cogroup(bonds.select(M, "a", "b").groupBy(M))
            .applyInPandas(per_molecule, _BCUT_SCHEMA.format(t=key_type)))


# ---------------------------------------------------------------- rings


def fragments(atoms: DataFrame, bonds: DataFrame, reached: tuple | None = None) -> DataFrame:
    """``(mol_id, _c)``: connected fragments per molecule, atoms without bonds included."""
    rows, far = reached or reach(atoms, bonds)
    out = molecule.fragments(rows)
    if far is not None:  # an atom stands for its fragment if it reaches none before it
        smaller = far[0].filter(F.col("dst") < F.col("src")).select(M, F.col("src").alias("atom_id")).distinct()
        out = out.unionByName(far[1].select(M, "atom_id").join(smaller, [M, "atom_id"], "left_anti").groupBy(M).agg(F.count(F.lit(1)).alias("_c")))
    return out


def rings(atoms: DataFrame, bonds: DataFrame, reached: tuple | None = None) -> DataFrame:
    """Ring counts by the cyclomatic number E - V + C, on the whole graph and on the aromatic
    subgraph (aromatic bonds between aromatic atoms); aliphatic = total - aromatic. ``reached``: a :func:`reach` over the
    same bonds to reuse."""
    def cyclomatic(at: DataFrame, bo: DataFrame, found: DataFrame, name: str) -> DataFrame:
        v = at.groupBy(M).agg(F.count(F.lit(1)).alias("_v"))
        e = bo.groupBy(M).agg(F.count(F.lit(1)).alias("_e"))
        return (v.join(e, M, "left").join(found, M, "left")
                .select(M, (F.coalesce("_e", F.lit(0)) - F.col("_v") + F.coalesce("_c", F.lit(0))).alias(name)))

    arom_atoms = atoms.filter(F.coalesce("aromatic", F.lit(False)))
    arom_ids = arom_atoms.select(M, F.col("atom_id").alias("a"))
    arom_bonds = (bonds.filter(F.coalesce("aromatic", F.lit(False))).join(arom_ids, [M, "a"], "left_semi")
                  .join(arom_ids.withColumnRenamed("a", "b"), [M, "b"], "left_semi"))
    total = cyclomatic(atoms, bonds, fragments(atoms, bonds, reached), "_rings")
    arom = cyclomatic(arom_atoms, arom_bonds, fragments(arom_atoms, arom_bonds), "NumAromaticRings")
    return total.join(arom, M, "left").select(
        M, F.coalesce("NumAromaticRings", F.lit(0)).alias("NumAromaticRings"),
        (F.col("_rings") - F.coalesce("NumAromaticRings", F.lit(0))).alias("NumAliphaticRings"))


# ---------------------------------------------------------------- structure keys and stereocentres


def _about(atoms: DataFrame) -> Column:
    """What an atom is, without its neighbours and its number; columns that a table lacks count as unset."""
    get = lambda n, kind, unset: F.coalesce(F.col(n).cast(kind) if n in atoms.columns else F.lit(None).cast(kind), F.lit(unset)).alias(n)
    return F.struct(get("element", "string", ""), get("charge", "double", 0.0), get("hydrogens", "int", 0), get("isotope", "string", ""), get("aromatic", "boolean", False),
                    get("chirality", "string", ""))


def canonical_keys(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """``(mol_id, structure)``: a text that two molecules share if and only if they are one labelled graph, however
    their atoms are numbered. Elements, charges, hydrogens, isotopes, aromaticity and bond orders count; chirality marks don't
    (they depend on the order of writing). A molecule is one row; the search (:mod:`ecospark.operators.canonical`) runs in
    Arrow batches of molecules."""
    import pyarrow as pa

    from ecospark.operators.canonical import canonical_code

    about = _about(atoms)
    label = F.concat_ws("|", *[about[n].cast("string") for n in ("element", "charge", "hydrogens", "isotope", "aromatic")])
    packed = molecule.pack_bonds(atoms, bonds, label).select(M, "about", "edges")

    def codes(batches):
        for batch in batches:
            labels, edges = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            keys = [canonical_code(x, [(e["a"], e["b"], e["o"]) for e in es]) for x, es in zip(labels, edges)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.string())], [M, "structure"])

    return packed.mapInArrow(codes, f"{M} {atoms.schema[M].dataType.simpleString()}, structure string")


def stereocentres(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """``(mol_id, centres, assigned, unassigned)``: possible tetrahedral stereocentres, those with a chirality mark and
    those without; a mark on an atom that is no centre doesn't count.

    A centre has four different neighbours, at most one of them a hydrogen that isn't written as an atom: carbon, silicon,
    germanium or a cation of nitrogen with single bonds only, phosphorus or arsenic with any; or sulfur or selenium with three
    different neighbours, one by a double bond (its lone pair is the fourth). Neighbours differ if refinement of all
    atoms by their neighbourhoods, to a fixpoint, puts them in different classes. Centres that exist only through other
    centres' configurations aren't found."""
    # chirality is no part of the classes: two neighbours that differ by marks alone count as equal
    about = _about(atoms)
    bare = F.struct(*[about[n].alias(n) for n in ("element", "charge", "hydrogens", "isotope", "aromatic")])
    marks = atoms.select(M, "atom_id", about["chirality"].alias("mark")) if "chirality" in atoms.columns else atoms.select(M, "atom_id", F.lit("").alias("mark"))
    marked = marks.filter("mark <> ''").groupBy(M).agg(F.collect_set("atom_id").alias("marked"))
    rows = molecule.with_ranks(molecule.pack_bonds(atoms, bonds, bare)).join(marked, M, "left")

    def centre(x: Column, i: Column) -> Column:
        around = F.get("near", i)
        n, h = F.size(around), x["hydrogens"]
        single = F.forall(around, lambda e: e["o"] == 1.0)
        double = F.size(F.filter(around, lambda e: e["o"] == 2.0)) == 1
        different = F.size(F.array_distinct(F.transform(around, lambda e: F.get("ranks", e["v"])))) == n
        four = (n + h == 4) & (h <= 1) & ((x["element"].isin("C", "Si", "Ge") & single) | ((x["element"] == "N") & (x["charge"] > 0) & single) | x["element"].isin("P", "As"))
        three = x["element"].isin("S", "Se") & (n == 3) & (h == 0) & double
        return different & ~x["aromatic"] & (four | three)

    found = F.transform("about", lambda x, i: centre(x, i))
    one = rows.withColumn("at", F.filter(F.transform(found, lambda f, i: F.when(f, F.get("ids", i))), lambda x: x.isNotNull()))
    n, own = F.size("at"), F.size(F.array_intersect("at", F.coalesce("marked", F.slice("ids", 1, 0))))
    return one.select(M, n.alias("centres"), own.alias("assigned"), (n - own).alias("unassigned"))


# ---------------------------------------------------------------- fingerprints


def _fp(df: DataFrame, family: str, n_bits: int) -> DataFrame:
    return df.groupBy(M).agg(F.array_sort(F.collect_set("bit")).alias("on_bits")).select(
        M, F.lit(family).alias("family"), F.lit(n_bits).alias("n_bits"), "on_bits")


def morgan(atoms: DataFrame, bonds: DataFrame, radius: int = 2, n_bits: int = 2048) -> DataFrame:
    """Circular fingerprint. Round 0 identifier = (element, degree, aromatic); each round
    hashes an atom's identifier with the sorted (bond order, neighbour identifier) list. All
    identifiers of rounds 0..radius are folded to bits."""
    deg = degrees(atoms, bonds)
    ident = atoms.join(deg, [M, "atom_id"]).select(
        M, "atom_id", F.md5(F.concat_ws("|", "element", F.col("degree").cast("string"),
                                        F.coalesce("aromatic", F.lit(False)).cast("string"))).alias("ident"))
    ids = [ident]
    d = directed(bonds)
    for _ in range(radius):
        cur = ids[-1]
        nb = (d.join(cur.select(M, F.col("atom_id").alias("dst"), F.col("ident").alias("nid")), [M, "dst"])
              .groupBy(M, F.col("src").alias("atom_id"))
              .agg(F.array_sort(F.collect_list(F.concat_ws(":", F.col("bond_order").cast("string"), "nid"))).alias("env")))
        nxt = cur.join(nb, [M, "atom_id"], "left").select(
            M, "atom_id", F.md5(F.concat_ws("|", "ident", F.array_join(F.coalesce("env", F.array()), ","))).alias("ident"))
        ids.append(cut_lineage(nxt))
    allid = ids[0]
    for x in ids[1:]:
        allid = allid.unionByName(x)
    return _fp(allid.select(M, fold(F.col("ident"), n_bits).alias("bit")), "Morgan", n_bits)


def atom_pair_features(atoms: DataFrame, dist: DataFrame) -> DataFrame:
    """D12 features: ``(mol_id, feature)`` = sorted end labels + distance, per unordered pair."""
    la = atoms.select(M, F.col("atom_id").alias("src"), F.col("element").alias("ea"))
    lb = atoms.select(M, F.col("atom_id").alias("dst"), F.col("element").alias("eb"))
    pairs = dist.filter(F.col("src") < F.col("dst")).join(la, [M, "src"]).join(lb, [M, "dst"])
    return pairs.select(M, F.concat_ws("|", F.least("ea", "eb"), F.greatest("ea", "eb"),
                                       F.col("dist").cast("string")).alias("feature"))


def atom_pair(atoms: DataFrame, bonds: DataFrame, n_bits: int = 2048) -> DataFrame:
    """Atom-pair fingerprint."""
    rows, far = reach(atoms, bonds)
    features = molecule.atom_pair_features(rows)
    if far is not None:
        features = features.unionByName(atom_pair_features(far[1], far[0]))
    return _fp(features.select(M, fold(F.col("feature"), n_bits).alias("bit")), "AtomPair", n_bits)


def torsion_features(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """D13 features: every 4-atom bond path a-b-c-d (distinct atoms), labelled by its elements in
    the direction whose label string is smaller; each path once."""
    d = directed(bonds).select(M, "src", "dst")
    p = (d.select(M, F.col("src").alias("x1"), F.col("dst").alias("x2"))
         .join(d.select(M, F.col("src").alias("x2"), F.col("dst").alias("x3")), [M, "x2"])
         .filter(F.col("x3") != F.col("x1"))
         .join(d.select(M, F.col("src").alias("x3"), F.col("dst").alias("x4")), [M, "x3"])
         .filter((F.col("x4") != F.col("x2")) & (F.col("x4") != F.col("x1"))))
    p = p.filter(F.col("x1") < F.col("x4"))  # one direction per path
    el = atoms.select(M, "atom_id", "element")
    for i in range(1, 5):
        p = p.join(el.select(M, F.col("atom_id").alias(f"x{i}"), F.col("element").alias(f"e{i}")), [M, f"x{i}"])
    fwd = F.concat_ws("|", "e1", "e2", "e3", "e4")
    rev = F.concat_ws("|", "e4", "e3", "e2", "e1")
    return p.select(M, F.least(fwd, rev).alias("feature"))


def torsion(atoms: DataFrame, bonds: DataFrame, n_bits: int = 2048) -> DataFrame:
    """Topological-torsion fingerprint."""
    return _fp(torsion_features(atoms, bonds).select(M, fold(F.col("feature"), n_bits).alias("bit")), "Torsion", n_bits)


def paths(atoms: DataFrame, bonds: DataFrame, max_bonds: int = 7, n_bits: int = 2048) -> DataFrame:
    """Path fingerprint: every simple bond path of 1..max_bonds bonds, labelled by its
    element sequence (smaller of both directions), folded to bits."""
    packed, giants = molecule.split_by_size(atoms, bonds)
    features = molecule.path_features(packed, max_bonds)
    if giants is not None:
        features = features.unionByName(layered_path_features(*giants, max_bonds))
    return _fp(features.select(M, fold(F.col("feature"), n_bits).alias("bit")), "RDKitFP", n_bits)


def layered_path_features(atoms: DataFrame, bonds: DataFrame, max_bonds: int) -> DataFrame:
    """D14 features for molecules of any size: ``(mol_id, feature)``, walks grown by one join per bond."""
    d = directed(bonds).select(M, "src", "dst")
    el = atoms.select(M, F.col("atom_id").alias("node"), "element")
    walks = d.select(M, F.array("src", "dst").alias("path"), F.col("dst").alias("end"))
    out = None
    for k in range(1, max_bonds + 1):
        if k > 1:
            walks = (walks.join(d.withColumnRenamed("src", "end"), [M, "end"])
                     .filter(~F.array_contains("path", F.col("dst")))
                     .select(M, F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("end")))
            walks = cut_lineage(walks)
        one_way = walks.filter(F.element_at("path", 1) < F.element_at("path", -1))
        labelled = (one_way.select(M, "path", F.posexplode("path").alias("i", "node"))
                    .join(el, [M, "node"])
                    .groupBy(M, "path").agg(F.array_sort(F.collect_list(F.struct("i", "element"))).alias("seq")))
        lab = F.transform("seq", lambda s: s["element"])
        found = labelled.select(M, F.least(F.array_join(lab, "|"), F.array_join(F.reverse(lab), "|")).alias("feature"))
        out = found if out is None else out.unionByName(found)
    return out


def bits_to_columns(fp: DataFrame, family: str, n_bits: int) -> DataFrame:
    """On-bit array -> ``{family}_0 .. {family}_{n-1}`` 0/1 columns (export only)."""
    # one selectExpr call: n_bits generated expressions analysed JVM-side (no Py4J round trip per column)
    return fp.selectExpr(M, *[f"CAST(array_contains(on_bits, {i}) AS INT) AS `{family}_{i}`" for i in range(n_bits)])


# ---------------------------------------------------------------- assembly


def descriptors(atoms: DataFrame, bonds: DataFrame, with_bcut: bool = True) -> DataFrame:
    """Every descriptor per molecule, keyed by ``mol_id`` (left joins on the molecule key)."""
    reached = reach(atoms, bonds)
    out = (counts(atoms, bonds).join(topological_indices(atoms, bonds, reached), M, "left")
           .join(zagreb(atoms, bonds), M, "left").join(charge_extremes(atoms), M, "left")
           .join(rings(atoms, bonds, reached), M, "left"))
    if with_bcut:
        out = out.join(bcut(atoms, bonds), M, "left")
    return out
