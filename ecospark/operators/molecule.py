"""Molecules as one row each: adjacency arrays and searches within the row.

``pack`` folds ``atoms`` and ``bonds`` to one row per molecule, once; everything after it is array arithmetic inside that row,
with no shuffle and no round of jobs. Breadth-first search keeps a frontier, the atoms seen, and a list of (atom,
distance); a step takes the frontier's neighbours that are not seen. Molecules of more than ``ATOMS`` atoms (a polymer) are
left to the layered joins of :mod:`ecospark.operators.molgraph`, which spread one molecule over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ecospark.session import cut_lineage

M = "mol_id"
#: atoms of a molecule that is searched within its row
ATOMS = 256


def split_by_size(atoms: DataFrame, bonds: DataFrame, limit: int | None = None) -> tuple[DataFrame, tuple[DataFrame, DataFrame] | None]:
    """(packed molecules, atoms and bonds of the giants or None)."""
    limit = ATOMS if limit is None else limit
    sizes = atoms.groupBy(M).agg(F.count(F.lit(1)).alias("_n"))
    giants = cut_lineage(sizes.filter(F.col("_n") > limit).select(M))
    if giants.isEmpty():
        return cut_lineage(pack(atoms, bonds)), None
    rest = [x.join(giants, M, "left_anti") for x in (atoms, bonds)]
    return cut_lineage(pack(*rest)), (atoms.join(giants, M, "left_semi"), bonds.join(giants, M, "left_semi"))


def pack(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """(mol_id, ids, elements, aromatic, adj): atom ids in order; per place the element, aromaticity and the places of the
    neighbours. Bonds to atoms that are not in ``atoms`` are left out."""
    a = atoms.groupBy(M).agg(F.array_sort(F.collect_set(F.struct(F.col("atom_id").alias("id"), F.coalesce("element", F.lit("")).alias("element"),
                                                                    F.coalesce("aromatic", F.lit(False)).alias("aromatic")))).alias("at"))
    b = bonds.filter("a <> b").groupBy(M).agg(F.collect_set(F.struct(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).alias("bo"))
    ids = F.transform("at", lambda x: x["id"])
    j = a.join(b, M, "left").select(M, ids.alias("ids"), F.transform("at", lambda x: x["element"]).alias("elements"),
                                    F.transform("at", lambda x: x["aromatic"]).alias("aromatic"), "bo")
    place = lambda v: (F.array_position("ids", v) - 1).cast("int")
    ends = F.filter(F.transform("bo", lambda e: F.struct(place(e["a"]).alias("a"), place(e["b"]).alias("b"))), lambda e: (e["a"] >= 0) & (e["b"] >= 0))
    j = j.withColumn("bo", F.coalesce(ends, F.array().cast("array<struct<a:int,b:int>>")))
    near = F.transform(F.sequence(F.lit(0), F.size("ids") - 1), lambda i: F.array_sort(F.transform(
        F.filter("bo", lambda e: (e["a"] == i) | (e["b"] == i)), lambda e: F.when(e["a"] == i, e["b"]).otherwise(e["a"]))))
    return j.select(M, "ids", "elements", "aromatic", near.alias("adj"))


def _search(start: Column) -> Column:
    """(atom, distance) of every atom reached from place ``start``, by frontier sets."""
    empty = F.array().cast("array<struct<atom:int,dist:int>>")
    first = F.array(start.cast("int"))

    def step(state: Column, d: Column) -> Column:
        onward = F.array_except(F.flatten(F.transform(state["front"], lambda u: F.get("adj", u))), state["seen"])
        return F.struct(onward.alias("front"), F.concat(state["seen"], onward).alias("seen"),
                        F.concat(state["out"], F.transform(onward, lambda v: F.struct(v.alias("atom"), d.alias("dist")))).alias("out"))

    init = F.struct(first.alias("front"), first.alias("seen"), empty.alias("out"))
    # no path is longer than the number of atoms; once the frontier is empty a step does nothing
    return F.aggregate(F.sequence(F.lit(1), F.size("ids")), init, lambda s, d: F.when(F.size(s["front"]) > 0, step(s, d)).otherwise(s), lambda s: s["out"])


def with_reach(packed: DataFrame) -> DataFrame:
    """``packed`` with ``reach``: per place the (atom, distance) list of all other atoms of its fragment. Written once."""
    reach = F.transform(F.sequence(F.lit(0), F.size("ids") - 1), lambda i: _search(i))
    return cut_lineage(packed.withColumn("reach", reach))


def distances(reached: DataFrame) -> DataFrame:
    """(mol_id, src, dst, dist) of ordered pairs of different atoms that are connected."""
    out = reached.select(M, "ids", F.posexplode("reach").alias("i", "r")).select(M, "ids", F.get("ids", F.col("i")).alias("src"), F.explode("r").alias("x"))
    return out.select(M, "src", F.get("ids", F.col("x.atom")).alias("dst"), F.col("x.dist").alias("dist"))


def sums(reached: DataFrame) -> DataFrame:
    """(mol_id, _s, _h, _diam): sum of distances, of their inverses, and the largest, over ordered pairs (null without pairs)."""
    every = F.flatten(F.transform("reach", lambda r: F.transform(r, lambda x: x["dist"])))
    add = lambda col, f: F.aggregate(col, F.lit(0.0), lambda s, x: s + f(x))
    d = reached.select(M, every.alias("d"))
    return d.filter(F.size("d") > 0).select(M, add("d", lambda x: x.cast("double")).cast("long").alias("_s"), add("d", lambda x: 1.0 / x).alias("_h"), F.array_max("d").alias("_diam"))


def fragments(reached: DataFrame) -> DataFrame:
    """(mol_id, _c): connected fragments; an atom stands for its fragment if it reaches none before it."""
    lone = F.filter(F.sequence(F.lit(0), F.size("ids") - 1), lambda i: ~F.exists(F.get("reach", i), lambda x: x["atom"] < i))
    return reached.select(M, F.size(lone).cast("long").alias("_c"))


def atom_pair_features(reached: DataFrame) -> DataFrame:
    """(mol_id, feature): both elements, smaller first, and the distance, per unordered pair."""
    label = lambda i: F.get("elements", i)
    pairs = F.flatten(F.transform("reach", lambda r, i: F.transform(F.filter(r, lambda x: x["atom"] > i), lambda x: F.concat_ws(
        "|", F.least(label(i), label(x["atom"])), F.greatest(label(i), label(x["atom"])), x["dist"].cast("string")))))
    return reached.select(M, F.explode(pairs).alias("feature"))


def path_features(packed: DataFrame, max_bonds: int) -> DataFrame:
    """(mol_id, feature): the element sequence, smaller direction first, of every simple path of 1 to ``max_bonds`` bonds."""
    grow = lambda p: F.transform(F.filter(F.get("adj", F.element_at(p, -1)), lambda v: ~F.array_contains(p, v)), lambda v: F.concat(p, F.array(v)))
    starts = F.transform(F.sequence(F.lit(0), F.size("ids") - 1), lambda i: F.array(i.cast("int")))
    walks = packed.select(M, "elements", "adj", F.explode(starts).alias("p"))
    out = None
    for _ in range(max_bonds):
        walks = walks.select(M, "elements", "adj", F.explode(grow(F.col("p"))).alias("p"))
        labels = F.transform("p", lambda i: F.get("elements", i))
        one_way = walks.filter(F.element_at("p", 1) < F.element_at("p", -1))
        found = one_way.select(M, F.least(F.array_join(labels, "|"), F.array_join(F.reverse(labels), "|")).alias("feature"))
        out = found if out is None else out.unionByName(found)
    return out


# ---------------------------------------------------------------- equivalence of atoms


def pack_bonds(atoms: DataFrame, bonds: DataFrame, describe: Column) -> DataFrame:
    """(mol_id, ids, about, edges): atom ids in order, per place the struct ``describe`` of its atom, and the bonds as (a, b, bond order) of places."""
    a = atoms.groupBy(M).agg(F.array_sort(F.collect_list(F.struct(F.col("atom_id").alias("id"), describe.alias("about")))).alias("at"))
    b = bonds.filter("a <> b").groupBy(M).agg(F.collect_set(F.struct(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"),
                                                                        F.col("bond_order").cast("double").alias("o"))).alias("bo"))
    place = lambda v: (F.array_position("ids", v) - 1).cast("int")
    j = a.join(b, M, "left").select(M, F.transform("at", lambda x: x["id"]).alias("ids"), F.transform("at", lambda x: x["about"]).alias("about"), "bo")
    ends = F.filter(F.transform("bo", lambda e: F.struct(place(e["a"]).alias("a"), place(e["b"]).alias("b"), e["o"].alias("o"))), lambda e: (e["a"] >= 0) & (e["b"] >= 0))
    return j.select(M, "ids", "about", F.coalesce(ends, F.array().cast("array<struct<a:int,b:int,o:double>>")).alias("edges"))


def with_ranks(packed: DataFrame) -> DataFrame:
    """``packed`` (of :func:`pack_bonds`) with ``near``, per place its (neighbour, bond order) list, and ``ranks``: classes of atoms refined
    to a fixpoint. An atom's class is first the order of its ``about``; a round orders the atoms by (class, sorted bond orders and
    classes of the neighbours); the classes are final once a round splits none."""
    near = F.transform(F.sequence(F.lit(0), F.size("ids") - 1), lambda i: F.transform(F.filter("edges", lambda e: (e["a"] == i) | (e["b"] == i)), lambda e: F.struct(
        F.when(e["a"] == i, e["b"]).otherwise(e["a"]).alias("v"), e["o"].alias("o"))))
    rank = lambda keys: F.transform(keys, lambda k: F.array_position(F.array_sort(F.array_distinct(keys)), k).cast("int"))
    one = cut_lineage(packed.withColumn("near", near).withColumn("first", rank(F.col("about"))))

    def step(s: Column, _: Column) -> Column:
        keys = F.transform(s["ranks"], lambda r, i: F.struct(r.alias("own"), F.array_sort(F.transform(F.get("near", i), lambda e: F.struct(
            e["o"].alias("o"), F.get(s["ranks"], e["v"]).alias("r")))).alias("around")))
        new = rank(keys)
        return F.when(s["done"], s).otherwise(F.struct(new.alias("ranks"), (F.array_max(new) == F.array_max(s["ranks"])).alias("done")))

    start = F.struct(F.col("first").alias("ranks"), F.lit(False).alias("done"))
    return cut_lineage(one.withColumn("ranks", F.aggregate(F.sequence(F.lit(1), F.size("ids")), start, step, lambda s: s["ranks"])).drop("first"))
