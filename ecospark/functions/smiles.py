"""SMILES strings to atoms and bonds, as column expressions (SURVEY B31, A9's structure column).

One fold over a string's tokens keeps the atom that the next one bonds to, a stack of branch points, the pending bond sign and
the open ring closures. Everything else follows from the folded arrays: elements, charges and hydrogens from the atoms'
own text, bond orders from the signs, aromatic bonds where both atoms are aromatic and the bond lies in a ring, and the
hydrogens that the organic subset implies from the normal valences. No Python runs on the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ecospark.functions.cols import c, evaluate_once
from ecospark.session import cut_lineage

M = "mol_id"
#: a bracket atom, an atom of the organic subset, a two-digit or one-digit ring closure, a bond or structure sign
TOKEN = r"(\[[^\]\[]*\]|Br|Cl|[BCNOPSFIbcnops]|%\d\d|\d|[().=#$:/\\-])"
#: groups: isotope, symbol, chirality, hydrogens, charge
BRACKET = r"^\[(\d*)(se|as|te|[bcnops]|[A-Z][a-z]?|\*)(@@?|@[A-Z]{2}\d+)?(H\d*)?(\+\+|--|[+-]\d*)?(?::\d+)?\]$"

# Normal valences of the organic subset (the smallest that the bonds fit in counts).
VALENCES = {"B": [3], "C": [4], "N": [3, 5], "O": [2], "P": [3, 5], "S": [2, 4, 6], "F": [1], "Cl": [1], "Br": [1], "I": [1]}
# Bond orders of the bond signs.
ORDERS = {"-": 1.0, "/": 1.0, "\\": 1.0, "=": 2.0, "#": 3.0, "$": 4.0, ":": 1.5}

_STATE = "struct<prev:int,stack:array<int>,sign:string,syms:array<string>,bonds:array<struct<a:int,b:int,sign:string>>,open:array<struct<n:string,atom:int,sign:string>>,ok:boolean>"


def _table(values: dict) -> Column:
    return F.create_map(*[F.lit(x) if not isinstance(x, list) else F.array(*[F.lit(float(v)) for v in x]) for kv in values.items() for x in kv])


def _step(s: Column, t: Column) -> Column:
    """The state after token ``t``."""
    head = F.substring(t, 1, 1)
    atom = head.rlike(r"[\[A-Za-z]")
    ring = head.rlike(r"[%\d]")
    sign = t.isin(*ORDERS)
    label = F.ltrim(F.translate(t, "%", ""), F.lit("0"))  # %01 and 1 name the same closure
    here = F.size(s["syms"])
    mates = F.filter(s["open"], lambda o: o["n"] == label)
    closes = ring & (F.size(mates) > 0)
    mate = F.get(mates, F.lit(0))
    bond = lambda a, b, sg: F.array(F.struct(a.alias("a"), b.alias("b"), sg.alias("sign")))
    return F.struct(
        F.when(atom, here).when(t == ")", F.coalesce(F.try_element_at(s["stack"], F.lit(-1)), F.lit(-1))).when(t == ".", F.lit(-1)).otherwise(s["prev"]).alias("prev"),
        F.when(t == "(", F.concat(s["stack"], F.array(s["prev"]))).when((t == ")") & (F.size(s["stack"]) > 0), F.slice(s["stack"], F.lit(1), F.greatest(F.size(s["stack"]) - 1, F.lit(0))))
        .otherwise(s["stack"]).alias("stack"),
        F.when(sign, t).when(t == "(", s["sign"]).otherwise(F.lit("")).alias("sign"),
        F.when(atom, F.concat(s["syms"], F.array(t))).otherwise(s["syms"]).alias("syms"),
        F.when(atom & (s["prev"] >= 0), F.concat(s["bonds"], bond(s["prev"], here, s["sign"])))
        .when(closes, F.concat(s["bonds"], bond(mate["atom"], s["prev"], F.when(s["sign"] != "", s["sign"]).otherwise(mate["sign"])))).otherwise(s["bonds"]).alias("bonds"),
        F.when(closes, F.filter(s["open"], lambda o: o["n"] != label)).when(ring, F.concat(s["open"], F.array(F.struct(
            label.alias("n"), s["prev"].alias("atom"), s["sign"].alias("sign"))))).otherwise(s["open"]).alias("open"),
        (s["ok"] & ~((t == ")") & (F.size(s["stack"]) == 0)) & ~((ring | sign | (t == "(")) & (s["prev"] < 0)) & ~(closes & (mate["atom"] == s["prev"]))
         & ~(sign & (s["sign"] != "")) & ~((s["sign"] != "") & (t.isin(")", ".")))).alias("ok"))


def fold(smiles: Column) -> Column:
    """The folded state of a string, with ``ok`` false where it isn't a well-formed SMILES."""
    tokens = F.regexp_extract_all(smiles, F.lit(TOKEN), 1)
    empty = lambda kind: F.array().cast(kind)
    start = F.struct(F.lit(-1).alias("prev"), empty("array<int>").alias("stack"), F.lit("").alias("sign"), empty("array<string>").alias("syms"),
                     empty("array<struct<a:int,b:int,sign:string>>").alias("bonds"), empty("array<struct<n:string,atom:int,sign:string>>").alias("open"), F.lit(True).alias("ok"))
    whole = F.array_join(tokens, "") == smiles
    return F.aggregate(tokens, start.cast(_STATE), lambda s, t: _step(s, t).cast(_STATE), lambda s: F.struct(
        s["syms"].alias("syms"), s["bonds"].alias("bonds"),
        F.coalesce(s["ok"] & whole & (F.size(s["stack"]) == 0) & (F.size(s["open"]) == 0) & (s["sign"] == "") & (F.size(s["syms"]) > 0), F.lit(False)).alias("ok")))


def _atom(t: Column) -> Column:
    """Element, aromaticity, charge, stated hydrogens (null: implied), isotope and chirality of an atom token."""
    bracket = t.startswith("[")
    part = lambda i: F.regexp_extract(t, BRACKET, i)
    symbol = F.when(bracket, part(2)).otherwise(t)
    h, q = part(4), part(5)
    hydrogens = F.when(h == "", F.lit(0)).when(h == "H", F.lit(1)).otherwise(F.substring(h, F.lit(2), F.lit(9)).try_cast("int"))
    sign = F.when(q.startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
    size = F.when(q == "", F.lit(0)).when(q.isin("++", "--"), F.lit(2)).when(F.length(q) == 1, F.lit(1)).otherwise(F.substring(q, F.lit(2), F.lit(9)).try_cast("int"))
    return F.struct(F.initcap(symbol).alias("element"), symbol.rlike("^[a-z]").alias("aromatic"), F.when(bracket, sign * size).otherwise(F.lit(0.0)).alias("charge"),
                    F.when(bracket, hydrogens).alias("stated"), F.when(bracket, part(1)).otherwise(F.lit("")).alias("isotope"),
                    F.when(bracket, part(3)).otherwise(F.lit("")).alias("chirality"), (bracket & ~t.rlike(BRACKET)).alias("bad"))


def _in_ring(bonds: Column, e: Column, n: Column) -> Column:
    """The bond's ends stay connected without it."""
    rest = F.filter(bonds, lambda x: ~((x["a"] == e["a"]) & (x["b"] == e["b"])))
    grow = lambda seen: F.array_distinct(F.concat(seen, F.flatten(F.transform(F.filter(rest, lambda x: F.array_contains(seen, x["a"]) != F.array_contains(seen, x["b"])),
                                                                               lambda x: F.array(x["a"], x["b"])))))
    start = F.struct(F.array(e["a"]).alias("seen"), F.lit(False).alias("done"))

    def step(s: Column, _: Column) -> Column:
        more = grow(s["seen"])
        return F.when(s["done"], s).otherwise(F.struct(more.alias("seen"), (F.array_contains(more, e["b"]) | (F.size(more) == F.size(s["seen"]))).alias("done")))

    return F.aggregate(F.sequence(F.lit(1), n), start, step, lambda s: F.array_contains(s["seen"], e["b"]))


def parse(df: DataFrame, key: str, smiles: str) -> DataFrame:
    """(mol_id, ok, atoms, bonds): arrays of the atoms (element, aromatic, charge, hydrogens, isotope, chirality) and bonds (a, b,
    bond_order, aromatic; a and b are places from 0, a < b) of each string. ``ok`` is false, and the arrays empty, for
    null, empty or malformed strings. Written once."""
    one = evaluate_once(df.select(c(key).alias(M), c(smiles).alias("_s")), "f", fold(F.col("_s")))
    one = evaluate_once(one.select(M, "f.*"), "at", F.transform("syms", _atom))
    ok = F.coalesce(F.col("ok") & ~F.exists("at", lambda x: x["bad"]), F.lit(False))
    low = F.transform("bonds", lambda b: F.struct(F.least(b["a"], b["b"]).alias("a"), F.greatest(b["a"], b["b"]).alias("b"), b["sign"].alias("sign")))
    ends = F.transform(low, lambda b: F.struct(b["a"], b["b"]))
    one = evaluate_once(one.withColumn("ok", ok), "lo", F.when(F.col("ok"), low))
    one = one.withColumn("ok", F.coalesce(F.col("ok") & (F.size(F.array_distinct(ends)) == F.size(ends)), F.lit(False))).drop("bonds", "syms")
    soft = lambda b: (b["sign"] == "") & F.get("at", b["a"])["aromatic"] & F.get("at", b["b"])["aromatic"]
    aromatic = lambda b: (b["sign"] == ":") | (soft(b) & _in_ring(F.col("lo"), b, F.size("at")))
    orders = _table(ORDERS)
    one = evaluate_once(one, "ar", F.transform("lo", lambda b: F.struct(b["a"].alias("a"), b["b"].alias("b"), b["sign"].alias("sign"), aromatic(b).alias("aromatic"))))
    done = F.transform("ar", lambda b: F.struct(b["a"].alias("a"), b["b"].alias("b"), F.when(b["aromatic"], F.lit(1.5)).otherwise(F.coalesce(
        F.try_element_at(orders, b["sign"]), F.lit(1.0))).alias("bond_order"), b["aromatic"].alias("aromatic")))
    one = evaluate_once(one, "bonds", done)
    used = lambda i: F.aggregate(F.filter("bonds", lambda b: (b["a"] == i) | (b["b"] == i)), F.lit(0.0), lambda s, b: s + b["bond_order"])
    fits = lambda x, i: F.get(F.filter(F.try_element_at(_table(VALENCES), x["element"]), lambda v: v >= used(i)), F.lit(0))
    least = lambda x: F.get(F.try_element_at(_table(VALENCES), x["element"]), F.lit(0))
    implied = lambda x, i: F.greatest(F.lit(0.0), F.coalesce(F.when(x["aromatic"], least(x)).otherwise(fits(x, i)), F.lit(0.0)) - used(i))
    atoms = F.transform("at", lambda x, i: F.struct(x["element"].alias("element"), x["aromatic"].alias("aromatic"), x["charge"].alias("charge"),
                                                     F.coalesce(x["stated"], F.floor(implied(x, i)).cast("int")).alias("hydrogens"), x["isotope"].alias("isotope"), x["chirality"].alias("chirality")))
    one = evaluate_once(one, "atoms", F.when(F.col("ok"), atoms))
    blank = lambda x, kind: F.coalesce(F.when(F.col("ok"), c(x)), F.array().cast(kind)).alias(x)
    return cut_lineage(one.select(M, "ok", blank("atoms", "array<struct<element:string,aromatic:boolean,charge:double,hydrogens:int,isotope:string,chirality:string>>"),
                                  blank("bonds", "array<struct<a:int,b:int,bond_order:double,aromatic:boolean>>")))


def tables(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ``atoms`` and ``bonds`` tables that the molecular-graph jobs take (plus hydrogens, isotope, chirality)."""
    atoms = parsed.select(M, F.posexplode("atoms").alias("atom_id", "x")).select(M, "atom_id", "x.*")
    bonds = parsed.select(M, F.explode("bonds").alias("x")).select(M, "x.*")
    return atoms, bonds
