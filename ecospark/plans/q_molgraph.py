"""Analogue queries for molecular-graph jobs: a conversation is a molecule, a
turn an atom (element = role, aromatic = user turn, charge = text length scaled), consecutive
turns are bonded. For D10 a bond from the first to the last turn closes one ring in every
conversation of three or more turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ecospark.operators import molgraph as G
from ecospark.plans.registry import ORACLES, register, rounded
from ecospark.session import table


def atoms(spark, d):
    cv = table(spark, d, "conversations")
    return cv.select(F.col("conv_id").alias("mol_id"), F.col("turn").cast("int").alias("atom_id"),
                     F.col("role").alias("element"), (F.col("role") == "user").alias("aromatic"),
                     (F.length("text") / 1000.0 - 0.5).alias("charge"))


def bonds(spark, d, ring=False):
    cv = table(spark, d, "conversations").select("conv_id", "turn", "role")
    nxt = cv.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("turn").alias("t2"), F.col("role").alias("r2"))
    b = cv.join(nxt, ["conv_id", "turn"]).select(
        F.col("conv_id").alias("mol_id"), F.col("turn").cast("int").alias("a"), F.col("t2").cast("int").alias("b"),
        F.lit(1.0).alias("bond_order"), ((F.col("role") == "user") & (F.col("r2") == "user")).alias("aromatic"))
    if not ring:
        return b
    ends = cv.groupBy("conv_id").agg(F.min(F.struct("turn", "role")).alias("lo"), F.max(F.struct("turn", "role")).alias("hi"),
                                     F.count(F.lit(1)).alias("n")).filter(F.col("n") >= 3)
    closing = ends.select(F.col("conv_id").alias("mol_id"), F.col("lo.turn").cast("int").alias("a"),
                          F.col("hi.turn").cast("int").alias("b"), F.lit(1.0).alias("bond_order"),
                          ((F.col("lo.role") == "user") & (F.col("hi.role") == "user")).alias("aromatic"))
    return b.unionByName(closing)


FOLD = "((('0x' || substr(md5({f}), 1, 8))::BIGINT) % {n})::INT"
AT = "(SELECT conv_id AS mol_id, turn::INT AS atom_id, role AS element, role = 'user' AS aromatic FROM conversations)"
BD = """(SELECT c1.conv_id AS mol_id, c1.turn::INT AS a, c2.turn::INT AS b, c1.role = 'user' AND c2.role = 'user' AS aromatic
        FROM conversations c1 JOIN conversations c2 ON c1.conv_id = c2.conv_id AND c2.turn = c1.turn + 1)"""
PAIRS = f"(SELECT x.mol_id, x.atom_id AS src, y.atom_id AS dst, abs(x.atom_id - y.atom_id) AS dist FROM {AT} x JOIN {AT} y ON x.mol_id = y.mol_id AND x.atom_id <> y.atom_id)"


@register("D1_constitutional_counts", f"""SELECT a.mol_id, count(*) AS NumAtoms, coalesce(max(b.nb), 0) AS NumBonds,
    count(*) FILTER (WHERE a.aromatic) AS NumAromaticAtoms FROM {AT} a LEFT JOIN (SELECT mol_id, count(*) AS nb FROM {BD} GROUP BY mol_id) b
    ON a.mol_id = b.mol_id GROUP BY a.mol_id""")
def d1(spark, d):
    return G.counts(atoms(spark, d), bonds(spark, d))


DEG = f"""deg AS (SELECT a.mol_id, a.atom_id, coalesce(e.n, 0) AS degree FROM {AT} a LEFT JOIN
    (SELECT mol_id, x AS atom_id, count(*) AS n FROM (SELECT mol_id, a AS x FROM {BD} UNION ALL SELECT mol_id, b FROM {BD}) GROUP BY 1, 2) e
    ON a.mol_id = e.mol_id AND a.atom_id = e.atom_id)"""


@register("D2_D3_zagreb_indices", f"""WITH {DEG},
    f AS (SELECT mol_id, sum(degree * degree)::BIGINT AS FirstZagrebIndex FROM deg GROUP BY mol_id),
    s AS (SELECT b.mol_id, sum(da.degree * db.degree)::BIGINT AS SecondZagrebIndex FROM {BD} b
          JOIN deg da ON b.mol_id = da.mol_id AND b.a = da.atom_id JOIN deg db ON b.mol_id = db.mol_id AND b.b = db.atom_id GROUP BY b.mol_id)
    SELECT f.mol_id, FirstZagrebIndex, coalesce(SecondZagrebIndex, 0) AS SecondZagrebIndex FROM f LEFT JOIN s ON f.mol_id = s.mol_id""")
def d2(spark, d):
    return G.zagreb(atoms(spark, d), bonds(spark, d))


@register("D4_topological_distances", f"SELECT mol_id, src, dst, dist FROM {PAIRS}")
def d4(spark, d):
    return G.distances(atoms(spark, d), bonds(spark, d))


@register("D5_D6_D7_wiener_harary_balaban", f"""WITH p AS {PAIRS},
    c AS (SELECT mol_id, count(*) AS na, count(*) - 1 AS nb FROM {AT} GROUP BY mol_id),
    g AS (SELECT mol_id, sum(dist) AS s, sum(1.0 / dist) AS h, max(dist) AS diam FROM p GROUP BY mol_id)
    SELECT c.mol_id, round(coalesce(s, 0) / 2.0, 6) AS WienerIndex,
      round(CASE WHEN nb = 0 OR na <= 2 THEN 0.0 ELSE (nb / (na - 1)) * (1.0 / diam) * h END, 6) AS BalabanJ,
      round(coalesce(h, 0.0) / 2.0, 6) AS HararyIndex FROM c LEFT JOIN g ON c.mol_id = g.mol_id""")
def d5(spark, d):
    return rounded(G.topological_indices(atoms(spark, d), bonds(spark, d)))


@register("D8_bcut_eigenvalues")
def d8(spark, d):
    return rounded(G.bcut(atoms(spark, d), bonds(spark, d)))


@register("D9_partial_charge_extremes", """SELECT conv_id AS mol_id, round(max(abs(q)), 6) AS MaxAbsPartialCharge,
    round(min(abs(q)), 6) AS MinAbsPartialCharge, round(max(q), 6) AS MaxPartialCharge, round(min(q), 6) AS MinPartialCharge
    FROM (SELECT conv_id, length(text) / 1000.0 - 0.5 AS q FROM conversations) GROUP BY conv_id""")
def d9(spark, d):
    return rounded(G.charge_extremes(atoms(spark, d)))


RING_BD = f"""(SELECT * FROM {BD} UNION ALL SELECT conv_id, min(turn)::INT, max(turn)::INT,
      bool_and(role = 'user') FILTER (WHERE turn = lo OR turn = hi)
    FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS lo, max(turn) OVER (PARTITION BY conv_id) AS hi,
                 count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE n >= 3 GROUP BY conv_id)"""


@register("D10_ring_counts", f"""WITH RECURSIVE rb AS {RING_BD},
    ab AS (SELECT mol_id, a, b FROM rb WHERE aromatic),
    e AS (SELECT mol_id, a, b FROM ab UNION SELECT mol_id, b, a FROM ab),
    reach(mol_id, node, lab) AS (SELECT mol_id, a, a FROM e UNION SELECT mol_id, a, b FROM e
        UNION SELECT r.mol_id, r.node, e.b FROM reach r JOIN e ON r.mol_id = e.mol_id AND r.lab = e.a),
    comp AS (SELECT mol_id, count(DISTINCT lab) AS c, count(*) AS v FROM (SELECT mol_id, node, min(lab) AS lab FROM reach GROUP BY 1, 2) GROUP BY 1),
    va AS (SELECT mol_id, count(*) FILTER (WHERE aromatic) AS v FROM {AT} GROUP BY 1),
    tot AS (SELECT a.mol_id, coalesce(b.e, 0) - a.v + 1 AS rings FROM (SELECT mol_id, count(*) AS v FROM {AT} GROUP BY 1) a
            LEFT JOIN (SELECT mol_id, count(*) AS e FROM rb GROUP BY 1) b ON a.mol_id = b.mol_id),
    aro AS (SELECT va.mol_id, coalesce(x.e, 0) - va.v + coalesce(comp.c, 0) + (va.v - coalesce(comp.v, 0)) AS ar
            FROM va LEFT JOIN (SELECT mol_id, count(*) AS e FROM ab GROUP BY 1) x ON va.mol_id = x.mol_id
            LEFT JOIN comp ON va.mol_id = comp.mol_id)
    SELECT tot.mol_id, aro.ar AS NumAromaticRings, tot.rings - aro.ar AS NumAliphaticRings FROM tot JOIN aro ON tot.mol_id = aro.mol_id""")
def d10(spark, d):
    return G.rings(atoms(spark, d), bonds(spark, d, ring=True))


DIRB = f"(SELECT mol_id, a AS src, b AS dst, 1.0 AS bond_order FROM {BD} UNION ALL SELECT mol_id, b, a, 1.0 FROM {BD})"


def _morgan_round(prev, name):
    return f"""{name} AS (SELECT r.mol_id, r.atom_id, md5(r.ident || '|' || coalesce(e.env, '')) AS ident FROM {prev} r LEFT JOIN
      (SELECT d.mol_id, d.src AS atom_id, array_to_string(list_sort(list(d.bond_order::VARCHAR || ':' || n.ident)), ',') AS env
       FROM {DIRB} d JOIN {prev} n ON d.mol_id = n.mol_id AND d.dst = n.atom_id GROUP BY 1, 2) e
      ON r.mol_id = e.mol_id AND r.atom_id = e.atom_id)"""


MORGAN_SQL = f"""WITH {DEG},
  r0 AS (SELECT a.mol_id, a.atom_id, md5(a.element || '|' || deg.degree::VARCHAR || '|' || a.aromatic::VARCHAR) AS ident
         FROM {AT} a JOIN deg ON a.mol_id = deg.mol_id AND a.atom_id = deg.atom_id),
  {_morgan_round('r0', 'r1')}, {_morgan_round('r1', 'r2')},
  allid AS (SELECT * FROM r0 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2)
  SELECT mol_id, 'Morgan' AS family, 2048 AS n_bits, list_sort(list_distinct(list(bit))) AS on_bits
  FROM (SELECT mol_id, {FOLD.format(f='ident', n=2048)} AS bit FROM allid) GROUP BY mol_id"""


@register("D11_morgan_fingerprint", MORGAN_SQL)
def d11(spark, d):
    return G.morgan(atoms(spark, d), bonds(spark, d))



@register("D12_atom_pair_fingerprint", f"""SELECT mol_id, 'AtomPair' AS family, 2048 AS n_bits, list_sort(list_distinct(list(bit))) AS on_bits
    FROM (SELECT x.mol_id, {FOLD.format(f="least(x.element, y.element) || '|' || greatest(x.element, y.element) || '|' || (y.atom_id - x.atom_id)::VARCHAR", n=2048)} AS bit
          FROM {AT} x JOIN {AT} y ON x.mol_id = y.mol_id AND x.atom_id < y.atom_id) GROUP BY mol_id""")
def d12(spark, d):
    a, b = atoms(spark, d), bonds(spark, d)
    return G.atom_pair(a, b)


@register("D13_torsion_fingerprint", f"""SELECT mol_id, 'Torsion' AS family, 2048 AS n_bits, list_sort(list_distinct(list(bit))) AS on_bits
    FROM (SELECT a1.mol_id, {FOLD.format(f="least(a1.element || '|' || a2.element || '|' || a3.element || '|' || a4.element, a4.element || '|' || a3.element || '|' || a2.element || '|' || a1.element)", n=2048)} AS bit
          FROM {AT} a1 JOIN {AT} a2 ON a1.mol_id = a2.mol_id AND a2.atom_id = a1.atom_id + 1
          JOIN {AT} a3 ON a1.mol_id = a3.mol_id AND a3.atom_id = a1.atom_id + 2
          JOIN {AT} a4 ON a1.mol_id = a4.mol_id AND a4.atom_id = a1.atom_id + 3) GROUP BY mol_id""")
def d13(spark, d):
    return G.torsion(atoms(spark, d), bonds(spark, d))


@register("D14_path_fingerprint", f"""WITH seg AS (SELECT x.mol_id, x.atom_id AS i, y.atom_id AS j FROM {AT} x JOIN {AT} y
      ON x.mol_id = y.mol_id AND y.atom_id - x.atom_id BETWEEN 1 AND 7),
  lab AS (SELECT s.mol_id, s.i, s.j, string_agg(a.element, '|' ORDER BY a.atom_id) AS fwd,
                 string_agg(a.element, '|' ORDER BY a.atom_id DESC) AS rev
          FROM seg s JOIN {AT} a ON a.mol_id = s.mol_id AND a.atom_id BETWEEN s.i AND s.j GROUP BY 1, 2, 3)
  SELECT mol_id, 'RDKitFP' AS family, 2048 AS n_bits, list_sort(list_distinct(list({FOLD.format(f='least(fwd, rev)', n=2048)}))) AS on_bits
  FROM lab GROUP BY mol_id""")
def d14(spark, d):
    return G.paths(atoms(spark, d), bonds(spark, d), max_bonds=7)


@register("D8_bcut_per_bond", f"""SELECT x.mol_id, x.a, round(CASE WHEN p > 0 THEN -sqrt(p) ELSE 0 END, 6) AS BCUT2D_MWLOW, round(CASE WHEN p > 0 THEN sqrt(p) ELSE 0 END, 6) AS BCUT2D_MWUP
    FROM (SELECT b.mol_id, b.a, q1.q * q2.q AS p FROM {BD} b JOIN (SELECT conv_id, turn, length(text) / 1000.0 - 0.5 AS q FROM conversations) q1 ON q1.conv_id = b.mol_id AND q1.turn = b.a
      JOIN (SELECT conv_id, turn, length(text) / 1000.0 - 0.5 AS q FROM conversations) q2 ON q2.conv_id = b.mol_id AND q2.turn = b.b) x""")
def d8_bonds(spark, d):
    """Every bond as a molecule of its own two atoms, where the eigenvalues are plus and minus the root of the charges' product."""
    at, bo = atoms(spark, d), bonds(spark, d)
    ids = F.struct("mol_id", "a")
    one = bo.select(ids.alias("key"), "mol_id", F.explode(F.array("a", "b")).alias("atom_id")).join(at, ["mol_id", "atom_id"])
    mols = one.select(F.to_json("key").alias("mol_id"), "atom_id", "element", "aromatic", "charge")
    out = G.bcut(mols, bo.select(F.to_json(ids).alias("mol_id"), "a", "b"))
    key = F.from_json("mol_id", "mol_id long, a int")
    out = rounded(out.select(key["mol_id"].alias("mol_id"), key["a"].alias("a"), "BCUT2D_MWLOW", "BCUT2D_MWUP"))
    # no negative zero
    return out.withColumns({x: F.when(F.col(x) == 0, F.lit(0.0)).otherwise(F.col(x)) for x in ("BCUT2D_MWLOW", "BCUT2D_MWUP")})


@register("D15_bits_to_columns", f"""SELECT mol_id, {", ".join(f'list_contains(on_bits, {i})::INT AS "Morgan_{i}"' for i in range(2048))} FROM ({MORGAN_SQL})""")
def d15(spark, d):
    return G.bits_to_columns(G.morgan(atoms(spark, d), bonds(spark, d)), "Morgan", 2048)


CHAIN_SQL = """(SELECT conv_id AS mol_id, role, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations)"""
RING_PAIRS = f"""(SELECT x.mol_id, CASE WHEN x.n >= 3 THEN least(abs(x.k - y.k), x.n - abs(x.k - y.k)) ELSE abs(x.k - y.k) END AS dist
    FROM {CHAIN_SQL} x JOIN {CHAIN_SQL} y ON x.mol_id = y.mol_id AND x.k <> y.k)"""
_DEG_RING = f"""deg AS (SELECT a.mol_id, a.atom_id, coalesce(e.n, 0) AS degree FROM {AT} a LEFT JOIN
    (SELECT mol_id, x AS atom_id, count(*) AS n FROM (SELECT mol_id, a AS x FROM rb UNION ALL SELECT mol_id, b FROM rb) GROUP BY 1, 2) e
    ON a.mol_id = e.mol_id AND a.atom_id = e.atom_id)"""


def _d16_sql():
    return f"""WITH RECURSIVE rb AS {RING_BD}, {_DEG_RING}, p AS {RING_PAIRS}, ring AS ({ORACLES["D10_ring_counts"]}),
    c AS (SELECT a.mol_id, count(*) AS NumAtoms, coalesce(max(b.nb), 0) AS NumBonds, count(*) FILTER (WHERE a.aromatic) AS NumAromaticAtoms FROM {AT} a
      LEFT JOIN (SELECT mol_id, count(*) AS nb FROM rb GROUP BY mol_id) b ON a.mol_id = b.mol_id GROUP BY a.mol_id),
    g AS (SELECT mol_id, sum(dist) AS s, sum(1.0 / dist) AS h, max(dist) AS diam FROM p GROUP BY mol_id),
    z1 AS (SELECT mol_id, sum(degree * degree)::BIGINT AS FirstZagrebIndex FROM deg GROUP BY mol_id),
    z2 AS (SELECT b.mol_id, sum(da.degree * db.degree)::BIGINT AS z FROM rb b JOIN deg da ON b.mol_id = da.mol_id AND b.a = da.atom_id
      JOIN deg db ON b.mol_id = db.mol_id AND b.b = db.atom_id GROUP BY b.mol_id), q AS ({ORACLES["D9_partial_charge_extremes"]})
    SELECT c.mol_id, NumAtoms, NumBonds, NumAromaticAtoms, round(coalesce(s, 0) / 2.0, 6) AS WienerIndex,
      round(CASE WHEN NumBonds = 0 OR NumAtoms <= 2 THEN 0.0 ELSE (NumBonds / (NumAtoms - 1)) * (1.0 / diam) * h END, 6) AS BalabanJ,
      round(coalesce(h, 0.0) / 2.0, 6) AS HararyIndex, FirstZagrebIndex, coalesce(z, 0) AS SecondZagrebIndex, MaxAbsPartialCharge, MinAbsPartialCharge,
      MaxPartialCharge, MinPartialCharge, NumAromaticRings, NumAliphaticRings
    FROM c LEFT JOIN g ON g.mol_id = c.mol_id LEFT JOIN z1 ON z1.mol_id = c.mol_id LEFT JOIN z2 ON z2.mol_id = c.mol_id LEFT JOIN q ON q.mol_id = c.mol_id
      LEFT JOIN ring ON ring.mol_id = c.mol_id"""


@register("D16_graph_descriptors", _d16_sql())
def d16_graph(spark, d):
    """The table without the eigenvalues."""
    return rounded(G.descriptors(atoms(spark, d), bonds(spark, d, ring=True), with_bcut=False))


@register("D16_descriptor_table")
def d16(spark, d):
    return rounded(G.descriptors(atoms(spark, d), bonds(spark, d, ring=True)))


# ---------------------------------------------------------------- structures from strings

# Fixed values of this analogue: the atom that a turn is written as; user turns carry a chlorine branch.
SYMBOLS = {"user": "C(Cl)", "assistant": "N", "system": "O"}


def strings(spark, d, ring: bool = False, turned: bool = False):
    """One SMILES string per conversation: its turns as a chain, closed to a ring from three turns on if ``ring``; if
    ``turned``, odd conversations are written from the other end."""
    turns = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("mol_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("roles"))
    symbol = F.create_map(*[F.lit(x) for kv in SYMBOLS.items() for x in kv])
    syms = F.transform("roles", lambda r: symbol[r])
    if ring:
        n = F.size("roles")
        mark = lambda s: F.concat(F.substring(s, 1, 1), F.lit("1"), F.substring(s, F.lit(2), F.lit(9)))
        syms = F.transform(syms, lambda s, i: F.when((n >= 3) & ((i == 0) | (i == n - 1)), mark(s)).otherwise(s))
    if turned:
        syms = F.when(F.col("mol_id") % 2 == 1, F.reverse(syms)).otherwise(syms)
    return turns.select("mol_id", F.array_join(syms, "").alias("smiles"))


def _graph(spark, d, **how):
    from ecospark.functions import smiles

    return smiles.tables(smiles.parse(strings(spark, d, **how), "mol_id", "smiles"))




@register("B31_smiles_to_graph", f"""SELECT mol_id, any_value(n) + count(*) FILTER (role = 'user') AS atoms,
    any_value(n) - 1 + count(*) FILTER (role = 'user') + CASE WHEN any_value(n) >= 3 THEN 1 ELSE 0 END AS bonds, count(*) FILTER (role = 'user') AS carbons,
    CAST(sum(CASE role WHEN 'user' THEN 3 WHEN 'assistant' THEN 3 ELSE 2 END - CASE WHEN n >= 3 THEN 2 ELSE n - 1 END) AS BIGINT) AS hydrogens FROM {CHAIN_SQL} GROUP BY mol_id""")
def b31_graph(spark, d):
    """Strings parsed to atoms and bonds: counts per molecule."""
    at, bo = _graph(spark, d, ring=True)
    a = at.groupBy("mol_id").agg(F.count(F.lit(1)).alias("atoms"), F.count_if(F.col("element") == "C").alias("carbons"), F.sum("hydrogens").alias("hydrogens"))
    b = bo.groupBy("mol_id").agg(F.count(F.lit(1)).alias("bonds"))
    return a.join(b, "mol_id", "left").select("mol_id", "atoms", F.coalesce("bonds", F.lit(0)).alias("bonds"), "carbons", "hydrogens")


@register("C8_potential_stereocentres", f"""WITH t AS {CHAIN_SQL},
    s AS (SELECT mol_id, string_agg(role[1], '' ORDER BY k) AS fwd, string_agg(role[1], '' ORDER BY k DESC) AS rev, any_value(n) AS n FROM t GROUP BY mol_id)
    SELECT s.mol_id, CAST(count(*) FILTER (t.role = 'user' AND t.k > 1 AND t.k < t.n AND NOT (fwd = rev AND 2 * t.k = t.n + 1)) AS INTEGER) AS centres, 0 AS assigned
    FROM s JOIN t ON s.mol_id = t.mol_id GROUP BY s.mol_id""")
def c8_centres(spark, d):
    """A turn's atom is a centre unless it ends the chain or the chain reads the same both ways from it."""
    return G.stereocentres(*_graph(spark, d)).select("mol_id", "centres", "assigned")


@register("C3_canonical_structures", f"""WITH t AS {CHAIN_SQL},
    s AS (SELECT mol_id, string_agg(role[1], '' ORDER BY k) AS fwd, string_agg(role[1], '' ORDER BY k DESC) AS rev FROM t GROUP BY mol_id)
    SELECT min(mol_id) AS mol_id, count(*) AS writings FROM s GROUP BY least(fwd, rev)""")
def c3_structures(spark, d):
    """First molecule of each structure; half of the strings are written from the other end."""
    keys = G.canonical_keys(*_graph(spark, d, turned=True))
    return keys.groupBy("structure").agg(F.min("mol_id").alias("mol_id"), F.count(F.lit(1)).alias("writings")).drop("structure")
