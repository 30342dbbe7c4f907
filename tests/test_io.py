import os

from pyspark.sql import functions as F

from ecospark.sources import io as IO


def test_csv_and_lines(spark, tmp_dir):
    df = spark.createDataFrame([(1, "a b", 1.5), (2, "c", None)], "k int, s string, v double")
    p = os.path.join(tmp_dir, "t.csv")
    IO.write_csv(df, p)
    back = IO.scan_csv(spark, p, "k int, s string, v double")
    assert sorted(back.collect()) == sorted(df.collect())
    assert IO.width(back) == 3
    lines = os.path.join(tmp_dir, "lines.txt")
    with open(lines, "w") as f:
        f.write("first\nsecond\n")
    attached = IO.attach_by_position(df, IO.scan_lines(spark, lines), "smiles", order=["k"]).collect()
    assert [(r.k, r.smiles) for r in attached] == [(1, "first"), (2, "second")]


SDF = """mol-a
  test

  3  2  0  0  0  0  0  0  0  0999 V2000
    0.0000    0.0000    0.0000 C   0  0  0  0  0  0  0  0  0  0  0  0
    0.0000    0.0000    0.0000 C   0  0  0  0  0  0  0  0  0  0  0  0
    0.0000    0.0000    0.0000 O   0  0  0  0  0  0  0  0  0  0  0  0
  1  2  1  0
  2  3  1  0
M  END
> <Standardized_InChI>
InChI=1S/C2H6O/c1-2-3/h3H,2H2,1H3

> <Status>
Passed

$$$$
broken
  test

  x  y
$$$$
empty
  test

  0  0  0  0  0  0  0  0  0  0999 V2000
M  END
$$$$
"""


def test_sdf_scan_skips_bad_records_and_round_trips(spark, tmp_dir):
    p = os.path.join(tmp_dir, "m.sdf")
    with open(p, "w") as f:
        f.write(SDF)
    recs, atoms, bonds = IO.scan_sdf(spark, p)
    r = recs.collect()
    assert [(x.name, x.n_atoms, x.n_bonds) for x in r] == [("mol-a", 3, 2)]
    assert r[0].tags["Status"] == "Passed"
    assert sorted(x.element for x in atoms.collect()) == ["C", "C", "O"]
    assert sorted((x.a, x.b) for x in bonds.collect()) == [(1, 2), (2, 3)]
    mb = IO.molblocks(atoms.withColumn("mol_id", F.lit("again")), bonds.withColumn("mol_id", F.lit("again")))
    out = os.path.join(tmp_dir, "out.sdf")
    IO.write_sdf(mb.withColumn("Status", F.lit("ok")), out, tags=["Status"])
    r2, a2, b2 = IO.scan_sdf(spark, out)
    assert [(x.name, x.n_atoms, x.n_bonds, x.tags["Status"]) for x in r2.collect()] == [("again", 3, 2, "ok")]


def test_payload_fields(spark):
    df = spark.createDataFrame([('{"id": {"cid": 7}, "w": 1.5}', "<p><strong>IUPAC Standard InChI:</strong> <span>InChI=1S/X</span></p>"),
                                ('{"w": 2}', "<p>nothing</p>")], "j string, html string")
    out = IO.json_field(df, "j", "$.id.cid", "cid", "int")
    out = IO.html_field(out, "html", IO.labelled_span("IUPAC Standard InChI:"), "inchi").collect()
    assert [(r.cid, r.inchi) for r in out] == [(7, "InChI=1S/X"), (None, None)]
    csv = IO.csv_fields(spark.createDataFrame([("a,1,2.5",)], "p string"), "p", "n string, i int, x double").first()
    assert (csv.n, csv.i, csv.x) == ("a", 1, 2.5)


def test_sdf_crlf_charges_and_aromatic_atoms(spark, tmp_dir):
    p = os.path.join(tmp_dir, "crlf.sdf")
    ring = SDF.split("$$$$\n")[0].replace("  1  2  1  0", "  1  2  4  0").replace("M  END", "M  CHG  1   3  -1\nM  END")
    with open(p, "w", newline="") as f:
        f.write((ring + "$$$$\n" + "\n" + ring.split("\n", 1)[1] + "$$$$\n").replace("\n", "\r\n"))
    recs, atoms, bonds = IO.scan_sdf(spark, p)
    assert sorted(r.name for r in recs.collect()) == ["", "mol-a"]
    rows = sorted({(a.atom_id, a.element, a.aromatic, a.charge) for a in atoms.collect()})
    assert rows == [(1, "C", True, None), (2, "C", True, None), (3, "O", False, -1.0)]
    assert recs.filter("tags['Status'] = 'Passed'").count() == 2


def test_molecules_beyond_three_digits_round_trip(spark, tmp_dir):
    """More than 999 atoms and bonds (V3000) beside an ordinary molecule, built with joins from ids."""
    n = 1201
    atoms = spark.range(n).selectExpr("1L AS mol_id", "int(id + 1) AS atom_id", "if(id % 3 = 0, 'N', 'C') AS element").unionByName(
        spark.range(3).selectExpr("2L AS mol_id", "int(id + 1) AS atom_id", "'O' AS element"))
    bonds = spark.range(n - 1).selectExpr("1L AS mol_id", "int(id + 1) AS a", "int(id + 2) AS b", "1.0D AS bond_order", "id < 2 AS aromatic").unionByName(
        spark.range(1).selectExpr("2L AS mol_id", "1 AS a", "2 AS b", "2.0D AS bond_order", "false AS aromatic"))
    p = os.path.join(tmp_dir, "big")
    IO.write_sdf(IO.molblocks(atoms, bonds), p)
    recs, back, edges = IO.scan_sdf(spark, p)
    got = {r.name: (r.n_atoms, r.n_bonds) for r in recs.collect()}
    assert got == {"1": (n, n - 1), "2": (3, 1)}
    assert back.groupBy("element").count().collect().__len__() == 3 and back.filter("element = 'N'").count() == 401
    assert back.filter("aromatic").count() == 3 and edges.filter("a + 1 <> b").count() == 0
    assert edges.filter("bond_order = 2").count() == 1


def test_lines_of_many_files_are_numbered_in_path_order(spark, tmp_dir):
    p = os.path.join(tmp_dir, "parts")
    spark.range(500).repartitionByRange(7, "id").sortWithinPartitions("id").selectExpr("cast(id AS string) AS value").write.text(p)
    got = {r.line_no: int(r.value) for r in IO.scan_lines(spark, p).collect()}
    assert got == {i: i for i in range(500)}


def test_cleanup_removes_only_what_the_run_made(spark):
    from ecospark import session

    path, other = IO.scratch(spark, "x"), IO.scratch(spark, "y") + "-kept"
    session._MADE.remove(os.path.dirname(other.removesuffix("-kept")))
    for p in (path, other):
        spark.range(3).write.parquet(p)
    assert spark.read.parquet(path).count() == 3 and session.cleanup(spark) >= 1
    local = lambda p: p.removeprefix("file:")
    assert not os.path.exists(local(path)) and os.path.exists(local(other)) and not session._MADE
