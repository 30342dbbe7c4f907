from pyspark.sql import functions as F

from ecospark.functions import clean as K


def test_units_every_spelling(spark):
    rows = [(u, 2.0, 50.0) for u in K.UNIT_RULES] + [("furlong", 2.0, 50.0), ("uM", 2.0, None), ("mg/L", None, None)]
    df = spark.createDataFrame(rows, "unit string, value double, mass double")
    out = {(r.u0, r.mass): (r.value, r.unit) for r in
           K.standardise_units(df.withColumn("u0", F.col("unit")), "value", "unit", "mass").collect()}
    assert out[("%", 50.0)] == (20000.0, "mg/L")
    assert out[("ug/L", 50.0)] == (0.002, "mg/L")
    assert out[("uM", 50.0)] == (2.0 * 50.0 / 1000, "mg/L")
    assert out[("mmol/kg", 50.0)] == (2.0 * 50.0 * 1000, "mg/L")
    assert out[("M", 50.0)] == (2.0 * 50.0 * 1000, "mg/L")
    assert out[("pg/g egg", 50.0)] == (2.0 * 1e-9, "mg/L")
    assert out[("% dry wght", 50.0)] == (20.0, "mg/L")
    assert out[("furlong", 50.0)] == (2.0, "furlong")  # unknown unit unchanged
    assert out[("uM", None)] == (2.0, "uM")  # missing molar mass: unchanged
    assert len(K.UNIT_RULES) == 21


def test_species_cas_name(spark):
    df = spark.createDataFrame([("Fish/Trout;Other", "50000", "benzene (C1=CC=CC=C1)"), ("Algae", "12", "water"), ("X", "7", "a b")],
                               "s string, cas string, name string")
    n, cand = K.split_name(F.col("name"))
    r = df.select(K.species_name("s").alias("sp"), K.format_cas("cas").alias("cas"), n.alias("n"), cand.alias("c")).collect()
    assert [x.sp for x in r] == ["Fish&Trout", "Algae", "X"]
    assert [x.cas for x in r] == ["50-00-0", "-1-2", "--7"]
    assert (r[0].n, r[0].c) == ("benzene", "C1=CC=CC=C1")
    assert (r[1].n, r[1].c) == ("water", None)


def test_compound_rules(spark):
    rows = [("CCO", 46.0), ("[Na+].[Cl-]", 58.0), ("C", 16.0), ("O=O", 32.0), ("CCN(C)C(=O)c1ccccc1", 163.0),
            ("NC(=O)NC(=O)NC(=O)NC(=O)NC(=O)NC(=O)NC(=O)NCC", 500.0), ("CC[Hg]C", 230.0), ("CCCCCCO.CCO", 150.0)]
    df = spark.createDataFrame(rows, "smiles string, mw double")
    out = {r.smiles: r.failure_reasons for r in K.compound_filter(df, "smiles", "mw", keep_failed=True).collect()}
    assert out["CCN(C)C(=O)c1ccccc1"] == []
    assert out["CCO"] == ["Is counterion"]
    assert "Not organic" in out["[Na+].[Cl-]"] and "Is mixture" in out["[Na+].[Cl-]"]
    assert out["C"] == ["Not organic", "Is counterion"]  # single element
    assert out["O=O"][0] == "Not organic"  # no carbon
    assert out["NC(=O)NC(=O)NC(=O)NC(=O)NC(=O)NC(=O)NC(=O)NCC"] == ["Is biologic"]
    assert out["CC[Hg]C"] == ["Not organic"]  # metal
    kept = K.compound_filter(df, "smiles", "mw").select("smiles", "Status").collect()
    assert [(r.smiles, r.Status) for r in kept] == [("CCN(C)C(=O)c1ccccc1", "Passed Initial Structural Checks; ")]


def test_molar_mass(spark):
    df = spark.createDataFrame([("C6H6",), ("H2O",), ("Xx2",)], "f string")
    m = [r.m for r in df.select(K.molar_mass("f").alias("m")).collect()]
    assert abs(m[0] - (6 * 12.011 + 6 * 1.008)) < 1e-9
    assert abs(m[1] - 18.015) < 1e-9
    assert m[2] is None


def test_filters_and_fill(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, 3.0), (3, "b", 5.0)], "k int, s string, v double")
    assert sorted(r.k for r in K.where_not_in(df, "s", ["a"]).collect()) == [2, 3]  # null kept
    assert [r.k for r in K.drop_missing(df, min_present=3).collect()] == [3]
    filled = {r.k: r.v for r in K.fill_mean(df, ["v"]).collect()}
    assert filled[1] == 4.0


def test_canonical_key(spark):
    from ecospark.functions import cols as C

    df = spark.createDataFrame([("a", "A", "x", 1)], "name string, name_clean string, cas string, n int")
    assert C.canonical_key(df, "name_clean", "name").first().asDict() == {"name": "A", "cas": "x", "n": 1}
    assert C.canonical_key(df, "absent", "name", "cas", ["n", "zz"]).first().asDict() == {"name": "x", "name_clean": "A"}
    assert C.canonical_key(df, "absent", "name").columns == df.columns and C.canonical_key(df, "name", "name").columns == df.columns
    assert C.canonical_key(df, "cas", "key").columns == ["name", "name_clean", "key", "n"]
