import math

from ecospark.operators import sensitivity as S

ROWS = [
    # chemical A: 4 species groups, ties and a null
    ("A", "Algae", 2.0, 1), ("A", "Algae", 1.0, 2), ("A", "Algae", 1.0, 3), ("A", "Crustaceans", 4.0, 4),
    ("A", "Amphibians", None, 5), ("A", "Other Invertebrates", 8.0, 6),
    # chemical B: 3 groups, one zero concentration
    ("B", "Algae", 0.0, 7), ("B", "Crustaceans", 3.0, 8), ("B", "Amphibians", 5.0, 9),
    # chemical C: 2 groups only
    ("C", "Algae", 1.0, 10), ("C", "Crustaceans", 1.0, 11),
]
GROUPS = ["Algae", "Amphibians", "Crustaceans", "Other Invertebrates"]


def test_eligible_and_minimum(spark):
    df = spark.createDataFrame(ROWS, "cas string, sp string, conc double, id int")
    assert sorted({r.cas for r in S.eligible(df, "cas", "sp", 3).collect()}) == ["A", "B"]
    best = {(r.cas, r.sp): (r.conc, r.id) for r in S.most_sensitive(df, "cas", "sp", "conc", ["id"]).collect()}
    assert best[("A", "Algae")] == (1.0, 2)  # tie broken by id
    assert ("A", "Amphibians") not in best  # null concentration excluded
    fused = {(r.cas, r.sp) for r in S.most_sensitive_eligible(df, "cas", "sp", "conc", ["id"]).collect()}
    # A counts 4 groups (the all-null group counts for eligibility) but emits 3 rows
    assert fused == {("A", "Algae"), ("A", "Crustaceans"), ("A", "Other Invertebrates"),
                     ("B", "Algae"), ("B", "Crustaceans"), ("B", "Amphibians")}


def test_summary_values(spark):
    recs = spark.createDataFrame(ROWS, "cas string, sp string, conc double, id int")
    mass = spark.createDataFrame([("A", "chem A", 100.0), ("B", "chem B", 10.0), ("C", "chem C", 1.0)],
                                 "key string, name string, mw double")
    out = {r.cas: r for r in S.summary(recs, mass, "cas", "name", "sp", "conc", "key", "mw", GROUPS, ["id"]).collect()}
    assert set(out) == {"A", "B"}
    a = out["A"]
    assert math.isclose(a.p_algae, -math.log10(1.0 / 100.0 * 1000))
    assert a.p_amphibians is None
    vals = [a.p_algae, 0.0, a.p_crustaceans, a.p_other_invertebrates]
    m = sum(vals) / 4
    assert math.isclose(a.p_mean, m)
    assert math.isclose(a.p_sd, math.sqrt(sum((v - m) ** 2 for v in vals) / 3))
    assert out["B"].p_algae is None  # zero concentration -> undefined p


def test_p_endpoint_null_branches(spark):
    df = spark.createDataFrame([(1.0, -5.0), (1.0, 0.0), (None, 3.0), (2.0, 4.0)], "c double, m double")
    got = [r.p for r in df.select(S.p_endpoint("c", "m").alias("p")).collect()]
    assert got[:3] == [None, None, None]
    assert math.isclose(got[3], -math.log10(2.0 / 4.0 * 1000))


def test_consistency_rule(spark):
    df = spark.createDataFrame([("A", "x", 1.0), ("A", "x", 4.0), ("B", "x", 1.0), ("B", "x", 2.5)], "k string, s string, v double")
    assert {r.k for r in S.consistent(df, ["k", "s"], "v", 3.0).collect()} == {"B"}
