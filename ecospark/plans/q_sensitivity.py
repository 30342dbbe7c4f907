"""Flagship and sensitivity analogue queries: chemical = o_custkey, species group = o_orderpriority,
concentration = o_totalprice, molar mass = c_acctbal (FIXTURES §4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ecospark.functions.clean import species_name
from ecospark.functions.cols import safe_name
from ecospark.operators import sensitivity as S
from ecospark.plans.registry import register, rounded
from ecospark.session import table

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
P_COLS = [safe_name(v, "p_") for v in PRIORITIES]


def _records(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", species_name("o_orderpriority").alias("o_orderpriority"), "o_totalprice"
    )


def sensitivity_summary(spark, d):
    out = S.summary(
        _records(spark, d),
        table(spark, d, "customer"),
        chem="o_custkey",
        name="c_name",
        species="o_orderpriority",
        conc="o_totalprice",
        mass_key="c_custkey",
        mass="c_acctbal",
        species_values=PRIORITIES,
        order=["o_orderkey"],
    )
    return rounded(out)


_O = """o AS (SELECT o_orderkey, o_custkey, split_part(replace(o_orderpriority, '/', '&'), ';', 1) AS o_orderpriority,
               o_totalprice FROM orders)"""
_ELIG = """elig AS (SELECT o_custkey FROM o WHERE o_custkey IS NOT NULL AND o_orderpriority IS NOT NULL
                  GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) >= 3)"""
_BEST = """best AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice FROM (
             SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice, o_orderkey) AS rn
             FROM o WHERE o_custkey IS NOT NULL AND o_orderpriority IS NOT NULL AND o_totalprice IS NOT NULL) t
           WHERE rn = 1)"""
_P = "CASE WHEN b.o_totalprice / c.c_acctbal * 1000 > 0 THEN -log10(b.o_totalprice / c.c_acctbal * 1000) END"
_PIVOT = ",\n".join(f"max(CASE WHEN o_orderpriority = '{v}' THEN p END) AS {n}" for v, n in zip(PRIORITIES, P_COLS))
_ANY = " OR ".join(f"{n} IS NOT NULL" for n in P_COLS)
_MEAN = "(" + " + ".join(f"coalesce({n}, 0)" for n in P_COLS) + f") / {len(P_COLS)}.0"
_SD = "sqrt((" + " + ".join(f"(coalesce({n}, 0) - m) * (coalesce({n}, 0) - m)" for n in P_COLS) + f") / {len(P_COLS) - 1}.0)"

FLAGSHIP_SQL = f"""
WITH {_O}, {_ELIG}, {_BEST},
pv AS (SELECT b.o_custkey, c.c_name, b.o_orderpriority, {_P} AS p
       FROM best b JOIN elig e ON b.o_custkey = e.o_custkey LEFT JOIN customer c ON b.o_custkey = c.c_custkey),
w AS (SELECT o_custkey, c_name, {_PIVOT} FROM pv WHERE c_name IS NOT NULL GROUP BY o_custkey, c_name),
m AS (SELECT *, {_MEAN} AS m FROM w WHERE {_ANY})
SELECT o_custkey, c_name, {", ".join(f"round({n}, 6) AS {n}" for n in P_COLS)},
       round(m, 6) AS p_mean, round({_SD}, 6) AS p_sd
FROM m
"""

register("flagship_sensitivity_summary", FLAGSHIP_SQL)(sensitivity_summary)


@register(
    "G5_eligible_chemicals",
    f"""WITH {_O}, {_ELIG}
    SELECT o.o_orderkey, o.o_custkey, o.o_orderpriority, round(o.o_totalprice, 6) AS o_totalprice
    FROM o WHERE o.o_custkey IN (SELECT o_custkey FROM elig)""",
)
def g5(spark, d):
    return rounded(S.eligible(_records(spark, d), "o_custkey", "o_orderpriority", 3))


@register(
    "G6_most_sensitive_record",
    f"""WITH {_O}, {_BEST} SELECT o_orderkey, o_custkey, o_orderpriority, round(o_totalprice, 6) AS o_totalprice FROM best""",
)
def g6(spark, d):
    return rounded(S.most_sensitive(_records(spark, d), "o_custkey", "o_orderpriority", "o_totalprice", ["o_orderkey"]))


@register(
    "B21_p_endpoint",
    """SELECT o.o_orderkey, round(CASE WHEN o.o_totalprice / c.c_acctbal * 1000 > 0
                 THEN -log10(o.o_totalprice / c.c_acctbal * 1000) END, 6) AS p
       FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey""",
)
def b21(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    cu = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    out = o.join(cu, "o_custkey", "left").select("o_orderkey", S.p_endpoint("o_totalprice", "c_acctbal").alias("p"))
    return rounded(out)


@register(
    "G8_species_pivot",
    f"""WITH {_O}, {_BEST},
    w AS (SELECT b.o_custkey, c.c_name, {_PIVOT.replace('THEN p END', 'THEN o_totalprice END')}
          FROM best b LEFT JOIN customer c ON b.o_custkey = c.c_custkey WHERE c.c_name IS NOT NULL GROUP BY b.o_custkey, c.c_name)
    SELECT o_custkey, c_name, {", ".join(f"round({n}, 6) AS {n}" for n in P_COLS)} FROM w WHERE {_ANY}""",
)
def g8(spark, d):
    best = S.most_sensitive(_records(spark, d), "o_custkey", "o_orderpriority", "o_totalprice", ["o_orderkey"])
    cu = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return rounded(S.pivot(best.join(cu, "o_custkey", "left"), ["o_custkey", "c_name"], "o_orderpriority",
                           "o_totalprice", PRIORITIES, names=P_COLS))


@register(
    "G20_row_mean_sd",
    f"""WITH w AS (SELECT o_custkey, {_PIVOT.replace('THEN p END', 'THEN o_totalprice / 1000 END')}
                 FROM orders GROUP BY o_custkey),
    m AS (SELECT *, {_MEAN} AS m FROM w)
    SELECT o_custkey, round(m, 6) AS p_mean, round({_SD}, 6) AS p_sd FROM m""",
)
def g20(spark, d):
    o = table(spark, d, "orders")
    w = o.groupBy("o_custkey").agg(
        *[F.max(F.when(F.col("o_orderpriority") == v, F.col("o_totalprice") / 1000)).alias(n)
          for v, n in zip(PRIORITIES, P_COLS)]
    )
    return rounded(S.mean_sd(w, P_COLS).select("o_custkey", "p_mean", "p_sd"))


@register(
    "G21_replicate_consistency",
    """WITH g AS (SELECT o_custkey, o_orderpriority FROM orders GROUP BY 1, 2
                 HAVING min(o_totalprice) <= 0 OR max(o_totalprice) / min(o_totalprice) > 3)
    SELECT o.o_orderkey, o.o_custkey, o.o_orderpriority FROM orders o
    WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.o_custkey = o.o_custkey AND g.o_orderpriority = o.o_orderpriority)""",
)
def g21(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    return S.consistent(o, ["o_custkey", "o_orderpriority"], "o_totalprice", 3.0).select(
        "o_orderkey", "o_custkey", "o_orderpriority")
