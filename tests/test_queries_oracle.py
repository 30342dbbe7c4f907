"""Every registered query with an oracle must match DuckDB on the smallest driver tables."""

import collections
import math
import os

import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (0.0 if round(v, 5) == 0 else round(v, 5))
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), _norm(x)) for k, x in v.items()))
    return v


def _bag(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return collections.Counter(tuple(_norm(r[i]) for i in order) for r in rows)


def _keys():
    import __spark_entry__ as E

    return sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
@pytest.mark.parametrize("key", _keys() if os.path.isdir(SF) else [])
def test_query_matches_oracle(spark, duck, key):
    import __spark_entry__ as E

    df = E.queries()[key](spark, SF)
    rows = df.collect()
    res = duck.execute(E.oracle_sql()[key])
    dcols = [x[0] for x in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _bag(df.columns, rows) == _bag(dcols, res.fetchall())


def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() >= 0 and "p_mean" in df.columns
    assert set(E.oracle_sql()) <= set(E.queries())
