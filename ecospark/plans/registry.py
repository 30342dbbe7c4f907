"""Registry of the analogue queries over the driver's tables: one Spark callable and (where the
semantics are SQL-expressible) one DuckDB oracle string per SURVEY operator ID."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(key: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql.strip()
        return fn

    return deco


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column so the oracle compare is not at the mercy of the last ulp.

    ``round(x * 10^d) / 10^d`` is the arithmetic DuckDB's ``round(x, d)`` performs; Spark's own
    ``round`` goes half-up on the shortest decimal string and disagrees on exact-half boundaries."""
    scale = float(10**digits)
    exprs = {
        f.name: F.round(F.col(f"`{f.name}`") * F.lit(scale)) / F.lit(scale)
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(exprs) if exprs else df


def load_all() -> None:
    """Import every module that registers queries."""
    from ecospark.plans import (  # noqa: F401
        q_clean,
        q_dedup,
        q_features,
        q_joins,
        q_models,
        q_molgraph,
        q_profile,
        q_resolve,
        q_sensitivity,
        q_sources,
    )
