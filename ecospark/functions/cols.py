"""Column naming and selection helpers.

Reference column names hold spaces, brackets, '#', '-' and commas (and trailing spaces), so every
reference to a name goes through :func:`c`, which back-quotes it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def q(name: str) -> str:
    """Back-quote a column name for SQL text / ``F.col``."""
    return "`" + name.replace("`", "``") + "`"


def c(name: str) -> Column:
    """Column by literal name, whatever characters it holds."""
    return F.col(q(name))


def safe_name(value: str, prefix: str = "") -> str:
    """A lower-case identifier derived from a value (pivot headers, family columns)."""
    return prefix + re.sub(r"[^0-9a-zA-Z]+", "_", str(value)).strip("_").lower()


def keep(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """B1: keep a named column list, in the given order."""
    return df.select(*[c(n) for n in names])


def discard(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """B2: drop columns if present (absent names are ignored)."""
    present = set(df.columns)
    return df.drop(*[n for n in names if n in present])


def by_position(df: DataFrame, first: int, rest_from: int, drop: Iterable[str] = ()) -> DataFrame:
    """Column ``first`` plus every column from ``rest_from`` on, after dropping ``drop``."""
    cols = [n for n in df.columns if n not in set(drop)]
    return df.select(*[c(n) for n in [cols[first], *cols[rest_from:]]])


def numeric(df: DataFrame) -> list[str]:
    """Names of numeric columns."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]


def categorical(df: DataFrame) -> list[str]:
    """Names of string / boolean columns."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BooleanType))]


def replace_columns(df: DataFrame, exprs: Mapping[str, Column]) -> DataFrame:
    """Add or replace columns on the same DataFrame (never concatenate frames by position)."""
    return df.withColumns(dict(exprs))


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename by dictionary; names not in the frame are ignored, others pass through."""
    present = set(df.columns)
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in present})


def rename_values(df: DataFrame, name: str, rules: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """B5, long form: replace the values of column ``name`` by a rule table ``(old, new)``; values without a rule (and
    nulls) stay. ``old`` must be unique in the rules, else rows would multiply."""
    r = rules.select(c(old).alias("_old"), c(new).alias("_new"))
    joined = df.join(r, c(name) == F.col("_old"), "left").withColumn(name, F.coalesce("_new", c(name)))
    return joined.select(*[c(x) for x in df.columns])


def canonical_key(df: DataFrame, preferred: str, key: str, fallback: str | None = None, drop: Iterable[str] = ()) -> DataFrame:
    """The column ``preferred`` takes the place and name of ``key`` if the frame has it; else ``fallback`` does and the columns
    ``drop`` go; else nothing changes. Neither needs ``key`` to exist."""
    source = next((x for x in (preferred, fallback) if x and x in df.columns), None)
    if source is None or source == key:
        return df
    out = discard(df, [key]).withColumnRenamed(source, key)
    return out if source == preferred else discard(out, drop)


def evaluate_once(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """Add ``expr`` as column ``name`` so that it is evaluated once per row.

    Catalyst substitutes aliases into filters pushed through a projection, so an expensive
    expression used by several predicates (or by a predicate and the output) is re-evaluated each
    time. Producing it from a one-element ``inline`` generator makes it a generated attribute:
    predicates on it stay above the generator and reference the computed value."""
    return df.select("*", F.inline(F.array(F.struct(expr.alias(name)))))
