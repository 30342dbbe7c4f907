"""Row-level cleaning as native Column expressions and narrow DataFrame ops.

Everything here is a projection or a filter: no shuffle, fully inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.ml.feature import Imputer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ecospark.functions.cols import c, evaluate_once

ColumnOrName = Column | str


def _col(x: ColumnOrName) -> Column:
    return c(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- filters

def where_eq(df: DataFrame, col: str, value) -> DataFrame:
    """Equality filter."""
    return df.filter(c(col) == F.lit(value))


def where_not_in(df: DataFrame, col: str, values: Iterable) -> DataFrame:
    """NOT IN that keeps nulls, as a pandas ``~isin`` mask does."""
    return df.filter(c(col).isNull() | ~c(col).isin(list(values)))


def where_present(df: DataFrame, col: str) -> DataFrame:
    """Keep rows where ``col`` is not null."""
    return df.filter(c(col).isNotNull())


def drop_missing(df: DataFrame, subset: Sequence[str] | None = None, min_present: int | None = None) -> DataFrame:
    """Drop rows null in ``subset`` (or any column); with ``min_present`` keep rows having
    at least that many non-null values (pandas ``dropna(thresh=k)``)."""
    if min_present is not None:
        return df.dropna(thresh=min_present, subset=list(subset) if subset else None)
    return df.dropna(how="any", subset=list(subset) if subset else None)


def min_present_ratio(df: DataFrame, ratio: float = 0.9) -> int:
    """The threshold ``int(ratio * ncols)`` the reference uses."""
    return int(ratio * len(df.columns))


# ---------------------------------------------------------------- value rewrites

def merge_values(df: DataFrame, col: str, values: Iterable, into) -> DataFrame:
    """Replace any of ``values`` by ``into``."""
    return df.withColumn(col, F.when(c(col).isin(list(values)), F.lit(into)).otherwise(c(col)))


def species_name(col: ColumnOrName) -> Column:
    """Replace '/' by '&', then keep the first ';'-separated token."""
    return F.split(F.replace(_col(col), F.lit("/"), F.lit("&")), ";").getItem(0)


def to_number(col: ColumnOrName) -> Column:
    """Coerce to double, unparsable text -> null (pandas ``to_numeric(errors='coerce')``)."""
    return _col(col).try_cast("double")


def to_key(col: ColumnOrName, decimals: int | None = None) -> Column:
    """Cast a join key to string. Doubles get a fixed format (``%.{decimals}f``) when asked (Q10)."""
    x = _col(col)
    if decimals is not None:
        return F.format_string(f"%.{decimals}f", x)
    return x.cast("string")


def fill(df: DataFrame, value, subset: Sequence[str] | None = None) -> DataFrame:
    """Fill nulls by a constant."""
    return df.fillna(value, subset=list(subset) if subset else None)


def fill_mean(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fill nulls by the column mean (one aggregate pass, then a projection)."""
    if not cols:
        return df
    tmp = [f"__imp_{i}" for i in range(len(cols))]
    casted = df.withColumns({t: c(n).cast("double") for t, n in zip(tmp, cols)})
    model = Imputer(strategy="mean", inputCols=tmp, outputCols=tmp).fit(casted)
    out = model.transform(casted)
    return out.withColumns({n: c(t) for t, n in zip(tmp, cols)}).drop(*tmp)


def quantile_value(df: DataFrame, col: str, q: float, exact: bool = True) -> float | None:
    """G13 helper: one quantile as a driver scalar (linear interpolation like pandas when exact)."""
    from ecospark.operators.profile import quantile

    return quantile(df, col, q, exact).first()["quantile"]


def clip_upper(df: DataFrame, col: str, q: float = 0.99, exact: bool = True) -> DataFrame:
    """Clip above at the q-quantile of the column. Missing values (null, NaN) stay missing."""
    bound = quantile_value(df, col, q, exact)
    if bound is None:
        return df
    v = c(col).cast("double")
    return df.withColumn(col, F.when(~F.isnan(v) & (v > F.lit(float(bound))), F.lit(float(bound))).otherwise(c(col)))


def log1p(col: ColumnOrName) -> Column:
    """B23."""
    return F.log1p(_col(col))


# ---------------------------------------------------------------- identifiers

def format_cas(col: ColumnOrName) -> Column:
    """Digits -> ``first-mid-check`` with Python slice semantics (s[:-3], s[-3:-1], s[-1])."""
    s = _col(col).cast("string")
    n = F.length(s)
    first = F.substring(s, F.lit(1), F.greatest(n - 3, F.lit(0)))
    mid = F.substring(s, F.greatest(n - 2, F.lit(1)), F.least(F.lit(2), n - 1))
    last = F.substring(s, n, F.lit(1))
    return F.when(n > 0, F.concat_ws("-", first, mid, last))


def split_name(col: ColumnOrName) -> tuple[Column, Column]:
    """A trailing space-separated token holding '(' and ')' becomes the candidate (parentheses
    stripped) and is removed from the name. Returns ``(name, candidate)``."""
    s = _col(col)
    last = F.element_at(F.split(s, " "), -1)
    hit = s.contains(" ") & last.contains("(") & last.contains(")")
    name = F.when(hit, F.substring(s, F.lit(1), F.length(s) - F.length(last) - 1)).otherwise(s)
    candidate = F.when(hit, F.trim(last, F.lit("()")))
    return name, candidate


# ---------------------------------------------------------------- text tests

def mentions(col: ColumnOrName, keyword: str) -> Column:
    """Case-insensitive substring test; null -> false."""
    return F.coalesce(F.lower(_col(col)).contains(keyword.lower()), F.lit(False))


def occurrences(col: ColumnOrName, needle: str) -> Column:
    """Non-overlapping occurrences of a literal substring (Python ``str.count``)."""
    s = _col(col)
    return ((F.length(s) - F.length(F.replace(s, F.lit(needle), F.lit("")))) / F.lit(len(needle))).cast("int")


def is_biologic(col: ColumnOrName, needle: str = "C(=O)N", max_count: int = 5) -> Column:
    """More than ``max_count`` peptide-bond substrings."""
    return occurrences(col, needle) > max_count


def is_mixture(col: ColumnOrName, sep: str = ".") -> Column:
    """Holds the component separator."""
    return _col(col).contains(sep)


# ---------------------------------------------------------------- status trail

def add_status(df: DataFrame, message: str | Column, when: Column | None = None, col: str = "Status") -> DataFrame:
    """Append ``message + '; '`` to the status column (on rows matching ``when``)."""
    cur = F.coalesce(c(col), F.lit("")) if col in df.columns else F.lit("")
    msg = message if isinstance(message, Column) else F.lit(message)
    new = F.concat(cur, msg, F.lit("; "))
    return df.withColumn(col, new if when is None else F.when(when, new).otherwise(cur))


def filter_status(converted: Column, passed: Column) -> Column:
    """Status text from the conversion and filter outcomes."""
    return (
        F.when(~F.coalesce(converted, F.lit(False)), F.lit("SMILES conversion failed"))
        .when(passed, F.lit("SMILES conversion successful, Passed initial filtering"))
        .otherwise(F.lit("SMILES conversion successful, Failed initial filtering"))
    )


# ---------------------------------------------------------------- structure rules

# Fixed values that must equal the reference's: the metal symbols that make a structure inorganic.
METALS = [
    "Li", "Be", "Na", "Mg", "Al", "K", "Ca", "Sc", "Ti", "V", "Cr", "Mn", "Fe", "Co", "Ni", "Cu",
    "Zn", "Ga", "Rb", "Sr", "Y", "Zr", "Nb", "Mo", "Tc", "Ru", "Rh", "Pd", "Ag", "Cd", "In", "Sn",
    "Sb", "Cs", "Ba", "La", "Hf", "Ta", "W", "Re", "Os", "Ir", "Pt", "Au", "Hg", "Tl", "Pb", "Bi",
]

# Standard atomic weights (IUPAC conventional values) for formula masses.
ATOMIC_MASS = {
    "H": 1.008, "He": 4.0026, "Li": 6.94, "Be": 9.0122, "B": 10.81, "C": 12.011, "N": 14.007, "O": 15.999,
    "F": 18.998, "Ne": 20.180, "Na": 22.990, "Mg": 24.305, "Al": 26.982, "Si": 28.085, "P": 30.974,
    "S": 32.06, "Cl": 35.45, "Ar": 39.948, "K": 39.098, "Ca": 40.078, "Sc": 44.956, "Ti": 47.867,
    "V": 50.942, "Cr": 51.996, "Mn": 54.938, "Fe": 55.845, "Co": 58.933, "Ni": 58.693, "Cu": 63.546,
    "Zn": 65.38, "Ga": 69.723, "Ge": 72.630, "As": 74.922, "Se": 78.971, "Br": 79.904, "Kr": 83.798,
    "Rb": 85.468, "Sr": 87.62, "Y": 88.906, "Zr": 91.224, "Nb": 92.906, "Mo": 95.95, "Tc": 98.0,
    "Ru": 101.07, "Rh": 102.91, "Pd": 106.42, "Ag": 107.87, "Cd": 112.41, "In": 114.82, "Sn": 118.71,
    "Sb": 121.76, "Te": 127.60, "I": 126.90, "Xe": 131.29, "Cs": 132.91, "Ba": 137.33, "La": 138.91,
    "Ce": 140.12, "Nd": 144.24, "Sm": 150.36, "Eu": 151.96, "Gd": 157.25, "Hf": 178.49, "Ta": 180.95,
    "W": 183.84, "Re": 186.21, "Os": 190.23, "Ir": 192.22, "Pt": 195.08, "Au": 196.97, "Hg": 200.59,
    "Tl": 204.38, "Pb": 207.2, "Bi": 208.98, "U": 238.03,
}

# SMILES atom tokens: bracket atoms, the two-letter organic-subset symbols, then one-letter ones.
_ATOM_TOKEN = r"(\[[0-9]*[A-Za-z][a-z]?|Cl|Br|[BCNOPSFIbcnops])"


def element_set(smiles: ColumnOrName) -> Column:
    """Distinct element symbols of a SMILES string (aromatic lower case mapped to upper)."""
    toks = F.regexp_extract_all(_col(smiles), F.lit(_ATOM_TOKEN), 1)
    sym = F.transform(toks, lambda t: F.initcap(F.translate(t, "[0123456789", "")))
    return F.array_distinct(sym)


def is_organic(elements: Column, metals: Sequence[str] = METALS, carbon: str = "C") -> Column:
    """No metal, carbon present, more than one element."""
    metal_arr = F.array(*[F.lit(m) for m in metals])
    return (~F.arrays_overlap(elements, metal_arr)) & F.array_contains(elements, carbon) & (F.size(elements) > 1)


def molar_mass(formula: ColumnOrName, masses: Mapping[str, float] = ATOMIC_MASS) -> Column:
    """Mass of a molecular formula (``C6H6O``) by a literal element-mass map, row-local (no join).
    Unknown symbols make the mass null."""
    table = F.create_map(*[x for k, v in masses.items() for x in (F.lit(k), F.lit(float(v)))])
    parts = F.regexp_extract_all(_col(formula), F.lit(r"([A-Z][a-z]?[0-9]*)"), 1)
    weights = F.transform(
        parts,
        lambda p: table[F.regexp_extract(p, r"^([A-Z][a-z]?)", 1)]
        * F.coalesce(F.regexp_extract(p, r"([0-9]+)$", 1).try_cast("double"), F.lit(1.0)),
    )
    return F.when(F.size(parts) > 0, F.aggregate(weights, F.lit(0.0), lambda acc, w: acc + w))


def failure_reasons(organic: Column, counterion: Column, biologic: Column, mixture: Column) -> Column:
    """The ordered list of failed rules (empty when the structure passes)."""
    return F.array_compact(
        F.array(
            F.when(~F.coalesce(organic, F.lit(False)), F.lit("Not organic")),
            F.when(F.coalesce(counterion, F.lit(False)), F.lit("Is counterion")),
            F.when(F.coalesce(biologic, F.lit(False)), F.lit("Is biologic")),
            F.when(F.coalesce(mixture, F.lit(False)), F.lit("Is mixture")),
        )
    )


def compound_filter(
    df: DataFrame,
    smiles: str,
    mass: str | None = None,
    keep_failed: bool = False,
    status: str = "Status",
    counterion_below: float = 100.0,
    mixture_sep: str = ".",
    biologic_needle: str = "C(=O)N",
    biologic_max: int = 5,
) -> DataFrame:
    """Four-rule compound filter with a status trail. ``mass`` names a molecular-weight column
    (e.g. from :func:`molar_mass`); rows failing any rule are dropped unless ``keep_failed``."""
    s = c(smiles)
    # the tokeniser runs over whole structure strings: evaluate it once, not once per predicate
    df = evaluate_once(df, "_elements", element_set(s))
    organic = is_organic(F.col("_elements"))
    counter = (c(mass) < counterion_below) if mass else F.lit(False)
    reasons = failure_reasons(organic, counter, is_biologic(s, biologic_needle, biologic_max), is_mixture(s, mixture_sep))
    out = df.withColumn("failure_reasons", F.when(s.isNotNull(), reasons)).drop("_elements")
    msg = (
        F.when(s.isNull(), F.lit("Failed to retrieve SMILES"))
        .when(F.size("failure_reasons") == 0, F.lit("Passed Initial Structural Checks"))
        .otherwise(F.concat(F.lit("Failed checks: "), F.array_join("failure_reasons", ", ")))
    )
    out = add_status(out, msg, col=status)
    if keep_failed:
        return out
    return out.filter(F.size("failure_reasons") == 0)


# ---------------------------------------------------------------- units

# Fixed values that must equal the reference's: concentration unit -> (factor to mg/L, needs molar mass).
# With molar mass the factor multiplies value * mass; without mass those rows keep value and unit.
UNIT_RULES = {
    "AI mg/L": (1.0, False), "mg/L": (1.0, False), "ae mg/L": (1.0, False), "ul/L": (1.0, False),
    "%": (10000.0, False), "ug/L": (1 / 1000, False), "ug/ml": (1.0, False), "uM": (1 / 1000, True),
    "ng/ml": (1 / 1000, False), "ppm": (1.0, False), "pg/g egg": (1e-9, False), "AI ug/L": (1 / 1000, False),
    "ug/g wet wt diet": (1 / 1000, False), "mmol/kg": (1000.0, True), "mM": (1.0, True),
    "umol/L": (0.001, True), "ug/g lipid diet": (1 / 1000, False), "umol/ml": (1.0, True),
    "% dry wght": (10.0, False), "M": (1000.0, True), "% w/v": (10000.0, False),
}


def standardise_units(
    df: DataFrame,
    value: str,
    unit: str,
    mass: str | None = None,
    rules: Mapping[str, tuple[float, bool]] = UNIT_RULES,
    target: str = "mg/L",
) -> DataFrame:
    """Convert ``value`` to ``target`` in place; ``unit`` becomes ``target`` where converted.

    The rule table is a literal map (bounded by construction), so the lookup is row-local: no join."""
    factor = F.create_map(*[x for k, (f, _) in rules.items() for x in (F.lit(k), F.lit(float(f)))])
    needs = F.create_map(*[x for k, (_, m) in rules.items() for x in (F.lit(k), F.lit(bool(m)))])
    u = c(unit)
    f = factor[u]
    nm = needs[u]
    m = c(mass).cast("double") if mass else F.lit(None).cast("double")
    convertible = f.isNotNull() & (~nm | m.isNotNull())
    new_value = F.when(nm, c(value) * m * f).otherwise(c(value) * f)
    return df.withColumns(
        {
            value: F.when(convertible, new_value).otherwise(c(value)),
            unit: F.when(convertible, F.lit(target)).otherwise(u),
        }
    )


def residual(y: ColumnOrName, yhat: ColumnOrName) -> Column:
    """``y - yhat``."""
    return _col(y) - _col(yhat)
