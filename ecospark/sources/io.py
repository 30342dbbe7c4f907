"""Scans and sinks.

Files are read and written by Spark's own sources (CSV, text, JSON, Parquet); record-structured
text (SDF) is split by a multi-character record separator and parsed with string functions.
Positional attachment uses explicit line numbers (numbers within each file split plus the counts of the
splits before it), never row order after a shuffle.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ecospark.functions.cols import c
from ecospark.session import cut_lineage, new_folder

# ---------------------------------------------------------------- scans


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, sep: str = ",",
             header: bool = True) -> DataFrame:
    """CSV with a header; an explicit schema avoids the inference pass."""
    r = spark.read.option("header", header).option("sep", sep)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    return r.csv(path)


def limit_rows(df: DataFrame, n: int | None, order: Sequence[str]) -> DataFrame:
    """A3: the first n rows in a declared order (None = all rows)."""
    return df if n is None else df.orderBy(*[c(o) for o in order]).limit(n)


def width(df: DataFrame) -> int:
    """A5: column count (schema only, no job)."""
    return len(df.columns)


def _before(blocks: DataFrame, order: Sequence[str]) -> DataFrame:
    """``blocks`` (one row per file split or partition: bounded) with ``_off``, the rows of the blocks before each."""
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))


def scan_lines(spark: SparkSession, path: str, name: str = "value") -> DataFrame:
    """One record per line with its 0-based line number ``line_no``; files in path order.

    Lines are numbered in the JVM: every file split numbers its own, the counts of the splits before it are added.
    The numbered lines are materialised, because two passes read them."""
    raw = spark.read.text(path).select(c("value").alias(name), F.col("_metadata.file_path").alias("_p"), F.col("_metadata.file_block_start").alias("_b"))
    raw = cut_lineage(raw.withColumn("_id", F.monotonically_increasing_id()))
    blocks = _before(raw.groupBy("_p", "_b").agg(F.min("_id").alias("_m"), F.count(F.lit(1)).alias("_n")), ["_p", "_b"])
    return raw.join(F.broadcast(blocks), ["_p", "_b"]).select((F.col("_off") + F.col("_id") - F.col("_m")).alias("line_no"), c(name))


def with_position(df: DataFrame, name: str = "row_no") -> DataFrame:
    """Consecutive 0-based position of each row in the DataFrame's current order (materialised once: a sort's
    partition bounds come from sampling, and two passes must agree on them)."""
    keyed = cut_lineage(df.withColumn("_id", F.monotonically_increasing_id()))  # partition number and place in it
    part, place = F.expr("shiftright(_id, 33)"), F.expr("_id & 8589934591")
    blocks = _before(keyed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")), ["_part"]).drop("_n")
    out = keyed.withColumn("_part", part).join(F.broadcast(blocks), "_part")
    return out.select((F.col("_off") + place).alias(name), *[c(x) for x in df.columns])


def attach_by_position(df: DataFrame, lines: DataFrame, name: str, order: Sequence[str] | None = None) -> DataFrame:
    """Attach a line list to a table by position, after checking equal lengths.
    With ``order`` the table is sorted first (a declared order instead of file order)."""
    base = df.orderBy(*[c(o) for o in order]) if order else df
    n_df, n_lines = base.count(), lines.count()
    if n_df != n_lines:
        raise ValueError(f"length mismatch: {n_df} rows vs {n_lines} lines")
    indexed = with_position(base, "_pos")
    return indexed.join(lines.select(F.col("line_no").alias("_pos"), F.col("value").alias(name)), "_pos").drop("_pos")


# ---------------------------------------------------------------- SDF

RECORD_SEP = "$$$$"


def _between(lines: Column, first: str, n: Column) -> Column:
    """``n`` lines after the line ``first``."""
    return F.slice(lines, (F.array_position(lines, first) + 1).cast("int"), n)


def scan_sdf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """SDF (V2000 and V3000, LF or CRLF) -> ``records(record_id, name, n_atoms, n_bonds, tags, molblock)``,
    ``atoms(mol_id, atom_id, element, aromatic, charge)``, ``bonds(mol_id, a, b, bond_order, aromatic)``.

    Records are split by Spark's text source at the record separator and parsed with string functions; they are
    materialised once, because three tables read them. ``record_id`` is unique, not consecutive. An atom is aromatic
    if an aromatic bond touches it; ``charge`` is the formal charge (``M  CHG`` lines, ``CHG=``), null where the file
    states none. Unreadable records (bad counts line, truncated blocks) and zero-atom records are skipped."""
    raw = spark.read.option("lineSep", RECORD_SEP).text(path).filter(F.col("value").rlike(r"\S"))
    # the line break after the separator belongs to it; a file's first record has none before it
    own, rest = F.split("value", "\r?\n"), F.split(F.regexp_replace("value", "^\r?\n", ""), "\r?\n")
    lines = F.when(F.try_element_at(rest, F.lit(4)).rlike("V[23]000"), rest).otherwise(own)
    recs = cut_lineage(raw.select(F.monotonically_increasing_id().alias("record_id"), lines.alias("lines")))
    counts, text = F.try_element_at("lines", F.lit(4)), F.array_join("lines", "\n")
    v3 = counts.contains("V3000")
    number = lambda at, group: F.when(v3, F.regexp_extract(text, r"M  V30 COUNTS +(\d+) +(\d+)", group)).otherwise(
        F.trim(F.substring(counts, at, 3))).try_cast("int")
    parsed = recs.select("record_id", F.try_element_at("lines", F.lit(1)).alias("name"), "lines", v3.alias("v3"),
                         number(1, 1).alias("n_atoms"), number(4, 2).alias("n_bonds"), text.alias("molblock"))
    end_at = F.array_position(F.col("lines"), "M  END")
    need = F.when(F.col("v3"), F.col("n_atoms") + F.col("n_bonds") + 9).otherwise(F.col("n_atoms") + F.col("n_bonds") + 5)
    good = parsed.filter((F.col("n_atoms") > 0) & F.col("n_bonds").isNotNull() & (end_at >= need))
    tag_lines = F.slice("lines", (end_at + 1).cast("int"), F.size("lines"))
    # "> <tag>" lines; the value is the next line
    tag_pairs = F.filter(F.transform(F.sequence(F.lit(1), F.size(tag_lines)), lambda i: F.struct(
        F.regexp_extract(F.try_element_at(tag_lines, i), r"^>\s*<([^>]+)>", 1).alias("k"),
        F.try_element_at(tag_lines, i + 1).alias("v"))), lambda s: s["k"] != "")
    records = good.select("record_id", "name", "n_atoms", "n_bonds",
                          F.map_from_entries(F.transform(tag_pairs, lambda s: F.struct(s["k"], F.coalesce(s["v"], F.lit("")))))
                          .alias("tags"), "molblock")
    bond_lines = F.when(F.col("v3"), _between(F.col("lines"), "M  V30 BEGIN BOND", F.col("n_bonds"))).otherwise(
        F.slice("lines", (F.col("n_atoms") + 5).cast("int"), F.col("n_bonds")))
    field = lambda at, word: F.when(F.col("v3"), F.try_element_at(F.split("line", " +"), F.lit(word))).otherwise(
        F.trim(F.substring("line", at, 3))).cast("int")
    b = good.select(F.col("record_id").alias("mol_id"), "v3", F.explode(bond_lines).alias("line")).select(
        "mol_id", field(1, 5).alias("x"), field(4, 6).alias("y"), field(7, 4).alias("t"))
    bonds = b.select("mol_id", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"),
                     F.when(F.col("t") == 4, F.lit(1.5)).otherwise(F.col("t").cast("double")).alias("bond_order"), (F.col("t") == 4).alias("aromatic"))
    ring = bonds.filter("aromatic").select("mol_id", F.explode(F.array("a", "b")).alias("atom_id")).distinct().withColumn("_ring", F.lit(True))
    atom_lines = F.when(F.col("v3"), _between(F.col("lines"), "M  V30 BEGIN ATOM", F.col("n_atoms"))).otherwise(F.slice("lines", 5, F.col("n_atoms")))
    stated = F.flatten(F.transform(F.filter("lines", lambda x: x.startswith("M  CHG")), lambda x: F.split(F.trim(F.substring(x, 10, 1000)), " +")))
    charges = F.transform(F.sequence(F.lit(0), F.size(stated) - 2, F.lit(2)), lambda i: F.struct(stated[i].cast("int"), stated[i + 1].cast("double")))
    of = F.when(F.size(stated) > 1, F.map_from_entries(charges))
    a = good.select(F.col("record_id").alias("mol_id"), "v3", of.alias("of"), F.posexplode(atom_lines).alias("i", "line"))
    element = F.when(F.col("v3"), F.try_element_at(F.split("line", " +"), F.lit(4))).otherwise(F.trim(F.substring("line", 32, 3)))
    charge = F.when(F.col("v3"), F.regexp_extract("line", r"CHG=(-?\d+)", 1).try_cast("double")).otherwise(F.try_element_at("of", F.col("i") + 1))
    atoms = a.select("mol_id", (F.col("i") + 1).cast("int").alias("atom_id"), element.alias("element"), charge.alias("charge"))
    atoms = atoms.join(ring, ["mol_id", "atom_id"], "left").select(
        "mol_id", "atom_id", "element", F.coalesce("_ring", F.lit(False)).alias("aromatic"), "charge")
    return records, atoms, bonds


def molblocks(atoms: DataFrame, bonds: DataFrame, key: str = "mol_id") -> DataFrame:
    """Connection tables built from ``atoms``/``bonds`` rows (2D coordinates zero): V2000, or V3000 where a molecule has
    more atoms or bonds than V2000's three digits can state."""
    idx = atoms.select(c(key), "atom_id", "element", F.row_number().over(Window.partitionBy(c(key)).orderBy("atom_id")).alias("n"))
    old = F.concat(F.lit("    0.0000    0.0000    0.0000 "), F.rpad("element", 3, " "), F.lit(" 0  0  0  0  0  0  0  0  0  0  0  0"))
    new = F.format_string("M  V30 %d %s 0 0 0 0", "n", "element")
    atom_block = idx.groupBy(c(key)).agg(F.array_sort(F.collect_list(F.struct("n", old.alias("l"), new.alias("l3")))).alias("al"),
                                         F.count(F.lit(1)).alias("na"))
    typ = F.when(F.coalesce("aromatic", F.lit(False)), F.lit(4)).otherwise(F.col("bond_order").cast("int"))
    ia = idx.select(c(key), F.col("atom_id").alias("a"), F.col("n").alias("na_"))
    ib = idx.select(c(key), F.col("atom_id").alias("b"), F.col("n").alias("nb_"))
    joined = bonds.join(ia, [key, "a"]).join(ib, [key, "b"]).select(c(key), "na_", "nb_", typ.alias("t"))
    bond_block = joined.groupBy(c(key)).agg(F.array_sort(F.collect_list(F.struct("na_", "nb_", "t"))).alias("bl"), F.count(F.lit(1)).alias("nb"))
    j = atom_block.join(bond_block, key, "left").withColumns({"nb": F.coalesce("nb", F.lit(0)), "bl": F.coalesce("bl", F.array())})
    head = lambda *rest: F.array(F.col(key).cast("string"), F.lit("  ecospark"), F.lit(""), *rest)
    v2 = F.concat(head(F.format_string("%3d%3d  0  0  0  0  0  0  0  0999 V2000", "na", "nb")), F.transform("al", lambda x: x["l"]),
                  F.transform("bl", lambda x: F.format_string("%3d%3d%3d  0", x["na_"], x["nb_"], x["t"])), F.array(F.lit("M  END")))
    v3 = F.concat(head(F.lit("  0  0  0     0  0            999 V3000"), F.lit("M  V30 BEGIN CTAB"), F.format_string("M  V30 COUNTS %d %d 0 0 0", "na", "nb"),
                       F.lit("M  V30 BEGIN ATOM")), F.transform("al", lambda x: x["l3"]), F.array(F.lit("M  V30 END ATOM"), F.lit("M  V30 BEGIN BOND")),
                  F.transform("bl", lambda x, i: F.format_string("M  V30 %d %d %d %d", i + 1, x["t"], x["na_"], x["nb_"])),
                  F.array(F.lit("M  V30 END BOND"), F.lit("M  V30 END CTAB"), F.lit("M  END")))
    return j.select(c(key), F.array_join(F.when((F.col("na") > 999) | (F.col("nb") > 999), v3).otherwise(v2), "\n").alias("molblock"))


def write_sdf(df: DataFrame, path: str, molblock: str = "molblock", tags: Sequence[str] = ()) -> None:
    """A10: one SDF record per row: molblock, ``> <tag>`` fields, ``$$$$`` (overwrite mode, Q9)."""
    parts = [c(molblock)]
    for t in tags:
        parts += [F.lit(f"> <{t}>"), F.coalesce(c(t).cast("string"), F.lit("")), F.lit("")]
    rec = F.concat(F.concat_ws("\n", *parts), F.lit("\n$$$$"))
    df.select(rec.alias("value")).write.mode("overwrite").text(path)


# ---------------------------------------------------------------- sinks


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, no index."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_split(df: DataFrame, path: str, by: str | Sequence[str], fmt: str = "parquet") -> None:
    """One output folder per value of ``by`` (``by=value`` directories)."""
    by = [by] if isinstance(by, str) else list(by)
    df.write.mode("overwrite").partitionBy(*by).format(fmt).option("header", True).save(path)


def write_counts(df: DataFrame, path: str) -> None:
    """Counters as JSON lines."""
    df.write.mode("overwrite").json(path)


def write_summary(df: DataFrame, path: str) -> None:
    """Computed numbers (Q14): numeric describe and null counts as two CSV folders."""
    from ecospark.operators.profile import describe, missing

    write_csv(describe(df), os.path.join(path, "describe"))
    write_csv(missing(df), os.path.join(path, "missing"))


def prune_file(spark: SparkSession, src: str, dst: str, ratio: float = 0.7, keep: Sequence[str] = ()) -> DataFrame:
    """Read, drop uninformative columns (F1), write to a *new* path (Spark cannot overwrite
    the path it is reading); returns the pruned frame read back."""
    from ecospark.operators.features import drop_uninformative

    if os.path.abspath(src) == os.path.abspath(dst):
        raise ValueError("prune_file writes to a new path")
    df = spark.read.parquet(src)
    drop_uninformative(df, ratio, keep).write.mode("overwrite").parquet(dst)
    return spark.read.parquet(dst)


# ---------------------------------------------------------------- payload columns


def json_field(df: DataFrame, col: str, path: str, out: str, cast: str | None = None) -> DataFrame:
    """A field of a JSON payload column (``$.a.b`` paths)."""
    v = F.get_json_object(c(col), path)
    return df.withColumn(out, v.try_cast(cast) if cast else v)


def csv_fields(df: DataFrame, col: str, schema: str, sep: str = ",") -> DataFrame:
    """A CSV payload held in a string column -> typed columns."""
    parsed = F.from_csv(c(col), schema, {"sep": sep})
    return df.withColumn("_csv", parsed).select("*", "_csv.*").drop("_csv")


def html_field(df: DataFrame, col: str, label_regex: str, out: str) -> DataFrame:
    """The value following a labelled element, e.g. ``<strong>Label:</strong> ... <span>v</span>``.
    ``label_regex`` must hold one capture group for the value."""
    return df.withColumn(out, F.nullif(F.trim(F.regexp_extract(c(col), label_regex, 1)), F.lit("")))


def labelled_span(label: str) -> str:
    """Pattern for the reference's page layout: the span after a ``<strong>`` label."""
    import re

    return r"(?s)<strong>\s*" + re.escape(label) + r"\s*</strong>.*?<span[^>]*>(.*?)</span>"


# ---------------------------------------------------------------- batch driver


def run_pairs(base: DataFrame, others: dict[str, DataFrame], fn: Callable[[DataFrame, DataFrame], DataFrame],
              out_dir: str, base_name: str = "base") -> dict[str, str]:
    """For each other table, build ``fn(base, other)`` lazily and write it to
    ``{out_dir}/{base}_{other}_processed``; returns the written paths."""
    paths = {}
    for name, other in others.items():
        p = os.path.join(out_dir, f"{base_name}_{name}_processed")
        write_csv(fn(base, other), p)
        paths[name] = p
    return paths


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory for intermediate files (``session.cleanup`` removes it)."""
    return os.path.join(new_folder(spark, "ecospark-scratch"), name)
