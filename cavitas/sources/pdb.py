"""Structure files with fixed columns."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cavitas.functions.checks import ArgumentError

#: Columns without which a table is no table of atoms.
ATOM_COLUMNS = ("system_id", "structure_index", "atom_index", "x", "y", "z")


def column(start: int, end: int) -> Column:
    """Columns ``start`` to ``end`` of a line, counted from 1, both included."""
    return F.trim(F.substring("value", start, end - start + 1))


def _number(c: Column, kind: str) -> Column:
    return F.nullif(c, F.lit("")).try_cast(kind)


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``system_id, line_no, value``: the files' lines in order; a system is a file without its suffix."""
    whole = spark.read.text(path, wholetext=True)
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    return whole.select(stem.alias("system_id"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))


def parse_atoms(rows: DataFrame) -> DataFrame:
    """Atoms of lines (``system_id, line_no, value``); each MODEL starts the next structure."""
    in_file = Window.partitionBy("system_id").orderBy("line_no")
    model = F.greatest(F.sum(F.when(F.col("value").startswith("MODEL "), 1).otherwise(0)).over(in_file) - 1, F.lit(0)).cast("int")
    atoms = rows.withColumn("structure_index", model).where(F.col("value").startswith("ATOM  ") | F.col("value").startswith("HETATM"))
    index = (F.row_number().over(Window.partitionBy("system_id", "structure_index").orderBy("line_no")) - 1).alias("atom_index")
    return atoms.select(
        "system_id", "structure_index", index,
        column(1, 6).alias("record"), _number(column(7, 11), "int").alias("atom_id"), column(13, 16).alias("atom_name"), column(18, 20).alias("group_name"),
        _number(column(23, 26), "int").alias("group_id"), column(22, 22).alias("chain_id"), F.upper(column(77, 78)).alias("atom_type"),
        *[_number(column(*at), "double").alias(name) for name, at in {"x": (31, 38), "y": (39, 46), "z": (47, 54), "occupancy": (55, 60), "b_factor": (61, 66)}.items()],
    )


def read_pdb(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The atoms table of PDB files."""
    return parse_atoms(lines(spark, path))


def atoms_of(system: DataFrame | str | Path | list | tuple, spark: SparkSession | None = None) -> DataFrame:
    """The atoms table of a molecular system: such a table as it is, or the PDB files of one path or several.

    Paths may be globs, on any file system that Spark reads; a `Path` is taken as absolute.
    """
    if isinstance(system, DataFrame):
        missing = [c for c in ATOM_COLUMNS if c not in system.columns]
        if missing:
            raise ArgumentError(f"molecular system: a table of atoms needs {', '.join(missing)}")
        return system
    several = list(system) if isinstance(system, (list, tuple)) else [system]
    if not several or not all(isinstance(p, (str, Path)) and str(p) for p in several):
        raise ArgumentError(f"molecular system: a table of atoms or paths are needed, not {system!r}")
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        raise ArgumentError("molecular system: reading paths needs a session")
    return read_pdb(spark, [str(p.absolute()) if isinstance(p, Path) else p for p in several])


def parse_pqr(rows: DataFrame) -> DataFrame:
    """Vertices of PQR lines: position by columns, radius the last field."""
    fields = F.split(F.trim("value"), r"\s+")
    atoms = rows.where(F.col("value").startswith("ATOM") | F.col("value").startswith("HETATM"))
    xyz = [_number(column(*at), "double").alias(name) for name, at in {"x": (31, 38), "y": (39, 46), "z": (47, 54)}.items()]
    return atoms.select("system_id", "line_no", *xyz, _number(F.element_at(fields, -1), "double").alias("radius"))


def read_pqr(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_pqr(lines(spark, path))
