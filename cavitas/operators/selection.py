"""Choosing atoms and frames. An atoms table is what `cavitas.sources.pdb` reads."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cavitas.functions.checks import ArgumentError, indices, is_all, is_iterable_of_integers

#: Residue names of water and of common ions.
WATERS = ["HOH", "WAT", "TIP3", "SOL", "H2O", "DOD"]
IONS = ["NA", "CL", "K", "MG", "CA", "ZN", "MN", "FE", "CU", "NI", "CO", "CD", "LI", "BR", "IOD", "F", "SO4", "PO4", "NA+", "CL-", "K+"]


def group_type(atoms: DataFrame) -> DataFrame:
    """``atoms`` with ``group_type``: water, ion, small molecule (other heteroatoms) or polymer."""
    name = F.upper(F.trim("group_name"))
    kind = F.when(name.isin(*WATERS), "water").when(name.isin(*IONS), "ion").when(F.trim("record") == "HETATM", "small molecule").otherwise("polymer")
    return atoms.withColumn("group_type", kind)


_QUOTED = r"'[^']*'|\"[^\"]*\""
_LISTED = re.compile(rf"({_QUOTED})|(\w+)\s+(not\s+)?in\s*\[((?:{_QUOTED}|[^\]'\"])*)\]", re.IGNORECASE)


def condition(text: str) -> str:
    """A selection text as a SQL condition: what ``name in [...]`` and ``name not in [...]`` say; the rest is SQL already.

    A missing value is in no list, and an empty list holds none. Brackets within quotes stay.
    """

    def turned(m: re.Match) -> str:
        quoted, name, negated, values = m.groups()
        if quoted:
            return quoted
        inside = f"coalesce({name} IN ({values}), false)" if values.strip() else "false"
        return f"(NOT {inside})" if negated else inside

    return _LISTED.sub(turned, text)


def select_atoms(atoms: DataFrame, selection: str | Column | list[int] = "all", mask: Column | None = None) -> DataFrame:
    """Atoms by a text, a condition, or a list of atom indices; ``mask`` narrows it.

    A text is a SQL expression in which ``name in [...]`` may stand (`condition`); it may name ``group_type``.
    """
    if isinstance(selection, Column):
        atoms = atoms.where(selection)
    elif is_iterable_of_integers(selection):
        atoms = atoms.where(F.col("atom_index").isin(*selection) if len(selection) else F.lit(False))
    elif not isinstance(selection, str):
        raise ArgumentError(f"selection: an expression, condition or indices are needed, not {selection!r}")
    elif not is_all(selection):
        rows = group_type(atoms) if re.search(r"\bgroup_type\b", selection) and "group_type" not in atoms.columns else atoms
        try:
            atoms = rows.where(condition(selection)).select(*atoms.columns)
        except AnalysisException as error:
            raise ArgumentError(f"selection: {selection!r} is no condition on atoms: {error.getCondition()}") from error
    return atoms if mask is None else atoms.where(mask)


def select_structures(atoms: DataFrame, structures=None) -> DataFrame:
    """Frames: None or ``'all'``, one index, or several."""
    chosen = indices(structures, "structures")
    return atoms if chosen is None else atoms.where(F.col("structure_index").isin(*chosen) if chosen else F.lit(False))


def without_types(atoms: DataFrame, kinds=("water", "ion", "small molecule")) -> DataFrame:
    """Without solvent, ions and ligands."""
    rows = atoms if "group_type" in atoms.columns else group_type(atoms)
    return rows.where(~F.col("group_type").isin(*kinds)).select(*atoms.columns)


def without_hydrogens(atoms: DataFrame) -> DataFrame:
    return atoms.where(F.coalesce(F.upper(F.trim("atom_type")), F.lit("")) != "H")


def removal_summary(atoms: DataFrame, by: tuple[str, ...] = ("system_id",)) -> DataFrame:
    """Atoms of each kind that `without_types` removes."""
    rows = atoms if "group_type" in atoms.columns else group_type(atoms)
    count = lambda kind: F.count_if(F.col("group_type") == kind)
    return rows.groupBy(*by).agg(count("water").alias("n_waters"), count("ion").alias("n_ions"), count("small molecule").alias("n_small_molecules"))


def as_points(atoms: DataFrame) -> DataFrame:
    """The point table of an atoms table."""
    return atoms.select("system_id", "structure_index", F.col("atom_index").cast("long").alias("point_index"), "x", "y", "z")


def element_radii(atoms: DataFrame) -> DataFrame:
    from cavitas.functions.metrics import element_radius

    return atoms.withColumn("radius", element_radius(F.upper(F.trim("atom_type"))))
