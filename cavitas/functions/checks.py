"""Argument checks at the library's doors: small, explicit, raising `ArgumentError`."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame


class ArgumentError(ValueError):
    """An argument has a wrong kind or value."""


#: ångström in each accepted unit of length.
ANGSTROMS = {"angstrom": 1.0, "angstroms": 1.0, "å": 1.0, "a": 1.0, "nm": 10.0, "nanometer": 10.0, "nanometers": 10.0, "pm": 0.01, "picometers": 0.01}
_QUANTITY = re.compile(r"\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)\s*([A-Za-zÅå]+)?\s*")


def length(value: float | str | tuple, name: str = "length") -> float:
    """A length in Å from a number (already Å), ``"3.0 angstroms"`` or ``(3.0, "angstroms")``."""
    if isinstance(value, bool):
        raise ArgumentError(f"{name}: a length is needed, not {value!r}")
    if isinstance(value, (int, float)):
        return float(value)
    if isinstance(value, tuple) and len(value) == 2:
        value = f"{value[0]} {value[1]}"
    found = _QUANTITY.fullmatch(value) if isinstance(value, str) else None
    if not found or (found[2] and found[2].lower() not in ANGSTROMS):
        raise ArgumentError(f"{name}: no length: {value!r}")
    return float(found[1]) * ANGSTROMS[(found[2] or "angstrom").lower()]


def points(value, unit: str = "angstrom", name: str = "points") -> list[list[float]]:
    """Rows of three coordinates in Å from one point or several, given in a unit."""
    rows = value.tolist() if hasattr(value, "tolist") else value
    if isinstance(rows, (list, tuple)) and len(rows) == 3 and not any(isinstance(x, (list, tuple)) for x in rows):
        rows = [rows]
    if not isinstance(rows, (list, tuple)) or not all(isinstance(r, (list, tuple)) and len(r) == 3 for r in rows):
        raise ArgumentError(f"{name}: rows of three coordinates are needed, not {value!r}")
    return [[length((x, unit), name) for x in row] for row in rows]


def radii(value, unit: str = "angstrom", name: str = "radii") -> list[float] | None:
    """Radii in Å from a list of numbers or lengths; None stays."""
    if value is None:
        return None
    rows = value.tolist() if hasattr(value, "tolist") else value
    if not isinstance(rows, (list, tuple)) or any(isinstance(r, list) for r in rows):
        raise ArgumentError(f"{name}: a list of lengths is needed, not {value!r}")
    return [length(r if isinstance(r, (str, tuple)) else (r, unit), name) for r in rows]


def to_unit(column: Column, unit: str, power: int = 1) -> Column:
    """A column in Å (Å² with power 2, Å³ with 3) in another unit of length."""
    if unit.lower() not in ANGSTROMS:
        raise ArgumentError(f"no unit of length: {unit!r}")
    return column / ANGSTROMS[unit.lower()] ** power


def whole_number(value: int, name: str, least: int = 0) -> int:
    if isinstance(value, bool) or not hasattr(value, "__index__") or value.__index__() < least:
        raise ArgumentError(f"{name}: a whole number of at least {least} is needed, not {value!r}")
    return value.__index__()


def one_of(value: str, allowed, name: str) -> str:
    """``value`` in lower case if it is allowed."""
    if not isinstance(value, str) or value.lower() not in allowed:
        raise ArgumentError(f"{name}: one of {sorted(allowed)} is needed, not {value!r}")
    return value.lower()


def columns(df: DataFrame, needed, name: str = "table") -> DataFrame:
    """``df`` if it has all the needed columns."""
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ArgumentError(f"{name}: columns are missing: {missing}")
    return df


def indices(value, name: str = "indices") -> list[int] | None:
    """None for all; else a list of whole numbers from one, several, or ``'all'``."""
    if is_all(value):
        return None
    if hasattr(value, "__index__") and not isinstance(value, bool):
        return [value.__index__()]
    if isinstance(value, (list, tuple, set, range)):
        return [whole_number(x, name) for x in value]
    raise ArgumentError(f"{name}: whole numbers or 'all' are needed, not {value!r}")


def is_all(value) -> bool:
    return value is None or (isinstance(value, str) and value.lower() == "all")


def is_next(value) -> bool:
    return isinstance(value, str) and value.lower() == "next"


def is_iterable_of_integers(value) -> bool:
    return isinstance(value, (list, tuple, set, range)) and all(hasattr(x, "__index__") and not isinstance(x, bool) for x in value)


def is_iterable_of_pairs(value) -> bool:
    return isinstance(value, (list, tuple)) and all(isinstance(x, (list, tuple)) and len(x) == 2 for x in value)


def is_iterable_of_iterables(value) -> bool:
    return isinstance(value, (list, tuple, set)) and all(isinstance(x, (list, tuple, set, range)) for x in value)


def existing(path: str, folder: bool = False) -> str:
    """``path`` if a file (or folder) of the driver is there."""
    if not (os.path.isdir(path) if folder else os.path.isfile(path)):
        raise ArgumentError(f"no such {'folder' if folder else 'file'}: {path}")
    return path
