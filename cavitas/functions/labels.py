"""Atom labels by template, and other string functions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cavitas.functions.checks import ArgumentError

DEFAULT_FORMAT = "{atom_name}-{atom_id}/{group_name}-{group_id}/{chain_name}-{chain_id}"
#: The columns of an atoms table that a label field stands for, if named otherwise.
FIELD_COLUMNS = {"chain_name": "chain_id"}
INTEGER_FIELDS = {"atom_id", "group_id"}


def pieces(template: str) -> list[tuple[bool, str]]:
    """(is a field, text) of the literals and fields of a template, in order."""
    out = []
    for i, part in enumerate(re.split(r"\{([^{}]*)\}", template)):
        if i % 2:
            out.append((True, part.strip()))
        elif part:
            if "{" in part or "}" in part:
                raise ArgumentError(f"unbalanced braces in {template!r}")
            out.append((False, part))
    return out


def fields(template: str) -> list[str]:
    return [text for field, text in pieces(template) if field]


def pattern(template: str) -> str:
    """An anchored regular expression with a positional, shortest-match group for each field."""
    return "^" + "".join("(.+?)" if field else re.sub(r"([^A-Za-z0-9 ])", r"\\\1", text) for field, text in pieces(template)) + "$"


def render(template: str, **context: Column) -> Column:
    """A label column; fields come from ``context`` or the columns of that name."""
    column = lambda name: context.get(name, F.col(FIELD_COLUMNS.get(name, name)))
    return F.concat(*[column(text).cast("string") if field else F.lit(text) for field, text in pieces(template)])


def parse(label: Column, template: str, strict: bool = True) -> Column:
    """A struct of the template's fields. A label that does not match raises, or gives null."""
    expression = pattern(template)
    found = F.struct(*[F.regexp_extract(label, expression, i + 1).alias(name) for i, name in enumerate(fields(template))])
    wrong = F.raise_error(F.concat(F.lit("no label of the format "), F.lit(template), F.lit(": "), label)).cast(_struct(template)) if strict else F.lit(None)
    return F.when(label.rlike(expression), found).when(label.isNotNull(), wrong)


def _struct(template: str) -> str:
    return "struct<" + ",".join(f"{name}:string" for name in fields(template)) + ">"


def parse_many(labels: Column, template: str, strict: bool = True) -> Column:
    """An array of structs from an array of labels."""
    return F.transform(labels, lambda x: parse(x, template, strict))


def by_field(structs: Column, template: str) -> Column:
    """A struct of arrays from an array of structs."""
    return F.struct(*[structs[name].alias(name) for name in fields(template)])


def resolve(labels: DataFrame, atoms: DataFrame, template: str, label: str = "label", keys: tuple[str, ...] = ()) -> DataFrame:
    """``labels`` with the ``atom_index`` of the atom that each label names (null if none does).

    Joined on exactly the fields of the template (``keys`` besides, e.g. a system).
    """
    parsed = labels.withColumn("__fields", parse(F.col(label), template, strict=False))
    index = atoms.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("atom_index"), *[F.col(FIELD_COLUMNS.get(f, f)).alias(f"__atom_{f}") for f in fields(template)])

    def same(name: str) -> Column:
        value = F.col("__fields")[name]
        return F.col(f"__atom_{name}") == (F.expr(f"try_cast(__fields.{name} AS bigint)") if name in INTEGER_FIELDS else value)

    on = reduce(lambda a, b: a & b, [*(F.col(k) == F.col(f"__{k}") for k in keys), *map(same, fields(template))])
    return parsed.join(index, on, "left").select(*labels.columns, "atom_index")


def natural_key(feature_id: Column) -> list[Column]:
    """Sort columns: ids with a prefix by prefix and number (none last), then the rest by text."""
    rest = feature_id.rlike("^[A-Za-z_]+")
    number = F.regexp_extract(feature_id, r"^[A-Za-z_]+[^0-9]*([0-9]+)", 1)
    return [
        F.when(rest, 0).otherwise(1).asc(),
        F.when(rest, F.regexp_extract(feature_id, "^([A-Za-z_]+)", 1)).asc_nulls_last(),
        F.try_to_number(number, F.lit("9" * 18)).asc_nulls_last(),
        feature_id.asc_nulls_last(),
    ]


def viewer_selection(indices: Column) -> Column:
    """``@1,2,3`` from an array of atom indices."""
    return F.concat(F.lit("@"), F.array_join(indices.cast("array<string>"), ","))


def trimmed_number(token: Column) -> Column:
    """A whole number with an optional comma behind it, else null."""
    bare = F.regexp_replace(token, ",+$", "")
    return F.when(bare.rlike("^[0-9]+$"), bare.cast("int"))


def number_or_null(text: str) -> Column:
    """The number that a text column holds, else null; the text stays beside it."""
    return F.expr(f"try_cast({text} AS double)")
