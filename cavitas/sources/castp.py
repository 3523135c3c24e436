"""Pockets and mouths in the four text files of a CASTp result."""

from __future__ import annotations

import io
import os
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cavitas.functions.checks import ArgumentError, one_of
from cavitas.functions.labels import trimmed_number
from cavitas.operators.registry import Registry
from cavitas.session import cut, list_folder, ship
from cavitas.sources.pdb import lines, parse_atoms

LABEL_FORMAT = "{atom_id}-{atom_name}/{group_name}/{chain_id}"
SUFFIXES = (".poc", ".pocInfo", ".mouth", ".mouthInfo", ".pdb")
MARKERS = {"pocket": "POC", "mouth": "M4P"}


def discover(spark: SparkSession, folder: str) -> dict[str, str]:
    """The first file by name of each suffix (case counts) of a folder."""
    names = list_folder(spark, folder)
    if names is None:
        raise ArgumentError(f"no such folder: {folder}")
    found: dict[str, str] = {}
    for name in names:
        suffix = os.path.splitext(name)[1]
        if suffix in SUFFIXES:
            found.setdefault(suffix, f"{folder.rstrip('/')}/{name}")
    return found


def parse_site_atoms(rows: DataFrame, kind: str, strict: bool = True) -> DataFrame:
    """``system_id, kind, site_id, atom_id, atom_name, group_name, chain_id, atom_label`` of atom lines.

    Blank lines are skipped. A line with under 13 fields or another marker raises, or is left out.
    """
    marker = MARKERS[one_of(kind, MARKERS, "kind")]
    rows = rows.withColumn("f", F.split(F.trim("value"), r"\s+")).where(F.trim("value") != "")
    good = (F.size("f") >= 13) & (F.try_element_at("f", F.lit(13)) == marker) & F.try_element_at("f", F.lit(12)).rlike("^[0-9]+$")
    rows = rows.withColumn("ok", F.coalesce(good, F.lit(False)))
    if strict:
        wrong = F.raise_error(F.concat(F.lit(f"no {kind} line: "), "value")).cast("array<string>")
        rows = rows.withColumn("f", F.when(F.col("ok"), F.col("f")).otherwise(wrong))
    else:
        rows = rows.where("ok")
    field = lambda k: F.try_element_at("f", F.lit(k + 1))
    out = rows.select("system_id", F.lit(kind).alias("kind"), field(11).try_cast("int").alias("site_id"), *[field(k).alias(n) for k, n in enumerate(("atom_id", "atom_name", "group_name", "chain_id"), 1)])
    return out.withColumn("atom_label", F.concat("atom_id", F.lit("-"), "atom_name", F.lit("/"), "group_name", F.lit("/"), "chain_id"))


def labels_by_site(atoms: DataFrame) -> DataFrame:
    """``system_id, kind, site_id, atom_labels``: the distinct labels of each site, sorted."""
    return atoms.groupBy("system_id", "kind", "site_id").agg(F.array_sort(F.collect_set("atom_label")).alias("atom_labels"))


def _info(rows: DataFrame, header: str, least: int) -> DataFrame:
    """Fields of the lines behind the header; of several lines for a site the last holds."""
    rows = rows.where((F.trim("value") != "") & ~F.col("value").rlike(header)).withColumn("f", F.split(F.trim("value"), r"\s+"))
    short = F.raise_error(F.concat(F.lit("too few fields: "), "value")).cast("array<string>")
    rows = rows.withColumn("f", F.when(F.size("f") >= least, F.col("f")).otherwise(short)).withColumn("site_id", F.element_at("f", 3).cast("int"))
    last = F.row_number().over(Window.partitionBy("system_id", "site_id").orderBy(F.desc("line_no")))
    return rows.withColumn("n", last).where("n = 1")


def parse_pocket_info(rows: DataFrame) -> DataFrame:
    """Areas, volumes, length, corners and mouth ids of each pocket."""
    number = lambda k: F.element_at("f", k + 1).cast("double")
    tail = F.filter(F.transform(F.slice("f", 11, 10_000), trimmed_number), lambda x: x.isNotNull())
    return _info(rows, r"^POC:\s+Molecule", 10).select(
        "system_id", "site_id", F.element_at("f", 4).cast("int").alias("n_mouths"),
        *[number(k).alias(n) for k, n in enumerate(("sa_area", "ms_area", "sa_volume", "ms_volume", "length"), 4)],
        F.element_at("f", 10).cast("int").alias("corner_points_count"), F.when(F.size("f") > 10, tail).otherwise(F.array().cast("array<int>")).alias("mouth_ids"),
    )


def parse_mouth_info(rows: DataFrame) -> DataFrame:
    """Areas, lengths and triangles of the mouths of each pocket."""
    number = lambda k: F.element_at("f", k + 1).cast("double")
    return _info(rows, r"^MTH:\s+Molecule", 9).select(
        "system_id", "site_id", F.element_at("f", 4).cast("int").alias("n_mouths"),
        *[number(k).alias(n) for k, n in enumerate(("sa_area", "ms_area", "sa_length", "ms_length"), 4)],
        F.element_at("f", 9).cast("int").alias("n_triangles"),
    )


def features_of(spark: SparkSession, poc=None, poc_info=None, mouth=None, mouth_info=None) -> tuple[DataFrame, DataFrame]:
    """Feature rows and relations of any of the four kinds of files; a mouth belongs to the pocket of its id in its system.

    Ids are ``POC-2`` and ``MOU-2`` for one system, ``1abc/POC-2`` for several.
    """
    parts = []
    for kind, atoms, info, parse in (("pocket", poc, poc_info, parse_pocket_info), ("mouth", mouth, mouth_info, parse_mouth_info)):
        if atoms is None:
            continue
        sites = labels_by_site(parse_site_atoms(_lines(spark, atoms), kind)).drop("kind")
        if info is not None:
            sites = sites.join(parse(_lines(spark, info)).drop("mouth_ids", "n_mouths"), ["system_id", "site_id"], "left")
        parts.append(sites.withColumn("feature_type", F.lit(kind)))
    if not parts:
        return spark.createDataFrame([], "feature_id string, feature_type string"), spark.createDataFrame([], "child_id string, parent_id string")
    rows = cut(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True))
    key = F.col("site_id").cast("string")
    name = F.concat(F.when(F.col("feature_type") == "pocket", "POC-").otherwise("MOU-"), key)
    if len(rows.select("system_id").distinct().limit(2).collect()) > 1:
        name = F.concat("system_id", F.lit("/"), name)
    rows = rows.select(
        "*", name.alias("feature_id"), F.lit("CASTp").alias("source"), key.alias("source_id"), F.lit(LABEL_FORMAT).alias("atom_label_format"),
        F.col("site_id").cast("long").alias("seq"), F.create_map(F.lit("system_id"), F.col("system_id")).alias("extra"),
    )
    pockets = rows.where("feature_type = 'pocket'").select("system_id", "site_id", F.col("feature_id").alias("parent_id"))
    mouths = rows.where("feature_type = 'mouth'").select("system_id", "site_id", F.col("feature_id").alias("child_id"))
    return rows, mouths.join(pockets, ["system_id", "site_id"]).select("child_id", "parent_id")


def unzip(spark: SparkSession, path: str) -> DataFrame:
    """``name, text`` of the members with known suffixes of zip files, a task an archive."""

    def members(batches):
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = [n for n in z.namelist() if os.path.splitext(n)[1] in SUFFIXES]
                    yield pd.DataFrame({"name": [os.path.basename(n) for n in names], "text": [z.read(n).decode("utf-8", "replace") for n in names]})

    ship(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(members, "name string, text string")


def _lines(spark: SparkSession, files) -> DataFrame:
    """Lines of paths, or of a table of ``name, text``."""
    if not isinstance(files, DataFrame):
        return lines(spark, files)
    return files.select(F.regexp_replace("name", r"\.[^.]*$", "").alias("system_id"), F.posexplode(F.split("text", "\r?\n")).alias("line_no", "value"))


def load(spark: SparkSession, folder: str | list[str] | None = None, zip_file: str | None = None, poc=None, poc_info=None, mouth=None, mouth_info=None, pdb=None) -> Registry:
    """A registry of pockets, mouths and their relations from files, one or several folders, or a zip; missing files are empty.

    Each kind may be several files: a system is a file name without its suffix.
    """
    given = dict(zip(SUFFIXES, (poc, poc_info, mouth, mouth_info, pdb), strict=True))
    found: dict[str, list[str]] = {}
    members = cut(unzip(spark, zip_file)) if zip_file is not None else None
    for one in [folder] if isinstance(folder, str) else folder or []:
        for suffix, path in discover(spark, one).items():
            found.setdefault(suffix, []).append(path)
    held = {r["name"] for r in members.select(F.regexp_extract("name", r"\.[^.]*$", 0).alias("name")).distinct().collect()} if members is not None else set()  # five suffixes at most
    files = {s: given[s] or found.get(s) or (members.where(F.col("name").endswith(s)) if s in held else None) for s in SUFFIXES}
    rows, relations = features_of(spark, *(files[s] for s in SUFFIXES[:4]))
    registry = Registry(spark, atoms=parse_atoms(_lines(spark, files[".pdb"])) if files[".pdb"] is not None else None).add(rows)
    return registry.connect_all(relations)
