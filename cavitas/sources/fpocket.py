"""Output folders of an fpocket run, running the program, and the keys file."""

from __future__ import annotations

import os
import re
import shutil
import subprocess
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cavitas.functions.checks import existing
from cavitas.operators.registry import Registry
from cavitas.session import cut, list_folder, ship
from cavitas.sources.pdb import column, lines, parse_pqr

#: Header keys that become typed columns.
TYPED = {"score": "Pocket Score", "druggability_score": "Drug Score", "volume_mc": "Pocket volume (Monte Carlo)", "volume_hull": "Pocket volume (convex hull)"}


class ProcessError(RuntimeError):
    """The external program failed or left no output."""


def pocket_number(name: Column) -> Column:
    """The number in a file name such as ``pocket12_atm.pdb``, or -1."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"pocket(\d+)", 1), F.lit("")).cast("int"), F.lit(-1))


def parse_headers(rows: DataFrame) -> DataFrame:
    """``pocket_id, key, value`` of ``HEADER n - key : value`` lines (``pocket_id, value``)."""
    head = r"^HEADER\s+[0-9]+\s*-\s*(.*?)\s*:\s*(.*?)\s*$"
    return rows.where(F.col("value").rlike(head)).select("pocket_id", F.regexp_extract("value", head, 1).alias("key"), F.regexp_extract("value", head, 2).alias("value"))


def header_maps(headers: DataFrame) -> DataFrame:
    """``pocket_id, raw`` and the typed columns; of a repeated key one value stays."""
    one = headers.groupBy("pocket_id", "key").agg(F.max("value").alias("value"))
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("raw")
    typed = [F.try_element_at("raw", F.lit(key)).try_cast("double").alias(name) for name, key in TYPED.items()]
    return one.groupBy("pocket_id").agg(entries).select("pocket_id", "raw", *typed)


def parse_serials(rows: DataFrame) -> DataFrame:
    """``pocket_id, atom_serials`` from atom lines (``pocket_id, line_no, value``), in order."""
    atoms = rows.where(F.col("value").startswith("ATOM") | F.col("value").startswith("HETATM"))
    serial = F.nullif(column(7, 11), F.lit("")).try_cast("int")
    return atoms.withColumn("serial", serial).where("serial IS NOT NULL").groupBy("pocket_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "serial"))), lambda x: x["serial"]).alias("atom_serials"))


def parse_info(rows: DataFrame) -> DataFrame:
    """``system_id, block, title, key, value, number`` of info texts (``system_id, line_no, value``).

    A line that starts with ``Pocket`` opens a block; its title is what stands before the colon,
    trailing space included. Other lines are split at their first colon.
    """
    block = F.sum(F.when(F.col("value").startswith("Pocket"), 1).otherwise(0)).over(Window.partitionBy("system_id").orderBy("line_no"))
    rows = rows.withColumn("block", block.cast("int")).where("block > 0")
    title = F.when(F.col("value").startswith("Pocket"), F.substring_index("value", ":", 1))
    rows = rows.withColumn("title", F.first(title, ignorenulls=True).over(Window.partitionBy("system_id", "block").orderBy("line_no")))
    body = rows.where(~F.col("value").startswith("Pocket") & F.col("value").contains(":"))
    value = F.trim(F.expr("substring(value, instr(value, ':') + 1)"))
    return body.select("system_id", "block", "title", F.trim(F.substring_index("value", ":", 1)).alias("key"), F.regexp_replace(value, r"^\s+|\s+$", "").alias("value")).withColumn("key", F.regexp_replace("key", r"^\s+|\s+$", "")).withColumn("number", F.col("value").try_cast("double"))


_POCKETS = "system_id string, pocket_id int, atom_serials array<int>, center struct<x:double,y:double,z:double>, score double, druggability_score double, volume_mc double, volume_hull double, raw map<string,string>"


def parse_files(files: DataFrame) -> DataFrame:
    """The pockets of all systems: columns as `read_outputs`. ``files`` has ``system_id, name`` of a pocket's file, and its text in ``value``."""
    key = F.struct("system_id", pocket_number(F.col("name")).alias("number")).alias("pocket_id")
    rows = lambda suffix: files.where(F.col("name").rlike(r"^pocket[0-9]+" + suffix)).select(key, F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))
    atoms = rows(r"_atm\.pdb$")
    vertices = rows(r"_vert\.pqr$").select(F.to_json("pocket_id").alias("system_id"), "line_no", "value")
    middle = parse_pqr(vertices).groupBy("system_id").agg(F.struct(*[F.avg(c).alias(c) for c in "xyz"]).alias("center"))
    middle = middle.select(F.from_json("system_id", "system_id string, number int").alias("pocket_id"), "center")
    out = atoms.select("pocket_id").distinct().join(parse_serials(atoms), "pocket_id", "left").join(header_maps(parse_headers(atoms)), "pocket_id", "left").join(middle, "pocket_id", "left")
    out = out.withColumn("atom_serials", F.coalesce("atom_serials", F.array().cast("array<int>")))
    names = [x.split(" ")[0] for x in _POCKETS.split(", ")][2:]
    return out.select("pocket_id.system_id", F.col("pocket_id.number").alias("pocket_id"), *names)


def read_outputs(spark: SparkSession, folders: str | list[str]) -> DataFrame:
    """``system_id, pocket_id, atom_serials, center, score, ..., raw`` of output folders on any file system; globs may be used.

    A system is a folder's name without ``_out``. Folders without pockets, and named ones that are not there, give none.
    """
    folders = [folders] if isinstance(folders, str) else list(folders)
    places = [f"{f.rstrip('/')}/pockets" for f in folders]
    places = [p for p in places if re.search(r"[*?\[{]", p) or list_folder(spark, p) is not None]
    if not places:
        return spark.createDataFrame([], _POCKETS)
    whole = spark.read.option("pathGlobFilter", "pocket*").text(places, wholetext=True)
    system = F.regexp_replace(F.regexp_extract("_metadata.file_path", "([^/]+)/pockets/[^/]+$", 1), "_out$", "")
    return parse_files(whole.select(F.url_decode(F.replace(system, F.lit("+"), F.lit("%2B"))).alias("system_id"), F.col("_metadata.file_name").alias("name"), "value"))


def read_output(spark: SparkSession, folder: str) -> DataFrame:
    """The pockets of one output folder, without ``system_id``; none if it holds no pockets."""
    return read_outputs(spark, folder).drop("system_id")


def read_info(spark: SparkSession, path: str) -> DataFrame:
    return parse_info(lines(spark, path))


def as_json(pockets: DataFrame) -> DataFrame:
    """One nested JSON text a pocket."""
    return pockets.select("pocket_id", F.to_json(F.struct(*pockets.columns)).alias("json"))


def run(pdb: str, command: str = "fpocket", folder: str | None = None, arguments: tuple[str, ...] = (), seconds: int | None = None, inside: str | None = None) -> str:
    """Runs the program on one local structure, copied into ``folder`` (or where it is, if that is ``inside``), and returns its output folder. Many structures: `run_all`."""
    work = inside or folder or tempfile.mkdtemp(prefix="cavitas-run-")
    copy = existing(pdb) if inside else shutil.copy(existing(pdb), work)
    try:
        done = subprocess.run([command, "-f", os.path.basename(copy), *arguments], cwd=work, capture_output=True, text=True, timeout=seconds)
    except subprocess.TimeoutExpired as error:
        raise ProcessError(f"{command} took over {seconds} s") from error
    except OSError as error:
        raise ProcessError(f"{command} can't be run: {error}") from error
    out = os.path.join(work, os.path.splitext(os.path.basename(copy))[0] + "_out")
    if done.returncode or not os.path.isdir(out):
        raise ProcessError(f"{command} ended with {done.returncode}: {done.stderr[-500:]}")
    return out


def structures(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``system_id, value``: structure files, whole."""
    whole = spark.read.text(paths, wholetext=True)
    return whole.select(F.regexp_replace("_metadata.file_name", r"\.[^.]*$", "").alias("system_id"), "value")


#: Seconds that the program may take for one structure.
SECONDS = 3600


def _run_rows(command: str, arguments: tuple[str, ...], seconds: int):
    def one(system: str, text: str) -> Iterator[tuple]:
        with tempfile.TemporaryDirectory(prefix="cavitas-run-") as work:  # of the task: what is in it goes into rows
            name = re.sub(r"[^\w.-]", "_", system) or "_"
            try:
                with open(os.path.join(work, f"{name}.pdb"), "w") as f:
                    f.write(text)
                out = run(os.path.join(work, f"{name}.pdb"), command, None, arguments, seconds, inside=work)
                pockets = os.path.join(out, "pockets")
                for file in sorted(os.listdir(pockets)) if os.path.isdir(pockets) else []:
                    with open(os.path.join(pockets, file), errors="replace") as f:
                        yield system, file, f.read(), None
                yield system, None, None, None
            except (ProcessError, OSError) as error:
                yield system, None, None, str(error)[:500]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for system, text in zip(batch["system_id"], batch["value"], strict=True):
                yield pd.DataFrame(list(one(system, text or "")), columns=["system_id", "name", "value", "error"])

    return rows


def run_all(systems: DataFrame, command: str = "fpocket", arguments: tuple[str, ...] = (), seconds: int = SECONDS) -> DataFrame:
    """Runs the program over structures (``system_id, value``) in tasks: ``system_id, name, value, error``.

    A row is a file of a structure's pockets; a structure has one more row, with its error if it failed (others
    go on). The program has to be on each machine; its folders go with the task, which may be run again elsewhere.
    """
    ship(systems.sparkSession)
    rows = systems.select("system_id", "value").repartition("system_id")  # a structure takes long, not much room
    return cut(rows.mapInPandas(_run_rows(command, arguments, seconds), "system_id string, name string, value string, error string"))


def failures(files: DataFrame) -> DataFrame:
    """``system_id, error`` of the structures of `run_all` that failed."""
    return files.where("error IS NOT NULL").select("system_id", "error")


def as_features(pockets: DataFrame) -> DataFrame:
    """Feature rows of pockets: atom indices count from 0; with a ``system_id``, ids are ``system/POC-2``."""
    number = F.concat(F.lit("POC-"), F.col("pocket_id").cast("string"))
    name = F.concat("system_id", F.lit("/"), number) if "system_id" in pockets.columns else number
    return pockets.select(
        F.lit("pocket").alias("feature_type"), name.alias("feature_id"), F.lit("fpocket").alias("source"),
        F.col("pocket_id").cast("string").alias("source_id"), F.transform("atom_serials", lambda x: x - 1).alias("atom_indices"), F.col("volume_mc").alias("ms_volume"), F.col("raw").alias("extra"),
    )


def registry_of(spark: SparkSession, output_folder: str) -> Registry:
    return Registry(spark).add(as_features(read_output(spark, output_folder)))


def registry_of_run(systems: DataFrame, command: str = "fpocket", arguments: tuple[str, ...] = (), seconds: int = SECONDS) -> tuple[Registry, DataFrame]:
    """The pockets that the program finds in structures, in one registry; and ``system_id, error`` of those that failed."""
    files = run_all(systems, command, arguments, seconds)
    return Registry(systems.sparkSession).add(as_features(parse_files(files.where("name IS NOT NULL")))), failures(files)


def parse_keys(rows: DataFrame) -> DataFrame:
    """``pocket_id, atom_indices`` from a keys text (``line_no, value``): field 1 is the atom, the last but one the pocket, from 1."""
    f = F.split(F.trim("value"), r"\s+")
    rows = rows.withColumn("f", f).where(F.size("f") >= 3)
    atom, pocket = F.try_element_at("f", F.lit(2)).try_cast("int") - 1, F.try_element_at("f", F.lit(-2)).try_cast("int") - 1
    rows = rows.select("line_no", atom.alias("atom"), pocket.alias("pocket_id")).where("atom IS NOT NULL AND pocket_id IS NOT NULL")
    return rows.groupBy("pocket_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "atom"))), lambda x: x["atom"]).alias("atom_indices"))


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    return parse_keys(lines(spark, path))
