"""Alpha-spheres of point sets, and what is computed from them.

A point table has ``system_id, structure_index, point_index, x, y, z``; an alpha-sphere
table ``system_id, structure_index, sphere_id, cx, cy, cz, radius, contacts``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cavitas.functions.checks import columns, length
from cavitas.operators.delaunay import circumspheres, empty_spheres
from cavitas.operators.graph import hot_join
from cavitas.operators.numbering import numbered
from cavitas.session import ship

KEYS = ["system_id", "structure_index"]


#: Points that a block of `alpha_spheres` is made for.
BLOCK_POINTS = 4000

_SPHERES = "cx double, cy double, cz double, radius double, contacts array<long>"


def _found(group: pd.DataFrame, kept=None) -> pd.DataFrame:
    """The spheres of the points of ``group``, by contacts; of these those for which ``kept`` (centre, radius) holds."""
    group = group.dropna(subset=["x", "y", "z"]).sort_values("point_index")
    ids = group["point_index"].tolist()
    found = empty_spheres(group[["x", "y", "z"]].to_numpy(float))
    rows = [(*c.tolist(), r, [ids[j] for j in touch]) for c, r, touch in found if kept is None or kept(c, r)]
    out = pd.DataFrame(rows, columns=["cx", "cy", "cz", "radius", "contacts"])
    for key in KEYS[::-1]:
        out.insert(0, key, group[key].iloc[0] if len(group) else None)
    return out


def _whole(group: pd.DataFrame) -> pd.DataFrame:
    out = _found(group)
    out.insert(2, "sphere_id", range(len(out)))
    return out


def alpha_spheres(points: DataFrame, max_radius=None, block_points: int = BLOCK_POINTS) -> DataFrame:
    """Alpha-spheres of each structure, ids by sorted contacts. Points with a null coordinate are left out; fewer than four points give no sphere.

    Without ``max_radius`` a structure is one task. With it, only spheres up to that radius are given, and a structure is many tasks:
    a sphere with its centre in a block of space depends only on points within that radius of the block, so that each block gets these too and
    keeps the spheres with a centre of its own. Blocks are cubes, no smaller than the radius, with about ``block_points`` points if they are evenly spread.
    """
    columns(points, [*KEYS, "point_index", "x", "y", "z"], "points")
    ship(points.sparkSession)
    kind = dict(points.dtypes)["system_id"]
    rows = points.select("system_id", F.col("structure_index").cast("int"), F.col("point_index").cast("long"), *[F.col(c).cast("double") for c in "xyz"])
    head = f"system_id {kind}, structure_index int"
    if max_radius is None:
        return rows.groupBy(*KEYS).applyInPandas(_whole, f"{head}, sphere_id long, {_SPHERES}")
    reach = length(max_radius, "max_radius")
    rows = rows.where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in "xyz"))
    extent = [F.greatest(F.max(c) - F.min(c), F.lit(reach)) for c in "xyz"]
    stats = rows.groupBy(*KEYS).agg(F.count("*").alias("__n"), (extent[0] * extent[1] * extent[2]).alias("__volume"))
    side = F.greatest(F.lit(reach), F.cbrt(F.col("__volume") * block_points / F.col("__n")))
    placed = hot_join(rows, stats.withColumn("__side", side).drop("__volume"), KEYS, "__n", rows.count())
    margin = reach * (1 + 1e-9) + 1e-9
    for c in "xyz":
        cell = lambda x: F.floor(x / F.col("__side")).cast("long")
        placed = placed.withColumn(f"__{c}", F.explode(F.sequence(cell(F.col(c) - margin), cell(F.col(c) + margin))))

    def in_block(group: pd.DataFrame) -> pd.DataFrame:
        size = float(group["__side"].iloc[0])
        low = group[["__x", "__y", "__z"]].iloc[0].to_numpy(float) * size
        near = 1e-9 * (1 + np.abs(low) + size)  # centres on a border come from both sides, and once into the result
        return _found(group, lambda c, r: r <= reach and (c >= low - near).all() and (c < low + size + near).all())

    found = placed.groupBy(*KEYS, "__side", "__x", "__y", "__z").applyInPandas(in_block, f"{head}, {_SPHERES}").dropDuplicates([*KEYS, "contacts"])
    return numbered(found, KEYS, ["contacts"], "__number").select(*KEYS, (F.col("__number") - 1).cast("long").alias("sphere_id"), "cx", "cy", "cz", "radius", "contacts")


def radius_band(spheres: DataFrame, min_radius=None, max_radius=None) -> DataFrame:
    """Without spheres smaller than the least or larger than the largest radius; equal ones stay."""
    if min_radius is not None:
        spheres = spheres.where(F.col("radius") >= length(min_radius, "min_radius"))
    if max_radius is not None:
        spheres = spheres.where(F.col("radius") <= length(max_radius, "max_radius"))
    return spheres


def without_spheres(spheres: DataFrame, removed: DataFrame) -> DataFrame:
    """Spheres whose key and ``sphere_id`` are not in ``removed``."""
    return spheres.join(removed.select(*KEYS, "sphere_id").distinct(), [*KEYS, "sphere_id"], "left_anti").select(*spheres.columns)


def contacts_union(spheres: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The distinct contact points of the spheres of each structure (or of ``keys``), sorted."""
    keys = keys or KEYS
    return spheres.select(*keys, F.explode("contacts").alias("point")).distinct().groupBy(*keys).agg(F.array_sort(F.collect_list("point")).alias("contacts"))


def surrounded(spheres: DataFrame, points: DataFrame) -> DataFrame:
    """Spheres all of whose contacts are among ``points`` (keys, ``point_index``)."""
    touch = spheres.select(*KEYS, "sphere_id", F.explode("contacts").alias("point_index"))
    outside = touch.join(points.select(*KEYS, "point_index").distinct(), [*KEYS, "point_index"], "left_anti")
    return without_spheres(spheres, outside)


def centroids(members: DataFrame, by: list[str], xyz: tuple[str, str, str] = ("cx", "cy", "cz")) -> DataFrame:
    """Mean position and size of each group."""
    return members.groupBy(*by).agg(*[F.avg(c).alias(c) for c in xyz], F.count("*").alias("size"))


def by_radius(spheres: DataFrame) -> DataFrame:
    """The spheres of each structure, smallest first."""
    return spheres.orderBy("system_id", "structure_index", "radius", "sphere_id")


__all__ = ["alpha_spheres", "by_radius", "centroids", "circumspheres", "contacts_union", "empty_spheres", "radius_band", "surrounded", "without_spheres"]
