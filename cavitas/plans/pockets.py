"""The two pocket pipelines: alpha-spheres of a structure, clustered."""

from __future__ import annotations

import warnings
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cavitas.functions.checks import length, whole_number
from cavitas.functions.metrics import euclidean
from cavitas.operators import selection as S
from cavitas.operators.cluster import hierarchical
from cavitas.operators.geometry import KEYS, alpha_spheres, centroids, radius_band
from cavitas.operators.graph import bfs_depth, connected_components, hot_join
from cavitas.operators.joins import distance_pairs, group_contacts, sphere_neighbors
from cavitas.operators.network import OUTSIDE
from cavitas.operators.reach import components_by_distance, depth_by_distance
from cavitas.session import cut
from cavitas.sources.pdb import atoms_of

CENTRE = ("cx", "cy", "cz")


def heavy_points(atoms: DataFrame, selection="all", structures=None) -> DataFrame:
    """Points of the chosen atoms, without solvent, ions, ligands and hydrogens."""
    chosen = S.select_structures(S.select_atoms(atoms, selection), structures)
    return S.as_points(S.without_hydrogens(S.without_types(chosen)))


def at_least(members: DataFrame, n: int, group: str = "pocket_id") -> DataFrame:
    """Members of the groups of ``n`` or more."""
    sizes = members.groupBy(*KEYS, group).agg(F.count("*").alias("__n")).where(F.col("__n") >= n).drop("__n")
    return members.join(sizes, [*KEYS, group], "left_semi")


def neighbour_clusters(spheres: DataFrame, max_neighbor_dist) -> DataFrame:
    """Step one: components of the spheres that share an edge and lie near; ``pocket_id`` is the least sphere."""
    side = lambda n: spheres.select(*KEYS, F.col("sphere_id").alias(n), *[F.col(c).alias(f"{c}_{n}") for c in CENTRE])
    pairs = sphere_neighbors(spheres, "edge").join(side("i"), [*KEYS, "i"]).join(side("j"), [*KEYS, "j"])
    near = pairs.where(euclidean([F.col(f"{c}_i") for c in CENTRE], [F.col(f"{c}_j") for c in CENTRE]) <= length(max_neighbor_dist))
    return connected_components(near, "i", "j", tuple(KEYS)).select(*KEYS, F.col("component").alias("pocket_id"), F.col("node").alias("sphere_id"))


def _renamed(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Members of the clusters in ``groups`` (node, component) under their group."""
    g = groups.select(*KEYS, F.col("node").alias("pocket_id"), F.col("component").alias("__g"))
    return members.join(g, [*KEYS, "pocket_id"]).select(*KEYS, F.col("__g").alias("pocket_id"), "sphere_id")


def pockets_by_contacts(
    spheres: DataFrame, min_radius="3.0 angstroms", max_radius="6.0 angstroms", max_neighbor_dist="1.73 angstroms", max_cluster_dist="4.5 angstroms",
    max_pair_dist="2.5 angstroms", min_contacts: int = 2, min_spheres: int = 36, keep_isolated: bool = False,
) -> DataFrame:
    """``system_id, structure_index, pocket_id, sphere_id``.

    Near neighbours cluster; clusters with near centroids merge; clusters with enough near pairs
    of spheres merge; small pockets go. Clusters that nothing joins are dropped in the second step,
    and in the third if anything in the structure is joined there, unless ``keep_isolated``.
    """
    whole_number(min_contacts, "min_contacts")
    whole_number(min_spheres, "min_spheres")
    spheres = cut(radius_band(spheres, min_radius, max_radius))
    place = spheres.select(*KEYS, "sphere_id", *CENTRE)
    first = cut(neighbour_clusters(spheres, max_neighbor_dist))
    middle = centroids(first.join(place, [*KEYS, "sphere_id"]), [*KEYS, "pocket_id"])
    near = distance_pairs(middle, length(max_cluster_dist), "pocket_id", CENTRE, tuple(KEYS))
    alone = first.select(*KEYS, F.col("pocket_id").alias("node")).distinct() if keep_isolated else None
    second = cut(_renamed(first, connected_components(near, "i", "j", tuple(KEYS), alone)))
    touch = cut(group_contacts(second.join(place, [*KEYS, "sphere_id"]), length(max_pair_dist), "pocket_id", max(1, min_contacts), "sphere_id", CENTRE, tuple(KEYS)))
    groups = connected_components(touch, "a", "b", tuple(KEYS))
    untouched = second.select(*KEYS, F.col("pocket_id").alias("node"), F.col("pocket_id").alias("component")).distinct()
    untouched = untouched.join(groups.select(*KEYS, "node"), [*KEYS, "node"], "left_anti") if keep_isolated else untouched.join(touch.select(*KEYS).distinct(), KEYS, "left_anti")
    return at_least(_renamed(second, groups.unionByName(untouched)), min_spheres)


def pockets_by_linkage(
    spheres: DataFrame, min_radius="3.4 angstroms", max_radius="6.2 angstroms", cut_distance="2.4 angstroms", linkage: str = "s", metric: str = "e",
    min_spheres: int = 15, apolar_min_ratio: float | None = None,
) -> DataFrame:
    """``system_id, structure_index, pocket_id, sphere_id``: hierarchical clusters of sphere centres, cut, small ones dropped.

    ``apolar_min_ratio`` needs a boolean ``is_apolar`` of the spheres; without it a warning is given.
    """
    whole_number(min_spheres, "min_spheres")
    spheres = cut(radius_band(spheres, min_radius, max_radius))
    groups = hierarchical(spheres, length(cut_distance), "sphere_id", CENTRE, tuple(KEYS), linkage, metric)
    members = at_least(groups.select(*KEYS, F.col("component").alias("pocket_id"), F.col("node").alias("sphere_id")), min_spheres)
    if apolar_min_ratio is None:
        return members
    if "is_apolar" not in spheres.columns:
        warnings.warn("the spheres have no is_apolar: the apolar ratio is not applied", stacklevel=2)
        return members
    share = members.join(spheres.select(*KEYS, "sphere_id", "is_apolar"), [*KEYS, "sphere_id"]).groupBy(*KEYS, "pocket_id")
    fine = share.agg(F.avg(F.col("is_apolar").cast("int")).alias("share")).where(F.col("share") >= apolar_min_ratio)
    return members.join(fine, [*KEYS, "pocket_id"], "left_semi")


def find_pockets(system: DataFrame | str | Path | list, method: str = "contacts", selection="all", structures=None, **parameters) -> DataFrame:
    """Pocket members with their spheres' geometry, from an atoms table or the paths of PDB files."""
    spheres = cut(alpha_spheres(heavy_points(atoms_of(system), selection, structures)))
    pipeline = {"contacts": pockets_by_contacts, "linkage": pockets_by_linkage}[method]
    return pipeline(spheres, **parameters).join(spheres, [*KEYS, "sphere_id"])


def depth_from_outside(edges: DataFrame) -> DataFrame:
    """``node, depth, buried``: steps from node -1; what it can't reach is buried, with no depth."""
    reached = bfs_depth(edges, OUTSIDE, "i", "j")
    nodes = edges.select(F.col("i").alias("node")).unionByName(edges.select(F.col("j").alias("node"))).distinct()
    return nodes.join(reached, "node", "left").withColumn("buried", F.col("depth").isNull())


def accessible_pockets(edges: DataFrame, least: int = 1) -> DataFrame:
    """``node, component`` of the reachable part without node -1, in components of ``least`` or more nodes."""
    depth = depth_from_outside(edges).where(~F.col("buried") & (F.col("node") != OUTSIDE)).select("node")
    inner = edges.where((F.col("i") != OUTSIDE) & (F.col("j") != OUTSIDE)).join(depth.withColumnRenamed("node", "i"), "i", "left_semi")
    parts = connected_components(inner, "i", "j", nodes=depth)
    sizes = parts.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return parts.join(sizes, "component", "left_semi").select("node", "component")


def depth_of_points(points: DataFrame, radius: float, doors: DataFrame) -> DataFrame:
    """`depth_from_outside` over the pairs of points at most ``radius`` apart and the ``doors`` (node), which are one step from node -1, without a list of the pairs."""
    doors = doors.select("node").where("node IS NOT NULL")
    seeds = doors.select("node", F.lit(1).alias("depth")).unionByName(doors.limit(1).select(F.lit(OUTSIDE).cast(doors.schema["node"].dataType).alias("node"), F.lit(0).alias("depth")))
    return depth_by_distance(points, radius, seeds).withColumn("buried", F.col("depth").isNull())


def accessible_points(points: DataFrame, radius: float, doors: DataFrame) -> DataFrame:
    """`accessible_pockets` over the pairs of points at most ``radius`` apart and the ``doors`` (node): the components that have a door."""
    doors = doors.select("node").where("node IS NOT NULL").distinct()
    parts = cut(components_by_distance(points, radius, doors).join(doors.withColumn("door", F.lit(True)), "node", "left"))
    sizes = parts.groupBy("component").agg(F.count("*").alias("n"), F.bool_or("door").alias("open")).where("open").drop("open")
    return hot_join(parts.drop("door"), sizes, ["component"], "n", parts.count()).select("node", "component")
