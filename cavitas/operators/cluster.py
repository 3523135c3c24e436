"""Hierarchical clustering with a distance cut."""

from __future__ import annotations

import warnings

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cavitas.functions.metrics import METRICS
from cavitas.operators.graph import connected_components
from cavitas.operators.joins import distance_pairs
from cavitas.operators.linkage import by_centroids, by_links
from cavitas.session import ship

LINKAGES = {"s": "single", "m": "complete", "a": "average", "c": "centroid"}


def single_linkage(points: DataFrame, cut: float, item: str, xyz, keys: tuple[str, ...], metric: str = "e") -> DataFrame:
    """``*keys, node, component``: single linkage cut at ``cut`` is the components of the pairs within it.

    Single points are clusters of their own; a cluster is named by its least member.
    """
    pairs = distance_pairs(points, cut, item, xyz, keys, metric)
    nodes = points.select(*keys, F.col(item).alias("node"))
    return connected_components(pairs, "i", "j", keys, nodes)


def hierarchical(points: DataFrame, cut: float, item: str, xyz, keys: tuple[str, ...], method: str = "s", metric: str = "e") -> DataFrame:
    """``*keys, node, component`` by linkage ``s``, ``m``, ``a`` or ``c`` and metric ``e``, ``b`` or ``c``.

    Single linkage is a distributed join. Complete and average linkage merge nothing within the cut that single linkage keeps apart, so
    that each of its components is a task; centroids may come nearer to others, so that centroid linkage
    is one task a structure. Neither holds a distance matrix, only pairs within the cut. Unknown codes warn and fall back to single
    and Euclidean; centroid linkage is always Euclidean.
    """
    if method not in LINKAGES:
        warnings.warn(f"unknown linkage {method!r}: single is used", stacklevel=2)
        method = "s"
    if metric not in METRICS:
        warnings.warn(f"unknown metric {metric!r}: euclidean is used", stacklevel=2)
        metric = "e"
    if method == "c" and metric != "e":
        warnings.warn("centroid linkage needs the Euclidean metric, which is used", stacklevel=2)
        metric = "e"
    if method == "s":
        return single_linkage(points, cut, item, xyz, keys, metric)
    ship(points.sparkSession)
    k, c = list(keys), list(xyz)
    name = LINKAGES[method]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node")
        nodes, x = group["node"].to_numpy(), group[c].to_numpy(float)
        label = by_centroids(x, cut) if name == "centroid" else by_links(x, cut, name, metric)
        return group[k].assign(node=nodes, component=nodes[label])

    kinds = dict(points.dtypes)
    schema = ", ".join([*(f"{x} {kinds[x]}" for x in k), "node long", "component long"])
    rows = points.select(*k, F.col(item).cast("long").alias("node"), *[F.col(x).cast("double").alias(x) for x in c])
    if name == "centroid":
        return rows.groupBy(*k).applyInPandas(run, schema)
    parts = single_linkage(rows, cut, "node", xyz, keys, metric).withColumnRenamed("component", "__part")
    return rows.join(parts, [*k, "node"]).groupBy(*k, "__part").applyInPandas(run, schema)


def by_size(parts: DataFrame, component: str = "component", keys: tuple[str, ...] = ()) -> DataFrame:
    """``*keys, component, n``: the clusters, largest first, then by name."""
    return parts.groupBy(*keys, component).agg(F.count("*").alias("n")).orderBy(*keys, F.desc("n"), component)
