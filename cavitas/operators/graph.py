"""Connected components and breadth-first depth over edge DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cavitas.session import cut, ship

#: Edges that a task takes at once to contract them.
CHUNK = 500_000

#: Keys that a join may send to every task, and rows of one key that a task takes in any case.
HOT_KEYS, HOT_ROWS = 100_000, 1_000


def hot_join(rows: DataFrame, by_key: DataFrame, on: list[str], size: str, total: int) -> DataFrame:
    """``rows`` joined with ``by_key``, which has one row a key and the number of its rows in ``size``.

    ``total`` is the number of rows or more. Fewer than ``HOT_KEYS`` keys can have over
    ``total / HOT_KEYS`` rows each: these are broadcast and their rows stay where they are. All
    other keys meet by shuffle, so that no key brings more rows than that to a task.
    """
    if total <= HOT_ROWS:
        return rows.join(by_key.drop(size), on)
    hot = by_key.where(F.col(size) > max(HOT_ROWS, total // HOT_KEYS))
    cold = by_key.where(F.col(size) <= max(HOT_ROWS, total // HOT_KEYS))
    spread = rows.join(F.broadcast(hot.drop(size)), on)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return spread.unionByName(rest.join(cold.drop(size), on))


def connected_components(
    edges: DataFrame,
    src: str = "src",
    dst: str = "dst",
    keys: tuple[str, ...] = (),
    nodes: DataFrame | None = None,
    chunk: int = CHUNK,
) -> DataFrame:
    """Label every node with the smallest node it can reach.

    ``edges`` are undirected; self loops, repeated edges and edges with a null
    end are harmless. ``keys`` are columns that separate independent graphs
    (for example ``system_id``). Nodes come from the edges only, unless
    ``nodes`` (columns ``*keys, node``) adds isolated ones. Returns
    ``*keys, node, component``. No edges and no nodes give an empty result.

    First each task contracts its edges, ``chunk`` at a time, to stars: what is left is a forest a chunk. If
    there is but one, or what is left fits one, that is all. Else alternating large-star and small-star steps: each node hangs its larger
    neighbours, then its smaller ones, on the least node it sees. A step is a
    partially aggregated ``min`` and an equi-join in which hubs are spread (`hot_join`), and the
    number of steps grows with the logarithm of the graph's size. The lineage is cut each round.
    """
    k = list(keys)
    e = (
        edges.select(*k, F.col(src).alias("u"), F.col(dst).alias("v"))
        .where(F.col("u").isNotNull() & F.col("v").isNotNull())
    )
    for name in k:
        e = e.where(F.col(name).isNotNull())
    e = cut(e)
    loops = e.where("u = v").select(*k, F.col("u").alias("node"))
    e = e.where("u <> v").select(*k, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    n = e.count()
    ship(edges.sparkSession)
    e = cut(e.coalesce(-(-n // chunk) or 1).mapInArrow(_contract(k, chunk), e.schema))
    mark, last = (e.count(),), None
    while n > chunk:
        if mark[0] <= chunk:  # what is left fits one chunk
            e = cut(e.coalesce(1).mapInArrow(_contract(k, chunk), e.schema))
            break
        e, mark = _round(e, k, mark[0])
        if mark == last:
            break
        last = mark
    labels = e.select(*k, F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(*k, F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    out = labels.unionByName(roots)
    alone = loops if nodes is None else loops.unionByName(nodes.select(*k, "node"))
    alone = alone.distinct().join(out.select(*k, "node"), [*k, "node"], "left_anti")
    return out.unionByName(alone.withColumn("component", F.col("node")))


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node that each of the nodes 0 to n - 1 reaches by the edges (a, b)."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _contract(keys: list[str], chunk: int):
    """Over batches of (*keys, u, v): for each ``chunk`` of them, each node with the least that it reaches."""

    def stars(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        graph = np.zeros(len(table), np.int64)
        for name in keys:
            codes, names = pd.factorize(table[name].to_pandas())
            graph = pd.factorize(graph * len(names) + codes)[0]
        node, names = pd.factorize(pd.concat([table["u"].to_pandas(), table["v"].to_pandas()], ignore_index=True), sort=True)
        place, first, own = np.unique(np.tile(graph, 2) * len(names) + node, return_index=True, return_inverse=True)
        root = roots(own[: len(table)], own[len(table) :], len(place))
        hung = np.flatnonzero(root != np.arange(len(root)))
        value = pa.array(names)
        at = [pa.array(x) for x in (first[hung] % len(table), node[first[hung]], node[first[root[hung]]])]
        columns = [table[name].combine_chunks().take(at[0]) for name in keys] + [value.take(x).cast(table["u"].type) for x in at[1:]]
        yield from pa.Table.from_arrays(columns, schema=table.schema).to_batches(10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if size + batch.num_rows > chunk and size:
                yield from stars(held)
                held, size = [], 0
            held.append(batch)
            size += batch.num_rows
        if size:
            yield from stars(held)

    return run


def _round(e: DataFrame, k: list[str], n: int) -> tuple[DataFrame, tuple]:
    both = e.unionByName(e.select(*k, F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(*k, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("__n"))
    large = (
        hot_join(both.where("v > u"), least, [*k, "u"], "__n", 2 * n)
        .select(*k, F.col("v").alias("u"), F.col("m").alias("v"))
        .where("u <> v")
        .distinct()
    )
    # in `large` every edge points from the larger node to a smaller one
    small_least = large.groupBy(*k, "u").agg(F.min("v").alias("m"), F.count("*").alias("__n"))
    small = hot_join(large, small_least, [*k, "u"], "__n", 2 * n)
    e = (
        small.select(*k, F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(small.select(*k, "u", F.col("m").alias("v")))
        .where("u <> v")
        .distinct()
    )
    e = cut(e)
    n, s = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v", *k).cast("decimal(38,0)"))).first()
    return e, (n, s)


def bfs_depth(edges: DataFrame, source, src: str = "src", dst: str = "dst", max_depth: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """Unweighted distance of every node reachable from ``source``, at most ``max_depth``.

    Returns ``node, depth``. Edges lie in parts of about ``chunk``, by range of their nodes, a hub over several. A round takes the
    parts that have a node with a new depth and passes on as many levels as each part's own edges reach; the
    depths then meet by their least. A path through p parts needs p rounds, however long it is. A source without
    edges gives its own row only.
    """
    spark = edges.sparkSession
    kind = edges.schema[src].dataType
    e = edges.select(F.least(src, dst).alias("u"), F.greatest(src, dst).alias("v")).where("u <> v").distinct()
    e = cut(e)
    parts = -(-e.count() // chunk) or 1
    e = e.repartitionByRange(parts, "u", "v") if parts > 1 else e
    e = cut(e.withColumn("part", F.spark_partition_id() if parts > 1 else F.lit(0)))
    ends = e.select("part", F.col("u").alias("node")).union(e.select("part", F.col("v").alias("node"))).distinct()
    ends = cut(ends) if parts > 1 else ends
    depths = spark.createDataFrame([(source,)], "node long").select(F.col("node").cast(kind), F.lit(0).alias("depth"), F.lit(True).alias("fresh"))
    ship(spark)
    schema = T.StructType([T.StructField("node", kind), T.StructField("depth", T.IntegerType())])
    while True:
        known = ends.withColumnRenamed("part", "at").join(depths, "node")
        if parts > 1:
            active = cut(known.where("fresh").select("at").distinct())
            if active.isEmpty():
                break
            known, near = known.join(active, "at", "left_semi"), e.join(active.withColumnRenamed("at", "part"), "part", "left_semi")
        else:
            near = e
        lower = near.groupBy("part").cogroup(known.groupBy("at")).applyInPandas(_deepened(max_depth), schema)
        both = depths.select("node", "depth", F.lit(False).alias("fresh")).unionByName(lower.withColumn("fresh", F.lit(True)))
        depths = cut(both.groupBy("node").agg(F.min("depth").alias("depth"), F.bool_or("fresh").alias("fresh")))
        if parts == 1:
            break
    return depths.drop("fresh")


def _deepened(max_depth: int | None):
    """Of a part's edges and the depths known of its nodes: the nodes that its edges bring to a lesser depth."""

    def run(edges: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        names = pd.Index(pd.unique(pd.concat([edges["u"], edges["v"]], ignore_index=True)))
        depth = np.full(len(names), np.iinfo(np.int32).max, np.int64)
        depth[names.get_indexer(known["node"])] = known["depth"]
        before = depth.copy()
        a, b = names.get_indexer(edges["u"]), names.get_indexer(edges["v"])
        a, b = np.concatenate([a, b]), np.concatenate([b, a])
        order = np.argsort(a, kind="stable")
        to, begin = b[order], np.searchsorted(a[order], np.arange(len(names) + 1))
        seeds = np.argsort(depth, kind="stable")[: len(known)]
        at, level = 0, 0
        front = seeds[:0]
        while at < len(seeds) or len(front):
            if not len(front):
                level = int(before[seeds[at]])
            stop = at + int(np.searchsorted(before[seeds[at:]], level, side="right"))
            own = seeds[at:stop]
            front, at = np.concatenate([front, own[depth[own] == level]]), stop
            if max_depth is not None and level >= max_depth:
                break
            size = begin[front + 1] - begin[front]
            place = np.repeat(begin[front] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            level += 1
            front = np.unique(to[place])
            front = front[depth[front] > level]
            depth[front] = level
        less = np.flatnonzero(depth < before)
        return pd.DataFrame({"node": names[less], "depth": depth[less].astype(np.int32)})

    return run
