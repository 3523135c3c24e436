"""Centroid clustering over a VA-file: vectors compressed to few-bit cells per dimension.

Vectors of whole numbers are assigned to the nearest centroid (squared Euclidean distance, of equal ones the smaller number),
and centroids replaced by the floor of their vectors' mean, for some rounds. Each vector has an approximation of ``BITS`` bits a
dimension, the number of a cell; a cell is a range of numbers. Lookup tables, a row a dimension and cell, give the least and the largest
squared distance of a cell from each centroid, and their sums an interval that holds the distance of the vector. A centroid whose
interval starts over the least upper end is not the nearest. If one is left, it is, by the approximation alone; the full vector is fetched
only where several are. Centroids are the exact floors of exact sums, which each round changes by the vectors
that moved: of the others no full vector is fetched. The final distances need every vector once.

Cells are cut between quantiles of the ``SAMPLE`` vectors with the smallest hashes, so evenly that most hold one or two numbers; the
outer ones reach to the smallest and largest number of all. Every vector has its approximation, and which cells there are changes no result.

Defined results: a vector takes part if it has exactly ``dims`` components, none null or not finite, and none over ``LARGEST`` in size once scaled (whose
squared distances pass a 64-bit number); others give no row. Of fewer vectors than centroids, each is one. Rows with one id are vectors of their own, in the order of
their components where the hashes are equal; null ids are clustered, and start no centroid; a table without vectors gives no rows; other columns are not read.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cavitas.llm.common import map_batches
from cavitas.session import cut, ship, table

DIMS, SCALE, CENTROIDS, ROUNDS, SEED = 64, 64, 16, 3, 1
BITS = 6
SAMPLE = 4096
#: Share of the sample beyond the cells that are cut evenly, at either end.
TAIL = 0.002
LARGEST = 1 << 26


def whole_vectors(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """``vec_id, full``: the vectors that take part, each component x as floor(scale * x)."""
    fits = lambda x: F.coalesce((x > -LARGEST) & (x < LARGEST), F.lit(False)) & ~F.isnan(x)
    rows = vectors.select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: x.cast("double") * scale).alias("v"))
    rows = rows.where((F.size("v") == dims) & F.forall("v", fits))
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(x).cast("int")).alias("full"))


def matrix(column: pa.Array | pd.Series, dims: int) -> np.ndarray:
    if isinstance(column, pd.Series):
        return np.stack(column.to_numpy()).astype(np.int64) if len(column) else np.zeros((0, dims), np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


class Cells:
    """The cells of each dimension: ``low`` and ``high`` of shape (dims, cells), both inclusive."""

    def __init__(self, sample: np.ndarray, least: np.ndarray, most: np.ndarray, bits: int = BITS):
        n = 1 << bits
        self.bits = bits
        self.edges = np.empty((len(least), n - 1), np.int64)
        for k, (a, b) in enumerate(zip(*np.quantile(sample, [TAIL, 1 - TAIL], axis=0), strict=True)):
            self.edges[k] = np.linspace(a, b, n - 1).round()
        self.low = np.maximum(np.concatenate([least[:, None], self.edges], axis=1), least[:, None])
        self.high = np.minimum(np.concatenate([self.edges - 1, most[:, None]], axis=1), most[:, None])

    def pack(self, full: np.ndarray) -> list[bytes]:
        """The cell numbers of each row, ``bits`` a dimension."""
        cell = np.stack([np.searchsorted(e, full[:, k], side="right") for k, e in enumerate(self.edges)], axis=1)
        bits = (cell[:, :, None] >> np.arange(self.bits - 1, -1, -1)) & 1
        packed = np.packbits(bits.reshape(len(full), -1).astype(np.uint8), axis=1)
        return [row.tobytes() for row in packed]

    def unpack(self, packed: list[bytes]) -> np.ndarray:
        size = len(self.edges) * self.bits
        bits = np.unpackbits(np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1), axis=1)[:, :size]
        return bits.reshape(len(packed), -1, self.bits) @ (1 << np.arange(self.bits - 1, -1, -1))

    def tables(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and largest squared distance of each centroid from each cell: (centroids, dims, cells)."""
        c = centroids[:, :, None]
        near = np.maximum(np.maximum(self.low - c, c - self.high), 0)
        far = np.maximum(np.abs(c - self.low), np.abs(c - self.high))
        return near**2, far**2


def candidates(cell: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """The centroids that may be nearest to each row of cell numbers, ascending."""
    dims = np.arange(cell.shape[1])
    low, high = (np.stack([t[k][dims, cell].sum(axis=1) for k in range(len(t))], axis=1) for t in tables)
    left = low <= high.min(axis=1, keepdims=True)
    return np.split(np.nonzero(left)[1], np.cumsum(left.sum(axis=1))[:-1]) if len(cell) else []


def nearest(full: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and its squared distance."""
    d = np.stack([((full - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    at = d.argmin(axis=1)
    return at, d[np.arange(len(d)), at]


def first_centroids(vectors: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The vectors with the smallest hashes of seed and id."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.where("vec_id IS NOT NULL").select(order.alias("h"), "full").orderBy("h", "full").limit(k).collect()
    return np.array([r["full"] for r in rows], np.int64)


def compressed(vectors: DataFrame, bits: int = BITS) -> tuple[DataFrame, Cells]:
    """``vec_id, cells, full`` of vectors (vec_id, full), and what the cells are."""
    ends = vectors.select(F.posexplode("full").alias("dim", "x")).groupBy("dim").agg(F.min("x").alias("least"), F.max("x").alias("most"))
    least, most = np.array([(r["least"], r["most"]) for r in sorted(ends.collect())], np.int64).T  # a row a dimension
    sample = vectors.select("full").orderBy(F.xxhash64("full"), "full").limit(SAMPLE).collect()
    cells = Cells(np.array([r["full"] for r in sample], np.int64), least, most, bits)

    def make():
        def step(batch: pa.RecordBatch):
            packed = cells.pack(matrix(batch["full"], len(least)))
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(packed, pa.binary()), batch["full"]], ["vec_id", "cells", "full"])

        return step

    return cut(map_batches(vectors, make, "vec_id long, cells binary, full array<int>")), cells


def near_centroids(rows: DataFrame, cells: Cells, now: np.ndarray, before: np.ndarray | None) -> DataFrame:
    """``rows`` (cells, full) with ``now`` and ``before``, the centroids that may be nearest by the cells, and ``full`` only where they don't tell whether the vector moved, or it did."""
    tables = [cells.tables(now), *([] if before is None else [cells.tables(before)])]

    @F.pandas_udf("struct<now:array<int>,before:array<int>>")
    def by_cells(packed: pd.Series) -> pd.DataFrame:
        found = [candidates(part, t) for t in tables for part in [cells.unpack(packed.tolist())]]
        return pd.DataFrame({"now": found[0], "before": found[-1] if before is not None else [None] * len(packed)})

    near = rows.withColumn("near", by_cells("cells")).select("near.now", "near.before", "full")
    still = F.coalesce((F.size("now") == 1) & (F.size("before") == 1) & (F.col("now")[0] == F.col("before")[0]), F.lit(False))
    return near.select("now", "before", F.when(~still, F.col("full")).alias("full"))


def _changes(now: np.ndarray, before: np.ndarray | None):
    """Over batches of ``near_centroids``: what the moved vectors add to the sums and counts of the centroids."""
    k, dims = now.shape

    def settled(lists: list, full: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        at = np.array([x[0] for x in lists], np.int64)
        several = np.flatnonzero(np.array([len(x) for x in lists]) > 1)
        at[several] = nearest(full[several], centroids)[0]
        return at

    def run(batches):
        total = np.zeros((k, dims + 1), np.int64)  # the last column counts
        for batch in batches:
            batch = batch.filter(batch["full"].is_valid())
            full = matrix(batch["full"], dims)
            if not len(full):
                continue
            rows = np.concatenate([full, np.ones((len(full), 1), np.int64)], axis=1)
            to = settled(batch["now"].to_pylist(), full, now)
            if before is None:
                np.add.at(total, to, rows)
                continue
            was = settled(batch["before"].to_pylist(), full, before)
            moved = to != was
            np.add.at(total, to[moved], rows[moved])
            np.subtract.at(total, was[moved], rows[moved])
        at = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].tolist(), pa.list_(pa.int64()))], ["centroid", "change"])

    return run


def sums(rows: DataFrame, cells: Cells, now: np.ndarray, before: np.ndarray | None, total: np.ndarray) -> np.ndarray:
    """The sums (and, last, counts) of the vectors nearest to each centroid of ``now``, from those of ``before``."""
    changes = near_centroids(rows, cells, now, before).mapInArrow(_changes(now, before), "centroid long, change array<long>")
    by_dim = changes.select("centroid", F.posexplode("change").alias("dim", "x")).groupBy("centroid", "dim").agg(F.sum("x").alias("x"))
    out = total.copy()
    for r in by_dim.collect():  # a row a centroid and dimension at most
        out[r["centroid"], r["dim"]] += r["x"]
    return out


def clusters(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, bits: int = BITS) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster, distance`` of each vector that takes part, and the final centroids."""
    ship(vectors.sparkSession)
    whole = cut(whole_vectors(vectors, dims, scale))
    now = first_centroids(whole, k, seed)
    if not len(now):
        return whole.where("vec_id IS NOT NULL").select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), now
    rows, cells = compressed(whole, bits)
    before, total = None, np.zeros((len(now), dims + 1), np.int64)
    for _ in range(rounds):
        total = sums(rows, cells, now, before, total)
        before, now = now, np.where(total[:, -1:] > 0, total[:, :-1] // np.maximum(total[:, -1:], 1), now)
    tables = cells.tables(now)

    def make():
        def step(batch: pa.RecordBatch):
            full, near = matrix(batch["full"], dims), candidates(cells.unpack(batch["cells"].to_pylist()), tables)
            at = np.array([x[0] for x in near], np.int64)
            several = np.flatnonzero(np.array([len(x) for x in near]) > 1)
            at[several] = nearest(full[several], now)[0]
            d = ((full - now[at]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(at.astype(np.int32)), pa.array(d)], ["vec_id", "cluster", "distance"])

        return step

    return cut(map_batches(rows, make, "vec_id long, cluster int, distance long")), now


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = clusters(table(spark, sf_dir, "embeddings"))
    names = [(k, sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for k, c in enumerate(centroids)]
    named = spark.createDataFrame(names, "cluster int, centroid_sha256 string")
    by_cluster = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    by_cluster = by_cluster.join(by_cluster.agg(F.sum("cluster_inertia").alias("inertia")), F.lit(True)).join(named, "cluster")
    # a row a centroid
    return found.join(F.broadcast(by_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round_sql(n: int) -> str:
    """The assignment by the centroids of round n, and the next centroids."""
    return f"""
near{n} AS (
  SELECT vec_id, k AS cluster, d FROM (
    SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, k) AS place FROM (
      SELECT v.vec_id, c.k, CAST(sum((v.x - c.x) * (v.x - c.x)) AS BIGINT) AS d
      FROM long_rows v JOIN c{n} c USING (dim) GROUP BY v.vec_id, c.k)) WHERE place = 1),
m{n} AS (
  SELECT cluster AS k, dim, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM near{n} JOIN long_rows USING (vec_id) GROUP BY cluster, dim),
c{n + 1} AS (
  SELECT c.k, c.dim, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, c.x) AS x FROM c{n} c LEFT JOIN m{n} m ON c.k = m.k AND c.dim = m.dim)"""


OP12_SQL = f"""
WITH kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}),
long_rows AS (SELECT vec_id, unnest(range({DIMS})) AS dim, unnest(v) AS x FROM kept),
firsts AS (
  SELECT vec_id, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS k FROM kept QUALIFY k < {CENTROIDS}),
c0 AS (SELECT f.k, l.dim, l.x FROM firsts f JOIN long_rows l USING (vec_id)),
{",".join(_round_sql(n) for n in range(ROUNDS + 1))},
named AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY dim)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY k),
totals AS (SELECT cluster, CAST(sum(d) AS BIGINT) AS cluster_inertia FROM near{ROUNDS} GROUP BY cluster)
SELECT n.vec_id, CAST(n.cluster AS INTEGER) AS cluster, n.d AS distance, t.cluster_inertia,
  CAST((SELECT sum(cluster_inertia) FROM totals) AS BIGINT) AS inertia, named.centroid_sha256
FROM near{ROUNDS} n JOIN totals t ON n.cluster = t.cluster JOIN named ON named.k = n.cluster
"""
