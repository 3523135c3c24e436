"""Hard-negative mining with rotated one-bit codes and deterministic intervals.

Vectors of whole numbers are scored by their integer inner product with an anchor. Each vector is stored with the signs of its
rotated difference from one of ``CENTRES`` centres, one bit a component, the length of the difference along that code (its alignment)
and the length that is left. For a query, the inner product with a code is estimated by popcounts with the bit planes of its
rotated components, rounded to ``PLANES`` bits; the rounding is bounded by its own size, and what the code leaves out by Cauchy
and Schwarz: it is at most the product of the lengths that both have across the code. So each score has an interval that holds it for certain;
what can't be among those asked for goes, and the surviving intervals are scored in integers. Centres and rotation change no result.

Rows are dealt into blocks by hash; a block's rows are held by one task (about ``BLOCK``), and the queries, which are many times fewer rows, stream past each block
in the order of the shuffle, so that no task holds them. Results of blocks are merged by windows with a limit of rank.

Defined results: a row takes part if it has an id, a label, and components that are neither null nor not finite, nor over ``LARGEST`` in size
once scaled (whose products pass a 64-bit number); vectors meet those with as many components. Rows equal in all three count once. Rows with one id are rows
of their own, and none of them is a positive of another. Without positives, or negatives in range, an anchor gives
no row; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cavitas.llm.common import map_batches
from cavitas.session import cut, ship, table

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: A negative has at least ``LOW`` and at most ``HIGH`` hundredths of the positive's score.
LOW, HIGH = 50, 95
BLOCK = 1 << 16
PLANES = 6
#: Centres, and vectors that they are fitted on, at most.
CENTRES, SAMPLE = 16, 4096
LARGEST = 1 << 26


@lru_cache(maxsize=8)
def rotation(dims: int) -> np.ndarray:
    """A random rotation, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(dims).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def fit_centres(sample: list[list[int]]) -> dict[int, np.ndarray]:
    """A few rounds of k-means for each number of components."""
    out = {}
    for dims in {len(x) for x in sample if x}:
        x = np.array([v for v in sample if len(v) == dims], float)
        c = x[:CENTRES].copy()
        for _ in range(4):
            own = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            c = np.array([x[own == k].mean(axis=0) if (own == k).any() else c[k] for k in range(len(c))])
        out[dims] = c
    return out


def encode(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centre, packed signs, alignment and length left of each row."""
    n, dims = x.shape
    at = (-2 * x @ centres.T + (centres**2).sum(axis=1)).argmin(axis=1) if len(centres) and n else np.zeros(n, np.int64)
    turned = (x - centres[at]) @ rotation(dims).T
    signs = turned > 0
    along = np.abs(turned).sum(axis=1) / np.sqrt(max(dims, 1))
    left = np.sqrt(np.maximum((turned**2).sum(axis=1) - along**2, 0))
    wide = np.zeros((n, -(-dims // 64) * 64), bool)
    wide[:, :dims] = signs
    return at, np.packbits(wide, axis=1, bitorder="little"), along, left


class Query:
    """A query's rotated components as bit planes, and what rounding them can change."""

    def __init__(self, q: np.ndarray, planes: int = PLANES):
        dims = len(q)
        turned = rotation(dims) @ q
        low, high = (turned.min(), turned.max()) if dims else (0.0, 0.0)
        step = max((high - low) / ((1 << planes) - 1), 1e-300)
        u = np.clip(((turned - low) / step).round(), 0, (1 << planes) - 1).astype(np.int64)
        self.low, self.step, self.total = low, step, u.sum()
        self.root = np.sqrt(max(dims, 1))
        self.error = np.abs(turned - (low + step * u)).sum() / self.root
        self.length2 = float(turned @ turned)
        self.dims = dims
        wide = np.zeros((planes, -(-dims // 64) * 64), bool)
        wide[:, :dims] = (u[None] >> np.arange(planes)[:, None]) & 1
        self.planes = np.packbits(wide, axis=1, bitorder="little").view(np.uint64)

    def bounds(self, bits: np.ndarray, ones: np.ndarray, along: np.ndarray, left: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest scores of rows of codes: packed bits, set bits, alignment, length left, and the score of their centres."""
        inside = np.zeros(len(bits), np.int64)
        for k, plane in enumerate(self.planes):
            inside += np.bitwise_count(bits & plane).sum(axis=1, dtype=np.int64) << k
        # the sum over set bits less that over others, of low + step * u
        g = (self.low * (2 * ones - self.dims) + self.step * (2 * inside - self.total)) / self.root
        across = left * np.sqrt(np.maximum(self.length2 - np.maximum(np.abs(g) - self.error, 0) ** 2, 0))
        spread = along * self.error + across
        spread = spread + 1e-9 * (np.abs(offset) + along * np.abs(g) + spread) + 0.5
        middle = offset + along * g
        return middle - spread, middle + spread


class Side:
    """The rows of a block with one number of components."""

    def __init__(self, ids, labels, x, centre, bits, along, left, centres):
        self.ids, self.labels, self.x = ids, labels, x
        self.centre, self.bits, self.along, self.left, self.centres = centre, bits, along, left, centres
        self.ones = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.order = np.argsort(labels, kind="stable")
        self.by_label = labels[self.order]

    def with_label(self, label: int) -> np.ndarray:
        a, b = np.searchsorted(self.by_label, [label, label + 1])
        return self.order[a:b]

    def without_label(self, label: int) -> np.ndarray:
        a, b = np.searchsorted(self.by_label, [label, label + 1])
        return np.concatenate([self.order[:a], self.order[b:]])

    def bounds(self, q: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        offset = (self.centres @ q)[self.centre[rows]]
        return Query(q).bounds(self.bits[rows], self.ones[rows], self.along[rows], self.left[rows], offset)

    def scores(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return self.x[rows] @ q

    def best(self, label: int, own_id: int, q: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the ``most`` best other rows of the label."""
        rows = self.with_label(label)
        rows = rows[self.ids[rows] != own_id]
        if len(rows) > most:
            low, high = self.bounds(q.astype(float), rows)
            rows = rows[high >= np.partition(low, len(low) - most)[len(low) - most]]
        s = self.scores(q, rows)
        top = np.lexsort((self.ids[rows], -s))[:most]
        return self.ids[rows[top]], s[top]

    def within(self, label: int, q: np.ndarray, ranges: list[tuple[int, int]], most: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each range of scores (both ends in it): ids and scores of its ``most`` best rows of other labels."""
        rows = self.without_label(label)
        if len(rows) > most:
            low, high = self.bounds(q.astype(float), rows)
            wanted = np.zeros(len(rows), bool)
            for a, b in ranges:
                least = a
                certain = low[(low >= a) & (high <= b)]
                if len(certain) >= most:
                    least = max(least, np.partition(certain, len(certain) - most)[len(certain) - most])
                wanted |= (high >= least) & (low <= b)
            rows = rows[wanted]
        s = self.scores(q, rows)
        order = np.lexsort((self.ids[rows], -s))
        ids, s = self.ids[rows[order]], s[order]
        out = []
        for a, b in ranges:
            first, last = np.searchsorted(-s, -b), np.searchsorted(-s, -a, side="right")
            take = slice(first, min(last, first + most))
            out.append((ids[take], s[take]))
        return out


def score_range(positive: int) -> tuple[int, int]:
    """The scores s with LOW * positive <= 100 * s <= HIGH * positive."""
    return -(-LOW * positive // 100), HIGH * positive // 100


def _whole(vectors: DataFrame, scale: int) -> DataFrame:
    """``vec_id, label, x`` of the rows that take part."""
    fits = lambda x: F.coalesce((x > -LARGEST) & (x < LARGEST), F.lit(False)) & ~F.isnan(x)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.transform("embedding", lambda x: x.cast("double") * scale).alias("v"))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").where(F.forall("v", fits))
    return rows.select("vec_id", "label", F.transform("v", lambda x: F.floor(x).cast("int")).alias("x"))


_INDEX = "vec_id long, label long, x array<int>, centre int, bits binary, along double, remains double"


def index(vectors: DataFrame, scale: int = SCALE) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """Each row that takes part with its code (``centre, bits, along, remains``), and the centres by number of components."""
    ship(vectors.sparkSession)
    rows = _whole(vectors, scale)
    centres = fit_centres([r["x"] for r in rows.orderBy(F.xxhash64("vec_id", "label", "x"), "vec_id").limit(SAMPLE).select("x").collect()])

    def make():
        def step(batch: pa.RecordBatch):
            x = [np.array(v, float) for v in batch["x"].to_pylist()]
            sizes = np.array([len(v) for v in x])
            out = [None] * len(x)
            for dims in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dims)
                own = np.stack([x[k] for k in at]) if dims else np.zeros((len(at), 0))
                centre, bits, along, left = encode(own, centres.get(dims, np.zeros((1, dims))))
                for k, *code in zip(at.tolist(), centre.tolist(), (b.tobytes() for b in bits), along.tolist(), left.tolist(), strict=True):
                    out[k] = code
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            arrays = [pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.float64(), pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], batch["x"], *arrays], ["vec_id", "label", "x", "centre", "bits", "along", "remains"])

        return step

    return cut(map_batches(rows, make, _INDEX)), centres


def _sides(batches: list[pa.RecordBatch], centres: dict[int, np.ndarray]) -> dict[int, Side]:
    rows = pa.Table.from_batches(batches).combine_chunks()
    sizes = np.array([len(v) for v in rows["x"].to_pylist()])
    out = {}
    for dims in np.unique(sizes).tolist():
        own = rows.filter(pa.array(sizes == dims))
        numbers = lambda c: own[c].to_numpy()  # noqa: B023, E731
        x = own["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(own), dims)
        bits = np.frombuffer(b"".join(own["bits"].to_pylist()), np.uint64).reshape(len(own), -1)
        code = [numbers("vec_id"), numbers("label"), x, numbers("centre"), bits, numbers("along"), numbers("remains")]
        order = np.lexsort((*x.T, code[1], code[0]))
        code = [c[order] for c in code]
        fresh = np.ones(len(own), bool)
        fresh[1:] = (code[0][1:] != code[0][:-1]) | (code[1][1:] != code[1][:-1]) | (code[2][1:] != code[2][:-1]).any(axis=1)
        out[dims] = Side(*(c[fresh] for c in code), centres.get(dims, np.zeros((1, dims))))
    return out


def _past_blocks(centres: dict[int, np.ndarray], work):
    """Over batches sorted by block and kind: ``work`` of the block's rows (kind 0, held) and of each batch of its queries (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, sides = None, [], None
        for batch in batches:
            marks = batch["block"].to_numpy(zero_copy_only=False) * 2 + batch["kind"].to_numpy(zero_copy_only=False)
            edges = np.concatenate([[0], np.flatnonzero(np.diff(marks)) + 1, [len(marks)]]) if len(marks) else [0]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                part = batch.slice(a, b - a)
                at, kind = divmod(int(marks[a]), 2)
                if at != block:
                    block, held, sides = at, [], None
                if kind == 0:
                    held.append(part)
                elif held:
                    sides = sides or _sides(held, centres)
                    yield from work(sides, part)

    return run


def _meet(rows: DataFrame, queries: DataFrame, blocks: int) -> DataFrame:
    """Rows dealt to blocks, and the queries (with ``ranges``) to each block, behind its rows."""
    by_hash = F.pmod(F.xxhash64("vec_id", "label", "x"), F.lit(blocks))
    side = rows.select(by_hash.alias("block"), F.lit(0).alias("kind"), *rows.columns, F.lit(None).cast("array<bigint>").alias("ranges"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")
    asked = queries.select(every, F.lit(1).alias("kind"), "vec_id", "label", "x", *[F.lit(None).cast(t).alias(c) for c, t in rows.dtypes[3:]], "ranges")
    return side.unionByName(asked).repartition(blocks, "block").sortWithinPartitions("block", "kind")


def _positives_in_blocks(most: int):
    def work(sides: dict[int, Side], queries: pa.RecordBatch):
        out: list[tuple] = []
        for own_id, label, x in zip(*(queries[c].to_pylist() for c in ("vec_id", "label", "x")), strict=True):
            if len(x) in sides:
                for i, s in zip(*(a.tolist() for a in sides[len(x)].best(label, own_id, np.array(x, np.int64), most)), strict=True):
                    out.append((own_id, label, x, i, s))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) if n != 2 else pa.array(list(c), pa.list_(pa.int32())) for n, c in enumerate(zip(*out, strict=True))], ["anchor_id", "label", "x", "positive_id", "positive_score"])

    return work


def _negatives_in_blocks(most: int):
    def work(sides: dict[int, Side], queries: pa.RecordBatch):
        out: list[tuple] = []
        for own_id, key, label, x, ranges in zip(*(queries[c].to_pylist() for c in ("vec_id", "centre", "label", "x", "ranges")), strict=True):
            if len(x) in sides:
                found = sides[len(x)].within(label, np.array(x, np.int64), list(map(score_range, ranges)), most)
                for p, (ids, s) in zip(ranges, found, strict=True):
                    out += [(own_id, label, x, p, i, v) for i, v in zip(ids.tolist(), s.tolist(), strict=True)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) if n != 2 else pa.array(list(c), pa.list_(pa.int32())) for n, c in enumerate(zip(*out, strict=True))], ["anchor_id", "label", "x", "positive_score", "negative_id", "negative_score"])

    return work


def _first(rows: DataFrame, by: list[str], score: str, id_: str, most: int) -> DataFrame:
    """The ``most`` best rows of each group with their ``rank``; Spark cuts each task's rows to so many before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), id_))
    return rows.withColumn("rank", place).where(F.col("rank") <= most)


def hard_negatives(vectors: DataFrame, anchors: Column, scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, block: int = BLOCK) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors`` has ``vec_id, embedding, label``; rows for which ``anchors`` holds (of ``vec_id``) are anchors.
    """
    spark = vectors.sparkSession
    rows, centres = index(vectors, scale)
    n = rows.count()
    blocks = max(1, ceil(n / block), min(spark.sparkContext.defaultParallelism, ceil(n / 512)))
    asked = rows.where(anchors).select("vec_id", "label", "x").distinct()
    met = _meet(rows, asked.withColumn("ranges", F.lit(None).cast("array<bigint>")), blocks)
    best = met.mapInArrow(_past_blocks(centres, _positives_in_blocks(positives)), "anchor_id long, label long, x array<int>, positive_id long, positive_score long")
    anchor = ["anchor_id", "label", "x"]
    best = cut(_first(best, anchor, "positive_score", "positive_id", positives).drop("rank"))
    # a score or more for each anchor, at most ``positives``
    ranges = best.groupBy(*anchor).agg(F.collect_set("positive_score").alias("ranges")).withColumnRenamed("anchor_id", "vec_id")
    met = _meet(rows, ranges, blocks)
    found = met.mapInArrow(_past_blocks(centres, _negatives_in_blocks(negatives)), "anchor_id long, label long, x array<int>, positive_score long, negative_id long, negative_score long")
    found = _first(found, [*anchor, "positive_score"], "negative_score", "negative_id", negatives)
    return best.join(found, [*anchor, "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 50 == 0)


OP11_SQL = f"""
WITH kept AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
long_rows AS (SELECT vec_id, label, unnest(range(len(v))) AS dim, unnest(v) AS x FROM kept),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(sum(a.x * b.x) AS BIGINT) AS score
  FROM long_rows a JOIN long_rows b USING (dim) WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id GROUP BY ALL),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {POSITIVES})
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY row_number() OVER w <= {NEGATIVES}
"""
