"""MinHash near-dedup with HyperMinHash registers: four-word shingles, Jaccard similarity 0.8 or more.

A-Z are lower-cased, words are runs outside space and U+0009 to U+000D, and a document's set has its distinct
runs of ``words`` words (fewer words: the whole sequence as one). A 64-bit hash of a shingle names one of
``REGISTERS`` buckets by its first bits; of a bucket's hashes the smallest stays, as the number of leading zeros
of its further bits and the ``MANTISSA`` bits after the first one: a register of 16 bits, 0 if the bucket is empty.

Candidates share one of ``BANDS`` bands of ``ROWS`` registers, where an empty bucket lends the register of the first
full one in a fixed random order of its own, so that small sets have whole bands too:
1 - (1 - J ** ROWS) ** BANDS of the pairs of similarity J, all but 5e-8 at 0.8. Candidates are let through by the estimate of J from
the registers that either has: the share that agrees, less what agrees by chance, within ``SLACK`` standard deviations of
the similarity asked for. What that joins is judged by the exact similarity of the full sets: see `similar_sets`.

Defined results: a text that is null, empty or blank has an empty set and links to nothing; rows with one id and
different texts are documents of their own; ``component_id`` is the smallest id reachable, its own included; rows without an id
link to nothing, have no component and are kept; repeated rows give repeated rows; an empty table gives no
rows; other columns are not read, and pass through ``deduplicate``. Sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cavitas.llm.common import documents, map_batches, mix, texts_of
from cavitas.llm.similar_sets import BUCKET, SIMILARITY, STREAM, WEIGHT, Near, set_name, shingle_set, similar_classes
from cavitas.operators.graph import connected_components, hot_join
from cavitas.session import cut, ship

WORDS = 4
REGISTERS, MANTISSA = 128, 10
BANDS, ROWS = 32, 4
SLACK = 5.0

_BITS = REGISTERS.bit_length() - 1
#: For each bucket, all buckets in an order of its own.
_ORDER = np.argsort(mix(np.arange(1, REGISTERS * REGISTERS + 1, dtype=np.uint64)).reshape(REGISTERS, REGISTERS), axis=1)
_WEIGHTS = mix(np.arange(1, ROWS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def registers(hashes: np.ndarray) -> np.ndarray:
    """The registers of sorted, distinct hashes: zeros of the rest above ``MANTISSA`` bits of it, plus one; 0 if empty."""
    out = np.zeros(REGISTERS, np.uint16)
    if not len(hashes):
        return out
    bucket = (hashes >> np.uint64(64 - _BITS)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    rest = (hashes[first] << np.uint64(_BITS)) | np.uint64((1 << _BITS) - 1)  # never zero
    zeros = 64 - np.frexp((rest >> np.uint64(11)).astype(np.float64))[1] - 11
    deep = zeros >= 53  # below what a double tells apart
    zeros[deep] = 64 - np.frexp((rest[deep] & np.uint64(2047)).astype(np.float64))[1]
    after = np.where(zeros >= 63, np.uint64(0), rest << np.minimum(zeros + 1, 63).astype(np.uint64))
    mantissa = after >> np.uint64(64 - MANTISSA)
    out[bucket[first]] = (zeros.astype(np.uint64) << np.uint64(MANTISSA)) + mantissa + np.uint64(1)
    return out


def dense(found: np.ndarray) -> np.ndarray:
    """Registers with those of empty buckets lent; all zero if all are."""
    full = found > 0
    if full.all() or not full.any():
        return found
    order = _ORDER[~full]
    out = found.copy()
    out[~full] = found[order[np.arange(len(order)), full[order].argmax(axis=1)]]
    return out


def bands(found: np.ndarray) -> np.ndarray:
    """A key of each band."""
    own = (dense(found).astype(np.uint64).reshape(BANDS, ROWS) * _WEIGHTS).sum(axis=1, dtype=np.uint64)
    return mix(own * np.uint64(BANDS) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def by_chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Expected share of buckets that agree in sets of n and m members without one in common.

    The published approximation 0.1692 * 2 ** -MANTISSA * 4 r / (1 + r) ** 2, with r the ratio of the sizes.
    """
    ratio = np.maximum(n, m) / np.maximum(np.minimum(n, m), 1)
    return 0.1692 / (1 << MANTISSA) * 4 * ratio / (1 + ratio) ** 2


def estimate(one: np.ndarray, others: np.ndarray, n: int, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The collision-corrected similarity of one row of registers to others, and the number of buckets it rests on."""
    either = ((others > 0) | (one > 0)).sum(axis=1)
    same = ((others == one) & (one > 0)).sum(axis=1) / np.maximum(either, 1)
    chance = by_chance(np.full(len(sizes), n), sizes)
    return (same - chance) / (1 - chance), either


def _alike(similarity: float):
    spread = SLACK * sqrt(similarity * (1 - similarity))

    def of(prints: list[bytes], sizes: np.ndarray) -> Near:
        rows = np.frombuffer(b"".join(prints), np.uint16).reshape(len(prints), REGISTERS)

        def near(at: int, others: np.ndarray) -> np.ndarray:
            j, buckets = estimate(rows[at], rows[others], int(sizes[at]), sizes[others])
            return j >= similarity - spread / np.sqrt(np.maximum(buckets, 1))

        return near

    return of


def _sketcher(words: int):
    def make():
        def step(batch: pa.RecordBatch):
            rows = []
            for data in texts_of(batch["text"]):
                h = shingle_set(data, words)
                found = registers(h)
                rows.append((set_name(h), len(h), bands(found).tolist() if len(h) else None, found.tobytes()))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            arrays = [pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["row_key"], *arrays], ["doc_id", "row_key", "id", "n", "bands", "print"])

        return step

    return make


def sketches(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, row_key, id`` of its class, ``n`` shingles, ``bands`` (null if empty) and registers of each row."""
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row_key"), F.col("text").cast("string"))
    return map_batches(rows, _sketcher(words), "doc_id long, row_key long, id long, n long, bands array<long>, print binary")


def _keys(classes: DataFrame) -> DataFrame:
    return classes.select("id", F.explode("bands").alias("key"))


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, bucket: int = BUCKET, stream: int = STREAM, weight: int = WEIGHT) -> DataFrame:
    """``doc_id, row_key, n, keep_id, keep_key``: each row, and of the row of its component with the smallest id (and text hash)."""
    ship(docs.sparkSession)
    rows = cut(sketches(docs, words))
    linked = rows.where("n > 0 AND doc_id IS NOT NULL")
    found = similar_classes(docs.where("doc_id IS NOT NULL"), linked, _keys, _alike(similarity), words, similarity, bucket, stream, weight)
    firsts = linked.groupBy("id").agg(F.min(F.struct("doc_id", "row_key")).alias("first"), F.count("*").alias("rows"))
    parts = connected_components(found).select(F.col("node").alias("id"), "component")
    named = cut(firsts.join(parts, "id", "left").withColumn("component", F.coalesce("component", "id")))
    keep = named.groupBy("component").agg(F.min("first").alias("keep"), F.count("*").alias("size"))
    named = hot_join(named, keep, ["component"], "size", named.count()).select("id", "keep", "rows")
    joined = hot_join(linked.select("doc_id", "row_key", "n", "id"), named, ["id"], "rows", linked.count())
    joined = joined.select("doc_id", "row_key", "n", F.col("keep.doc_id").alias("keep_id"), F.col("keep.row_key").alias("keep_key"))
    alone = rows.where("n = 0 OR doc_id IS NULL")
    return joined.unionByName(alone.select("doc_id", "row_key", "n", F.col("doc_id").alias("keep_id"), F.col("row_key").alias("keep_key")))


def deduplicate(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each component stays: the one with the smallest id (and rows that repeat it)."""
    groups = near_duplicates(docs, words, similarity)
    gone = groups.where("doc_id <> keep_id OR row_key <> keep_key").select(F.col("doc_id").alias("__gone"), F.col("row_key").alias("__key")).distinct()
    on = (docs["doc_id"].cast("long") == F.col("__gone")) & (F.xxhash64(docs["text"]) == F.col("__key"))
    return docs.join(gone, on, "left_anti")


def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicates(documents(spark, sf_dir))
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(True)).alias("kept")
    return groups.select("doc_id", F.col("n").alias("n_shingles"), F.col("keep_id").alias("component_id"), kept)


#: All pairs by shared shingles, then labels passed along links until none changes.
OP13_SQL = """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS q, len(ws) AS n FROM w),
k AS (SELECT doc_id, q, n, concat_ws(' ', word, """ + ", ".join(f"lead(word, {k}) OVER o" for k in range(1, WORDS)) + f""") AS g FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY q)),
s AS (SELECT DISTINCT doc_id, g FROM k WHERE q + {WORDS - 1} <= n OR n < {WORDS} AND q = 1),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT a AS doc_id, a AS other FROM both_ways UNION SELECT r.doc_id, e.b FROM reached r JOIN both_ways e ON e.a = r.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles, coalesce(least.component_id, w.doc_id) AS component_id, coalesce(coalesce(least.component_id, w.doc_id) = w.doc_id, true) AS kept
FROM w LEFT JOIN z USING (doc_id) LEFT JOIN least USING (doc_id)"""
