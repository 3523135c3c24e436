"""The SimHash operator at a given similarity: five-word shingles, 0.8 or more.

Classes with Jaccard similarity of ``SIMILARITY`` or more link. Candidates meet by the deletion-variant signatures of `simhash`:
each half of 32 bits of the first ``SIGNATURE_BITS`` bits of a SimHash fingerprint over the distinct shingles, with
each bit deleted. In texts of similarity J a share p = acos(2J / (1 + J)) / pi of the bits differs,
0.15 at 0.8, where a half differs in one bit at most with a probability of 0.03 only. So the signatures find the
closest copies, and classes are candidates as well if one of ``BANDS`` groups of ``GROUP`` minima of
their shingles agrees: 1 - (1 - J ** GROUP) ** BANDS, 0.9996 at 0.8, whatever the edit.

How they meet and are judged is in `similar_sets`: first by the ``SHINGLE_BITS`` bits of the fingerprints, where a pair within ``SLACK`` standard
deviations of p is let through, and then, within what that joins, by the exact similarity of the sets of
shingles. No link is under the similarity asked for, and none that the keys bring together is lost.

Defined results: as in `simhash`; rows without an id link to nothing and stay; rows with one id and
different texts are documents of their own, the one with the smaller text hash first; repeated rows stay
together. Classes are told apart by a 64-bit hash of their shingles.
"""

from __future__ import annotations

from math import acos, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cavitas.llm.common import map_batches, mix, texts_of
from cavitas.llm.similar_sets import BUCKET, SIMILARITY, STREAM, WEIGHT, Near, set_name, shingle_set, similar_classes
from cavitas.operators.graph import connected_components, hot_join
from cavitas.session import cut, ship

WORDS = 5
SIGNATURE_BITS, SHINGLE_BITS = 128, 512
BANDS, GROUP = 20, 5
SLACK = 4.0
#: With few shingles more bits differ than the formula says: at most this share, 4 shingles against 5.
FEW, FEW_SHARE = 32, 0.1875


def most_bits(similarity: float = SIMILARITY, bits: int = SHINGLE_BITS, slack: float = SLACK, least: float = 0.0) -> int:
    share = max(least, acos(2 * similarity / (1 + similarity)) / pi)
    return int(bits * (share + slack * sqrt(share * (1 - share) / bits)))


def long_fingerprint(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Each bit is 1 if it is set in over half of the hashes' expansions; none: all zero."""
    ones = np.zeros(bits, np.int64)
    for at in range(0, len(hashes), 1 << 13):
        part = hashes[at : at + (1 << 13), None] + np.arange(bits // 64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        ones += np.unpackbits(mix(part).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little")


_SEEDS = mix(np.arange(1, 2 * BANDS * GROUP + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)).reshape(2, -1, 1) | np.uint64(1)


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key of each group of minima of independently seeded hashes; none: those of no other set."""
    low = np.full(BANDS * GROUP, ~np.uint64(0))
    for at in range(0, len(hashes), 1 << 10):
        np.minimum(low, ((hashes[at : at + (1 << 10)] ^ _SEEDS[0]) * _SEEDS[1]).min(axis=1), out=low)
    own = (low.reshape(BANDS, GROUP) * _SEEDS[1, :GROUP, 0]).sum(axis=1, dtype=np.uint64)
    return mix(own + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _fingerprinter(words: int):
    longs = pa.list_(pa.int64())

    def make():
        def step(batch: pa.RecordBatch):
            rows = []
            for data in texts_of(batch["text"]):
                h = shingle_set(data, words)
                bits = long_fingerprint(h, SHINGLE_BITS)
                rows.append((set_name(h), bits[: SIGNATURE_BITS // 8].view(np.int64).tolist(), bands(h).tolist(), len(h), bits.tobytes()))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            arrays = [pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), longs, longs, pa.int64(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["row_key"], *arrays], ["doc_id", "row_key", "id", "own", "bands", "n", "print"])

        return step

    return make


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, row_key`` of each row that has an id, ``id`` of its class, signature bits, bands, number of shingles and their fingerprint."""
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row_key"), "text")
    return map_batches(rows, _fingerprinter(words), "doc_id long, row_key long, id long, own array<long>, bands array<long>, n long, print binary")


def signatures(prints: DataFrame) -> DataFrame:
    """``key, id``: 32 rows for each half of each 64 bits of ``own``, one bit deleted in each, and the ``bands``."""
    bit = F.expr("sequence(0, 31)")
    shift = lambda v, b: F.call_function("shiftleft", v, b)
    halves = []
    for n in range(SIGNATURE_BITS // 32):
        word = F.col("own")[n // 2]
        half = F.shiftrightunsigned(word, 32) if n % 2 else word.bitwiseAND(0xFFFFFFFF)
        halves.append(_variants(bit, half, n, shift))
    return prints.select("id", F.explode(F.concat(*halves, "bands")).alias("key"))


def _variants(bit, half, n: int, shift):
    one = F.lit(1).cast("long")
    return F.transform(bit, lambda b: half.bitwiseAND(F.bitwise_not(shift(one, b))).bitwiseOR(shift((b + 32 * n).cast("long"), F.lit(32))))


def _alike(similarity: float):
    """Prints that differ in few bits."""
    usual, few = most_bits(similarity), most_bits(similarity, least=FEW_SHARE)

    def of(prints: list[bytes], sizes: np.ndarray) -> Near:
        bits = np.frombuffer(b"".join(prints), np.uint64).reshape(len(prints), -1)
        most = np.where(sizes <= FEW, few, usual)
        return lambda at, others: np.bitwise_count(bits[others] ^ bits[at]).sum(axis=1, dtype=np.int64) <= np.maximum(most[others], most[at])

    return of


def links(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, bucket: int = BUCKET, stream: int = STREAM, weight: int = WEIGHT) -> tuple[DataFrame, DataFrame]:
    """``src, dst``: classes with similar shingles, which join what the similar pairs join; and ``doc_id, row_key, id`` of each row's class."""
    ship(docs.sparkSession)
    prints = cut(fingerprints(docs, words))
    return similar_classes(docs, prints, signatures, _alike(similarity), words, similarity, bucket, stream, weight), prints.select("doc_id", "row_key", "id")


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, bucket: int = BUCKET, stream: int = STREAM, weight: int = WEIGHT) -> DataFrame:
    """``doc_id, row_key, keep_id, keep_key``: each row that has an id, and the row of its group with the smallest id and text hash."""
    found, rows = links(docs, words, similarity, bucket, stream, weight)
    firsts = rows.groupBy("id").agg(F.min(F.struct("doc_id", "row_key")).alias("first"))
    parts = connected_components(found).select(F.col("node").alias("id"), "component")
    named = cut(firsts.join(parts, "id", "left").withColumn("component", F.coalesce("component", "id")))
    keep = named.groupBy("component").agg(F.min("first").alias("keep"), F.count("*").alias("size"))
    named = hot_join(named, keep, ["component"], "size", named.count()).select("id", "keep")
    sizes = rows.groupBy("id").agg(F.count("*").alias("size")).join(named, "id")
    return hot_join(rows, sizes, ["id"], "size", rows.count()).select("doc_id", "row_key", F.col("keep.doc_id").alias("keep_id"), F.col("keep.row_key").alias("keep_key"))


def deduplicate(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, bucket: int = BUCKET, stream: int = STREAM, weight: int = WEIGHT) -> DataFrame:
    """One document of each group of similar ones stays: the one with the smallest id (and rows that repeat it)."""
    groups = near_duplicates(docs, words, similarity, bucket, stream, weight)
    gone = groups.where("doc_id <> keep_id OR row_key <> keep_key").select(F.col("doc_id").alias("__gone"), F.col("row_key").alias("__key")).distinct()
    on = (docs["doc_id"].cast("long") == F.col("__gone")) & (F.xxhash64(docs["text"]) == F.col("__key"))
    return docs.join(gone, on, "left_anti")
