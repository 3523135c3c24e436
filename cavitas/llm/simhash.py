"""SimHash near-dedup with deletion-variant signatures.

A-Z are lower-cased, words are runs outside space and U+0009 to U+000D, and a
text's shingles are its runs of ``words`` words, repeats included, joined by one
space (fewer words: the whole sequence). A bit of the 64-bit fingerprint is 1
if it is set in over half of the shingles' XXH64 (seed 42). Fingerprints link
at ``DISTANCE`` or fewer differing bits; documents with one fingerprint are
one class.

Defined results: a null, empty or blank text has fingerprint zero, which links
like any other; ``component_id`` is the smallest id reachable, null ids left out
(null if there is no other); repeated rows give repeated rows; an empty table
gives no rows; other columns are not read, and pass through ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cavitas.llm.common import SPACE, documents, map_batches, texts_of
from cavitas.operators.graph import connected_components
from cavitas.session import cut, ship

DISTANCE = 2
#: Up to so many fingerprints that share a signature are compared in a task;
#: larger buckets take the way of `wildcard_links`, which compares none.
BUCKET = 512


def fingerprint(text: bytes, words: int = 3) -> int:
    found = text.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        return xxhash.xxh64_intdigest(joined, 42)
    space = np.flatnonzero(SPACE[np.frombuffer(joined, np.uint8)])
    starts = np.concatenate([[0], space + 1])[: len(found) - words + 1].tolist()
    ends = np.concatenate([space, [len(joined)]])[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(h), bitorder="little")
    return int(bits.view(np.uint64)[0])


def _fingerprinter(words: int):
    def make():
        def step(batch: pa.RecordBatch):
            found = np.array([fingerprint(x, words) for x in texts_of(batch["text"])], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["row_key"], pa.array(found)], ["doc_id", "row_key", "fp"])

        return step

    return make


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id, row_key, fp``; ``row_key`` hashes the text as it is."""
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row_key"), "text")
    return map_batches(rows, _fingerprinter(words), "doc_id long, row_key long, fp long")


def signatures(prints: DataFrame) -> DataFrame:
    """``key, fp``: 64 rows a fingerprint, one for each half and each bit of it deleted.

    Of ``DISTANCE`` = 2 differing bits at most one lies in one of the halves, so
    that two linked fingerprints agree in a half but for one deleted bit.
    """
    low = F.col("fp").bitwiseAND(0xFFFFFFFF)
    high = F.shiftrightunsigned("fp", 32)
    bit = F.expr("sequence(0, 31)")

    def half(value, number: int):
        mask = lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b)
        head = lambda b: F.call_function("shiftleft", (b + 32 * number).cast("long"), F.lit(32))
        return F.transform(bit, lambda b: value.bitwiseAND(F.bitwise_not(mask(b))).bitwiseOR(head(b)))

    return prints.select("fp", F.explode(F.concat(half(low, 0), half(high, 1))).alias("key"))


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= DISTANCE


def spanning_links(group: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what the near pairs of ``group`` join: (member, earlier member)."""
    left = np.unique(group)
    links = []
    while len(left):
        reached, todo = left[:1], left[:1]
        left = left[1:]
        while len(todo) and len(left):
            hit = near(todo[0], left)
            new = left[hit]
            links += [(int(x), int(todo[0])) for x in new]
            left = left[~hit]
            todo = np.concatenate([todo[1:], new])
        del reached
    return links


def _bucket_links(bucket: int):
    """Over batches sorted by key: links of small buckets, and (fp, null) for members of larger ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size = None, [], 0

        def flush(a: list, b: list) -> None:
            if 1 < size <= bucket:
                for x, y in spanning_links(np.concatenate(held)):
                    a.append(x)
                    b.append(y)

        for batch in batches:
            a: list = []
            b: list = []
            keys = batch["key"].to_numpy(zero_copy_only=False)
            fps = batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
            edges = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]) if len(keys) else [0]
            alone = np.diff(edges) == 1
            for i in np.flatnonzero(~alone | (np.arange(len(alone)) == 0) | (np.arange(len(alone)) == len(alone) - 1)):
                part = fps[edges[i] : edges[i + 1]]
                if keys[edges[i]] != key:
                    flush(a, b)
                    key, held, size = keys[edges[i]], [], 0
                was, size = size, size + len(part)
                if size <= bucket:
                    held.append(part)
                else:
                    out = np.concatenate([*held, part]) if was <= bucket else part
                    held = []
                    a += out.tolist()
                    b += [None] * len(out)
            if a:
                yield _links(a, b)
        a, b = [], []
        flush(a, b)
        if a:
            yield _links(a, b)

    return run


def _links(a: list, b: list) -> pa.RecordBatch:
    signed = lambda x: None if x is None else x - (1 << 64) if x >> 63 else x
    return pa.RecordBatch.from_arrays([pa.array(map(signed, a), pa.int64()), pa.array(map(signed, b), pa.int64())], ["src", "dst"])


def wildcard_links(prints: DataFrame) -> DataFrame:
    """Links of the fingerprints of large buckets, without comparing pairs.

    Each fingerprint meets the least fingerprint that equals it but for two
    deleted bits: any two that meet differ in those bits only. 2,016 rows a
    fingerprint, combined on the map side; `links` sends only members of
    buckets over ``BUCKET`` here.
    """
    one = F.lit(1).cast("long")
    shift = lambda b: F.call_function("shiftleft", one, b)
    pairs = F.flatten(F.transform(F.expr("sequence(1, 63)"), lambda i: F.transform(F.sequence(F.lit(0), i - 1), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    rows = prints.select("fp", F.explode(pairs).alias("d")).select(
        "fp", (F.col("d.i") * 64 + F.col("d.j")).alias("deleted"), F.col("fp").bitwiseAND(F.bitwise_not(shift(F.col("d.i")).bitwiseOR(shift(F.col("d.j"))))).alias("rest")
    )
    least = rows.groupBy("deleted", "rest").agg(F.min("fp").alias("dst"), F.max("fp").alias("top")).where("dst <> top").drop("top")
    return rows.join(least, ["deleted", "rest"]).where("fp <> dst").select(F.col("fp").alias("src"), "dst").distinct()


def links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``src, dst``: verified links that join exactly the distinct ``fp`` which near pairs join."""
    ship(prints.sparkSession)
    keyed = signatures(prints).repartition("key").sortWithinPartitions("key")
    found = cut(keyed.mapInArrow(_bucket_links(bucket), "src long, dst long").distinct())
    crowded = found.where("dst IS NULL").select(F.col("src").alias("fp"))
    small = found.where("dst IS NOT NULL")
    if crowded.isEmpty():
        return small
    return small.unionByName(wildcard_links(crowded.repartition("fp")))


def near_duplicates(docs: DataFrame, words: int = 3, bucket: int = BUCKET) -> DataFrame:
    """One row a document: ``doc_id, row_key, fp, component_id``."""
    rows = cut(fingerprints(docs, words))
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    parts = connected_components(links(classes.select("fp"), bucket), nodes=classes.select(F.col("fp").alias("node")))
    named = classes.join(parts.withColumnRenamed("node", "fp"), "fp")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print = named.join(least, "component").select("fp", "component_id")
    return rows.join(by_print.hint("merge"), "fp").select("doc_id", "row_key", "fp", "component_id")


def deduplicate(docs: DataFrame, words: int = 3, bucket: int = BUCKET) -> DataFrame:
    """One document of each component stays: the one with the smallest id (and rows that repeat it).

    A component whose ids are all null stays whole, as nothing tells its rows apart.
    """
    gone = near_duplicates(docs, words, bucket).where(~F.col("doc_id").eqNullSafe(F.col("component_id")))
    gone = gone.select(F.col("doc_id").alias("__gone"), F.col("row_key").alias("__key"))
    on = docs["doc_id"].cast("long").eqNullSafe(F.col("__gone")) & (F.xxhash64(docs["text"]) == F.col("__key"))
    return docs.join(gone, on, "left_anti")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
