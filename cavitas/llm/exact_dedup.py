"""Exact dedup with a heavy-hitter split.

Texts are equal when identical after lower-casing A-Z. Of equal texts the row
with the largest ``doc_id`` stays.

Defined results: a null text counts as empty; a null ``doc_id`` is below every
other one, and stays only among equals that all have none; repeated rows (the
same id and an equal text) are all marked as the row that stays, and
``deduplicate`` keeps them all; an empty table gives no rows; other columns
are never read by ``mark_duplicates`` and pass through ``deduplicate``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cavitas.llm.common import documents, map_batches, texts_of
from cavitas.session import cut

#: Counters of a Misra-Gries summary: at most so many digests are broadcast.
COUNTERS = 1000


def _digester():
    def step(batch: pa.RecordBatch):
        digests = [hashlib.sha256(x.lower()).digest() for x in texts_of(batch["text"])]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["row_key"], pa.array(digests, pa.binary())], ["doc_id", "row_key", "digest"])

    return step


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, row_key, digest``: SHA-256 of the text with A-Z lower-cased (``bytes.lower`` is ASCII only).

    ``row_key`` hashes the text as it is; with ``doc_id`` it leads back to the row.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row_key"), "text")
    return map_batches(rows, _digester, "doc_id long, row_key long, digest binary")


def _summarise(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for batch in batches:
            for item in batch["digest"].to_pylist():
                if item in held:
                    held[item] += 1
                elif len(held) < counters:
                    held[item] = 1
                else:
                    held = {k: v - 1 for k, v in held.items() if v > 1}
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["digest", "seen"])

    return run


def heavy_hitters(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """At most ``counters + 1`` digests, with all that make up over ``2 / counters`` of the rows.

    A partition's summary undercounts a digest by at most its rows divided by
    ``counters + 1``, so the summed summaries undercount by at most that share of all
    rows. Digests whose summed count reaches that share are returned.
    """
    partial = rows.mapInArrow(_summarise(counters), "digest binary, seen long")
    share = F.lit(1.0) * rows.count() / (counters + 1)
    return partial.groupBy("digest").agg(F.sum("seen").alias("seen")).where((F.col("seen") >= share) & (F.col("seen") > 1)).select("digest")


def mark_duplicates(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One row a document: ``doc_id, row_key, keep_id, group_size, kept, digest``.

    The frequent digests' winners and sizes, verified over all rows with a
    map-side combine, are broadcast (``counters + 1`` rows at most), so the
    largest groups never meet in a task. The rest is grouped by an ordinary
    shuffle; there no group holds over ``2 / counters`` of the rows.
    """
    rows = cut(digests(docs))
    heavy = heavy_hitters(rows, counters)
    winners = cut(
        rows.join(F.broadcast(heavy), "digest")
        .groupBy("digest")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    )
    large = rows.join(F.broadcast(winners), "digest")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    groups = rest.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    small = rest.join(groups.hint("merge"), "digest")
    return large.unionByName(small).select(
        "doc_id", "row_key", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest"
    )


def deduplicate(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """``docs`` without the rows that an equal text with a larger ``doc_id`` replaces."""
    gone = mark_duplicates(docs, counters).where(~F.col("kept")).select(F.col("doc_id").alias("__gone"), F.col("row_key").alias("__key"))
    on = docs["doc_id"].cast("long").eqNullSafe(F.col("__gone")) & (F.xxhash64(docs["text"]) == F.col("__key"))
    return docs.join(gone, on, "left_anti")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_duplicates(documents(spark, sf_dir)).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


OP4_SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256
FROM n JOIN g USING (t)
"""
