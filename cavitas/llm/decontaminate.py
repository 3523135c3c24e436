"""Benchmark decontamination by the q-gram lemma.

Texts are lower-cased, and everything but letters and digits (and characters over
U+007F) becomes one space. An item of m bytes occurs in a document if a part of the
document is within k = ``RATE`` x m edits of it. Such a part shares at least
m - q + 1 - kq of the item's q-grams (q = 8), within k + 1 neighbouring
diagonals. Shared q-grams are therefore counted in diagonal bands of twice that
width, each overlapping the next by half; bands that reach the bound are verified
by a banded alignment with free ends in the document. A q-gram that an item has over ``OFTEN`` times
counts in a band at most as often as the item has it, and at most as often as the text has it beside the
band: the lemma holds for that too, and no list of its pairs is needed. Long texts are taken in windows that overlap
by the longest occurrence, so that memory does not grow with a text.

The benchmark is the stated query set: it is taken in blocks of about
``BLOCK`` characters, each broadcast, and ``PASS`` blocks are held against all
documents in one pass without a shuffle (an index has about 40 bytes a character).

Defined results: null texts count as empty; items under q bytes, once
normalised, never occur; for short items k is lowered until the bound is 1; a repeated item
reports each of its ids, a null id none; repeated rows give repeated rows; an
empty benchmark leaves all documents clean; an empty table gives no rows; other
columns are not read, and pass through ``decontaminate``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cavitas.llm.common import documents, map_batches
from cavitas.session import table

Q = 8
RATE = 0.1
BLOCK, PASS = 1_000_000, 4
#: Places of a q-gram in an item up to which they are paired one by one.
OFTEN = 4
#: Bytes of a text that are looked at together, if no item is longer.
SPAN = 1 << 16
#: Pairs of places that are listed at a time.
PAIRS = 1 << 20
_FILTER_BITS = 22
_KEEP = bytes(b if 97 <= b <= 122 or 48 <= b <= 57 or b > 127 else 32 for b in range(256))


def normalised(text: str | None) -> bytes:
    return b" ".join((text or "").lower().encode("utf-8", "replace").translate(_KEEP).split())


def grams(data: bytes) -> np.ndarray:
    """All 8-grams as 64-bit integers."""
    x = np.frombuffer(data, np.uint8).astype(np.uint64)
    if len(x) < Q:
        return x[:0]
    x = x[:-1] | x[1:] << np.uint64(8)
    x = x[:-2] | x[2:] << np.uint64(16)
    return x[:-4] | x[4:] << np.uint64(32)


def edit_budget(m: int, rate: float = RATE) -> int:
    return max(0, min(int(m * rate), (m - Q) // Q))


def _slot(g: np.ndarray) -> np.ndarray:
    return (g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _FILTER_BITS)


def banded_distance(item: np.ndarray, region: np.ndarray, k: int) -> int:
    """Least edits from ``item`` to any part of ``region``, or k + 1 if more than k."""
    m = len(item)
    width = len(region) - m + 1 + 2 * k  # diagonals -k to len(region) - m + k
    if width <= 0:
        return k + 1
    padded = np.full(len(region) + 2 * k, 256, np.int16)  # outside the region every byte of the item costs an edit
    padded[k : k + len(region)] = region
    step = np.arange(width, dtype=np.int32)
    row = np.zeros(width, np.int32)
    for i in range(m):
        best = row + (padded[i : i + width] != item[i])
        best[:-1] = np.minimum(best[:-1], row[1:] + 1)
        row = np.minimum.accumulate(best - step) + step
        if row.min() > k:
            return k + 1
    return int(row.min())


class Index:
    """The q-grams of a block of items."""

    def __init__(self, ids: list[int | None], texts: list[str | None], rate: float = RATE):
        found = [(i, data) for i, t in zip(ids, texts, strict=True) if len(data := normalised(t)) >= Q]
        self.ids = [i for i, _ in found]
        self.items = [data for _, data in found]
        m = np.array([len(x) for x in self.items], np.int64)
        self.k = np.array([edit_budget(x, rate) for x in m.tolist()], np.int64)
        self.bound = m - Q + 1 - self.k * Q
        all_grams = [grams(x) for x in self.items]
        lengths = [len(g) for g in all_grams]
        g = np.concatenate(all_grams) if all_grams else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        at = np.concatenate([np.arange(n) for n in lengths]) if lengths else np.zeros(0, np.int64)
        self.m = m
        self.least = int(self.bound.min()) if len(m) else 0
        self.reach = int((m + 2 * self.k).max()) if len(m) else 0
        order = np.lexsort((at, owner, g))
        g, owner, at = g[order], owner[order], at[order]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[_slot(g)] = True
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
        times = np.diff(np.append(np.flatnonzero(new), len(g)))
        often = np.repeat(times > OFTEN, times)
        #: grams that an item has often: (gram, item, times), by gram
        self.often = (g[often & new], owner[often & new], times[times > OFTEN])
        self.owner, self.at = owner[~often], at[~often]
        self.grams, self.first = np.unique(g[~often], return_index=True)
        self.size = np.diff(np.append(self.first, len(self.owner)))

    def candidates(self, data: bytes) -> Iterator[tuple[int, int, int]]:
        """(item, first diagonal, width) of the bands with enough shared q-grams, by item."""
        g = grams(data)
        j = np.flatnonzero(self.filter[_slot(g)]) if self.items else g[:0]
        if len(j) < self.least or not len(j):
            return
        span = 2 * len(data) + 1_000_000
        low = -len(data) - 2  # below any band
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for key, count in self._shares(g[j], j, span, low):
            held.append((key, count))
            if sum(len(k) for k, _ in held) > 4 * PAIRS:
                held = [_added(held)]
        if not held:
            return
        keys, counts = _added(held)
        for x in keys[counts >= self.bound[keys // span]].tolist():
            i, b = divmod(x, span)
            yield i, (b + low) * (int(self.k[i]) + 1), 2 * (int(self.k[i]) + 1)

    def _shares(self, g: np.ndarray, j: np.ndarray, span: int, low: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(item and band, shared q-grams) of q-grams ``g`` at places ``j``, in parts."""
        row, hit = _rows(self.grams, g)
        places, row = j[hit], row[hit]
        n = self.size[row]
        ends = np.cumsum(n)
        at = 0
        while at < len(row):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
            m, r = n[at:to], row[at:to]
            which = np.repeat(self.first[r] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
            item = self.owner[which]
            band = np.floor_divide(np.repeat(places[at:to], m) - self.at[which], self.k[item] + 1)
            yield np.unique(np.concatenate([item * span + (band - low), item * span + (band - 1 - low)]), return_counts=True)
            at = to
        often, items, times = self.often
        row, hit = _rows(often, g)
        if not hit.any():
            return
        order = np.lexsort((j[hit], g[hit]))
        grams_of, places = g[hit][order], j[hit][order]
        starts = np.flatnonzero(np.diff(grams_of, prepend=grams_of[:1] ^ np.uint64(1)))
        for a, b in zip(starts.tolist(), np.append(starts[1:], len(places)).tolist(), strict=True):
            own, gram = places[a:b], grams_of[a]
            for i in range(int(np.searchsorted(often, gram)), int(np.searchsorted(often, gram, side="right"))):
                item, step, m = int(items[i]), int(self.k[items[i]]) + 1, int(self.m[items[i]])
                first, last = (int(own[0]) - m) // step - 1, int(own[-1]) // step + 1
                band = np.arange(first, last + 1)
                beside = np.searchsorted(own, (band + 2) * step + m) - np.searchsorted(own, band * step)
                full = np.flatnonzero(beside)
                yield item * span + (band[full] - low), np.minimum(beside[full], times[i])

    def found(self, text: str | None) -> list[int]:
        """Numbers of the items that occur in a text."""
        data = normalised(text)
        if len(data) < Q:
            return []
        out: set[int] = set()
        array = None
        size = max(SPAN, 4 * self.reach)
        for offset in range(0, max(1, len(data) - self.reach), size - self.reach):
            for i, diagonal, width in self.candidates(data[offset : offset + size]):
                if i in out:
                    continue
                item, k = self.items[i], int(self.k[i])
                begin, end = max(0, offset + diagonal - k), offset + diagonal + width + len(item) + k
                if data.find(item, begin, end) < 0:
                    if array is None:
                        array = np.frombuffer(data, np.uint8).astype(np.int16)
                    if banded_distance(np.frombuffer(item, np.uint8).astype(np.int16), array[begin:end], k) > k:
                        continue
                out.add(i)
        return sorted(out)


def _rows(table: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of ``g`` is in a sorted table, and which are there."""
    if not len(table):
        return np.zeros(len(g), np.int64), np.zeros(len(g), bool)
    row = np.minimum(np.searchsorted(table, g), len(table) - 1)
    return row, table[row] == g


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The counts of each key of all parts."""
    keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(where, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64)


def blocks(benchmark: DataFrame, block: int = BLOCK) -> Iterator[DataFrame]:
    """The benchmark (item_id, text) in parts of about ``block`` characters."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // block)
    for b in range(n):
        yield items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)


def _index(part: DataFrame, rate: float) -> Index:
    rows = sorted(part.collect(), key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"] or ""))
    return Index([r["item_id"] for r in rows], [r["text"] for r in rows], rate)


def _passes(docs: DataFrame, benchmark: DataFrame, rate: float, block: int) -> Iterator:
    """Broadcast lists of at most ``PASS`` indexes."""
    held = []
    for part in blocks(benchmark, block):
        held.append(_index(part, rate))
        if len(held) == PASS:
            yield docs.sparkSession.sparkContext.broadcast(held)
            held = []
    if held:
        yield docs.sparkSession.sparkContext.broadcast(held)


def scan(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_found, items`` of each document: occurring items, and their ids in order."""
    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.lit(0).cast("long").alias("n_found"), F.array().cast("array<long>").alias("items"))
    for indexes in _passes(docs, benchmark, rate, block):

        def make(indexes=indexes):
            def step(batch: pa.RecordBatch):
                found = [[own.ids[i] for own in indexes.value for i in own.found(t)] for t in batch["text"].to_pylist()]
                n = pa.array([a + len(f) for a, f in zip(batch["n_found"].to_pylist(), found, strict=True)], pa.int64())
                ids = [[*a, *(i for i in f if i is not None)] for a, f in zip(batch["items"].to_pylist(), found, strict=True)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text"], n, pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "text", "n_found", "items"])

            return step

        out = map_batches(out, make, "doc_id long, text string, n_found long, items array<long>")
    return out.select("doc_id", "n_found", F.array_sort("items").alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block: int = BLOCK) -> DataFrame:
    """``docs`` without the rows in which an item occurs."""
    for indexes in _passes(docs, benchmark, rate, block):

        def make(indexes=indexes):
            def step(batch: pa.RecordBatch):
                yield batch.filter(pa.array([not any(own.found(t) for own in indexes.value) for t in batch["text"].to_pylist()], pa.bool_()))

            return step

        docs = map_batches(docs, make, docs.schema)
    return docs


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.col("n_found") > 0).alias("contaminated"), "n_found", F.array_join("items", ",").alias("items"))
