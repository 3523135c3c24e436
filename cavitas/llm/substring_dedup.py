"""Substring dedup: words go that a window of ``WINDOW`` words covers which also
starts in a document with a smaller id.

The corpus is its own reference, so broadcast automata of all its shards would have to
be streamed by all documents, work that grows with the square of the corpus.
Instead the passages meet by key, in two rounds that move hashes only:

1. Each window has an anchor, the least-hashed ``GRAM``-word run in it, the same wherever
   the window stands. A document's anchors (a fifth of its words) meet by hash;
   those in two documents or more come back to their documents.
2. Windows on such anchors meet by a 96-bit hash of their words with the ids;
   each comes back, by the first 64 bits, to the documents above the least id that has it.

A task first settles what repeats within its own rows, and sends one entry a hash and
task, so that a passage in a third of all documents is no hot key. Text is shuffled
once, by document, and joined with what came back; adjoining windows become
maximal spans, and all their words go.

Defined results: a null text has no words; rows without an id neither lose words nor
take any from others; of rows with one id none is smaller, so they lose nothing to each
other; repeated rows give repeated rows; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cavitas.llm.common import documents, gram_hashes, mix, slices, texts_of, word_bounds, word_hashes
from cavitas.session import ship

WINDOW = 13
GRAM = 6
#: Words after which a task settles what it holds and sends it on.
FLUSH = 2_000_000

_OTHER = np.uint64(0xA0761D6478BD642F)


class Text:
    """Word hashes, and each window's anchor and hashes."""

    def __init__(self, data: bytes, window: int, gram: int):
        array = np.frombuffer(data, np.uint8)
        self.words = word_hashes(array, *word_bounds(array))
        self.window, self.gram = window, gram

    def __len__(self) -> int:
        return len(self.words)

    def anchors(self) -> np.ndarray:
        if len(self.words) < self.window:
            return np.zeros(0, np.uint64)
        return sliding_window_view(gram_hashes(self.words, self.gram), self.window - self.gram + 1).min(axis=1)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        return gram_hashes(self.words, self.window), gram_hashes(mix(self.words ^ _OTHER), self.window).astype(np.uint32)


def _member(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in the sorted ``table``."""
    if not len(table):
        return np.zeros(len(x), bool)
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Number of the run of equal keys that each (sorted) row is in."""
    new = np.zeros(len(keys[0]), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


_SENT = pa.schema([("bucket", pa.int32()), ("dk", pa.int64()), ("hashes", pa.binary()), ("more", pa.binary()), ("docs", pa.binary()), ("keys", pa.binary()), ("runs", pa.binary())])
_SENT_SQL = "bucket int, dk long, hashes binary, more binary, docs binary, keys binary, runs binary"
#: What goes back: for each slot of documents, their keys, how many hashes and runs each has, and these.
_BACK = pa.schema([("slot", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("hashes", pa.binary()), ("runs", pa.binary())])
_BACK_SQL = "slot int, keys binary, counts binary, hashes binary, runs binary"
_FOUND = pa.schema([("dk", pa.int64()), ("hashes", pa.binary()), ("runs", pa.binary())])
_FOUND_SQL = "dk long, hashes binary, runs binary"


def _by_bucket(buckets: int, h: np.ndarray, *columns: np.ndarray):
    """(bucket, h, columns) of each bucket of the hashes, ordered by the last column within."""
    b = (h % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((columns[-1], b))
    b = b[order]
    edges = np.append(np.flatnonzero(np.diff(b, prepend=-1)), len(b))
    for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        rows = order[x:y]
        yield int(b[x]), h[rows], *(c[rows] for c in columns)


def _to_docs(dk: np.ndarray, h: np.ndarray):
    """(dk, hashes) of each document."""
    order = np.argsort(dk, kind="stable")
    dk, h = dk[order], h[order]
    edges = np.append(np.flatnonzero(np.diff(dk, prepend=dk[:1] - 1)), len(dk)) if len(dk) else np.zeros(1, np.int64)
    for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(dk[x]), h[x:y].tobytes()


def _batch(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _packed(slots: int, found: list[tuple[int, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
    """(dk, hashes, runs) of documents in one row a slot."""
    by: dict[int, list] = {}
    for row in found:
        by.setdefault(row[0] % slots, []).append(row)
    rows = []
    for slot, part in by.items():
        counts = np.array([[len(h) // 8, len(r) // 8] for _, h, r in part], np.int32)
        rows.append({"slot": slot, "keys": np.array([k for k, *_ in part], np.int64).tobytes(), "counts": counts.tobytes(), "hashes": b"".join(h for _, h, _ in part), "runs": b"".join(r for *_, r in part)})
    if rows:
        yield _batch(_BACK, rows)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a document from all the rows of its slot."""
    held: dict[int, list[list[bytes]]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            h = r = 0
            for k, (n, m) in zip(np.frombuffer(row["keys"], np.int64).tolist(), np.frombuffer(row["counts"], np.int32).reshape(-1, 2).tolist(), strict=True):
                own = held.setdefault(k, [[], []])
                own[0].append(row["hashes"][h : h + 8 * n])
                own[1].append(row["runs"][r : r + 8 * m])
                h, r = h + 8 * n, r + 8 * m
    rows = [{"dk": k, "hashes": b"".join(h), "runs": b"".join(r)} for k, (h, r) in held.items()]
    for at in range(0, len(rows), 10_000):
        yield _batch(_FOUND, rows[at : at + 10_000])


def _send_anchors(buckets: int, window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: list[np.ndarray] = []
        keys: list[np.ndarray] = []
        size = 0

        def settle() -> Iterator[pa.RecordBatch]:
            h, dk = np.concatenate(hashes), np.concatenate(keys)
            order = np.lexsort((dk, h))
            h, dk = h[order], dk[order]
            group = _groups(h)
            first = np.append(0, np.flatnonzero(np.diff(group)) + 1)
            last = np.append(first[1:], len(h)) - 1
            shared = (dk[first] != dk[last])[group]
            rows = [{"bucket": k % buckets, "dk": k, "hashes": x} for k, x in _to_docs(dk[shared], h[shared])]
            mark = np.unique(h[shared])
            h = np.concatenate([h[~shared], mark])
            dk = np.concatenate([dk[~shared], np.zeros(len(mark), np.int64)])
            rows += [{"bucket": b, "hashes": x.tobytes(), "keys": k.tobytes()} for b, x, k in _by_bucket(buckets, h, dk)]
            yield _batch(_SENT, rows)

        for batch in batches:
            for part in slices(batch):
                for k, data in zip(part["dk"].to_pylist(), texts_of(part["text"]), strict=True):
                    text = Text(data, window, gram)
                    a = np.unique(text.anchors())
                    if len(a):
                        hashes.append(a)
                        keys.append(np.full(len(a), k, np.int64))
                        size += len(text)
                    if size >= FLUSH:
                        yield from settle()
                        hashes, keys, size = [], [], 0
        if hashes:
            yield from settle()

    return run


def _match_anchors(slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _packed(slots, _matched_anchors(batches))

    return run


def _matched_anchors(batches: Iterator[pa.RecordBatch]) -> list[tuple[int, bytes, bytes]]:
    """Anchors of a partition's buckets that two documents have, back to each of these."""
    held_h, held_k, out = [], [], []
    for batch in batches:
        for row in batch.to_pylist():
            if row["dk"] is not None:
                out.append((row["dk"], row["hashes"], b""))
            else:
                held_h.append(np.frombuffer(row["hashes"], np.uint64))
                held_k.append(np.frombuffer(row["keys"], np.int64))
    if held_h:
        h, dk = np.concatenate(held_h), np.concatenate(held_k)
        order = np.argsort(h, kind="stable")
        h, dk = h[order], dk[order]
        group = _groups(h)
        n = group[-1] + 1
        marked = np.zeros(n, bool)
        marked[group[dk == 0]] = True
        low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
        np.minimum.at(low, group, dk)
        np.maximum.at(high, group, dk)
        back = (marked | (low != high))[group] & (dk != 0)
        out += [(k, x, b"") for k, x in _to_docs(dk[back], h[back])]
    return out


def _runs(at: np.ndarray) -> bytes:
    """(first, last) of the runs of consecutive positions, as 32-bit integers."""
    if not len(at):
        return b""
    cut = np.flatnonzero(np.diff(at) != 1)
    return np.stack([at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)]], axis=1).astype(np.int32).tobytes()


def _send_windows(buckets: int, window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def settle() -> Iterator[pa.RecordBatch]:
            h, more, at, doc, dk = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((doc, more, h))
            h, more, at, doc, dk = h[order], more[order], at[order], doc[order], dk[order]
            group = _groups(h, more)
            first = np.append(0, np.flatnonzero(np.diff(group)) + 1)
            lost = doc > doc[first][group]
            order = np.lexsort((at[lost], dk[lost]))
            own, where = dk[lost][order], at[lost][order]
            edges = np.append(np.flatnonzero(np.diff(own, prepend=own[:1] - 1)), len(own)) if len(own) else np.zeros(1, np.int64)
            rows = [{"bucket": int(own[x]) % buckets, "dk": int(own[x]), "runs": _runs(where[x:y])} for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            # of a document's equal windows one is sent
            new = ~lost
            new[1:] &= (group[1:] != group[:-1]) | (dk[1:] != dk[:-1])
            rows += [{"bucket": b, "hashes": x.tobytes(), "more": m.tobytes(), "docs": d.tobytes(), "keys": k.tobytes()} for b, x, m, d, k in _by_bucket(buckets, h[new], more[new], doc[new], dk[new])]
            yield _batch(_SENT, rows)

        for batch in batches:
            for part in slices(batch):
                for i, k, data, anchors in zip(part["doc_id"].to_pylist(), part["dk"].to_pylist(), texts_of(part["text"]), part["anchors"].to_pylist(), strict=True):
                    if i is None:
                        continue
                    text = Text(data, window, gram)
                    at = np.flatnonzero(_member(text.anchors(), np.sort(np.frombuffer(anchors, np.uint64))))
                    if len(at):
                        h, more = text.windows()
                        held.append((h[at], more[at], at.astype(np.int32), np.full(len(at), i, np.int64), np.full(len(at), k, np.int64)))
                        size += len(at)
                    if size >= FLUSH:
                        yield from settle()
                        held, size = [], 0
        if held:
            yield from settle()

    return run


def _match_windows(slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _packed(slots, _matched_windows(batches))

    return run


def _matched_windows(batches: Iterator[pa.RecordBatch]) -> list[tuple[int, bytes, bytes]]:
    """Windows of a partition's buckets, back to the documents above the least that has them."""
    held, out = [], []
    for batch in batches:
        for row in batch.to_pylist():
            if row["dk"] is not None:
                out.append((row["dk"], b"", row["runs"]))
            else:
                held.append((np.frombuffer(row["hashes"], np.uint64), np.frombuffer(row["more"], np.uint32), np.frombuffer(row["docs"], np.int64), np.frombuffer(row["keys"], np.int64)))
    if held:
        h, more, doc, dk = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((doc, more, h))
        h, more, doc, dk = h[order], more[order], doc[order], dk[order]
        group = _groups(h, more)
        first = np.append(0, np.flatnonzero(np.diff(group)) + 1)
        lost = doc > doc[first][group]
        out += [(k, x, b"") for k, x in _to_docs(dk[lost], h[lost])]
    return out


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])


def covered(n: int, window: int, starts: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words the windows cover that start at ``starts`` or within (first, last) ``runs``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + window, n), -1)
    if len(runs):
        np.add.at(edge, runs[:, 0], 1)
        np.add.at(edge, np.minimum(runs[:, 1] + window, n), -1)
    return np.cumsum(edge[:n]) > 0


def _remove(window: int, gram: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = []
                for i, data, hashes, runs in zip(part["doc_id"].to_pylist(), texts_of(part["text"]), part["hashes"].to_pylist(), part["runs"].to_pylist(), strict=True):
                    words, removed = data.split(), 0
                    if i is not None and (hashes or runs):
                        text = Text(data, window, gram)
                        starts = np.flatnonzero(_member(text.windows()[0], np.sort(np.frombuffer(hashes or b"", np.uint64))))
                        gone = covered(len(words), window, starts, np.frombuffer(runs or b"", np.int32).reshape(-1, 2))
                        removed = int(gone.sum())
                        kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                    else:
                        kept = words
                    text_kept = b" ".join(kept)
                    rows.append({"doc_id": i, "n_words": len(words), "n_removed": removed, "kept": text_kept if keep_text else hashlib.sha256(text_kept).digest()})
                yield _batch(_OUT, rows)

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, keep_text: bool = True) -> DataFrame:
    """``doc_id, n_words, n_removed, kept``: the words that stay, joined by one space (or only their SHA-256)."""
    spark = docs.sparkSession
    ship(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("dk", F.xxhash64("doc_id", "text"))
    named = rows.where("doc_id IS NOT NULL")

    def back(sent: DataFrame, match) -> DataFrame:
        """To the buckets and back: what matched, one row a document."""
        matched = sent.repartition(n, "bucket").mapInArrow(match(n), _BACK_SQL)
        return matched.repartition(n, "slot").mapInArrow(_unpacked, _FOUND_SQL).hint("merge")

    anchors = back(named.select("dk", "text").mapInArrow(_send_anchors(n, window, gram), _SENT_SQL), _match_anchors)
    dealt = rows.repartition(n, "dk")  # both joins read this one exchange
    found = dealt.join(anchors.select("dk", F.col("hashes").alias("anchors")), "dk").select("doc_id", "dk", "text", "anchors")
    windows = back(found.mapInArrow(_send_windows(n, window, gram), _SENT_SQL), _match_windows)
    joined = dealt.join(windows, "dk", "left")
    kind = "string" if keep_text else "binary"
    out = joined.select("doc_id", "text", "hashes", "runs").mapInArrow(_remove(window, gram, keep_text), "doc_id long, n_words long, n_removed long, kept binary")
    return out.withColumn("kept", F.col("kept").cast(kind))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir), keep_text=False)
    return out.select("doc_id", "n_words", "n_removed", F.lower(F.hex("kept")).alias("kept_sha256"))


#: The contract in SQL: each window's words as one text, the least document that has it, and the words that such windows cover.
OP10_SQL = """WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS q, len(ws) AS n FROM w),
k AS (SELECT doc_id, q, n, concat_ws(' ', word, """ + ", ".join(f"lead(word, {k}) OVER o" for k in range(1, WINDOW)) + f""") AS g FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY q)),
f AS (SELECT doc_id, q, g FROM k WHERE q + {WINDOW - 1} <= n),
m AS (SELECT g, min(doc_id) AS least FROM f GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, q + s AS q FROM f JOIN m USING (g), (SELECT unnest(range({WINDOW})) AS s) WHERE doc_id > least),
r AS (SELECT t.doc_id, count(gone.q) AS n_removed, string_agg(CASE WHEN gone.q IS NULL THEN word END, ' ' ORDER BY t.q) AS kept FROM t LEFT JOIN gone ON gone.doc_id = t.doc_id AND gone.q = t.q GROUP BY t.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN r USING (doc_id)"""
