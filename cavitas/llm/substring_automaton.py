"""Substring dedup by broadcast suffix automata of reference shards.

The reference is cut into shards of about ``SHARD_WORDS`` words; a task builds the generalised
suffix automaton of each, and they are broadcast one after the other. All documents stream through
each for matching statistics - at each word the longest factor of the shard that ends there, and
the least document that has its last ``window`` words - and maximal spans of at least ``window`` words that a document with a smaller
id has go.

With a reference of bounded size this is one pass over the documents a shard. With the corpus as its own
reference the passes grow with the corpus; `substring_dedup` gives the same result there without
that, and the tests hold the two against each other.

Defined results: as in `substring_dedup`. A shard holds whole documents, so that one very long
document makes a longer shard.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cavitas.llm.common import map_batches, texts_of
from cavitas.llm.substring_dedup import WINDOW, _runs, covered
from cavitas.session import cut, ship

#: Words of a shard; its automaton has about 200 bytes a word when it is broadcast.
SHARD_WORDS = 250_000


class SuffixAutomaton:
    """Over words as numbers; ``least`` is the least document in which each state's factors end."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], [np.iinfo(np.int64).max]

    def add(self, doc: int, words: list[bytes]) -> None:
        last = 0
        for word in words:
            last = self._extend(last, self.number.setdefault(word, len(self.number)))
            self.least[last] = min(self.least[last], doc)

    def _extend(self, last: int, c: int) -> int:
        nexts, link, length = self.next, self.link, self.length
        q = nexts[last].get(c)
        if q is not None:
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        new, p = len(nexts), last
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        self.least.append(self.least[0])
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.least.append(self.least[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def close(self) -> None:
        """Hands the least documents up the suffix links."""
        for state in np.argsort(self.length, kind="stable")[:0:-1].tolist():
            up = self.link[state]
            self.least[up] = min(self.least[up], self.least[state])

    def starts(self, doc: int, words: list[bytes], window: int) -> np.ndarray:
        """Starts of the windows of a text that a smaller document has."""
        nexts, link, lengths, least = self.next, self.link, self.length, self.least
        state = length = 0
        out = []
        for at, c in enumerate(map(self.number.get, words)):
            while state and c not in nexts[state]:
                state = link[state]
                length = lengths[state]
            to = nexts[state].get(c)
            if to is None:
                continue
            state, length = to, length + 1
            if length >= window:
                while lengths[link[state]] >= window:  # the state of the last ``window`` words
                    state = link[state]
                    length = lengths[state]
                if least[state] < doc:
                    out.append(at - window + 1)
        return np.array(out, np.int64)


def build(reference: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``shard, payload``: an automaton of each shard of the reference (doc_id, text), dealt by hash."""
    ship(reference.sparkSession)
    rows = reference.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.size(F.split("text", r"[\x20\x09-\x0D]+")))).first()[0] or 0
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(-(-total // shard_words) or 1)).cast("int"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        automaton = SuffixAutomaton()
        for doc, text in part[["doc_id", "text"]].sort_values(["doc_id", "text"]).itertuples(index=False):
            automaton.add(doc, text.encode("utf-8", "replace").split())
        automaton.close()
        return pd.DataFrame({"shard": [int(part["shard"].iloc[0])], "payload": [pickle.dumps(automaton, protocol=5)]})

    return cut(rows.groupBy("shard").applyInPandas(run, "shard int, payload binary"))


def matched(docs: DataFrame, shards: DataFrame, window: int = WINDOW) -> Iterator[DataFrame]:
    """``dk, runs`` of each shard: runs of the starts of a document's windows that a smaller document has."""
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("dk"), "text")
    for (k,) in shards.select("shard").orderBy("shard").collect():  # as many as there are passes
        shared = docs.sparkSession.sparkContext.broadcast(shards.where(F.col("shard") == k).first()["payload"])

        def make(shared=shared):
            automaton = pickle.loads(shared.value)

            def step(batch: pa.RecordBatch):
                found = [(key, _runs(s)) for i, key, t in zip(batch["doc_id"].to_pylist(), batch["dk"].to_pylist(), texts_of(batch["text"]), strict=True) if len(s := automaton.starts(i, t.split(), window))]
                yield pa.RecordBatch.from_arrays([pa.array([key for key, _ in found], pa.int64()), pa.array([r for _, r in found], pa.binary())], ["dk", "runs"])

            return step

        yield map_batches(rows, make, "dk long, runs binary")


def remove_repeats(docs: DataFrame, reference: DataFrame | None = None, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` against a reference (the documents themselves if none is given)."""
    found = None
    for part in matched(docs, build(docs if reference is None else reference, shard_words), window):
        found = part if found is None else found.unionByName(part)
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("dk"), "text")
    if found is None:
        joined = rows.withColumn("runs", F.array().cast("array<binary>"))
    else:
        joined = rows.join(cut(found).groupBy("dk").agg(F.collect_set("runs").alias("runs")), "dk", "left")

    def make():
        def step(batch: pa.RecordBatch):
            out = []
            for i, data, runs in zip(batch["doc_id"].to_pylist(), texts_of(batch["text"]), batch["runs"].to_pylist(), strict=True):
                words = data.split()
                gone = covered(len(words), window, np.zeros(0, np.int64), np.frombuffer(b"".join(runs or []), np.int32).reshape(-1, 2))
                kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
                out.append({"doc_id": i, "n_words": len(words), "n_removed": int(gone.sum()), "kept_sha256": hashlib.sha256(kept).hexdigest()})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]))

        return step

    return map_batches(joined.select("doc_id", "text", "runs"), make, "doc_id long, n_words long, n_removed long, kept_sha256 string")
