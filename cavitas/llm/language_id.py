"""Language ID by nearest centroid over hashed n-gram TF-IDF vectors.

A text's vector counts the byte trigrams of its lower-cased letters (other
characters become one space), hashed to ``DIMS``; it is damped, weighted by inverse
document frequency over all learnable documents, and normalised. Each language
has up to ``CENTROIDS`` centroids, clustered by cosine on a sample of about
``SAMPLE`` documents, by hash of the id; a cluster with under ``SHARE`` of the sample, odd
documents, gives none. A text gets the language of the centroid with
the largest cosine, and is rejected if that cosine is under ``FLOOR`` times what
all but ``TAIL`` of the language's own sample reach (for texts with under ``FEW``
distinct trigrams less, by the root of their share of it).

Only text and non-null lang of documents with crc32(doc_id as text) mod 3 not 1
are learned from, whatever the number of languages (128 kB each in the model). A letter is what Unicode calls one. Defined
results: null or letterless texts are ``und`` with score 0 and rejected; so
is every text if nothing can be learned; null ids are predicted, not held out, and
never learned from; repeated rows give repeated rows; an empty table gives no
rows; other columns are not read, and pass through ``keep_known``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cavitas.llm.common import documents, held_out, map_batches
from cavitas.session import cut, ship

DIMS = 1 << 13
CENTROIDS = 4
SAMPLE = 500
SHARE, TAIL = 0.05, 0.01
FLOOR = 0.3
FEW = 100

_LETTER = regex.compile(r"\p{L}")
_KEEP = bytes(b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def counts(text: str) -> np.ndarray:
    """Hashed trigram counts of a text."""
    clean = b" ".join((b" " + text.lower().encode("utf-8", "replace").translate(_KEEP) + b" ").split())
    data = np.frombuffer(b" " + clean + b" ", np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.zeros(DIMS)
    code = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    return np.bincount((code * np.uint32(2654435761)) >> np.uint32(32 - 13), minlength=DIMS)


def vector(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.sqrt(found, dtype=np.float32) * idf
    size = float(np.sqrt(v @ v))
    return v / size if size else v


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]  # of each centroid
    floors: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine, and whether the text is rejected."""
        if text is None or not self.langs or not _LETTER.search(text):
            return "und", 0.0, True
        found = counts(text)
        near = self.centroids @ vector(found, self.idf)
        best = int(near.argmax())
        score = min(1.0, max(0.0, float(near[best])))
        return self.langs[best], score, score < float(self.floors[best]) * min(1.0, (np.count_nonzero(found) / FEW) ** 0.5)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(DIMS, np.int64), 0
    for batch in batches:
        for text in batch["text"].to_pylist():
            total += counts(text) > 0
            n += 1
    dims = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(dims, -1), pa.int32()), pa.array(np.append(total[dims], n), pa.int64())], ["dim", "n"])


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=-1, keepdims=True), 1e-9)


def cluster(vectors: np.ndarray, k: int, share: float = SHARE, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from members drawn from the half nearest to the mean; small clusters go, the largest stays."""
    near = vectors @ _unit(vectors.mean(axis=0))
    dense = vectors[near >= np.median(near)]
    c = dense[np.random.default_rng(0).choice(len(dense), min(k, len(dense)), replace=False)]
    for last in (False, True):
        for _ in range(rounds):
            own = (vectors @ c.T).argmax(axis=1)
            c = np.array([_unit(vectors[own == j].mean(axis=0)) if (own == j).any() else c[j] for j in range(len(c))])
        sizes = np.bincount((vectors @ c.T).argmax(axis=1), minlength=len(c))
        if not last:
            c = c[(sizes >= share * len(vectors)) | (sizes == sizes.max())]
    return c


def _fit_language(idf: np.ndarray, k: int, floor: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "text"])
        vectors = np.array([vector(counts(t), idf) for t in rows["text"]])
        c = cluster(vectors, k)
        least = floor * float(np.quantile((vectors @ c.T).max(axis=1), TAIL))
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "centroid": [x.astype(float).tolist() for x in c], "floor": least})

    return run


def fit(docs: DataFrame, sample: int = SAMPLE, k: int = CENTROIDS, floor: float = FLOOR) -> Model:
    """Learns from the learnable rows of ``docs`` (doc_id, text, lang)."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out())
    found = rows.select("text").mapInArrow(_frequencies, "dim int, n long").groupBy("dim").agg(F.sum("n")).collect()  # DIMS + 1 rows
    frequency = np.zeros(DIMS)
    total = 0
    for dim, n in found:
        if dim < 0:
            total = n
        else:
            frequency[dim] = n
    idf = np.log((1 + total) / (1 + frequency)).astype(np.float32) + np.float32(0.1)
    sizes = cut(rows.groupBy("lang").agg(F.count("*").alias("n")))
    if sizes.isEmpty():
        return Model(idf, np.zeros((0, DIMS), np.float32), [], np.zeros(0))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    # the names of the languages, less than the model that they are fitted for
    chosen = rows.join(F.broadcast(sizes), "lang").where(place < F.lit(sample) / F.col("n")).drop("n")
    fitted = chosen.groupBy("lang").applyInPandas(_fit_language(idf, k, floor), "lang string, centroid array<double>, floor double").collect()
    fitted.sort(key=lambda r: (r["lang"], r["centroid"]))
    matrix = np.array([r["centroid"] for r in fitted], np.float32).reshape(-1, DIMS)
    return Model(idf, matrix, [r["lang"] for r in fitted], np.array([r["floor"] for r in fitted]))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        predict_one = shared.value.predict

        def step(batch: pa.RecordBatch):
            langs, scores, rejected = zip(*map(predict_one, batch["text"].to_pylist()), strict=True) if batch.num_rows else ((), (), ())
            arrays = [batch["doc_id"], batch["held_out"], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "lang_pred", "score", "rejected"])

        return step

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).select("doc_id", held_out().alias("held_out"), "text")
    return map_batches(rows, make, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows that the model rejects."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        predict_one = shared.value.predict

        def step(batch: pa.RecordBatch):
            yield batch.filter(pa.array([not predict_one(t)[2] for t in batch["text"].to_pylist()], pa.bool_()))

        return step

    return map_batches(docs, make, docs.schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predict(docs, fit(docs))
