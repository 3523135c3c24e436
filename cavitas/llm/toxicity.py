"""Toxicity by a bidirectional GRU with attention pooling, trained in numpy.

A word's input is made of its own hashed table and of the tables of its hashed
character n-grams (with marks at both ends): trained embeddings (of the
n-grams, each dimension's largest), and how strongly each goes with the label,
as a smoothed z-score over the training documents. Embeddings start at zero and
are trained only for words and n-grams of several texts; in training, words
lose their embeddings and windows their z-scores at random, so that the network
learns from each without the other. Windows of ``STEPS`` words, each overlapping
the next, run through a GRU in both directions; attention pools its states into
a logit. A document's score is the calibrated largest logit of all its windows.

The model is fitted on a sample of about ``SAMPLE`` labelled documents of each
class, by hash of the id, of those with crc32(doc_id as text) mod 3 not 1. Labels, lang,
source and doc_id are no inputs of a score.

Defined results: null, empty and wordless texts score 0; so does all if the
learnable labels lack one of the classes; null ids are scored, not held out and
never learned from; labels without a document or value are ignored, of
several for a document the largest counts; repeated rows give repeated rows; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cavitas.llm.common import _BYTE, documents, gram_hashes, held_out, map_batches, mix, powers
from cavitas.session import ship, table

SAMPLE = 1500
STEPS, STRIDE = 24, 16
HIDDEN, EMBED = 8, 8
GRAMS = (5, 6, 7)
TABLE_BITS = 20
EMBED_SLOTS = 1 << 18
INPUTS = 4 + 2 * EMBED
THRESHOLD = 0.7
#: Training: rates of the network and of the embeddings, and shares of words whose own embedding, of words whose
#: embeddings, and of windows whose scores are put to zero.
RATE, EMBED_RATE, WORD_DROP, BOTH_DROP, SCORE_DROP = 0.01, 0.03, 0.3, 0.1, 0.3
#: Words and n-grams in fewer training texts have no embedding: they could only be learned by heart.
MIN_TEXTS = 10
#: Words whose projected inputs a task keeps.
WORDS = 200_000

_KEEP = bytes(b if 97 <= b <= 122 or 48 <= b <= 57 or b > 127 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(_KEEP).split()


def _range_hashes(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = powers(len(total))
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)) >> np.uint64(64 - TABLE_BITS)


def slots(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table slots of the words, and of their character n-grams with the number of the word."""
    marked = b"".join(b"^%b$" % w for w in words)
    data = np.frombuffer(marked, np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), sizes)
    up, _ = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    ends = np.cumsum(sizes)
    own = _range_hashes(total, ends - sizes, ends)
    grams, of = [], []
    for n in GRAMS:
        at = np.arange(max(0, len(data) - n + 1))
        at = at[owner[at] == owner[at + n - 1]]
        grams.append(_range_hashes(total, at, at + n))
        of.append(owner[at])
    of = np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return own.astype(np.int64), np.concatenate(grams).astype(np.int64)[order], of[order]


def windows_of(n: int) -> np.ndarray:
    """Starts of the windows over n words: each overlaps the next, the last ends with the text."""
    if n <= STEPS:
        return np.zeros(1, np.int64)
    starts = np.arange(0, n - STEPS, STRIDE)
    return np.append(starts, n - STEPS)


@dataclass
class Model:
    word_z: np.ndarray
    gram_z: np.ndarray
    word_e: np.ndarray
    gram_e: np.ndarray
    p: dict[str, np.ndarray]
    calibration: np.ndarray

    def inputs(self, words: list[bytes]) -> np.ndarray:
        return _inputs(slots(words), len(words), self.word_z, self.gram_z, self.word_e, self.gram_e)

    def projected(self, words: list[bytes]) -> np.ndarray:
        x = self.inputs(words)
        return np.concatenate([x @ self.p["Wf"] + self.p["bf"], x @ self.p["Wb"] + self.p["bb"]], axis=1)

    def logits(self, table: np.ndarray, index: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """Logits of windows: ``index`` rows of the projected ``table``, shape (windows, STEPS)."""
        n = len(index)
        states = np.empty((STEPS, n, 2 * HIDDEN), np.float32)
        for side, (u, steps) in enumerate(((self.p["Uf"], range(STEPS)), (self.p["Ub"], range(STEPS - 1, -1, -1)))):
            part = table[:, side * 3 * HIDDEN : (side + 1) * 3 * HIDDEN]
            h = np.zeros((n, HIDDEN), np.float32)
            for t in steps:
                gi = part[index[:, t]]
                gh = h @ u
                gate = np.tanh((gi[:, : 2 * HIDDEN] + gh[:, : 2 * HIDDEN]) * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)
                new = np.tanh(gi[:, 2 * HIDDEN :] + gate[:, HIDDEN:] * gh[:, 2 * HIDDEN :])
                h = new + gate[:, :HIDDEN] * (h - new)
                states[t, :, side * HIDDEN : (side + 1) * HIDDEN] = h
        energy = np.where(valid.T, states @ self.p["w"], np.float32(-1e9))
        weight = np.exp(energy - energy.max(axis=0))
        weight /= weight.sum(axis=0)
        return (states * weight[:, :, None]).sum(axis=0) @ self.p["u"] + self.p["b"][0]

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return _sigmoid(evidence @ self.calibration)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Evidence:
    """What a document's windows add up to: their largest logit, how many are likely, and how many there are."""

    def __init__(self, n: int):
        self.top, self.likely, self.windows = np.full(n, -30.0), np.zeros(n), np.zeros(n)

    def add(self, owner: np.ndarray, logit: np.ndarray) -> None:
        np.maximum.at(self.top, owner, logit)
        self.likely += np.bincount(owner, _sigmoid(logit), minlength=len(self.top))
        self.windows += np.bincount(owner, minlength=len(self.top))

    def features(self) -> np.ndarray:
        return np.stack([np.ones(len(self.top)), self.top, np.log(self.likely + 1e-3), np.log1p(self.windows)], axis=1)


def _inputs(found, n: int, word_z, gram_z, word_e, gram_e) -> np.ndarray:
    own, grams, of = found
    x = np.zeros((n, INPUTS), np.float32)
    x[:, 0] = word_z[own]
    count = np.maximum(np.bincount(of, minlength=n), 1)
    z = gram_z[grams]
    top = np.full(n, -9.0, np.float32)
    np.maximum.at(top, of, z)
    x[:, 1] = np.where(top > -9, top, 0)
    x[:, 2] = np.bincount(of, z, minlength=n) / count
    x[:, 3] = 1
    x[:, 4 : 4 + EMBED] = word_e[own % EMBED_SLOTS]
    if len(of):
        starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        x[of[starts], 4 + EMBED :] = np.maximum.reduceat(gram_e[grams % EMBED_SLOTS], starts, axis=0)
    return x


def _texts_of(slot_sets: list[np.ndarray], key: np.ndarray) -> np.ndarray:
    """In how many of the texts each embedding's slot is; texts of one key count once."""
    seen = np.zeros(EMBED_SLOTS, np.int32)
    for i in np.unique(key, return_index=True)[1].tolist():
        seen[np.unique(slot_sets[i] % EMBED_SLOTS)] += 1
    return seen


def _sketch(slot: np.ndarray) -> int:
    """The least hash of a text's runs of five words: most near copies have one in common."""
    found = gram_hashes(mix(slot.astype(np.uint64)), min(5, len(slot))) if len(slot) else slot
    return int(found.min()) if len(found) else 0


def _z_scores(slot_sets: list[np.ndarray], labels: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Smoothed z-score of the log-odds of each slot between texts with and without the label; texts of one key count once."""
    size = 1 << TABLE_BITS
    seen, n = np.zeros((2, size), np.float32), np.zeros(2)
    first = set()
    for found, y, k in zip(slot_sets, labels.astype(int).tolist(), key.tolist(), strict=True):
        if (y, k) not in first:
            first.add((y, k))
            seen[y, found] += 1
            n[y] += 1
    a, b = seen[1] + 0.5, seen[0] + 0.5
    delta = np.log(a / (n[1] + 1.5 - seen[1])) - np.log(b / (n[0] + 1.5 - seen[0]))
    return (np.clip(delta / np.sqrt(1 / a + 1 / b), -6, 9) / 3).astype(np.float32)


def _initial(rng: np.random.Generator) -> dict[str, np.ndarray]:
    draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
    p = {"w": draw(2 * HIDDEN), "u": draw(2 * HIDDEN), "b": np.zeros(1, np.float32)}
    for side in "fb":
        p |= {f"W{side}": draw(INPUTS, 3 * HIDDEN), f"b{side}": np.zeros(3 * HIDDEN, np.float32), f"U{side}": draw(HIDDEN, 3 * HIDDEN)}
    return p


def gradients(p: dict[str, np.ndarray], x: np.ndarray, valid: np.ndarray, y: np.ndarray):
    """Loss, gradients of the parameters, and of the inputs ``x`` (batch, STEPS, INPUTS)."""
    n, H = len(x), HIDDEN
    states = np.zeros((STEPS, n, 2 * H), np.float32)
    kept: dict[str, list] = {}
    order = {"f": list(range(STEPS)), "b": list(range(STEPS - 1, -1, -1))}
    for s, side in enumerate("fb"):
        h = np.zeros((n, H), np.float32)
        kept[side] = []
        for t in order[side]:
            gi, gh = x[:, t] @ p[f"W{side}"] + p[f"b{side}"], h @ p[f"U{side}"]
            gate = np.tanh((gi[:, : 2 * H] + gh[:, : 2 * H]) / 2) / 2 + np.float32(0.5)
            new = np.tanh(gi[:, 2 * H :] + gate[:, H:] * gh[:, 2 * H :])
            kept[side].append((t, h, gate[:, :H], gate[:, H:], new, gh[:, 2 * H :]))
            h = new + gate[:, :H] * (h - new)
            states[t, :, s * H : (s + 1) * H] = h
    energy = np.where(valid.T, states @ p["w"], np.float32(-1e9))
    a = np.exp(energy - energy.max(axis=0))
    a /= a.sum(axis=0)
    c = (states * a[:, :, None]).sum(axis=0)
    logit = c @ p["u"] + p["b"][0]
    prob = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    loss = float(np.mean(np.logaddexp(0, logit) - y * logit))
    d = ((prob - y) / n).astype(np.float32)
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["u"], g["b"] = d @ c, np.array([d.sum()], np.float32)
    dc = d[:, None] * p["u"]
    da = (states * dc).sum(axis=2)
    de = a * (da - (a * da).sum(axis=0))
    g["w"] = np.tensordot(de, states, 2)
    ds = a[:, :, None] * dc + de[:, :, None] * p["w"]
    dx = np.zeros_like(x)
    for s, side in enumerate("fb"):
        dh = np.zeros((n, H), np.float32)
        for t, h, z, r, new, ghn in reversed(kept[side]):
            dh = dh + ds[t, :, s * H : (s + 1) * H]
            dn = dh * (1 - z) * (1 - new**2)
            dz = dh * (h - new) * z * (1 - z)
            dr = dn * ghn * r * (1 - r)
            gi = np.concatenate([dz, dr, dn], axis=1)
            gh = np.concatenate([dz, dr, dn * r], axis=1)
            g[f"W{side}"] += x[:, t].T @ gi
            g[f"b{side}"] += gi.sum(axis=0)
            g[f"U{side}"] += h.T @ gh
            dx[:, t] += gi @ p[f"W{side}"].T
            dh = dh * z + gh @ p[f"U{side}"].T
    return loss, g, dx


def train(texts: list[str], labels: np.ndarray, sizes: dict[int, int] | None = None, rounds: int = 300, batch: int = 128, seed: int = 7) -> Model | None:
    """Fits the tables' z-scores, then the network on windows, then the calibration on documents.

    ``sizes`` are the classes' documents that the texts are a sample of; the calibration weighs by them.
    """
    labels = np.asarray(labels, float)
    if len(set(labels.tolist())) < 2:
        return None
    rng = np.random.default_rng(seed)
    number: dict[bytes, int] = {}
    docs = [np.array([number.setdefault(w, len(number)) for w in words_of(t)], np.int64) for t in texts]
    vocabulary = list(number)
    own, grams, of = slots(vocabulary)
    edges = np.searchsorted(of, np.arange(len(vocabulary) + 1))
    by_word = grams
    word_sets = [np.unique(own[d]) for d in docs]
    gram_sets = [np.unique(np.concatenate([by_word[edges[i] : edges[i + 1]] for i in np.unique(d)])) if len(d) else np.zeros(0, np.int64) for d in docs]
    key = np.array([_sketch(own[d]) for d in docs], np.uint64)
    word_z, gram_z = _z_scores(word_sets, labels, key), _z_scores(gram_sets, labels, key)
    fold = (key % np.uint64(2)).astype(np.int64)
    by_fold = [tuple(_z_scores([x for x, f in zip(sets, fold, strict=True) if f != k], labels[fold != k], key[fold != k]) for sets in (word_sets, gram_sets)) for k in (0, 1)]
    # zero at first, so that a word never trained on says nothing
    word_e, gram_e = (np.zeros((EMBED_SLOTS, EMBED), np.float32) for _ in range(2))
    common = [_texts_of(sets, key) >= MIN_TEXTS for sets in (word_sets, gram_sets)]
    squares = [np.full(EMBED_SLOTS, 1e-4, np.float32) for _ in range(2)]
    signal = np.stack([_inputs((own, grams, of), len(vocabulary), *z, word_e, gram_e)[:, :2].max(axis=1) for z in by_fold])

    place, owner = [], []
    for i, d in enumerate(docs):
        if len(d):
            starts = windows_of(len(d))
            place.append(starts)
            owner.append(np.full(len(starts), i))
    at, owner = np.concatenate(place), np.concatenate(owner)
    lengths = np.array([len(d) for d in docs])
    offset = np.concatenate([[0], np.cumsum(lengths)])
    flat = np.append(np.concatenate(docs), 0)
    index = np.minimum(at, lengths[owner])[:, None] + np.arange(STEPS)
    valid = index < lengths[owner][:, None]
    index = flat[np.where(valid, index + offset[owner][:, None], len(flat) - 1)]
    evidence = np.where(valid, signal[fold[owner][:, None], index], -9).max(axis=1)
    best = np.full(len(docs), -9.0)
    np.maximum.at(best, owner, evidence)
    positive = np.flatnonzero((labels[owner] == 1) & (evidence >= np.minimum(best[owner], 1.5)))
    negative = np.flatnonzero(labels[owner] == 0)
    hard = negative[np.argsort(-evidence[negative], kind="stable")[: max(batch, len(negative) // 10)]]

    p = _initial(rng)
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    half = batch // 2
    for step in range(1, rounds + 1):
        rows = np.concatenate([rng.choice(positive, half), rng.choice(negative, half // 2), rng.choice(hard, half - half // 2)])
        y = (labels[owner[rows]] == 1).astype(np.float32)
        y = np.where(y == 1, np.float32(0.97), np.float32(0.01))
        ids = index[rows]
        # a window sees the scores that the other fold's texts give
        seen, where = np.unique(2 * ids + fold[owner[rows]][:, None], return_inverse=True)
        where = where.reshape(ids.shape)
        side, seen = seen % 2, seen // 2
        n_grams = edges[seen + 1] - edges[seen]
        pick = np.repeat(edges[seen] - np.concatenate([[0], np.cumsum(n_grams)[:-1]]), n_grams) + np.arange(n_grams.sum())
        of_seen = np.repeat(np.arange(len(seen)), n_grams)
        x_seen = _inputs((own[seen], by_word[pick], of_seen), len(seen), *by_fold[0], word_e, gram_e)
        odd = _inputs((own[seen], by_word[pick], of_seen), len(seen), *by_fold[1], word_e, gram_e)
        x_seen = np.where(side[:, None] == 0, x_seen, odd)
        keep = np.ones((batch, STEPS, INPUTS), np.float32) * valid[rows][:, :, None]
        keep[:, :, :3] *= rng.random((batch, 1, 1)) >= SCORE_DROP
        keep[:, :, 4 : 4 + EMBED] *= rng.random((batch, STEPS, 1)) >= WORD_DROP
        keep[:, :, 4:] *= rng.random((batch, STEPS, 1)) >= BOTH_DROP
        x = x_seen[where] * keep
        _, g, dx = gradients(p, x, valid[rows], y)
        fall = min(1, 3 * (1 - step / (rounds + 1)))
        for k in p:
            first[k] += 0.1 * (g[k] - first[k])
            second[k] += 0.001 * (g[k] ** 2 - second[k])
            p[k] = p[k] - np.float32(RATE * fall) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-7)
        total = np.zeros((len(seen), INPUTS), np.float32)
        np.add.at(total, where.ravel(), (dx * keep).reshape(-1, INPUTS))
        of_word, of_gram = own[seen] % EMBED_SLOTS, by_word[pick] % EMBED_SLOTS
        largest = gram_e[of_gram] == x_seen[of_seen, 4 + EMBED :]
        for embeddings, square, at, grad, seen_enough in (
            (word_e, squares[0], of_word, total[:, 4 : 4 + EMBED], common[0]),
            (gram_e, squares[1], of_gram, total[of_seen, 4 + EMBED :] * largest, common[1]),
        ):
            chosen = seen_enough[at]
            some, back = np.unique(at[chosen], return_inverse=True)
            summed = np.stack([np.bincount(back, grad[chosen, d], minlength=len(some)) for d in range(EMBED)], axis=1).astype(np.float32)
            square[some] += (summed**2).mean(axis=1)
            embeddings[some] -= np.float32(EMBED_RATE * fall) * summed / np.sqrt(square[some])[:, None]

    p = {k: v.astype(np.float32) for k, v in p.items()}
    seen = Evidence(len(docs))
    for k in (0, 1):
        model = Model(*by_fold[k], word_e, gram_e, p, np.zeros(0))
        table = _with_pad(model.projected(vocabulary), model)
        own_rows = np.flatnonzero(fold[owner] == k)
        for at in range(0, len(own_rows), 4096):
            part = own_rows[at : at + 4096]
            seen.add(owner[part], model.logits(table, np.where(valid[part], index[part], len(vocabulary)), valid[part]))
    weights = np.ones(len(labels))
    for y, n in (sizes or {}).items():
        weights[labels == y] = n / max(1, (labels == y).sum())
    weights /= weights.mean()
    small = lambda z: z.astype(np.float16)
    return Model(small(word_z), small(gram_z), word_e, gram_e, p, calibrated(seen.features(), labels, weights))


def _with_pad(table: np.ndarray, model: Model) -> np.ndarray:
    """The projected words, and a last row for places after a short text's end."""
    return np.append(table, np.concatenate([model.p["bf"], model.p["bb"]])[None], axis=0)


def calibrated(x: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Logistic regression of the documents' labels on their evidence, by Newton's steps."""
    t = np.zeros(x.shape[1])
    for _ in range(60):
        q = _sigmoid(x @ t)
        grad = x.T @ (weights * (q - labels)) + 0.1 * t
        hess = (x * (weights * q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(len(t))
        t = t - np.clip(np.linalg.solve(hess, grad), -1, 1)
    return t


class Scorer:
    """Scores batches of texts, keeping the projected inputs of words it has seen."""

    def __init__(self, model: Model):
        self.model = model
        self.number: dict[bytes, int] = {}
        self.table = np.zeros((1 << 14, 6 * HIDDEN), np.float32)
        self.pad = np.concatenate([model.p["bf"], model.p["bb"]])

    def rows(self, words: list[bytes]) -> np.ndarray:
        if len(self.number) > WORDS:
            self.number.clear()
        found = list(map(self.number.get, words))
        if None in found:
            new = list({w for w, f in zip(words, found, strict=True) if f is None})
            at = len(self.number)
            while at + len(new) + 1 > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            for k in range(0, len(new), 20_000):
                part = new[k : k + 20_000]
                self.table[at + 1 + k : at + 1 + k + len(part)] = self.model.projected(part)
            self.number.update(zip(new, range(at + 1, at + 1 + len(new)), strict=True))
            found = list(map(self.number.__getitem__, words))
        return np.array(found, np.int32)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        split = list(map(words_of, texts))
        self.table[0] = self.pad
        lengths = np.fromiter(map(len, split), np.int64, len(split))
        seen = Evidence(len(texts))
        rows = np.append(self.rows([w for s in split for w in s]), 0)
        offset = np.concatenate([[0], np.cumsum(lengths)])
        starts = [windows_of(n) if n else np.zeros(0, np.int64) for n in lengths.tolist()]
        owner = np.repeat(np.arange(len(texts)), [len(s) for s in starts])
        at = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        for k in range(0, len(at), 4096):
            who = owner[k : k + 4096]
            index = at[k : k + 4096][:, None] + np.arange(STEPS)
            valid = index < lengths[who][:, None]
            index = rows[np.where(valid, index + offset[who][:, None], len(rows) - 1)]
            seen.add(who, self.model.logits(self.table, index, valid))
        return np.where(lengths > 0, self.model.score(seen.features()), 0.0)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Learns from documents (doc_id, text) and labels (doc_id, toxic)."""
    spark = docs.sparkSession
    ship(spark)
    marked = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return None
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = marked.where(place < F.when(F.col("toxic") == 1, sample / sizes[1]).otherwise(sample / sizes[0]))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "text"])
        return pd.DataFrame({"model": [pickle.dumps(train(frame["text"].fillna("").tolist(), frame["toxic"].to_numpy(), sizes))]})

    found = rows.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(run, "model binary").collect()  # one row
    return pickle.loads(bytes(found[0]["model"])) if found else None


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(shared.value) if shared.value is not None else None

        def step(batch: pa.RecordBatch):
            texts = batch["text"].to_pylist()
            found = scorer.scores(texts) if scorer else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

        return step

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).select("doc_id", held_out().alias("held_out"), "text")
    return map_batches(rows, make, "doc_id long, held_out boolean, score double, predicted int")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
