import hashlib
import random

from cavitas.llm import substring_dedup as sd


def brute(rows, window=sd.WINDOW):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in split:
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        if i is not None:
            for k in range(len(w) - window + 1):
                if first[tuple(w[k : k + window])] < i:
                    gone |= set(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "a", "é"]) if rng.random() < 0.5 else f"w{rng.randrange(200)}"
    prose = lambda k: [word() for _ in range(k)]
    shared = [prose(rng.choice([12, 13, 14, 30, 80])) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts += prose(rng.randint(0, 30))
            if rng.random() < 0.6:
                parts += rng.choice(shared)
        rows.append((i, rng.choice([" ", "\n", "  \t"]).join(parts)))
    rng.shuffle(rows)
    return rows + [(n, None), (n + 1, ""), (n + 2, "x " * 3000), (n + 3, "x " * 40), (None, rows[0][1]), (n + 4, rows[1][1]), (n + 4, rows[1][1]), (n + 5, "q " + " ".join(f"u{k}" for k in range(20)) + " r"), (n + 5, " ".join(f"u{k}" for k in range(20))), (-5, " ".join(shared[4]) + " tail")]


def test_against_brute_force(spark, stored, monkeypatch):
    rows = corpus()
    path = stored(rows)
    want = brute(rows)
    got = sd.op10_substring_dedup(spark, path)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert sum(x[2] for x in want) > 200


def test_many_partitions_and_small_windows(spark, docs):
    rows = corpus(3)
    table = docs(rows).repartition(7)
    got = sd.remove_repeats(table, window=5, gram=3)
    out = sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got.collect()), key=str)
    assert out == brute(rows, 5)


def test_empty(docs):
    assert sd.remove_repeats(docs([])).count() == 0
