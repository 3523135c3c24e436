import random

import numpy as np

from cavitas.llm import hyperminhash as hyper
from cavitas.llm import similar_sets


def shingles(text, words=4):
    w = (text or "").lower().split()
    return {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()


def components(rows):
    """(id, text) to the smallest id reachable, by comparing all pairs."""
    keys = sorted({(i, t) for i, t in rows if i is not None}, key=lambda x: (x[0], x[1] or ""))
    sets = [shingles(t) for _, t in keys]
    parent = list(range(len(keys)))

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(keys)):
        for b in range(a + 1, len(keys)):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {key: keys[top(k)][0] for k, key in enumerate(keys)}


def corpus(seed, n=60):
    """Texts from 1 to 400 words with edits of all sizes, boilerplate that many share, and odd rows."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(600)]
    common = [rng.choice(words) for _ in range(60)]
    rows = []
    for _ in range(n):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 4, 5, 8, 9, 14, 30, 60, 150, 400]))]
        if rng.random() < 0.3:
            base = common + base
        for copy in range(rng.choice([1, 2, 3])):
            t = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, len(t) // 12]) if copy else 0):
                at = rng.randrange(len(t))
                t[at : at + rng.choice([0, 1])] = [f"e{rng.randrange(9999)}"]
            rows.append((len(rows), " ".join(t)))
    return rows + [(9000, None), (9001, ""), (9002, " \t\n"), (9003, rows[0][1].upper()), (9003, rows[0][1].upper()), (9003, "other words of the same id"), (None, rows[0][1]), (None, None)]


def test_equals_brute_force(docs):
    for seed in (1, 2):
        rows = corpus(seed)
        want = components(rows)
        assert len(set(want.values())) < 0.8 * len(want)
        for options in ({}, {"bucket": 3, "weight": 400, "stream": 20}):
            out = hyper.near_duplicates(docs(rows), **options).collect()
            assert sorted((r.doc_id, r.n, r.keep_id) for r in out if r.doc_id is not None) == sorted((i, len(shingles(t)), want[i, t]) for i, t in rows if i is not None)
            assert [(r.keep_id, r.n) for r in out if r.doc_id is None] == [(None, k) for k in (r.n for r in out if r.doc_id is None)] and len(out) == len(rows)


def test_half_of_a_crowded_set_is_not_similar(spark, docs, monkeypatch):
    """Rows that meet follow a set's size, also if half of its members are similar to no other."""
    met = {}
    for n in (200, 400):
        rng = random.Random(n)
        shared = [f"w{k}" for k in range(100)]
        near = [shared + [f"n{k}" for k in range(30)] + [f"x{i}"] for i in range(n)]
        apart = [shared + [f"y{rng.randrange(10**9)}" for _ in range(60)] for _ in range(n)]
        rows = list(enumerate(" ".join(t) for t in near + apart))
        seen, sort = [], similar_sets.sorted_blocks
        monkeypatch.setattr(similar_sets, "sorted_blocks", lambda rows, seen=seen, sort=sort: (seen.append(rows.cache().count()), sort(rows))[1])
        out = {r.doc_id: r.keep_id for r in hyper.near_duplicates(docs(rows), bucket=16, weight=3000).collect()}
        monkeypatch.setattr(similar_sets, "sorted_blocks", sort)
        assert out == {i: 0 if i < n else i for i, _ in rows}
        met[n] = sum(seen)
    assert met[400] <= 2.3 * met[200], met


def test_registers():
    rng = np.random.default_rng(0)
    for n in (1, 3, 50, 5000):
        h = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1))
        h[0] = h[0] >> np.uint64(58)  # a long run of zeros
        h = np.unique(h)
        want = [0] * hyper.REGISTERS
        for k in range(hyper.REGISTERS):
            own = [x for x in h.tolist() if x >> 57 == k]
            if own:
                bits = f"{min(own) & (1 << 57) - 1:057b}" + "1" * 7
                zeros = bits.index("1")
                want[k] = (zeros << 10) + int((bits[zeros + 1 :] + "0" * 10)[:10], 2) + 1
        assert hyper.registers(h).tolist() == want
        assert (hyper.dense(hyper.registers(h)) > 0).all()


def test_estimate_is_near_the_similarity():
    rng = np.random.default_rng(1)
    for j in (0.0, 0.5, 0.8, 0.95):
        errors = []
        for _ in range(60):
            n = 3000
            common = int(2 * n * j / (1 + j))
            pool = rng.integers(0, 1 << 63, 2 * n).astype(np.uint64) * np.uint64(2)
            a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[:common], pool[n : 2 * n - common]]))
            got, buckets = hyper.estimate(hyper.registers(a), hyper.registers(b)[None], len(a), np.array([len(b)]))
            assert buckets[0] == hyper.REGISTERS
            errors.append(got[0] - j)
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_bands_find_pairs_of_small_sets():
    """Of pairs of similarity 0.8, five shingles or fifty, nearly all share a band."""
    rng = np.random.default_rng(2)
    for n, common in ((5, 4), (50, 40), (500, 400)):
        lost = 0
        for _ in range(400):
            pool = rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)
            a, b = np.unique(pool), np.unique(pool[:common])
            lost += not (hyper.bands(hyper.registers(a)) == hyper.bands(hyper.registers(b))).any()
        assert lost == 0


def test_deduplicate_and_empty(docs):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(3, text), (1, text + " more"), (2, None), (4, ""), (1, text + " more"), (5, "x" * 2_000_000), (6, "long " * 300_000 + "a"), (7, "long " * 300_000 + "a")]
    out = hyper.deduplicate(docs(rows))
    assert out.columns == docs([]).columns and sorted(r.doc_id for r in out.collect()) == [1, 1, 2, 4, 5, 6]
    assert hyper.deduplicate(docs([])).count() == 0 and hyper.near_duplicates(docs([])).count() == 0


def test_bitmap_keeps_all_that_is_named(spark, monkeypatch):
    rows = spark.range(5000).withColumnRenamed("id", "a")
    names = rows.where("a % 37 = 0")
    for bits in (1 << 15, 1 << 18):
        monkeypatch.setattr(similar_sets, "LOOKUP_BITS", bits)
        out = similar_sets.only_named(rows, names, ["a"])
        assert out.columns == ["a"] and out.join(names, "a", "left_semi").count() == names.count() and out.count() < 400
    assert similar_sets.only_named(rows, names.limit(0), ["a"]).count() == 0


def test_similar_sets_share_a_rare_shingle(spark):
    rng = np.random.default_rng(3)
    sets = []
    for k in range(0, 200, 2):
        pool = rng.integers(0, 1 << 62, 60).astype(np.uint64)
        n = int(rng.integers(5, 60))
        own = np.concatenate([np.arange(20, dtype=np.uint64), pool[:n]])
        sets += [(k, own), (k + 1, own[int(rng.integers(0, len(own) // 5 + 1)) :])]
    table = spark.createDataFrame([(k, k, bytearray(np.unique(s).tobytes())) for k, s in sets], "id long, component long, set_of binary")
    keys = {}
    for r in similar_sets.rare_shingles(table, 0.8).collect():
        keys.setdefault(r.id, set()).add(r.key)
    for (a, x), (b, y) in zip(sets[::2], sets[1::2], strict=True):
        if len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y)):
            assert keys[a] & keys[b]
