import hashlib
import random

import xxhash

from cavitas.llm import exact_dedup, simhash


def brute_exact(rows):
    groups = {}
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    out = []
    for i, t in rows:
        ids = groups[low(t)]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(low(t).encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(1, "Aa b"), (2, "aA B"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "x" * 200_000), (None, "lone"), (None, "aa b"), (8, "same"), (8, "same")]


def test_exact_edge_cases(spark, stored):
    got = exact_dedup.op4_exact_dedup(spark, stored(ROWS))
    assert sorted(map(tuple, got.collect()), key=str) == brute_exact(ROWS)


def test_exact_filter_and_heavy(spark, docs):
    rows = [(i, "hot" if i % 3 else f"text {i % 40}") for i in range(600)]
    kept = {r.doc_id for r in exact_dedup.deduplicate(docs(rows), counters=4).collect()}
    assert kept == {i for i, k, *_ in brute_exact(rows) if i == k}
    marked = exact_dedup.mark_duplicates(docs(rows), counters=4)
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in marked.collect()) == sorted(x[:3] for x in brute_exact(rows))
    assert exact_dedup.heavy_hitters(exact_dedup.digests(docs(rows)), 4).count() <= 5


def test_exact_empty(spark, docs):
    assert exact_dedup.mark_duplicates(docs([])).count() == 0
    assert exact_dedup.deduplicate(docs([])).count() == 0


def brute_print(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(prints))]


def corpus(n=160, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(80)]
    base = [[rng.choice(words) for _ in range(120)] for _ in range(6)]
    rows = []
    for i in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((i, " ".join(t)))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "One"), (n + 4, "one TWO"), (n + 5, "one two é"), (n + 5, "one two é")]


def check_components(spark, path, rows, monkeypatch=None):
    got = {}
    for r in simhash.op9_simhash_near_dedup(spark, path).collect():
        got[r.doc_id] = (r.fingerprint, r.component_id)
    prints = [brute_print(t) for _, t in rows]
    roots = brute_components(prints)
    for (i, _), p, k in zip(rows, prints, roots, strict=True):
        least = min(j for (j, _), q in zip(rows, roots, strict=True) if q == k)
        assert got[i] == (f"{p:016x}", least)


def test_simhash_matches_brute_force(spark, stored):
    rows = corpus()
    check_components(spark, stored(rows), rows)


def test_simhash_crowded_buckets(spark, docs):
    rows = corpus(seed=5)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs(rows), bucket=2).collect()}
    want = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs(rows)).collect()}
    assert got == want
    kept = simhash.deduplicate(docs(rows))
    assert {r.doc_id for r in kept.collect()} == set(want.values())


def test_simhash_null_ids_and_empty(spark, docs):
    assert simhash.near_duplicates(docs([])).count() == 0
    got = simhash.near_duplicates(docs([(None, "a b c"), (4, "a b c"), (None, "p q r s")])).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("4", "4"), ("None", "4"), ("None", "None")]
