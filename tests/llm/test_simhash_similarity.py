import random

import numpy as np

from cavitas.llm import similar_sets
from cavitas.llm import simhash_similarity as similar


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def corpus(n=120, seed=2):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    rows, k = [], 0
    for _ in range(n):
        base = [rng.choice(words) for _ in range(rng.randint(60, 400))]
        for copy in range(rng.choice([1, 1, 2, 4])):
            t = list(base)
            for _ in range(int(len(t) * rng.choice([0.004, 0.012, 0.018, 0.15])) if copy else 0):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((k, " ".join(t)))
            k += 1
    return rows


def row_key(spark, rows):
    """Text hash of each row, as Spark has it."""
    df = spark.createDataFrame([(t,) for t in {t for _, t in rows}], "text string")
    return {r.text: r.h for r in df.selectExpr("text", "xxhash64(text) AS h").collect()}


def groups_of(spark, docs, rows, **options):
    """(id, text) of each row, and of the row that its group keeps."""
    keys = row_key(spark, rows)
    text = {(i, keys[t]): (i, t) for i, t in rows}
    return {text[r.doc_id, r.row_key]: text[r.keep_id, r.keep_key] for r in similar.near_duplicates(docs(rows), **options).collect()}


def brute_force(rows):
    """(id, text) pairs that are similar."""
    sets = {(i, t): shingles(t) for i, t in rows if i is not None}
    return {(a, b) for a in sets for b in sets if a != b and (not sets[a] and not sets[b] or sets[a] & sets[b] and len(sets[a] & sets[b]) >= similar.SIMILARITY * len(sets[a] | sets[b]) - 1e-9)}


def test_recall_and_precision(spark, docs):
    rows = corpus()
    rows += [(5000, None), (5001, ""), (5002, "  "), (None, rows[0][1]), (5003, rows[0][1]), (5003, rows[0][1])]
    near = brute_force(rows)
    for options in ({}, {"bucket": 2, "weight": 900, "stream": 40}):
        out = similar.deduplicate(docs(rows), **options)
        assert out.columns == docs([]).columns
        kept = [r.doc_id for r in out.collect()]
        group = groups_of(spark, docs, rows, **options)
        assert len(near) > 120 and sum(group[a] == group[b] for a, b in near) >= 0.98 * len(near)
        joined = {x for pair in near for x in pair}
        assert all(x in joined for x, keep in group.items() if x != keep)
        assert sorted(x for x in kept if x is not None) == sorted(i for i, t in rows if i is not None and group[i, t] == (i, t))
        assert kept.count(None) == 1


def test_one_id_with_several_texts(spark, docs):
    a, b = (" ".join(f"{x}{k}" for k in range(80)) for x in "ab")
    for rows in ([(3, a), (5, b), (5, a)], [(5, a), (5, b), (3, a)]):
        assert sorted((r.doc_id, r.text) for r in similar.deduplicate(docs(rows)).collect()) == [(3, a), (5, b)]


def hot_group(n, seed=3):
    """Near copies of one text, in two families that are not similar to each other, and rows of their own."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    other = base[:150] + [f"v{k}" for k in range(50)]
    rows = []
    for k in range(n):
        t = list(base if k % 9 else other)
        t[rng.randrange(len(t))] = f"x{k}"
        rows.append((k, " ".join(t)))
    return rows + [(n + k, " ".join(f"y{rng.randrange(5000)}" for _ in range(60))) for k in range(50)]


def test_hot_group_of_near_copies(spark, docs, monkeypatch):
    """All links of a large group are found, in rows that grow with the group and not with its square."""
    met = {}
    for n in (300, 600):
        rows = hot_group(n)
        near = brute_force(rows) if n == 300 else set()
        for options in ({"bucket": 40, "weight": 8000}, {"bucket": 80, "stream": 50}):
            seen = []
            sort = similar_sets.sorted_blocks
            monkeypatch.setattr(similar_sets, "sorted_blocks", lambda rows, seen=seen: (seen.append(rows.cache().count()), sort(rows))[1])
            group = groups_of(spark, docs, rows, **options)
            monkeypatch.setattr(similar_sets, "sorted_blocks", sort)
            met[n, str(options)] = sum(seen)
            assert len({group[x] for x in rows[:n]}) == 2
            assert all(group[a] == group[b] for a, b in near)
            assert all(group[x] == x for x in rows[n:])
    for key in {k for _, k in met}:
        assert met[600, key] <= 2.6 * met[300, key], met


def edited(kind, base, size, rng):
    other = [f"x{rng.randrange(4000)}" for _ in range(size)]
    at = rng.randrange(len(base) - size)
    if kind == "tail":
        return base[:-size]
    if kind == "header":
        return other + base
    if kind == "footer":
        return base + other
    if kind == "swap":
        return base[:at] + base[at + size :] + base[at : at + size]
    return [rng.choice(other) if rng.random() < size / len(base) / 6 else w for w in base]


def test_recall_by_kind_of_edit(spark, docs):
    rng = random.Random(7)
    common = [f"w{i}" for i in range(3000)]
    rows, pairs = [], {}
    for kind in ("tail", "header", "footer", "swap", "scattered"):
        while len(pairs.setdefault(kind, [])) < 40:
            base = [common[int(len(common) * rng.random() ** 3)] for _ in range(rng.randint(60, 300))]
            t = edited(kind, base, rng.randint(3, len(base) // 4), rng)
            a, b = shingles(" ".join(base)), shingles(" ".join(t))
            if 0.8 <= len(a & b) / len(a | b) < 0.9:
                k = len(rows)
                rows += [(k, " ".join(base)), (k + 1, " ".join(t))]
                pairs[kind].append(k)
    group = groups_of(spark, docs, rows)
    found = {kind: sum(group[rows[k + 1]] == group[rows[k]] for k in ks) for kind, ks in pairs.items()}
    assert min(found.values()) >= 38, found


def test_links_are_exact(spark, docs):
    rng = random.Random(11)
    rows = []
    for k in range(0, 300, 2):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([9, 12, 30, 100, 200]))]
        rows += [(k, " ".join(base)), (k + 1, " ".join(base + [f"x{rng.randrange(5000)}" for _ in range(rng.randrange(len(base) * 3 // 5))]))]
    # 900 is similar to 902 alone, and 901 to neither, though the filter lets it through
    base = [f"y{k}" for k in range(200)]
    rows += [(900, " ".join(base)), (901, " ".join(base[50:] + [f"z{k}" for k in range(6)])), (902, " ".join(base + ["v"] * 3))]
    sets = {i: shingles(t) for i, t in rows}
    share = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    for bucket in (similar.BUCKET, 2):
        found, of = similar.links(docs(rows), bucket=bucket)
        ids = {r.id: r.doc_id for r in of.collect()}
        found = {tuple(sorted((ids[r.src], ids[r.dst]))) for r in found.collect()}
        assert all(share(a, b) >= similar.SIMILARITY for a, b in found)
        near = {(k, k + 1) for k in range(0, 300, 2) if share(k, k + 1) >= similar.SIMILARITY and sets[k] != sets[k + 1]} | {(900, 902)}
        assert len(near) > 30 and len(near - found) <= 1, near - found


def test_forest_joins_what_pairs_join():
    rng = np.random.default_rng(0)
    prints = rng.integers(0, 1 << 63, (40, 8)).astype(np.uint64)
    prints[20:] = prints[:20] ^ np.uint64(3)
    found = similar_sets.forest(np.arange(40), lambda at, others: np.bitwise_count(prints[others] ^ prints[at]).sum(axis=1) <= 20)
    assert sorted(sorted(x) for x in found) == [[k, k + 20] for k in range(20)]


def test_keys_across_batches():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    keys = np.sort(rng.integers(0, 12, 90))
    ids = rng.integers(0, 30, 90)
    groups = {}
    for k, i in zip(keys.tolist(), ids.tolist(), strict=True):
        groups.setdefault(k, set()).add(i)
    for size in (1, 7, 90):
        for bucket in (2, 4, 1000):
            batches = [pa.RecordBatch.from_arrays([pa.array(keys[k : k + size]), pa.array(ids[k : k + size])], ["key", "id"]) for k in range(0, 90, size)]
            got, parts = {}, {}
            for b in similar_sets._shared(bucket)(iter(batches)):
                for s, p, i in zip(*(b[c].to_pylist() for c in ("set", "part", "id")), strict=True):
                    got.setdefault(s, set()).add(i)
                    parts.setdefault((s, p), set()).add(i)
            assert {frozenset(v) for v in got.values()} == {frozenset(v) for v in groups.values() if len(v) > 1}
            assert max(map(len, parts.values())) <= bucket


def test_empty(docs):
    assert similar.deduplicate(docs([])).count() == 0
    assert similar.deduplicate(docs([(1, "a b")])).count() == 1
