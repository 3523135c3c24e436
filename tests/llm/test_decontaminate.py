import random

import numpy as np

from cavitas.llm import decontaminate as d


def distance(item, text):
    """Least edits from item to any part of text (Sellers)."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(rng, text, n):
    t = list(text)
    for _ in range(n):
        at = rng.randrange(len(t))
        kind = rng.randrange(3)
        if kind == 0:
            t[at] = rng.choice("abcxyz ")
        elif kind == 1:
            del t[at]
        else:
            t.insert(at, rng.choice("abcxyz"))
    return "".join(t)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(rng.randint(3, 25))) for i in range(8)]
    docs = []
    for i in range(40):
        t = prose(rng.randint(0, 30))
        if rng.random() < 0.7:
            item = rng.choice(items)[1]
            t += " " + edited(rng, item, rng.choice([0, 0, 1, 3, int(0.1 * len(item)), int(0.2 * len(item))])) + " " + prose(rng.randint(0, 20))
        docs.append((i, t))
    return docs, items


def brute(docs, items):
    out = []
    for i, t in docs:
        data = d.normalised(t)
        hit = sorted(j for j, x in items if len(n := d.normalised(x)) >= d.Q and distance(n, data) <= d.edit_budget(len(n)))
        out.append((i, bool(hit), len(hit), ",".join(map(str, hit))))
    return sorted(out, key=str)


def test_against_brute_force(spark, stored):
    docs, items = corpus(1)
    docs += [(100, None), (101, ""), (102, items[0][1].upper().replace(" ", " !! ")), (103, items[3][1]), (103, items[3][1]), (104, "abc " * 2_000)]
    items += [(50, None), (51, "abc"), (52, items[2][1])]
    path = stored(docs, benchmark=(items, "item_id long, text string"))
    got = d.op3_decontaminate(spark, path).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items)
    table, bench = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/benchmark.parquet")
    for block in (d.BLOCK, 300):
        kept = d.decontaminate(table, bench, block=block)
        assert kept.columns == table.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, hit, *_ in brute(docs, items) if not hit)
    blocks = d.scan(table, bench, block=300).collect()
    assert sorted((r.doc_id, r.n_found, r["items"]) for r in blocks) == sorted((i, n, [int(x) for x in s.split(",") if x]) for i, _, n, s in brute(docs, items))


def test_repetitive_items_and_windows(monkeypatch):
    """Against brute force where q-grams repeat, and where a text is taken in windows."""
    rng = random.Random(9)
    monkeypatch.setattr(d, "SPAN", 60)
    monkeypatch.setattr(d, "PAIRS", 7)
    some = 0
    for _ in range(60):
        unit = "".join(rng.choice("ab ") for _ in range(rng.randint(1, 4)))
        items = [(unit * 40)[: rng.randint(9, 60)], "".join(rng.choice("abc") for _ in range(30)), "xyz" * 12]
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 300))) + edited(rng, rng.choice(items), rng.randint(0, 4)) + "".join(rng.choice("abxyz") for _ in range(rng.randint(0, 200)))
        index = d.Index(list(range(3)), items)
        want = [k for k, data in enumerate(index.items) if distance(data, d.normalised(text)) <= d.edit_budget(len(data))]
        assert index.found(text) == want
        some += len(want)
    assert some > 40


def test_memory_of_a_repetitive_text():
    import tracemalloc

    index = d.Index([0, 1], ["0 " * 1_000, "lorem ipsum dolor sit amet " * 20])
    peaks = []
    for n in (20_000, 1_000_000):
        tracemalloc.start()
        assert index.found("1 " * 30 + "0 " * (n // 2)) == [0]
        peaks.append(tracemalloc.get_traced_memory()[1] - 8 * n)
        tracemalloc.stop()
    assert peaks[1] < peaks[0] + 40_000_000, peaks


def test_banded_distance():
    rng = random.Random(7)
    arr = lambda s: np.frombuffer(s.encode(), np.uint8).astype(np.int16)
    for _ in range(150):
        item = "".join(rng.choice("ab") for _ in range(rng.randint(1, 25)))
        region = "".join(rng.choice("ab") for _ in range(rng.randint(0, 40)))
        k = rng.randint(0, 6)
        assert d.banded_distance(arr(item), arr(region), k) == min(distance(item, region), k + 1)


def test_empty(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "x")], "item_id long, text string")
    assert d.scan(docs([]), one).count() == 0
    assert d.scan(docs([(1, "abc")]), none).first().n_found == 0
    assert d.decontaminate(docs([(1, "abc")]), none).count() == 1
