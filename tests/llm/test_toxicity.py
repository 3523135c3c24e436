import math
import random
import zlib

import numpy as np

from cavitas.llm import toxicity as tx

BAD = ["grumbug", "zonkhead", "vilefoo"]


def rows(n=700, seed=0):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("lo", "mi", "ta", "re", "so") for b in ("ban", "dor", "kel", "pim", "tus", "wex")]
    out, labels = [], []
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.randint(3, 90))]
        y = int(rng.random() < 0.4)
        if y:
            for _ in range(rng.randint(2, 5)):
                t.insert(rng.randrange(len(t) + 1), rng.choice(BAD) + rng.choice(["", "", "s", "x"]))
        out.append((i, " ".join(t)))
        labels.append((i, 1, y))
    return out, labels


LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy_and_edges(spark, stored):
    docs, labels = rows()
    truth = {i: y for i, _, y in labels}
    extra = [(1000, None), (1001, ""), (1002, "!! .."), (None, "grumbug zonkhead lodor"), (1003, "miban " * 30_000), (1004, "lodor"), (1004, "lodor")]
    labels += [(1001, 1, 0), (5000, 1, 1), (7, 1, None), (None, 1, 1)]
    path = stored(docs + extra, labels=(labels, LABELS))
    got = tx.op1_toxicity(spark, path).collect()
    assert len(got) == len(docs) + len(extra)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.9 * len(held)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= tx.THRESHOLD)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    by = {r.doc_id: r.score for r in got}
    assert by[1000] == by[1001] == by[1002] == 0 and by[1003] < 0.5 and by[None] > 0.5


def test_scores_do_not_depend_on_batches():
    docs, labels = rows(120)
    model = tx.train([t for _, t in docs], np.array([y for *_, y in labels]), rounds=60)
    texts = [t for _, t in docs] + ["", None, "one"]
    whole = tx.Scorer(model).scores(texts)
    alone = np.array([tx.Scorer(model).scores([t])[0] for t in texts])
    assert np.allclose(whole, alone, atol=1e-5)


def test_windows_overlap_and_cover():
    for n in (1, 5, tx.STEPS, tx.STEPS + 1, 100, 1003):
        w = tx.windows_of(n)
        seen = {k for s in w.tolist() for k in range(s, s + tx.STEPS)}
        assert set(range(n)) <= seen and (n <= tx.STEPS or max(seen) == n - 1)
        assert (np.diff(w) < tx.STEPS).all()


def test_gradients():
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in tx._initial(rng).items()}
    x = rng.standard_normal((3, tx.STEPS, tx.INPUTS))
    valid = np.arange(tx.STEPS)[None] < np.array([[tx.STEPS], [5], [11]])
    y = np.array([1.0, 0.0, 1.0])
    _, g, dx = tx.gradients(p, x, valid, y)
    for name, grad in [*g.items(), ("x", dx)]:
        target = x if name == "x" else p[name]
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in target.shape)
            was = target[at]
            target[at] = was + 1e-2
            high = tx.gradients(p, x, valid, y)[0]
            target[at] = was - 1e-2
            low = tx.gradients(p, x, valid, y)[0]
            target[at] = was
            assert abs((high - low) / 2e-2 - grad[at]) < 2e-3 + 0.05 * abs(grad[at])


def test_forward_pass_against_plain_loops():
    docs, labels = rows(150)
    model = tx.train([t for _, t in docs], np.array([y for *_, y in labels]), rounds=40)
    p, H = {k: v.astype(float) for k, v in model.p.items()}, tx.HIDDEN
    sigmoid = lambda v: 1 / (1 + math.exp(-v))
    of = lambda table, key: table[key % tx.EMBED_SLOTS].astype(float)

    def word_input(w):
        own, grams, _ = tx.slots([w])
        z = [float(model.gram_z[g]) for g in grams]
        own_e = of(model.word_e, own[0])
        gram_e = [max(of(model.gram_e, g)[d] for g in grams) if len(grams) else 0.0 for d in range(tx.EMBED)]
        return [float(model.word_z[own[0]]), max(z, default=0.0), sum(z) / max(1, len(z)), 1.0, *own_e, *gram_e]

    def states(x, side):
        W, U, b = p[f"W{side}"], p[f"U{side}"], p[f"b{side}"]
        h, out = [0.0] * H, []
        for row in x:
            gi = [b[j] + sum(row[i] * W[i][j] for i in range(len(row))) for j in range(3 * H)]
            gh = [sum(h[i] * U[i][j] for i in range(H)) for j in range(3 * H)]
            z = [sigmoid(gi[j] + gh[j]) for j in range(H)]
            r = [sigmoid(gi[H + j] + gh[H + j]) for j in range(H)]
            new = [math.tanh(gi[2 * H + j] + r[j] * gh[2 * H + j]) for j in range(H)]
            h = [new[j] + z[j] * (h[j] - new[j]) for j in range(H)]
            out.append(h)
        return out

    def logit(words):
        x = [word_input(w) for w in words] + [[0.0] * tx.INPUTS] * (tx.STEPS - len(words))
        both = [f + b for f, b in zip(states(x, "f"), states(x[::-1], "b")[::-1], strict=True)][: len(words)]
        energy = [sum(a * w for a, w in zip(s, p["w"], strict=True)) for s in both]
        weight = [math.exp(e - max(energy)) for e in energy]
        pooled = [sum(a * s[j] for a, s in zip(weight, both, strict=True)) / sum(weight) for j in range(2 * H)]
        return p["b"][0] + sum(a * u for a, u in zip(pooled, p["u"], strict=True))

    texts = [docs[0][1], docs[3][1], "grumbug", "lodor a zonkheads miban", "lodor " * 7]
    expected = []
    for text in texts:
        words = tx.words_of(text)
        logits = [logit(words[a : a + tx.STEPS]) for a in tx.windows_of(len(words)).tolist()]
        features = [1.0, max(logits), math.log(sum(map(sigmoid, logits)) + 1e-3), math.log1p(len(logits))]
        expected.append(sigmoid(sum(f * c for f, c in zip(features, model.calibration, strict=True))))
    assert np.allclose(tx.Scorer(model).scores(texts), expected, atol=1e-4)


def _auc(scores, labels):
    high, low = scores[labels == 1], scores[labels == 0]
    return float(np.mean(high[:, None] > low[None]) + np.mean(high[:, None] == low[None]) / 2)


def test_embeddings_and_scores_each_tell_the_label():
    docs, labels = rows(900)
    y = np.array([y for *_, y in labels])
    texts = [t for _, t in docs]
    model = tx.train(texts[:600], y[:600])
    held, truth = texts[600:], y[600:]
    assert _auc(tx.Scorer(model).scores(held), truth) > 0.97
    none = [np.zeros_like(t) for t in (model.word_z, model.gram_z)]
    without_scores = tx.Model(*none, model.word_e, model.gram_e, model.p, model.calibration)
    assert _auc(tx.Scorer(without_scores).scores(held), truth) > 0.93
    blank = [np.zeros_like(t) for t in (model.word_e, model.gram_e)]
    without_embeddings = tx.Model(model.word_z, model.gram_z, *blank, model.p, model.calibration)
    assert _auc(tx.Scorer(without_embeddings).scores(held), truth) > 0.93


def test_planted_spellings():
    docs, labels = rows(900)
    model = tx.train([t for _, t in docs], np.array([y for *_, y in labels]))
    clean = [t for (_, t), (*_, y) in zip(docs, labels, strict=True) if not y and len(t.split()) > 20][:40]
    plain = tx.Scorer(model).scores(clean)
    for spelling in ("grumbugging", "zonkheadly", "xvilefoo"):  # never seen in training
        planted = [" ".join([*t.split()[:10], spelling, spelling, *t.split()[10:]]) for t in clean]
        found = tx.Scorer(model).scores(planted)
        assert np.mean(found > plain) > 0.95 and np.mean(found >= tx.THRESHOLD) > 0.8, spelling
    assert np.mean(plain >= tx.THRESHOLD) < 0.1


def test_unlearnable(spark, docs):
    none = spark.createDataFrame([], LABELS)
    one = spark.createDataFrame([(1, 0, 1), (2, 0, 1)], LABELS)
    for labels in (none, one):
        model = tx.fit(docs([(1, "a"), (2, "b")]), labels)
        assert model is None and [r.score for r in tx.score(docs([(1, "a")]), model).collect()] == [0.0]
    assert tx.score(docs([]), None).count() == 0
