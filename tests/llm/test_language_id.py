import random
import zlib

from cavitas.llm import language_id

VOCABULARY = {"xx": ["bada", "dobu", "gaba", "abdo", "udog"], "yy": ["kiti", "pesk", "sitek", "étik", "kepis"], "zz": ["молоко", "ворона", "лото", "мор", "рамон"]}


def rows(n=300, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(VOCABULARY))
        out.append((i, " ".join(rng.choice(VOCABULARY[lang]) for _ in range(rng.randint(4, 60))), lang))
    return out


SCHEMA = "doc_id long, text string, lang string, source string, held_out boolean, score double, rejected string"


def frame(spark, data):
    return spark.createDataFrame([(i, t, g, "s", None, None, None) for i, t, g in data], SCHEMA)


def test_held_out_accuracy_and_edges(spark, tmp_path):
    data = rows() + [(1000, None, "xx"), (1001, "", "yy"), (1002, "12 %% !", "xx"), (None, "bada dobu gaba", "xx"), (1003, "kiti pesk " * 30_000, None), (1004, "bada dobu", "xx"), (1004, "bada dobu", "xx"), (1005, "漢字仮名" * 20, None)]
    frame(spark, data).write.parquet(f"{tmp_path}/documents.parquet")
    got = language_id.op8_language_id(spark, str(tmp_path)).collect()
    assert len(got) == len(data)
    truth = {i: g for i, _, g in rows()}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    for r in got:
        assert 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].rejected for i in (1000, 1001, 1002))
    assert by[None].lang_pred == "xx" and by[1003].lang_pred == "yy" and by[1005].rejected and by[1005].lang_pred != "und"
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = language_id.keep_known(docs, language_id.fit(docs))
    assert kept.schema == docs.schema
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted((r.doc_id or -1) for r in got if not r.rejected)


def test_letters_many_languages_and_odd_documents(spark):
    data = rows(900) + [(2000 + k, f"{chr(0x4E00 + k)}{chr(0x5000 + k)} " * 5, f"l{k:03}") for k in range(400) if zlib.crc32(str(2000 + k).encode()) % 3 != 1]
    # a few mislabelled documents give no centroid
    data += [(9000 + k, "bada dobu gaba abdo " * 9, "yy") for k in range(9)]
    docs = frame(spark, data)
    model = language_id.fit(docs)
    assert len(set(model.langs)) == len({g for _, _, g in data}) > 256
    assert model.predict("²½")[0] == "und" and model.predict("ⅷ 12")[0] == "und" and model.predict("ª")[0] != "und"
    assert model.predict("abdo gaba bada dobu " * 9)[0] == "xx"
    for lang in VOCABULARY:
        assert 1 <= model.langs.count(lang) <= language_id.CENTROIDS


def test_prediction_against_plain_python(spark):
    """Cosines by dictionaries of trigrams, without hashing or arrays, for the same centroids' language."""
    import math

    docs = frame(spark, rows())
    model = language_id.fit(docs)

    def plain(text):
        clean = " ".join("".join(c if c.isalpha() and (c.islower() or not c.isascii()) else " " for c in text.lower()).split())
        data = f" {clean} ".encode()
        return [data[k : k + 3] for k in range(len(data) - 2)]

    for _, text, _ in rows(40, seed=3):
        weights = {}
        for gram in plain(text):
            slot = ((gram[0] << 16 | gram[1] << 8 | gram[2]) * 2654435761 % (1 << 32)) >> 19
            weights[slot] = weights.get(slot, 0) + 1
        weights = {s: math.sqrt(n) * float(model.idf[s]) for s, n in weights.items()}
        size = math.sqrt(sum(w * w for w in weights.values()))
        cosines = [sum(w * float(c[s]) for s, w in weights.items()) / size for c in model.centroids]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        lang, score, _ = model.predict(text)
        assert lang == model.langs[best] and abs(score - min(1.0, cosines[best])) < 1e-4


def test_never_learns_from_held_out(spark):
    data = rows()
    wrong = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 3 == 1 else g) for i, t, g in data]
    a, b = language_id.fit(frame(spark, data)), language_id.fit(frame(spark, wrong))
    assert a.langs == b.langs and (a.centroids == b.centroids).all() and (a.idf == b.idf).all()


def test_empty_and_unlearnable(spark):
    empty = frame(spark, [])
    assert language_id.predict(empty, language_id.fit(empty)).count() == 0
    some = frame(spark, [(1, "bada", None)])
    assert language_id.predict(some, language_id.fit(some)).first().lang_pred == "und"
