import hashlib
import random

import corpus_pipeline
from cavitas.llm import bpe, decontaminate

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = {"xx": ["bada", "dobu", "gaba", "abdo", "udog", "gadu", "obad"], "yy": ["kiti", "pesk", "sitek", "etik", "kepis", "tikes", "skepi"]}


def corpus():
    rng = random.Random(5)
    word = lambda lang: "".join(rng.choice(VOCABULARY[lang]) for _ in range(2))
    prose = lambda lang, n: " ".join(word(lang) for _ in range(n))
    rows = [(i, prose(lang := rng.choice(["xx", "yy"]), rng.randint(30, 90)), lang) for i in range(120)]
    items = [(k, prose("xx", 20)) for k in range(4)]
    base = prose("yy", 200).split()
    edited = list(base)
    edited[100] = "udog"
    rows += [(200, " ".join(base), "yy"), (201, " ".join(edited), "yy")]  # near copies: 200 stays
    rows += [(210, "Equal " + rows[0][1], "xx"), (211, "equal " + rows[0][1], "xx")]  # equal but for case: 211 stays, until it meets 0, its near copy (similarity 73 / 74)
    rows += [(220, prose("xx", 10) + " " + items[2][1].upper() + "! " + prose("xx", 10), "xx")]  # holds a benchmark item
    rows += [(230, None, "xx"), (231, "", None), (232, "123 %% 456", "yy")]  # no language
    rows += [(None, prose("xx", 40), "xx"), (240, rows[5][1] + " " + rows[6][1] * 400, None)]
    return rows, items


def test_stages_against_what_is_planted(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame([(i, t, g, None, None) for i, t, g in rows], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    text = {i: t for i, t, _ in rows}
    ids = lambda df: {r.doc_id for r in df.collect()}
    want = set(text)
    gone = {"language_id": {230, 231, 232}, "exact_dedup": {210}, "simhash_near_dedup": {201, 211}, "benchmark_decontamination": {220}}
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == [*gone, "bpe_encoding"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        want -= gone[name]
        assert ids(out) == want, name
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == want
    enc = bpe.Encoder(bpe.vocabulary_path())
    for i, r in got.items():
        data = enc.encode(text[i])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(data) // 4, hashlib.sha256(data).hexdigest(), hashlib.sha256(text[i].encode()).hexdigest())
    assert not any(decontaminate.normalised(items[2][1]) in decontaminate.normalised(text[i]) for i in want)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], COLUMNS + ", digest string, fp long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
