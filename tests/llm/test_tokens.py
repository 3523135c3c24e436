import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from cavitas.llm import bpe, token_shards

PIECES = ["a", "b", " ", "  ", "\n", "é", "'", "'s", "!", "1", "<|endoftext|>", "　", "\x1c", " ", "日", "the", " the", "aaaa", "́"]
ROWS = [(3, "The cat's  here.\n\nOh"), (1, None), (2, ""), (None, "lost"), (5, "same"), (5, "same"), (4, "<|endoftext|> x"), (9, "ab" * 400 + " é " + " " * 300 + "\n" * 300), (8, "x y " * 500)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.vocabulary_path())


def want_ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("leaf", [7, 64, 1 << 16])
def test_encoder_equals_library(library, leaf):
    rng = random.Random(leaf)
    enc, dec = bpe.Encoder(bpe.vocabulary_path(), leaf), bpe.Decoder(bpe.vocabulary_path())
    for _ in range(800):
        text = "".join(rng.choice(PIECES[: rng.randint(2, len(PIECES))]) for _ in range(rng.choice([3, 10, 40, 200])))
        ids = want_ids(library, text)
        want = np.array(ids, "<u4").tobytes()
        assert enc.encode(text) == want
        assert bpe.joined(enc, [(g, bpe.leaf_encoded(enc, g, t)) for g, t in bpe.leaves_of(text, enc)]) == want
        assert dec.decode(want) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("keep", [5, 300, 1 << 17])
def test_texts_together_equal_library(library, keep):
    rng = random.Random(keep)
    pieces = [*PIECES, " x", "\nHel", "\u00ff", "\u024f", "\u0250", "\u00d7", "\u00f7", "-->", "0042", "lo" * 40]
    enc = bpe.Encoder(bpe.vocabulary_path(), keep=keep)
    for _ in range(8):
        texts = ["".join(rng.choice(pieces[: rng.randint(2, len(pieces))]) for _ in range(rng.choice([0, 1, 3, 10, 40]))) for _ in range(400)]
        texts += ["aaaaaaa aaa aa", "Hello there, world", " leading", "trailing ", "\n", "one\ntwo 3.5"]
        assert enc.encode_all(texts) == [np.array(want_ids(library, t), "<u4").tobytes() for t in texts]


def test_plain_texts_take_no_call_a_word(library, monkeypatch):
    enc = bpe.Encoder(bpe.vocabulary_path())
    texts = [f"Document {k}: plain words, r\u00e9sum\u00e9 no. {k * k}\nand zqxv{k}jk." for k in range(50)]
    calls = []
    monkeypatch.setattr(enc, "leaf_ids", lambda token: calls.append(token) or [])
    assert enc.encode_all(texts) == [np.array(want_ids(library, t), "<u4").tobytes() for t in texts]
    assert not calls


def test_round_trip_takes_one_python_worker_a_task(docs):
    """No Python step stands over another within one stage."""
    plan = bpe.round_trip(docs(ROWS), bpe.vocabulary_path())._jdf.queryExecution().sparkPlan()
    over = []

    def walk(node, inside):
        name = node.nodeName()
        python = "InArrow" in name or "InPandas" in name
        over.extend([name] * (python and inside))
        inside = (inside or python) and "Exchange" not in name and not name.startswith("FlatMapGroups")
        for k in range(node.children().size()):
            walk(node.children().apply(k), inside)

    walk(plan, False)
    assert not over


def test_round_trip(spark, docs, library):
    want = []
    for i, t in ROWS:
        ids = want_ids(library, t)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    for leaf in (50, 1 << 16):
        got = bpe.round_trip(docs(ROWS), bpe.vocabulary_path(), leaf).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    text = {(r.doc_id, r.text) for r in bpe.decode(bpe.encode(docs(ROWS), bpe.vocabulary_path()), bpe.vocabulary_path()).collect()}
    assert text == {(i, t or "") for i, t in ROWS}
    assert bpe.round_trip(docs([]), bpe.vocabulary_path()).count() == 0


def test_shards(spark, docs, library, tmp_path):
    for k, size in enumerate((10, 1 << 20)):
        token_shards.write_shards(docs(ROWS), bpe.vocabulary_path(), f"{tmp_path}/{k}", shard_tokens=size)
        got = token_shards.read_shards(spark, f"{tmp_path}/{k}").collect()
        start, want = 0, []
        for i, t in sorted(ROWS, key=lambda x: (x[0] is not None, x[0] or 0)):
            ids = [*want_ids(library, t), token_shards.END]
            want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    token_shards.write_shards(docs([]), bpe.vocabulary_path(), f"{tmp_path}/none")
    assert token_shards.read_shards(spark, f"{tmp_path}/none").count() == 0


def test_wavelet_matrix():
    rng = np.random.default_rng(0)
    for n, top, levels in ((0, 5, 16), (1, 5, 16), (1300, 7, 16), (5000, 50257, 16), (700, 90000, 17)):
        tokens = rng.integers(0, top, n).astype(np.uint32)
        built, lengths = token_shards.WaveletMatrix.from_bytes(token_shards.WaveletMatrix.build(tokens, levels).to_bytes(np.array([n])))
        assert (built.tokens() == tokens).all() and lengths.tolist() == [n]
        for i in rng.integers(0, n, min(n, 20)).tolist():
            assert built.access(i) == tokens[i]
            where = np.flatnonzero(tokens == tokens[i])
            assert built.count(int(tokens[i])) == len(where)
            assert built.count(int(tokens[i]), i, n) == (where >= i).sum()
            assert built.locate(int(tokens[i]), len(where) - 1) == where[-1]
            assert built.locate(int(tokens[i]), len(where)) is None
        assert built.count(1 << levels) == 0
