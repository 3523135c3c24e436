"""Byte-level BPE encoding and decoding, with tree concatenation of long text.

Ids are those of the tokenizers library's own pre-tokenizer and model for the
given vocabulary file. Plain texts are encoded many at once (`merges`); of others a
task keeps the ids of chunks (a space and what follows it) it has seen. A text over ``LEAF`` characters is
cut between chunks into rows that are encoded in parallel; a pre-token
over ``LEAF`` bytes, which nothing splits, is cut into halves again and again,
the leaves are encoded in parallel, and neighbours are then joined pair by pair:
a window of tokens around each join is encoded anew and grows until its ends
agree with both sides. BPE sequences whose neighbouring tokens are all
compatible are unique, so that agreement makes the result exact.

Defined results: a null text counts as empty and has no ids; special tokens'
strings in a text become their ids, as in the library; ids that are no valid
UTF-8 decode with replacement characters; repeated rows give repeated rows;
null ids pass through; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cavitas.llm.common import documents, map_batches
from cavitas.llm.merges import Merges, Plain
from cavitas.session import ship

VOCABULARY = "byte_bpe_50k.json"
#: Longest text, in characters, and pre-token, in bytes, that is encoded at once.
LEAF = 1 << 16
#: Chunks, and pre-tokens, whose ids a Python worker keeps (about 0.4 kB a pair).
CHUNKS = 150_000
#: Pre-tokens of under so many characters are kept; of as many bytes at most, encoded together.
SHORT = 64
#: Bytes of plain text that are encoded together.
TOGETHER = 1 << 19
#: Chunks of Latin letters, digits and signs but the apostrophe, with single line
#: ends between: their pre-tokens are runs of one kind, and the line ends.
_LETTERS, _SIGNS = "A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F", r"!-&(-/:-@\[-`{-~"
SIMPLE = re.compile(f"[{_LETTERS}0-9{_SIGNS}]+(?:\n[{_LETTERS}0-9{_SIGNS}]+)*")
RUNS = re.compile(f"[{_LETTERS}]+|[0-9]+|[{_SIGNS}]+|\n")
#: The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100.
_OWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
ALPHABET = {b: chr(b) for b in _OWN} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in set(_OWN))}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def is_boundary(follows: str) -> bool:
    """A space before this text always starts a pre-token: the text starts with no white space."""
    return bool(follows) and ("!" <= follows[0] <= "~" or follows[0].isalpha())


def chunks_of(text: str) -> list[str]:
    """Cuts before each space that starts a pre-token."""
    out: list[str] = []
    held: list[str] = []
    for i, part in enumerate(text.split(" ")):
        if i and is_boundary(part):
            out.append(" ".join(held))
            held = ["", part]
        else:
            held.append(part)
    out.append(" ".join(held))
    return out


class Encoder:
    def __init__(self, path: str, leaf: int = LEAF, keep: int = CHUNKS):
        from tokenizers import Tokenizer

        self.keep = keep
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.model = self.tokenizer.model
        self.leaf = leaf
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = {t.content: np.uint32(i).tobytes() for i, t in added.items()}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.plain_special = not any(t.lstrip or t.rstrip or t.single_word for t in added.values())
        merges = Merges.of(self.tokenizer, ALPHABET)
        self.plain = merges and Plain(merges, keep, SHORT)
        self.chunks: dict[str, bytes] = {}
        self.tokens: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if any(s in text for s in self.special):
            if not self.plain_special:
                return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            parts = self.special_pattern.split(text)
            return b"".join(self.special[p] if i % 2 else self._encode(p) for i, p in enumerate(parts))
        return self._encode(text)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """`encode` of each text, plain texts many at once."""
        if self.plain is None:
            return [self.encode(t) for t in texts]
        out: list[bytes | None] = []
        held: list[bytes] = []
        size = 0
        for text in texts:
            held.append(text.encode())
            size += len(held[-1])
            if size > TOGETHER:
                out += self.plain.encode(held)
                held, size = [], 0
        out += self.plain.encode(held)
        return [self.encode(t) if x is None or any(s in t for s in self.special) else x for t, x in zip(texts, out, strict=True)]

    def _encode(self, text: str) -> bytes:
        if not text:
            return b""
        first, *parts = text.split(" ")
        known = self.chunks
        out = list(map(known.get, parts))
        if None in out:
            for kept in (known, self.tokens):
                if len(kept) > self.keep:
                    kept.clear()
            for i, part in enumerate(parts):
                if out[i] is None:
                    if not is_boundary(part):
                        return b"".join(map(self._chunk, chunks_of(text)))
                    out[i] = known[part] = self._spaced(part)
        return self._chunk(first) + b"".join(out)

    def _chunk(self, text: str) -> bytes:
        if text[:1] == " " and is_boundary(text[1:]):
            found = self.chunks.get(text[1:])
            return self._spaced(text[1:]) if found is None else found
        return b"".join(map(self._mapped, (token for token, _ in self.split(text))))

    def _spaced(self, part: str) -> bytes:
        """Ids of a space and ``part``."""
        if part.isascii() and part.isalpha():
            return self._token(" " + part)
        if SIMPLE.fullmatch(part):
            first, *rest = RUNS.findall(part)
            return self._token(" " + first) + b"".join(map(self._token, rest))
        return b"".join(map(self._mapped, (token for token, _ in self.split(" " + part))))

    def _token(self, text: str) -> bytes:
        """Ids of a pre-token, from those seen before."""
        ids = self.tokens.get(text)
        if ids is None:
            mapped = "\u0120" + text[1:] if text.isascii() and text[0] == " " else text.encode().decode("latin-1").translate(ALPHABET)
            ids = self._mapped(mapped)
            if len(text) < SHORT:
                self.tokens[text] = ids
        return ids

    def _mapped(self, token: str) -> bytes:
        """Ids of a pre-token whose characters stand for bytes."""
        if len(token) > self.leaf:
            return array("I", self.join([self.leaf_ids(x) for x in halves(token, self.leaf)])).tobytes()
        return array("I", self.leaf_ids(token)).tobytes()

    def leaf_ids(self, token: str) -> list[int]:
        return [t.id for t in self.model.tokenize(token)]

    def join(self, leaves: list[list[int]]) -> list[int]:
        """Joins neighbours, then what they gave, up to the whole."""
        while len(leaves) > 1:
            leaves = [self.concatenate(*leaves[i : i + 2]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
        return leaves[0] if leaves else []

    def concatenate(self, left: list[int], right: list[int], width: int = 4) -> list[int]:
        """Encodes a growing window around the join until both its ends agree."""
        while True:
            a, b = left[-width:], right[:width]
            window = self.leaf_ids("".join(map(self.model.id_to_token, a + b)))
            agree_left = width >= len(left) or window[:2] == a[:2]
            agree_right = width >= len(right) or window[-2:] == b[-2:]
            if agree_left and agree_right:
                return left[: len(left) - len(a)] + window + right[len(b) :]
            width *= 2


def halves(token: str, leaf: int) -> list[str]:
    if len(token) <= leaf:
        return [token]
    middle = len(token) // 2
    return halves(token[:middle], leaf) + halves(token[middle:], leaf)


class Decoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        byte = {c: b for b, c in ALPHABET.items()}
        added = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
        self.table = [b""] * tokenizer.get_vocab_size()
        for token, i in tokenizer.get_vocab().items():
            self.table[i] = token.encode() if token in added else bytes(byte[c] for c in token)

    def decode(self, ids: bytes) -> str:
        """The text of little-endian unsigned 32-bit ids, special tokens' strings included."""
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def encoder(path: str, leaf: int = LEAF, keep: int = CHUNKS) -> Encoder:
    return Encoder(path, leaf, keep)


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def _ids_only(path: str):
    return lambda batch, ids: {"doc_id": batch["doc_id"], "ids": pa.array(ids, pa.binary())}


def _digests(path: str):
    dec = decoder(path)

    def columns(batch: pa.RecordBatch, ids: list[bytes]) -> dict[str, pa.Array]:
        return {
            "doc_id": batch["doc_id"],
            "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
            "decoded_sha256": pa.array([hashlib.sha256(dec.decode(x).encode()).hexdigest() for x in ids]),
        }

    return columns


_IDS, _DIGESTS = "doc_id long, ids binary", "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _encode_rows(path: str, leaf: int, returned):
    def make():
        enc, columns = encoder(path, leaf), returned(path)

        def step(batch: pa.RecordBatch):
            yield pa.RecordBatch.from_pydict(columns(batch, enc.encode_all([t or "" for t in batch["text"].to_pylist()])))

        return step

    return make


def leaves_of(text: str, enc: Encoder) -> list[tuple[int, str]]:
    """(group, text): TEXT is text between boundaries, TOKENS short pre-tokens, others number the long pre-tokens, in halves."""
    out: list[tuple[int, str]] = []
    group = 0
    held: list[str] = []
    size = 0

    def flush(kind: int, between: str) -> None:
        nonlocal held, size
        if held:
            out.append((kind, between.join(held)))
        held, size = [], 0

    for piece in [x for i, p in enumerate(enc.special_pattern.split(text)) for x in ([p] if i % 2 else chunks_of(p)) if x]:
        if len(piece) > enc.leaf and piece not in enc.special:
            flush(TEXT, "")
            for token, _ in enc.split(piece):
                if len(token) > enc.leaf:
                    flush(TOKENS, " ")
                    out += [(group, x) for x in halves(token, enc.leaf)]
                    group += 1
                else:
                    held.append(token)
                    size += len(token)
                    if size > enc.leaf:
                        flush(TOKENS, " ")
            flush(TOKENS, " ")
        else:
            if size + len(piece) > enc.leaf:
                flush(TEXT, "")
            held.append(piece)
            size += len(piece)
    flush(TEXT, "")
    return out


#: Kinds of leaves; a pre-token in the byte-level alphabet has no space in it.
TEXT, TOKENS = -1, -2


def leaf_encoded(enc: Encoder, group: int, text: str) -> bytes:
    if group == TEXT:
        return enc.encode(text)
    if group == TOKENS:
        return b"".join(map(enc._mapped, text.split(" ")))
    return array("I", enc.leaf_ids(text)).tobytes()


def joined(enc: Encoder, leaves) -> bytes:
    """The ids of a text from its (group, ids) in order."""
    out: list[bytes] = []
    for group, part in groupby(leaves, key=lambda x: x[0]):
        if group < 0:
            out += [x for _, x in part]
        else:
            out.append(array("I", enc.join([np.frombuffer(x, "<u4").tolist() for _, x in part])).tobytes())
    return b"".join(out)


def _leaf_rows(path: str, leaf: int):
    def make():
        enc = encoder(path, leaf)

        def step(batch: pa.RecordBatch):
            for row in batch.to_pylist():
                found = leaves_of(row["text"], enc)
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["doc_id"]] * n, pa.int64()), pa.array([row["row_key"]] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([g for g, _ in found], pa.int32()), pa.array([t for _, t in found], pa.string())],
                    ["doc_id", "row_key", "seq", "group", "text"],
                )

        return step

    return make


def _encode_leaves(path: str, leaf: int):
    def make():
        enc = encoder(path, leaf)

        def step(batch: pa.RecordBatch):
            ids = [leaf_encoded(enc, g, t) for g, t in zip(batch["group"].to_pylist(), batch["text"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["row_key"], batch["seq"], batch["group"], pa.array(ids, pa.binary())], ["doc_id", "row_key", "seq", "group", "ids"])

        return step

    return make


def _join_leaves(path: str, leaf: int, returned):
    def run(leaves: pa.Table) -> pa.Table:
        enc, columns = encoder(path, leaf), returned(path)
        parts = leaves.select(["seq", "group", "ids"]).sort_by("seq").to_pylist()
        times = sum(x["seq"] == 0 for x in parts)  # of a repeated row
        ids = joined(enc, [(x["group"], x["ids"]) for x in parts[::times]])
        own = pa.RecordBatch.from_pydict({"doc_id": leaves["doc_id"].slice(0, 1).combine_chunks()})
        return pa.concat_tables([pa.table(columns(own, [ids]))] * times)

    return run


def _encoded(docs: DataFrame, path: str, leaf: int, returned, schema: str) -> DataFrame:
    """What ``returned`` makes of each document's ids, in the Python worker that has them: a task needs one worker, with one vocabulary, and no ids go through Spark."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    long = F.coalesce(F.length("text") > leaf, F.lit(False))
    short = map_batches(rows.where(~long), _encode_rows(path, leaf, returned), schema)
    keyed = rows.where(long).select("doc_id", F.xxhash64("text").alias("row_key"), "text")
    leaves = map_batches(keyed, _leaf_rows(path, leaf), "doc_id long, row_key long, seq int, group int, text string")
    spread = leaves.repartition("doc_id", "row_key", "seq")
    done = map_batches(spread, _encode_leaves(path, leaf), "doc_id long, row_key long, seq int, group int, ids binary")
    return short.unionByName(done.groupBy("doc_id", "row_key").applyInArrow(_join_leaves(path, leaf, returned), schema))


def encode(docs: DataFrame, path: str, leaf: int = LEAF) -> DataFrame:
    """``doc_id, ids``: ids as little-endian unsigned 32-bit integers, one row a document."""
    return _encoded(docs, path, leaf, _ids_only, _IDS)


def _decode_rows(path: str):
    def make():
        dec = decoder(path)

        def step(batch: pa.RecordBatch):
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([dec.decode(x or b"") for x in batch["ids"].to_pylist()])], ["doc_id", "text"])

        return step

    return make


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` of the rows of `encode`."""
    return map_batches(encoded.select("doc_id", "ids"), _decode_rows(path), "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, leaf: int = LEAF) -> DataFrame:
    """Encodes, decodes, and returns ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    return _encoded(docs, path, leaf, _digests, _DIGESTS)


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir), vocabulary_path())
