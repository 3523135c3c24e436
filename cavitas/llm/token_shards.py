"""Token-ID output as one compressed wavelet matrix per shard.

A shard file holds the ids of consecutive documents, in ascending ``doc_id``
order, as bit-planes from the highest bit down: each plane has the bit of
every token in the order that the planes above leave (zeros first, stably),
with counts of ones before every ``BLOCK`` bits. That gives access to
a token, counting, and lookup of occurrences by rank and select, and the
planes alone give back all tokens.

Defined results: a null text counts as empty and has the end id only; ids
null come first; rows with one id are ordered by their text's hash, then text; an empty
table gives no file; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cavitas.llm.bpe import encoder, vocabulary_path
from cavitas.llm.common import documents, slices
from cavitas.session import scratch_folder, ship

END = 2
#: A shard is closed once it has so many tokens.
SHARD_TOKENS = 1 << 20
BLOCK = 512
#: Chunks whose ids a Python worker keeps.
CHUNKS = 500_000
MAGIC = b"WMX1"
_HEAD = struct.Struct("<4sBxxxQQ")


class WaveletMatrix:
    """``planes[k]`` are the packed bits of level ``k`` (little bit order), ``zeros[k]`` its zeros."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], blocks: list[np.ndarray]):
        self.n, self.planes, self.zeros, self.blocks = n, planes, zeros, blocks
        self.levels = len(planes)

    @classmethod
    def build(cls, tokens: np.ndarray, levels: int) -> WaveletMatrix:
        a = tokens.astype(np.uint16 if levels <= 16 else np.uint32)
        planes, zeros, blocks = [], [], []
        for k in range(levels - 1, -1, -1):
            bits = (a & a.dtype.type(1 << k)) != 0
            packed = np.packbits(bits, bitorder="little")
            planes.append(packed)
            blocks.append(_block_counts(packed))
            low = np.compress(~bits, a)
            zeros.append(len(low))
            a = np.concatenate([low, np.compress(bits, a)])
        return cls(len(tokens), planes, zeros, blocks)

    def bits(self, k: int) -> np.ndarray:
        return np.unpackbits(self.planes[k], count=self.n, bitorder="little").view(bool)

    def tokens(self) -> np.ndarray:
        """All tokens, from the lowest plane up."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        a = np.zeros(self.n, kind)
        for k in range(self.levels - 1, -1, -1):
            bits, z = self.bits(k), self.zeros[k]
            above = np.empty(self.n, kind)
            above[np.flatnonzero(~bits)] = a[:z]
            above[np.flatnonzero(bits)] = a[z:] | kind(1 << (self.levels - 1 - k))
            a = above
        return a

    def rank1(self, k: int, i: int) -> int:
        """Ones among the first ``i`` bits of plane ``k``."""
        block = i // BLOCK
        ones = int(self.blocks[k][block])
        part = self.planes[k][block * BLOCK // 8 : (i + 7) // 8].copy()
        if len(part) and i % 8:
            part[-1] &= (1 << (i % 8)) - 1
        return ones + int(np.bitwise_count(part).sum())

    def select(self, k: int, bit: int, j: int) -> int:
        """Position of the ``j``-th (from 0) ``bit`` of plane ``k``."""
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            ones = self.rank1(k, mid + 1)
            if (ones if bit else mid + 1 - ones) > j:
                high = mid
            else:
                low = mid + 1
        return low

    def access(self, i: int) -> int:
        value = 0
        for k in range(self.levels):
            bit = int(self.planes[k][i // 8] >> (i % 8)) & 1
            ones = self.rank1(k, i)
            value = value << 1 | bit
            i = self.zeros[k] + ones if bit else i - ones
        return value

    def _descend(self, token: int, begin: int, end: int) -> tuple[int, int]:
        for k in range(self.levels):
            a, b = self.rank1(k, begin), self.rank1(k, end)
            begin, end = (self.zeros[k] + a, self.zeros[k] + b) if token >> (self.levels - 1 - k) & 1 else (begin - a, end - b)
        return begin, end

    def count(self, token: int, begin: int = 0, end: int | None = None) -> int:
        """Occurrences of a token among positions ``begin`` to ``end``."""
        if token >> self.levels:
            return 0
        a, b = self._descend(token, begin, self.n if end is None else end)
        return b - a

    def locate(self, token: int, j: int) -> int | None:
        """Position of the ``j``-th (from 0) occurrence of a token."""
        if token >> self.levels:
            return None
        a, b = self._descend(token, 0, self.n)
        if not 0 <= j < b - a:
            return None
        i = a + j
        for k in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - k) & 1
            i = self.select(k, bit, i - self.zeros[k] if bit else i)
        return i

    def to_bytes(self, lengths: np.ndarray) -> bytes:
        """The shard file: head, documents' lengths, and for each plane its zeros, counts and bits, compressed."""
        squeeze = zstandard.ZstdCompressor(level=1).compress
        out = [_HEAD.pack(MAGIC, self.levels, self.n, len(lengths)), _block(squeeze(lengths.astype("<u8").tobytes()))]
        for plane, zeros, blocks in zip(self.planes, self.zeros, self.blocks, strict=True):
            out += [struct.pack("<Q", zeros), _block(squeeze(blocks.astype("<u4").tobytes())), _block(squeeze(plane.tobytes()))]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple[WaveletMatrix, np.ndarray]:
        magic, levels, n, _ = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        expand = zstandard.ZstdDecompressor().decompress
        at = _HEAD.size

        def part() -> bytes:
            nonlocal at
            (size,) = struct.unpack_from("<Q", data, at)
            at += 8 + size
            return expand(data[at - size : at])

        lengths = np.frombuffer(part(), "<u8").astype(np.int64)
        planes, zeros, blocks = [], [], []
        for _ in range(levels):
            zeros.append(struct.unpack_from("<Q", data, at)[0])
            at += 8
            blocks.append(np.frombuffer(part(), "<u4"))
            planes.append(np.frombuffer(part(), np.uint8))
        return cls(n, planes, zeros, blocks), lengths


def _block(data: bytes) -> bytes:
    return struct.pack("<Q", len(data)) + data


def _block_counts(packed: np.ndarray) -> np.ndarray:
    step = BLOCK // 8
    ones = np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), step), dtype=np.int64) if len(packed) else np.zeros(0, np.int64)
    return np.concatenate([[0], np.cumsum(ones)])


_FILE = "part int, shard int, n_tokens long, doc_ids array<long>, payload binary"


def _build(path: str, end_id: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, keep=CHUNKS)
        levels = max(enc.tokenizer.get_vocab_size(), end_id + 1).bit_length()
        levels = 16 if levels <= 16 else levels
        end = np.uint32(end_id).tobytes()
        part, shard, held, ids, size = TaskContext.get().partitionId(), 0, [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal held, ids, size, shard
            lengths = np.array([len(x) // 4 for x in held])
            tokens = np.frombuffer(b"".join(held), "<u4")
            payload = WaveletMatrix.build(tokens, levels).to_bytes(lengths)
            arrays = [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(tokens)], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([payload], pa.binary())]
            held, ids, size, shard = [], [], 0, shard + 1
            return pa.RecordBatch.from_arrays(arrays, ["part", "shard", "n_tokens", "doc_ids", "payload"])

        for batch in batches:
            for rows in slices(batch):
                encoded = enc.encode_all([text or "" for text in rows["text"].to_pylist()])
                for i, own in zip(rows["doc_id"].to_pylist(), encoded, strict=True):
                    held.append(own + end)
                    ids.append(i)
                    size += len(held[-1]) // 4
                    if size >= shard_tokens:
                        yield close()
        if held:
            yield close()

    return run


def write_shards(docs: DataFrame, path: str, folder: str, end_id: int = END, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encodes ``docs`` and writes shard files, one a file, in ascending order of (part, shard)."""
    spark = docs.sparkSession
    ship(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row_key"), F.col("text").cast("string"))
    rows = rows.repartitionByRange(n, "doc_id", "row_key").sortWithinPartitions("doc_id", "row_key", "text").select("doc_id", "text")
    shards = rows.mapInArrow(_build(path, end_id, shard_tokens), _FILE)
    shards.write.option("maxRecordsPerFile", 1).option("compression", "none").parquet(folder)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            matrix, lengths = WaveletMatrix.from_bytes(batch["payload"][row].as_py())
            tokens = memoryview(matrix.tokens().astype("<u4").tobytes())
            ends = np.cumsum(lengths)
            starts = ends - lengths
            crc = [zlib.crc32(tokens[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            own = [pa.array(np.full(len(lengths), batch[c][row].as_py(), np.int32)) for c in ("part", "shard")]
            arrays = [*own, batch["doc_ids"][row].values, pa.array(starts), pa.array(lengths), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32"])


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, from the files."""
    ship(spark)
    files = spark.read.schema(_FILE).parquet(folder)
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    # one row a part, then the shards of each part
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before().orderBy("part")), F.lit(0)).alias("first"))
    within = files.select("part", "shard", F.coalesce(F.sum("n_tokens").over(before("part").orderBy("shard")), F.lit(0)).alias("within"))
    bases = within.join(F.broadcast(parts), "part").select("part", "shard", (F.col("first") + F.col("within")).alias("base"))
    read = files.select("part", "shard", "doc_ids", "payload").mapInArrow(_read, "part int, shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return read.join(bases, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{scratch_folder(spark, 'token-shards')}/files"
    write_shards(documents(spark, sf_dir), vocabulary_path(), folder)
    return read_shards(spark, folder)
