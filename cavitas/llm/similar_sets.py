"""What the near-duplicate operators share: sets of shingles, sets of candidates, and links between similar classes.

Documents with one set of shingles are one class. An operator gives each class a print (of bits or registers) and keys;
the classes that share a key are a set. `join_sets` links what similar members of sets join, in work that grows with a
set's size and not its square: see there. `similar_classes` does so twice: by the prints, as the operator compares
them, and then, within what that joins, by the exact similarity of the sets of shingles (as 64-bit hashes).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cavitas.llm.common import gram_hashes, map_batches, mix, texts_of, word_bounds, word_hashes
from cavitas.operators.graph import connected_components, hot_join
from cavitas.session import cut, ship

SIMILARITY = 0.8
#: Members of a set that meet in a task: some 8 million comparisons at worst, a second or two.
BUCKET = 4096
#: Shingles (of 8 bytes) that meet in a task, in the exact judgement.
WEIGHT = 1 << 20
#: Rows of one key that a task holds; keys with more are spread.
STREAM = 1 << 17
#: Counters of the rows of keys, and of shingles.
COUNTERS, SHINGLE_COUNTERS = 1 << 18, 1 << 17
#: Rows a member that the members of a set outside its largest component may take to meet the others directly.
DIRECT = 4


def _words(data: bytes) -> np.ndarray:
    array = np.frombuffer(data.lower(), np.uint8)
    return word_hashes(array, *word_bounds(array))


def shingle_set(data: bytes, words: int) -> np.ndarray:
    """The distinct shingles, sorted; a text of fewer words is one shingle, none has none."""
    h = _words(data)
    return np.unique(gram_hashes(h, min(words, len(h)))) if len(h) else h


def set_name(values: np.ndarray) -> int:
    """A hash of a set of numbers."""
    return int(mix(np.array([mix(values.view(np.uint64)).sum(dtype=np.uint64) + np.uint64(len(values))], np.uint64)).view(np.int64)[0])


def _shingler(words: int):
    def make():
        def step(batch: pa.RecordBatch):
            sets = [shingle_set(data, words).tobytes() for data in texts_of(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(sets, pa.binary())], ["id", "set_of"])

        return step

    return make


def _shared(bucket: int):
    """Over batches sorted by key: (set, part, big, id) of keys with two ids or more, and two components if the rows have them.

    A set is named by its members, so that keys with the same ones give the same rows. Members of a
    set of over ``bucket`` are numbered in parts of so many.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, parts_of = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

        def settle(last: bool):
            nonlocal keys, ids, parts_of
            edges = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
            done = len(edges) - 1 if last else len(edges) - 2  # the last key may go on
            sets, members, parts = [], [], []
            for i in np.flatnonzero(np.diff(edges[: done + 1]) > 1).tolist():
                at = slice(edges[i], edges[i + 1])
                own = np.unique(ids[at])
                if len(own) > 1 and (parts_of[at] != parts_of[edges[i]]).any():
                    sets.append(np.full(len(own), set_name(own), np.int64))
                    members.append(own)
                    parts.append(np.arange(len(own)) // bucket if len(own) > bucket else np.full(len(own), -1))
            keys, ids, parts_of = (a[edges[done] :] for a in (keys, ids, parts_of))
            if sets:
                part = np.concatenate(parts)
                arrays = [np.concatenate(sets), np.maximum(part, 0), part >= 0, np.concatenate(members)]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["set", "part", "big", "id"])

        for batch in batches:
            keys = np.concatenate([keys, batch["key"].to_numpy(zero_copy_only=False)])
            ids = np.concatenate([ids, batch["id"].to_numpy(zero_copy_only=False)])
            of = batch["component" if "component" in batch.schema.names else "id"]
            parts_of = np.concatenate([parts_of, of.to_numpy(zero_copy_only=False)])
            if len(keys):
                yield from settle(False)
        if len(keys):
            yield from settle(True)

    return run


def key_sets(keyed: DataFrame, bucket: int = BUCKET, stream: int = STREAM) -> DataFrame:
    """``set, part, big, id``: the classes of ``keyed`` (key, id) that share a key, in parts of about ``bucket`` members.

    The rows of all keys are counted in ``COUNTERS`` counters; keys of a counter with over max(``stream``, a
    1 / 10,000 of all rows) are spread by member, and fewer than 10,000 counters can be such. The others are
    shuffled by key. If ``keyed`` has the ``component`` of each id, keys of a single one give no set.
    """
    columns = [c for c in ("key", "id", "component") if c in keyed.columns]
    keyed = keyed.withColumn("counter", F.pmod(F.xxhash64("key"), F.lit(COUNTERS)).cast("int"))
    counts = cut(keyed.groupBy("counter").agg(F.count("*").alias("rows")))
    total = counts.agg(F.sum("rows")).first()[0] or 0
    crowded = counts.where(F.col("rows") > max(stream, total // 10_000)).select("counter", F.ceil(F.col("rows") / bucket).alias("parts"))
    shared = "set long, part long, big boolean, id long"
    if crowded.isEmpty():
        return cut(keyed.select(*columns).repartition("key").sortWithinPartitions("key").mapInArrow(_shared(bucket), shared).distinct())
    few = keyed.join(F.broadcast(crowded.select("counter")), "counter", "left_anti").select(*columns)
    sets = few.repartition("key").sortWithinPartitions("key").mapInArrow(_shared(bucket), shared)
    spread = keyed.join(F.broadcast(crowded), "counter")
    if "component" in columns:
        mixed = spread.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("size")).where("a <> b").select("key", "size")
        spread = hot_join(spread, mixed, ["key"], "size", total)
    dealt = spread.select(F.col("key").alias("set"), F.pmod(F.xxhash64("id"), "parts").alias("part"), F.lit(True).alias("big"), "id")
    return cut(sets.unionByName(dealt).distinct())


#: Which rows are near the one at a place: of two arguments, a place and an array of others.
Near = Callable[[int, np.ndarray], np.ndarray]


def forest(ids: np.ndarray, near: Near) -> list[tuple[int, int]]:
    """Links that join what the pairs that ``near`` finds join: (id, earlier id)."""
    left = np.arange(len(ids))
    links = []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            at = todo.pop()
            hit = near(at, left)
            links += [(int(ids[k]), int(ids[at])) for k in left[hit]]
            todo += left[hit].tolist()
            left = left[~hit]
    return links


def _sizes_fit(sizes: np.ndarray, similarity: float) -> Near:
    return lambda at, others: np.minimum(sizes[others], sizes[at]) >= similarity * np.maximum(sizes[others], sizes[at]) - 1e-9


def _similar(sets: list[np.ndarray], sizes: np.ndarray, similarity: float) -> Near:
    """A check by exact Jaccard similarity; two empty sets are equal."""

    def check(at: int, others: np.ndarray) -> np.ndarray:
        out = np.ones(len(others), bool)
        own = sets[at]
        if len(own) and len(others):
            all_ = np.concatenate([sets[k] for k in others])
            hit = own[np.minimum(np.searchsorted(own, all_), len(own) - 1)] == all_
            common = np.add.reduceat(hit, np.cumsum(sizes[others]) - sizes[others], dtype=np.int64)
            out = common >= similarity * (len(own) + sizes[others] - common) - 1e-9
        return out

    return check


def _in_turn(checks: list[Near]) -> Near:
    """All of the checks, each of what the ones before let through."""

    def near(at: int, others: np.ndarray) -> np.ndarray:
        kept = np.arange(len(others))
        for check in checks:
            if len(kept):
                kept = kept[check(at, others[kept])]
        out = np.zeros(len(others), bool)
        out[kept] = True
        return out

    return near


def _judge(similarity: float, alike: Callable[[list[bytes], np.ndarray], Near], exact: bool):
    """Over batches sorted by block: the links of each block, by the prints alone or by the sets too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def settle():
            ids, first = np.unique(np.array([r[1] for r in held], np.int64), return_index=True)
            sizes = np.array([held[k][2] for k in first])
            checks = [_sizes_fit(sizes, similarity), alike([held[k][3] for k in first], sizes)]
            if exact:
                checks.append(_similar([np.frombuffer(held[k][4], np.uint64) for k in first], sizes, similarity))
            found = forest(ids, _in_turn(checks))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found]), pa.array([b for _, b in found])], ["src", "dst"])

        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("block", "id", "n", "print", *(["set_of"] if exact else []))), strict=True):
                if held and held[-1][0] != row[0]:
                    yield from settle()
                    held = []
                held.append(row)
        if held:
            yield from settle()

    return run


def join_sets(members: DataFrame, judge: Callable[[DataFrame], DataFrame], limit: int, refine: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``src, dst``: links that join what the pairs that ``judge`` finds within each set join.

    ``members`` has ``set, part, big, id`` and a weight ``w``, of which a part has about ``limit`` at most; a set that
    is not big is one part. ``judge`` takes ``block, id`` and links within a block. First, sets that are not
    big meet, and each member of big ones meets the part of its largest set that it is in, with that set's least member. What this joins
    need not meet again. So of a big set those that are not in its largest component have yet to meet
    that component (once for all sets that have it) and each other. They do so directly if that takes ``DIRECT`` rows a member
    at most. If it takes more, ``refine`` gives finer members (``set, part, big, id, w``) of the ids in
    question (``id, component``), in which any two similar ones of different components share a set, and these are joined in turn; without ``refine``, or
    within its sets, all meet directly.
    """
    block = F.xxhash64("set", "part").alias("block")
    big = members.where("big")
    total = big.count()
    small = members.where("NOT big").select(block, "id")
    if not total:
        return cut(judge(small))
    sizes = big.groupBy("set").agg(F.count("*").alias("size"), F.count("*").alias("members"))
    ranked = hot_join(big.select("set", "part", "id"), sizes, ["set"], "size", total)
    chosen = cut(ranked.groupBy("id").agg(F.max(F.struct("members", "set", "part")).alias("c")).select("id", "c.set", "c.part"))
    pivots = chosen.select("set", "part").distinct().join(chosen.groupBy("set").agg(F.min("id").alias("id")), "set")
    found = cut(judge(small.unionByName(chosen.select(block, "id")).unionByName(pivots.select(block, "id"))))
    named = connected_components(found).select(F.col("node").alias("id"), "component")
    placed = cut(big.select("set", "id", "w").join(named, "id", "left").withColumn("component", F.coalesce("component", "id")))
    by_component = placed.groupBy("set", "component").count()
    largest = by_component.groupBy("set").agg(F.max(F.struct("count", "component")).alias("top"), F.sum("count").alias("size"))
    largest = largest.where(F.col("size") > F.col("top.count")).select("set", F.col("top.component").alias("family"), "size")
    still = cut(hot_join(placed, largest, ["set"], "size", total).select("family", "id", "w", (F.col("component") == F.col("family")).alias("core"), "component").distinct())
    if still.isEmpty():
        return found
    parts = lambda rows: F.greatest(F.ceil(F.sum(F.when(rows, F.col("w"))) / limit), F.lit(1)).cast("long")
    families = still.groupBy("family").agg(parts(F.col("core")).alias("cores"), parts(~F.col("core")).alias("rests"), F.count("*").alias("size"), F.count_if(~F.col("core")).alias("others"))
    rows = F.col("rests") * (F.col("size") - F.col("others")) + F.col("cores") * F.col("others") + F.when(F.col("rests") > 1, F.col("rests") * F.col("others")).otherwise(0)
    families = cut(families.withColumn("direct", F.lit(refine is None) | (rows <= DIRECT * F.col("size"))))
    finer = families.where("NOT direct")
    if not finer.isEmpty():
        ids = hot_join(still, finer.select("family", "size"), ["family"], "size", total).select("id", "component").distinct()
        found = found.unionByName(join_sets(refine(ids), judge, limit))
    families = families.where("direct").drop("direct", "others")
    met = hot_join(still, families, ["family"], "size", total).withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("core"), F.col("cores")).otherwise(F.col("rests"))))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    pair = lambda a, b: F.xxhash64("family", a, b).alias("block")
    core = met.where("core").select("family", "id", "own", upto("rests").alias("b")).select(pair("own", "b"), "id")
    rest = met.where("NOT core").select("family", "id", "own", upto("cores").alias("a")).select(pair("a", "own"), "id")
    among = met.where("NOT core AND rests > 1").select("family", "id", "own", upto("rests").alias("b"))
    among = among.select(pair(-1 - F.least("own", "b"), -1 - F.greatest("own", "b")), "id")
    return found.unionByName(judge(core.unionByName(rest).unionByName(among)))


def sorted_blocks(rows: DataFrame) -> DataFrame:
    return rows.repartition("block").sortWithinPartitions("block")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SHINGLE_COUNTERS, np.int64)
    for batch in batches:
        for data in batch["set_of"].to_pylist():
            np.add.at(total, (np.frombuffer(data, np.uint64) % SHINGLE_COUNTERS).astype(np.int64), 1)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["counter", "n"])


def rare_shingles(sets: DataFrame, similarity: float) -> DataFrame:
    """``key, id, component``: of each set (id, component, set_of) the rarest shingles, so many that any two similar sets share one of them.

    Sets of n and more shingles with similarity s have ceil(s n) in common, so the first
    n - ceil(s n) + 1 of both in one order of all shingles have one in common. Any order will do; the
    order by how many shingles fall into a shingle's counter (``SHINGLE_COUNTERS`` of them, 1 MB) puts the common ones last.
    """
    ship(sets.sparkSession)
    counts = np.zeros(SHINGLE_COUNTERS, np.int64)
    for r in sets.mapInArrow(_counted, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).collect():  # SHINGLE_COUNTERS rows at most
        counts[r["counter"]] = r["n"]
    shared = sets.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            for id_, part, data in zip(*(batch[c].to_pylist() for c in ("id", "component", "set_of")), strict=True):
                own = np.frombuffer(data, np.uint64)
                n = len(own) - ceil(similarity * len(own) - 1e-9) + 1 if len(own) else 0
                first = own[np.lexsort((own, counts[(own % SHINGLE_COUNTERS).astype(np.int64)]))[:n]]
                more = [pa.array(np.full(len(first), x, np.int64)) for x in (id_, part)]
                yield pa.RecordBatch.from_arrays([pa.array(first.view(np.int64)), *more], ["key", "id", "component"])

    return sets.mapInArrow(run, "key long, id long, component long")


#: Bits of the bitmap of rows that are looked for, 1 MB.
LOOKUP_BITS = 1 << 23


def only_named(rows: DataFrame, names: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` without most of those whose ``on`` is not in ``names``, by a bitmap of hashes that is broadcast: ``LOOKUP_BITS`` bits, however many names."""
    place = F.pmod(F.xxhash64(*on), F.lit(LOOKUP_BITS))
    parts = F.bitmap_bucket_number(place).alias("__part")  # of 32,768 bits
    maps = names.groupBy(parts).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("__bits"))
    byte = F.conv(F.hex(F.substring("__bits", (F.col("__bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    named = rows.withColumn("__part", F.bitmap_bucket_number(place)).withColumn("__bit", F.bitmap_bit_position(place))
    return named.join(F.broadcast(maps), "__part").where(F.getbit(byte, (F.col("__bit") % 8).cast("int")) == 1).drop("__part", "__bit", "__bits")


def similar_classes(docs: DataFrame, prints: DataFrame, keys: Callable[[DataFrame], DataFrame], alike: Callable[[list[bytes], np.ndarray], Near], words: int, similarity: float = SIMILARITY, bucket: int = BUCKET, stream: int = STREAM, weight: int = WEIGHT) -> DataFrame:
    """``src, dst``: links between classes with similar shingles, which join what the similar pairs join.

    ``prints`` has a row a document of ``docs`` that takes part: ``doc_id, row_key`` (text hash), ``id`` of its class, ``n`` shingles, a ``print`` and
    what ``keys`` needs to give ``key, id`` of classes. ``alike`` compares prints. No link is under ``similarity``, and none that the keys bring together is lost.
    """
    more = [c for c in prints.columns if c not in ("doc_id", "row_key", "id")]
    classes = cut(prints.groupBy("id").agg(*[F.first(c).alias(c) for c in more], F.min(F.struct("doc_id", "row_key")).alias("first")))
    bits = classes.select("id", "n", "print")
    texts = docs.select(F.col("doc_id").cast("long").alias("own_id"), F.xxhash64("text").alias("own_key"), "text")

    def sets_of(ids: DataFrame) -> DataFrame:
        on = ["own_id", "own_key"]
        chosen = cut(ids.join(classes.select("id", "first"), "id").select("id", F.col("first.doc_id").alias("own_id"), F.col("first.row_key").alias("own_key")))
        found = only_named(texts, chosen, on).join(chosen, on).select("id", "text")
        return map_batches(found, _shingler(words), "id long, set_of binary").dropDuplicates(["id"])

    def refine(ids: DataFrame, by: Callable[[DataFrame], DataFrame] = sets_of) -> DataFrame:
        return key_sets(rare_shingles(cut(by(ids.select("id")).join(ids, "id")), similarity), bucket, stream)

    def filtered(met: DataFrame) -> DataFrame:
        return sorted_blocks(met.join(bits, "id")).mapInArrow(_judge(similarity, alike, False), "src long, dst long")

    near = cut(join_sets(key_sets(keys(classes), bucket, stream).withColumn("w", F.lit(1)), filtered, bucket, lambda ids: refine(ids).withColumn("w", F.lit(1))).distinct())
    # what the filter joins meets once more, with the sets of shingles of these classes alone
    joined = connected_components(near).select(F.col("node").alias("id"), F.col("component").alias("set"))
    joined = cut(joined.join(classes.select("id", "n"), "id"))

    def dealt(rows: DataFrame) -> DataFrame:
        """``set, part, big, id, w`` of rows (set, id, n), in parts of about ``weight`` shingles."""
        rows = cut(rows.select("set", "id", F.greatest("n", F.lit(-(-weight // bucket))).alias("w")))
        sizes = rows.groupBy("set").agg(F.count("*").alias("size"), F.ceil(F.sum("w") / weight).alias("parts"))
        named = hot_join(rows, sizes, ["set"], "size", rows.count())
        return named.select("set", F.pmod(F.xxhash64("id"), "parts").alias("part"), (F.col("parts") > 1).alias("big"), "id", "w")

    sets = cut(sets_of(joined.select("id")).join(bits, "id"))

    def exact(met: DataFrame) -> DataFrame:
        return sorted_blocks(met.join(sets, "id")).mapInArrow(_judge(similarity, alike, True), "src long, dst long")

    def finer(ids: DataFrame) -> DataFrame:
        found = refine(ids, lambda x: sets.join(x, "id").select("id", "set_of"))
        return dealt(found.select("set", "id").distinct().join(bits.select("id", "n"), "id"))

    return join_sets(dealt(joined), exact, weight, finer).distinct()
