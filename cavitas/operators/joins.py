"""Joins by shared keys and by distance, without comparing all pairs."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cavitas.functions.checks import ArgumentError, one_of
from cavitas.functions.metrics import METRICS, cityblock, correlation, euclidean, squared
from cavitas.session import cut

#: Shared contacts that make two spheres neighbours.
CRITERIA = {"point": 1, "edge": 2, "face": 3}


#: Rows of a key that one task takes from each side, and keys an item may have, for each that it must share, to meet by its rarest.
BLOCK, SHORT = 4_000, 2


def _met(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """``left`` (item ``i``) and ``right`` (item ``j``) joined on a key that ``__n`` rows have.

    A key of more than ``BLOCK`` rows is dealt in blocks by hash of the item: a block of the left and one of the
    right meet in a task, each pair of rows once.
    """
    blocks = F.ceil(F.col("__n") / BLOCK).cast("long")
    all_of = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    left = left.select("*", F.pmod(F.xxhash64("i"), blocks).alias("__a"), all_of.alias("__b")).drop("__n")
    right = right.select("*", F.pmod(F.xxhash64("j"), blocks).alias("__b"), all_of.alias("__a")).drop("__n")
    return left.join(right, [*on, "__a", "__b"]).drop("__a", "__b")


def shared_key_pairs(items: DataFrame, item: str, key: str, least: int = 1, keys: tuple[str, ...] = (), mirrored: bool = False) -> DataFrame:
    """Pairs of items that share at least ``least`` distinct keys: ``*keys, i, j, n_shared`` with i < j.

    ``items`` has one row an item and key; rows without either do not count. The inverted index is an equi-join on the
    key. Items that share ``least`` of n keys share one of the n - ``least`` + 1 rarest of each: where ``least`` is two or
    more, items with at most ``SHORT * least`` keys meet by these only (a prefix filter) and compare their whole lists;
    longer ones, which would leave out little, meet all others by all keys. ``mirrored`` adds the pairs turned round.
    """
    k = list(keys)
    on = [*k, "key"]
    rows = cut(items.select(*k, F.col(item).alias("i"), F.col(key).alias("key")).where("i IS NOT NULL AND key IS NOT NULL").distinct())
    by_key = rows.groupBy(*on).agg(F.count("*").alias("__n"))
    crowded = (by_key.agg(F.max("__n")).first()[0] or 0) > BLOCK

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnRenamed("i", "j")
        return _met(left.join(by_key, on), right.join(by_key, on), on) if crowded else left.join(right, on)

    if least == 1:
        parts = [_counted(met(rows, rows).where("i < j"), k, 1)]
    else:
        sizes = rows.groupBy(*k, "i").agg(F.count("*").alias("__size")).where(F.col("__size") >= least)
        short = F.col("__size") <= SHORT * least
        some_short, some_long = sizes.agg(F.bool_or(short), F.bool_or(~short)).first()
        parts = []
        if some_long:
            long = rows.join(sizes.where(~short), [*k, "i"], "left_semi") if some_short else rows
            rest = rows.join(sizes.withColumn("__long", ~short).drop("__size"), [*k, "i"]) if some_short else rows.withColumn("__long", F.lit(True))
            found = met(long, rest).where("NOT __long OR i < j")
            parts.append(_counted(found.select(*k, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")), k, least))
        if some_short or not some_long:
            near = rows.join(sizes.where(short), [*k, "i"], "left_semi") if some_long else rows
            parts.append(_by_rarest(near.join(by_key, on), k, least))
    pairs = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if mirrored:
        pairs = pairs.unionByName(pairs.select(*k, F.col("j").alias("i"), F.col("i").alias("j"), "n_shared"))
    return pairs


def _counted(met: DataFrame, k: list[str], least: int) -> DataFrame:
    return met.groupBy(*k, "i", "j").agg(F.count("*").alias("n_shared")).where(F.col("n_shared") >= least)


def _by_rarest(rows: DataFrame, k: list[str], least: int) -> DataFrame:
    """Pairs of items of a bounded number of keys, each found at the rarest key that both have."""
    lists = rows.groupBy(*k, "i").agg(F.sort_array(F.collect_list(F.struct("__n", "key"))).alias("__all")).where(F.size("__all") >= least)
    first = lists.select(*k, "i", F.col("__all.key").alias("__list"), F.explode(F.slice("__all", F.lit(1), F.size("__all") - (least - 1))).alias("__one"))
    first = first.select(*k, "i", "__list", F.col("__one.key").alias("key"), F.col("__one.__n").alias("__n"))
    met = _met(first, first.withColumnsRenamed({"i": "j", "__list": "__other"}), [*k, "key"]).where("i < j")
    shared = met.withColumn("__both", F.array_intersect("__list", "__other"))
    return shared.where((F.col("__both")[0] == F.col("key")) & (F.size("__both") >= least)).select(*k, "i", "j", F.size("__both").cast("long").alias("n_shared"))


def sphere_neighbors(spheres: DataFrame, criterion: str = "edge", mirrored: bool = False) -> DataFrame:
    """Pairs of alpha-spheres of a structure that share a point, an edge or a face."""
    least = CRITERIA[one_of(criterion, CRITERIA, "criterion")]
    touch = spheres.select("system_id", "structure_index", "sphere_id", F.explode("contacts").alias("point"))
    return shared_key_pairs(touch, "sphere_id", "point", least, ("system_id", "structure_index"), mirrored)


def _cells(df: DataFrame, xyz: list[str], size: Column | float) -> DataFrame:
    return df.withColumns({f"__b{n}": F.floor(F.col(c) / size).cast("long") for n, c in enumerate(xyz)})


def _half(reach: int) -> list[tuple[int, int, int]]:
    """A cell and those after it up to ``reach`` cells away: with these, each two such cells meet once."""
    side = range(-reach, reach + 1)
    return [(0, 0, 0), *((x, y, z) for x in side for y in side for z in side if (x, y, z) > (0, 0, 0))]


_HALF = _half(1)


def _candidates(rows: DataFrame, keys: list[str], xyz: list[str], cell: float, steps: list[tuple[int, int, int]] = _HALF, crowd: DataFrame | None = None) -> DataFrame:
    """Pairs of rows in cells that are one of ``steps`` apart, each once; the other side's columns get ``r_``.

    ``crowd`` has the cells of over `BLOCK` rows, with their number in ``__n``: fewer than one a `BLOCK` rows, sent to every task. The
    other side of such a cell is dealt in blocks by hash, and all that look into the cell look into each block.
    """
    bins = [f"__b{n}" for n in range(3)]
    here = _cells(rows, xyz, cell)
    near = here.withColumn("__step", F.explode(_steps(steps)))
    near = near.withColumns({b: F.col(b) + F.col(f"__step.{b}") for b in bins}).withColumn("__own", F.col("__step") == _steps([(0, 0, 0)])[0]).drop("__step")
    there, on = here.withColumnsRenamed({c: f"r_{c}" for c in rows.columns if c not in keys}), [*keys, *bins]
    if crowd is not None:
        blocks = F.coalesce(F.ceil(F.col("__n") / BLOCK), F.lit(1)).cast("long")
        near = near.join(F.broadcast(crowd), on, "left").withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).drop("__n")
        there = there.join(F.broadcast(crowd), on, "left").withColumn("__block", F.pmod(F.xxhash64("r_i"), blocks)).drop("__n")
        on = [*on, "__block"]
    return near.join(there, on).where("IF(__own, i < r_i, i <> r_i)").drop(*on[len(keys) :], "__own")


def _within(rows: DataFrame, keys: list[str], xyz: list[str], radius: float, added: bool = False) -> DataFrame:
    """`_candidates` for a radius. If a cell of the radius has over `BLOCK` rows, cells are half as wide, and those that still have are dealt in blocks.

    ``added``: distances along the axes add up, so half cells with a whole one between them in two directions are too far apart.
    """
    on = [*keys, *[f"__b{n}" for n in range(3)]]
    count = lambda cell: _cells(rows, xyz, cell).groupBy(*on).agg(F.count("*").alias("__n"))
    if (count(radius).agg(F.max("__n")).first()[0] or 0) <= BLOCK:
        return _candidates(rows, keys, xyz, radius)
    cell = radius / 2 * (1 + 1e-9)
    steps = [s for s in _half(2) if not added or sum(abs(x) == 2 for x in s) < 2]
    return _candidates(rows, keys, xyz, cell, steps, count(cell).where(F.col("__n") > BLOCK))


def _in_order(pairs: DataFrame, keys: list[str], *more: str, carry: tuple[str, ...] = ()) -> DataFrame:
    first = F.col("i") <= F.col("r_i")
    carried = [F.when(first, a).otherwise(F.col(b)).alias(f"{c}_{end}") for c in carry for end, a, b in (("i", F.col(c), f"r_{c}"), ("j", F.col(f"r_{c}"), c))]
    return pairs.select(*keys, F.least("i", "r_i").alias("i"), F.greatest("i", "r_i").alias("j"), *more, *carried)


def distance_pairs(
    points: DataFrame,
    radius: float,
    item: str = "point_index",
    xyz: tuple[str, str, str] = ("x", "y", "z"),
    keys: tuple[str, ...] = ("system_id", "structure_index"),
    metric: str = "e",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Pairs at most ``radius`` apart (inclusive): ``*keys, i, j, distance`` with i < j.

    ``carry`` names columns of the points that come along, as ``c_i`` and ``c_j``: pairs, which grow with the square of the density, need not
    be joined again. Points meet in a grid of cells of the radius: an equi-join on the cell, with one side in its own and the
    13 cells after it. Crowded cells are halved and dealt in blocks, so that no task holds more than `BLOCK` rows of a key; pairs are never shuffled. City-block distance is never below the Euclidean, so the same grid holds it. A
    correlation distance c is half the squared distance of the centred points on the unit sphere, which meet in a grid of
    cells of the root of 2 c; points without spread have none.
    """
    if radius <= 0:
        raise ArgumentError(f"radius: a positive number is needed, not {radius!r}")
    k, c = list(keys), list(xyz)
    rows = points.select(*k, F.col(item).alias("i"), *[F.col(x).cast("double").alias(x) for x in c], *carry)
    if METRICS.get(metric) is correlation:
        middle = sum((F.col(x) for x in c[1:]), F.col(c[0])) / len(c)
        size = F.sqrt(sum(((F.col(x) - middle) ** 2 for x in c[1:]), (F.col(c[0]) - middle) ** 2))
        unit = [f"__u{n}" for n in range(len(c))]
        rows = rows.where(size > 0).withColumns({u: (F.col(x) - middle) / size for u, x in zip(unit, c, strict=True)})
        pairs = _within(rows, k, unit, sqrt(2 * radius) * (1 + 1e-9))
    else:
        pairs = _within(rows, k, c, radius, METRICS.get(metric) is cityblock)
    measure = METRICS.get(metric, euclidean)
    distance = measure([F.col(x) for x in c], [F.col(f"r_{x}") for x in c])
    return _in_order(pairs.withColumn("distance", distance).where(F.col("distance") <= radius), k, "distance", carry=carry)


#: Size classes of balls: each holds radii down to half of its largest, the last all that are smaller.
CLASSES = 20
_FULL = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)]


def _steps(steps: list[tuple[int, int, int]]) -> Column:
    return F.array(*[F.struct(*[F.lit(s).alias(f"__b{n}") for n, s in enumerate(step)]) for step in steps])


def overlap_pairs(discs: DataFrame, max_radius: float, item: str = "point_index", radius: str = "radius", xyz=("x", "y", "z"), keys=("system_id", "structure_index")) -> DataFrame:
    """Pairs of balls that overlap (distance below the sum of the radii); none has over ``max_radius``.

    Each class of sizes has a grid of its own, with cells as wide as its largest balls. A ball stands in the grid of its
    class and looks into that and into those of larger classes that occur, so that one large ball does not
    widen the cells of small ones.
    """
    k, c, bins = list(keys), list(xyz), [f"__b{n}" for n in range(3)]
    r = F.col("r")
    level = F.when(r > 0, F.greatest(F.lit(0), F.least(F.lit(CLASSES), F.floor(F.log2(F.lit(float(max_radius)) / r))))).otherwise(CLASSES).cast("int")
    rows = discs.select(*k, F.col(item).alias("i"), F.col(radius).alias("r"), *[F.col(x).cast("double").alias(x) for x in c]).withColumn("__level", level)
    there = _cells(rows, c, _width(max_radius))
    there = there.withColumnsRenamed({x: f"r_{x}" for x in ["i", "r", *c]})
    seen = rows.agg(F.collect_set("__level")).scalar()
    near = rows.withColumn("__own", F.col("__level")).withColumn("__level", F.explode(F.array_intersect(seen, F.sequence(F.lit(0), F.col("__own")))))
    near = _cells(near, c, _width(max_radius)).withColumn("__own", F.col("__own") == F.col("__level"))
    near = near.withColumn("__step", F.explode(F.when(F.col("__own"), _steps(_HALF)).otherwise(_steps(_FULL))))
    near = near.withColumn("__own", F.col("__own") & (F.col("__step") == _steps([(0, 0, 0)])[0]))
    near = near.withColumns({b: F.col(b) + F.col(f"__step.{b}") for b in bins}).drop("__step")
    total = r + F.col("r_r")
    apart = squared([F.col(x) for x in c], [F.col(f"r_{x}") for x in c])
    met = near.join(there, [*k, "__level", *bins]).where("NOT __own OR i < r_i")
    return _in_order(met.where(apart < total * total), k)


def _width(max_radius: float) -> Column:
    """Width of a cell of the grid of class ``__level``."""
    return F.lit(2 * max_radius * (1 + 1e-9)) * F.pow(F.lit(0.5), F.col("__level"))


#: Pairs of points that two cells may bring to a comparison of each with each, and times that a cell is halved.
PAIRS, HALVINGS = 1_000_000, 20


def group_contacts(points: DataFrame, radius: float, group: str, least: int = 1, item: str = "point_index", xyz=("x", "y", "z"), keys=("system_id", "structure_index")) -> DataFrame:
    """Pairs of groups with at least ``least`` pairs of members within ``radius``: ``*keys, a, b, n_pairs`` with a < b.

    Groups smaller than ``least`` do not count. Where no cell of the radius is crowded, points meet in these cells. Else cells meet
    as boxes around their points: boxes too far apart are dropped, boxes wholly within the radius count by the product of their groups' sizes, and boxes
    with few points are compared point by point. What is left is halved in each direction, a job a halving.
    """
    k, c = list(keys), list(xyz)
    large = points.groupBy(*k, group).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).drop("__n")
    live = cut(points.join(large, [*k, group]).select(*k, F.col(item).alias("i"), F.col(group).alias("g"), *[F.col(x).cast("double").alias(x) for x in c]))
    bins, other = [f"__b{n}" for n in range(3)], [f"r___b{n}" for n in range(3)]
    close = squared([F.col(x) for x in c], [F.col(f"r_{x}") for x in c]) <= radius * radius
    most = _cells(live, c, radius).groupBy(*k, *bins).count().agg(F.max("count")).first()[0]
    if (most or 0) ** 2 <= PAIRS:
        return _by_group(_candidates(live, k, c, radius).where("g <> r_g").where(close), k, F.count("*")).where(F.col("n_pairs") >= least)
    counts, left = [], None
    for halved in range(HALVINGS + 1):
        live = _cells(live.drop(*bins), c, radius / 2**halved)
        box = live.groupBy(*k, *bins).agg(F.count("*").alias("n"), *[f(x).alias(f"{side}{x}") for x in c for f, side in ((F.min, "lo_"), (F.max, "hi_"))])
        there = box.withColumnsRenamed({x: f"r_{x}" for x in box.columns if x not in k})
        if left is None:
            met = _beside(box.withColumn("__step", F.explode(_steps(_HALF))), there, k, bins, other)
        else:
            met = _halves(left, box, there, k, bins, other)
        met, own = _judged(met, c, radius), " AND ".join(f"{a} = {b}" for a, b in zip(bins, other, strict=True))
        small = F.lit(halved == HALVINGS) | (F.col("n") * F.col("r_n") <= PAIRS)
        met = cut(met.where("verdict <> 'far'").withColumn("verdict", F.when((F.col("verdict") == "open") & small, "points").otherwise(F.col("verdict"))).select(*k, *bins, *other, "verdict", F.expr(own).alias("own")))
        size = live.groupBy(*k, *bins, "g").agg(F.count("*").alias("m"))
        whole = met.where("verdict = 'near'").join(size, [*k, *bins]).join(_far(size, k), [*k, *other])
        counts.append(_by_group(whole.where("IF(own, g < r_g, g <> r_g)"), k, F.sum(F.col("m") * F.col("r_m"))))
        single = met.where("verdict = 'points'").join(live, [*k, *bins]).join(_far(live, k), [*k, *other])
        counts.append(_by_group(single.where("IF(own, i < r_i, true) AND g <> r_g").where(close), k, F.count("*")))
        left = met.where("verdict = 'open'").drop("verdict", "own")
        if halved == HALVINGS or left.isEmpty():
            break
        open_cells = left.select(*k, *bins).union(left.select(*k, *other)).distinct()
        live = live.join(open_cells, [*k, *bins], "left_semi")
    total = counts[0]
    for more in counts[1:]:
        total = total.unionByName(more)
    return total.groupBy(*k, "a", "b").agg(F.sum("n_pairs").alias("n_pairs")).where(F.col("n_pairs") >= least)


def _far(rows: DataFrame, k: list[str]) -> DataFrame:
    return rows.withColumnsRenamed({x: f"r_{x}" for x in rows.columns if x not in k})


def _by_group(rows: DataFrame, k: list[str], number: Column) -> DataFrame:
    return rows.groupBy(*k, F.least("g", "r_g").alias("a"), F.greatest("g", "r_g").alias("b")).agg(number.alias("n_pairs"))


def _beside(box: DataFrame, there: DataFrame, k: list[str], bins: list[str], other: list[str]) -> DataFrame:
    """Boxes with those of the same and of neighbouring cells, each pair once."""
    near = box.withColumns({r: F.col(b) + F.col(f"__step.{b}") for b, r in zip(bins, other, strict=True)}).drop("__step")
    return near.join(there, [*k, *other])


def _halves(left: DataFrame, box: DataFrame, there: DataFrame, k: list[str], bins: list[str], other: list[str]) -> DataFrame:
    """Pairs of halved boxes within the pairs of ``left``, each once."""
    up = [f"__up{n}" for n in range(3)]
    pairs = left.withColumnsRenamed({**dict(zip(bins, up, strict=True)), **{o: f"r{u}" for o, u in zip(other, up, strict=True)}})
    ours = box.withColumns({u: F.shiftright(b, 1) for u, b in zip(up, bins, strict=True)})
    theirs = there.withColumns({f"r{u}": F.shiftright(o, 1) for u, o in zip(up, other, strict=True)})
    met = pairs.join(ours, [*k, *up]).join(theirs, [*k, *[f"r{u}" for u in up]])
    same = " AND ".join(f"{u} = r{u}" for u in up)
    return met.where(f"NOT ({same}) OR struct({', '.join(bins)}) <= struct({', '.join(other)})").drop(*up, *[f"r{u}" for u in up])


def _judged(met: DataFrame, c: list[str], radius: float) -> DataFrame:
    """``verdict``: far, near (each point within the radius of each) or open, with room for rounding; boxes of one place exactly."""
    zero, square = F.lit(0.0), radius * radius
    gap = [F.greatest(zero, F.col(f"r_lo_{x}") - F.col(f"hi_{x}"), F.col(f"lo_{x}") - F.col(f"r_hi_{x}")) for x in c]
    span = [F.greatest(F.col(f"r_hi_{x}") - F.col(f"lo_{x}"), F.col(f"hi_{x}") - F.col(f"r_lo_{x}")) for x in c]
    least, most = (sum((d * d for d in side[1:]), side[0] * side[0]) for side in (gap, span))
    place = F.lit(True)
    for x in c:
        place &= (F.col(f"lo_{x}") == F.col(f"hi_{x}")) & (F.col(f"r_lo_{x}") == F.col(f"r_hi_{x}"))
    exact = squared([F.col(f"lo_{x}") for x in c], [F.col(f"r_lo_{x}") for x in c]) <= square
    verdict = F.when(place, F.when(exact, "near").otherwise("far")).when(least > square * (1 + 1e-9), "far").when(most <= square * (1 - 1e-9), "near").otherwise("open")
    return met.withColumn("verdict", verdict)


__all__ = ["cityblock", "correlation", "distance_pairs", "euclidean", "group_contacts", "overlap_pairs", "shared_key_pairs", "sphere_neighbors"]
