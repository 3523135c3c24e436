"""The permeability network of alpha-spheres: which neighbours a probe can pass between."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cavitas.functions.metrics import euclidean, passes_two, with_side_open
from cavitas.operators.geometry import KEYS
from cavitas.operators.joins import sphere_neighbors
from cavitas.session import cut

#: The node that stands for the outside.
OUTSIDE = -1


def faces(spheres: DataFrame, least: int = 2) -> DataFrame:
    """``*KEYS, i, j, face``: neighbours and the sorted contacts they share, at least ``least``."""
    criterion = {1: "point", 2: "edge", 3: "face"}[least]
    pairs = sphere_neighbors(spheres, criterion).drop("n_shared")
    side = lambda n: spheres.select(*KEYS, F.col("sphere_id").alias(n), F.col("contacts").alias(f"c{n}"))
    rows = pairs.join(side("i"), [*KEYS, "i"]).join(side("j"), [*KEYS, "j"])
    return rows.select(*KEYS, "i", "j", F.array_sort(F.array_intersect("ci", "cj")).alias("face"))


def _open_by_discs(faces: DataFrame, probe: float) -> DataFrame:
    """Keys and ``face`` of those whose ``discs`` let a probe through: two by their gap, three or four by a side of a triangle.

    A side is a row; sides of a face stay with it, so that counting them together shuffles nothing.
    """
    disc = lambda k: F.get("discs", F.lit(k))
    gap = lambda i, j: euclidean([disc(i)[c] for c in "xyz"], [disc(j)[c] for c in "xyz"])
    reach = lambda k: disc(k)["r"] + probe

    def side(i: int, j: int, k: int) -> Column:
        return F.struct(gap(i, j).alias("d"), gap(i, k).alias("e"), gap(j, k).alias("g"), reach(i).alias("ri"), reach(j).alias("rj"), reach(k).alias("rk"))

    triangle = lambda a, b, c: [side(a, b, c), side(a, c, b), side(b, c, a)]
    n = F.size("discs")
    two = faces.where((n == 2) & passes_two(gap(0, 1), disc(0)["r"], disc(1)["r"], probe)).select(*KEYS, "face")
    sides = F.when(n == 3, F.array(*triangle(0, 1, 2))).when(n == 4, F.array(*triangle(0, 1, 2), *triangle(0, 2, 3)))
    rows = with_side_open(faces.where(n > 2).select(*KEYS, "face", F.explode(sides).alias("s")).select(*KEYS, "face", "s.*"))
    return two.unionByName(rows.groupBy(*KEYS, "face").agg(F.max("open").alias("open")).where("open").select(*KEYS, "face"))


def _open_by_centroid(faces: DataFrame, probe: float) -> DataFrame:
    """Keys and ``face`` of those all of whose ``discs`` are farther from their middle than radius and probe."""
    mean = lambda c: F.aggregate(F.transform("discs", lambda p: p[c]), F.lit(0.0), lambda a, v: a + v) / F.size("discs")
    far = F.forall("discs", lambda p: euclidean([p[c] for c in "xyz"], [F.col(f"__{c}") for c in "xyz"]) >= p["r"] + probe)
    return faces.withColumns({f"__{c}": mean(c) for c in "xyz"}).where(far).select(*KEYS, "face")


def permeable_edges(spheres: DataFrame, atoms: DataFrame, probe: float, centroid: bool = False) -> DataFrame:
    """``*KEYS, i, j, face`` of the neighbours between which a probe passes.

    The shared atoms (two, three or four) let it through by their discs, or (``centroid``,
    three or more) by all being farther from their middle than radius and probe. ``atoms``
    has keys, ``point_index, x, y, z, radius``. Each distinct face is judged once.
    """
    rows = cut(faces(spheres, 3 if centroid else 2).where(F.size("face").between(2, 4) if not centroid else F.size("face") > 2))
    judged = rows.select(*KEYS, "face").distinct()
    at = judged.select(*KEYS, "face", F.explode("face").alias("point_index"))
    place = F.struct("point_index", *[F.col(c).cast("double").alias(c) for c in "xyz"], F.col("radius").cast("double").alias("r"))
    discs = at.join(atoms, [*KEYS, "point_index"]).groupBy(*KEYS, "face").agg(F.array_sort(F.collect_list(place)).alias("discs"))
    open_faces = (_open_by_centroid if centroid else _open_by_discs)(discs.where(F.size("discs") == F.size("face")), probe)
    out = rows.join(open_faces, [*KEYS, "face"]).select(*KEYS, "i", "j", "face")
    # by centroid, a face gives one edge
    return out.groupBy(*KEYS, "face").agg(F.min(F.struct("i", "j")).alias("e")).select(*KEYS, "e.i", "e.j", "face") if centroid else out
