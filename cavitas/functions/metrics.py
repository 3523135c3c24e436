"""Distances and permeability of probe discs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Element radii in Å.
ELEMENT_RADII = {"C": 1.7, "H": 1.1, "O": 1.52, "N": 1.55, "P": 1.8, "S": 1.8}


def element_radius(element: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in ELEMENT_RADII.items() for x in pair]), element)


def squared(a: list[Column], b: list[Column]) -> Column:
    return sum(((x - y) * (x - y) for x, y in zip(a[1:], b[1:], strict=True)), (a[0] - b[0]) * (a[0] - b[0]))


def euclidean(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(squared(a, b))


def cityblock(a: list[Column], b: list[Column]) -> Column:
    return sum((F.abs(x - y) for x, y in zip(a[1:], b[1:], strict=True)), F.abs(a[0] - b[0]))


def correlation(a: list[Column], b: list[Column]) -> Column:
    """1 - Pearson's correlation over the coordinates; null if either has no spread."""
    total = lambda v: sum(v[1:], v[0])
    ma, mb = total(a) / len(a), total(b) / len(b)
    da, db = [x - ma for x in a], [x - mb for x in b]
    size = F.sqrt(total([x * x for x in da]) * total([x * x for x in db]))
    return F.when(size > 0, 1 - total([x * y for x, y in zip(da, db, strict=True)]) / size)


METRICS = {"e": euclidean, "b": cityblock, "c": correlation}


def passes_two(distance: Column, r1: Column, r2: Column, probe) -> Column:
    """A probe fits between two discs."""
    return distance >= r1 + r2 + 2 * probe


def passes_centroid(centres: list[np.ndarray], radii: list[np.ndarray], probe) -> np.ndarray:
    """All atoms are farther from their centroid than their radius and the probe."""
    middle = sum(centres) / len(centres)
    return np.all([np.linalg.norm(c - middle, axis=1) >= r + probe for c, r in zip(centres, radii, strict=True)], axis=0)


def flattened(c1: np.ndarray, c2: np.ndarray, c3: np.ndarray) -> np.ndarray:
    """Triangles of space in the plane: shape (3, n, 2), the first at the origin, the second on the x axis."""
    a, b = c2 - c1, c3 - c1
    d12 = np.linalg.norm(a, axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        x = np.where(d12 > 0, (a * b).sum(axis=1) / d12, 0)
    y = np.sqrt(np.maximum((b * b).sum(axis=1) - x * x, 0))
    zero = np.zeros(len(d12))
    return np.stack([np.stack([zero, zero], 1), np.stack([d12, zero], 1), np.stack([x, y], 1)])


def _in_triangle(p: np.ndarray, corners: np.ndarray) -> np.ndarray:
    cross = lambda u, v: u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]
    area = np.abs(cross(corners[1] - corners[0], corners[2] - corners[0]))
    parts = sum(np.abs(cross(corners[i] - p, corners[(i + 1) % 3] - p)) for i in range(3))
    return parts <= area * (1 + 1e-9) + 1e-12


def passes_three(c1, c2, c3, r1, r2, r3, probe) -> np.ndarray:
    """A probe fits through the triangle of three discs, all arrays of n.

    For each side: a probe that touches either end's disc on the side (if the side
    lets it pass) or both discs at once within the triangle must clear the third disc.
    """
    corners = flattened(np.asarray(c1, float), np.asarray(c2, float), np.asarray(c3, float))
    reach = [np.asarray(r, float) + probe for r in (r1, r2, r3)]
    inside = corners.mean(axis=0)
    found = np.zeros(corners.shape[1], bool)
    for i, j, k in ((0, 1, 2), (0, 2, 1), (1, 2, 0)):
        side = corners[j] - corners[i]
        d = np.linalg.norm(side, axis=1)
        along = side / np.where(d > 0, d, 1)[:, None]
        clear = lambda p, k=k: np.linalg.norm(corners[k] - p, axis=1) >= reach[k]
        open_side = d >= reach[i] + reach[j]
        found |= open_side & (clear(corners[i] + reach[i][:, None] * along) | clear(corners[j] - reach[j][:, None] * along))
        middle = corners[i] + ((d + reach[i] - reach[j]) / 2)[:, None] * along
        across = np.stack([-along[:, 1], along[:, 0]], axis=1)
        across *= np.where((across * (inside - middle)).sum(axis=1) < 0, -1.0, 1.0)[:, None]
        under = 4 * d**2 * reach[i] ** 2 - (d**2 - reach[j] ** 2 + reach[i] ** 2) ** 2
        rise = np.sqrt(np.maximum(under, 0)) / (2 * np.where(d > 0, d, 1))
        touch = middle + rise[:, None] * across
        found |= _in_triangle(touch, corners) & clear(touch)
    return found


def passes_sampled(c1, c2, c3, r1, r2, r3, probe, tries: int = 20_000, seed: int = 0) -> bool:
    """Whether any of ``tries`` random points of one triangle clears its three discs."""
    corners = flattened(*(np.asarray(c, float)[None] for c in (c1, c2, c3)))[:, 0]
    rng = np.random.default_rng(seed)
    w = rng.dirichlet((1, 1, 1), tries)
    p = w @ corners
    return bool(np.all([np.linalg.norm(p - c, axis=1) >= r + probe for c, r in zip(corners, (r1, r2, r3), strict=True)], axis=0).any())


def with_side_open(sides: DataFrame) -> DataFrame:
    """``sides`` with ``open``: what `passes_three` asks of one side, for rows of distances and radii with the probe.

    The ends are i and j, the third disc is k; ``d``, ``e`` and ``g`` are the distances ij, ik and jk, ``ri``, ``rj`` and
    ``rk`` the radii. The side lies on the x axis with i at the origin, k above it.
    """
    d, e, g, ri, rj, rk = (F.col(c) for c in ("d", "e", "g", "ri", "rj", "rk"))
    x, y, mx, my = (F.col(c) for c in ("__x", "__y", "__mx", "__my"))
    zero = F.lit(0.0)
    under = d * d - rj * rj + ri * ri
    place = {
        "__x": F.when(d > 0, (d * d + e * e - g * g) / (2 * d)).otherwise(zero),
        "__mx": (d + ri - rj) / 2,
        "__my": F.when(d > 0, F.sqrt(F.greatest(4 * d * d * ri * ri - under * under, zero)) / (2 * d)).otherwise(zero),
    }
    clear = lambda px, py: F.sqrt((x - px) * (x - px) + (y - py) * (y - py)) >= rk
    along = (d >= ri + rj) & (clear(ri, zero) | clear(d - rj, zero))
    parts = F.abs(d * my) + F.abs((d - mx) * (y - my) + my * (x - mx)) + F.abs((y - my) * mx - (x - mx) * my)
    within = parts <= d * y * (1 + 1e-9) + 1e-12
    rows = sides.withColumns(place).withColumn("__y", F.sqrt(F.greatest(e * e - x * x, zero)))
    return rows.withColumn("open", along | (within & clear(mx, my))).drop("__x", "__y", "__mx", "__my")


def passes_four(centres: list[np.ndarray], radii: list[np.ndarray], probe) -> np.ndarray:
    """A probe fits through either of the triangles 0-1-2 and 0-2-3."""
    return passes_three(*centres[:3], *radii[:3], probe) | passes_three(centres[0], centres[2], centres[3], radii[0], radii[2], radii[3], probe)
