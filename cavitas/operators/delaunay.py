"""Empty spheres through the points of one block, by the Delaunay tetrahedra of its points.

Points are added one by one, in the order of a space-filling curve. Tetrahedra know their neighbours: the one that holds a new point is found by walking
from the last one made, and those whose spheres hold it are the ones around it, so that a point takes about the same time among few or many.
The outside is tetrahedra with a point at infinity. Points in special places (five on a sphere, four in a plane) would
leave open which tetrahedra there are: they are moved by a very small random step for that choice alone, which is made in whole numbers where
doubles are not sure, and all spheres are of the true points; tetrahedra with one sphere are then merged, and flat ones have none.
"""

from __future__ import annotations

import numpy as np

#: Size of the random step, as a share of the largest coordinate.
STEP = 1e-9
#: How far from a sphere, by radius and the largest coordinate, a point is on it.
NEAR = 1e-9
#: Tetrahedra are flat under this volume, by the third power of their longest edge.
FLAT = 1e-12
#: Moved points are multiples of 2 ** -GRID, so that doubles hold them as they are.
GRID = 50
#: Rounding of the two determinants, by the third and fifth power of the largest distance: several times what it can be.
SURE_VOLUME, SURE_SPHERE = 2e-15, 2e-14
INFINITE = -1
#: The even permutations that bring each corner to the last place.
_LAST = ((1, 3, 2, 0), (0, 2, 3, 1), (0, 3, 1, 2), (0, 1, 2, 3))


def circumspheres(corners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres, squared radii, and the determinants of tetrahedra of shape (n, 4, 3)."""
    base = corners[:, 0]
    b, c, d = (corners[:, k] - base for k in (1, 2, 3))
    cross = np.cross(c, d)
    det = np.einsum("ij,ij->i", b, cross)
    sq = lambda v: np.einsum("ij,ij->i", v, v)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        offset = (sq(b) * cross + sq(c) * np.cross(d, b) + sq(d) * np.cross(b, c)) / (2 * det)[:, None]
    return base + offset, np.einsum("ij,ij->i", offset, offset), det


def curve_order(unit: np.ndarray) -> np.ndarray:
    """Order of points by the interleaved bits of their coordinates."""
    low = unit.min(axis=0)
    size = max(float((unit - low).max()), 1e-300)
    cell = ((unit - low) / size * 0x1FFFFF).astype(np.uint64)
    key = np.zeros(len(unit), np.uint64)
    for bit in range(21):
        for axis in range(3):
            key |= ((cell[:, axis] >> np.uint64(bit)) & np.uint64(1)) << np.uint64(3 * bit + axis)
    return np.argsort(key, kind="stable")


def _volume(a, b, c, p):
    """Positive where p is on the side of the plane from which a, b, c run one way, negative on the other; and the sum of squared distances from p."""
    ax, ay, az = a[0] - p[0], a[1] - p[1], a[2] - p[2]
    bx, by, bz = b[0] - p[0], b[1] - p[1], b[2] - p[2]
    cx, cy, cz = c[0] - p[0], c[1] - p[1], c[2] - p[2]
    far = ax * ax + ay * ay + az * az + bx * bx + by * by + bz * bz + cx * cx + cy * cy + cz * cz
    return ax * (by * cz - bz * cy) - ay * (bx * cz - bz * cx) + az * (bx * cy - by * cx), far


def _inside(a, b, c, d, p):
    """Positive where p is inside the sphere of a tetrahedron of positive volume; and the sum of squared distances from p."""
    ax, ay, az = a[0] - p[0], a[1] - p[1], a[2] - p[2]
    bx, by, bz = b[0] - p[0], b[1] - p[1], b[2] - p[2]
    cx, cy, cz = c[0] - p[0], c[1] - p[1], c[2] - p[2]
    dx, dy, dz = d[0] - p[0], d[1] - p[1], d[2] - p[2]
    a2, b2, c2, d2 = ax * ax + ay * ay + az * az, bx * bx + by * by + bz * bz, cx * cx + cy * cy + cz * cz, dx * dx + dy * dy + dz * dz
    # volumes of each three corners and p
    bcd = bx * (cy * dz - cz * dy) - by * (cx * dz - cz * dx) + bz * (cx * dy - cy * dx)
    acd = ax * (cy * dz - cz * dy) - ay * (cx * dz - cz * dx) + az * (cx * dy - cy * dx)
    abd = ax * (by * dz - bz * dy) - ay * (bx * dz - bz * dx) + az * (bx * dy - by * dx)
    abc = ax * (by * cz - bz * cy) - ay * (bx * cz - bz * cx) + az * (bx * cy - by * cx)
    return b2 * acd - a2 * bcd - c2 * abd + d2 * abc, a2 + b2 + c2 + d2


class Triangulation:
    """Tetrahedra as lists of four corners (of positive volume), and their neighbours opposite each corner."""

    def __init__(self, places: list[tuple[int, int, int]], first: tuple[int, int, int, int]):
        self.places = places
        self.points = [(x / (1 << GRID), y / (1 << GRID), z / (1 << GRID)) for x, y, z in places]
        a, b, c, d = first
        if not self.sees(a, b, c, d):
            a, b = b, a
        self.corners: list[list[int]] = [[a, b, c, d]]
        self.next: list[list[int]] = [[1, 2, 3, 4]]
        self.free: list[int] = []
        faces = []
        for k in range(4):  # the outside of each face, turned round
            x, y, z, _ = (self.corners[0][j] for j in _LAST[k])
            faces.append((y, x, z))
            self.corners.append([y, x, z, INFINITE])
            self.next.append([-1, -1, -1, 0])
        for i, f in enumerate(faces):
            for j, g in enumerate(faces):
                if i != j:
                    (alone,) = set(f) - set(g)
                    self.next[i + 1][f.index(alone)] = j + 1
        self.last = 0

    def sees(self, a: int, b: int, c: int, i: int) -> bool:
        """Whether point i is on the positive side of a, b, c."""
        x = self.points
        v, far = _volume(x[a], x[b], x[c], x[i])
        if abs(v) <= SURE_VOLUME * far * far**0.5:
            x = self.places
            v, _ = _volume(x[a], x[b], x[c], x[i])
        return v > 0

    def holds(self, t: int, i: int) -> bool:
        """Whether point i is in the sphere of t; outside, on the outer side of its face."""
        corners, x = self.corners[t], self.points
        if INFINITE in corners:
            a, b, c, _ = (corners[j] for j in _LAST[corners.index(INFINITE)])
            return self.sees(a, b, c, i)
        a, b, c, d = corners
        v, far = _inside(x[a], x[b], x[c], x[d], x[i])
        if abs(v) <= SURE_SPHERE * far * far * far**0.5:
            x = self.places
            v, _ = _inside(x[a], x[b], x[c], x[d], x[i])
        return v > 0

    def locate(self, i: int) -> int:
        """A tetrahedron that point i is in, or an outer one that sees it."""
        t, before = self.last, -1
        if INFINITE in self.corners[t]:
            t = self.next[t][self.corners[t].index(INFINITE)]
        while True:
            corners = self.corners[t]
            if INFINITE in corners:
                return t
            for k in range(4):
                if self.next[t][k] != before:
                    a, b, c, _ = (corners[j] for j in _LAST[k])
                    if not self.sees(a, b, c, i):
                        t, before = self.next[t][k], t
                        break
            else:
                return t

    def add(self, i: int) -> None:
        corners, near, free = self.corners, self.next, self.free
        start = self.locate(i)
        hit, todo, border = {start}, [start], []
        missed: set[int] = set()
        while todo:
            t = todo.pop()
            for k in range(4):
                u = near[t][k]
                if u in hit:
                    continue
                if u not in missed and self.holds(u, i):
                    hit.add(u)
                    todo.append(u)
                else:
                    missed.add(u)
                    border.append((t, k, u))
        edges: dict[tuple[int, int], tuple[int, int]] = {}
        made = []
        for t, k, u in border:
            own = corners[t].copy()
            own[k] = i
            if free:
                new = free.pop()
                corners[new], near[new] = own, [-1, -1, -1, -1]
            else:
                new = len(corners)
                corners.append(own)
                near.append([-1, -1, -1, -1])
            near[new][k] = u
            made.append((new, t, u))
            for j in range(4):
                if j != k:
                    a, b = (own[m] for m in range(4) if m not in (j, k))
                    edge = (a, b) if a < b else (b, a)
                    other = edges.pop(edge, None)
                    if other is None:
                        edges[edge] = (new, j)
                    else:
                        near[new][j], near[other[0]][other[1]] = other[0], new
        for new, t, u in made:
            face = set(corners[new]) - {i}
            for j, corner in enumerate(corners[u]):
                if corner not in face and near[u][j] == t:
                    near[u][j] = new
                    break
        for t in hit:
            corners[t] = []
            free.append(t)
        self.last = made[-1][0]


def _first_four(unit: np.ndarray, order: np.ndarray) -> tuple[int, int, int, int] | None:
    """Four points that are not in one plane, far apart."""
    x = unit[order]
    a = 0
    b = int(((x - x[a]) ** 2).sum(axis=1).argmax())
    line = x[b] - x[a]
    area = (np.cross(x - x[a], line) ** 2).sum(axis=1)
    c = int(area.argmax())
    height = np.abs((x - x[a]) @ np.cross(line, x[c] - x[a]))
    d = int(height.argmax())
    return tuple(int(order[k]) for k in (a, b, c, d)) if height[d] > FLAT else None


def tetrahedra(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners of the Delaunay tetrahedra of distinct points, and their neighbours (-1 outside), of shape (n, 4) each."""
    none = np.zeros((0, 4), np.int64)
    if len(points) < 4:
        return none, none
    middle = points.mean(axis=0)
    unit = (points - middle) / max(float(np.abs(points - middle).max()), 1e-300)
    order = curve_order(unit)
    first = _first_four(unit, order)
    if first is None:
        return none, none
    moved = unit + np.random.default_rng(0).uniform(-STEP, STEP, unit.shape)
    mesh = Triangulation(list(map(tuple, (moved * (1 << GRID)).round().astype(np.int64).tolist())), first)
    for i in order.tolist():
        if i not in first:
            mesh.add(i)
    live = [t for t, c in enumerate(mesh.corners) if c and INFINITE not in c]
    number = np.full(len(mesh.corners), -1)
    number[live] = np.arange(len(live))
    return np.array([mesh.corners[t] for t in live], np.int64).reshape(-1, 4), number[np.array([mesh.next[t] for t in live], np.int64).reshape(-1, 4)]


def empty_spheres(points: np.ndarray) -> list[tuple[np.ndarray, float, list[int]]]:
    """(centre, radius, contacts) of the spheres through four or more points with none inside, by contacts."""
    if not len(points):
        return []
    own, which = np.unique(points, axis=0, return_inverse=True)  # repeated points are contacts of the same spheres
    which = which.reshape(-1)
    cells, near = tetrahedra(own)
    if not len(cells):
        return []
    corners = own[cells]
    centre, r2, det = circumspheres(corners)
    edge = np.max(np.linalg.norm(corners[:, 1:] - corners[:, :1], axis=2), axis=1)
    solid = np.abs(det) > FLAT * edge**3
    radius = np.sqrt(np.where(solid, r2, 0))
    slack = NEAR * np.maximum(radius, float(np.abs(own - own.mean(axis=0)).max()))
    touch: list[set[int] | None] = [None] * len(cells)
    there = near >= 0
    far_corners = own[cells[near]]  # corners of each neighbour: (n, 4, 4, 3); of -1 those of the last, not used
    off = np.abs(np.linalg.norm(far_corners - np.where(solid[:, None], centre, 0)[:, None, None], axis=3) - radius[:, None, None]).max(axis=2)
    shared = there & (off <= slack[:, None]) & solid[:, None]
    for t in np.flatnonzero(shared.any(axis=1)).tolist():
        found, todo = {t}, [t]
        while todo:  # all around whose corners are on this sphere
            for u in near[todo.pop()].tolist():
                if u >= 0 and u not in found and (np.abs(np.linalg.norm(own[cells[u]] - centre[t], axis=1) - radius[t]) <= slack[t]).all():
                    found.add(u)
                    todo.append(u)
        touch[t] = {c for u in found for c in cells[u].tolist()}
    copies = np.split(np.argsort(which, kind="stable"), np.cumsum(np.bincount(which))[:-1])
    single = len(own) == len(points)
    out: dict[tuple, tuple] = {}
    for t in np.flatnonzero(solid).tolist():
        rows = touch[t] or cells[t].tolist()
        contacts = sorted(int(copies[c][0]) for c in rows) if single else sorted(int(k) for c in rows for k in copies[c])
        out.setdefault(tuple(contacts), (centre[t], float(radius[t]), contacts))
    return [out[k] for k in sorted(out)]
