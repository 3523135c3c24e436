"""Complete, average and centroid linkage up to a cut, without a distance matrix.

Only pairs within the cut are found (by a grid of cells) and kept: clusters that merge within it have such a pair. The nearest two clusters
merge first, of equal ones those with the smallest numbers; a cluster has the number of its least row.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush
from itertools import product

import numpy as np

_STEPS = [s for s in product((-1, 0, 1), repeat=3) if s > (0, 0, 0)]


def _measure(x: np.ndarray, metric: str):
    """Points to put into cells, the cell for a cut, and the distance of rows from rows."""
    if metric == "c":
        y = x - x.mean(axis=1, keepdims=True)
        size = np.linalg.norm(y, axis=1)
        unit = np.full_like(y, np.nan)  # a row without spread has no distances
        np.divide(y, size[:, None], out=unit, where=size[:, None] > 0)
        return unit, lambda cut: np.sqrt(2 * cut) * (1 + 1e-9), lambda i, j: 1 - (y[i] * y[j]).sum(axis=-1) / (size[i] * size[j])
    if metric == "b":
        return x, lambda cut: cut, lambda i, j: np.abs(x[i] - x[j]).sum(axis=-1)
    return x, lambda cut: cut, lambda i, j: np.sqrt(((x[i] - x[j]) ** 2).sum(axis=-1))


def _cells(x: np.ndarray, size: float) -> dict[tuple, np.ndarray]:
    """Row numbers by cell of the first three coordinates; rows without numbers are in none."""
    rows = np.flatnonzero(np.isfinite(x).all(axis=1))
    cell = np.zeros((len(rows), 3), np.int64)
    cell[:, : x.shape[1]] = np.floor(x[rows, :3] / size)
    order = np.lexsort(cell.T)
    edges = np.flatnonzero((np.diff(cell[order], axis=0) != 0).any(axis=1)) + 1
    return {tuple(cell[part[0]].tolist()): rows[part] for part in np.split(order, edges) if len(part)}


def near_pairs(x: np.ndarray, cut: float, metric: str = "e") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """i, j and distance of the pairs of rows within ``cut``, i < j."""
    placed, size, distance = _measure(x, metric)
    cells = _cells(placed, size(cut))
    out = []
    for at, rows in cells.items():
        others = [cells[key] for s in _STEPS if (key := (at[0] + s[0], at[1] + s[1], at[2] + s[2])) in cells]
        for k, row in enumerate(rows.tolist()):
            near = np.concatenate([rows[k + 1 :], *others])
            d = distance(row, near)
            hit = d <= cut
            if hit.any():
                near = near[hit]
                out.append((np.minimum(near, row), np.maximum(near, row), d[hit]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def by_links(x: np.ndarray, cut: float, method: str, metric: str = "e") -> np.ndarray:
    """Cluster number of each row by ``complete`` or ``average`` linkage.

    Kept is a distance for each two clusters with a pair of rows within the cut: others are farther apart than the cut by either linkage.
    With complete linkage so are those of which one pair is farther; with average linkage, the distance of a merged cluster
    from one that only one of its parts had such a pair with is worked out from the rows.
    """
    _, _, distance = _measure(x, metric)
    gap: list[dict[int, float]] = [{} for _ in range(len(x))]
    heap = []
    for i, j, d in zip(*(a.tolist() for a in near_pairs(x, cut, metric)), strict=True):
        gap[i][j] = gap[j][i] = d
        heap.append((d, i, j))
    heapify(heap)
    members: list[list[int]] = [[k] for k in range(len(x))]

    def apart(i: int, k: int) -> float:
        known = gap[i].get(k)
        return known if known is not None else float(distance(np.array(members[i])[:, None], np.array(members[k])[None]).mean())

    while heap:
        d, i, j = heappop(heap)
        if gap[i].get(j) != d:  # one of them has merged since
            continue
        a, b = len(members[i]), len(members[j])
        both = gap[i].keys() & gap[j].keys() if method == "complete" else (gap[i].keys() | gap[j].keys()) - {i, j}
        new = {k: max(gap[i][k], gap[j][k]) if method == "complete" else (a * apart(i, k) + b * apart(j, k)) / (a + b) for k in both}
        for old in (i, j):
            for k in gap[old]:
                gap[k].pop(old, None)
        gap[i], gap[j] = new, {}
        members[i] += members[j]
        members[j] = []
        for k, h in new.items():
            gap[k][i] = h
            if h <= cut:
                heappush(heap, (h, min(i, k), max(i, k)))
    return _labels(members, len(x))


def by_centroids(x: np.ndarray, cut: float) -> np.ndarray:
    """Cluster number of each row by centroid linkage; merged centroids may be nearer to others than their parts were.

    While two centroids are within the cut the nearest two merge, and the new one looks for others in the cells around it. What comes
    after the first merge beyond the cut would be no cluster within it, as it holds that merge.
    """
    place = [row for row in x]
    version, members = [0] * len(x), [[k] for k in range(len(x))]
    cells: dict[tuple, set[int]] = {key: set(rows.tolist()) for key, rows in _cells(x, cut).items()}
    cell_of = lambda p: tuple(np.floor(np.append(p, [0.0, 0.0])[:3] / cut).astype(np.int64).tolist())
    heap = [(d, i, j, 0, 0) for i, j, d in zip(*(a.tolist() for a in near_pairs(x, cut)), strict=True)]
    heapify(heap)
    while heap:
        _, i, j, vi, vj = heappop(heap)
        if version[i] != vi or version[j] != vj:
            continue
        a, b = len(members[i]), len(members[j])
        for k in (i, j):
            cells[cell_of(place[k])].discard(k)
        place[i] = (a * place[i] + b * place[j]) / (a + b)
        members[i] += members[j]
        members[j] = []
        version[i] += 1
        version[j] = -1
        at = cell_of(place[i])
        near = [k for s in product((-1, 0, 1), repeat=3) for k in cells.get((at[0] + s[0], at[1] + s[1], at[2] + s[2]), ())]
        if near:
            d = np.sqrt(((np.array([place[k] for k in near]) - place[i]) ** 2).sum(axis=1))
            for k, h in zip(near, d.tolist(), strict=True):
                if h <= cut:
                    heappush(heap, (h, min(i, k), max(i, k), version[min(i, k)], version[max(i, k)]))
        cells.setdefault(at, set()).add(i)
    return _labels(members, len(x))


def _labels(members: list[list[int]], n: int) -> np.ndarray:
    label = np.arange(n)
    for rows in members:
        if rows:
            label[rows] = min(rows)
    return label
