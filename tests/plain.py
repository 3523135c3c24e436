"""Plain forms that tests hold the operators against."""

import numpy as np


def distances(x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "b":
        return np.abs(x[:, None] - x[None]).sum(axis=2)
    if metric == "c":
        y = x - x.mean(axis=1, keepdims=True)
        size = np.linalg.norm(y, axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            return 1 - (y @ y.T) / np.outer(size, size)
    gram = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    return np.sqrt(gram)


def merged(x: np.ndarray, cut: float, method: str, metric: str) -> np.ndarray:
    """Cluster number of each row: the nearest two clusters merge while some are within ``cut``.

    A cluster counts as within the cut if all merges in it are, as heights may fall with centroids. Each
    row keeps its nearest, which is looked for anew only when that one merged: work near the square of n.
    A row without distances (no spread, by correlation) stays alone.
    """
    n = len(x)
    d = distances(x, metric)
    d[np.isnan(d)] = np.inf
    np.fill_diagonal(d, np.inf)
    near = d.argmin(axis=1) if n else np.zeros(0, np.int64)
    gap = d[np.arange(n), near]
    size = np.ones(n)
    label = np.arange(n)
    parent_height: dict[int, float] = {}
    node = list(range(n))
    links: list[tuple[int, int, int, float]] = []
    alive = np.ones(n, bool)
    for step in range(n - 1):
        i = int(np.argmin(gap))
        j, h = int(near[i]), gap[i]
        if not np.isfinite(h):
            break
        links.append((node[i], node[j], n + step, h))
        a, b = size[i], size[j]
        if method == "complete":
            new = np.maximum(d[i], d[j])
        elif method == "average":
            new = (a * d[i] + b * d[j]) / (a + b)
        elif method == "centroid":
            new = np.sqrt(np.maximum((a * d[i] ** 2 + b * d[j] ** 2) / (a + b) - a * b * h**2 / (a + b) ** 2, 0))
        else:
            new = np.minimum(d[i], d[j])
        alive[j] = False
        new[~alive], new[i] = np.inf, np.inf
        d[i], d[:, i] = new, new
        d[j], d[:, j], gap[j] = np.inf, np.inf, np.inf
        closer = (new < gap) | ((new == gap) & (i < near))
        near[closer], gap[closer] = i, new[closer]
        lost = np.flatnonzero(alive & ~closer & ((near == i) | (near == j)))
        near[lost] = d[lost].argmin(axis=1)
        gap[lost] = d[lost, near[lost]]
        size[i] = a + b
        node[i] = n + step
    members = {k: [k] for k in range(n)}
    top = {k: 0.0 for k in range(n)}
    for p, q, r, h in links:
        top[r] = max(top[p], top[q], h)
        members[r] = members[p] + members[q]
        parent_height[p] = parent_height[q] = top[r]
    for k, rows in members.items():
        if top[k] <= cut and parent_height.get(k, np.inf) > cut:
            label[rows] = min(rows)
    return label
