"""Clustering of one matrix in memory: what the rounds over tables are held against."""

import numpy as np

from tsengine.operators.grouping import two_groups


def affinity_exemplars(dist: np.ndarray, damping: float = 0.5, rounds: int = 200, steady: int = 15) -> np.ndarray:
    """Exemplar of each row by affinity propagation on 2 - distance, preference the median similarity; lowest index on ties."""
    n = len(dist)
    if n < 2:
        return np.zeros(n, int)
    s = 2.0 - dist
    off = ~np.eye(n, dtype=bool)
    # rows that are alike would swing together for ever: earlier rows get a slightly higher preference
    np.fill_diagonal(s, np.median(s[off]) + 1e-3 * (n - np.arange(n)) / n)
    a, r, same, last = np.zeros((n, n)), np.zeros((n, n)), 0, None
    rows = np.arange(n)
    for _ in range(rounds):
        t = a + s
        first = t.argmax(1)
        top = t[rows, first]
        t[rows, first] = -np.inf
        new = s - top[:, None]
        new[rows, first] = s[rows, first] - t.max(1)
        r = damping * r + (1 - damping) * new
        p = np.maximum(r, 0)
        p[rows, rows] = r[rows, rows]
        new = p.sum(0)[None, :] - p
        own = new[rows, rows].copy()
        new = np.minimum(new, 0)
        new[rows, rows] = own
        a = damping * a + (1 - damping) * new
        centres = np.flatnonzero(a[rows, rows] + r[rows, rows] > 0)
        same = same + 1 if last is not None and np.array_equal(centres, last) else 0
        last = centres
        if same >= steady and len(centres):
            break
    if not len(last):
        return rows
    label = s[:, last].argmax(1)
    label[last] = np.arange(len(last))
    # within each cluster the member most similar to the others becomes the exemplar
    for k in range(len(last)):
        members = np.flatnonzero(label == k)
        last[k] = members[s[np.ix_(members, members)].sum(0).argmax()]
    label = s[:, last].argmax(1)
    label[last] = np.arange(len(last))
    return last[label]


def pack_exemplars(dist: np.ndarray, low: float, high: float) -> np.ndarray:
    """Greedy packing: while some are left, all far (> high) become single and all near (< low) one cluster; else the row whose
    sorted distances split widest takes its near group."""
    left, out = list(range(len(dist))), np.arange(len(dist))
    while left:
        d = dist[np.ix_(left, left)]
        off = d[~np.eye(len(left), dtype=bool)]
        if not len(off) or off.min() > high:
            break
        if off.max() < low:
            out[left] = left[int(np.round(d.sum(1), 12).argmin())]
            break
        best = None
        for i in range(len(left)):
            order = np.sort(np.delete(d[i], i))
            k = two_groups(order)
            if k and order[k - 1] <= high:
                gap = round(order[k:].mean() - order[:k].mean(), 12) if k < len(order) else 0.0
                if best is None or gap > best[0]:
                    best = (gap, i, order[k - 1])
        if best is None:
            i, j = divmod(int(np.where(np.eye(len(left), dtype=bool), np.inf, d).argmin()), len(left))
            best = (0.0, i, d[i, j])
        _, i, reach = best
        group = [left[j] for j in range(len(left)) if j == i or d[i, j] <= reach]
        out[group] = left[i]
        left = [x for x in left if x not in set(group)]
    return out


def ward_labels(x: np.ndarray, least: int) -> dict[int, np.ndarray]:
    """For k from `least` up to the number of rows: labels of k groups of rows, by merging the two whose union adds the least
    squared error."""
    n = len(x)
    centre, size, label = x.astype(float).copy(), np.ones(n), np.arange(n)
    cost = ((centre[:, None] - centre[None]) ** 2).sum(2) / 2
    np.fill_diagonal(cost, np.inf)
    out = {n: label.copy()}
    for k in range(n - 1, max(least, 1) - 1, -1):
        i, j = sorted(divmod(int(cost.argmin()), n))
        centre[i] = (size[i] * centre[i] + size[j] * centre[j]) / (size[i] + size[j])
        size[i], size[j] = size[i] + size[j], 0
        label[label == j] = i
        cost[j, :] = cost[:, j] = np.inf
        live = (size > 0) & (np.arange(n) != i)
        cost[i, live] = cost[live, i] = size[i] * size[live] / (size[i] + size[live]) * ((centre[live] - centre[i]) ** 2).sum(1)
        out[k] = label.copy()
    return out


def kmeans_labels(x: np.ndarray, k: int, rounds: int = 100) -> np.ndarray:
    """k-means of rows, from the row nearest the mean and then always the row furthest from those chosen."""
    first = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    centre, far = [x[first]], ((x - x[first]) ** 2).sum(1)
    for _ in range(k - 1):
        centre.append(x[int(far.argmax())])
        far = np.minimum(far, ((x - centre[-1]) ** 2).sum(1))
    c, label = np.array(centre, float), None
    for _ in range(rounds):
        new = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        if label is not None and np.array_equal(new, label):
            break
        label = new
        for i in np.unique(label):
            c[i] = x[label == i].mean(0)
    return label
