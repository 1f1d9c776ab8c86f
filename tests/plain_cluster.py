"""Dendrograms one merge at a time, by definition."""

import numpy as np


def merges(d: np.ndarray, method: str = "ward.D") -> list[tuple[int, int, float]]:
    """(left, right, height) by step: leaves are -1, -2, ..., earlier merges 1, 2, ...

    ward.D updates distances as they are given, without squares; complete takes the larger. Of equal
    least distances the first by position is merged. Leaves stand before clusters, lower first.
    """
    n = len(d)
    d = d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, name, out = np.ones(n), [-(i + 1) for i in range(n)], []
    for step in range(1, n):
        i, j = divmod(int(np.argmin(d)), n)
        i, j = min(i, j), max(i, j)
        height = d[i, j]
        a, b = name[i], name[j]
        order = sorted((a, b), key=lambda x: (x > 0, abs(x)))
        out.append((order[0], order[1], float(height)))
        with np.errstate(invalid="ignore"):
            if method == "ward.D":
                new = ((size[i] + size) * d[i] + (size[j] + size) * d[j] - size * height) / (size[i] + size[j] + size)
            elif method == "complete":
                new = np.maximum(d[i], d[j])
            else:
                raise ValueError(f"unknown method: {method}")
        new[[i, j]] = np.inf
        new[np.isinf(d[i]) | np.isinf(d[j])] = np.inf
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        name[i] = step
    return out


def cut(steps: list[tuple[int, int, float]], k: int) -> list[int]:
    """Labels 1 to k of the leaves when the tree is cut in k groups, numbered by first appearance."""
    n = len(steps) + 1
    if not 1 <= k <= n:
        raise ValueError(f"k must lie between 1 and {n}")
    group, members = list(range(n)), {}
    for s, (a, b, _) in enumerate(steps[: n - k], 1):
        own = [i for x in (a, b) for i in ([-x - 1] if x < 0 else members[x])]
        members[s] = own
        for i in own:
            group[i] = min(own)
    seen: dict[int, int] = {}
    return [seen.setdefault(g, len(seen) + 1) for g in group]


def leaves(steps: list[tuple[int, int, float]]) -> list[int]:
    """Leaf numbers (from 0) in drawing order, from the last merge down, left before right."""
    order, stack = [], [len(steps)] if steps else [-1]
    while stack:
        x = stack.pop()
        if x < 0:
            order.append(-x - 1)
        else:
            stack += [steps[x - 1][1], steps[x - 1][0]]
    return order
