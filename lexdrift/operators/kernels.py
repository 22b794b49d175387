"""Numerical kernels that Catalyst lacks: pure numpy, called within grouped tasks."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


def unit_matrix(rows) -> np.ndarray:
    m = np.asarray(rows, "f8")
    return m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-10)


def pairwise_distances(rows) -> np.ndarray:
    """Cosine distances of all pairs, i < j in row order."""
    u = unit_matrix(rows)
    i, j = np.triu_indices(len(u), 1)
    return 1 - (u @ u.T)[i, j]


def dip(values) -> float:
    """Hartigan and Hartigan's dip: the least largest distance between the empirical distribution and a unimodal one."""
    x, n = np.unique(np.asarray(values, "f8"), return_counts=True)
    return dip_of_counts(x, n) if len(x) else 0.0


def dip_of_counts(x: np.ndarray, n: np.ndarray) -> float:
    """The dip of values ``x``, ascending and different, that occur ``n`` times.

    For a mode interval, the best unimodal curve runs along the greatest convex
    minorant before it and the least concave majorant after it. The interval
    shrinks until the gap between the two within it no longer exceeds the gaps
    outside it.
    """
    above = np.cumsum(n).astype("f8")
    below, total = above - n, above[-1]
    if len(x) < 2:
        return 1 / (2 * total)
    low, high, worst = 0, len(x) - 1, 1.0
    while True:
        # Steps are touched from below by the minorant and from above by the majorant.
        minor, major = hull(x, below, low, high, convex=True), hull(x, above, low, high, convex=False)
        at = np.arange(low, high + 1)
        under, over = np.interp(x[at], x[minor], below[minor]), np.interp(x[at], x[major], above[major])
        gap_minor, gap_major = over[minor - low] - below[minor], above[major] - under[major - low]
        a, b = int(gap_minor.argmax()), int(gap_major.argmax())
        gap = max(gap_minor[a], gap_major[b])
        if gap_minor[a] >= gap_major[b]:
            new_low = minor[a]
            new_high = major[np.searchsorted(major, new_low)]
        else:
            new_high = major[b]
            new_low = minor[np.searchsorted(minor, new_high, side="right") - 1]
        if gap <= worst:
            break
        left, right = at[at <= new_low], at[at >= new_high]
        worst = max(worst, (above[left] - under[left - low]).max(initial=0), (over[right - low] - below[right]).max(initial=0))
        if (new_low, new_high) == (low, high) or new_low >= new_high:
            break
        low, high = int(new_low), int(new_high)
    return worst / (2 * total)


def hull(x: np.ndarray, y: np.ndarray, low: int, high: int, convex: bool) -> np.ndarray:
    """Places of the knots of the convex minorant or concave majorant of (x, y) between two places."""
    knots: list[int] = []
    sign, xs, ys = 1 if convex else -1, x.tolist(), y.tolist()
    for k in range(low, high + 1):
        while len(knots) > 1:
            i, j = knots[-2], knots[-1]
            # Drop j where the slope i-j exceeds (minorant) or undercuts (majorant) the slope j-k.
            if sign * ((ys[j] - ys[i]) * (xs[k] - xs[j]) - (ys[k] - ys[j]) * (xs[j] - xs[i])) >= 0:
                knots.pop()
            else:
                break
        knots.append(k)
    return np.array(knots)


#: Sizes at which the dip's distribution under uniformity is tabulated, each about a root of two over the one before.
DIP_SIZES = [int(round(2 ** (k / 2))) for k in range(4, 25)]


@lru_cache(maxsize=256)
def uniform_dips(n: int, draws: int, seed: int) -> np.ndarray:
    """Sorted dips of ``draws`` uniform samples of size ``n``."""
    rng = np.random.default_rng([seed, n])
    return np.sort([dip(rng.random(n)) for _ in range(draws)])


def dip_p_value(value: float, n: int, draws: int = 200, seed: int = 42, nulls: dict[int, np.ndarray] | None = None) -> float:
    """Share of uniform samples of size ``n`` with a dip at least as large.

    Root n times the dip is looked up at the tabulated sizes next to ``n`` and
    interpolated along 1 / root n, in which its distribution settles. Beyond
    the largest size the limit counts as reached. ``nulls``: sorted dips by
    size; without them they are drawn here.
    """
    if n < 4:
        return 1.0
    sizes = sorted(nulls) if nulls else DIP_SIZES
    at = int(np.searchsorted(sizes, n))
    near = [sizes[min(at, len(sizes) - 1)]] if at == len(sizes) or sizes[at] == n or at == 0 else [sizes[at - 1], sizes[at]]
    shares = []
    for size in near:
        table = nulls[size] if nulls else uniform_dips(size, draws, seed)
        shares.append(float((len(table) - np.searchsorted(table, value * np.sqrt(n / size) * (1 - 1e-12), side="left")) / len(table)))
    if len(near) == 1:
        return shares[0]
    low, high, here = (1 / np.sqrt(q) for q in (near[0], near[1], n))
    return float(shares[0] + (shares[1] - shares[0]) * (low - here) / (low - high))


def kde(values, grid: np.ndarray, least: int = 10) -> np.ndarray | None:
    """Gaussian density on a grid, with Scott's factor n ** -0.2 times the sample deviation; None below ``least`` values or without spread."""
    x = np.asarray(values, "f8")
    x = x[np.isfinite(x)]
    if len(x) < least or (sd := x.std(ddof=1)) == 0:
        return None
    h = sd * len(x) ** -0.2
    out = np.zeros(len(grid))
    for k in range(0, len(x), 4096):
        out += np.exp(-0.5 * ((grid[:, None] - x[None, k : k + 4096]) / h) ** 2).sum(1)
    return out / (len(x) * h * np.sqrt(2 * np.pi))


def kmeans(rows: np.ndarray, k: int, seed: int = 42, starts: int = 10, rounds: int = 100) -> np.ndarray:
    """Labels of the best of several starts, each spread by squared distance."""
    x = np.asarray(rows, "f8")
    rng = np.random.default_rng(seed)
    best, labels = np.inf, np.zeros(len(x), int)
    for _ in range(starts):
        centres = [x[rng.integers(len(x))]]
        while len(centres) < k:
            d = np.min([((x - c) ** 2).sum(1) for c in centres], axis=0)
            centres.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
        c = np.array(centres)
        for _ in range(rounds):
            own = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
            new = np.array([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(k)])
            if np.allclose(new, c):
                break
            c = new
        own = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        cost = ((x - c[own]) ** 2).sum()
        if cost < best - 1e-12:
            best, labels = cost, own
    return labels


def cosine_silhouette(rows: np.ndarray, labels: np.ndarray) -> float | None:
    """Mean silhouette by cosine distance; None where there is one cluster."""
    u = unit_matrix(rows)
    d = 1 - u @ u.T
    np.fill_diagonal(d, 0)
    kinds = np.unique(labels)
    if len(kinds) < 2 or len(kinds) >= len(labels):
        return None
    sums = np.stack([d[:, labels == c].sum(1) for c in kinds], 1)
    counts = np.array([(labels == c).sum() for c in kinds])
    own = np.searchsorted(kinds, labels)
    at = np.arange(len(labels))
    size = counts[own]
    a = np.where(size > 1, sums[at, own] / np.maximum(size - 1, 1), 0)
    means = sums / counts
    means[at, own] = np.inf
    b = means.min(1)
    s = np.where(size > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0)
    return float(s.mean())


def digamma(x):
    """By recurrence and the asymptotic series."""
    x = np.array(x, "f8")
    out = np.zeros_like(x)
    while (small := x < 6).any():
        out[small] -= 1 / x[small]
        x[small] += 1
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f / 252))


def mixture_weights(rows: np.ndarray, most: int, seed: int, rounds: int = 100, tolerance: float = 1e-3) -> np.ndarray:
    """Component weights of a variational mixture of diagonal Gaussians under a Dirichlet process (Blei and Jordan, 2006), concentration 1 / ``most``."""
    x = np.asarray(rows, "f8")
    n, d = x.shape
    most = min(most, n)
    gamma, mean0, var0, beta0, nu0 = 1 / most, x.mean(0), x.var(0) + 1e-6, 1.0, float(d)
    resp = np.full((n, most), 1e-10)
    resp[np.arange(n), kmeans(x, most, seed, starts=1, rounds=20)] = 1
    resp /= resp.sum(1, keepdims=True)
    before = -np.inf
    for _ in range(rounds):
        nk = resp.sum(0) + 1e-10
        xk = resp.T @ x / nk[:, None]
        sk = np.maximum(resp.T @ (x * x) / nk[:, None] - xk**2, 0) + 1e-6
        beta, nu = beta0 + nk, nu0 + nk
        mean = (beta0 * mean0 + nk[:, None] * xk) / beta[:, None]
        scale = (nu0 * var0 + nk[:, None] * sk + (beta0 * nk / beta)[:, None] * (xk - mean0) ** 2) / nu[:, None]
        a, b = 1 + nk, gamma + np.concatenate([np.cumsum(nk[::-1])[::-1][1:], [0]])
        stick = digamma(a) - digamma(a + b)
        rest = np.concatenate([[0], np.cumsum(digamma(b) - digamma(a + b))[:-1]])
        log_prec = d * (digamma(nu / 2) - np.log(nu / 2)) - np.log(scale).sum(1)
        square = ((x[:, None] - mean[None]) ** 2 / scale[None]).sum(2)
        log_p = stick + rest + 0.5 * (log_prec - d * np.log(2 * np.pi) - square - d / beta)
        top = log_p.max(1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(log_p - top).sum(1))
        resp = np.exp(log_p - total[:, None])
        if abs(total.mean() - before) < tolerance:
            break
        before = total.mean()
    v = a / (a + b)
    weights = v * np.concatenate([[1], np.cumprod(1 - v)[:-1]])
    return weights / weights.sum()


def bootstrap_components(rows: np.ndarray, most: int = 6, draws: int = 100, threshold: float = 0.05, seed: int = 42) -> tuple[int | None, float | None, int]:
    """(commonest number of components over resamples, its share, valid resamples); components weigh more than ``threshold``."""
    x = np.asarray(rows, "f8")
    rng = np.random.default_rng(seed)
    found: list[int] = []
    for k in range(draws):
        sample = x[rng.integers(0, len(x), len(x))]
        if len(np.unique(sample, axis=0)) < 2:
            continue
        found.append(int((mixture_weights(sample, most, seed + k) > threshold).sum()))
    if not found:
        return None, None, 0
    values, counts = np.unique(found, return_counts=True)
    return int(values[counts.argmax()]), float(counts.max() / len(found)), len(found)


def louvain(edges: list[tuple[str, str, float]], nodes: list[str] | None = None) -> dict[str, int]:
    """Communities by local moves and contraction (Blondel et al., 2008), nodes in sorted order; numbered by their smallest member."""
    names = sorted({*(nodes or []), *(u for u, _, _ in edges), *(v for _, v, _ in edges)})
    number = {w: k for k, w in enumerate(names)}
    graph: list[dict[int, float]] = [{} for _ in names]
    for u, v, w in edges:
        a, b = number[u], number[v]
        graph[a][b] = graph[a].get(b, 0) + w
        if a != b:
            graph[b][a] = graph[b].get(a, 0) + w
    member = list(range(len(names)))
    while True:
        label = local_moves(graph)
        kinds = {c: k for k, c in enumerate(dict.fromkeys(label))}
        label = [kinds[c] for c in label]
        member = [label[m] for m in member]
        if len(kinds) == len(graph):
            break
        merged: list[dict[int, float]] = [{} for _ in kinds]
        for a, near in enumerate(graph):
            for b, w in near.items():
                x, y = label[a], label[b]
                # A loop holds each inner edge once; both directions are met here.
                merged[x][y] = merged[x].get(y, 0) + (w / 2 if x == y and a != b else w)
        graph = merged
    first: dict[int, int] = {}
    return {w: first.setdefault(member[k], len(first)) for k, w in enumerate(names)}


def local_moves(graph: list[dict[int, float]]) -> list[int]:
    degree = [sum(w for b, w in near.items() if b != a) + 2 * near.get(a, 0) for a, near in enumerate(graph)]
    twice = sum(degree)
    label, weight = list(range(len(graph))), list(degree)
    if not twice:
        return label
    moved = True
    while moved:
        moved = False
        for a, near in enumerate(graph):
            to: dict[int, float] = {}
            for b, w in near.items():
                if b != a:
                    to[label[b]] = to.get(label[b], 0) + w
            own = label[a]
            weight[own] -= degree[a]
            best, gain = own, to.get(own, 0) - weight[own] * degree[a] / twice
            for c in sorted(to):
                if (g := to[c] - weight[c] * degree[a] / twice) > gain + 1e-12:
                    best, gain = c, g
            weight[best] += degree[a]
            if best != own:
                label[a], moved = best, True
    return label
