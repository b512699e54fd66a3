"""Numeric kernels of single windows and series, in numpy only: no Spark here, so each can be tested alone."""

from __future__ import annotations

import math

import numpy as np


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T
    return np.sqrt(np.maximum(d, 0))


def energy(x: np.ndarray, y: np.ndarray) -> float:
    """Energy distance, all pairs with themselves included."""
    return float(2 * distances(x, y).mean() - distances(x, x).mean() - distances(y, y).mean())


def mmd2(x: np.ndarray, y: np.ndarray, factor: float = 1.0) -> float:
    """Unbiased squared MMD of a Gaussian kernel whose bandwidth is ``factor`` times the median squared distance."""
    z = np.vstack([x, y])
    d2 = distances(z, z) ** 2
    upper = d2[np.triu_indices(len(z), 1)]
    k = np.exp(-d2 / max(factor * float(np.median(upper)) if len(upper) else 1.0, 1e-12))
    n, m = len(x), len(y)
    if n < 2 or m < 2:
        return 0.0
    a, b, c = k[:n, :n], k[n:, n:], k[:n, n:]
    return max(0.0, float((a.sum() - np.trace(a)) / (n * (n - 1)) + (b.sum() - np.trace(b)) / (m * (m - 1)) - 2 * c.mean()))


def sliced_wasserstein(x: np.ndarray, y: np.ndarray, projections: int = 100, seed: int = 0) -> float:
    """Root mean squared Wasserstein-2 distance over random directions, quantiles matched."""
    r = np.random.default_rng(seed)
    d = r.standard_normal((x.shape[1], projections))
    d /= np.linalg.norm(d, axis=0)
    q = (np.arange(max(len(x), len(y))) + 0.5) / max(len(x), len(y))
    a, b = np.quantile(x @ d, q, axis=0), np.quantile(y @ d, q, axis=0)
    return float(np.sqrt(((a - b) ** 2).mean()))


def _root(s: np.ndarray) -> np.ndarray:
    w, v = np.linalg.eigh((s + s.T) / 2)
    return (v * np.sqrt(np.maximum(w, 0))) @ v.T


def pca(z: np.ndarray, dims: int) -> np.ndarray:
    z = z - z.mean(0)
    return z @ np.linalg.svd(z, full_matrices=False)[2][: min(dims, *z.shape)].T


def frechet(x: np.ndarray, y: np.ndarray, dims: int = 256) -> float:
    """Distance of Gaussian fits after a joint projection, 1e-6 added to both diagonals."""
    z = pca(np.vstack([x, y]), dims)
    a, b = z[: len(x)], z[len(x) :]
    sa, sb = (np.atleast_2d(np.cov(v, rowvar=False)) + 1e-6 * np.eye(z.shape[1]) for v in (a, b))
    ra = _root(sa)
    return float(((a.mean(0) - b.mean(0)) ** 2).sum() + np.trace(sa) + np.trace(sb) - 2 * np.trace(_root(ra @ sb @ ra)))


SEMANTIC = {"S1": mmd2, "S2": energy, "S3": sliced_wasserstein, "S4": frechet}


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = l2 * np.eye(len(w))
    ridge[-1, -1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def rank_auc(score: np.ndarray, label: np.ndarray) -> float:
    values, where, n = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[where]
    p = label == 1
    return float((rank[p].sum() - p.sum() * (p.sum() + 1) / 2) / (p.sum() * (~p).sum()))


def c2st(x: np.ndarray, y: np.ndarray, dims: int = 32, folds: int = 5, seed: int = 0) -> tuple[float, float]:
    """Mean and deviation (ddof 1) over stratified folds of the AUC of a logistic regression that tells the sides apart."""
    z, label = pca(np.vstack([x, y]), dims), np.r_[np.zeros(len(x)), np.ones(len(y))]
    z = z / (z.std(0) + 1e-12)
    r, fold = np.random.default_rng(seed), np.zeros(len(z), int)
    for k in (0, 1):
        at = np.flatnonzero(label == k)
        fold[r.permutation(at)] = np.arange(len(at)) % folds
    out = []
    for f in range(folds):
        w = logistic(z[fold != f], label[fold != f])
        out.append(rank_auc(np.hstack([z[fold == f], np.ones(((fold == f).sum(), 1))]) @ w, label[fold == f]))
    return float(np.mean(out)), float(np.std(out, ddof=1))


def permutation_test(x: np.ndarray, y: np.ndarray, statistic, n: int, seed: int) -> tuple[float, float, float, float, float]:
    """Observed, null mean, null deviation (ddof 0), z (0 if the null is flat) and the share of the null at or above."""
    r, z = np.random.default_rng(seed), np.vstack([x, y])
    seen = statistic(x, y)
    null = []
    for _ in range(n):
        o = r.permutation(len(z))
        null.append(statistic(z[o[: len(x)]], z[o[len(x) :]]))
    null = np.array(null)
    sd = float(null.std())
    return seen, float(null.mean()), sd, (seen - float(null.mean())) / sd if sd > 0 else 0.0, float((null >= seen).mean())


def energy_permutations(x: np.ndarray, y: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Null energy distances from one pooled distance matrix: sums by side are products with an indicator matrix."""
    z, r = np.vstack([x, y]), np.random.default_rng(seed)
    d = distances(z, z)
    side = np.zeros((n, len(z)))
    for i in range(n):
        side[i, r.permutation(len(z))[: len(x)]] = 1
    bd, all_, nx, ny = side @ d, d.sum(), len(x), len(y)
    xx = (bd * side).sum(1)
    xy = bd.sum(1) - xx
    return 2 * xy / (nx * ny) - xx / nx**2 - (all_ - xx - 2 * xy) / ny**2


class Graph:
    """A directed graph over nodes numbered in order of their names, edges once each."""

    def __init__(self, edges):
        e = sorted({(a, b) for a, b in edges if a != b})
        self.names = sorted({v for ab in e for v in ab})
        at = {v: i for i, v in enumerate(self.names)}
        self.src, self.dst = (np.array([at[ab[k]] for ab in e], int) for k in (0, 1))
        self.n = len(self.names)

    def pagerank(self, damping: float = 0.85, rounds: int = 200) -> np.ndarray:
        out, p = np.bincount(self.src, minlength=self.n), np.full(self.n, 1 / max(self.n, 1))
        for _ in range(rounds):
            q = np.bincount(self.dst, p[self.src] / out[self.src], minlength=self.n)
            new = (1 - damping) / self.n + damping * (q + p[out == 0].sum() / self.n)
            if np.abs(new - p).sum() < 1e-6 * self.n:
                return new
            p = new
        return p

    def neighbours(self) -> list[list[int]]:
        near: list[set[int]] = [set() for _ in range(self.n)]
        for a, b in zip(self.src, self.dst, strict=True):
            near[a].add(int(b))
            near[b].add(int(a))
        return [sorted(x) for x in near]

    def largest(self) -> list[int]:
        near, seen, best = self.neighbours(), set(), []
        for s in range(self.n):
            if s not in seen:
                part, stack = [], [s]
                seen.add(s)
                while stack:
                    v = stack.pop()
                    part.append(v)
                    for u in near[v]:
                        if u not in seen:
                            seen.add(u)
                            stack.append(u)
                best = part if len(part) > len(best) else best
        return sorted(best)

    def spectral_gap(self, dense: int = 1500, steps: int = 150) -> float:
        """Second smallest eigenvalue of the normalised Laplacian of the largest component: of the matrix itself up to ``dense``
        nodes, above that by Lanczos steps on I + S without its known top vector."""
        part = self.largest()
        if len(part) < 3:
            return math.nan
        if len(part) > dense:
            return self._lanczos_gap(part, steps)
        at, near = {v: i for i, v in enumerate(part)}, self.neighbours()
        a = np.zeros((len(part), len(part)))
        for v in part:
            for u in near[v]:
                if u in at:
                    a[at[v], at[u]] = 1
        d = np.maximum(a.sum(1), 1)
        return float(np.sort(np.linalg.eigvalsh(np.eye(len(part)) - a / np.sqrt(d[:, None] * d[None, :])))[1])

    def _lanczos_gap(self, part: list[int], steps: int) -> float:
        at = np.full(self.n, -1)
        at[part] = np.arange(len(part))
        pairs = np.unique(np.sort(np.stack([at[self.src], at[self.dst]]), axis=0), axis=1)
        a, b = pairs[:, pairs[0] >= 0]
        d = np.bincount(np.r_[a, b], minlength=len(part)).astype(float)
        w = 1 / np.sqrt(d[a] * d[b])
        known = np.sqrt(d / d.sum())
        basis, alpha, beta = [], [], []
        q = np.random.default_rng(0).standard_normal(len(part))
        for _ in range(min(steps, len(part) - 1)):
            q -= known * (known @ q)
            for v in basis:
                q -= v * (v @ q)
            size = np.linalg.norm(q)
            if size < 1e-10:
                break
            q /= size
            if basis:
                beta.append(size)
            basis.append(q)
            r = q + np.bincount(a, w * q[b], len(part)) + np.bincount(b, w * q[a], len(part))
            alpha.append(q @ r)
            q = r - alpha[-1] * q
        t = np.diag(alpha) + np.diag(beta[: len(alpha) - 1], 1) + np.diag(beta[: len(alpha) - 1], -1)
        return float(2 - np.linalg.eigvalsh(t)[-1])

    def betweenness(self) -> float:
        """Mean betweenness on the largest component, from all sources. The shortest paths between two nodes at distance d give d - 1
        to the nodes between them, so the mean needs distances only."""
        part, near = self.largest(), self.neighbours()
        if len(part) < 3:
            return math.nan
        total = 0
        for s in part:
            seen, level, d = {s}, [s], 0
            while level:
                total += max(d - 1, 0) * len(level)
                level, d = list({u for v in level for u in near[v]} - seen), d + 1
                seen.update(level)
        n = len(part)
        return total / n / ((n - 1) * (n - 2))

    def exponent(self) -> float:
        """Exponent of a * k**-g fitted to the in-degree CCDF by Gauss-Newton; nan below ten cited nodes."""
        k = np.bincount(self.dst, minlength=self.n)
        return degree_exponent(*np.unique(k[k > 0], return_counts=True))

    def louvain(self, resolution: float = 1.0, total_weight: float | None = None) -> np.ndarray:
        """Communities by greedy modularity moves and merging, in node order. ``total_weight``: twice the linked pairs of the whole
        graph, if this one holds only some of its components."""
        weight: dict[tuple[int, int], float] = {}
        for v, us in enumerate(self.neighbours()):
            for u in us:
                weight[v, u] = 1.0
        label, m2 = np.arange(self.n), total_weight or sum(weight.values())
        while weight:
            nodes = sorted({v for v, _ in weight})
            near: dict[int, list[tuple[int, float]]] = {v: [] for v in nodes}
            for (v, u), w in weight.items():
                near[v].append((u, w))
            degree = {v: sum(w for _, w in near[v]) for v in nodes}
            own, total, moved = {v: v for v in nodes}, dict(degree), False
            for _ in range(20):
                again = False
                for v in nodes:
                    links: dict[int, float] = {}
                    for u, w in near[v]:
                        if u != v:
                            links[own[u]] = links.get(own[u], 0) + w
                    total[own[v]] -= degree[v]
                    gain = lambda c: links.get(c, 0) - resolution * total[c] * degree[v] / m2  # noqa: B023, E731
                    best = max(sorted({own[v], *links}), key=lambda c: (gain(c), c == own[v]))  # noqa: B023
                    if gain(best) <= gain(own[v]) + 1e-12:
                        best = own[v]
                    again |= best != own[v]
                    own[v] = best
                    total[best] += degree[v]
                moved |= again
                if not again:
                    break
            if not moved:
                break
            label = np.array([own.get(c, c) for c in label])
            merged: dict[tuple[int, int], float] = {}
            for (v, u), w in weight.items():
                k = own[v], own[u]
                merged[k] = merged.get(k, 0) + w
            weight = merged
        return label


def degree_exponent(k: np.ndarray, n: np.ndarray) -> float:
    """``Graph.exponent`` where ``n`` nodes each have in-degrees ``k``, in order."""
    if n.sum() < 10 or len(k) < 2:
        return math.nan
    y, g, a, x = np.cumsum(n[::-1])[::-1] / n.sum(), 1.5, 1.0, k.astype(float)
    for _ in range(200):
        f = a * x**-g
        j = np.stack([-f * np.log(x), x**-g], 1)
        step = np.linalg.lstsq(j.T @ j + 1e-9 * np.eye(2), j.T @ (y - f), rcond=None)[0]
        g, a = g + step[0], a + step[1]
        if np.abs(step).max() < 1e-10:
            break
    return float(g)


def degree_entropy(k: np.ndarray, n: np.ndarray) -> float:
    """Shannon entropy of the distribution of positive in-degrees; nan below three cited nodes."""
    return float(-(n / n.sum() * np.log(n / n.sum())).sum()) if n.sum() >= 3 else math.nan


def js_of_counts(p: np.ndarray, q: np.ndarray) -> float:
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    return float(sum(0.5 * (v[v > 0] * np.log(v[v > 0] / m[v > 0])).sum() for v in (p, q)))


def pagerank_js(a: Graph, b: Graph, bins: int = 20) -> float:
    pa, pb = a.pagerank(), b.pagerank()
    top = max(pa.max(initial=0), pb.max(initial=0))
    if top <= 0:
        return math.nan
    return js_of_counts(*(np.histogram(p, bins, (0, top))[0] + 1e-10 for p in (pa, pb)))


def profile_ranks(steps: np.ndarray, ends: np.ndarray, n: np.ndarray, damping: float = 0.85, rounds: int = 200) -> np.ndarray:
    """``Graph.pagerank`` of one node of each profile: ``n`` nodes have the same ``steps`` (a column each; later ones are zero) and
    cite nothing (``ends``). Ranks of a round are sums of steps, each with a factor of its own."""
    total = n.sum()
    factor = np.zeros(steps.shape[1])
    factor[0] = 1 / total
    p = steps @ factor
    for _ in range(rounds):
        factor = damping * np.concatenate([[0.0], factor[:-1]])
        factor[0] = (1 - damping) / total + damping * (p * n)[ends].sum() / total
        new = steps @ factor
        if (np.abs(new - p) * n).sum() < 1e-6 * total:
            return new
        p = new
    return p


def profiles_js(sides, bins: int = 20) -> float:
    """``pagerank_js`` of two graphs given as (steps, ends, n)."""
    ranks = [profile_ranks(*s) if len(s[2]) else np.zeros(0) for s in sides]
    top = max(r.max(initial=0) for r in ranks)
    if top <= 0:
        return math.nan
    return js_of_counts(*(np.histogram(r, bins, (0, top), weights=s[2])[0] + 1e-10 for r, s in zip(ranks, sides, strict=True)))


def community_js(a, b) -> float:
    """Divergence of the shares that two edge sets' nodes have in the communities of their union."""
    g = Graph([*a, *b])
    label = g.louvain()
    at = {v: i for i, v in enumerate(g.names)}
    if len(set(label.tolist())) < 2:
        return 0.0
    shares = [np.bincount(label[[at[v] for v in {x for e in s for x in e}]], minlength=g.n).astype(float) for s in (a, b)]
    return js_of_counts(*shares) if all(s.sum() for s in shares) else math.nan


GRAPH = {"G1": None, "G2": Graph.spectral_gap, "G5": Graph.exponent, "G8": Graph.betweenness}


def _segment_costs(y: np.ndarray, kernel: bool) -> np.ndarray:
    n = len(y)
    if kernel:
        d = (y[:, None] - y[None, :]) ** 2
        up = d[np.triu_indices(n, 1)]
        med = float(np.median(up)) if len(up) else 1.0
        k = np.exp(-d / (med if med > 0 else 1.0))
        s = np.zeros((n + 1, n + 1))
        s[1:, 1:] = k.cumsum(0).cumsum(1)
    cost = np.full((n + 1, n + 1), np.inf)
    for i in range(n):
        for j in range(i + 1, n + 1):
            v = y[i:j]
            cost[i, j] = (j - i) - (s[j, j] - s[i, j] - s[j, i] + s[i, i]) / (j - i) if kernel else float(((v - v.mean()) ** 2).sum())
    return cost


def pelt(y: np.ndarray, penalty: float, least: int = 2) -> list[int]:
    """Segment starts of the cheapest kernel segmentation with a penalty a break; exact (pruned optimal partitioning)."""
    n, cost = len(y), _segment_costs(y, True)
    best, back, alive = [-penalty] + [np.inf] * n, [0] * (n + 1), [0]
    for j in range(1, n + 1):
        for i in alive:
            if j - i >= least and best[i] + cost[i, j] + penalty < best[j]:
                best[j], back[j] = best[i] + cost[i, j] + penalty, i
        alive = [i for i in alive if j - i < least or best[i] + cost[i, j] <= best[j]] + [j]
    out, j = [], n
    while j > 0 and np.isfinite(best[j]):
        j = back[j]
        if j:
            out.append(j)
    return out[::-1]


def dynp(y: np.ndarray, breaks: int, least: int = 2, kernel: bool = False) -> list[int]:
    """Segment starts of the cheapest segmentation with exactly so many breaks; empty if the series is too short."""
    n = len(y)
    if n < (breaks + 1) * least:
        return []
    cost = _segment_costs(y, kernel)
    best, back = [cost[0].copy()], []
    best[0][: least] = np.inf
    for _ in range(breaks):
        now, at = np.full(n + 1, np.inf), np.zeros(n + 1, int)
        for j in range(least, n + 1):
            for i in range(least, j - least + 1):
                v = best[-1][i] + cost[i, j]
                if v < now[j]:
                    now[j], at[j] = v, i
        best.append(now)
        back.append(at)
    out, j = [], n
    for at in reversed(back):
        j = int(at[j])
        out.append(j)
    return out[::-1]


def mmd_permutations(x: np.ndarray, y: np.ndarray, n: int, seed: int) -> tuple[float, np.ndarray]:
    """Squared MMD (not clipped) as it is and under label permutations: sides are rows of an indicator matrix over one pooled kernel."""
    z, r = np.vstack([x, y]), np.random.default_rng(seed)
    d2 = distances(z, z) ** 2
    k = np.exp(-d2 / max(float(np.median(d2[np.triu_indices(len(z), 1)])), 1e-12))
    np.fill_diagonal(k, 0)
    side = np.zeros((n + 1, len(z)))
    side[0, : len(x)] = 1
    for i in range(1, n + 1):
        side[i, r.permutation(len(z))[: len(x)]] = 1
    by_side, nx, ny = side @ k, len(x), len(y)
    xx = (by_side * side).sum(1)
    xy = by_side.sum(1) - xx
    yy = k.sum() - xx - 2 * xy
    value = xx / max(nx * (nx - 1), 1) + yy / max(ny * (ny - 1), 1) - 2 * xy / (nx * ny)
    return float(value[0]), value[1:]


def community_permutations(a, b, n: int, seed: int) -> tuple[float, np.ndarray]:
    """``community_js`` as it is, and with the union's nodes dealt to two sides of the old sizes."""
    g = Graph([*a, *b])
    label = np.unique(g.louvain(), return_inverse=True)[1]
    seen, size = community_js(a, b), len({v for e in a for v in e})
    if label.max(initial=0) < 1 or not 0 < size < g.n:
        return (0.0 if seen != seen else seen), np.zeros(n)
    r, null = np.random.default_rng(seed), []
    for _ in range(n):
        o = r.permutation(g.n)
        null.append(js_of_counts(*(np.bincount(label[part], minlength=label.max() + 1).astype(float) for part in (o[:size], o[size:]))))
    return seen, np.array(null)


def js_of_groups(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> float:
    """``js_of_counts`` where ``n`` communities each have counts ``a`` and ``b``."""
    p, q = a / (a * n).sum(), b / (b * n).sum()
    m = (p + q) / 2
    return float(sum(0.5 * (n[v > 0] * v[v > 0] * np.log(v[v > 0] / m[v > 0])).sum() for v in (p, q)))


def community_groups_js(before: np.ndarray, after: np.ndarray, n: np.ndarray) -> float:
    """``community_js`` of ``n`` communities each with so many nodes on both sides; 0 for fewer than two communities."""
    if n.sum() < 2:
        return 0.0
    return js_of_groups(before, after, n) if (before * n).sum() and (after * n).sum() else math.nan


def hits_by_community(size: int, n: int, taken: int, r: np.random.Generator) -> np.ndarray:
    """(hits, communities) rows: ``taken`` of the nodes of ``n`` communities of one size, drawn without replacement. Few communities
    are drawn one by one; of many, only how many have which number of hits is kept, as one node of each is dealt at a time: a
    subset of the communities, so it falls to those of each number by the multivariate hypergeometric law."""
    if size * size > n:
        return np.stack(np.unique(r.multivariate_hypergeometric(np.full(n, size), taken, method="marginals"), return_counts=True), 1)
    have = np.zeros(size + 1, int)
    have[0] = n
    for k in r.multivariate_hypergeometric(np.full(size, n), taken, method="marginals"):
        hit = r.multivariate_hypergeometric(have, k, method="marginals")
        have -= hit
        have[1:] += hit[:-1]
    return np.stack([np.flatnonzero(have), have[have > 0]], 1)


def community_deals(before: np.ndarray, after: np.ndarray, size: np.ndarray, n: np.ndarray, count: int, seed) -> tuple[float, np.ndarray]:
    """``community_permutations`` from counts of communities: nodes dealt to a side of the old size fall to the communities of
    each size, and among these, by the multivariate hypergeometric law."""
    seen, take, all_ = community_groups_js(before, after, n), int((before * n).sum()), int((size * n).sum())
    if n.sum() < 2 or not 0 < take < all_:
        return (0.0 if seen != seen else seen), np.zeros(count)
    r, values = np.random.default_rng(seed), []
    sizes, at = np.unique(size, return_inverse=True)
    number = np.bincount(at, n).astype(int)
    for _ in range(count):
        groups = []
        for s, m, k in zip(sizes.tolist(), number.tolist(), r.multivariate_hypergeometric(sizes * number, take, method="marginals").tolist(), strict=True):
            h = hits_by_community(s, m, k, r)
            groups.append(np.stack([h[:, 0], s - h[:, 0], h[:, 1]], 1))
        values.append(js_of_groups(*np.concatenate(groups).T))
    return seen, np.array(values)


def distances_or_inf(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances where rows of ``y`` that are not finite are infinitely far."""
    out, ok = np.full((len(x), len(y)), np.inf), np.isfinite(y).all(1)
    out[:, ok] = distances(x, y[ok])
    return out


def lloyd(x: np.ndarray, k: int, seed: int = 0, rounds: int = 50) -> np.ndarray:
    """k-means labels from seeded farthest-leaning starts."""
    r = np.random.default_rng(seed)
    centers = [x[r.integers(len(x))]]
    for _ in range(k - 1):
        d = (distances(x, np.array(centers)) ** 2).min(1)
        centers.append(x[r.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[0])
    centers, label = np.array(centers), np.full(len(x), -1)
    for _ in range(rounds):
        new = distances(x, centers).argmin(1)
        if (new == label).all():
            break
        label = new
        centers = np.array([x[label == c].mean(0) if (label == c).any() else centers[c] for c in range(k)])
    return label


def spectral(x: np.ndarray, k: int, near: int = 15, seed: int = 0) -> np.ndarray:
    """Labels from the k lowest eigenvectors of the normalised Laplacian of the neighbour graph."""
    n = len(x)
    if n <= k:
        return np.arange(n)
    d, near = distances(x, x), min(near, n - 1)
    a = np.zeros((n, n))
    np.put_along_axis(a, np.argpartition(d, near, axis=1)[:, : near + 1], 1.0, axis=1)
    a = (a + a.T) / 2
    degree = np.sqrt(a.sum(1))
    v = np.linalg.eigh(np.eye(n) - a / np.outer(degree, degree))[1][:, :k]
    return lloyd(v / degree[:, None], k, seed)


def _spanning_tree(d: np.ndarray) -> list[tuple[float, int, int]]:
    n = len(d)
    best, source, inside = d[0].copy(), np.zeros(n, int), np.zeros(n, bool)
    inside[0], out = True, []
    for _ in range(n - 1):
        at = int(np.where(inside, np.inf, best).argmin())
        out.append((float(best[at]), int(source[at]), at))
        inside[at] = True
        closer = d[at] < best
        best[closer], source[closer] = d[at][closer], at
    return sorted(out)


def hdbscan(x: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(labels, core distances): clusters of ``least`` rows or more with the most excess of mass; -1 is noise.

    The tree of mutual reachability is walked from the root: a split counts where both sides hold ``least`` rows, else the
    smaller side leaves its cluster. A cluster wins over its descendants if its own stability is at least theirs; the root never does.
    """
    n = len(x)
    if n < max(least, 2):
        return np.full(n, -1), np.zeros(n)
    d = distances(x, x)
    np.fill_diagonal(d, 0)
    core = np.partition(d, min(least, n) - 1, axis=1)[:, min(least, n) - 1]
    tree = _spanning_tree(np.maximum(d, np.maximum(core[:, None], core[None, :])))
    owner, top = list(range(n)), list(range(n))
    kids: dict[int, tuple[int, int, float]] = {}
    size = [1] * n + [0] * (n - 1)

    def find(v: int) -> int:
        while owner[v] != v:
            owner[v] = owner[owner[v]]
            v = owner[v]
        return v

    for i, (w, a, b) in enumerate(tree):
        ra, rb, new = find(a), find(b), n + i
        kids[new], size[new] = (top[ra], top[rb], w), size[top[ra]] + size[top[rb]]
        owner[ra], top[rb] = rb, new

    born, stable, parent, under = {2 * n - 2: 0.0}, {2 * n - 2: 0.0}, {}, {2 * n - 2: []}
    stack = [(2 * n - 2, 2 * n - 2)]  # tree node, cluster that it continues
    while stack:
        node, cluster = stack.pop()
        if node < n:
            continue
        a, b, w = kids[node]
        level = 1 / max(w, 1e-12)
        if size[a] >= least and size[b] >= least:
            stable[cluster] += size[node] * (level - born[cluster])
            for c in (a, b):
                born[c], stable[c], parent[c], under[c] = level, 0.0, cluster, []
                under[cluster].append(c)
                stack.append((c, c))
            continue
        for c in (a, b):
            if size[c] >= least:
                stack.append((c, cluster))
            else:
                stable[cluster] += size[c] * (level - born[cluster])
    chosen: dict[int, list[int]] = {}
    mass: dict[int, float] = {}
    for c in sorted(born):  # children have smaller numbers than parents
        below = sum(mass[u] for u in under[c])
        if c != 2 * n - 2 and stable[c] >= below:
            mass[c], chosen[c] = stable[c], [c]
        else:
            mass[c], chosen[c] = below, [y for u in under[c] for y in chosen[u]]
    label = np.full(n, -1)
    for k, c in enumerate(sorted(chosen[2 * n - 2])):
        inside = [c]
        while inside:
            v = inside.pop()
            if v < n:
                label[v] = k
            else:
                inside += kids[v][:2]
    return label, core
