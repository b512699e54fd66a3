"""Graph measures by pieces against the same measures on whole windows."""

import numpy as np
import pytest

from quillspark.functions import kernels as K
from quillspark.operators import pieces as P


def window(seed=0, groups=40, size=6):
    """Edges (side, source, ref) of one window: small groups of nodes, linked at random on both sides, some groups in common."""
    r = np.random.default_rng(seed)
    out = []
    for side, first in (("before", 0), ("after", groups // 2)):
        for g in range(first, first + groups):
            a = r.integers(0, size, (8, 2)) + g * 100
            out += [(side, int(x), int(y)) for x, y in a if x != y]
    return out


def frame(spark, edges):
    return spark.createDataFrame([(2000, 1, *e) for e in edges], "anchor int, width int, side string, source_id long, ref_id long")


def sides(edges):
    return ([(a, b) for s, a, b in edges if s == side] for side in ("before", "after"))


def test_pieces_hold_whole_components(spark):
    edges = window()
    rows = P.pieces(frame(spark, edges), 20).collect()
    assert len(rows) > 5 and max(len(r.src) for r in rows) < len(set(edges)) / 3
    got = {(r.nodes[a], r.nodes[b], s) for r in rows for a, b, s in zip(r.src, r.dst, r.side)}
    want = {(a, b) for _, a, b in edges}
    before, after = map(set, sides(edges))
    assert got == {(a, b, ((a, b) in before) + 2 * ((a, b) in after)) for a, b in want}
    nodes = [v for r in rows for v in r.nodes]
    assert len(nodes) == len(set(nodes))


def test_communities_by_pieces_are_those_of_the_window(spark):
    edges = window()
    a, b = sides(edges)
    d = P.communities(P.pieces(frame(spark, edges), 20)).toPandas()
    graph = K.Graph([*a, *b])
    assert sorted(np.bincount(np.unique(graph.louvain(), return_inverse=True)[1]).tolist()) == sorted(np.repeat(d["size"], d.n).tolist())
    assert K.community_groups_js(*(d[c].to_numpy() for c in ("before", "after", "n"))) == pytest.approx(K.community_js(a, b))


def test_deals_of_counts_follow_permutations():
    a, b = sides(window())
    g = K.Graph([*a, *b])
    label = np.unique(g.louvain(), return_inverse=True)[1]
    on = [np.isin(g.names, [v for e in s for v in e]) for s in (a, b)]
    c, n = np.unique(np.stack([*(np.bincount(label, o) for o in on), np.bincount(label)], 1).astype(int), axis=0, return_counts=True)
    seen, null = K.community_deals(*c.T, n, 400, 3)
    other, plain = K.community_permutations(a, b, 400, 4)
    assert seen == pytest.approx(other) and len(null) == 400
    assert abs(null.mean() - plain.mean()) < 4 * plain.std() / 400**0.5 and abs(null.std() / plain.std() - 1) < 0.2


def test_hits_by_community_follow_plain_draws():
    r = np.random.default_rng(5)
    want = np.array([np.bincount(r.multivariate_hypergeometric(np.full(30, 3), 40), minlength=4) for _ in range(3000)])
    got = np.zeros((3000, 4), int)
    for row in got:
        for k, n in K.hits_by_community(3, 30, 40, r):
            row[k] = n
    assert (got.sum(1) == 30).all() and (got @ np.arange(4) == 40).all()
    assert np.abs(got.mean(0) - want.mean(0)).max() < 0.25 and np.abs(got.std(0) - want.std(0)).max() < 0.15


def plain(edges, method):
    a, b = map(K.Graph, sides(edges))
    f = {"G2": K.Graph.spectral_gap, "G5": K.Graph.exponent, "G6": lambda g: K.degree_entropy(*np.unique(np.bincount(g.dst)[np.bincount(g.dst) > 0], return_counts=True)), "G8": K.Graph.betweenness}[method]
    return abs(f(b) - f(a))


@pytest.mark.parametrize("method", ["G2", "G5", "G6", "G8"])
def test_series_by_pieces_equal_whole_windows(spark, monkeypatch, method):
    from quillspark.plans import kernels

    monkeypatch.setattr(P.pieces, "__defaults__", (20,))
    edges = window(3)
    (row,) = kernels.graph_series(frame(spark, edges), method).collect()
    assert row.value == pytest.approx(plain(edges, method))


@pytest.mark.parametrize("method", ["G2", "G5", "G6", "G8"])
def test_null_by_pieces_follows_permuted_windows(spark, monkeypatch, method):
    from quillspark.plans import kernels

    monkeypatch.setattr(P.pieces, "__defaults__", (20,))
    edges = window(4)
    (row,) = kernels.graph_null(frame(spark, edges), method, 300).collect()
    r, values = np.random.default_rng(1), []
    nodes, pairs = sorted({v for _, a, b in edges for v in (a, b)}), sorted({(a, b) for _, a, b in edges})
    size = len({v for s, a, b in edges if s == "before" for v in (a, b)})
    for _ in range(300):
        one = set(r.permutation(nodes)[:size].tolist())
        values.append(plain([("before" if a in one else "after", a, b) for a, b in pairs if (a in one) == (b in one)], method))
    values = np.array(values)
    assert row.observed == pytest.approx(plain(edges, method))
    assert abs(row.null_mean - np.nanmean(values)) < 6 * np.nanstd(values) / 300**0.5 and abs(row.null_std / np.nanstd(values) - 1) < 0.3


def test_subsample_keeps_its_share(spark, monkeypatch):
    monkeypatch.setattr(P.pieces, "__defaults__", (20,))
    p = P.pieces(frame(spark, window(5)))
    dealer = P.Dealer(p, 4, 1, lambda n, before: 0.8 * n)
    chosen = [sum(int(c.sum()) for r in p.collect() for i, c in dealer((r.anchor, r.width, r.piece), r.n) if i == rep) for rep in range(4)]
    assert chosen == [int(0.8 * sum(r.n for r in p.collect()))] * 4


def test_betweenness_counts_all_sources():
    import itertools

    r = np.random.default_rng(2)
    g = K.Graph([(i, i // 2) for i in range(1, 700)] + r.integers(0, 700, (60, 2)).tolist())
    near, part = g.neighbours(), g.largest()
    total = 0
    for s in part:
        dist, queue = {s: 0}, [s]
        for v in queue:
            for u in near[v]:
                if u not in dist:
                    dist[u] = dist[v] + 1
                    queue.append(u)
        total += sum(d - 1 for d in dist.values() if d)
    n = len(part)
    assert len(part) > 500 and g.betweenness() == pytest.approx(total / n / ((n - 1) * (n - 2)), rel=1e-12)
    star = K.Graph([(0, i) for i in itertools.chain(range(1, 601))])
    assert star.betweenness() == pytest.approx(1 / 601)


def test_ranks_by_profiles_are_those_of_whole_windows(spark, monkeypatch):
    from quillspark.plans import kernels as PK

    edges = window(3)
    monkeypatch.setattr(P, "ROWS", 20)
    monkeypatch.setattr(P.pieces, "__defaults__", (20,))
    a, b = map(K.Graph, sides(edges))
    got = PK.pagerank_series(frame(spark, edges)).collect()
    assert [r.value for r in got] == [pytest.approx(K.pagerank_js(a, b), abs=1e-12)]
    # permutations of the window, dealt as a whole
    r, nodes = np.random.default_rng(1), sorted({v for _, x, y in edges for v in (x, y)})
    first, pairs, plain = len({v for s, x, y in edges if s == "before" for v in (x, y)}), {(x, y) for _, x, y in edges}, []
    for _ in range(200):
        on = dict(zip(nodes, r.permutation(len(nodes)) < first))
        plain.append(K.pagerank_js(*(K.Graph([(x, y) for x, y in pairs if on[x] == on[y] == s]) for s in (True, False))))
    null = PK.pagerank_null(frame(spark, edges), 200).collect()
    assert len(null) == 1 and null[0].observed == pytest.approx(got[0].value)
    assert abs(null[0].null_mean - np.mean(plain)) < 5 * np.std(plain) / 200**0.5 * 2**0.5 and abs(null[0].null_std / np.std(plain) - 1) < 0.3
    most = P.rank_profiles(P.pieces(frame(spark, [("before", 10 * g, 10 * g + 1) for g in range(500)])), None).collect()
    assert sorted(x.n for x in most) == [500, 500]
