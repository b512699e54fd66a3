import numpy as np
import pytest

from quillspark.functions import kernels as K
from quillspark.operators import analysis as A
from quillspark.plans import kernels


def normal(n, d, shift=0.0, seed=0):
    return np.random.default_rng(seed).standard_normal((n, d)) + shift


def test_energy_and_permutations_agree():
    x, y = normal(30, 5), normal(40, 5, 0.2, 1)
    assert K.energy(x, x) == pytest.approx(0)
    null = K.energy_permutations(x, y, 50, 3)
    r = np.random.default_rng(3)
    z = np.vstack([x, y])
    for v in null[:5]:
        o = r.permutation(len(z))
        assert v == pytest.approx(K.energy(z[o[:30]], z[o[30:]]))


def test_planted_shift_is_found():
    seen, _, _, z, p = K.permutation_test(normal(80, 10), normal(80, 10, 3.0, 1), K.energy, 100, 1)
    assert z > 2 and p < 0.05 and seen > 0


def test_null_is_calibrated():
    zs = [K.permutation_test(normal(50, 10, seed=2 * i), normal(50, 10, seed=2 * i + 1), K.energy, 60, i)[3] for i in range(20)]
    assert abs(np.mean(zs)) < 1 and np.mean(np.abs(zs) > 3) < 0.3


def test_flat_null_gives_zero():
    assert K.permutation_test(normal(10, 2), normal(10, 2, 0, 1), lambda a, b: 1.0, 20, 0)[3] == 0.0


@pytest.mark.parametrize("f", [K.mmd2, K.sliced_wasserstein, K.frechet])
def test_distances_grow_with_shift(f):
    x = normal(60, 6)
    assert f(x, normal(60, 6, 2.0, 1)) > f(x, normal(60, 6, 0.0, 1)) >= 0


def test_c2st():
    assert abs(K.c2st(normal(100, 8), normal(100, 8, 0, 1))[0] - 0.5) < 0.15
    assert K.c2st(normal(100, 8), normal(100, 8, 1.5, 1))[0] > 0.9


def test_graph_measures():
    ring = K.Graph([(i, (i + 1) % 12) for i in range(12)])
    assert ring.pagerank() == pytest.approx(np.full(12, 1 / 12))
    assert ring.spectral_gap() == pytest.approx(1 - np.cos(2 * np.pi / 12))
    two = K.Graph([(a, b) for s in (0, 10) for a in range(s, s + 6) for b in range(a + 1, s + 6)] + [(0, 10)])
    label = two.louvain()
    assert len(set(label[:6])) == 1 and len(set(label[6:])) == 1 and label[0] != label[11]
    path = K.Graph([(0, 1), (1, 2)])
    assert path.betweenness() == pytest.approx(1 / 3)


def test_change_points_on_a_step():
    y = np.r_[np.zeros(10), np.ones(10) * 5] + np.random.default_rng(0).normal(0, 0.05, 20)
    assert K.dynp(y, 1) == [10] and K.dynp(y, 1, kernel=True) == [10]
    assert 10 in K.pelt((y - y.mean()) / y.std(), 1.0)


def test_power_law_exponent():
    edges = [(f"s{k}-{i}-{j}", f"t{k}-{i}") for k, n in ((1, 64), (2, 16), (4, 4), (8, 1)) for i in range(n) for j in range(k)]
    assert 1.0 < K.Graph(edges).exponent() < 3.5


def test_lanczos_gap_equals_dense_gap():
    r = np.random.default_rng(3)
    g = K.Graph(r.integers(0, 120, (400, 2)).tolist())
    assert abs(g.spectral_gap() - g.spectral_gap(dense=10)) < 1e-6


def test_lcs_with_shared_start():
    from quillspark.functions import similarity as S

    assert S.lcs("abcdef", "abcxef") == 5 and S.lcs("same", "same") == 4 and S.lcs("ab", "abcd") == 2 and S.lcs("xa", "ya") == 1


def test_density_and_spectral_clusters_find_separate_groups():
    x = np.vstack([normal(60, 3, s, s) for s in (0, 20, 40)] + [np.full((1, 3), 300.0)])
    label, core = K.hdbscan(x, 10)
    assert [len(set(label[i : i + 60])) for i in (0, 60, 120)] == [1, 1, 1] and len(set(label[:180])) == 3 and label[180] == -1 and len(core) == 181
    s = K.spectral(x[:180], 3)
    assert [len(set(s[i : i + 60])) for i in (0, 60, 120)] == [1, 1, 1] and len(set(s)) == 3
    assert K.hdbscan(x[:5], 10)[0].tolist() == [-1] * 5


def test_kernel_permutations_see_a_shift():
    x, y = normal(40, 4), normal(50, 4, 1.0, 1)
    seen, null = K.mmd_permutations(x, y, 200, 1)
    assert abs(seen - K.mmd2(x, y)) < 1e-9 and (null >= seen).mean() < 0.05
    seen, null = K.community_permutations([(i, i + 1) for i in range(20)], [(i, i + 1) for i in range(100, 120)], 100, 1)
    assert (null >= seen).mean() < 0.05


def test_null_model_blocks(spark):
    """Values of all blocks count once each, undefined ones not at all, and a window without any has no figures."""
    def null(g, count, seed):
        return (float(g.x.sum()), [float(seed[1])] * (count - 1) + [float("nan")]) if seed[0] != 50_201 else (float("nan"), [])

    df = spark.createDataFrame([(1, 1, 3.0), (1, 1, -1.0), (2, 1, 5.0)], "anchor int, width int, x double")
    got = {r.anchor: r for r in kernels.null_model(df, null, 25, 10).collect()}
    values = np.array([0.0] * 9 + [1.0] * 9 + [2.0] * 4)
    r = got[1]
    assert (r.observed, r.p_value) == (2.0, float((values >= 2).mean()))
    assert np.allclose([r.null_mean, r.null_std, r.z_score], [values.mean(), values.std(), (2 - values.mean()) / values.std()])
    assert got[2].observed is None and got[2].p_value is None


def test_burst_null(spark):
    """Shuffles of one bucket against a plain recount of each, several buckets against the same spread, no documents."""
    r = np.random.default_rng(3)
    words = [f"w{i:02d}" for i in range(12)]
    rows = [(i, " ".join(r.choice(words[: 4 + i % 9], 6)), 2000 + i % 5) for i in range(150)] + [(900, None, 2001), (901, "w01", None)]
    df = spark.createDataFrame(rows, "id long, text string, year int")
    full = [x for x in rows if x[2] is not None]
    top = 8
    n = {w: sum((t or "").split().count(w) for _, t, _ in rows) for w in words}
    best = sorted(words, key=lambda w: (-n[w], w))[:top]
    years = sorted({y for *_, y in full})
    counts = np.array([[(t or "").split().count(w) for w in best] for _, t, _ in full])

    def recount(y):
        f = np.array([counts[y == v].sum(0) / (y == v).sum() for v in years])
        return (((f - f.mean(0)) / np.where(f.std(0) > 0, f.std(0), np.inf)) > 1.5).sum(1)

    y = np.array([v for *_, v in full])
    null = np.array([recount(y[np.random.default_rng([rep, 0]).permutation(len(y))]) for rep in range(40)])
    got = {g.year: g for g in A.burst_null(df, "id", "text", "year", top, 1.5, n=40, block=15).collect()}
    for k, v in enumerate(years):
        assert got[v].observed == recount(y)[k]
        assert np.allclose([got[v].null_mean, got[v].null_std, got[v].p_value], [null[:, k].mean(), null[:, k].std(), (null[:, k] >= recount(y)[k]).mean()])
    many = {g.year: g for g in A.burst_null(df, "id", "text", "year", top, 1.5, n=200, rows=50).collect()}
    assert set(many) == set(years) and all(abs(many[v].null_mean - got[v].null_mean) < 0.6 for v in years)
    assert A.burst_null(df.where("id < 0"), "id", "text", "year", top).count() == 0
