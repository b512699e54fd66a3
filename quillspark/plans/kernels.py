"""Windows and series handed to numeric kernels. A group is one window, each side capped at ``most`` rows by a seeded hash (a
parameter of the methods themselves), so no group grows with the corpus. Seeds come from anchor and width: results don't
depend on how the rows are partitioned."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import kernels as K
from quillspark.operators import analysis as A
from quillspark.operators import pieces as P
from quillspark.operators import relational as R
from quillspark.session import saved

from . import proxy

C = F.col
MOST = 2000


def window_members(embeddings: DataFrame, widths: tuple[int, ...], gap: int = 1, most: int = MOST) -> DataFrame:
    m = R.windows_before_after(embeddings.select("vec_id", "embedding", C("label").alias("year")), "year", widths, gap)
    w = Window.partitionBy("anchor", "width", "side").orderBy(F.xxhash64("vec_id"), "vec_id")
    return m.withColumn("_r", F.row_number().over(w)).where(C("_r") <= most).drop("_r")


def _sides(g: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    g = g.sort_values("vec_id")
    x, y = (np.array(g.embedding[g.side == s].tolist(), float) for s in ("before", "after"))
    return x, y


def semantic(embeddings: DataFrame, method: str, widths: tuple[int, ...] = (2, 3), least: int = 10) -> DataFrame:
    """anchor, width, value of one of S1 to S4; null below ``least`` rows a side."""
    def one(key, g):
        x, y = _sides(g)
        value = K.SEMANTIC[method](x, y) if min(len(x), len(y)) >= least else None
        return pd.DataFrame({"anchor": [key[0]], "width": [key[1]], "value": [value]})

    return window_members(embeddings, widths).groupBy("anchor", "width").applyInPandas(one, "anchor int, width int, value double")


def classifier_test(embeddings: DataFrame, widths: tuple[int, ...] = (2, 3)) -> DataFrame:
    def one(key, g):
        auc, sd = K.c2st(*_sides(g), seed=100 * key[0] + key[1])
        return pd.DataFrame({"anchor": [key[0]], "width": [key[1]], "value": [auc], "auc_std": [sd]})

    return window_members(embeddings, widths).groupBy("anchor", "width").applyInPandas(one, "anchor int, width int, value double, auc_std double")


NULL = "anchor int, width int, observed double, null_mean double, null_std double, z_score double, p_value double"
REPLICATES = 500


def null_model(members: DataFrame, null, n: int = REPLICATES, block: int = 50) -> DataFrame:
    """anchor, width, observed, null_mean, null_std, z_score, p_value (share of the null at or above) of each window.

    ``null(g, count, seed)`` gives a window's statistic and ``count`` values of it under permutations. A task makes one block of
    replicates, with a seed of its window and block: a window's rows (bounded by ``MOST``, or a window's edges) are sent once a
    block, and the values come back a row each. Undefined values don't count; where none is left, or the statistic itself is
    undefined, all figures are null.
    """
    def one(key, g):
        seen, values = null(g, min(block, n - key[2] * block), [50_000 + 100 * key[0] + key[1], key[2]])
        return pd.DataFrame({"anchor": key[0], "width": key[1], "seen": float(seen), "value": np.asarray(values if len(values) else [np.nan], float)})

    m = members.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(-(-n // block) - 1))))
    v = m.groupBy("anchor", "width", "block").applyInPandas(one, "anchor int, width int, seen double, value double")
    return figures(v)


def figures(v: DataFrame) -> DataFrame:
    """The columns of ``null_model`` from rows of a window's statistic (seen) and one value under a permutation (value)."""
    v = v.select("anchor", "width", *[F.when(~F.isnan(c), C(c)).alias(c) for c in ("seen", "value")])
    d = v.groupBy("anchor", "width").agg(F.max("seen").alias("observed"), F.avg("value").alias("null_mean"), F.stddev_pop("value").alias("null_std"), F.avg(F.when(C("value").isNotNull(), (C("value") >= C("seen")).cast("double"))).alias("p_value"))
    ok = C("observed").isNotNull() & C("null_mean").isNotNull()
    z = F.when(C("null_std") > 0, (C("observed") - C("null_mean")) / C("null_std")).otherwise(0.0)
    return d.withColumn("z_score", z).select("anchor", "width", *[F.when(ok, C(c)).alias(c) for c in ("observed", "null_mean", "null_std", "z_score", "p_value")])


def semantic_null(statistic, reduce=None):
    """A null of ``statistic`` by permuted sides; ``reduce`` maps the pooled rows once."""
    def null(g, count, seed):
        x, y = _sides(g)
        z, r = np.vstack([x, y]), np.random.default_rng(seed)
        z = reduce(z) if reduce else z
        deal = lambda o: statistic(z[o[: len(x)]], z[o[len(x) :]])
        return deal(np.arange(len(z))), [deal(r.permutation(len(z))) for _ in range(count)]

    return null


def permutations(embeddings: DataFrame, n: int = REPLICATES, widths: tuple[int, ...] = (2, 3)) -> DataFrame:
    """Energy distance against label permutations of one pooled distance matrix."""
    def null(g, count, seed):
        x, y = _sides(g)
        return K.energy(x, y), K.energy_permutations(x, y, count, seed)

    return null_model(window_members(embeddings, widths), null, n, 250)


def bootstrap(embeddings: DataFrame, replicates: int = 200, fraction: float | None = None, widths: tuple[int, ...] = (2,)) -> DataFrame:
    """Energy distance of resampled windows: with replacement, or ``fraction`` of the smaller side without. Replicates are rows,
    so they spread over tasks."""
    def one(key, g):
        x, y = _sides(g)
        r = np.random.default_rng(key[0] * 100_000 + key[1] * 1_000 + key[2])
        if fraction is None:
            a, b = x[r.integers(0, len(x), len(x))], y[r.integers(0, len(y), len(y))]
        else:
            n = max(2, int(fraction * min(len(x), len(y))))
            a, b = x[r.choice(len(x), n, replace=False)], y[r.choice(len(y), n, replace=False)]
        return pd.DataFrame({"anchor": [key[0]], "width": [key[1]], "replicate": [key[2]], "value": [K.energy(a, b)]})

    m = window_members(embeddings, widths).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    return m.groupBy("anchor", "width", "replicate").applyInPandas(one, "anchor int, width int, replicate int, value double")


def lexical_members(works, terms=5000, widths=(1, 2)):
    """anchor, width, side (before, now, after), work_id, m: the works of each window by seeded hash, at most
    ``MOST`` a side, with their TF-IDF weights as a map over a vocabulary of ``terms``."""
    weights = saved(A.tfidf(works, "work_id", "abstract", 3, terms))
    index = weights.select("term").distinct().select("term", (F.row_number().over(Window.orderBy("term")) - 1).alias("i"))
    rows = weights.join(F.broadcast(index), "term").groupBy("work_id").agg(F.map_from_entries(F.collect_list(F.struct("i", "weight"))).alias("m"))
    years = works.select("work_id", "year")
    m = R.windows_before_after(years, "year", widths, 1).select("work_id", "anchor", "width", "side")
    now = m.select("anchor", "width").distinct().join(years.withColumnRenamed("year", "anchor"), "anchor").select("work_id", "anchor", "width", F.lit("now").alias("side"))
    w = Window.partitionBy("anchor", "width", "side").orderBy(F.xxhash64("work_id"), "work_id")
    some = m.unionByName(now).withColumn("_r", F.row_number().over(w)).where(C("_r") <= MOST).drop("_r")
    return some.join(rows, "work_id")


def dense(maps, terms=5000):
    x = np.zeros((len(maps), terms))
    for i, m in enumerate(maps):
        m = dict(m)
        x[i, list(m)] = list(m.values())
    return x


def _by_side(d: DataFrame, measure, change) -> DataFrame:
    """anchor, width, replicate, value: ``change`` between what ``measure`` gives of both sides' rows, nan for a side without rows.
    Replicates are dealt to tasks."""
    def one(key, g):
        out = []
        for rep, h in g.groupby("replicate"):
            a, b = (measure(h[h.side == s]) if (h.side == s).any() else math.nan for s in (0, 1))
            out.append((*key[:2], rep, change(a, b)))
        return pd.DataFrame(out, columns=["anchor", "width", "replicate", "value"])

    d = d.withColumn("part", F.pmod("replicate", F.lit(20)))
    return d.groupBy(*P.BY, "part").applyInPandas(one, "anchor int, width int, replicate long, value double")


def _degree_measure(f):
    def measure(h):
        h = h.sort_values("k")
        return f(h.k.to_numpy(), h.n.to_numpy())

    return measure


def _component_measure(f):
    return lambda h: f(K.Graph(zip(h.src.iloc[0].tolist(), h.dst.iloc[0].tolist(), strict=True)))


#: By method: what a side is described by, and the measure of it.
GRAPH = {
    "G2": (P.largest, _component_measure(K.Graph.spectral_gap)), "G8": (P.largest, _component_measure(K.Graph.betweenness)),
    "G5": (P.degrees, _degree_measure(K.degree_exponent)), "G6": (P.degrees, _degree_measure(K.degree_entropy)),
}


def _replicates(edges: DataFrame, method: str, n: int, tag: int, take=lambda n, before: before, split: bool = True) -> DataFrame:
    """anchor, width, replicate (-1: as it is), value: a measure's change from before to after each anchor, in all windows."""
    p = P.pieces(edges)
    describe, measure = GRAPH[method]
    dealer = P.Dealer(p, n, tag, take)
    d = describe(p, dealer, split) if describe is P.degrees else describe(p, dealer)
    v = _by_side(d, measure, lambda a, b: abs(b - a))
    spine = p.select(*P.BY).distinct().withColumn("replicate", F.explode(F.sequence(F.lit(-1).cast("long"), F.lit(n - 1).cast("long"))))
    return spine.join(v, [*P.BY, "replicate"], "left").withColumn("value", F.when(~F.isnan("value"), C("value")))


def graph_null(edges: DataFrame, method: str, n: int = REPLICATES) -> DataFrame:
    """Nodes of the union keep their edges and swap sides; the change between the graphs that the sides induce."""
    v = saved(_replicates(edges, method, n, 50_000))
    seen = v.where("replicate = -1").select(*P.BY, C("value").alias("seen"))
    return figures(v.where("replicate >= 0").join(seen, P.BY).select(*P.BY, "seen", "value"))


def graph_subsample(edges: DataFrame, method: str, n: int, share: float) -> DataFrame:
    """anchor, width, replicate, value: the change on a share of the window's nodes, without replacement."""
    v = _replicates(edges, method, n, 100_000, lambda n, before: share * n, split=False)
    return v.where("replicate >= 0").select(*P.BY, C("replicate").cast("int").alias("replicate"), "value")


def graph_series(edges: DataFrame, method: str) -> DataFrame:
    """anchor, width, value: a graph measure's change from before to after each anchor. ``edges``: anchor, width, side,
    source_id, ref_id."""
    if method == "G9":
        def one(key, g):
            value = K.community_groups_js(*(g[c].to_numpy() for c in ("before", "after", "n")))
            some = all((g[c] * g.n).sum() for c in ("before", "after"))
            return pd.DataFrame({"anchor": [key[0]], "width": [key[1]], "value": [value if some and value == value else None]})

        return P.communities(P.pieces(edges)).groupBy(*P.BY).applyInPandas(one, "anchor int, width int, value double")
    if method == "G1":
        return pagerank_series(edges)
    return _replicates(edges, method, 0, 0).select(*P.BY, "value")


def _rank_changes(p: DataFrame, dealer) -> DataFrame:
    """anchor, width, replicate, value: the divergence of both sides' ranks. A task sees a replicate's distinct profiles only."""
    def one(key, g):
        width = max(len(s) for s in g.steps) // 8
        steps = np.zeros((len(g), width))
        for row, s in zip(steps, g.steps, strict=True):
            row[: len(s) // 8] = np.frombuffer(s)
        parts = [(steps[m], g.ends.to_numpy(bool)[m], g.n.to_numpy(float)[m]) for m in ((g.side == s).to_numpy() for s in (0, 1))]
        value = K.profiles_js(parts)
        return pd.DataFrame({"anchor": [key[0]], "width": [key[1]], "replicate": [key[2]], "value": [None if value != value else value]})

    return P.rank_profiles(p, dealer).groupBy(*P.BY, "replicate").applyInPandas(one, "anchor int, width int, replicate long, value double")


def pagerank_series(edges: DataFrame) -> DataFrame:
    """anchor, width, value; null where a side has no edges."""
    p = P.pieces(edges)
    both = p.groupBy(*P.BY).agg((F.sum("n_before") > 0).alias("b"), (F.sum("n_after") > 0).alias("a"))
    return both.join(_rank_changes(p, None), P.BY, "left").select(*P.BY, F.when(C("a") & C("b"), C("value")).alias("value"))


def pagerank_null(edges: DataFrame, n: int = REPLICATES) -> DataFrame:
    """As ``graph_null``, of ranks."""
    p = P.pieces(edges)
    v = saved(_rank_changes(p, P.Dealer(p, n, 50_000, lambda n, before: before)))
    spine = p.select(*P.BY).distinct().withColumn("replicate", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    seen = v.where("replicate = -1").select(*P.BY, C("value").alias("seen"))
    return figures(spine.join(v, [*P.BY, "replicate"], "left").join(seen, P.BY, "left").select(*P.BY, "seen", "value"))


def change_points(series: DataFrame, by: list[str], t: str, x: str) -> DataFrame:
    """by..., detector, params, break_years: PELT, exact segmentation with 1 to 3 breaks, and kernel segmentation of each series."""
    def one(key, g):
        g = g.dropna(subset=[x]).sort_values(t)
        y, years, rows = g[x].to_numpy(float), g[t].to_numpy(), []
        if len(y) >= 5:
            y = (y - y.mean()) / (y.std() or 1.0)
            for p in (1.0, 3.0, 5.0):
                rows.append(("pelt", f"pen={p:g}", K.pelt(y, p)))
            for n in (1, 2, 3):
                rows += [("dynp", f"n={n}", K.dynp(y, n)), ("kernel_cpd", f"n={n}", K.dynp(y, n, kernel=True))]
        return pd.DataFrame([(*key, d, p, ";".join(str(int(years[i])) for i in b)) for d, p, b in rows], columns=[*by, "detector", "params", "break_years"])

    kinds = ", ".join(f"{c} {k}" for c, k in series.select(*by).dtypes)
    return series.groupBy(*by).applyInPandas(one, f"{kinds}, detector string, params string, break_years string")


def _edges(spark, sf_dir):
    from .analysis import window_edges

    return window_edges(proxy.view(spark, sf_dir, "inner_edges"))


def _series(spark, sf_dir):
    p = proxy.view(spark, sf_dir, "papers")
    return p.groupBy("venue", "year").agg(F.avg("price").alias("v"))


def queries() -> dict:
    e = lambda s, d: proxy.read(s, d, "embeddings")
    out = {f"DV_{m}": (lambda s, d, m=m: semantic(e(s, d), m)) for m in ("S1", "S3", "S4")}
    out |= {f"DV_{m}": (lambda s, d, m=m: graph_series(_edges(s, d), m)) for m in ("G1", "G2", "G5", "G8", "G9")}
    return out | {
        "DV_C1_c2st": lambda s, d: classifier_test(e(s, d)),
        "UN_01_permutation": lambda s, d: permutations(e(s, d)),
        "UN_12_bootstrap": lambda s, d: bootstrap(e(s, d)),
        "UN_14_subsample": lambda s, d: bootstrap(e(s, d), 20, 0.8),
        "BK_09_change_points": lambda s, d: change_points(_series(s, d), ["venue"], "year", "v"),
    }


def oracle_sql() -> dict[str, str]:
    return {}
