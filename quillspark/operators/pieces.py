"""Graphs of windows in pieces. A piece holds whole connected components of a window's graph, about ``ROWS`` edges of them, so
degrees, communities, largest components and ranks of a window, and their permutations, run piece by piece: no task sees a window."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import kernels as K
from quillspark.session import saved

from .components import components

C = F.col
ROWS = 50_000
BY = ["anchor", "width"]
_PIECE = "anchor int, width int, piece int, n int, n_before int, n_after int, links long, nodes array<long>, src array<int>, dst array<int>, side array<int>, before array<boolean>"


def pieces(edges: DataFrame, rows: int = ROWS) -> DataFrame:
    """A row for each piece of each window of ``edges`` (anchor, width, side, source_id, ref_id): its nodes in order, its distinct
    edges without loops as places among them with the sides they are on (1 before, 2 after, 3 both), which nodes an edge of the
    before side touches, and the numbers of nodes and of linked pairs. Only a single component of more edges makes a larger piece."""
    e = saved(edges.select(*[C(c).cast("int").alias(c) for c in BY], "side", *[C(c).cast("long").alias(c) for c in ("source_id", "ref_id")]).where("source_id is not null and ref_id is not null"))
    counts = [r["count"] for r in e.groupBy(*BY).count().collect()]  # a row a window
    n = max(1, -(-max(counts, default=0) // rows))
    label = components(e.select(C("source_id").alias("a"), C("ref_id").alias("b")))
    piece = F.pmod(F.xxhash64(F.coalesce("label", "source_id")), F.lit(n)).cast("int").alias("piece")
    dealt = e.join(label.withColumnRenamed("node", "source_id"), "source_id", "left").select(*BY, piece, "side", "source_id", "ref_id")

    def pack(key, g):
        nodes, ends = np.unique(g[["source_id", "ref_id"]].to_numpy(), return_inverse=True)
        ends = ends.reshape(-1, 2)
        is_before = (g.side == "before").to_numpy()
        before, after = (np.isin(np.arange(len(nodes)), ends[m]) for m in (is_before, ~is_before))
        code, at = np.unique(ends[:, 0] * len(nodes) + ends[:, 1], return_inverse=True)
        side = np.zeros(len(code), np.int32)
        np.bitwise_or.at(side, at.ravel(), np.where(is_before, 1, 2).astype(np.int32))
        src, dst = code // len(nodes), code % len(nodes)
        src, dst, side = src[src != dst], dst[src != dst], side[src != dst]
        links = len(np.unique(np.minimum(src, dst) * len(nodes) + np.maximum(src, dst)))
        return pd.DataFrame({"anchor": key[0], "width": key[1], "piece": key[2], "n": len(nodes), "n_before": int(before.sum()), "n_after": int(after.sum()), "links": links, "nodes": [nodes], "src": [src.astype("int32")], "dst": [dst.astype("int32")], "side": [side], "before": [before]})

    return saved(_spread(dealt, n * max(1, len(counts))).groupBy(*BY, "piece").applyInPandas(pack, _PIECE))


def _spread(df: DataFrame, groups: int) -> DataFrame:
    """So many partitions that few pieces share one."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(min(2_000, max(least, groups)), *BY, "piece")


def per_piece(p: DataFrame, f, schema: str) -> DataFrame:
    """``f(key, row)`` of every piece; anchor and width lead ``schema`` and are added here."""
    def one(key, g):
        out = [f(key, row) for row in g.itertuples(index=False)]
        out = pd.concat(out, ignore_index=True)
        out.insert(0, "width", key[1])
        out.insert(0, "anchor", key[0])
        return out

    return _spread(p, p.count()).groupBy(*BY, "piece").applyInPandas(one, f"anchor int, width int, {schema}")


class Dealer:
    """``n`` seeded choices of nodes of each window without replacement: as many as ``take`` says of its (n, n_before). How many
    fall to each piece is multivariate hypergeometric over the pieces' nodes, and inside a piece they are a permutation's first,
    so every set of that size is as likely as in a permutation of the whole window, and no task needs the others' nodes."""

    def __init__(self, p: DataFrame, n: int, tag: int, take):
        self.n, self.tag, self.windows = n, tag, {}
        for r in sorted(p.select(*BY, "piece", "n", "n_before").collect()):  # a row of numbers a piece
            self.windows.setdefault((r.anchor, r.width), []).append((r.piece, r.n, r.n_before))
        self.size = {w: int(take(sum(x[1] for x in v), sum(x[2] for x in v))) for w, v in self.windows.items()}

    def __call__(self, key, n: int):
        """Of each replicate, the chosen nodes of the piece ``key`` of ``n`` nodes."""
        window = self.windows[key[0], key[1]]
        sizes, at = np.array([x[1] for x in window]), [x[0] for x in window].index(key[2])
        for rep in range(self.n):
            seed = [self.tag, 100 * int(key[0]) + int(key[1]), rep]
            k = np.random.default_rng(seed).multivariate_hypergeometric(sizes, self.size[key[0], key[1]], method="marginals")[at]
            chosen = np.zeros(n, bool)
            chosen[np.random.default_rng([*seed, int(key[2])]).permutation(n)[:k]] = True
            yield rep, chosen


def communities(p: DataFrame, resolution: float = 1.0) -> DataFrame:
    """anchor, width, before, after, size, n: how many communities of the union of both sides have so many nodes, of them so many
    on each side. Louvain's gains depend on the rest of the graph only through its total weight, so components are moved apart."""
    m2 = {(r.anchor, r.width): 2.0 * r.m for r in p.groupBy(*BY).agg(F.sum("links").alias("m")).collect()}  # a row a window

    def one(key, r):
        graph = K.Graph(zip(r.src.tolist(), r.dst.tolist(), strict=True))
        label = np.unique(graph.louvain(resolution, m2[key[0], key[1]]), return_inverse=True)[1]
        names, count = np.array(graph.names, int), []
        for bit in (1, 2):
            on, at = np.zeros(len(r.nodes), bool), (r.side & bit) > 0
            on[r.src[at]] = on[r.dst[at]] = True
            count.append(np.bincount(label, on[names], label.max(initial=-1) + 1))
        c, n = np.unique(np.stack([*count, np.bincount(label, minlength=label.max(initial=-1) + 1)], 1).astype(int), axis=0, return_counts=True)
        return pd.DataFrame({"before": c[:, 0], "after": c[:, 1], "size": c[:, 2], "n": n})

    d = per_piece(p, one, "before long, after long, size long, n long")
    return d.groupBy(*BY, "before", "after", "size").agg(F.sum("n").alias("n"))


def degrees(p: DataFrame, dealer: Dealer, split: bool) -> DataFrame:
    """anchor, width, replicate, side (0 before, 1 after), k, n: how many nodes have in-degree k > 0, of the graphs of both sides as
    they are (replicate -1) and of each replicate. ``split``: chosen nodes are its before side, the others its after side, each with
    all edges inside; else chosen nodes stay on the sides they have."""
    def count(rep, dst, on, n):
        for side in (0, 1):
            k = np.bincount(np.bincount(dst[on == side], minlength=n))
            at = np.flatnonzero(k[1:]) + 1
            yield np.stack([np.full(len(at), rep), np.full(len(at), side), at, k[at]], 1)

    def one(key, r):
        n, out = len(r.nodes), []
        own = [(r.dst[(r.side & bit) > 0], side) for side, bit in enumerate((1, 2))]
        out += count(-1, np.concatenate([d for d, _ in own]), np.repeat([0, 1], [len(d) for d, _ in own]), n)
        for rep, chosen in dealer(key, n):
            a, b = chosen[r.src], chosen[r.dst]
            if split:
                out += count(rep, r.dst[a == b], 1 - a[a == b].astype(int), n)
            else:
                own = [r.dst[a & b & ((r.side & bit) > 0)] for bit in (1, 2)]
                out += count(rep, np.concatenate(own), np.repeat([0, 1], [len(d) for d in own]), n)
        return pd.DataFrame(np.concatenate(out).astype(np.int64), columns=["replicate", "side", "k", "n"])

    d = per_piece(p, one, "replicate long, side long, k long, n long")
    return d.groupBy(*BY, "replicate", "side", "k").agg(F.sum("n").alias("n"))


def component_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of ``n`` nodes reaches."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            return label
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label[label] != label).any():
            label = label[label]


def largest(p: DataFrame, dealer: Dealer | None) -> DataFrame:
    """anchor, width, replicate, side, src, dst: the edges of the largest component of each graph that ``degrees`` describes
    (ties: that of the smallest node). Every piece sends its own largest, the larger of which stay."""
    def best(rep, side, r, src, dst):
        if not len(src):
            return []
        label = component_labels(len(r.nodes), src, dst)
        top = int(np.bincount(label).argmax())
        at = label[src] == top
        size = int((label == top).sum())
        return [(rep, side, size, -int(r.nodes[top]), r.nodes[src[at]].tolist(), r.nodes[dst[at]].tolist())]

    def one(key, r):
        out = []
        for side, bit in enumerate((1, 2)):
            at = (r.side & bit) > 0
            out += best(-1, side, r, r.src[at], r.dst[at])
        for rep, chosen in dealer(key, len(r.nodes)) if dealer else ():
            a, b = chosen[r.src], chosen[r.dst]
            for side, at in enumerate((a & b, ~a & ~b)):
                out += best(rep, side, r, r.src[at], r.dst[at])
        return pd.DataFrame(out, columns=["replicate", "side", "size", "first", "src", "dst"])

    d = per_piece(p, one, "replicate long, side long, size long, first long, src array<long>, dst array<long>")
    d = d.groupBy(*BY, "replicate", "side").agg(F.max_by(F.struct("src", "dst"), F.struct("size", "first")).alias("e"))
    return d.select(*BY, "replicate", "side", "e.src", "e.dst")


def rank_profiles(p: DataFrame, dealer: Dealer | None, damping: float = 0.85, rounds: int = 200) -> DataFrame:
    """anchor, width, replicate, side (0 before, 1 after), steps, ends, n: how many nodes of each graph that ``degrees`` describes
    (split) share a profile. ``steps`` are doubles, what the node has after 0, 1, 2... rounds of passing on 1 from every node,
    zeros at the end left out; ``ends`` says that it cites nothing. PageRank's rounds are sums of these, with factors that a
    window's totals give, so a piece needs no other and equal nodes are one row.

    A round changes ranks by less than ``damping`` times the last, so none is needed beyond where that must have ended."""
    weight = np.random.default_rng(7).random(rounds + 2) + 0.5

    def profiles(rep, n, src, dst, side):
        if not len(src):
            return []
        out, used = np.bincount(src, minlength=n), np.zeros(n, bool)
        used[src] = used[dst] = True
        u, steps, key = used.astype(float), [], np.zeros(n)
        least = min(k for k in np.bincount(side[used]) if k)  # no more than the smaller graph has in all pieces
        most = min(rounds, int(np.ceil(np.log(1e-6 * least / 2) / np.log(damping))) + 2)
        share = 1.0 / out[src]
        for j in range(max(1, most) + 1):
            steps.append(u)
            key = key + weight[j] * u
            u = np.bincount(dst, u[src] * share, minlength=n)
            if not u.any():
                break
        rows = []
        for s in (0, 1):
            for ends in (False, True):
                at = np.flatnonzero(used & (side == s) & ((out == 0) == ends))
                if len(at):
                    _, first, count = np.unique(key[at], return_index=True, return_counts=True)
                    x = np.stack([v[at[first]] for v in steps], 1)
                    rows += [(rep, s, np.trim_zeros(v, "b").tobytes(), ends, int(c)) for v, c in zip(x, count, strict=True)]
        return rows

    def every(frames):
        """A frame for some replicates of a piece at a time: a piece whose nodes all differ is not held for all of them."""
        columns = ["replicate", "side", "steps", "ends", "n"]
        for g in frames:
            for r in g.itertuples(index=False):
                key, n, rows = (r.anchor, r.width, r.piece), len(r.nodes), []
                for s, bit in enumerate((1, 2)):
                    at = (r.side & bit) > 0
                    rows += profiles(-1, n, r.src[at], r.dst[at], np.full(n, s))
                for rep, chosen in dealer(key, n) if dealer else ():
                    same = chosen[r.src] == chosen[r.dst]
                    rows += profiles(rep, n, r.src[same], r.dst[same], 1 - chosen.astype(int))
                    if len(rows) > 20_000:
                        yield pd.DataFrame(rows, columns=columns).assign(anchor=r.anchor, width=r.width)
                        rows = []
                yield pd.DataFrame(rows, columns=columns).assign(anchor=r.anchor, width=r.width)

    d = _spread(p, p.count()).mapInPandas(every, "replicate long, side long, steps binary, ends boolean, n long, anchor int, width int")
    return d.groupBy(*BY, "replicate", "side", "steps", "ends").agg(F.sum("n").alias("n"))
