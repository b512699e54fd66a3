"""The last queries: novelty, graph and lexical null models, robust breaks, spectra, labels and file round trips."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from quillspark.functions import kernels as KN
from quillspark.functions import similarity as S
from quillspark.operators import analysis as A
from quillspark.operators import relational as R
from quillspark.operators.fuzzy import fuzzy_links

from . import kernels, proxy
from .analysis import _TFIDF, _WIN, window_edges
from .more import _cocited
from .relational import C, r6

Q: dict = {}
SQL: dict[str, str] = {}


def op(name: str, *needs: str, sql: str | None = None):
    def put(f):
        Q[name] = lambda spark, sf_dir: f(*[proxy.view(spark, sf_dir, n) if n in proxy._TEXT else proxy.read(spark, sf_dir, n) for n in needs])
        if sql:
            views = [proxy.sql(n) for n in needs if n in proxy._TEXT]
            head = "WITH " + ", ".join(views) if views else ""
            SQL[name] = f"{head}, {sql.strip()[5:]}" if views and sql.strip().upper().startswith("WITH ") else f"{head} {sql}"
        return f

    return put


@op("DV_L2_novelty", "works", sql=f"""WITH {_TFIDF}, {_WIN.format(t='works')}, m AS (SELECT anchor, width, CASE WHEN year < anchor THEN 'b' ELSE 'a' END side, work_id FROM works JOIN a ON year BETWEEN anchor - width AND anchor - 1 OR year BETWEEN anchor + 1 AND anchor + width),
n AS (SELECT anchor, width, side, count(*) n FROM m GROUP BY 1, 2, 3), vt AS (SELECT DISTINCT term FROM vec), g AS (SELECT anchor, width, side, term, sum(weight) w FROM m JOIN vec USING (work_id) GROUP BY 1, 2, 3, 4),
x AS (SELECT n.anchor, n.width, n.side, vt.term, coalesce(w, 0) / n + 1e-10 v FROM n CROSS JOIN vt LEFT JOIN g ON g.anchor = n.anchor AND g.width = n.width AND g.side = n.side AND g.term = vt.term), q AS (SELECT anchor, width, side, term, v / sum(v) OVER (PARTITION BY anchor, width, side) q FROM x),
d AS (SELECT w.work_id, w.year, vt.term, coalesce(vec.weight, 0) + 1e-10 v FROM (SELECT work_id, year FROM works WHERE work_id IN (SELECT work_id FROM vec)) w CROSS JOIN vt LEFT JOIN vec ON vec.work_id = w.work_id AND vec.term = vt.term), p AS (SELECT work_id, year, term, v / sum(v) OVER (PARTITION BY work_id) p FROM d),
k AS (SELECT anchor, width, side, work_id, least(sum(p * ln(p / q)), 50) kl FROM p JOIN q ON q.anchor = p.year AND q.term = p.term GROUP BY 1, 2, 3, 4)
SELECT anchor, CAST(width AS INT) width, round(avg(kl) FILTER (WHERE side = 'b'), 6) novelty, round(avg(kl) FILTER (WHERE side = 'a'), 6) transience, round(avg(kl) FILTER (WHERE side = 'b') - avg(kl) FILTER (WHERE side = 'a'), 6) resonance FROM k GROUP BY 1, 2""")
def _(works):
    members = R.windows_before_after(works.select("work_id", "year"), "year", (1, 2), 1)
    d = A.novelty(A.tfidf(works, "work_id", "abstract"), works, members, "work_id", "year")
    return d.select("anchor", "width", *[r6(C(c), c) for c in ("novelty", "transience", "resonance")])


@op("DV_G4_cross_tradition", "inner_edges", sql="WITH s AS (SELECT source_year, count(*) n, count(*) FILTER (WHERE source_id % 2 <> ref_id % 2) k FROM inner_edges GROUP BY 1) SELECT source_year AS year, CASE WHEN n >= 2 THEN round(k / n, 6) END AS value FROM s")
def _(edges):
    """The share of each year's edge rows across a given two-way split."""
    s = edges.groupBy(C("source_year").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(C("source_id") % 2 != C("ref_id") % 2, 1)).alias("k"))
    return s.select("year", F.when(C("n") >= 2, F.round(C("k") / C("n"), 6)).alias("value"))


@op("DV_G4_bisection", "edges")
def _(edges):
    """Sign of the second eigenvector of the co-citation network of the top works: the split of a network of bounded size."""
    def one(g):
        graph = KN.Graph(list(zip(g.a, g.b, strict=True)))
        a = np.zeros((graph.n, graph.n))
        a[graph.src, graph.dst] = a[graph.dst, graph.src] = 1
        d = np.maximum(a.sum(1), 1)
        v = np.linalg.eigh(np.eye(graph.n) - a / np.sqrt(d[:, None] * d[None, :]))[1][:, 1]
        v = v if v[np.argmax(np.abs(v))] > 0 else -v
        return pd.DataFrame({"node": graph.names, "part": (v > 0).astype(int)})

    return _cocited(edges).groupBy(F.lit("all").alias("all")).applyInPandas(one, "node long, part int")


@op("DV_C2_c2st_lexical", "works")
def _(works):
    """Classifier test on TF-IDF over the whole vocabulary: rows travel as maps and are dense only inside a window's task."""
    def one(key, g):
        g = g.sort_values("work_id")
        x, y = (kernels.dense(g.m[g.side == s].tolist()) for s in ("before", "after"))
        auc, sd = KN.c2st(x, y, seed=100 * key[0] + key[1]) if min(len(x), len(y)) >= 10 else (None, None)
        return pd.DataFrame({"anchor": [key[0]], "width": [key[1]], "value": [auc], "auc_std": [sd]})

    members = kernels.lexical_members(works).where("side <> 'now'")
    return members.groupBy("anchor", "width").applyInPandas(one, "anchor int, width int, value double, auc_std double")


for _n in ("UN_07_null_G5", "UN_07_null_G6", "UN_07_null_G8", "UN_09_null_G2"):
    op(_n, "inner_edges")(lambda edges, _m=_n[-2:]: kernels.graph_null(window_edges(edges), _m))


op("UN_08_null_G1", "inner_edges")(lambda edges: kernels.pagerank_null(window_edges(edges)))


@op("UN_13_graph_subsample", "inner_edges")
def _(edges):
    """Entropy change on 80 % of the nodes, without replacement, replicates as rows."""
    return kernels.graph_subsample(window_edges(edges), "G6", 5, 0.8)


@op("UN_06_null_bursts", "works")
def _(works):
    return A.burst_null(works, "work_id", "abstract", "year", top=50)


@op("BK_03_robust_breaks", "papers", sql="WITH z AS (SELECT venue, year, (v - avg(v) OVER w) / nullif(stddev_samp(v) OVER w, 0) z FROM (SELECT venue, year, count(*) v FROM papers GROUP BY 1, 2) WINDOW w AS (PARTITION BY venue)), p AS (SELECT venue, year FROM (SELECT *, lag(z) OVER o a, lead(z) OVER o b FROM z WINDOW o AS (PARTITION BY venue ORDER BY year)) WHERE z > 0.5 AND z > a AND z > b), c AS (SELECT DISTINCT year y FROM p) SELECT y AS year, count(DISTINCT venue) support FROM c JOIN p ON abs(p.year - y) <= 1 GROUP BY 1 HAVING count(DISTINCT venue) >= 2")
def _(papers):
    """Peaks that at least two series have within a year."""
    z = R.zscore(papers.groupBy("venue", "year").agg(F.count(F.lit(1)).alias("v")), ["venue"], "v")
    p = R.local_maxima(z.select("venue", "year", "z"), ["venue"], "year", "z", 0.5).select("venue", "year")
    near = p.withColumn("year", F.explode(F.array(C("year") - 1, C("year"), C("year") + 1)))
    return near.join(p.select("year").distinct(), "year").groupBy("year").agg(F.countDistinct("venue").alias("support")).where("support >= 2")


@op("BK_05_k_sensitivity", "embeddings")
def _(embeddings):
    """JS (base 2) of cluster shares around each anchor for several k."""
    v = embeddings.select("vec_id", C("label").alias("year"), array_to_vector("embedding").alias("features")).persist()
    out = None
    for k in (4, 6):
        c = KMeans(k=k, seed=1, maxIter=10).fit(v).transform(v).select("year", C("prediction").alias("c"))
        m = R.windows_before_after(c, "year", (2,), 1).groupBy("anchor", "width", "c").agg(F.count(F.when(C("side") == "before", 1)).alias("p"), F.count(F.when(C("side") == "after", 1)).alias("q"))
        d = R.js_divergence(m, ["anchor", "width"], "c", "p", "q", base=2).withColumn("k", F.lit(k))
        out = d if out is None else out.unionByName(d)
    return out


@op("EM_06_silhouette", "embeddings")
def _(embeddings):
    v = embeddings.select(array_to_vector("embedding").alias("features")).persist()
    rows = [(k, float(ClusteringEvaluator().evaluate(KMeans(k=k, seed=1, maxIter=10).fit(v).transform(v)))) for k in (3, 6)]
    return embeddings.sparkSession.createDataFrame(rows, "k int, silhouette double")


@op("EM_16_coupling_space", "edges")
def _(edges):
    """SVD of the coupling counts of a bounded set of works: one task, a few hundred nodes."""
    def one(g):
        names = sorted(set(g.a) | set(g.b))
        at, m = {v: i for i, v in enumerate(names)}, np.zeros((len(names), len(names)))
        for a, b, n in zip(g.a, g.b, g.n, strict=True):
            m[at[a], at[b]] = m[at[b], at[a]] = n
        u, s, _ = np.linalg.svd(m)
        x = np.abs(u[:, :2] * s[:2])
        return pd.DataFrame({"node": names, "x": x[:, 0], "y": x[:, 1]})

    return _cocited(edges, 100).groupBy(F.lit("all").alias("all")).applyInPandas(one, "node long, x double, y double")


@op("LX_06_cluster_labels", "works", sql=f"WITH {_TFIDF}, m AS (SELECT lang, term, sum(weight) / (SELECT count(*) FROM works x WHERE x.lang = w.lang) v FROM vec JOIN works w USING (work_id) GROUP BY lang, term), o AS (SELECT term, sum(weight) / (SELECT count(*) FROM works) v FROM vec GROUP BY 1) SELECT lang, term, round(d, 6) d FROM (SELECT lang, m.term, m.v - o.v d, row_number() OVER (PARTITION BY lang ORDER BY round(m.v - o.v, 9) DESC, m.term) r FROM m JOIN o USING (term)) WHERE r <= 10")
def _(works):
    w = A.saved(A.tfidf(works, "work_id", "abstract")).join(works.select("work_id", "lang"), "work_id")
    n = works.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("t"))
    m = w.groupBy("lang", "term").agg(F.sum("weight").alias("v")).join(F.broadcast(n), "lang")
    o = w.groupBy("term").agg(F.sum("weight").alias("o")).crossJoin(F.broadcast(total))
    d = m.join(o, "term").select("lang", "term", (C("v") / C("n") - C("o") / C("t")).alias("d"))
    return R.top_per_group(d, ["lang"], 10, F.desc(F.round("d", 9)), C("term")).select("lang", "term", r6(C("d"), "d"))


@op("LX_08_fuzzy_titles", "works")
def _(works):
    """Titles of four words or more with at least half of their distinct words in common, and any two of at most 64 characters,
    scored whole, linked from 75. Equal titles are one node (the smallest work). Words are those that the score compares."""
    t = works.where(F.size(F.split("title", " ")) >= 4).groupBy("title").agg(F.min("work_id").alias("work_id"))
    return fuzzy_links(t, "work_id", "title")


@op("GR_13_tradition_names", "works", sql="SELECT lang, count(*) FILTER (WHERE contains(first_author, 'Author1')) one, count(*) FILTER (WHERE contains(first_author, 'Author2')) two FROM works GROUP BY 1")
def _(works):
    n = lambda k: F.count(F.when(F.contains("first_author", F.lit(k)), 1))
    return works.groupBy("lang").agg(n("Author1").alias("one"), n("Author2").alias("two"))


@op("PL_05_outlier_flag", "works", "embeddings", sql="WITH e AS (SELECT vec_id, [CAST(x AS DOUBLE) for x in embedding] v FROM embeddings), c AS (SELECT list(m ORDER BY i) c FROM (SELECT i, avg(x) m FROM (SELECT unnest(v) x, unnest(range(len(v))) i FROM e) GROUP BY 1)), d AS (SELECT vec_id, 1 - list_cosine_similarity(v, c) d FROM e, c) SELECT work_id, coalesce(d > (SELECT avg(d) + stddev_pop(d) FROM d), false) semantic_outlier FROM works LEFT JOIN d ON vec_id = work_id")
def _(works, embeddings):
    o = A.semantic_outliers(embeddings, "vec_id", "embedding", 1.0).select(C("vec_id").alias("work_id"), "outlier")
    return works.select("work_id").join(o, "work_id", "left").select("work_id", F.coalesce("outlier", F.lit(False)).alias("semantic_outlier"))


@op("PL_16_normalize_readings", "works", sql="WITH k AS (SELECT lower(trim(title)) k, string_agg(DISTINCT source, ' ; ' ORDER BY source) courses, count(DISTINCT source) n_courses, min(work_id) work_id FROM works WHERE trim(title) <> '' GROUP BY 1) SELECT work_id, courses, n_courses FROM k")
def _(works):
    k = works.where("trim(title) <> ''").groupBy(F.lower(F.trim("title")).alias("k"))
    return k.agg(F.array_join(F.array_sort(F.collect_set("source")), " ; ").alias("courses"), F.countDistinct("source").alias("n_courses"), F.min("work_id").alias("work_id")).drop("k")


@op("SL_08_random_pairs", "embeddings")
def _(embeddings):
    """Cosine of seeded pairs inside and across labels: each row meets the next in a seeded order of its random bucket, no pair
    list is made. Buckets hold about 20,000 rows and grow in number with the table."""
    w = R.Window.partitionBy("bucket").orderBy(F.xxhash64("vec_id", F.lit(5)))
    inside = R.Window.partitionBy("bucket", "label").orderBy(F.xxhash64("vec_id", F.lit(5)))
    embeddings = embeddings.withColumn("bucket", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-embeddings.count() // 20_000)))))
    cos = lambda o: A.dot("embedding", o) / (A.norm("embedding") * A.norm(o))
    d = embeddings.select("label", "embedding", F.lead("embedding").over(inside).alias("same"), F.lead("embedding").over(w).alias("other"), F.lead("label").over(w).alias("other_label"))
    return d.agg(F.avg(F.when(C("same").isNotNull(), cos("same"))).alias("within"), F.avg(F.when(C("other").isNotNull() & (C("label") != C("other_label")), cos("other"))).alias("between"))


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
