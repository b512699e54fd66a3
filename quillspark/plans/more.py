"""Further queries: similarity joins, sampling and quotas, clustering, networks, replicates and summaries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.functions import kernels as KN
from quillspark.functions import similarity as S
from quillspark.functions import text as T
from quillspark.operators import analysis as A
from quillspark.operators import corpus as O
from quillspark.operators import relational as R

from . import kernels, proxy
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


@op("FN_08_inverted_index", "works", sql="SELECT work_id, concat_ws(' ', source, lang, source) AS out FROM works")
def _(works):
    x = F.from_json(F.concat(F.lit('{"'), "source", F.lit('": [0, 2], "'), "lang", F.lit('": [1]}')), "map<string,array<int>>")
    return works.select("work_id", T.invert_index(x).alias("out"))


_COUNTS = ", ".join(f"len([x for x in w if x in ({', '.join(repr(v) for v in words.split())})]) {k}" for k, words in S.STOP_WORDS.items())
_DETECTED = f"""s AS (SELECT work_id, lang, abstract, regexp_split_to_array(lower(abstract), '[^\\p{{L}}]+') w FROM works), n AS (SELECT work_id, lang, abstract, {_COUNTS} FROM s),
d AS (SELECT work_id, lang, abstract, CASE WHEN length(trim(abstract)) >= 20 AND greatest(de, en, es, fr) > 0 THEN CASE greatest(de, en, es, fr) WHEN de THEN 'de' WHEN en THEN 'en' WHEN es THEN 'es' ELSE 'fr' END END detected FROM n)"""


@op("FN_11_detect_language", "works", sql=f"WITH {_DETECTED} SELECT work_id, lang, detected FROM d")
def _(works):
    return works.select("work_id", "lang", S.detect_language(C("abstract")).alias("detected"))


@op("FN_05_repair_text", "works")
def _(works):
    return works.select("work_id", S.repair_text(F.concat("title", F.lit(" &amp;amp; x"))).alias("out"))


@op("FN_40_title_similarity", "works")
def _(works):
    return works.select("work_id", S.title_similarity("title", F.reverse("title")).alias("out"))


@op("FN_41_token_sort_ratio", "works")
def _(works):
    return works.select("work_id", S.token_sort_ratio("title", F.substring("title", 1, 40)).alias("out"))


@op("FN_45_robust_minmax", "papers", sql="WITH q AS (SELECT quantile_cont(price, 0.01) lo, quantile_cont(price, 0.99) hi FROM papers) SELECT source_id, work_id, round(CASE WHEN hi > lo THEN (least(greatest(price, lo), hi) - lo) / (hi - lo) ELSE 0 END, 6) score FROM papers, q")
def _(papers):
    q = R.exact_quantiles(papers, "price", {"lo": 0.01, "hi": 0.99})
    s = (F.least(F.greatest("price", "lo"), "hi") - C("lo")) / (C("hi") - C("lo"))
    return papers.crossJoin(F.broadcast(q)).select("source_id", "work_id", r6(F.when(C("hi") > C("lo"), s).otherwise(0.0), "score"))


@op("FN_48_number_format", "works", sql="SELECT work_id, format('{:,}', cited_by_count * 1234) || ' (' || printf('%.1f', cited_by_count * 1.0) || '%)' AS out FROM works")
def _(works):
    return works.select("work_id", F.concat(F.format_number(C("cited_by_count") * 1234, 0), F.lit(" ("), F.format_string("%.1f", C("cited_by_count").cast("double")), F.lit("%)")).alias("out"))


@op("FN_52_null_band_z", "papers", sql="WITH g AS (SELECT venue w, year, avg(price) v FROM papers GROUP BY 1, 2), m AS (SELECT w, avg(v) mu, stddev_samp(v) sd FROM g GROUP BY 1) SELECT w, year, round((v * 0.9 + 1.96 * sd * 0.1 - mu) / sd, 6) hi, round((v * 0.9 - 1.96 * sd * 0.1 - mu) / sd, 6) lo FROM g JOIN m USING (w) WHERE sd > 0")
def _(papers):
    g = papers.groupBy(C("venue").alias("w"), "year").agg(F.avg("price").alias("v"))
    m = g.groupBy("w").agg(F.avg("v").alias("mu"), F.stddev_samp("v").alias("sd")).where("sd > 0")
    z = lambda k: (C("v") * 0.9 + k * 1.96 * C("sd") * 0.1 - C("mu")) / C("sd")
    return g.join(m, "w").select("w", "year", r6(z(1), "hi"), r6(z(-1), "lo"))


@op("FN_53_signal_matrix", "papers", sql="WITH g AS (SELECT CASE WHEN length(kind) > 7 THEN 'C2ST' ELSE kind END AS method, year, avg(price) v FROM papers GROUP BY 1, 2), s AS (SELECT method, year, CASE WHEN method = 'C2ST' THEN (v / 100000 - 0.5) * 20 ELSE v / 10000 END s FROM g) SELECT method, round(max(s) FILTER (WHERE year = 1996), 6) y1996, round(max(s) FILTER (WHERE year = 1999), 6) y1999 FROM s GROUP BY 1")
def _(papers):
    g = papers.groupBy(F.when(F.length("kind") > 7, "C2ST").otherwise(C("kind")).alias("method"), "year").agg(F.avg("price").alias("v"))
    g = g.withColumn("s", F.when(C("method") == "C2ST", (C("v") / 100000 - 0.5) * 20).otherwise(C("v") / 10000))
    p = g.groupBy("method").pivot("year", [1996, 1999]).agg(F.round(F.max("s"), 6))
    return p.withColumnsRenamed({"1996": "y1996", "1999": "y1999"})


@op("JN_10_blocked_match", "works")
def _(works):
    refs = works.select(C("work_id").alias("ref_id"), F.concat("title", F.lit(" x")).alias("ref_title"), (C("year") + 1).alias("ref_year"))
    return O.blocked_match(refs, works.select("work_id", "title", "year"), 85.0)


@op("JN_11_match_entries", "works", sql="SELECT work_id FROM works WHERE cited_by_count >= 90 AND NOT EXISTS (SELECT 1 FROM works k WHERE k.work_id % 2 = 0 AND k.title = works.title)")
def _(works):
    return works.where("cited_by_count >= 90").join(works.where("work_id % 2 = 0").select("title"), "title", "left_anti").select("work_id")


@op("JN_12_overlap_pairs", "papers", sql="WITH e AS (SELECT DISTINCT venue c, kind || year || source_id % 7 r FROM papers), n AS (SELECT c, count(*) n FROM e GROUP BY 1), p AS (SELECT a.c a, b.c b, count(*) k FROM e a JOIN e b ON a.r = b.r AND a.c < b.c GROUP BY 1, 2) SELECT a, b, k AS n FROM p JOIN n x ON x.c = a JOIN n y ON y.c = b WHERE k >= 3 AND k > 0.8 * least(x.n, y.n)")
def _(papers):
    """Venues and what they list: kinds by year and branch."""
    e = papers.select(C("venue").alias("c"), F.concat("kind", C("year").cast("string"), (C("source_id") % 7).cast("string")).alias("r")).distinct()
    n = e.groupBy("c").agg(F.count(F.lit(1)).alias("m"))
    p = R.pairs_within(e, "r", "c").join(n.select(C("c").alias("a"), C("m").alias("ma")), "a").join(n.select(C("c").alias("b"), C("m").alias("mb")), "b")
    return p.where("n >= 3 and n > 0.8 * least(ma, mb)").select("a", "b", "n")


@op("JN_19_substring_join", "works", sql="SELECT w.work_id, min(k.k) k FROM works w JOIN (SELECT unnest(['tion', 'eaux', 'ing the', 'heit']) k) k ON contains(w.title, k.k) GROUP BY 1")
def _(works):
    keys = F.array(*[F.lit(k) for k in ("tion", "eaux", "ing the", "heit")])
    return works.select("work_id", F.explode(F.filter(keys, lambda k: F.contains("title", k))).alias("k")).groupBy("work_id").agg(F.min("k").alias("k"))


@op("SL_03_top_terms", "works", sql="WITH t AS (SELECT unnest(regexp_extract_all(lower(abstract), '[\\p{L}\\p{M}\\p{N}_]{2,}')) term FROM works) SELECT term, count(*) n FROM t GROUP BY 1 ORDER BY n DESC, term LIMIT 50")
def _(works):
    return A.tokens(works, "work_id", "abstract").groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term").limit(50)


@op("SL_05_quota_selection", "works", sql="WITH r AS (SELECT work_id, lang, cited_by_count, row_number() OVER (PARTITION BY lang ORDER BY cited_by_count DESC, work_id) r FROM works) SELECT work_id, lang, cited_by_count FROM r WHERE r <= 15 UNION ALL (SELECT work_id, lang, cited_by_count FROM r WHERE r > 15 ORDER BY cited_by_count DESC, work_id LIMIT 40)")
def _(works):
    """The best of each language up to its quota, then the best of the rest: each quota is a top-k of its own."""
    order = (F.desc("cited_by_count"), C("work_id"))
    sure = R.top_per_group(works.select("work_id", "lang", "cited_by_count"), ["lang"], 15, *order).drop("rank")
    rest = works.select("work_id", "lang", "cited_by_count").join(sure.select("work_id"), "work_id", "left_anti").orderBy(*order).limit(40)
    return sure.unionByName(rest)


@op("SL_07_equal_n", "works", sql="WITH s AS (SELECT lang, work_id, row_number() OVER (PARTITION BY lang ORDER BY md5('9:' || work_id), work_id) r FROM works), m AS (SELECT min(n) n FROM (SELECT count(*) n FROM works GROUP BY lang)) SELECT lang, work_id FROM s, m WHERE r <= n")
def _(works):
    least = works.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("n"))
    w = Window.partitionBy("lang").orderBy(F.md5(F.concat(F.lit("9:"), C("work_id").cast("string"))), "work_id")
    return works.select("lang", "work_id").withColumn("r", F.row_number().over(w)).crossJoin(F.broadcast(least)).where("r <= n").select("lang", "work_id")


@op("SL_09_fixture_sample", "works", sql="SELECT work_id, substr(abstract, 1, 200) abstract FROM (SELECT *, row_number() OVER (PARTITION BY cited_by_count >= 50 ORDER BY md5('4:' || work_id), work_id) r FROM works) WHERE r <= CASE WHEN cited_by_count >= 50 THEN 20 ELSE 80 END")
def _(works):
    """The first of each side in a seeded order: each is a top-k of its own, so no task gets a whole side, and texts are cut before."""
    core, order = C("cited_by_count") >= 50, (F.md5(F.concat(F.lit("4:"), C("work_id").cast("string"))), C("work_id"))
    d = works.select("work_id", "cited_by_count", F.substring("abstract", 1, 200).alias("abstract"))
    parts = [d.where(c).orderBy(*order).limit(n) for c, n in ((core, 20), (~core, 80), (core.isNull(), 80))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("work_id", "abstract")


@op("SL_10_balanced", "labels", sql="WITH s AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY md5('5:' || doc_id), doc_id) r FROM labels) SELECT doc_id, toxic FROM s WHERE r <= (SELECT min(n) FROM (SELECT count(*) n FROM labels GROUP BY toxic))")
def _(labels):
    least = labels.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("n"))
    w = Window.partitionBy("toxic").orderBy(F.md5(F.concat(F.lit("5:"), C("doc_id").cast("string"))), "doc_id")
    return labels.withColumn("r", F.row_number().over(w)).crossJoin(F.broadcast(least)).where("r <= n").select("doc_id", "toxic")


@op("PL_04_isolated", "works", "inner_edges", sql="SELECT work_id FROM works WHERE year <= 1999 AND work_id NOT IN (SELECT source_id FROM inner_edges UNION SELECT ref_id FROM inner_edges)")
def _(works, edges):
    return O.flag_isolated(works.select("work_id", "year"), edges, "work_id", 1999).where("isolated").select("work_id")


@op("PL_06_relevance_candidates", "works", "labels", sql="SELECT work_id, coalesce(quality = 0, false) irrelevant FROM works LEFT JOIN labels ON doc_id = work_id WHERE cited_by_count < 50 AND source_count < 2")
def _(works, labels):
    scores = labels.select(C("doc_id").alias("work_id"), "quality")
    return works.where("cited_by_count < 50 and source_count < 2").join(scores, "work_id", "left").select("work_id", F.coalesce(C("quality") == 0, F.lit(False)).alias("irrelevant"))


@op("PL_11_verify_blacklist", "works", sql="SELECT count(*) violations FROM works WHERE contains(lower(title), 'zzzz')")
def _(works):
    return works.where(T.any_contains(F.lower("title"), ["zzzz"])).agg(F.count(F.lit(1)).alias("violations"))


@op("PL_12_enrichment_status", "works", sql="SELECT CASE WHEN n = 0 THEN 'missing' WHEN n > 500 THEN 'too_long' ELSE 'ok' END AS status, count(*) n FROM (SELECT len([t for t in regexp_split_to_array(trim(abstract), '\\s+') if t <> '']) n FROM works) GROUP BY 1")
def _(works):
    return works.groupBy(T.length_class(T.count_tokens(C("abstract")), 500).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@op("PL_14_core_score", "works", sql="WITH q AS (SELECT quantile_cont(cited_by_count, 0.01) lo, quantile_cont(cited_by_count, 0.99) hi FROM works) SELECT work_id, round(0.6 * (least(greatest(cited_by_count, lo), hi) - lo) / (hi - lo) + 0.1 * source_count + CASE WHEN lang <> 'en' THEN 0.1 ELSE 0 END, 6) score FROM works, q ORDER BY score DESC, work_id LIMIT 100")
def _(works):
    q = works.agg(F.percentile("cited_by_count", F.lit(0.01)).alias("lo"), F.percentile("cited_by_count", F.lit(0.99)).alias("hi"))
    s = 0.6 * (F.least(F.greatest("cited_by_count", "lo"), "hi") - C("lo")) / (C("hi") - C("lo")) + 0.1 * C("source_count") + F.when(C("lang") != "en", 0.1).otherwise(0.0)
    return works.crossJoin(F.broadcast(q)).select("work_id", r6(s, "score")).orderBy(F.desc("score"), "work_id").limit(100)


@op("PL_15_zip_padded", "works", sql="SELECT work_id, t.c course, CASE WHEN t.i = 1 THEN source ELSE 'Unknown' END institution FROM works, (SELECT unnest([1, 2]) i, unnest(['x', 'y']) c) t WHERE source_count >= 2")
def _(works):
    z = F.arrays_zip(F.array(F.lit("x"), F.lit("y")).alias("c"), F.array("source").alias("i"))
    return works.where("source_count >= 2").select("work_id", F.explode(z).alias("z")).select("work_id", C("z.c").alias("course"), F.coalesce("z.i", F.lit("Unknown")).alias("institution"))


@op("PL_18_language_audit", "works", sql=f"WITH {_DETECTED} SELECT lang, CASE WHEN length(abstract) < 100 THEN 'short' WHEN detected = lang THEN 'agrees' ELSE 'differs' END status, count(*) n FROM d GROUP BY 1, 2")
def _(works):
    d = works.withColumn("detected", S.detect_language(C("abstract")))
    return d.groupBy("lang", F.when(F.length("abstract") < 100, "short").when(C("detected") == C("lang"), "agrees").otherwise("differs").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@op("PL_19_accuracy", "works", "labels", sql="WITH g AS (SELECT source, count(*) FILTER (WHERE quality = 1) s, count(*) n FROM works JOIN labels ON doc_id = work_id GROUP BY 1), p AS (SELECT *, s / n p, 1.959963984540054 z FROM g) SELECT source, s, n, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) lo FROM p")
def _(works, labels):
    g = works.join(labels, C("doc_id") == C("work_id")).groupBy("source").agg(F.count(F.when(C("quality") == 1, 1)).alias("s"), F.count(F.lit(1)).alias("n"))
    return g.select("source", "s", "n", r6(T.wilson(C("s"), C("n"))[0], "lo"))


@op("PL_23_best_query", "works", "labels", sql="WITH d AS (SELECT quality y, q.q, CASE q.q WHEN 'a' THEN length(abstract) WHEN 'b' THEN cited_by_count ELSE -length(abstract) END s FROM works JOIN labels ON doc_id = work_id, (SELECT unnest(['a', 'b', 'c']) q) q), r AS (SELECT q, y, rank() OVER (PARTITION BY q ORDER BY s) + (count(*) OVER (PARTITION BY q, s) - 1) / 2 r FROM d), u AS (SELECT q, (sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) u FROM r GROUP BY 1) SELECT q AS query, round(u, 6) auc FROM u ORDER BY u DESC, q LIMIT 1")
def _(works, labels):
    d = works.join(labels, C("doc_id") == C("work_id")).select("quality", F.length("abstract").alias("a"), C("cited_by_count").alias("b"), (-F.length("abstract")).alias("c"))
    one = [R.auc(d, q, "quality").select(F.lit(q).alias("query"), r6(C("auc"), "auc")) for q in "abc"]
    return one[0].unionByName(one[1]).unionByName(one[2]).orderBy(F.desc("auc"), "query").limit(1)


@op("PL_24_golden_compare", "works", sql="WITH a AS (SELECT source k, count(*) v FROM works GROUP BY 1), b AS (SELECT source k, count(*) + CASE WHEN source = 'src3' THEN 1 ELSE 0 END v FROM works WHERE source <> 'src5' GROUP BY 1) SELECT k, CASE WHEN b.v IS NULL THEN 'new' WHEN a.v IS NULL THEN 'gone' WHEN a.v = b.v THEN 'same' ELSE 'changed' END AS status FROM a FULL OUTER JOIN b USING (k)")
def _(works):
    a = works.groupBy(C("source").alias("k")).agg(F.count(F.lit(1)).alias("v"))
    b = works.where("source <> 'src5'").groupBy(C("source").alias("k")).agg((F.count(F.lit(1)) + F.when(F.first("source") == "src3", 1).otherwise(0)).alias("w"))
    return a.join(b, "k", "full_outer").select("k", F.when(C("w").isNull(), "new").when(C("v").isNull(), "gone").when(C("v") == C("w"), "same").otherwise("changed").alias("status"))


@op("UN_16_summary", "papers", sql="WITH p AS (SELECT year, venue, avg(price) pt, quantile_cont(price, 0.025) lo, median(price) md, quantile_cont(price, 0.975) hi FROM papers GROUP BY 1, 2), n AS (SELECT year, venue, count(*) / 100.0 pv FROM papers WHERE price > 50000 GROUP BY 1, 2) SELECT year, venue, round(pt, 6) point_estimate, round(lo, 6) boot_q025, round(md, 6) boot_median, round(hi, 6) boot_q975, coalesce(pv < 0.05, false) significant FROM p LEFT JOIN n USING (year, venue)")
def _(papers):
    p = papers.groupBy("year", "venue").agg(r6(F.avg("price"), "point_estimate"), *[r6(F.percentile("price", F.lit(q)), n) for q, n in ((0.025, "boot_q025"), (0.5, "boot_median"), (0.975, "boot_q975"))])
    n = papers.where("price > 50000").groupBy("year", "venue").agg((F.count(F.lit(1)) / 100.0).alias("p"))
    return p.join(n, ["year", "venue"], "left").withColumn("significant", F.coalesce(C("p") < 0.05, F.lit(False))).drop("p")


def _mmd_null(g, count, seed):
    seen, values = KN.mmd_permutations(*kernels._sides(g), count, seed)
    return max(seen, 0.0), np.maximum(values, 0)


_NULLS = {"UN_02_null_S1": (_mmd_null, 250), "UN_02_null_S3": (kernels.semantic_null(KN.sliced_wasserstein), 25), "UN_02_null_S4": (kernels.semantic_null(KN.frechet), 25), "UN_10_null_c2st": (kernels.semantic_null(lambda a, b: KN.c2st(a, b, 16)[0], lambda z: KN.pca(z, 16)), 25)}
for _m, (_f, _b) in _NULLS.items():
    op(_m, "embeddings")(lambda embeddings, _f=_f, _b=_b: kernels.null_model(kernels.window_members(embeddings, (2,)), _f, block=_b))


@op("UN_18_sensitivity_grid", "embeddings")
def _(embeddings):
    """Energy distance over gaps and widths, z over anchors."""
    out = None
    for gap in (1, 2):
        d = kernels.window_members(embeddings, (2, 3), gap).groupBy("anchor", "width").applyInPandas(lambda key, g: pd.DataFrame({"anchor": [key[0]], "width": [key[1]], "value": [KN.energy(*kernels._sides(g))]}), "anchor int, width int, value double").withColumn("gap", F.lit(gap))
        out = d if out is None else out.unionByName(d)
    return R.zscore(out, ["width", "gap"], "value")


@op("BK_02_wide_z", "papers", sql="WITH g AS (SELECT year, kind, avg(price) v FROM papers GROUP BY 1, 2), z AS (SELECT year, kind, (v - avg(v) OVER w) / nullif(stddev_samp(v) OVER w, 0) z FROM g WINDOW w AS (PARTITION BY kind)) SELECT year, round(max(z) FILTER (WHERE kind = 'ECONOMY'), 6) economy, round(max(z) FILTER (WHERE kind = 'PROMO'), 6) promo FROM z GROUP BY 1")
def _(papers):
    z = R.zscore(papers.groupBy("year", "kind").agg(F.avg("price").alias("v")), ["kind"], "v")
    return z.groupBy("year").agg(*[r6(F.max(F.when(C("kind") == k, C("z"))), k.lower()) for k in ("ECONOMY", "PROMO")])


@op("BK_11_heatmap", "papers", sql="WITH g AS (SELECT kind, year, count(*) v FROM papers GROUP BY 1, 2), z AS (SELECT kind, year, coalesce((v - avg(v) OVER w) / nullif(stddev_samp(v) OVER w, 0), 0) z FROM g WINDOW w AS (PARTITION BY kind)) SELECT kind, round(max(z) FILTER (WHERE year = 1995), 6) a, round(max(z) FILTER (WHERE year = 1998), 6) b FROM z GROUP BY 1")
def _(papers):
    z = R.zscore(papers.groupBy("kind", "year").agg(F.count(F.lit(1)).alias("v")), ["kind"], "v", flat=0.0)
    return z.groupBy("kind").agg(r6(F.max(F.when(C("year") == 1995, C("z"))), "a"), r6(F.max(F.when(C("year") == 1998, C("z"))), "b"))


@op("EM_01_align_vectors", "works", "embeddings", sql="SELECT work_id, vec_id IS NULL AS is_zero FROM works LEFT JOIN embeddings ON vec_id = work_id")
def _(works, embeddings):
    d = works.select("work_id").join(embeddings.select(C("vec_id").alias("work_id"), "embedding"), "work_id", "left")
    v = F.coalesce("embedding", F.array_repeat(F.lit(0.0).cast("float"), 64))
    return d.select("work_id", (~F.exists(v, lambda x: x != 0)).alias("is_zero"))


@op("EM_02_incremental_cache", "works", sql="SELECT work_id, substr(md5(title), 1, 8) h FROM works WHERE work_id % 3 <> 0")
def _(works):
    d = works.select("work_id", T.text_hash(C("title")).alias("h"))
    return d.join(d.where("work_id % 3 = 0"), ["work_id", "h"], "left_anti")


@op("EM_04_kmeans", "embeddings")
def _(embeddings):
    v = embeddings.select("vec_id", "label", array_to_vector("embedding").alias("features")).persist()
    out = KMeans(k=6, seed=1, maxIter=20).fit(v).transform(v)
    return out.select("vec_id", "label", C("prediction").alias("cluster"))


@op("EM_07_stability", "embeddings")
def _(embeddings):
    v = embeddings.select("vec_id", array_to_vector("embedding").alias("features")).persist()
    a = KMeans(k=6, seed=1).fit(v).transform(v).select("vec_id", C("prediction").alias("a"))
    some = v.where(F.pmod(F.xxhash64("vec_id"), F.lit(10)) != 0)
    b = KMeans(k=6, seed=1).fit(some).transform(some).select("vec_id", C("prediction").alias("b"))
    return R.rand_index(a.join(b, "vec_id"), "a", "b")


@op("EM_09_isolation", "embeddings", sql="WITH e AS (SELECT vec_id, label, [CAST(x AS DOUBLE) for x in embedding] v FROM embeddings), d AS (SELECT a.vec_id, 1 - list_cosine_similarity(a.v, b.v) d, row_number() OVER (PARTITION BY a.vec_id ORDER BY 1 - list_cosine_similarity(a.v, b.v)) r FROM e a JOIN e b ON b.label = 0 AND a.label = 1) SELECT vec_id, round(avg(d), 6) score FROM d WHERE r <= 5 GROUP BY 1")
def _(embeddings):
    """The reference group is all vectors of one label."""
    score = A.isolation(embeddings.where("label = 1"), embeddings.where("label = 0"), "vec_id", "embedding", 5)
    return score.select("vec_id", F.round("score", 6).alias("score"))


@op("EM_13_mixture_bic", "embeddings")
def _(embeddings):
    """BIC of one normal distribution less that of a mixture of two, for the first component."""
    v = embeddings.select(C("embedding")[0].cast("double").alias("x")).select("x", array_to_vector(F.array("x")).alias("features")).persist()
    n, var = v.agg(F.count("x"), F.var_pop("x")).first()
    one = n * (np.log(2 * np.pi * var) + 1) + 2 * np.log(n)
    two = 5 * np.log(n) - 2 * GaussianMixture(k=2, seed=1).fit(v).summary.logLikelihood
    return embeddings.sparkSession.createDataFrame([(float(one - two),)], "delta_bic double")


@op("EM_15_pca_layout", "embeddings")
def _(embeddings):
    v = embeddings.select("vec_id", array_to_vector("embedding").alias("features")).persist()
    return PCA(k=2, inputCol="features", outputCol="p").fit(v).transform(v).select("vec_id", vector_to_array("p").alias("p")).select("vec_id", C("p")[0].alias("x"), C("p")[1].alias("y"))


@op("UN_19_projection", "embeddings")
def _(embeddings):
    """Johnson-Lindenstrauss: one fixed Gaussian matrix for all rows."""
    m = np.random.default_rng(1).standard_normal((64, 16)) / 4.0

    @F.pandas_udf("array<double>")
    def project(v: pd.Series) -> pd.Series:
        return pd.Series(list(np.array(v.tolist(), float).reshape(len(v), -1) @ m))

    return embeddings.select("vec_id", project("embedding").alias("v"))


def _cocited(edges, top=60):
    t = edges.groupBy("ref_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "ref_id").limit(top).select("ref_id")
    return R.pairs_within(edges.join(F.broadcast(t), "ref_id", "left_semi"), "source_id", "ref_id")


def _communities(pairs, resolutions):
    """Louvain on a network of at most a few hundred nodes (top-N by construction), one task a resolution."""
    def one(key, g):
        graph = KN.Graph(list(zip(g.a, g.b, strict=True)))
        label = graph.louvain(key[0])
        return pd.DataFrame({"resolution": key[0], "node": graph.names, "community": label})

    return pairs.withColumn("resolution", F.explode(F.array(*[F.lit(r) for r in resolutions]))).groupBy("resolution").applyInPandas(one, "resolution double, node long, community long")


op("GR_02_cocitation_counts", "edges", sql="WITH t AS (SELECT ref_id FROM (SELECT ref_id, count(*) n FROM edges GROUP BY 1) ORDER BY n DESC, ref_id LIMIT 60), e AS (SELECT DISTINCT source_id, ref_id FROM edges WHERE ref_id IN (SELECT ref_id FROM t)) SELECT a.ref_id a, b.ref_id b, count(*) n FROM e a JOIN e b ON a.source_id = b.source_id AND a.ref_id < b.ref_id GROUP BY 1, 2")(_cocited)
op("GR_03_communities", "edges")(lambda edges: _communities(_cocited(edges), (1.0,)))
op("GR_05_resolution_sweep", "edges")(lambda edges: _communities(_cocited(edges), (0.5, 1.0, 1.5, 2.0)))


@op("GR_04_coupling", "edges", sql="WITH e AS (SELECT DISTINCT source_id, ref_id FROM edges) SELECT a.source_id a, b.source_id b, count(*) n FROM e a JOIN e b ON a.ref_id = b.ref_id AND a.source_id < b.source_id GROUP BY 1, 2 HAVING count(*) >= 2")
def _(edges):
    return R.pairs_within(edges, "ref_id", "source_id").where("n >= 2")


@op("GR_06_temporal_communities", "edges")
def _(edges):
    out = None
    for cut in (1997, 2001):
        d = _communities(_cocited(edges.where(C("source_year") <= cut)), (1.0,)).withColumn("cutoff", F.lit(cut))
        out = d if out is None else out.unionByName(d)
    return out


@op("GR_07_community_overlap", "edges", sql="WITH e AS (SELECT DISTINCT source_year a, ref_id FROM edges), n AS (SELECT a, count(*) n FROM e GROUP BY 1), p AS (SELECT x.a a, y.a b, count(*) k FROM e x JOIN e y ON x.ref_id = y.ref_id AND x.a < y.a GROUP BY 1, 2) SELECT p.a, p.b, round(k / (x.n + y.n - k), 6) jaccard FROM p JOIN n x ON x.a = p.a JOIN n y ON y.a = p.b")
def _(edges):
    e = edges.select(C("source_year").alias("y"), "ref_id").distinct()
    n = e.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    p = R.pairs_within(e, "ref_id", "y").withColumnRenamed("n", "k").join(F.broadcast(n.select(C("y").alias("a"), C("n").alias("na"))), "a").join(F.broadcast(n.select(C("y").alias("b"), C("n").alias("nb"))), "b")
    return p.select("a", "b", r6(C("k") / (C("na") + C("nb") - C("k")), "jaccard"))


@op("GR_09_backbone", "inner_edges", sql="WITH d AS (SELECT ref_id, count(DISTINCT source_id) n FROM inner_edges GROUP BY 1), b AS (SELECT ref_id FROM d WHERE n >= 8) SELECT DISTINCT ref_id AS \"from\", source_id AS \"to\", CASE WHEN source_year < 1998 THEN 'early' ELSE 'late' END band FROM inner_edges WHERE ref_id IN (SELECT ref_id FROM b) AND source_id IN (SELECT ref_id FROM b)")
def _(edges):
    b = edges.groupBy("ref_id").agg(F.countDistinct("source_id").alias("n")).where("n >= 8").select("ref_id")
    e = edges.join(b, "ref_id", "left_semi").join(b.withColumnRenamed("ref_id", "source_id"), "source_id", "left_semi")
    return e.select(C("ref_id").alias("from"), C("source_id").alias("to"), F.when(C("source_year") < 1998, "early").otherwise("late").alias("band")).distinct()


@op("GR_10_cross_lineage", "inner_edges", sql="WITH d AS (SELECT ref_id, count(*) n FROM inner_edges GROUP BY 1) SELECT source_id, i.ref_id, a.n + b.n joint FROM inner_edges i JOIN d a ON a.ref_id = i.source_id JOIN d b ON b.ref_id = i.ref_id WHERE source_id % 3 <> i.ref_id % 3 ORDER BY joint DESC, source_id, i.ref_id LIMIT 15")
def _(edges):
    d = edges.groupBy("ref_id").agg(F.count(F.lit(1)).alias("n"))
    e = edges.where("source_id % 3 <> ref_id % 3").join(d.select("ref_id", C("n").alias("nb")), "ref_id").join(d.select(C("ref_id").alias("source_id"), C("n").alias("na")), "source_id")
    return e.select("source_id", "ref_id", (C("na") + C("nb")).alias("joint")).orderBy(F.desc("joint"), "source_id", "ref_id").limit(15)


@op("GR_12_flow_matrix", "inner_edges", sql="SELECT source_id % 3 AS tradition, count(*) FILTER (WHERE ref_id % 3 = 0) t0, count(*) FILTER (WHERE ref_id % 3 = 1) t1, count(*) FILTER (WHERE ref_id % 3 = 2) t2 FROM inner_edges GROUP BY 1")
def _(edges):
    return edges.groupBy((C("source_id") % 3).alias("tradition")).agg(*[F.count(F.when(C("ref_id") % 3 == k, 1)).alias(f"t{k}") for k in range(3)])


@op("LX_11_subcorpus", "works", sql="SELECT work_id, title FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY cited_by_count DESC, work_id) r FROM works WHERE regexp_matches(abstract, '(?i)tion the|eaux le')) WHERE r = 1")
def _(works):
    d = works.where(C("abstract").rlike("(?i)tion the|eaux le"))
    return R.keep_best(d, ["title"], F.desc("cited_by_count"), C("work_id")).select("work_id", "title")


@op("EXT_stream_dedup", "events")
def _(events):
    """What the streaming ingest gives on a table that is all there: one row a key."""
    return events.dropDuplicates(["user_id", "event_type"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
