"""Queries of lexical, semantic and citation analysis, beside their SQL. Embedding labels stand in for years."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.operators import analysis as A
from quillspark.operators import relational as R

from . import proxy
from .relational import C, r6

Q: dict = {}
SQL: dict[str, str] = {}
_TOK = "SELECT work_id, year, lang, unnest(regexp_extract_all(lower(abstract), '[\\p{L}\\p{M}\\p{N}_]{2,}')) term FROM works"
_TFIDF = f"tok AS ({_TOK}), tf AS (SELECT work_id, term, count(*) tf FROM tok GROUP BY 1, 2), voc AS (SELECT term, count(*) df FROM tf GROUP BY 1 HAVING count(*) >= 3 ORDER BY sum(tf) DESC, term LIMIT 5000), w AS (SELECT work_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM works)) / (1 + df)) + 1) w FROM tf JOIN voc USING (term)), vec AS (SELECT work_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY work_id)) weight FROM w)"
_E = "e AS (SELECT vec_id, label, [CAST(x AS DOUBLE) for x in embedding] v FROM embeddings)"
_WIN = "b AS (SELECT min(year) lo, max(year) hi FROM {t}), a AS (SELECT w.w AS width, CAST(y.y AS INT) anchor FROM b, (SELECT unnest([1, 2]) w) w, (SELECT unnest(range(1980, 2010)) y) y WHERE y.y >= lo + w.w AND y.y < hi - w.w)"


def op(name: str, *needs: str, sql: str | None = None):
    def put(f):
        Q[name] = lambda spark, sf_dir: f(*[proxy.view(spark, sf_dir, n) if n in proxy._TEXT else proxy.read(spark, sf_dir, n) for n in needs])
        if sql:
            views = [proxy.sql(n) for n in needs if n in proxy._TEXT]
            head = "WITH " + ", ".join(views) if views else ""
            SQL[name] = f"{head}, {sql.strip()[5:]}" if views and sql.strip().upper().startswith("WITH ") else f"{head} {sql}"
        return f

    return put


@op("LX_01_tfidf", "works", sql=f"WITH {_TFIDF} SELECT work_id, term, round(weight, 6) weight FROM vec")
def _(works):
    return A.tfidf(works, "work_id", "abstract").withColumn("weight", F.round("weight", 6))


@op("LX_02_top_terms_by_year", "works", sql=f"WITH tok AS ({_TOK}), n AS (SELECT year, term, count(*) n FROM tok GROUP BY 1, 2) SELECT year, term, n FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY n DESC, term) r FROM n) WHERE r <= 25")
def _(works):
    n = A.tokens(works, "work_id", "abstract", ["year"]).groupBy("year", "term").agg(F.count(F.lit(1)).alias("n"))
    return R.top_per_group(n, ["year"], 25, F.desc("n"), C("term")).drop("rank")


@op("LX_03_bigrams", "works", sql="WITH t AS (SELECT work_id, regexp_extract_all(lower(abstract), '[\\p{L}\\p{M}\\p{N}_]{2,}') t FROM works), g AS (SELECT work_id, unnest([t[i] || ' ' || t[i + 1] for i in range(1, len(t))]) term FROM t) SELECT term, count(DISTINCT work_id) df FROM g GROUP BY 1 HAVING count(DISTINCT work_id) >= 25")
def _(works):
    t = works.select("work_id", F.regexp_extract_all(F.lower("abstract"), F.lit(f"({A.TOKEN})"), F.lit(1)).alias("t"))
    pairs = F.filter(F.transform("t", lambda x, i: F.concat_ws(" ", x, F.try_element_at("t", i + 2))), lambda p: F.contains(p, F.lit(" ")))
    return t.select("work_id", F.explode(F.array_distinct(pairs)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).where("df >= 25")


_SHIFT = f"WITH {_TFIDF} SELECT term, round(coalesce(sum(weight) FILTER (WHERE year >= 1998), 0) / (SELECT count(*) FROM works WHERE year >= 1998) - coalesce(sum(weight) FILTER (WHERE year < 1998), 0) / (SELECT count(*) FROM works WHERE year < 1998), 6) + 0 diff, count(*) FILTER (WHERE year < 1998) n_before, count(*) FILTER (WHERE year >= 1998) n_after FROM vec JOIN works USING (work_id) GROUP BY 1"


@op("LX_04_term_shift", "works", sql=_SHIFT)
def _(works):
    late = C("year") >= 1998
    n = works.agg(F.count(F.when(late, 1)).alias("na"), F.count(F.when(~late, 1)).alias("nb"))
    d = A.tfidf(works, "work_id", "abstract").join(works.select("work_id", "year"), "work_id").crossJoin(F.broadcast(n))
    z = lambda x: F.coalesce(x, F.lit(0.0))
    return d.groupBy("term").agg(r6(z(F.sum(F.when(late, C("weight")))) / F.max("na") - z(F.sum(F.when(~late, C("weight")))) / F.max("nb"), "diff"), F.count(F.when(~late, 1)).alias("n_before"), F.count(F.when(late, 1)).alias("n_after"))


@op("LX_05_log_odds", "works", sql=f"WITH tok AS ({_TOK}), c AS (SELECT term, count(*) FILTER (WHERE year < 1998) freq_before, count(*) FILTER (WHERE year >= 1998) freq_after FROM tok GROUP BY 1), s AS (SELECT *, sum(freq_before) OVER () nb, sum(freq_after) OVER () na, count(*) OVER () a0 FROM c), l AS (SELECT *, a0 * (freq_before + freq_after) / (nb + na) al FROM s) SELECT term, freq_before, freq_after, round(ln((freq_after + al) / (na + a0 - freq_after - al)) - ln((freq_before + al) / (nb + a0 - freq_before - al)), 6) log_odds FROM l WHERE freq_before + freq_after >= 20")
def _(works):
    early = C("year") < 1998
    n = A.tokens(works, "work_id", "abstract", ["year"]).groupBy("term").agg(F.count(F.when(early, 1)).alias("freq_before"), F.count(F.when(~early, 1)).alias("freq_after"))
    return A.log_odds(n, "freq_before", "freq_after").where("freq_before + freq_after >= 20").withColumn("log_odds", F.round("log_odds", 6))


@op("LX_10_topic_by_year", "works", sql="WITH t AS (SELECT year, CASE WHEN contains(abstract, '***') THEN 'starred' WHEN contains(abstract, '|') THEN 'barred' ELSE 'plain' END topic FROM works), n AS (SELECT year, topic, count(*) n FROM t GROUP BY 1, 2) SELECT year, arg_max(topic, n * 1000 + length(topic)) topic, max(n) n FROM n GROUP BY 1")
def _(works):
    topic = F.when(F.contains("abstract", F.lit("***")), "starred").when(F.contains("abstract", F.lit("|")), "barred").otherwise("plain")
    n = works.groupBy("year", topic.alias("topic")).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("year").agg(F.max_by("topic", C("n") * 1000 + F.length("topic")).alias("topic"), F.max("n").alias("n"))


@op("LX_12_distinctive_refs", "edges", sql="WITH a AS (SELECT ref_id, count(*) na FROM edges WHERE source_year < 1998 GROUP BY 1), b AS (SELECT ref_id, count(*) nb FROM edges WHERE source_year >= 1998 GROUP BY 1), s AS (SELECT (SELECT sum(na) FROM a) ta, (SELECT sum(nb) FROM b) tb) SELECT ref_id, na, round((na / ta) / (coalesce(nb, 0) / tb + 0.001), 6) ratio FROM a LEFT JOIN b USING (ref_id), s WHERE na >= 3 ORDER BY round((na / ta) / (coalesce(nb, 0) / tb + 0.001), 9) DESC, ref_id LIMIT 10")
def _(edges):
    early = C("source_year") < 1998
    n = edges.groupBy("ref_id").agg(F.count(F.when(early, 1)).alias("na"), F.count(F.when(~early, 1)).alias("nb"))
    t = n.agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"))
    ratio = (C("na") / C("ta")) / (C("nb") / C("tb") + 0.001)
    return n.crossJoin(F.broadcast(t)).where("na >= 3").orderBy(F.desc(F.round(ratio, 9)), "ref_id").limit(10).select("ref_id", "na", r6(ratio, "ratio"))


@op("DV_L1_js", "works", sql=f"""WITH {_TFIDF}, {_WIN.format(t='works')}, m AS (SELECT anchor, width, CASE WHEN year < anchor THEN 'before' ELSE 'after' END side, work_id FROM works JOIN a ON year BETWEEN anchor - width AND anchor - 1 OR year BETWEEN anchor + 1 AND anchor + width),
n AS (SELECT anchor, width, count(*) FILTER (WHERE side = 'before') nb, count(*) FILTER (WHERE side = 'after') na FROM m GROUP BY 1, 2), voc2 AS (SELECT DISTINCT term FROM vec), g AS (SELECT anchor, width, term, sum(weight) FILTER (WHERE side = 'before') b, sum(weight) FILTER (WHERE side = 'after') f FROM m JOIN vec USING (work_id) GROUP BY 1, 2, 3),
x AS (SELECT n.anchor, n.width, coalesce(b, 0) / nb + 1e-10 b, coalesce(f, 0) / na + 1e-10 f FROM n CROSS JOIN voc2 LEFT JOIN g ON g.anchor = n.anchor AND g.width = n.width AND g.term = voc2.term), y AS (SELECT anchor, width, b / sum(b) OVER w p, f / sum(f) OVER w q FROM x WINDOW w AS (PARTITION BY anchor, width))
SELECT anchor, CAST(width AS INT) width, round(sqrt(sum(p * ln(2 * p / (p + q)) + q * ln(2 * q / (p + q))) / 2), 6) value FROM y GROUP BY 1, 2""")
def _(works):
    members = R.windows_before_after(works.select("work_id", "year"), "year", (1, 2), 1)
    return A.lexical_js(A.tfidf(works, "work_id", "abstract"), members, "work_id", ["anchor", "width"]).withColumn("value", F.round("value", 6))


@op("DV_L3_bursts", "works", sql=f"WITH tok AS ({_TOK}), voc AS (SELECT term FROM tok GROUP BY 1 HAVING count(DISTINCT work_id) >= 3 ORDER BY count(*) DESC, term LIMIT 100), d AS (SELECT year, count(*) d FROM works GROUP BY 1), n AS (SELECT year, term, count(*) n FROM tok JOIN voc USING (term) GROUP BY 1, 2), f AS (SELECT d.year, voc.term, coalesce(n, 0) / d f FROM d CROSS JOIN voc LEFT JOIN n ON n.year = d.year AND n.term = voc.term), z AS (SELECT year, stddev_pop(f) OVER w > 0 AND (f - avg(f) OVER w) / nullif(stddev_pop(f) OVER w, 0) > 2 hit FROM f WINDOW w AS (PARTITION BY term)) SELECT year, count(*) FILTER (WHERE hit) value FROM z GROUP BY 1")
def _(works):
    return A.bursts(works, "work_id", "abstract", "year")


@op("DV_G3_age_shift", "edges", sql="SELECT source_year AS year, CASE WHEN count(ref_year) >= 3 THEN median(ref_year) END AS value FROM edges GROUP BY 1")
def _(edges):
    return A.age_shift(edges)


_GWIN = "g AS (SELECT anchor, width, CASE WHEN source_year < anchor THEN 'before' ELSE 'after' END side, source_id, ref_id FROM inner_edges JOIN a ON (source_year BETWEEN anchor - width AND anchor - 1 AND ref_year BETWEEN anchor - width AND anchor - 1) OR (source_year BETWEEN anchor + 1 AND anchor + width AND ref_year BETWEEN anchor + 1 AND anchor + width))"


def window_edges(edges):
    """Edges with both ends on one side of an anchor."""
    m = R.windows_before_after(edges.withColumnRenamed("source_year", "year"), "year", (1, 2), 1)
    ok = F.when(C("side") == "before", C("ref_year").between(C("anchor") - C("width"), C("anchor") - 1)).otherwise(C("ref_year").between(C("anchor") + 1, C("anchor") + C("width")))
    return m.where(ok).select("anchor", "width", "side", "source_id", "ref_id")


@op("DV_G6_entropy", "inner_edges", sql=f"WITH {_WIN.format(t='(SELECT source_year AS year FROM inner_edges)')}, {_GWIN}, k AS (SELECT anchor, width, side, ref_id, count(DISTINCT source_id) k FROM g GROUP BY 1, 2, 3, 4), n AS (SELECT anchor, width, side, k, count(*) n FROM k GROUP BY 1, 2, 3, 4), h AS (SELECT anchor, width, side, CASE WHEN sum(n) >= 3 THEN ln(sum(n)) - sum(n * ln(n)) / sum(n) END h FROM n GROUP BY 1, 2, 3) SELECT anchor, CAST(width AS INT) width, round(abs(max(h) FILTER (WHERE side = 'after') - max(h) FILTER (WHERE side = 'before')), 6) value FROM h GROUP BY 1, 2")
def _(edges):
    h = A.degree_entropy(window_edges(edges), ["anchor", "width", "side"])
    return h.groupBy("anchor", "width").agg(r6(F.abs(F.max(F.when(C("side") == "after", C("entropy"))) - F.max(F.when(C("side") == "before", C("entropy")))), "value"))


@op("DV_G7_disruption", "inner_edges", "orders", sql="""WITH e AS (SELECT DISTINCT source_id, ref_id FROM inner_edges), ij AS (SELECT c.ref_id id, count(*) c, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM e r1 JOIN e r2 ON r1.ref_id = r2.ref_id WHERE r1.source_id = c.source_id AND r2.source_id = c.ref_id)) j FROM e c GROUP BY 1),
k AS (SELECT id, count(*) k FROM (SELECT DISTINCT o.source_id id, x.source_id citer FROM e o JOIN e x ON x.ref_id = o.ref_id) q WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.ref_id = q.id AND e.source_id = q.citer) GROUP BY 1)
SELECT CAST(year(o_orderdate) AS INT) "year", round(avg((coalesce(c, 0) - 2 * coalesce(j, 0)) / (coalesce(c, 0) + coalesce(k, 0))), 6) value FROM orders LEFT JOIN ij ON ij.id = o_orderkey LEFT JOIN k ON k.id = o_orderkey WHERE coalesce(c, 0) + coalesce(k, 0) > 0 GROUP BY 1""")
def _(edges, orders):
    works = orders.select(C("o_orderkey").alias("id"), F.year("o_orderdate").alias("year"))
    return A.disruption(edges, edges, works).withColumn("value", F.round("value", 6))


_EWIN = "wn AS (SELECT w.w AS width, CAST(y.y AS INT) anchor FROM (SELECT unnest([2, 3]) w) w, (SELECT unnest(range(0, 10)) y) y WHERE y.y >= w.w AND y.y < 9 - w.w), m AS (SELECT anchor, width, CASE WHEN label < anchor THEN 'b' ELSE 'a' END side, vec_id, v FROM e JOIN wn ON label BETWEEN anchor - width AND anchor - 1 OR label BETWEEN anchor + 1 AND anchor + width)"


@op("DV_S2_energy", "embeddings", sql=f"WITH {_E}, {_EWIN}, p AS (SELECT x.anchor, x.width, x.side s, y.side t, avg(list_distance(x.v, y.v)) d FROM m x JOIN m y ON x.anchor = y.anchor AND x.width = y.width GROUP BY 1, 2, 3, 4) SELECT anchor, CAST(width AS INT) width, round(sum(CASE WHEN s <> t THEN d ELSE -d END), 6) value FROM p GROUP BY 1, 2")
def _(embeddings):
    from . import kernels

    return kernels.semantic(embeddings, "S2", (2, 3)).select("anchor", "width", r6(C("value"), "value"))


@op("BK_01_share_js", "papers", sql=f"""WITH {_WIN.format(t='papers')}, m AS (SELECT anchor, width, kind, count(*) FILTER (WHERE year < anchor) p, count(*) FILTER (WHERE year > anchor) q FROM papers JOIN a ON year BETWEEN anchor - width AND anchor - 1 OR year BETWEEN anchor + 1 AND anchor + width GROUP BY 1, 2, 3), s AS (SELECT anchor, width, p / sum(p) OVER w p, q / sum(q) OVER w q FROM m WINDOW w AS (PARTITION BY anchor, width))
SELECT anchor, CAST(width AS INT) width, round(sum(coalesce(p * log2(nullif(2 * p / (p + q), 0)), 0) + coalesce(q * log2(nullif(2 * q / (p + q), 0)), 0)) / 2, 6) js FROM s GROUP BY 1, 2""")
def _(papers):
    m = R.windows_before_after(papers.select("year", "kind"), "year", (1, 2), 1).groupBy("anchor", "width", "kind").agg(F.count(F.when(C("side") == "before", 1)).alias("p"), F.count(F.when(C("side") == "after", 1)).alias("q"))
    return R.js_divergence(m, ["anchor", "width"], "kind", "p", "q", base=2).withColumn("js", F.round("js", 6))


@op("UN_11_analytical_null", "papers", sql="WITH n AS (SELECT year, count(*) n FROM papers GROUP BY 1), w AS (SELECT year, sum(n) OVER (ORDER BY year RANGE BETWEEN 2 PRECEDING AND 1 PRECEDING) b, sum(n) OVER (ORDER BY year RANGE BETWEEN 1 FOLLOWING AND 2 FOLLOWING) a FROM n) SELECT year, 0.5::DOUBLE null_mean, round(sqrt((b + a + 1) / (12 * b * a)), 9) null_std FROM w WHERE a > 0 AND b > 0")
def _(papers):
    w = Window.orderBy("year")
    n = papers.groupBy("year").agg(F.count(F.lit(1)).alias("n")).select("year", F.sum("n").over(w.rangeBetween(-2, -1)).alias("b"), F.sum("n").over(w.rangeBetween(1, 2)).alias("a")).where("a > 0 and b > 0")
    return n.select("year", F.lit(0.5).alias("null_mean"), F.round(A.analytical_null(C("b"), C("a")), 9).alias("null_std"))


@op("UN_17_spearman", "papers", sql="WITH v AS (SELECT venue, count(*) x, avg(price) y FROM papers GROUP BY 1), r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 ry FROM v) SELECT round(corr(rx, ry), 6) rho, count(*) n FROM r")
def _(papers):
    v = papers.groupBy("venue").agg(F.count(F.lit(1)).alias("x"), F.avg("price").alias("y"))
    rank = lambda c: F.rank().over(Window.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(c)) - 1) / 2
    return v.select(rank("x").alias("rx"), rank("y").alias("ry")).agg(r6(F.corr("rx", "ry"), "rho"), F.count(F.lit(1)).alias("n"))


_BREAKS = "bk AS (SELECT DISTINCT 'M' || work_id % 3 AS method, CASE work_id % 3 WHEN 0 THEN 'semantic' WHEN 1 THEN 'lexical' ELSE 'citation' END channel, source || lang AS detector, CAST(1990 + (work_id * 7) % 20 AS VARCHAR) || ';' || CAST(1990 + (work_id * 3) % 20 AS VARCHAR) break_years FROM works)"


@op("BK_10_convergence", "works", sql=f"WITH {_BREAKS}, r AS (SELECT *, row_number() OVER () i FROM bk), y AS (SELECT i, method, channel, CAST(unnest(string_split(break_years, ';')) AS INT) y FROM r), c AS (SELECT DISTINCT y AS year FROM y), h AS (SELECT DISTINCT c.year, i, method, channel FROM c JOIN y ON abs(y.y - c.year) <= 1) SELECT year, count(*) FILTER (WHERE channel = 'semantic') n_semantic, count(*) FILTER (WHERE channel = 'lexical') n_lexical, count(*) FILTER (WHERE channel = 'citation') n_citation, string_agg(DISTINCT method, ';' ORDER BY method) methods_detecting, count(*) n_total, round(count(*) / (SELECT count(*) FROM bk), 4) pct_total FROM h GROUP BY 1")
def _(works):
    y = lambda k: (1990 + (C("work_id") * k) % 20).cast("string")
    m = C("work_id") % 3
    b = works.select(F.concat(F.lit("M"), m.cast("string")).alias("method"), F.when(m == 0, "semantic").when(m == 1, "lexical").otherwise("citation").alias("channel"), F.concat("source", "lang").alias("detector"), F.concat(y(7), F.lit(";"), y(3)).alias("break_years")).distinct()
    return A.convergence(b)


@op("EM_03_semantic_outlier", "embeddings", sql=f"WITH {_E}, c AS (SELECT list(m ORDER BY i) c FROM (SELECT i, avg(x) m FROM (SELECT unnest(v) x, unnest(range(len(v))) i FROM e) GROUP BY 1)), d AS (SELECT vec_id, 1 - list_cosine_similarity(v, c) d FROM e, c) SELECT vec_id, round(d, 6) distance, d > (SELECT avg(d) + 2 * stddev_pop(d) FROM d) outlier FROM d")
def _(embeddings):
    return A.semantic_outliers(embeddings, "vec_id", "embedding").withColumn("distance", F.round("distance", 6))


@op("EM_11_cohesion", "embeddings", sql=f"WITH {_E}, c AS (SELECT label, list(m ORDER BY i) c FROM (SELECT label, i, avg(x) m FROM (SELECT label, unnest(v) x, unnest(range(len(v))) i FROM e) GROUP BY 1, 2) GROUP BY 1) SELECT label, round(avg(list_distance(v, c)), 6) intra, count(*) n FROM e JOIN c USING (label) GROUP BY 1")
def _(embeddings):
    d = embeddings.join(F.broadcast(A.centroid(embeddings, ["label"], "embedding")), "label")
    diff = F.zip_with("embedding", "centroid", lambda x, y: x.cast("double") - y)
    return d.withColumn("diff", diff).groupBy("label").agg(r6(F.avg(A.norm("diff")), "intra"), F.count(F.lit(1)).alias("n"))


@op("EM_12_seed_axis", "embeddings", sql=f"WITH {_E}, c AS (SELECT list(m ORDER BY i) c FROM (SELECT i, avg(x) FILTER (WHERE label = 0) - avg(x) FILTER (WHERE label = 1) m FROM (SELECT label, unnest(v) x, unnest(range(len(v))) i FROM e) GROUP BY 1)), s AS (SELECT vec_id, list_inner_product(v, c) / sqrt(list_inner_product(c, c)) s FROM e, c) SELECT vec_id, round(s - (SELECT median(s) FROM s), 6) score FROM s")
def _(embeddings):
    m = lambda k: F.avg(F.when(C("label") == k, C("x").cast("double")))
    long = embeddings.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("i").agg((m(0) - m(1)).alias("m"))
    axis = long.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("axis"))
    s = embeddings.crossJoin(F.broadcast(axis)).select("vec_id", (A.dot("embedding", "axis") / A.norm("axis")).alias("s"))
    return s.crossJoin(F.broadcast(s.agg(F.median("s").alias("mid")))).select("vec_id", r6(C("s") - C("mid"), "score"))


@op("EM_10_landmark_neighbours", "embeddings", sql=f"WITH {_E}, l AS (SELECT vec_id lid, v lv FROM e WHERE vec_id < 5), r AS (SELECT lid, vec_id, list_cosine_similarity(v, lv) s, row_number() OVER (PARTITION BY lid ORDER BY round(list_cosine_similarity(v, lv), 9) DESC, vec_id) r FROM e, l WHERE vec_id <> lid) SELECT lid AS landmark, vec_id, round(s, 6) score, r AS rank FROM r WHERE r <= 10")
def _(embeddings):
    landmarks = embeddings.where("vec_id < 5").select(C("vec_id").alias("landmark"), C("embedding").alias("lv"))  # a fixed handful
    s = A.dot("embedding", "lv") / (A.norm("embedding") * A.norm("lv"))
    d = embeddings.crossJoin(F.broadcast(landmarks)).where("vec_id <> landmark").select("landmark", "vec_id", s.alias("score"))
    d = R.top_per_group(d, ["landmark"], 10, F.desc(F.round("score", 9)), C("vec_id"))
    return d.select("landmark", "vec_id", r6(C("score"), "score"), C("rank").cast("long").alias("rank"))


@op("GR_01_pagerank", "inner_edges")
def _(edges):
    return A.pagerank(edges)


@op("GR_08_citer_matrix", "edges", sql="SELECT source_year % 3 AS cluster, ref_year % 4 AS community, count(DISTINCT source_id) n FROM edges GROUP BY 1, 2")
def _(edges):
    return edges.groupBy((C("source_year") % 3).alias("cluster"), (C("ref_year") % 4).alias("community")).agg(F.countDistinct("source_id").alias("n"))


@op("GR_11_flows", "inner_edges", "orders", sql="WITH f AS (SELECT a.o_orderstatus || '>' || b.o_orderstatus flow, count(*) n FROM inner_edges JOIN orders a ON a.o_orderkey = source_id JOIN orders b ON b.o_orderkey = ref_id GROUP BY 1) SELECT flow, n, round(n / sum(n) OVER (), 6) share FROM f")
def _(edges, orders):
    a, b = (orders.select(C("o_orderkey").alias(k), C("o_orderstatus").alias(p)) for k, p in (("source_id", "pa"), ("ref_id", "pb")))
    f = edges.join(a, "source_id").join(b, "ref_id").groupBy(F.concat("pa", F.lit(">"), "pb").alias("flow")).agg(F.count(F.lit(1)).alias("n"))
    return f.withColumn("share", F.round(C("n") / F.sum("n").over(Window.partitionBy()), 6))


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
