"""Queries of joins, aggregates, windows, sorts and set operations, beside their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import relational as R

from . import proxy

C = F.col
Q: dict = {}
SQL: dict[str, str] = {}


def op(name: str, *needs: str, sql: str):
    def put(f):
        Q[name] = lambda spark, sf_dir: f(*[proxy.view(spark, sf_dir, n) if n in proxy._TEXT else proxy.read(spark, sf_dir, n) for n in needs])
        views = [proxy.sql(n) for n in needs if n in proxy._TEXT]
        head = "WITH " + ", ".join(views) if views else ""
        SQL[name] = f"{head}, {sql.strip()[5:]}" if views and sql.strip().upper().startswith("WITH ") else f"{head} {sql}"
        return f

    return put


def r6(x, name):
    return F.round(x, 6).alias(name)


@op("AG_10_venue_concentration", "papers", sql="""WITH n AS (SELECT year, venue, count(*) n FROM papers GROUP BY 1, 2), t AS (SELECT year, sum(n) t FROM n GROUP BY 1)
SELECT n.year, round(CAST(sum((n / t) * (n / t)) AS DOUBLE), 6) hhi, round(-sum((n / t) * ln(n / t)), 6) shannon_entropy, CAST(count(*) AS INT) n_venues, CAST(max(t) AS INT) n_papers FROM n JOIN t ON n.year = t.year GROUP BY 1""")
def _(papers):
    d = R.concentration(papers, "year", "venue")
    return d.select("year", r6(C("hhi"), "hhi"), r6(C("shannon_entropy"), "shannon_entropy"), "n_venues", "n_papers")


@op("AG_01_priority_merge", "works", sql=f"""WITH w AS (SELECT *, CASE source WHEN 'src3' THEN 0 WHEN 'src1' THEN 1 ELSE 2 END * 1000000 + work_id AS r, {T and "lower(trim(regexp_replace(trim(doi), '^(https?://(dx.)?doi.org/|doi:)', '', 'i')))"} AS d FROM works WHERE doi IS NOT NULL)
SELECT d AS doi_norm, arg_min(title, r) FILTER (WHERE trim(title) <> '') AS title, arg_min(first_author, r) FILTER (WHERE trim(coalesce(first_author, '')) <> '') AS first_author, max(cited_by_count) AS cited_by_count, max(from_grey) AS from_grey FROM w GROUP BY 1""")
def _(works):
    d = works.where("doi is not null").withColumn("doi_norm", T.normalize_doi(C("doi")))
    rank = F.when(C("source") == "src3", 0).when(C("source") == "src1", 1).otherwise(2) * 1000000 + C("work_id")
    return R.priority_merge(d, "doi_norm", rank, ["title", "first_author"], ["cited_by_count", "from_grey"])


@op("AG_03_share_of_total", "works", sql="SELECT lang, count(*) n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) pct FROM works GROUP BY 1")
def _(works):
    return R.share_of_total(works, "lang").withColumn("pct", F.round("pct", 6))


@op("AG_03_folded_shares", "works", sql="WITH n AS (SELECT keywords k, count(*) n FROM works GROUP BY 1), m AS (SELECT CASE WHEN n < 3 THEN 'Other' ELSE k END keywords, CAST(sum(n) AS BIGINT) n FROM n GROUP BY 1) SELECT keywords, n, round(100.0 * n / sum(n) OVER (), 6) pct FROM m")
def _(works):
    return R.folded_shares(works, "keywords", 3).withColumn("pct", F.round("pct", 6))


@op("AG_04_group_stats", "works", sql="SELECT g.lang, round(avg(cited_by_count), 6) mean, round(median(cited_by_count), 6) median, count(work_id) n FROM (SELECT unnest(['en', 'fr', 'xx', 'de']) lang) g LEFT JOIN works USING (lang) GROUP BY 1")
def _(works):
    spine = works.sparkSession.createDataFrame([(x,) for x in ("en", "fr", "xx", "de")], "lang string")
    return F.broadcast(spine).join(works, "lang", "left").groupBy("lang").agg(r6(F.avg("cited_by_count"), "mean"), r6(F.median("cited_by_count"), "median"), F.count("work_id").alias("n"))


@op("AG_05_contingency", "works", sql="""WITH n AS (SELECT lang, source_count s, count(*) n FROM works GROUP BY 1, 2), a AS (SELECT lang, sum(n) ra FROM n GROUP BY 1), b AS (SELECT s, sum(n) cb FROM n GROUP BY 1), t AS (SELECT sum(n) t FROM n)
SELECT lang, s AS source_count, CAST(coalesce(n, 0) AS BIGINT) n, round(CAST(ra * cb / t AS DOUBLE), 6) expected, round((coalesce(n, 0) - ra * cb / t) / sqrt(ra * cb / t), 6) residual FROM a CROSS JOIN b CROSS JOIN t LEFT JOIN n USING (lang, s)""")
def _(works):
    d = R.contingency(works, "lang", "source_count")
    return d.select("lang", "source_count", C("n").cast("long").alias("n"), r6(C("expected"), "expected"), r6(C("residual"), "residual"))


@op("AG_06_crosstab", "works", sql="SELECT p AS year, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'fr') AS fr, count(*) FILTER (WHERE lang = 'de') AS de FROM (SELECT unnest(range(1994, 2003)) p) LEFT JOIN works ON year = p GROUP BY 1")
def _(works):
    spine = works.sparkSession.range(1994, 2003).select(C("id").alias("year"))
    pivot = works.groupBy(C("year").cast("long").alias("year")).pivot("lang", ["en", "fr", "de"]).count()
    return spine.join(pivot, "year", "left").na.fill(0)


@op("AG_07_margins", "works", sql="SELECT lang, source_count, count(*) n FROM works GROUP BY CUBE (lang, source_count)")
def _(works):
    return works.cube("lang", "source_count").agg(F.count(F.lit(1)).alias("n"))


@op("AG_08_yearly_percent", "works", sql="SELECT year, round(100.0 * count(*) FILTER (WHERE lang = 'en') / count(*), 6) en, round(100.0 * count(*) FILTER (WHERE lang <> 'en') / count(*), 6) other FROM works GROUP BY 1")
def _(works):
    n = F.count(F.lit(1))
    return works.groupBy("year").agg(r6(100 * F.count(F.when(C("lang") == "en", 1)) / n, "en"), r6(100 * F.count(F.when(C("lang") != "en", 1)) / n, "other"))


@op("AG_09_yearly_flag_sum", "works", sql="SELECT year, CAST(sum(from_grey) AS BIGINT) grey, count(*) n FROM works GROUP BY 1")
def _(works):
    return works.groupBy("year").agg(F.sum("from_grey").alias("grey"), F.count(F.lit(1)).alias("n"))


@op("AG_11_venue_summary", "works", sql="SELECT venue, count(*) works, CAST(sum(cited_by_count) AS BIGINT) cited FROM works GROUP BY 1 ORDER BY works DESC, cited DESC, venue LIMIT 10")
def _(works):
    return works.groupBy("venue").agg(F.count(F.lit(1)).alias("works"), F.sum("cited_by_count").alias("cited")).orderBy(F.desc("works"), F.desc("cited"), "venue").limit(10)


@op("AG_12_prefix_groups", "works", sql="WITH g AS (SELECT 'Teens' venue, count(*) n FROM works WHERE starts_with(venue, 'src1')), o AS (SELECT venue, count(*) n FROM works WHERE NOT starts_with(venue, 'src1') GROUP BY 1 ORDER BY n DESC, venue LIMIT 5) SELECT * FROM g UNION ALL SELECT * FROM o")
def _(works):
    group = works.where(C("venue").startswith("src1")).agg(F.lit("Teens").alias("venue"), F.count(F.lit(1)).alias("n"))
    rest = works.where(~C("venue").startswith("src1")).groupBy("venue").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "venue").limit(5)
    return group.unionByName(rest)


@op("AG_13_pole_lean", "works", sql="""WITH v AS (SELECT venue, count(*) FILTER (WHERE year < 1998) e, count(*) FILTER (WHERE year >= 1998) a FROM works GROUP BY 1), l AS (SELECT *, log2((e + 0.5) / (a + 0.5)) lean FROM v WHERE e + a >= 5), k AS (SELECT *, CASE WHEN lean > 0 THEN 'early' ELSE 'late' END pole FROM l)
SELECT venue, e, a, round(lean, 6) lean, pole FROM (SELECT *, row_number() OVER (PARTITION BY pole ORDER BY e + a DESC, venue) r FROM k) WHERE r <= 5""")
def _(works):
    v = works.groupBy("venue").agg(F.count(F.when(C("year") < 1998, 1)).alias("e"), F.count(F.when(C("year") >= 1998, 1)).alias("a")).where("e + a >= 5")
    v = v.withColumn("lean", F.log2((C("e") + 0.5) / (C("a") + 0.5))).withColumn("pole", F.when(C("lean") > 0, "early").otherwise("late"))
    return R.top_per_group(v, ["pole"], 5, F.desc(C("e") + C("a")), C("venue")).select("venue", "e", "a", r6(C("lean"), "lean"), "pole")


@op("AG_14_source_stats", "works", sql="WITH s AS (SELECT 'grey' src, * FROM works WHERE from_grey = 1 UNION ALL SELECT 'teaching', * FROM works WHERE from_teaching = 1 UNION ALL SELECT 'total', * FROM works) SELECT src, count(*) n, count(doi) with_doi, round(avg(year), 6) mean_year FROM s GROUP BY 1")
def _(works):
    flags = F.array_compact(F.array(F.when(C("from_grey") == 1, "grey"), F.when(C("from_teaching") == 1, "teaching"), F.lit("total")))
    return works.withColumn("src", F.explode(flags)).groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.count("doi").alias("with_doi"), r6(F.avg("year"), "mean_year"))


@op("AG_15_coverage", "works", sql="SELECT CASE WHEN year BETWEEN 1995 AND 1997 THEN '1995–1997' ELSE '1998–1999' END AS period, count(*) n, round(100.0 * count(doi) / count(*), 6) coverage, round(100.0 * count(doi) FILTER (WHERE cited_by_count >= 50) / nullif(count(*) FILTER (WHERE cited_by_count >= 50), 0), 6) core FROM works GROUP BY 1")
def _(works):
    core = C("cited_by_count") >= 50
    return works.groupBy(T.period(C("year"), ((1995, 1997), (1998, 1999))).alias("period")).agg(F.count(F.lit(1)).alias("n"), r6(100 * F.count("doi") / F.count(F.lit(1)), "coverage"), r6(100 * F.count(F.when(core, C("doi"))) / F.nullif(F.count(F.when(core, 1)), F.lit(0)), "core"))


@op("AG_16_corpus_stats", "works", sql="SELECT count(*) n, count(DISTINCT venue) venues, min(year) first_year, max(year) last_year, count(*) FILTER (WHERE cited_by_count >= 50) core, count(*) FILTER (WHERE lang <> 'en') other_languages FROM works")
def _(works):
    return works.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("venue").alias("venues"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count(F.when(C("cited_by_count") >= 50, 1)).alias("core"), F.count(F.when(C("lang") != "en", 1)).alias("other_languages"))


@op("AG_17_flag_counts", "works", sql="SELECT trim(f) flag, count(*) n FROM (SELECT unnest(string_split(keywords, ';')) f FROM works) GROUP BY 1")
def _(works):
    return works.select(F.explode(F.split("keywords", "; *")).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


@op("AG_18_collect_set", "edges", sql="SELECT source_id, count(DISTINCT ref_id) n_refs FROM edges GROUP BY 1")
def _(edges):
    return edges.groupBy("source_id").agg(F.size(F.collect_set("ref_id")).cast("long").alias("n_refs"))


@op("AG_19_group_concat", "works", sql="SELECT lang, string_agg(DISTINCT source, ' ; ' ORDER BY source) sources FROM works GROUP BY 1")
def _(works):
    return works.groupBy("lang").agg(F.array_join(F.array_sort(F.collect_set("source")), " ; ").alias("sources"))


@op("AG_20_distinct_threshold", "edges", sql="SELECT ref_id, count(DISTINCT source_year) n FROM edges GROUP BY 1 HAVING count(DISTINCT source_year) >= 3")
def _(edges):
    return edges.groupBy("ref_id").agg(F.countDistinct("source_year").alias("n")).where("n >= 3")


@op("AG_21_breakdown", "works", sql="SELECT lang, has_doi, count(*) n, count(*) FILTER (WHERE source_count >= 2) n2 FROM (SELECT *, CAST(doi IS NOT NULL AS INT) has_doi FROM works) GROUP BY GROUPING SETS ((lang, has_doi), (lang), ())")
def _(works):
    d = works.withColumn("has_doi", C("doi").isNotNull().cast("int"))
    return d.groupingSets([["lang", "has_doi"], ["lang"], []], "lang", "has_doi").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(C("source_count") >= 2, 1)).alias("n2"))


@op("AG_22_detailed_groups", "works", sql="SELECT source, count(doi) n FROM works GROUP BY 1 HAVING count(doi) >= 5")
def _(works):
    return works.groupBy("source").agg(F.count("doi").alias("n")).where("n >= 5")


@op("AG_23_trimmed_band", "works", sql="""WITH s AS (SELECT source, list_sort(list(cited_by_count)) s FROM works GROUP BY 1), k AS (SELECT source, len(s) n, CASE WHEN len(s) <= 4 THEN s ELSE s[3:len(s) - 2] END k FROM s)
SELECT source, k[1] lo, CAST(k[(len(k) + 1) // 2] + k[len(k) // 2 + 1] AS DOUBLE) / 2 mid, k[len(k)] hi, CAST(n AS INT) n FROM k""")
def _(works):
    return R.trimmed_band(works, ["source"], "cited_by_count", 2)


@op("AG_24_medians", "works", sql="SELECT year, lang, median(cited_by_count) m FROM works GROUP BY 1, 2")
def _(works):
    return works.groupBy("year", "lang").agg(F.median("cited_by_count").alias("m"))


@op("AG_25_quantiles", "works", sql="SELECT year, round(quantile_cont(cited_by_count, 0.025), 6) q025, round(quantile_cont(cited_by_count, 0.5), 6) q50, round(quantile_cont(cited_by_count, 0.975), 6) q975 FROM works GROUP BY 1")
def _(works):
    return works.groupBy("year").agg(*[r6(F.percentile("cited_by_count", F.lit(q)), n) for q, n in ((0.025, "q025"), (0.5, "q50"), (0.975, "q975"))])


@op("AG_26_top_keywords", "works", sql="WITH k AS (SELECT year, trim(unnest(string_split(lower(keywords), ';'))) k FROM works), n AS (SELECT year, k, count(*) n FROM k GROUP BY 1, 2) SELECT year, k AS keyword, n FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY n DESC, k) r FROM n) WHERE r <= 10")
def _(works):
    n = works.select("year", F.explode(F.split(F.lower("keywords"), "; *")).alias("keyword")).groupBy("year", "keyword").agg(F.count(F.lit(1)).alias("n"))
    return R.top_per_group(n, ["year"], 10, F.desc("n"), C("keyword")).drop("rank")


@op("AG_27_wilson", "works", sql="""WITH g AS (SELECT lang, count(*) FILTER (WHERE doi IS NOT NULL) s, count(*) n FROM works GROUP BY 1), p AS (SELECT *, s / n p, 1.959963984540054 z FROM g)
SELECT lang, s, n, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) lo, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) hi FROM p""")
def _(works):
    g = works.groupBy("lang").agg(F.count("doi").alias("s"), F.count(F.lit(1)).alias("n"))
    lo, hi = T.wilson(C("s"), C("n"))
    return g.select("lang", "s", "n", r6(lo, "lo"), r6(hi, "hi"))


@op("AG_28_cohens_d", "works", sql="WITH s AS (SELECT avg(cited_by_count) FILTER (WHERE lang = 'en') a, avg(cited_by_count) FILTER (WHERE lang = 'fr') b, var_samp(cited_by_count) FILTER (WHERE lang = 'en') va, var_samp(cited_by_count) FILTER (WHERE lang = 'fr') vb FROM works) SELECT round((a - b) / sqrt((va + vb) / 2), 6) d FROM s")
def _(works):
    x = lambda g: F.when(C("lang") == g, C("cited_by_count"))
    return works.agg(r6((F.avg(x("en")) - F.avg(x("fr"))) / F.sqrt((F.var_samp(x("en")) + F.var_samp(x("fr"))) / 2), "d"))


@op("AG_29_auc", "documents", "labels", sql="""WITH d AS (SELECT n_chars s, quality y FROM documents JOIN labels USING (doc_id)), r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 r FROM d)
SELECT round((sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) auc, CAST(sum(y) AS BIGINT) positives, CAST(count(*) - sum(y) AS BIGINT) negatives FROM r""")
def _(documents, labels):
    d = R.auc(documents.select("doc_id", "n_chars").join(labels, "doc_id"), "n_chars", "quality")
    return d.select(r6(C("auc"), "auc"), "positives", "negatives")


@op("AG_30_youden", "documents", "labels", sql="""WITH d AS (SELECT least(n_chars / 5000.0, 1.0) s, quality y FROM documents JOIN labels USING (doc_id)), t AS (SELECT unnest(range(0, 200)) i), c AS (SELECT i, count(*) FILTER (WHERE s >= i / 199.0 AND y = 1) tp, count(*) FILTER (WHERE s >= i / 199.0 AND y = 0) fp, count(*) FILTER (WHERE y = 1) p, count(*) FILTER (WHERE y = 0) n FROM d CROSS JOIN t GROUP BY 1)
SELECT CAST(i AS INT) i, tp, fp, round(tp / p - fp / n, 6) j FROM c ORDER BY round(tp / p - fp / n, 9) DESC, i LIMIT 1""")
def _(documents, labels):
    # Each row counts at all thresholds up to its own, so counts by threshold summed from the top give them all.
    d = documents.select("doc_id", "n_chars").join(labels, "doc_id").withColumn("i", F.floor(F.least(C("n_chars") / 5000.0, F.lit(1.0)) * 199 + F.lit(1e-9)).cast("int"))
    n = documents.sparkSession.range(200).select(C("id").cast("int").alias("i")).join(d.groupBy("i").agg(F.sum("quality").alias("p1"), F.sum(1 - C("quality")).alias("n1")), "i", "left").na.fill(0)
    w, all_ = Window.orderBy(F.desc("i")), Window.partitionBy()
    n = n.select("i", F.sum("p1").over(w).alias("tp"), F.sum("n1").over(w).alias("fp"), F.sum("p1").over(all_).alias("p"), F.sum("n1").over(all_).alias("n"))
    j = C("tp") / C("p") - C("fp") / C("n")
    return n.orderBy(F.desc(F.round(j, 9)), "i").limit(1).select("i", "tp", "fp", r6(j, "j"))


@op("AG_31_adjusted_rand", "works", sql="""WITH n AS (SELECT lang a, source_count b, count(*) n FROM works GROUP BY 1, 2), s AS (SELECT sum(n * (n - 1) / 2) s, sum(n) t FROM n), r AS (SELECT sum(n * (n - 1) / 2) r FROM (SELECT sum(n) n FROM n GROUP BY a)), c AS (SELECT sum(n * (n - 1) / 2) c FROM (SELECT sum(n) n FROM n GROUP BY b))
SELECT round((s - r * c / (t * (t - 1) / 2)) / ((r + c) / 2 - r * c / (t * (t - 1) / 2)), 6) ari FROM s, r, c""")
def _(works):
    return R.rand_index(works, "lang", "source_count").select(r6(C("ari"), "ari"))


@op("AG_32_growth_correlation", "papers", sql="WITH y AS (SELECT year, count(*) n, avg(price) v FROM papers GROUP BY 1), g AS (SELECT year, v, n / lag(n) OVER (ORDER BY year) - 1 g FROM y) SELECT round(corr(v, g), 6) r, abs(corr(v, g)) > 0.5 confounded FROM g")
def _(papers):
    y = papers.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.avg("price").alias("v"))
    y = y.withColumn("g", C("n") / F.lag("n").over(Window.orderBy("year")) - 1)
    return y.agg(r6(F.corr("v", "g"), "r"), (F.abs(F.corr("v", "g")) > 0.5).alias("confounded"))


@op("AG_33_mean_z", "papers", sql="WITH g AS (SELECT year, venue, avg(price) v FROM papers GROUP BY 1, 2), z AS (SELECT year, (v - avg(v) OVER w) / nullif(stddev_samp(v) OVER w, 0) z FROM g WINDOW w AS (PARTITION BY venue)) SELECT year, round(avg(z), 6) z FROM z GROUP BY 1")
def _(papers):
    z = R.zscore(papers.groupBy("year", "venue").agg(F.avg("price").alias("v")), ["venue"], "v")
    return z.groupBy("year").agg(r6(F.avg("z"), "z"))


@op("WN_01_zscore", "papers", sql="WITH g AS (SELECT year, venue, count(*) v FROM papers GROUP BY 1, 2) SELECT year, venue, v, round((v - avg(v) OVER w) / nullif(stddev_samp(v) OVER w, 0), 6) z FROM g WINDOW w AS (PARTITION BY venue)")
def _(papers):
    return R.zscore(papers.groupBy("year", "venue").agg(F.count(F.lit(1)).alias("v")), ["venue"], "v").withColumn("z", F.round("z", 6))


@op("WN_02_zscore_dense", "papers", sql="WITH n AS (SELECT year, kind, count(*) n FROM papers WHERE price > 90000 GROUP BY 1, 2), f AS (SELECT y.year, k.kind, coalesce(n.n, 0) v FROM (SELECT DISTINCT year FROM papers) y CROSS JOIN (SELECT DISTINCT kind FROM papers) k LEFT JOIN n ON n.year = y.year AND n.kind = k.kind) SELECT year, kind, v, round(coalesce((v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0), 0), 6) z FROM f WINDOW w AS (PARTITION BY kind)")
def _(papers):
    n = papers.where("price > 90000").groupBy("year", "kind").agg(F.count(F.lit(1)).alias("v"))
    spine = papers.select("year").distinct().crossJoin(F.broadcast(papers.select("kind").distinct()))  # categories only
    return R.zscore(spine.join(n, ["year", "kind"], "left").na.fill(0), ["kind"], "v", sample=False, flat=0.0).withColumn("z", F.round("z", 6))


@op("WN_03_local_maxima", "papers", sql="WITH g AS (SELECT venue, year, count(*) v FROM papers GROUP BY 1, 2), l AS (SELECT *, lag(v) OVER w p, lead(v) OVER w n FROM g WINDOW w AS (PARTITION BY venue ORDER BY year)) SELECT venue, year, v FROM l WHERE v > 10 AND v > p AND v > n")
def _(papers):
    return R.local_maxima(papers.groupBy("venue", "year").agg(F.count(F.lit(1)).alias("v")), ["venue"], "year", "v", 10)


@op("WN_04_percent_change", "papers", sql="WITH g AS (SELECT venue, year, count(*) v FROM papers GROUP BY 1, 2) SELECT venue, year, round(v / lag(v) OVER (PARTITION BY venue ORDER BY year) - 1, 6) change FROM g")
def _(papers):
    g = papers.groupBy("venue", "year").agg(F.count(F.lit(1)).alias("v"))
    return g.select("venue", "year", r6(C("v") / F.lag("v").over(Window.partitionBy("venue").orderBy("year")) - 1, "change"))


@op("WN_05_interpolate", "papers", sql="""WITH g AS (SELECT venue, year, CASE WHEN (year + length(venue)) % 3 = 0 THEN NULL ELSE count(*) END v FROM papers GROUP BY 1, 2), f AS (SELECT *, last_value(v IGNORE NULLS) OVER b x0, last_value(CASE WHEN v IS NOT NULL THEN year END IGNORE NULLS) OVER b t0, first_value(v IGNORE NULLS) OVER a x1, first_value(CASE WHEN v IS NOT NULL THEN year END IGNORE NULLS) OVER a t1 FROM g WINDOW b AS (PARTITION BY venue ORDER BY year ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY venue ORDER BY year ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT venue, year, round(CAST(CASE WHEN t0 IS NULL THEN x1 WHEN t1 IS NULL OR t1 = t0 THEN x0 ELSE x0 + (x1 - x0) * (year - t0) / (t1 - t0) END AS DOUBLE), 6) filled FROM f""")
def _(papers):
    g = papers.groupBy("venue", "year").agg(F.count(F.lit(1)).alias("v")).withColumn("v", F.when((C("year") + F.length("venue")) % 3 != 0, C("v").cast("double")))
    return R.interpolate(g, ["venue"], "year", "v").select("venue", "year", r6(C("filled"), "filled"))


@op("WN_06_ccdf", "edges", sql="WITH d AS (SELECT ref_id, count(*) k FROM edges GROUP BY 1), h AS (SELECT k, count(*) n FROM d GROUP BY 1) SELECT k, CAST(sum(n) OVER (ORDER BY k DESC) AS BIGINT) at_least FROM h")
def _(edges):
    h = edges.groupBy("ref_id").agg(F.count(F.lit(1)).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    return h.select("k", F.sum("n").over(Window.orderBy(F.desc("k"))).alias("at_least"))


@op("WN_07_keep_best", "works", sql="SELECT title, work_id, cited_by_count FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY cited_by_count DESC, work_id) r FROM works) WHERE r = 1")
def _(works):
    return R.keep_best(works, ["title"], F.desc("cited_by_count"), C("work_id")).select("title", "work_id", "cited_by_count")


@op("WN_08_first_edges", "edges", sql="SELECT source_id, ref_id FROM (SELECT DISTINCT source_id, ref_id, row_number() OVER (PARTITION BY source_id ORDER BY ref_id) r FROM (SELECT DISTINCT source_id, ref_id FROM edges)) WHERE r <= 3")
def _(edges):
    return R.top_per_group(edges.select("source_id", "ref_id").distinct(), ["source_id"], 3, C("ref_id")).drop("rank")


@op("WN_09_slots", "works", sql="SELECT work_id, row_number() OVER w - 1 slot, count(*) OVER (PARTITION BY lang, year) n FROM works WINDOW w AS (PARTITION BY lang, year ORDER BY cited_by_count DESC, work_id)")
def _(works):
    return works.select("work_id", (F.row_number().over(Window.partitionBy("lang", "year").orderBy(F.desc("cited_by_count"), "work_id")) - 1).cast("long").alias("slot"), F.count(F.lit(1)).over(Window.partitionBy("lang", "year")).alias("n"))


@op("WN_10_top_three", "works", sql="SELECT year, lang, work_id, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY year, lang ORDER BY cited_by_count DESC, work_id) r FROM works) WHERE r <= 3")
def _(works):
    return R.top_per_group(works, ["year", "lang"], 3, F.desc("cited_by_count"), C("work_id")).select("year", "lang", "work_id", C("rank").cast("long").alias("rank"))


@op("WN_11_stack_bottoms", "works", sql="WITH n AS (SELECT year, lang, count(*) n FROM works GROUP BY 1, 2) SELECT year, lang, n, CAST(coalesce(sum(n) OVER (PARTITION BY year ORDER BY lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) bottom FROM n")
def _(works):
    n = works.groupBy("year", "lang").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("bottom", F.coalesce(F.sum("n").over(Window.partitionBy("year").orderBy("lang").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


@op("WN_12_interval_counts", "papers", sql="WITH n AS (SELECT year, count(*) n FROM papers GROUP BY 1) SELECT year, CAST(coalesce(sum(n) OVER (ORDER BY year RANGE BETWEEN 2 PRECEDING AND 1 PRECEDING), 0) AS BIGINT) before, CAST(coalesce(sum(n) OVER (ORDER BY year RANGE BETWEEN 1 FOLLOWING AND 2 FOLLOWING), 0) AS BIGINT) after FROM n")
def _(papers):
    w = Window.orderBy("year")
    return papers.groupBy("year").agg(F.count(F.lit(1)).alias("n")).select("year", F.coalesce(F.sum("n").over(w.rangeBetween(-2, -1)), F.lit(0)).alias("before"), F.coalesce(F.sum("n").over(w.rangeBetween(1, 2)), F.lit(0)).alias("after"))


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
