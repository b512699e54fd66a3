"""Queries of corpus building: joins, sets, sorts, merge, flags and filter, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import corpus as O
from quillspark.operators import relational as R

from . import proxy
from .relational import C, r6
from .scalars import _ASCII, _DOI

Q: dict = {}
SQL: dict[str, str] = {}
SAFE, NOISE = ["tion", "eau"], ["the", "der "]
_SAFE = "coalesce(contains(lower(title), 'tion') OR contains(lower(title), 'eau'), false)"
_NOISE = "coalesce(contains(lower(trim(title)), 'the') OR contains(lower(trim(title)), 'der '), false)"
_BLANK = "coalesce(trim(CAST({} AS VARCHAR)), '') IN ('', 'nan')"
_F1 = f"({_BLANK.format('title')} OR (({_BLANK.format('first_author')} OR {_BLANK.format('year')}) AND NOT {_SAFE}))"
_F2 = f"(NOT length(coalesce(trim(abstract), '')) > 50 AND NOT {_SAFE})"
_F3 = f"({_NOISE} AND NOT {_SAFE})"
_WHY = "concat_ws('; ', CASE WHEN cited_by_count >= 50 THEN 'cited_by=' || cited_by_count END, CASE WHEN source_count >= 2 THEN 'multi_source=' || source_count END, CASE WHEN work_id % 6 = 0 THEN 'cited_in_corpus' END, CASE WHEN from_teaching = 1 THEN 'from_teaching' END)"


def op(name: str, *needs: str, sql: str):
    def put(f):
        Q[name] = lambda spark, sf_dir: f(*[proxy.view(spark, sf_dir, n) if n in proxy._TEXT else proxy.read(spark, sf_dir, n) for n in needs])
        views = [proxy.sql(n) for n in needs if n in proxy._TEXT]
        head = "WITH " + ", ".join(views) if views else ""
        SQL[name] = f"{head}, {sql.strip()[5:]}" if views and sql.strip().upper().startswith("WITH ") else f"{head} {sql}"
        return f

    return put


@op("JN_01_inner_on_doi", "works", sql=f"WITH d AS (SELECT *, {_DOI} d FROM works WHERE doi IS NOT NULL) SELECT a.work_id, b.work_id AS other FROM d a JOIN d b ON a.d = b.d AND a.work_id < b.work_id")
def _(works):
    d = works.where("doi is not null").select("work_id", T.normalize_doi(C("doi")).alias("d"))
    return d.join(d.select("d", C("work_id").alias("other")), "d").where("work_id < other").select("work_id", "other")


@op("JN_02_left_dedup_right", "orders", "customer", sql="SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def _(orders, customer):
    right = customer.where("c_acctbal > 0").dropDuplicates(["c_custkey"]).select("c_custkey", "c_mktsegment")
    return orders.join(right, C("o_custkey") == C("c_custkey"), "left").select("o_orderkey", "c_mktsegment")


@op("JN_03_two_key", "papers", sql="WITH a AS (SELECT year, venue, count(*) n FROM papers GROUP BY 1, 2), b AS (SELECT year, venue, round(avg(price), 6) p FROM papers GROUP BY 1, 2) SELECT year, venue, n, p FROM a JOIN b USING (year, venue)")
def _(papers):
    return papers.groupBy("year", "venue").agg(F.count(F.lit(1)).alias("n")).join(papers.groupBy("year", "venue").agg(r6(F.avg("price"), "p")), ["year", "venue"])


@op("JN_04_semi_flag", "works", "labels", sql="SELECT work_id, work_id IN (SELECT doc_id FROM labels) AS in_labels FROM works")
def _(works, labels):
    ids = labels.select(C("doc_id").alias("work_id")).distinct().withColumn("_in", F.lit(True))
    return works.select("work_id").join(ids, "work_id", "left").select("work_id", F.coalesce("_in", F.lit(False)).alias("in_labels"))


@op("JN_05_isolated", "inner_edges", "orders", sql="SELECT o_orderkey AS work_id FROM orders WHERE year(o_orderdate) <= 2000 AND o_orderkey NOT IN (SELECT source_id FROM inner_edges UNION SELECT ref_id FROM inner_edges)")
def _(edges, orders):
    w = orders.select(C("o_orderkey").alias("work_id"), F.year("o_orderdate").alias("year"))
    return O.flag_isolated(w, edges, "work_id", 2000).where("isolated").select("work_id")


@op("JN_07_lookup_fallbacks", "works", "labels", sql="SELECT work_id, coalesce(CAST(a.quality AS VARCHAR), CAST(b.toxic AS VARCHAR), 'none') v FROM works LEFT JOIN labels a ON a.doc_id = work_id LEFT JOIN labels b ON b.doc_id = work_id - 1")
def _(works, labels):
    a = labels.select(C("doc_id").alias("work_id"), C("quality").cast("string").alias("a"))
    b = labels.select((C("doc_id") + 1).alias("work_id"), C("toxic").cast("string").alias("b"))
    return works.select("work_id").join(a, "work_id", "left").join(b, "work_id", "left").select("work_id", F.coalesce("a", "b", F.lit("none")).alias("v"))


@op("JN_08_fill_missing", "works", sql="SELECT w.work_id, CASE WHEN w.first_author IS NULL OR lower(trim(w.first_author)) IN ('', 'nan', 'none') THEN c.a ELSE w.first_author END first_author FROM works w LEFT JOIN (SELECT source_id, 'Filled ' || source_id a FROM works WHERE work_id % 2 = 0) c USING (source_id)")
def _(works):
    cache = works.where("work_id % 2 = 0").select("source_id", F.concat(F.lit("Filled "), "source_id").alias("first_author"))
    return O.fill_from(works.select("work_id", "source_id", "first_author"), cache, "source_id", "first_author").select("work_id", "first_author")


@op("JN_09_crossfill_longest", "works", sql=f"WITH d AS (SELECT work_id, {_DOI} d, CASE WHEN work_id % 3 = 0 THEN NULL ELSE title END t FROM works), b AS (SELECT d, arg_max(t, length(t) * 1000000 - work_id) v FROM d WHERE t IS NOT NULL AND lower(trim(t)) NOT IN ('', 'nan', 'none') AND d <> '' GROUP BY 1) SELECT work_id, CASE WHEN t IS NULL OR lower(trim(t)) IN ('', 'nan', 'none') THEN v ELSE t END title FROM d LEFT JOIN b USING (d)")
def _(works):
    d = works.select("work_id", T.normalize_doi(C("doi")).alias("d"), F.when(C("work_id") % 3 != 0, C("title")).alias("title"))
    return O.crossfill_longest(d, "d", "title", "work_id").select("work_id", "title")


@op("JN_13_cocitation", "edges", sql="WITH t AS (SELECT ref_id FROM (SELECT ref_id, count(*) n FROM edges GROUP BY 1) ORDER BY n DESC, ref_id LIMIT 60), e AS (SELECT DISTINCT source_id, ref_id FROM edges WHERE ref_id IN (SELECT ref_id FROM t)) SELECT a.ref_id a, b.ref_id b, count(*) n FROM e a JOIN e b ON a.source_id = b.source_id AND a.ref_id < b.ref_id GROUP BY 1, 2")
def _(edges):
    top = edges.groupBy("ref_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "ref_id").limit(60).select("ref_id")
    return R.pairs_within(edges.join(F.broadcast(top), "ref_id", "left_semi"), "source_id", "ref_id")


@op("JN_14_coupling", "edges", sql="WITH e AS (SELECT DISTINCT source_id, ref_id FROM edges) SELECT a.source_id a, b.source_id b, count(*) n FROM e a JOIN e b ON a.ref_id = b.ref_id AND a.source_id < b.source_id GROUP BY 1, 2 HAVING count(*) >= 2")
def _(edges):
    return R.pairs_within(edges, "ref_id", "source_id").where("n >= 2")


@op("JN_15_window_members", "papers", sql="WITH b AS (SELECT min(year) lo, max(year) hi FROM papers), a AS (SELECT w.w AS width, CAST(y.y AS INT) anchor FROM b, (SELECT unnest([1, 2]) w) w, (SELECT unnest(range(1990, 2010)) y) y WHERE y.y >= lo + w.w AND y.y < hi - w.w) SELECT anchor, CAST(width AS INT) width, CASE WHEN year < anchor THEN 'before' ELSE 'after' END side, count(*) n FROM papers JOIN a ON year BETWEEN anchor - width AND anchor - 1 OR year BETWEEN anchor + 1 AND anchor + width GROUP BY 1, 2, 3")
def _(papers):
    return R.windows_before_after(papers.select("year"), "year", (1, 2), 1).groupBy("anchor", "width", "side").agg(F.count(F.lit(1)).alias("n"))


@op("JN_16_two_lookups", "inner_edges", "orders", sql="SELECT concat(a.o_orderpriority, '>', b.o_orderpriority) flow, count(*) n FROM inner_edges JOIN orders a ON a.o_orderkey = source_id JOIN orders b ON b.o_orderkey = ref_id GROUP BY 1")
def _(edges, orders):
    a, b = (orders.select(C("o_orderkey").alias(k), C("o_orderpriority").alias(p)) for k, p in (("source_id", "pa"), ("ref_id", "pb")))
    return edges.join(a, "source_id").join(b, "ref_id").groupBy(F.concat("pa", F.lit(">"), "pb").alias("flow")).agg(F.count(F.lit(1)).alias("n"))


@op("JN_17_full_outer", "works", sql="WITH a AS (SELECT keywords k, count(*) a FROM works WHERE year < 1998 GROUP BY 1), b AS (SELECT keywords k, count(*) b FROM works WHERE year >= 1998 GROUP BY 1) SELECT k, coalesce(a, 0) a, coalesce(b, 0) b FROM a FULL OUTER JOIN b USING (k)")
def _(works):
    a, b = (works.where(c).groupBy(C("keywords").alias("k")).agg(F.count(F.lit(1)).alias(n)) for c, n in (("year < 1998", "a"), ("year >= 1998", "b")))
    return a.join(b, "k", "full_outer").na.fill(0)


@op("JN_18_jaccard_pairs", "edges", sql="WITH e AS (SELECT DISTINCT source_id, ref_id FROM edges), n AS (SELECT source_id, count(*) n FROM e GROUP BY 1), p AS (SELECT a.source_id a, b.source_id b, count(*) k FROM e a JOIN e b ON a.ref_id = b.ref_id AND a.source_id < b.source_id GROUP BY 1, 2) SELECT a, b, round(k / (x.n + y.n - k), 6) jaccard FROM p JOIN n x ON x.source_id = a JOIN n y ON y.source_id = b")
def _(edges):
    e = edges.select("source_id", "ref_id").distinct()
    e = e.withColumn("refs", F.count(F.lit(1)).over(R.Window.partitionBy("source_id")))
    p = R.pairs_within(e, "ref_id", "source_id", "refs")
    return p.select("a", "b", r6(C("n") / (C("carry_a") + C("carry_b") - C("n")), "jaccard"))


@op("ST_01_union_all", "works", sql="SELECT source, count(*) n FROM (SELECT source FROM works UNION ALL SELECT lang FROM works) GROUP BY 1")
def _(works):
    return works.select("source").unionByName(works.select(C("lang").alias("source"))).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@op("ST_02_merge_citations", "edges", sql="WITH e AS (SELECT CAST(source_id AS VARCHAR) s, CASE WHEN ref_id % 10 = 0 THEN '__NO_REFS__' WHEN ref_id % 3 = 0 THEN '' ELSE '10.1/A' || ref_id END d, 'T' || ref_id % 7 t, 'Author ' || ref_id % 5 f, ref_year y FROM edges), u AS (SELECT 0 p, * FROM e UNION ALL SELECT 1, s, lower(d), ' ' || upper(t), lower(f), y FROM e WHERE y > 1995 AND d <> '__NO_REFS__'), k AS (SELECT *, row_number() OVER (PARTITION BY lower(trim(s)), lower(trim(d)), CASE WHEN d = '' THEN lower(trim(t)) END, CASE WHEN d = '' THEN lower(trim(f)) END, CASE WHEN d = '' THEN y END ORDER BY p, s, d, t, f, y) r FROM u WHERE d <> '__NO_REFS__') SELECT s source_doi, d ref_doi, t ref_title, f ref_first_author, y ref_year FROM k WHERE r = 1")
def _(edges):
    """Two sources of citations, the second with other cases and blanks: its rows go where the first has the key."""
    d = F.when(C("ref_id") % 10 == 0, "__NO_REFS__").when(C("ref_id") % 3 == 0, "").otherwise(F.concat(F.lit("10.1/A"), C("ref_id").cast("string")))
    title, author = (F.concat(F.lit(w), (C("ref_id") % k).cast("string")) for w, k in (("T", 7), ("Author ", 5)))
    e = edges.select(C("source_id").cast("string").alias("source_doi"), d.alias("ref_doi"), title.alias("ref_title"), author.alias("ref_first_author"), "ref_year")
    again = e.where("ref_year > 1995 and ref_doi <> '__NO_REFS__'").select("source_doi", F.lower("ref_doi").alias("ref_doi"), F.concat(F.lit(" "), F.upper("ref_title")).alias("ref_title"), F.lower("ref_first_author").alias("ref_first_author"), "ref_year")
    return O.merge_citations([e, again], "__NO_REFS__")


@op("ST_03_intersection", "works", "labels", sql="SELECT work_id FROM works INTERSECT SELECT doc_id FROM labels WHERE quality = 1")
def _(works, labels):
    return works.select("work_id").intersect(labels.where("quality = 1").select(C("doc_id").alias("work_id")))


@op("ST_04_difference", "works", "labels", sql="SELECT work_id FROM works EXCEPT SELECT doc_id FROM labels")
def _(works, labels):
    return works.select("work_id").subtract(labels.select(C("doc_id").alias("work_id")))


@op("ST_05_jaccard_sets", "works", sql="WITH s AS (SELECT lang, list_distinct(list(source)) s FROM works GROUP BY 1) SELECT a.lang a, b.lang b, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) j FROM s a JOIN s b ON a.lang < b.lang")
def _(works):
    s = works.groupBy("lang").agg(F.collect_set("source").alias("s"))
    o = s.select(C("lang").alias("b"), C("s").alias("t"))
    return s.join(F.broadcast(o), C("lang") < C("b")).select(C("lang").alias("a"), "b", r6(F.size(F.array_intersect("s", "t")) / F.size(F.array_union("s", "t")), "j"))


@op("ST_06_distinct_pairs", "edges", sql="SELECT DISTINCT source_year, ref_year FROM edges")
def _(edges):
    return edges.select("source_year", "ref_year").distinct()


@op("SL_01_mixed_sort", "works", sql="SELECT work_id, year, cited_by_count FROM works ORDER BY year DESC NULLS LAST, cited_by_count, work_id")
def _(works):
    return works.select("work_id", "year", "cited_by_count").orderBy(F.desc_nulls_last("year"), "cited_by_count", "work_id")


@op("SL_02_top_k", "works", sql="SELECT work_id, cited_by_count FROM works ORDER BY cited_by_count DESC, work_id LIMIT 20")
def _(works):
    return works.select("work_id", "cited_by_count").orderBy(F.desc("cited_by_count"), "work_id").limit(20)


@op("SL_04_priority_order", "works", "labels", sql="SELECT work_id, coalesce(quality * 10 + toxic, -1) p FROM works LEFT JOIN labels ON doc_id = work_id ORDER BY p DESC, work_id")
def _(works, labels):
    p = labels.select(C("doc_id").alias("work_id"), (C("quality") * 10 + C("toxic")).alias("p"))
    return works.select("work_id").join(p, "work_id", "left").na.fill(-1).orderBy(F.desc("p"), "work_id")


@op("SL_06_stratified_sample", "works", sql="SELECT lang, work_id FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('3:' || work_id), work_id) r FROM works) WHERE r <= 10")
def _(works):
    h = F.md5(F.concat(F.lit("3:"), C("work_id").cast("string")))
    return R.top_per_group(works.select("lang", "work_id"), ["lang"], 10, h, C("work_id")).drop("rank")


@op("AG_02_two_pass_merge", "works", sql=rf"WITH d AS (SELECT *, {_DOI} d, coalesce(trim(regexp_replace(regexp_replace(lower(title), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g')), '') t FROM works), k AS (SELECT *, CASE WHEN d <> '' THEN 'd:' || d WHEN t <> '' THEN 't:' || t || '|' || year END AS key FROM d) SELECT key, arg_min(title, work_id) FILTER (WHERE trim(title) <> '') title, arg_min(first_author, work_id) FILTER (WHERE trim(coalesce(first_author, '')) <> '') first_author, max(cited_by_count) cited_by_count, count(DISTINCT source) source_count FROM k WHERE key IS NOT NULL GROUP BY 1")
def _(works):
    return O.merge_works(works, C("work_id"))


_FLAGS = {"PL_01_missing_metadata": (lambda: O.flag_missing_metadata(SAFE), _F1), "PL_02_no_abstract": (lambda: O.flag_no_abstract(SAFE), _F2), "PL_03_title_blacklist": (lambda: O.flag_title_blacklist(NOISE, SAFE), _F3), "PL_07_protection": (lambda: O.protection(50, 2, C("work_id") % 6 == 0), _WHY)}
for _name, (_col, _sql) in _FLAGS.items():
    op(_name, "works", sql=f"SELECT work_id, {_sql} AS out FROM works")(lambda works, _col=_col: works.select("work_id", _col().alias("out")))


def _flags():
    return {"missing_metadata": O.flag_missing_metadata(SAFE), "no_abstract": O.flag_no_abstract(SAFE), "title_blacklist": O.flag_title_blacklist(NOISE, SAFE)}


_FLAG_TEXT = f"concat_ws('|', CASE WHEN {_F1} THEN 'missing_metadata' END, CASE WHEN {_F2} THEN 'no_abstract' END, CASE WHEN {_F3} THEN 'title_blacklist' END)"


@op("PL_08_flag_text", "works", sql=f"SELECT work_id, {_FLAG_TEXT} flags FROM works")
def _(works):
    return works.select("work_id", O.flag_text(_flags()).alias("flags"))


@op("PL_09_filter", "works", sql=f"""WITH d AS (SELECT work_id, year, cited_by_count, from_grey, {_DOI} d, CASE WHEN (({_FLAG_TEXT}) <> '' AND ({_WHY}) = '') OR year < 1996 THEN 'remove' ELSE 'keep' END act FROM works),
g AS (SELECT d FROM d WHERE act = 'keep' AND from_grey = 1 AND d <> '' GROUP BY 1 HAVING count(*) > 1), e AS (SELECT * REPLACE (CASE WHEN from_grey = 1 AND d IN (SELECT d FROM g) THEN '' ELSE d END AS d) FROM d)
SELECT work_id, d doi_norm, CASE WHEN act = 'keep' AND d <> '' AND row_number() OVER (PARTITION BY act, d ORDER BY cited_by_count DESC, work_id) > 1 THEN 'deduped' ELSE act END "action" FROM e""")
def _(works):
    d = works.withColumn("doi_norm", T.normalize_doi(C("doi")))
    return O.apply_filter(d, O.flag_text(_flags()) != "", O.protection(50, 2, C("work_id") % 6 == 0) != "", 1996).select("work_id", "doi_norm", "action")


@op("PL_10_dry_run", "works", sql=f"SELECT CASE WHEN ({_FLAG_TEXT}) <> '' AND ({_WHY}) = '' THEN 'would_remove' ELSE 'keep' END act, count(*) n FROM works GROUP BY 1")
def _(works):
    gone = (O.flag_text(_flags()) != "") & (O.protection(50, 2, C("work_id") % 6 == 0) == "")
    return works.groupBy(F.when(gone, "would_remove").otherwise("keep").alias("act")).agg(F.count(F.lit(1)).alias("n"))


@op("PL_13_align_citations", "edges", "part", sql="SELECT source_id, ref_id FROM edges WHERE ref_id IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def _(edges, part):
    return edges.join(part.where("p_size > 25").select(C("p_partkey").alias("ref_id")), "ref_id", "left_semi").select("source_id", "ref_id")


@op("PL_17_weak_labels", "works", sql="SELECT work_id, CASE WHEN cited_by_count >= 80 AND lang = 'en' THEN 1 WHEN cited_by_count < 10 AND source_count = 0 THEN 0 END y FROM works")
def _(works):
    return works.select("work_id", F.when((C("cited_by_count") >= 80) & (C("lang") == "en"), 1).when((C("cited_by_count") < 10) & (C("source_count") == 0), 0).alias("y"))


@op("PL_21_boundary_cases", "works", sql="SELECT work_id, abs(cited_by_count - 50) d FROM works ORDER BY d, work_id LIMIT 20")
def _(works):
    return works.select("work_id", F.abs(C("cited_by_count") - 50).alias("d")).orderBy("d", "work_id").limit(20)


@op("PL_22_agreement", "works", "labels", sql="SELECT cited_by_count >= 50 AS decision, quality, count(*) n FROM works JOIN labels ON doc_id = work_id GROUP BY 1, 2")
def _(works, labels):
    return works.join(labels, C("doc_id") == C("work_id")).groupBy((C("cited_by_count") >= 50).alias("decision"), "quality").agg(F.count(F.lit(1)).alias("n"))


_WORDS = r"coalesce(trim(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9 ]', ' ', 'g'), '\s+', ' ', 'g')), '')"


@op("LX_07_near_duplicates", "works", sql=f"""WITH k AS (SELECT work_id, substr({_WORDS.format(c="abstract")}, 1, 200) s, length(abstract) c, {_WORDS.format(c="substr(title, 1, 24)")} t FROM works),
a AS (SELECT s, min(work_id) f FROM k WHERE c >= 50 AND s <> '' GROUP BY 1 HAVING count(*) >= 2), u AS (SELECT t, s, count(*) n, min(work_id) f FROM k WHERE length(t) >= 10 GROUP BY 1, 2),
v AS (SELECT t, min(f) f FROM u GROUP BY 1 HAVING sum(n) >= 2 AND coalesce(sum(n) FILTER (WHERE s <> '' AND n > 1), 0) >= 0.5 * sum(n)),
m AS (SELECT work_id, CASE WHEN c >= 50 THEN a.f END x, v.f y FROM k LEFT JOIN a USING (s) LEFT JOIN v USING (t) WHERE (a.f IS NOT NULL AND c >= 50) OR v.f IS NOT NULL),
e AS (SELECT DISTINCT x, y FROM m WHERE x <> y), h AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
l AS (WITH RECURSIVE r AS (SELECT DISTINCT coalesce(x, y) node, coalesce(x, y) got FROM m UNION SELECT node, h.y FROM r JOIN h ON h.x = got) SELECT node, min(got) label FROM r GROUP BY 1),
w AS (SELECT work_id, label FROM m JOIN l ON node = coalesce(x, y)), g AS (SELECT label, row_number() OVER (ORDER BY count(*) DESC, min(work_id)) g FROM w GROUP BY 1 HAVING count(*) >= 2)
SELECT work_id, g AS "group" FROM w JOIN g USING (label)""")
def _(works):
    """Titles are cut to 24 characters here, so that some of them join what abstracts keep apart."""
    return O.near_duplicate_groups(works.withColumn("title", F.substring("title", 1, 24)), least=2).withColumn("group", C("group").cast("long"))


@op("JN_06_internal_edges", "inner_edges", "orders", sql="SELECT source_id, ref_id FROM inner_edges WHERE source_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND ref_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def _(edges, orders):
    ids = orders.where("o_orderstatus = 'F'").select("o_orderkey")
    return edges.join(ids.withColumnRenamed("o_orderkey", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("o_orderkey", "ref_id"), "ref_id", "left_semi").select("source_id", "ref_id")


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
