"""Queries of file round trips, source projections, single detectors, further null models, axis search and cross-snapshot
clustering. Files go to the folder that ``spark.checkpoint.dir`` names, as all intermediate tables do."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from quillspark.functions import kernels as KN
from quillspark.functions import text as T
from quillspark.operators import analysis as A
from quillspark.operators import pieces as P
from quillspark.operators import relational as R
from quillspark.session import saved, shared
from quillspark.sources import catalogs as S
from quillspark.sources import sinks as K

from . import kernels, proxy
from .analysis import window_edges
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


def _place(df, name: str) -> str:
    return f"{shared(df.sparkSession)}/files/{uuid.uuid4().hex}/{name}"


# Scans and sinks: each writes a table in the format and gives what a reader sees.


@op("SRC_01_csv_catalog", "works", sql="SELECT source_id, coalesce(first_author, '') first_author, CAST(year AS VARCHAR) AS year, 'grey' AS catalog FROM works")
def _(works):
    path = _place(works, "grey_works.csv")
    rows = works.select(*[(C(c).cast("string") if c in works.columns else F.lit(None).cast("string")).alias(c) for c in S.WORK_COLUMNS])
    rows.write.csv(path, header=True, quoteAll=True, escape='"')
    return S.read_csv(works.sparkSession, path).select("source_id", "first_author", "year", "catalog")


@op("SRC_06_pool_scan", "works", sql="SELECT work_id, title, year FROM works")
def _(works):
    """Gzipped JSON lines with lines among them that are no records."""
    path = _place(works, "pool")
    lines = works.select(F.to_json(F.struct("work_id", "title", "year")).alias("value")).unionByName(works.select(F.concat(F.lit("{broken "), "source").alias("value")))
    lines.write.option("compression", "gzip").text(path)
    return S.read_pool(works.sparkSession, path, "work_id long, title string, year int")


@op("SRC_24_json_lines", "works", sql="SELECT work_id, lang, n FROM works, (SELECT unnest([1, 2]) n)")
def _(works):
    path = _place(works, "lines")
    for n in (1, 2):
        K.append_json(works.select("work_id", "lang", F.lit(n).alias("n")), path)
    return works.sparkSession.read.json(path, schema="work_id long, lang string, n int")


@op("SNK_01_csv_export", "works", sql="SELECT CAST(work_id AS VARCHAR) work_id, source, CAST(cited_by_count AS VARCHAR) cited_by_count FROM works")
def _(works):
    path = _place(works, "export")
    K.write_csv(works.select("work_id", "source", "cited_by_count"), path)
    return works.sparkSession.read.csv(path, header=True, schema="work_id string, source string, cited_by_count string")


@op("SNK_02_vectors", "embeddings", sql="SELECT vec_id, len(embedding) dims, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings")
def _(embeddings):
    path = _place(embeddings, "vectors")
    K.write_table(embeddings.select("vec_id", "embedding"), path)
    v = embeddings.sparkSession.read.parquet(path)
    return v.select("vec_id", F.size("embedding").cast("long").alias("dims"), r6(C("embedding")[0].cast("double"), "first"))


@op("SNK_03_hand_off", "edges", sql="SELECT source_id, count(*) n FROM edges GROUP BY 1")
def _(edges):
    return saved(edges).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))


@op("SNK_04_run_report", "works", sql="SELECT 'merge' run, count(*) \"rows\", count(*) FILTER (WHERE doi IS NULL) missing, max(year) last_year FROM works")
def _(works):
    seen = K.write_with_report(works.select("work_id", "doi", "year"), _place(works, "report"), "merge", missing=F.count(F.when(C("doi").isNull(), 1)), last_year=F.max("year"))
    return works.sparkSession.createDataFrame([tuple(seen[k] for k in ("run", "rows", "missing", "last_year"))], "run string, rows long, missing long, last_year int")


@op("SNK_05_resume", "works", sql="SELECT work_id, md5(title) h FROM works")
def _(works):
    """A second run works only on keys that the first one's checkpoint lacks; both together have every key once."""
    path = _place(works, "checkpoint")
    result = lambda df: df.select("work_id", F.md5("title").alias("h"))
    K.append_json(result(works.where(F.pmod(F.xxhash64("work_id"), F.lit(2)) == 0)), path)
    done = works.sparkSession.read.json(path, schema="work_id long, h string")
    return done.unionByName(result(works.join(done.select("work_id"), "work_id", "left_anti")))


@op("SNK_07_variables", "works", sql="SELECT 'last_year: ' || max(year) || chr(10) || 'works: ' || count(*) || chr(10) AS yaml FROM works")
def _(works):
    n = works.agg(F.count(F.lit(1)).alias("works"), F.max("year").alias("last_year")).first().asDict()
    return works.sparkSession.createDataFrame([(K.variables(n),)], "yaml string")


# Projections of single sources.


@op("SRC_17_grey_record", "works", sql="SELECT source_id, lower('10.1/g' || work_id) doi, title, 'A' first_author, 'A ; B' all_authors, CAST(year AS VARCHAR) AS year, 'World Bank' journal, lang AS language, source || ' ; ' || lang keywords FROM works")
def _(works):
    v = lambda *xs: F.array(*[F.struct(x.alias("value")) for x in xs])
    meta = F.create_map(F.lit("dc.title"), v(C("title")), F.lit("dc.contributor.author"), v(F.lit("A"), F.lit("B")), F.lit("dc.identifier.doi"), v(F.concat(F.lit("https://doi.org/10.1/G"), C("work_id").cast("string"))), F.lit("dc.language.iso"), v(C("lang")), F.lit("dc.subject"), v(C("source"), C("lang")))
    flat = F.array(*[F.struct(F.lit(k).alias("key"), x.alias("value")) for k, x in (("dc.title", C("title")), ("dc.contributor.author", F.lit("A")), ("dc.contributor.author", F.lit("B")), ("dc.identifier.doi", F.concat(F.lit("10.1/g"), C("work_id").cast("string"))), ("dc.language.iso", C("lang")), ("dc.subject", C("source")), ("dc.subject", C("lang")))])
    item = works.select(C("source_id").alias("uuid"), C("year").cast("string").alias("year"), F.when(C("work_id") % 2 == 0, F.to_json(meta)).otherwise(F.to_json(flat)).alias("metadata"))
    return item.select(*S.grey_work(C("metadata"), C("year"))).select("source_id", "doi", "title", "first_author", "all_authors", "year", "journal", "language", "keywords")


@op("SRC_19_paper_record", "works", sql="SELECT source_id, lower('10.1/s' || work_id) doi, coalesce(first_author, '') first_author, concat_ws(' ; ', coalesce(first_author, ''), 'Second') all_authors, source || ' ; ' || lang categories, CAST(cited_by_count AS VARCHAR) cited_by_count FROM works")
def _(works):
    fields = F.array(F.struct(C("lang").alias("category"), F.lit("s2-fos-model").alias("source")), F.struct(F.lit("other").alias("category"), F.lit("external").alias("source")))
    r = works.select(C("source_id").alias("paperId"), "title", "year", C("venue"), "abstract", C("cited_by_count").alias("citationCount"), F.array(F.struct(C("first_author").alias("name")), F.struct(F.lit("Second").alias("name"))).alias("authors"), F.struct(F.concat(F.lit("10.1/S"), C("work_id").cast("string")).alias("DOI")).alias("externalIds"), F.array("source").alias("fieldsOfStudy"), fields.alias("s2FieldsOfStudy"))
    return r.select(*S.paper_work()).select("source_id", "doi", "first_author", "all_authors", "categories", "cited_by_count")


@op("SRC_20_entry_record", "works", sql="SELECT CAST(work_id AS VARCHAR) source_id, CAST(year AS VARCHAR) AS year, venue journal, CASE WHEN work_id % 2 = 0 THEN lang ELSE '' END affiliations FROM works")
def _(works):
    """Entries whose field names hold colons, as JSON maps."""
    place = F.when(C("work_id") % 2 == 0, F.array(F.struct(C("lang").alias("affilname"))))
    e = works.select(F.to_json(F.struct(F.concat(F.lit("SCOPUS_ID:"), C("work_id").cast("string")).alias("dc:identifier"), C("title").alias("dc:title"), F.concat(C("year").cast("string"), F.lit("-03-01")).alias("prism:coverDate"), C("venue").alias("prism:publicationName"), place.alias("affiliation"))).alias("entry"))
    return e.select(*S.entry_work(C("entry"))).select("source_id", "year", "journal", "affiliations")


@op("SRC_23_bibliography", "works", sql="SELECT 'k' || work_id bib_key, CASE WHEN work_id % 3 = 0 THEN NULL ELSE year END AS bib_year, lower('10.1/b' || work_id) bib_doi, 'article' bib_type FROM works")
def _(works):
    id_ = C("work_id").cast("string")
    rec = F.concat(F.lit("@article{k"), id_, F.lit(",\n title = {T},\n doi = {10.1/B"), id_, F.lit("},\n year = {"), F.when(C("work_id") % 3 == 0, "in press").otherwise(C("year").cast("string")), F.lit("}\n}\n"))
    return S.bibliography(S.bibtex_entries(works.select(rec.alias("t")), C("t"))).select("bib_key", "bib_year", "bib_doi", "bib_type")


@op("FN_50_query_slug", "works", sql=r"SELECT work_id, trim(regexp_replace(lower(source || ' & ' || lang || '!'), '[^a-z0-9_]', '_', 'g'), '_') slug, 'default.search:\"' || source || '\",publication_year:>' || (year - 1) || ',publication_year:<' || (year + 2) AS filter FROM works".replace('\\"', '"'))
def _(works):
    return works.select("work_id", T.query_slug(F.concat("source", F.lit(" & "), "lang", F.lit("!"))).alias("slug"), T.search_filter(C("source"), C("year"), C("year") + 1).alias("filter"))


# Single detectors.

_BREAKS = "year_series string, detector string, params string, break_years string"


def _detected(papers, name: str, found):
    """Breaks of the count series of every kind; a series is one row a year."""
    def one(key, g):
        g = g.sort_values("year")
        y, years = g["v"].to_numpy(float), g["year"].to_numpy()
        y = (y - y.mean()) / (y.std() or 1.0)
        return pd.DataFrame([(key[0], name, p, ";".join(str(int(years[i])) for i in b)) for p, b in found(y)], columns=["year_series", "detector", "params", "break_years"])

    s = papers.groupBy("kind", "year").agg(F.avg("price").alias("v"))
    return s.groupBy(C("kind").alias("year_series")).applyInPandas(one, _BREAKS)


op("BK_06_pelt", "papers")(lambda papers: _detected(papers, "pelt", lambda y: [(f"pen={p:g}", KN.pelt(y, p)) for p in (1.0, 3.0, 5.0)]))
op("BK_07_dynp", "papers")(lambda papers: _detected(papers, "dynp", lambda y: [(f"n={n}", KN.dynp(y, n)) for n in (1, 2, 3)]))
op("BK_08_kernel_cpd", "papers")(lambda papers: _detected(papers, "kernel_cpd", lambda y: [(f"n={n}", KN.dynp(y, n, kernel=True)) for n in (1, 2, 3)]))


@op("BK_04_combined_support", "papers", sql="""WITH g AS (SELECT kind, year, CAST(count(*) AS DOUBLE) n, avg(price) p FROM papers GROUP BY 1, 2), v AS (SELECT 'js' m, kind, year, n v FROM g UNION ALL SELECT 'cos', kind, year, p FROM g),
z AS (SELECT m, kind, year, (v - avg(v) OVER w) / nullif(stddev_samp(v) OVER w, 0) z FROM v WINDOW w AS (PARTITION BY m, kind)), o AS (SELECT *, lag(z) OVER w a, lead(z) OVER w b FROM z WINDOW w AS (PARTITION BY m, kind ORDER BY year)),
k AS (SELECT m, year, count(DISTINCT kind) n, avg(z) z FROM o WHERE z > 0.5 AND z > a AND z > b GROUP BY 1, 2 HAVING count(DISTINCT kind) >= 2), j AS (SELECT * FROM k WHERE m = 'js'), c AS (SELECT * FROM k WHERE m = 'cos'),
e AS (SELECT c.year cy, min(j.year) y FROM c JOIN j ON abs(c.year - j.year) <= 1 GROUP BY 1), b AS (SELECT y, arg_max(c.n, cy) n, arg_max(c.z, cy) z FROM e JOIN c ON c.year = cy GROUP BY 1),
u AS (SELECT j.year, j.n js_windows, j.z jz, coalesce(b.n, 0) cos_windows, coalesce(b.z, 0) cz, CASE WHEN b.n IS NULL THEN 'JS only' ELSE 'both' END support FROM j LEFT JOIN b ON b.y = j.year UNION ALL SELECT year, 0, 0, n, z, 'cosine only' FROM c WHERE year NOT IN (SELECT cy FROM e))
SELECT year, js_windows, round(jz, 3) js_mean_z, cos_windows, round(cz, 3) cos_mean_z, support, round(jz + cz, 3) combined_z FROM u""")
def _(papers):
    """Peaks of two measures (counts and mean prices) over their series, matched within a year: support of either or both,
    ranked by the sum of their mean z. The tables hold a row a year."""
    one = {}
    for name, x in (("js", F.count(F.lit(1))), ("cos", F.avg("price"))):
        z = R.zscore(papers.groupBy("kind", "year").agg(x.cast("double").alias("v")), ["kind"], "v")
        p = R.local_maxima(z.select("kind", "year", "z"), ["kind"], "year", "z", 0.5)
        one[name] = p.groupBy("year").agg(F.countDistinct("kind").alias(f"{name}_windows"), F.avg("z").alias(f"{name}_mean_z")).where(f"{name}_windows >= 2")
    near = one["cos"].select(C("year").alias("cy"), "cos_windows", "cos_mean_z", F.explode(F.array(C("year") - 1, C("year"), C("year") + 1)).alias("year"))
    w = R.Window.partitionBy("cy").orderBy("year")
    both = near.join(one["js"], "year").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    js = one["js"].join(both.groupBy("year").agg(F.max_by("cos_windows", "cy").alias("cos_windows"), F.max_by("cos_mean_z", "cy").alias("cos_mean_z")), "year", "left")
    rest = one["cos"].join(both.select(C("cy").alias("year")), "year", "left_anti").select("year", F.lit(0).cast("long").alias("js_windows"), F.lit(0.0).alias("js_mean_z"), "cos_windows", "cos_mean_z")
    out = js.select("year", "js_windows", "js_mean_z", "cos_windows", "cos_mean_z").unionByName(rest)
    out = out.withColumn("support", F.when(C("js_windows") == 0, "cosine only").when(C("cos_windows").isNull(), "JS only").otherwise("both")).na.fill(0)
    return out.withColumn("combined_z", F.round(C("js_mean_z") + C("cos_mean_z"), 3)).withColumns({c: F.round(c, 3) for c in ("js_mean_z", "cos_mean_z")}).orderBy(F.desc("combined_z"), "year")


# Null models whose permutations are matrix products.


@op("UN_03_kernel_permutations", "embeddings")
def _(embeddings):
    """Squared MMD against label permutations of one pooled kernel matrix."""
    return kernels.null_model(kernels.window_members(embeddings, (2, 3)), lambda g, n, seed: KN.mmd_permutations(*kernels._sides(g), n, seed), block=250)


def _lexical_null(works, statistic):
    def null(g, count, seed):
        g = g.sort_values("work_id")
        past, now, future = (kernels.dense(g.m[g.side == s].tolist()) for s in ("before", "now", "after"))
        if not len(past) or not len(future) or not len(now):
            return np.nan, []
        pool, r = np.vstack([past, future]), np.random.default_rng(seed)
        side = np.zeros((count + 1, len(pool)))
        side[0, : len(past)] = 1
        for i in range(1, count + 1):
            side[i, r.permutation(len(pool))[: len(past)]] = 1
        values = statistic(side @ pool / len(past), (1 - side) @ pool / len(future), now)
        return values[0], values[1:]

    return kernels.null_model(kernels.lexical_members(works), null, block=250)


def _shares(x):
    x = x + A.EPS
    return x / x.sum(1, keepdims=True)


def _js_rows(a, b, now):
    p, q = _shares(a), _shares(b)
    m = (p + q) / 2
    return np.sqrt(np.maximum(((p * np.log(p / m)).sum(1) + (q * np.log(q / m)).sum(1)) / 2, 0))


def _resonance_rows(a, b, now):
    d = _shares(now)
    own = (d * np.log(d)).sum(1)
    kl = lambda q: np.minimum(own[None, :] - np.log(_shares(q)) @ d.T, 50.0).mean(1)
    return kl(a) - kl(b)


op("UN_04_lexical_null", "works")(lambda works: _lexical_null(works, _js_rows))
op("UN_05_resonance_null", "works")(lambda works: _lexical_null(works, _resonance_rows))


@op("UN_09_null_G9", "inner_edges")
def _(edges):
    """Communities of the union are found once, piece by piece; permutations deal its nodes to sides, so each needs only how many
    communities have which size."""
    def null(g, count, seed):
        g = g.sort_values(["size", "before", "after"])
        return KN.community_deals(*(g[c].to_numpy() for c in ("before", "after", "size", "n")), count, seed)

    return kernels.null_model(P.communities(P.pieces(window_edges(edges))), null, block=25)


@op("UN_15_window_seeds", "papers", sql="WITH b AS (SELECT min(year) lo, max(year) hi FROM papers) SELECT CAST(y AS INT) AS anchor, CAST(w AS INT) width, CAST(42 + 100 * y + w AS INT) seed, CAST(50042 + 100 * y + w AS INT) permutation_seed FROM b, (SELECT unnest([1, 2]) w), (SELECT unnest(range(1900, 2100)) y) WHERE y >= lo + w AND y < hi - w")
def _(papers):
    m = R.windows_before_after(papers.select("year").distinct(), "year", (1, 2), 1).select("anchor", "width").distinct()
    seed = 42 + 100 * C("anchor") + C("width")
    return m.select("anchor", "width", seed.alias("seed"), (50_000 + seed).alias("permutation_seed"))


@op("UN_20_null_coverage", "papers", sql="SELECT m AS method, m NOT IN ('G3', 'G4', 'G7') has_null FROM (SELECT unnest(['S1', 'S2', 'S3', 'S4', 'L1', 'L2', 'L3', 'G1', 'G2', 'G3', 'G4', 'G5', 'G6', 'G7', 'G8', 'G9', 'C2ST_embedding', 'C2ST_lexical']) m)")
def _(papers):
    methods = ["S1", "S2", "S3", "S4", "L1", "L2", "L3", *[f"G{i}" for i in range(1, 10)], "C2ST_embedding", "C2ST_lexical"]
    d = papers.sparkSession.createDataFrame([(m,) for m in methods], "method string")
    return d.withColumn("has_null", ~C("method").isin("G3", "G4", "G7"))


# Spaces, axes and clusterings.


def _gram_space(weights, key: str, dims: int):
    """key, s: coordinates on the leading ``dims`` singular directions. The term-by-term products are summed in Spark (their
    number is that of the vocabulary squared, whatever the corpus), their eigenvectors are found on the driver."""
    terms = [r.term for r in weights.select("term").distinct().orderBy("term").collect()]
    at = {t: i for i, t in enumerate(terms)}

    def products(frames):
        """The sum of a task's term products; a document's terms come as one row."""
        m = np.zeros((len(terms), len(terms)))
        for g in frames:
            x = np.zeros((len(g), len(terms)))
            row = np.repeat(np.arange(len(g)), [len(t) for t in g.t])
            if len(row):
                np.add.at(x, (row, [at[t] for r in g.t for t in r]), np.concatenate(list(g.w)))
                m += x.T @ x
        i = np.flatnonzero(m.any(1))
        yield pd.DataFrame({"i": i, "m": list(m[i])})

    rows = weights.groupBy(key).agg(F.collect_list("term").alias("t"), F.collect_list("weight").alias("w")).select("t", "w")
    m = np.zeros((len(terms), len(terms)))
    sums = rows.mapInPandas(products, "i long, m array<double>").select("i", F.posexplode("m").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    for i, j, v in sums.toPandas().itertuples(index=False):
        m[i, j] = v
    values, v = np.linalg.eigh(m)
    v = v[:, np.argsort(-values)[:dims]]
    v = v * np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])
    table = weights.sparkSession.createDataFrame([(t, row.tolist()) for t, row in zip(terms, v, strict=True)], "term string, v array<double>")
    long = weights.join(F.broadcast(table), "term").select(key, F.posexplode("v").alias("i", "x"), "weight").groupBy(key, "i").agg(F.sum(C("x") * C("weight")).alias("x"))
    return long.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("s")), table


@op("LX_09_tfidf_svd", "works")
def _(works):
    d, _ = _gram_space(saved(A.tfidf(works, "work_id", "abstract", 20, 300)), "work_id", 100)
    return d


def _delta_bic(scores, name: str) -> float:
    """BIC of one normal distribution less that of a mixture of two."""
    v = scores.select(C(name).alias("x"), array_to_vector(F.array(name)).alias("features")).persist()
    n, var = v.agg(F.count("x"), F.var_pop("x")).first()
    two = 5 * np.log(n) - 2 * GaussianMixture(k=2, seed=1).fit(v).summary.logLikelihood
    v.unpersist()
    return float(n * (np.log(2 * np.pi * max(var, 1e-300)) + 1) + 2 * np.log(n) - two)


@op("EM_14_axis_search", "embeddings")
def _(embeddings):
    """Leading components of the vectors: variance, correlation with the axis between two labels' centroids, delta BIC."""
    long = embeddings.select("label", F.posexplode("embedding").alias("i", "x"))
    mean = lambda k: F.avg(F.when(C("label") == k, C("x").cast("double")))
    axis = long.groupBy("i").agg((mean(0) - mean(1)).alias("m")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("axis"))
    v = embeddings.crossJoin(F.broadcast(axis)).select("vec_id", A.dot("embedding", "axis").alias("seed_score"), array_to_vector("embedding").alias("features"))
    model = PCA(k=5, inputCol="features", outputCol="p").fit(v)
    p = saved(model.transform(v).select("vec_id", "seed_score", vector_to_array("p").alias("p")))
    corr = p.agg(*[F.corr(C("p")[i], "seed_score").alias(f"c{i}") for i in range(5)]).first()
    rows = [(f"emb_PC{i + 1}", float(model.explainedVariance[i]), float(corr[i]), abs(float(corr[i])), _delta_bic(p.select(C("p")[i].alias("x")), "x")) for i in range(5)]
    return embeddings.sparkSession.createDataFrame(rows, "component string, explained_variance_ratio double, corr double, abs_corr double, delta_bic double")


def _model_sample(embeddings, most: int):
    """At most ``most`` rows by seeded hash as an array: what spectral and density models are fitted on."""
    rows = embeddings.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).select("vec_id", "embedding").toPandas()
    return rows.vec_id.to_numpy(), np.array(rows.embedding.tolist(), float)


def spectral_clusters(embeddings, k: int = 6, most: int = 2_000):
    """vec_id, cluster: spectral clusters of a sample of at most ``most`` rows, every other row goes to the nearest centroid."""
    ids, x = _model_sample(embeddings, most)
    label = KN.spectral(x, k)
    centers = np.array([x[label == c].mean(0) if (label == c).any() else np.full(x.shape[1], np.inf) for c in range(k)])
    known = embeddings.sparkSession.createDataFrame(pd.DataFrame({"vec_id": ids, "own": label.astype("int32")}))

    @F.pandas_udf("int")
    def nearest(v: pd.Series) -> pd.Series:
        return pd.Series(KN.distances_or_inf(np.array(v.tolist(), float).reshape(len(v), -1), centers).argmin(1).astype("int32"))

    return embeddings.join(F.broadcast(known), "vec_id", "left").select("vec_id", F.coalesce(C("own").cast("int"), nearest("embedding")).alias("cluster"))


def density_clusters(embeddings, least: int = 10, most: int = 2_000):
    """vec_id, cluster: density clusters (-1 is noise) of a sample of at most ``most`` rows; every other row goes with its nearest
    sampled row if it is no farther from it than that row's core distance, else it is noise."""
    ids, x = _model_sample(embeddings, most)
    label, core = KN.hdbscan(x, least)
    known = embeddings.sparkSession.createDataFrame(pd.DataFrame({"vec_id": ids, "own": label.astype("int32")}))

    @F.pandas_udf("int")
    def joined(v: pd.Series) -> pd.Series:
        d = KN.distances(np.array(v.tolist(), float).reshape(len(v), -1), x)
        at = d.argmin(1)
        return pd.Series(np.where(d[np.arange(len(d)), at] <= core[at], label[at], -1).astype("int32"))

    return embeddings.join(F.broadcast(known), "vec_id", "left").select("vec_id", F.coalesce(C("own").cast("int"), joined("embedding")).alias("cluster"))


op("EM_05_spectral", "embeddings")(spectral_clusters)
op("EM_05_hdbscan", "embeddings")(density_clusters)


@op("EM_08_snapshots", "embeddings")
def _(embeddings):
    """Two snapshots (all rows; a random four fifths) clustered by the same methods; agreement on the rows both have."""
    part = saved(embeddings.where(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(5)) != 0).select("vec_id", "embedding"))

    def kmeans(d):
        v = d.select("vec_id", array_to_vector("embedding").alias("features"))
        return KMeans(k=6, seed=1).fit(v).transform(v).select("vec_id", C("prediction").alias("cluster"))

    out = None
    for name, method in (("kmeans", kmeans), ("spectral", spectral_clusters), ("hdbscan", density_clusters)):
        a, b = (saved(method(d)).withColumnRenamed("cluster", c) for d, c in ((embeddings, "a"), (part, "b")))
        both = a.join(b, "vec_id")
        d = R.rand_index(both, "a", "b").crossJoin(F.broadcast(both.agg(F.count(F.lit(1)).alias("n_shared")))).withColumn("method", F.lit(name))
        out = d if out is None else out.unionByName(d)
    return out.select("method", "ari", "n_shared")


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
