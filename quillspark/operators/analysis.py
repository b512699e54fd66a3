"""Change over time: lexical, semantic and citation divergence, graph measures, outliers, breaks, summaries."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import saved

C = F.col
EPS = 1e-10
TOKEN = r"(?U)\w\w+"


def tokens(df: DataFrame, key: str, text: str, keep: list[str] = ()) -> DataFrame:
    """A row for each token (two or more word characters, lower case)."""
    return df.select(key, *keep, F.explode(F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))).alias("term"))


def _words(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, t: the tokens of each document as one array. Rows that share a key are one document; only these are moved."""
    t = F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))
    again = saved(df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(C(key).alias("_k")))
    if again.isEmpty():
        return df.select(key, t.alias("t"))
    same = C(key).eqNullSafe(C("_k"))
    many = df.join(again, same, "left_semi").groupBy(key).agg(F.flatten(F.collect_list(t)).alias("t"))
    return df.join(again, same, "left_anti").select(key, t.alias("t")).unionByName(many)


def _cells(batch: pa.RecordBatch, index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, code, n: how often each row has each code that ``index`` gives for its tokens (none: left out)."""
    t = batch.column("t")
    code = index(t.flatten())
    row = pc.list_parent_indices(t).to_numpy(zero_copy_only=False)
    known = code.is_valid().to_numpy(zero_copy_only=False)
    code = pc.fill_null(code, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(code.max(initial=0)) + 1
    cell, n = np.unique((row.astype(np.int64) * width + code)[known], return_counts=True)
    return cell // width, cell % width, n


def vocabulary(words: DataFrame, min_df: int = 3, max_terms: int | None = 5000) -> DataFrame:
    """term, df: terms in ``min_df`` documents or more, the ``max_terms`` most frequent (ties to the earlier term)."""
    def counted(batches):
        for batch in batches:
            names = []

            def index(tokens):
                d = tokens.dictionary_encode()
                names.append(d.dictionary)
                return d.indices

            _, code, n = _cells(batch, index)
            size = len(names[0])
            df, total = np.bincount(code, minlength=size), np.bincount(code, n, size).astype(np.int64)
            yield pa.RecordBatch.from_arrays([names[0], pa.array(df, pa.int64()), pa.array(total, pa.int64())], ["term", "df", "total"])

    v = words.select("t").mapInArrow(counted, "term string, df long, total long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total")).where(C("df") >= min_df)
    return (v.orderBy(F.desc("total"), "term").limit(max_terms) if max_terms else v).select("term", "df")


def tfidf(df: DataFrame, key: str, text: str, min_df: int = 3, max_terms: int = 5000) -> DataFrame:
    """key, term, weight: sublinear tf, smooth idf, rows of unit length. Vocabulary: terms in ``min_df`` documents or more,
    the ``max_terms`` most frequent (ties to the earlier term).

    A document is weighed where it is read: only counts of terms are moved, and the vocabulary is sent to every task."""
    words = _words(df, key, text)
    n = df.count()
    known = sorted((r.term, r.df) for r in vocabulary(words, min_df, max_terms).collect())  # at most max_terms
    terms, idf = [t for t, _ in known], np.array([np.log((1 + n) / (1 + d)) + 1 for _, d in known])

    def weighed(batches):
        values = pa.array(terms, pa.string())
        for batch in (b.slice(at, 2_000) for b in batches for at in range(0, b.num_rows, 2_000)):
            row, code, tf = _cells(batch, lambda tokens: pc.index_in(tokens, values))
            w = (1 + np.log(tf)) * idf[code]
            w = w / np.sqrt(np.bincount(row, w * w, batch.num_rows))[row]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), values.take(pa.array(code)), pa.array(w, pa.float64())], [key, "term", "weight"])

    return words.mapInArrow(weighed, f"{df.select(key).schema[0].name} {df.select(key).dtypes[0][1]}, term string, weight double")


def lexical_js(weights: DataFrame, members: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Jensen-Shannon distance (natural log) between the mean vectors of the before and after side of each window, smoothed
    over the whole vocabulary: terms that neither side has all contribute the same, in closed form."""
    weights = saved(weights)
    v = weights.agg(F.countDistinct("term").alias("v"))
    sizes = members.groupBy(*by, "side").agg(F.countDistinct(key).alias("n"))
    mass = members.join(weights, key).groupBy(*by, "side", "term").agg(F.sum("weight").alias("w")).join(sizes, [*by, "side"])
    wide = mass.groupBy(*by, "term").agg(*[F.sum(F.when(C("side") == s, C("w") / C("n"))).alias(s) for s in ("before", "after")]).na.fill(0.0)
    wide = saved(wide)
    total = wide.groupBy(*by).agg(F.sum("before").alias("nb"), F.sum("after").alias("na")).crossJoin(F.broadcast(v))  # a row a window
    wide = wide.join(total, by)
    p, q = ((C(s) + EPS) / (C(n) + C("v") * EPS) for s, n in (("before", "nb"), ("after", "na")))
    wide = wide.withColumns({"p": p, "q": q, "p0": EPS / (C("nb") + C("v") * EPS), "q0": EPS / (C("na") + C("v") * EPS)})
    part = lambda a, b: (a * F.ln(2 * a / (a + b)) + b * F.ln(2 * b / (a + b))) / 2
    js = F.sum(part(C("p"), C("q"))) + (F.max("v") - F.count(F.lit(1))) * F.max(part(C("p0"), C("q0")))
    return wide.groupBy(*by).agg(F.sqrt(F.greatest(js, F.lit(0.0))).alias("value"))


def bursts(df: DataFrame, key: str, text: str, year: str, top: int = 100, z: float = 2.0, min_df: int = 3) -> DataFrame:
    """How many of the ``top`` terms burst each year: frequency per document more than ``z`` deviations (ddof 0) above the
    term's mean over years, years without it included."""
    t = tokens(df, key, text, [year])
    vocabulary = t.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("df")).where(C("df") >= min_df).orderBy(F.desc("n"), "term").limit(top)
    n = t.join(F.broadcast(vocabulary.select("term")), "term").groupBy(year, "term").agg(F.count(F.lit(1)).alias("n"))
    docs = df.groupBy(year).agg(F.count(F.lit(1)).alias("d"))
    full = docs.crossJoin(F.broadcast(vocabulary.select("term"))).join(n, [year, "term"], "left").withColumn("f", F.coalesce("n", F.lit(0)) / C("d"))
    w = Window.partitionBy("term")
    full = full.withColumn("hit", (F.stddev_pop("f").over(w) > 0) & ((C("f") - F.avg("f").over(w)) / F.stddev_pop("f").over(w) > z))
    return full.groupBy(year).agg(F.sum(C("hit").cast("int")).alias("value"))


def burst_null(df: DataFrame, key: str, text: str, year: str, top: int = 100, z: float = 2.0, min_df: int = 3, n: int = 500, rows: int = 20_000, block: int = 100) -> DataFrame:
    """year, observed, null_mean, null_std, z_score, p_value: ``bursts`` against ``n`` shuffles of the documents' years.

    Years are shuffled inside random buckets of about ``rows`` documents, whose number grows with the table (one bucket, a plain
    shuffle, up to that many). A task shuffles one bucket for one block of replicates and sends up counts by replicate, year and
    term, which are all that bursts need, so no task sees the corpus. Documents without a year take no part.
    """
    t = tokens(df, key, text)
    vocabulary = t.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("df")).where(C("df") >= min_df).orderBy(F.desc("n"), "term").limit(top)
    index = F.broadcast(vocabulary.select("term", (F.row_number().over(Window.orderBy("term")) - 1).alias("i")))
    counts = t.join(index, "term").groupBy(key, "i").agg(F.count(F.lit(1)).alias("c")).groupBy(key).agg(F.collect_list(F.struct("i", "c")).alias("m"))
    docs = saved(df.where(C(year).isNotNull()).select(key, C(year).cast("int").alias("year")).join(counts, key, "left"))
    size = docs.groupBy("year").agg(F.count(F.lit(1)).alias("d"))
    buckets = max(1, -(-docs.count() // rows))

    def one(group, g):
        g = g.sort_values(key)
        years, y = np.unique(g.year.to_numpy(), return_inverse=True)
        m = [() if v is None else v for v in g.m]
        doc = np.repeat(np.arange(len(g)), [len(v) for v in m])
        term, c = (np.array([x[f] for v in m for x in v], np.int64) for f in ("i", "c"))
        out = []
        for rep in range(group[1] * block, min(n, (group[1] + 1) * block)):
            r = np.random.default_rng([rep, group[0]])
            out.append(np.bincount(y[r.permutation(len(y))][doc] * top + term, c, len(years) * top))
        at = np.arange(len(years) * top)
        f = pd.DataFrame({"rep": np.repeat(np.arange(len(out)) + group[1] * block, len(at)), "year": np.tile(years[at // top], len(out)), "i": np.tile(at % top, len(out)), "c": np.concatenate(out).astype(np.int64)})
        return f[f.c > 0]

    bucket = F.pmod(F.xxhash64(key, F.lit("bucket")), F.lit(buckets)).alias("bucket")
    dealt = docs.select(key, "year", "m", bucket, F.explode(F.sequence(F.lit(0), F.lit(-(-n // block) - 1))).alias("block"))
    dealt = dealt.groupBy("bucket", "block").applyInPandas(one, "rep long, year int, i int, c long")
    seen = docs.where("m is not null").select("year", F.inline("m")).select(F.lit(-1).cast("long").alias("rep"), "year", C("i").cast("int").alias("i"), C("c").cast("long").alias("c"))
    f = dealt.unionByName(seen).groupBy("rep", "year", "i").agg(F.sum("c").alias("c")).join(F.broadcast(size), "year").withColumn("f", C("c") / C("d"))
    # years in which a term is absent count as zeros: sums over present years and the number of all years give its deviation
    ny = size.agg(F.count(F.lit(1)).alias("ny"))
    s = f.groupBy("rep", "i").agg(F.collect_list(F.struct("year", "f")).alias("l")).crossJoin(F.broadcast(ny))
    total = lambda g: F.aggregate("l", F.lit(0.0), lambda a, x: a + g(x["f"]))
    s = s.withColumn("mean", total(lambda x: x) / C("ny"))
    s = s.withColumn("sd", F.sqrt((total(lambda x: (x - C("mean")) * (x - C("mean"))) + (C("ny") - F.size("l")) * C("mean") * C("mean")) / C("ny")))
    hits = s.where("sd > 0").select("rep", "mean", "sd", F.inline("l")).where((C("f") - C("mean")) / C("sd") > z).groupBy("rep", "year").agg(F.count(F.lit(1)).alias("v"))
    # replicates without a burst in a year have no row: they count as zeros
    seen = hits.where("rep = -1").select("year", C("v").alias("observed"))
    d = size.select("year").join(seen, "year", "left").select("year", F.coalesce("observed", F.lit(0)).alias("observed"))
    d = d.join(hits.where("rep >= 0").select("year", "v"), "year", "left").groupBy("year").agg(F.max("observed").alias("observed"), F.coalesce(F.sum("v"), F.lit(0)).alias("s1"), F.coalesce(F.sum(C("v") * C("v")), F.lit(0)).alias("s2"), F.count("v").alias("k"), F.count(F.when(C("v") >= C("observed"), 1)).alias("above"))
    d = d.select("year", C("observed").cast("double").alias("observed"), (C("s1") / n).alias("null_mean"), F.sqrt(F.greatest(C("s2") / n - C("s1") * C("s1") / (n * n), F.lit(0.0))).alias("null_std"), ((C("above") + F.when(C("observed") <= 0, n - C("k")).otherwise(0)) / n).alias("p_value"))
    return d.withColumn("z_score", F.when(C("null_std") > 0, (C("observed") - C("null_mean")) / C("null_std")).otherwise(0.0))


def log_odds(counts: DataFrame, before: str, after: str) -> DataFrame:
    """Log odds of each term after against before, with the corpus as Dirichlet prior of the vocabulary's size."""
    counts = saved(counts)
    d = counts.crossJoin(F.broadcast(counts.agg(F.sum(before).alias("nb"), F.sum(after).alias("na"), F.count(F.lit(1)).alias("a0"))))
    alpha = C("a0") * (C(before) + C(after)) / (C("nb") + C("na"))
    one = lambda f, n: F.ln((C(f) + alpha) / (C(n) + C("a0") - C(f) - alpha))
    return d.withColumn("log_odds", one(after, "na") - one(before, "nb")).drop("nb", "na", "a0")


def age_shift(edges: DataFrame, least: int = 3) -> DataFrame:
    """Median year of references for each citing year, null below ``least`` references."""
    d = edges.groupBy("source_year").agg(F.count("ref_year").alias("n"), F.median("ref_year").alias("m"))
    return d.select(C("source_year").alias("year"), F.when(C("n") >= least, C("m")).alias("value"))


def degree_entropy(window_edges: DataFrame, by: list[str]) -> DataFrame:
    """Shannon entropy (natural log) of the distribution of positive in-degrees; null below three cited works."""
    k = window_edges.select(*by, "source_id", "ref_id").distinct().groupBy(*by, "ref_id").agg(F.count(F.lit(1)).alias("k"))
    n = k.groupBy(*by, "k").agg(F.count(F.lit(1)).alias("n"))
    d = n.groupBy(*by).agg(F.sum("n").alias("t"), F.sum(C("n") * F.ln("n")).alias("nl"))
    return d.select(*by, F.when(C("t") >= 3, F.ln("t") - C("nl") / C("t")).alias("entropy"))


def disruption(refs: DataFrame, inner: DataFrame, works: DataFrame, cells: int = 4_000_000, rows: int = 2_000_000) -> DataFrame:
    """Mean (n_i - n_j) / (n_i + n_j + n_k) by year. n_j of a work's citers also cite one of its references, n_i don't; n_k works
    cite its references but not itself. ``refs``: all references; ``inner``: edges between works; ``works``: id, year.

    A work gets the list of citers of each of its references whole, not a row for each; its lists and its own citers are
    compared as sets. Lists are dealt by citer so that a work's in one part hold about ``cells`` numbers at most."""
    e = refs.select("source_id", "ref_id").withColumn("f", F.lit(3))
    if inner is not refs:
        e = e.withColumn("f", F.lit(1)).unionByName(inner.select("source_id", "ref_id", F.lit(2).alias("f")))
    e = saved(e.where("source_id is not null and ref_id is not null"))
    top = lambda c, f: e.where(C("f").bitwiseAND(f) > 0).groupBy(c).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    (most, total), cited = top("source_id", 1), max(top("ref_id", f)[0] or 0 for f in ((3,) if inner is refs else (1, 2)))
    parts = max(1, -(-(most or 0) * cited // cells))
    spread = max(int(e.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(total or 0) // rows))
    by_ref = e.repartition(spread, "ref_id").groupBy("ref_id", "source_id").agg(F.bit_or("f").alias("f"))
    part = [F.pmod(F.xxhash64("source_id"), F.lit(parts)).alias("part")] if parts > 1 else []
    by = ["id", "part"] if parts > 1 else ["id"]
    held = lambda f, name: F.collect_list(F.when(C("f").bitwiseAND(f) > 0, C("source_id"))).alias(name)
    kinds = [("l", 3)] if inner is refs else [("l", 1), ("m", 2)]  # citers by refs, by inner
    lists = by_ref.groupBy("ref_id", *part).agg(*[held(f, name) for name, f in kinds])
    own = by_ref.where(C("f").bitwiseAND(1) > 0).select(C("source_id").alias("id"), "ref_id")
    near = own.join(lists, "ref_id").repartition(spread, "id").groupBy(*by).agg(*[F.array_distinct(F.flatten(F.collect_list(name))).alias(name) for name, _ in kinds])
    cites = lists.select(C("ref_id").alias("id"), *by[1:], C(kinds[-1][0]).alias("c")).where(F.size("c") > 0)
    both = near.join(cites, by, "full")
    none = F.array().cast(lists.schema["l"].dataType)
    l, m, c = (F.coalesce(name, none) for name in ("l", kinds[-1][0], "c"))
    counts = both.select("id", F.size(c).alias("c"), F.size(F.array_intersect(l, c)).alias("j"), F.size(F.array_except(m, c)).alias("k"))
    counts = counts.groupBy("id").agg(F.sum("c").alias("c"), F.sum("j").alias("n_j"), F.sum("k").alias("n_k"))
    d = works.join(counts, "id", "left").na.fill(0, ["c", "n_j", "n_k"])
    n_i = C("c") - C("n_j")
    return d.where("c + n_k > 0").groupBy("year").agg(F.avg((n_i - C("n_j")) / (C("c") + C("n_k"))).alias("value"))


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def centroid(df: DataFrame, by: list[str], vector: str) -> DataFrame:
    """Mean vector of each group: long form with partial sums, put together again by position."""
    long = df.select(*by, F.posexplode(vector).alias("i", "x")).groupBy(*by, "i").agg(F.avg(C("x").cast("double")).alias("m"))
    return long.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def semantic_outliers(df: DataFrame, key: str, vector: str, sigma: float = 2.0) -> DataFrame:
    """key, distance, outlier: cosine distance to the mean of raw vectors above its mean by ``sigma`` deviations (ddof 0)."""
    d = df.crossJoin(F.broadcast(centroid(df, [], vector)))
    d = d.select(key, (1 - dot(vector, "centroid") / (F.nullif(norm(vector), F.lit(0.0)) * F.greatest(norm("centroid"), F.lit(1e-10)))).alias("distance"))
    d = d.withColumn("distance", F.coalesce("distance", F.lit(1.0)))
    level = d.agg((F.avg("distance") + sigma * F.stddev_pop("distance")).alias("level"))
    return d.crossJoin(F.broadcast(level)).select(key, "distance", (C("distance") > C("level")).alias("outlier"))


def analytical_null(n_before: Column, n_after: Column) -> Column:
    """Standard deviation of the AUC under no difference; its mean is 0.5."""
    return F.sqrt((n_before + n_after + 1) / (12 * n_before * n_after))


def convergence(breaks: DataFrame, tolerance: int = 1) -> DataFrame:
    """How many break rows (method, channel, break_years) detect each candidate year within ``tolerance``."""
    rows = breaks.withColumn("row", F.monotonically_increasing_id()).withColumn("y", F.explode(F.filter(F.split("break_years", ";"), lambda s: F.trim(s) != ""))).withColumn("y", F.floor(F.try_to_number(F.trim("y"), F.lit("9999")).cast("double")).cast("int"))
    near = rows.withColumn("year", F.explode(F.sequence(C("y") - tolerance, C("y") + tolerance))).select("row", "method", "channel", "year").distinct()
    hit = near.join(rows.select(C("y").alias("year")).distinct(), "year")
    total = breaks.agg(F.count(F.lit(1)).alias("all"))
    n = [F.count(F.when(C("channel") == c, 1)).alias(f"n_{c}") for c in ("semantic", "lexical", "citation")]
    out = hit.groupBy("year").agg(*n, F.array_join(F.array_sort(F.collect_set("method")), ";").alias("methods_detecting"))
    out = out.withColumn("n_total", C("n_semantic") + C("n_lexical") + C("n_citation")).crossJoin(F.broadcast(total))
    return out.withColumn("pct_total", F.round(C("n_total") / C("all"), 4)).drop("all")


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """node, rank. Edges source_id -> ref_id; the mass of nodes without references is spread evenly.

    Nodes without references give their rank to all nodes alike. Since that adds the same to each, it is left out of the rounds
    and made up for by scaling the ranks to 1 at the end, so a round is one join and one sum by target. Edges and nodes are
    partitioned by node once and kept. Ranks are written to the shared folder every few rounds, which cuts lineage and outlives
    executors.
    """
    e = edges.select("source_id", "ref_id").distinct()
    out = e.groupBy(C("source_id").alias("node")).agg(F.count(F.lit(1)).alias("out"))
    nodes = e.select(C("source_id").alias("node")).unionByName(e.select(C("ref_id").alias("node"))).distinct()
    base = saved(nodes.join(out, "node", "left"))
    n = base.count()
    links = e.withColumnRenamed("source_id", "node").repartition("node").persist()
    base = base.repartition("node").persist()
    ranks = base.select("node", "out", F.lit(1.0 / max(n, 1)).alias("rank"))
    for i in range(rounds):
        given = ranks.where("out is not null").join(links, "node").groupBy(C("ref_id").alias("node")).agg(F.sum(C("rank") / C("out")).alias("in"))
        ranks = base.join(given, "node", "left").select("node", "out", ((1 - damping) / max(n, 1) + damping * F.coalesce("in", F.lit(0.0))).alias("rank"))
        if i % 5 == 4 or i == rounds - 1:
            ranks = saved(ranks)
    links.unpersist()
    base.unpersist()
    ranks = ranks.crossJoin(F.broadcast(ranks.agg(F.sum("rank").alias("total")))).withColumn("rank", C("rank") / C("total"))
    return ranks.select("node", "rank")


def novelty(weights: DataFrame, works: DataFrame, members: DataFrame, key: str, year: str, clip: float = 50.0) -> DataFrame:
    """anchor, width, novelty, transience, resonance: mean over the anchor year's documents of the clipped KL divergence from the
    mean vector of the years before and after, smoothed over the whole vocabulary.

    Terms that a document lacks all have one probability, so their part needs only the window's sum of logarithms: present
    terms are joined, absent ones are never written out.
    """
    weights = saved(weights)
    v = weights.agg(F.countDistinct("term").cast("double").alias("v"))
    n = members.groupBy("anchor", "width", "side").agg(F.countDistinct(key).alias("n"))
    m = members.join(weights, key).groupBy("anchor", "width", "side", "term").agg(F.sum("weight").alias("w")).join(n, ["anchor", "width", "side"]).withColumn("m", C("w") / C("n"))
    total = Window.partitionBy("anchor", "width", "side")
    m = m.crossJoin(F.broadcast(v)).withColumn("s", F.sum("m").over(total) + C("v") * EPS)
    q = saved(m.select("anchor", "width", "side", "term", "v", "s", ((C("m") + EPS) / C("s")).alias("q")))
    all_ = q.groupBy("anchor", "width", "side").agg(F.max("v").alias("v"), (EPS / F.max("s")).alias("q0"), (F.sum(F.ln("q")) + (F.max("v") - F.count(F.lit(1))) * F.ln(EPS / F.max("s"))).alias("logs"))
    own = works.select(key, C(year).alias("anchor")).join(weights, key)
    own = own.withColumn("sx", F.sum("weight").over(Window.partitionBy(key)))
    d = own.join(all_, "anchor").join(q.select("anchor", "width", "side", "term", "q"), ["anchor", "width", "side", "term"], "left").withColumn("q", F.coalesce("q", "q0"))
    d = d.withColumn("z", C("sx") + C("v") * EPS).withColumn("p", (C("weight") + EPS) / C("z")).withColumn("p0", EPS / C("z"))
    kl = F.sum(C("p") * F.ln(C("p") / C("q")) - C("p0") * F.ln(C("p0") / C("q"))) + F.max(C("p0") * (C("v") * F.ln("p0") - C("logs")))
    d = d.groupBy("anchor", "width", "side", key).agg(F.least(kl, F.lit(clip)).alias("kl"))
    d = d.groupBy("anchor", "width").agg(F.avg(F.when(C("side") == "before", C("kl"))).alias("novelty"), F.avg(F.when(C("side") == "after", C("kl"))).alias("transience"))
    return d.withColumn("resonance", C("novelty") - C("transience"))


def isolation(queries: DataFrame, reference: DataFrame, key: str, vector: str, k: int, query_rows: int = 2_048, reference_rows: int = 16_384) -> DataFrame:
    """key, score: mean cosine distance of each query to its ``k`` nearest reference vectors, of all of them.

    Both sides are dealt into blocks of about the stated rows. A task compares one block with another in slices and gives
    the ``k`` least distances of each query there; the least of these count. No reference vectors, no rows.
    """
    n_q, n_r = (max(1, -(-d.count() // rows)) for d, rows in ((queries, query_rows), (reference, reference_rows)))
    block = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select(key, vector, block(n_q).alias("qb")).withColumn("rb", every(n_r))
    r = reference.select(vector, block(n_r).alias("rb")).withColumn("qb", every(n_q))

    def unit(v):
        x = np.array(v.tolist(), float).reshape(len(v), -1)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def least(a, b):
        if not len(a) or not len(b):
            return pd.DataFrame({key: a[key].head(0), "least": pd.Series(dtype=object)})
        x, y, out = unit(a[vector]), unit(b[vector]), []
        for at in range(0, len(x), 256):
            d = 1 - x[at : at + 256] @ y.T
            out += list(np.partition(d, k - 1, axis=1)[:, :k] if d.shape[1] > k else d)
        return pd.DataFrame({key: a[key], "least": out})

    kind = dict(queries.dtypes)[key]
    part = q.groupBy("qb", "rb").cogroup(r.groupBy("qb", "rb")).applyInPandas(least, f"{key} {kind}, least array<double>")
    best = part.groupBy(key).agg(F.slice(F.sort_array(F.flatten(F.collect_list("least"))), 1, k).alias("d"))
    return best.select(key, (F.aggregate("d", F.lit(0.0), lambda a, x: a + x) / F.size("d")).alias("score"))
