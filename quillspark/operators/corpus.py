"""Corpus building: merge, enrichment, quality flags, protection, filter, reference matching, near-duplicate groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import similarity as S
from quillspark.functions import text as T
from quillspark.operators.components import components
from quillspark.operators.relational import numbered
from quillspark.session import saved

C = F.col


def merge_works(works: DataFrame, rank: Column) -> DataFrame:
    """Two passes: by normalised DOI, then rows without one by title and year. Empty titles go in the second."""
    d = works.withColumn("doi_norm", T.normalize_doi(C("doi"))).withColumn("rank", rank)
    key = F.when(C("doi_norm") != "", F.concat(F.lit("d:"), "doi_norm")).when(T.normalize_title(C("title")) != "", F.concat(F.lit("t:"), T.normalize_title(C("title")), F.lit("|"), C("year").cast("string")))
    d = d.withColumn("key", key).where(C("key").isNotNull())
    filled = lambda c: F.min_by(F.when(F.coalesce(F.trim(c), F.lit("")) != "", C(c)), F.when(F.coalesce(F.trim(c), F.lit("")) != "", C("rank")))
    return d.groupBy("key").agg(filled("title").alias("title"), filled("first_author").alias("first_author"), F.max("cited_by_count").alias("cited_by_count"), F.countDistinct("source").alias("source_count"))


def fill_from(df: DataFrame, cache: DataFrame, key: str, column: str) -> DataFrame:
    """Missing values of a column filled from a key -> value table; later rows of the cache are not looked at twice."""
    c = cache.where(~T.is_missing(C(column))).dropDuplicates([key]).select(key, C(column).alias("_v"))
    return df.join(c, key, "left").withColumn(column, F.when(T.is_missing(C(column)), C("_v")).otherwise(C(column))).drop("_v")


def crossfill_longest(df: DataFrame, key: str, column: str, row_id: str) -> DataFrame:
    """Missing values filled with the longest value that rows of the same key have, the first of equals."""
    best = df.where(~T.is_missing(C(column)) & (C(key) != "")).groupBy(key).agg(F.max_by(column, F.struct(F.length(column), -C(row_id))).alias("_v"))
    return df.join(best, key, "left").withColumn(column, F.when(T.is_missing(C(column)), C("_v")).otherwise(C(column))).drop("_v")


def flag_missing_metadata(safe: list[str]) -> Column:
    blank = lambda c: F.coalesce(F.trim(C(c).cast("string")), F.lit("")).isin("", "nan")
    return blank("title") | ((blank("first_author") | blank("year")) & ~T.any_contains(F.lower("title"), safe))


def flag_no_abstract(safe: list[str], least: int = 50) -> Column:
    return ~(F.length(F.coalesce(F.trim("abstract"), F.lit(""))) > least) & ~T.any_contains(F.lower("title"), safe)


def flag_title_blacklist(noise: list[str], safe: list[str], exact: list[str] = ()) -> Column:
    t = F.lower(F.trim(F.coalesce("title", F.lit(""))))
    out = T.any_contains(t, noise) & ~T.any_contains(t, safe)
    return out | t.isin(*exact) if exact else out


def flag_isolated(works: DataFrame, edges: DataFrame, key: str, max_year: int) -> DataFrame:
    """``isolated``: an old work that neither cites nor is cited."""
    ends = edges.select(C("source_id").alias(key)).unionByName(edges.select(C("ref_id").alias(key))).where(C(key).isNotNull()).distinct().withColumn("_in", F.lit(True))
    return works.join(ends, key, "left").withColumn("isolated", F.coalesce((C("year") <= max_year) & C("_in").isNull() & C(key).isNotNull(), F.lit(False))).drop("_in")


def protection(min_cited: int, min_sources: int, cited: Column) -> Column:
    """Reasons in order, joined; empty for works that have none."""
    return F.concat_ws(
        "; ",
        F.when(C("cited_by_count") >= min_cited, F.concat(F.lit("cited_by="), C("cited_by_count").cast("string"))),
        F.when(C("source_count") >= min_sources, F.concat(F.lit("multi_source="), C("source_count").cast("string"))),
        F.when(cited, "cited_in_corpus"),
        F.when(C("from_teaching") == 1, "from_teaching"),
    )


def flag_text(flags: dict[str, Column]) -> Column:
    return F.concat_ws("|", *[F.when(c, n) for n, c in flags.items()])


def apply_filter(works: DataFrame, flagged: Column, protected: Column, year_floor: int, doi: str = "doi_norm") -> DataFrame:
    """``action``: keep, remove or deduped. Flags remove what is not protected, the year floor removes in any case; DOIs that
    grey works share are placeholders and cleared; of kept works with one DOI the most cited stays."""
    d = works.withColumn("action", F.when((flagged & ~protected) | F.coalesce(C("year") < year_floor, F.lit(False)), "remove").otherwise("keep"))
    shared = d.where("action = 'keep' and from_grey = 1").where(C(doi) != "").groupBy(doi).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(doi, F.lit(True).alias("_fake"))
    d = d.join(shared, doi, "left").withColumn(doi, F.when(C("_fake") & (C("from_grey") == 1), "").otherwise(C(doi))).drop("_fake")
    w = Window.partitionBy("action", doi).orderBy(F.desc_nulls_last("cited_by_count"), "work_id")
    kept = d.where((C("action") == "keep") & (F.coalesce(C(doi), F.lit("")) != ""))
    kept = kept.withColumn("action", F.when(F.row_number().over(w) > 1, "deduped").otherwise("keep"))
    return kept.unionByName(d.where((C("action") != "keep") | (F.coalesce(C(doi), F.lit("")) == "")))


def merge_citations(parts: list[DataFrame], sentinel: str) -> DataFrame:
    """Union without sentinel rows; one row for each source and DOI or, where there is no DOI, for each source, title, first
    author and year. Keys are trimmed and lower-cased, null like empty. Of rows with one key that of the earliest part stays, ties
    to the smaller row (all columns, in order), so the result doesn't depend on how the rows are read."""
    out = parts[0].withColumn("_part", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn("_part", F.lit(i)), allowMissingColumns=True)
    columns = [c for c in out.columns if c != "_part"]
    out = out.where(F.coalesce(C("ref_doi"), F.lit("")) != sentinel)
    norm = lambda c: F.lower(F.trim(F.coalesce(C(c), F.lit(""))))
    doi = norm("ref_doi")
    loose = lambda k: F.when(doi == "", k)
    author = norm("ref_first_author") if "ref_first_author" in columns else F.lit("")
    keys = {"_k0": norm("source_doi"), "_k1": doi, "_k2": loose(norm("ref_title")), "_k3": loose(author), "_k4": loose(C("ref_year"))}
    first = F.min(F.struct("_part", *columns)).alias("_r")
    return out.withColumns(keys).groupBy(*keys).agg(first).select(*[C(f"_r.{c}").alias(c) for c in columns])


def blocked_match(refs: DataFrame, works: DataFrame, least: float) -> DataFrame:
    """Best work for each reference among those within a year, by the share of a common subsequence in both titles with words in
    order (``token_sort_ratio``), ``least`` or more; the best wins, then the earlier year offset, then the smaller work. Titles of
    up to 10 characters don't match.

    Equal titles of a year are one. First all works at most two characters inserted or left out away are found: of three equal
    parts of such a title one is in the reference's untouched, shifted by no more than its edits, so a join on hashed parts
    brings them. In titles of seven characters or more, each of these scores above every work further away. References without
    one are compared with all works of near years whose length allows ``least``.
    """
    r = saved(refs.where((F.length("ref_title") > 10) & C("ref_year").isNotNull()).select("ref_id", "ref_year", S.token_sorted("ref_title").alias("a")))
    w = works.where((F.length("title") > 10) & C("year").isNotNull()).select("work_id", "year", S.token_sorted("title").alias("b"))
    w = saved(w.groupBy("b", "year").agg(F.min("work_id").alias("work_id")).select("*", F.length("b").alias("lb"), F.monotonically_increasing_id().alias("w")))
    d = saved(r.select("a", "ref_year").distinct().select("*", F.length("a").alias("la"), F.monotonically_increasing_id().alias("r")))
    near = d.select("r", "ref_year", F.explode(_probes("a", "la")).alias("h")).join(w.where("lb >= 5").select("w", "year", F.explode(_parts("b", "lb")).alias("h")), "h")
    near = near.where("year between ref_year - 1 and ref_year + 1").select("r", "w").distinct().join(d, "r").join(w, "w")
    scored = lambda p: p.select("r", "la", "lb", S.subsequence_ratio("a", "b").alias("score"), (C("year") - C("ref_year")).alias("offset"), "work_id")
    near = saved(scored(near).where("la > 6 and score >= 100 * (1 - 2.5 / (la + lb))").drop("la", "lb"))
    allowed = least / (200 - least)
    grade = lambda n: F.floor(F.ln(n + 1.0) / F.lit(0.1))  # noqa: E731  lengths on a logarithmic scale: few for each title
    rest = d.join(near.select("r").distinct(), "r", "left_anti").withColumn("grade", F.explode(F.sequence(grade(F.floor(C("la") * allowed)), grade(F.ceil(C("la") / allowed)))))
    rest = rest.withColumn("year", F.explode(F.array(*[C("ref_year") + o for o in (-1, 0, 1)])))
    far = rest.join(w.withColumn("grade", grade(C("lb"))), ["year", "grade"]).where(F.least("la", "lb") >= F.greatest("la", "lb") * allowed)
    found = near.unionByName(scored(far).drop("la", "lb")).where(C("score") >= least)
    first = F.min(F.struct((-C("score")).alias("s"), "offset", "work_id")).alias("m")
    best = found.groupBy("r").agg(first).join(d, "r").select("a", "ref_year", (-C("m.s")).alias("score"), "m.offset", "m.work_id")
    return r.join(best, ["a", "ref_year"]).groupBy("ref_id").agg(first).select("ref_id", "m.work_id", (-C("m.s")).alias("score"))


def _part(text: str, start: Column, end: Column, n: Column, i: int, shift: int = 0) -> Column:
    return F.xxhash64(F.lit(i), n, F.substring(C(text), (start + shift + 1).cast("int"), (end - start).cast("int")))


def _third(n: Column, i: int) -> Column:
    return F.floor(n * i / 3)


def _parts(text: str, n: str) -> Column:
    """Hashes of a string's three parts."""
    return F.array(*[_part(text, _third(C(n), i), _third(C(n), i + 1), C(n), i) for i in range(3)])


def _probes(text: str, n: str) -> Column:
    """Hashes of what may be a part of a string at most two insertions or deletions away: of each length of the other, the
    part ``i`` has at most ``i`` edits before it and ``2 - i`` after it where it is the first one untouched counted from one end."""
    out = []
    for more in range(-2, 3):
        other = C(n) + more
        for i in range(3):
            out += [_part(text, _third(other, i), _third(other, i + 1), other, i, s) for s in range(-i, i + 1) if abs(s + more) <= 2 - i]
    return F.array(*out)


def near_duplicate_groups(works: DataFrame, prefix: int = 200, least: int = 5, least_abstract: int = 50, overlap: float = 0.5) -> DataFrame:
    """work_id, group: works linked by the start of their normalised abstract or by title, groups numbered by falling size
    (ties to the smaller first work).

    Abstracts of ``least_abstract`` characters or more link works with the same start, titles of ten normalised characters or
    more those with the same title, where at least ``least`` works do. A title counts only if a share of ``overlap`` of its
    works have an abstract whose start another of them has too; empty ones count against it. Groups are the components of both
    kinds of links together. A work is an edge from its abstract's first work to its title's, so components run over distinct
    pairs of first works, not over works.
    """
    start = F.substring(T.ascii_words(C("abstract")), 1, prefix)
    k = saved(works.select("work_id", start.alias("start"), F.length("abstract").alias("chars"), T.ascii_words(C("title")).alias("title")))
    count = F.count(F.lit(1))
    a = k.where((C("chars") >= least_abstract) & (C("start") != "")).groupBy("start").agg(count.alias("n"), F.min("work_id").alias("by_start")).where(C("n") >= least).drop("n")
    s = k.where(F.length("title") >= 10).groupBy("title", "start").agg(count.alias("n"), F.min("work_id").alias("first"))
    shared = F.sum(F.when((C("start") != "") & (C("n") > 1), C("n")).otherwise(0))
    t = s.groupBy("title").agg(F.sum("n").alias("n"), shared.alias("shared"), F.min("first").alias("by_title")).where((C("n") >= least) & (C("shared") >= overlap * C("n"))).drop("n", "shared")
    a = k.where(C("chars") >= least_abstract).select("work_id", "start").join(a, "start").select("work_id", "by_start")
    t = k.select("work_id", "title").join(t, "title").select("work_id", "by_title")
    m = saved(a.join(t, "work_id", "full_outer"))
    labels = components(m.select(C("by_start").alias("a"), C("by_title").alias("b")).distinct())
    m = m.withColumn("node", F.coalesce("by_start", "by_title")).join(labels, "node", "left").select("work_id", F.coalesce("label", "node").alias("label"))
    m = saved(m)
    n = m.groupBy("label").agg(count.alias("n"), F.min("work_id").alias("first")).where(C("n") >= least)
    return m.join(numbered(n, [F.desc("n"), C("first")], "group"), "label").select("work_id", "group")
