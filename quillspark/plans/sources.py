"""Queries of readers, flattening and sinks. Raw records are made from the test tables, so that SQL can check the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import relational as R
from quillspark.sources import catalogs as S
from quillspark.sources import sinks as K
from quillspark.streaming import ingest

from .relational import C

Q: dict = {}
SQL: dict[str, str] = {}


def op(name: str, *needs: str, sql: str | None = None):
    from . import proxy

    def put(f):
        Q[name] = lambda spark, sf_dir: f(*[proxy.view(spark, sf_dir, n) if n in proxy._TEXT else proxy.read(spark, sf_dir, n) for n in needs])
        if sql:
            views = [proxy.sql(n) for n in needs if n in proxy._TEXT]
            head = "WITH " + ", ".join(views) if views else ""
            SQL[name] = f"{head}, {sql.strip()[5:]}" if views and sql.strip().upper().startswith("WITH ") else f"{head} {sql}"
        return f

    return put


def nested(works):
    """Records as an API gives them."""
    inst = F.array(F.struct(C("source").alias("display_name")), F.struct(F.lit("Zed").alias("display_name")))
    return works.select(
        F.concat(F.lit("https://openalex.org/W"), C("work_id").cast("string")).alias("id"), "doi", "title", C("year").alias("publication_year"), C("lang").alias("language"), C("cited_by_count").cast("long").alias("cited_by_count"),
        F.array(F.struct(F.struct(C("first_author").alias("display_name")).alias("author"), inst.alias("institutions")), F.struct(F.struct(F.lit("Second").alias("display_name")).alias("author"), inst.alias("institutions"))).alias("authorships"),
        F.array(F.struct(C("lang").alias("display_name")), F.struct(C("source").alias("display_name"))).alias("keywords"), F.array(F.struct(C("source").alias("display_name"), F.lit(1).alias("level")), F.struct(F.lit("deep").alias("display_name"), F.lit(3).alias("level"))).alias("concepts"),
        F.struct(F.struct(C("venue").alias("display_name")).alias("source")).alias("primary_location"), F.create_map(F.lit("two"), F.array(F.lit(1)), F.lit("one"), F.array(F.lit(0), F.lit(2))).alias("abstract_inverted_index"),
        F.transform(F.sequence(F.lit(1), (C("work_id") % 3 + 1).cast("int")), lambda i: F.concat(F.lit("W"), (C("work_id") + i).cast("string"))).alias("referenced_works"), "work_id",
    )


@op("SRC_02_union_scan", "documents", "conversations", sql="SELECT text, lang FROM documents UNION ALL SELECT text, NULL FROM conversations")
def _(documents, conversations):
    return documents.select("text", "lang").unionByName(conversations.select("text"), allowMissingColumns=True)


@op("SRC_03_coerced_load", "works", sql="SELECT work_id, coalesce(CAST(floor(try_cast(y AS DOUBLE)) AS INT), 0) AS year FROM (SELECT work_id, CASE work_id % 4 WHEN 0 THEN '2015.0' WHEN 1 THEN 'n/a' WHEN 2 THEN NULL ELSE '1999' END y FROM works)")
def _(works):
    y = F.when(C("work_id") % 4 == 0, "2015.0").when(C("work_id") % 4 == 1, "n/a").when(C("work_id") % 4 == 3, "1999")
    return works.select("work_id", y.alias("y")).select("work_id", F.coalesce(F.floor(C("y").try_cast("double")).cast("int"), F.lit(0)).alias("year"))


@op("SRC_04_edge_load", "edges", sql="SELECT source_id, ref_id, source_year, ref_year FROM edges")
def _(edges):
    return edges


@op("SRC_05_embeddings", "embeddings", sql="SELECT vec_id, len(embedding) dims, label FROM embeddings")
def _(embeddings):
    return embeddings.select("vec_id", F.size("embedding").cast("long").alias("dims"), "label")


@op("SRC_07_distinct_ids", "events", sql="SELECT DISTINCT user_id FROM events")
def _(events):
    return events.select("user_id").distinct()


@op("SRC_08_flatten_record", "works", sql="SELECT 'W' || work_id source_id, coalesce(first_author, '') first_author, concat_ws(' ; ', first_author, 'Second') all_authors, CAST(year AS VARCHAR) AS year, venue journal, 'one two one' abstract, concat(lang, ' ; ', source) keywords, source categories, CASE WHEN source < 'Zed' THEN source || ' ; Zed' ELSE 'Zed ; ' || source END affiliations FROM works")
def _(works):
    d = nested(works).select(*S.openalex_work())
    return d.select("source_id", "first_author", "all_authors", "year", "journal", "abstract", "keywords", "categories", "affiliations")


@op("SRC_09_references", "works", sql="SELECT 'W' || work_id source_id, 'W' || (work_id + unnest(range(1, CAST(work_id % 3 + 2 AS BIGINT)))) AS \"ref\" FROM works")
def _(works):
    return S.references(nested(works)).select("source_id", "ref")


@op("SRC_10_keep_first", "works", sql="SELECT title, min(work_id) work_id FROM works GROUP BY 1")
def _(works):
    return S.keep_first(works, "title", "work_id").select("title", "work_id")


@op("SRC_11_ris", "works", sql="SELECT trim(title) title, 'Doe, J.' first_author, 'Doe, J. ; Roe, R.' all_authors, CAST(year AS VARCHAR) AS year, concat(lang, ' ; ', source) keywords FROM works WHERE NOT regexp_matches(title, '[\\r]') AND trim(title) <> ''")
def _(works):
    rec = F.concat(F.lit("TY  - JOUR\nTI  - "), "title", F.lit("\nAU  - Doe, J.\nAU  - Roe, R.\nPY  - "), C("year").cast("string"), F.lit("/01\nKW  - "), "lang", F.lit("\nKW  - "), "source", F.lit("\n"))
    d = S.ris_records(works.where("trim(title) <> ''").select(rec.alias("r")), C("r"))
    return d.select(*S.ris_work()).select("title", "first_author", "all_authors", "year", "keywords")


@op("SRC_12_ris_numbered", "works", sql="SELECT CAST(year AS VARCHAR) AS year, source keywords FROM works")
def _(works):
    rec = F.concat(F.lit("1. PY  - "), C("year").cast("string"), F.lit("\n2. KW  - "), "source")
    return S.ris_records(works.select(rec.alias("r")), C("r")).select(*S.ris_work()).select("year", "keywords")


@op("SRC_13_bibtex", "works", sql="SELECT 'article' kind, 'k' || work_id AS key, 'The {W}ork ' || work_id title, CAST(year AS VARCHAR) AS year FROM works")
def _(works):
    id_ = C("work_id").cast("string")
    rec = F.concat(F.lit("@Article{k"), id_, F.lit(",\n title = {The {W}ork "), id_, F.lit("},\n year = "), C("year").cast("string"), F.lit("\n}\n"))
    both = works.select(F.concat(rec, F.lit("\n")).alias("t"))
    d = S.bibtex_entries(both, C("t"))
    return d.select("kind", "key", F.try_element_at("fields", F.lit("title")).alias("title"), F.try_element_at("fields", F.lit("year")).alias("year"))


@op("SRC_14_author_split", "works", sql="SELECT work_id, list_aggregate([trim(x) for x in string_split(replace(coalesce(first_author, ''), chr(10), ';'), ';') if trim(x) <> ''], 'string_agg', ' ; ') authors, coalesce(nullif(venue, 'src1'), 'none') category FROM works WHERE trim(title) <> ''")
def _(works):
    a = F.filter(F.transform(F.split(F.regexp_replace(F.coalesce("first_author", F.lit("")), "\n", ";"), ";"), lambda x: F.trim(x)), lambda x: x != "")
    return works.where("trim(title) <> ''").select("work_id", F.when(F.size(a) > 0, F.array_join(a, " ; ")).alias("authors"), F.coalesce(F.nullif("venue", F.lit("src1")), F.lit("none")).alias("category"))


@op("SRC_15_year_bounds", "works", sql="SELECT work_id FROM works WHERE work_id % 9 = 0 OR year BETWEEN 1996 AND 1999")
def _(works):
    y = F.when(C("work_id") % 9 != 0, C("year").cast("string")).otherwise("n.d.").try_cast("int")
    return works.where(y.isNull() | y.between(1996, 1999)).select("work_id")


@op("SRC_16_two_shapes", "works", sql="SELECT work_id, source v FROM works")
def _(works):
    obj = F.to_json(F.create_map(F.lit("a"), C("source")))
    lst = F.to_json(F.array(F.struct(F.lit("a").alias("key"), C("source").alias("value"))))
    return works.select("work_id", F.try_element_at(S.metadata_map(F.when(C("work_id") % 2 == 0, obj).otherwise(lst)), F.lit("a")).alias("v"))


@op("SRC_18_istex_record", "works", sql="SELECT source_id, 'A' first_author, lang affiliations, concat(source, ' ; ', lang) keywords FROM works")
def _(works):
    a = F.array(F.struct(F.lit("A").alias("name"), F.array(C("lang"), F.lit("x@y.z")).alias("affiliations")), F.struct(F.lit("B").alias("name"), F.array("lang").alias("affiliations")))
    d = works.select(C("source_id").alias("id"), F.array("doi").alias("doi"), "title", a.alias("author"), F.array("source", "lang", "source").alias("keywords"))
    return d.select(*S.istex_work()).select("source_id", "first_author", "affiliations", "keywords")


@op("SRC_21_tei_citation", "works", sql="SELECT work_id, 'Paper ' || work_id title, 'Doe' first_author, CAST(year AS VARCHAR) AS year, source journal FROM works")
def _(works):
    xml = F.concat(F.lit("<b><analytic><title>Paper "), C("work_id").cast("string"), F.lit("</title><author><surname>Doe</surname></author></analytic><monogr><title>"), "source", F.lit("</title><date when='"), C("year").cast("string"), F.lit("-03'/></monogr></b>"))
    return works.select("work_id", *S.tei_citation(xml))


@op("SRC_22_fan_out", "works", sql="WITH k AS (SELECT sha256(trim(title, ' ')) k, min(work_id) parsed FROM works GROUP BY 1) SELECT work_id, parsed FROM works JOIN k ON sha256(trim(title, ' ')) = k")
def _(works):
    key = F.sha2(F.trim("title"), 256)
    return works.select("work_id", key.alias("k")).join(works.groupBy(key.alias("k")).agg(F.min("work_id").alias("parsed")), "k").select("work_id", "parsed")


@op("SRC_26_chunks", "works", sql="SELECT work_id, CAST(i AS INT) AS pos, substr(abstract, i * 900 + 1, 1000) chunk FROM (SELECT work_id, abstract, unnest(range(0, CAST(greatest(length(abstract) - 101, 0) // 900 + 1 AS BIGINT))) i FROM works WHERE length(abstract) > 0)")
def _(works):
    return works.select("work_id", F.posexplode(T.chunks(C("abstract"), 1000, 100)).alias("pos", "chunk"))


@op("SRC_27_json_in_text", "events", sql="SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) k FROM events")
def _(events):
    v = S.json_in_text(F.concat(F.lit("Sure, here: "), "props", F.lit(" - done")))
    return events.select("event_id", F.try_variant_get(v, "$.k", "int").alias("k"))


@op("SRC_28_last_wins", "events", sql="SELECT user_id, arg_max(event_type, event_id) event_type FROM events GROUP BY 1")
def _(events):
    return S.last_wins(events, "user_id", "event_type", "event_id")


@op("SRC_29_identifiers", "works", sql="SELECT 'source_id' kind, source_id id FROM works UNION ALL SELECT 'doi', coalesce(lower(trim(regexp_replace(trim(doi), '^(https?://(dx.)?doi.org/|doi:)', '', 'i'))), '') FROM works WHERE doi IS NOT NULL")
def _(works):
    v = works.select(F.concat(F.lit("sid:"), "source_id").alias("value")).unionByName(works.select(C("doi").alias("value")).where("doi is not null"))
    return S.identifiers(v)


@op("SRC_30_method_of_file", "works", sql="SELECT DISTINCT source, 'S' || substr(source, 4) AS method, CASE WHEN length(source) > 4 THEN 'lexical' ELSE 'semantic' END channel FROM works")
def _(works):
    m = F.regexp_extract(F.concat(F.lit("/x/tab_div_S"), F.substring("source", 4, 9), F.lit(".csv")), r"tab_div_(\w+)\.csv$", 1)
    return works.select("source", m.alias("method"), F.when(F.length("source") > 4, "lexical").otherwise("semantic").alias("channel")).distinct()


@op("SNK_06_markdown", "works", sql=None)
def _(works):
    text = K.markdown(R.share_of_total(works, "lang").orderBy("lang").withColumn("pct", F.round("pct", 1)))
    return works.sparkSession.createDataFrame([(text,)], "markdown string")


@op("SNK_08_deposit", "works", sql="SELECT work_id AS id, title, CAST(year AS INT) AS year FROM works")
def _(works):
    return K.deposit(works.select("work_id", "title", "year", "abstract"), ["abstract"], {"work_id": "id"}, "id")


@op("PL_20_canonical_hash", "works")
def _(works):
    return K.canonical_hash(works.select("work_id", "title", "year"))


@op("EXT_windowed_counts", "events", sql="SELECT time_bucket(INTERVAL 6 hours, ts) AS start, event_type, count(*) n, round(sum(value), 4) total FROM events GROUP BY 1, 2")
def _(events):
    return ingest.windowed_counts(events, "ts", "event_type", "6 hours").withColumn("total", F.round("total", 4))


@op("EXT_sessions", "events", sql="WITH g AS (SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 30 minutes THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) s FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) p FROM events)) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 minutes AS \"end\", count(*) n FROM g GROUP BY user_id, s")
def _(events):
    return ingest.sessions(events, "ts", "user_id")


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
