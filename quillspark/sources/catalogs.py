"""Readers of bibliographic exports and record flattening. All are scans plus column expressions; nothing runs on the driver
but path listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import text as X

C = F.col
WORK_COLUMNS = ("source", "source_id", "doi", "title", "first_author", "all_authors", "year", "journal", "abstract", "language", "keywords", "categories", "cited_by_count", "affiliations")
WORK_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in WORK_COLUMNS])
REFERENCE_COLUMNS = ("source_doi", "source_id", "ref_doi", "ref_title", "ref_first_author", "ref_year", "ref_journal", "ref_raw")


def read_csv(spark: SparkSession, path: str, schema: T.StructType = WORK_SCHEMA) -> DataFrame:
    """A catalog, one file or a folder of parts: all strings, empty stays empty, quoted newlines kept; ``catalog`` is the name
    before ``_works``."""
    df = spark.read.csv(path, schema=schema, header=True, multiLine=True, quote='"', escape='"', emptyValue="").na.fill("")
    return df.withColumn("catalog", F.regexp_extract(C("_metadata.file_path"), r"([^/]+?)(?:_works)?\.csv(?:/[^/]*)?$", 1))


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the paths that exist, in any file system that Spark reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    return [p for p in paths if jvm.org.apache.hadoop.fs.Path(p).getFileSystem(conf).exists(jvm.org.apache.hadoop.fs.Path(p))]


def read_all(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Union of the catalogs that exist, columns by name."""
    out = None
    for p in existing(spark, paths):
        df = read_csv(spark, p)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return spark.createDataFrame([], WORK_SCHEMA.add("catalog", T.StringType())) if out is None else out


def read_pool(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Newline-delimited JSON, gzipped or not; lines that are no records are skipped."""
    return spark.read.json(path, schema=schema, mode="DROPMALFORMED")


def keep_first(pool: DataFrame, key: str, *order: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(*order)
    return pool.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


#: Schema of raw records, for ``read_pool``.
OPENALEX = (
    "id string, doi string, title string, publication_year int, language string, cited_by_count long, authorships array<struct<author:struct<display_name:string>,institutions:array<struct<display_name:string>>>>, keywords array<struct<display_name:string>>, concepts array<struct<display_name:string,level:int>>, primary_location struct<source:struct<display_name:string>>, abstract_inverted_index map<string,array<int>>, referenced_works array<string>"
)


def openalex_work() -> list[Column]:
    """Columns of a work from a nested record."""
    names = F.transform("authorships", lambda a: a["author"]["display_name"])
    places = F.array_sort(F.array_distinct(F.flatten(F.transform("authorships", lambda a: F.transform(F.coalesce(a["institutions"], F.array()), lambda i: i["display_name"])))))
    return [
        F.lit("openalex").alias("source"), F.regexp_replace("id", "^https?://openalex.org/", "").alias("source_id"), X.normalize_doi(C("doi")).alias("doi"), F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce(F.try_element_at(names, F.lit(1)), F.lit("")).alias("first_author"), F.array_join(names, " ; ").alias("all_authors"), C("publication_year").cast("string").alias("year"), C("primary_location.source.display_name").alias("journal"),
        F.coalesce(X.invert_index(C("abstract_inverted_index")), F.lit("")).alias("abstract"), C("language"), F.array_join(F.transform("keywords", lambda k: k["display_name"]), " ; ").alias("keywords"),
        F.array_join(F.transform(F.filter("concepts", lambda c: c["level"] <= 2), lambda c: c["display_name"]), " ; ").alias("categories"), C("cited_by_count").cast("string").alias("cited_by_count"), F.array_join(places, " ; ").alias("affiliations"),
    ]


def references(works: DataFrame) -> DataFrame:
    return works.select(X.normalize_doi(C("doi")).alias("source_doi"), F.regexp_replace("id", "^https?://openalex.org/", "").alias("source_id"), F.explode("referenced_works").alias("ref"))


def istex_work() -> list[Column]:
    """DOI as scalar or first of a list, affiliations without e-mail addresses, first 20 distinct keywords."""
    doi = F.coalesce(F.try_element_at(C("doi"), F.lit(1)), F.lit(""))
    names = F.transform("author", lambda a: a["name"])
    places = F.array_distinct(F.filter(F.flatten(F.transform("author", lambda a: F.coalesce(a["affiliations"], F.array()))), lambda x: ~x.contains("@")))
    keys = F.slice(F.array_distinct(F.coalesce("keywords", F.array().cast("array<string>"))), 1, 20)
    return [F.lit("istex").alias("source"), C("id").alias("source_id"), X.normalize_doi(doi).alias("doi"), C("title"), F.try_element_at(names, F.lit(1)).alias("first_author"), F.array_join(names, " ; ").alias("all_authors"), F.array_join(places, " ; ").alias("affiliations"), F.array_join(keys, " ; ").alias("keywords")]


def ris(spark: SparkSession, path: str) -> DataFrame:
    """A row a record, tag -> values. Records end at ``ER  -``; a number before a tag (as some exports have) is dropped."""
    return ris_records(spark.read.text(path, lineSep="ER  -"), C("value"))


def ris_records(df: DataFrame, text: Column) -> DataFrame:
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: x.rlike(r"^\s*(?:\d+[.)]\s*)?[A-Z][A-Z0-9]  ?-"))
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"([A-Z][A-Z0-9])  ?-", 1).alias("tag"), F.trim(F.regexp_extract(x, r"[A-Z][A-Z0-9]  ?-\s*(.*)$", 1)).alias("value")))
    tags = F.array_distinct(F.transform(pairs, lambda p: p["tag"]))
    fields = F.map_from_arrays(tags, F.transform(tags, lambda t: F.transform(F.filter(pairs, lambda p: p["tag"] == t), lambda p: p["value"])))
    return df.withColumn("fields", fields).where(F.size("fields") > 0)


def ris_work() -> list[Column]:
    one = lambda *tags: F.coalesce(*[F.try_element_at(F.try_element_at("fields", F.lit(t)), F.lit(1)) for t in tags])
    authors = F.concat(*[F.coalesce(F.try_element_at("fields", F.lit(t)), F.array().cast("array<string>")) for t in ("AU", "A1")])
    return [one("TI", "T1").alias("title"), F.try_element_at(authors, F.lit(1)).alias("first_author"), F.array_join(authors, " ; ").alias("all_authors"), F.regexp_extract(one("PY", "Y1"), r"(\d{4})", 1).alias("year"), one("JO", "T2", "JF").alias("journal"), one("AB", "N2").alias("abstract"), X.normalize_doi(one("DO")).alias("doi"), F.array_join(F.try_element_at("fields", F.lit("KW")), " ; ").alias("keywords")]


def bibtex(spark: SparkSession, path: str) -> DataFrame:
    return bibtex_entries(spark.read.text(path, wholetext=True), C("value"))


def bibtex_entries(df: DataFrame, text: Column) -> DataFrame:
    """kind, key, fields: an entry runs to the next line that starts one; values in braces (one level nested) or quotes."""
    entries = df.select(F.explode(F.regexp_extract_all(text, F.lit(r"(?s)(@\w+\s*\{.*?)(?=\n\s*@\w+\s*\{|\z)"), F.lit(1))).alias("e"))
    pair = r"""(?s)(\w+\s*=\s*(?:\{(?:[^{}]|\{[^{}]*\})*\}|"[^"]*"|\d+))"""
    pairs = F.transform(F.regexp_extract_all("e", F.lit(pair), F.lit(1)), lambda p: F.struct(F.lower(F.regexp_extract(p, r"^(\w+)", 1)).alias("k"), F.trim(F.regexp_replace(F.regexp_replace(p, r"(?s)^\w+\s*=\s*", ""), r'^[{"]|[}"]$', "")).alias("v")))
    return entries.select(F.lower(F.regexp_extract("e", r"@(\w+)", 1)).alias("kind"), F.trim(F.regexp_extract("e", r"@\w+\s*\{\s*([^,\s]+)", 1)).alias("key"), F.map_from_entries(pairs).alias("fields"))


def tei_citation(xml: Column) -> list[Column]:
    """Article title (else the book's), first surname, year and journal of a parsed reference."""
    s = lambda p: F.nullif(F.trim(F.xpath_string(xml, F.lit(p))), F.lit(""))
    return [F.coalesce(s("//analytic/title"), s("//monogr/title")).alias("title"), s("//author[1]//surname").alias("first_author"), F.substring(s("//date/@when"), 1, 4).alias("year"), F.when(s("//analytic/title").isNotNull(), s("//monogr/title")).alias("journal")]


def json_in_text(x: Column) -> Column:
    """The first JSON object or array inside free text, as a variant; null if none parses."""
    return F.try_parse_json(F.regexp_extract(x, r"(?s)(\{.*\}|\[.*\])", 1))


def metadata_map(x: Column) -> Column:
    """One map from metadata given either as an object or as a list of key and value objects (a JSON string)."""
    as_map = F.from_json(x, "map<string,string>")
    as_list = F.from_json(x, "array<struct<key:string,value:string>>")
    return F.when(F.ltrim(x).startswith("["), F.map_from_entries(F.transform(as_list, lambda e: F.struct(e["key"], e["value"])))).otherwise(as_map)


def identifiers(lines: DataFrame) -> DataFrame:
    """kind, id from a list of identifiers (column ``value``); ``sid:`` marks source ids, others are DOIs."""
    v = F.trim("value")
    return lines.where(F.length(v) > 0).select(F.when(v.startswith("sid:"), "source_id").otherwise("doi").alias("kind"), F.when(v.startswith("sid:"), F.substring(v, 5, 10_000)).otherwise(X.normalize_doi(v)).alias("id"))


def last_wins(cache: DataFrame, key: str, value: str, row_id: str) -> DataFrame:
    return cache.groupBy(key).agg(F.max_by(value, row_id).alias(value))


def _or_empty(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def grey_work(metadata: Column, year: Column) -> list[Column]:
    """A repository item: ``metadata`` (JSON) is a map of lists of values, or a list of keys and values; values of one key are
    joined."""
    as_map = F.transform_values(F.from_json(metadata, "map<string,array<struct<value:string>>>"), lambda k, v: F.transform(v, lambda e: e["value"]))
    flat = F.from_json(metadata, "array<struct<key:string,value:string>>")
    keys = F.array_distinct(F.transform(flat, lambda e: e["key"]))
    as_list = F.map_from_arrays(keys, F.transform(keys, lambda k: F.transform(F.filter(flat, lambda e: e["key"] == k), lambda e: e["value"])))
    values = F.when(F.ltrim(metadata).startswith("["), as_list).otherwise(as_map)
    field = lambda k: _or_empty(F.array_join(F.filter(F.try_element_at(values, F.lit(k)), lambda v: v != ""), " ; "))
    author = field("dc.contributor.author")
    return [
        F.lit("grey").alias("source"), _or_empty(C("uuid")).alias("source_id"), X.normalize_doi(field("dc.identifier.doi")).alias("doi"), field("dc.title").alias("title"), F.split(author, " ; ")[0].alias("first_author"),
        author.alias("all_authors"), year.alias("year"), F.lit("World Bank").alias("journal"), field("dc.description.abstract").alias("abstract"), field("dc.language.iso").alias("language"), field("dc.subject").alias("keywords"),
        F.lit("grey literature").alias("categories"), F.lit("").alias("cited_by_count"), F.lit("World Bank").alias("affiliations"),
    ]


def paper_work() -> list[Column]:
    """A paper of the graph API; categories are its fields of study, then the model's."""
    names = F.transform(F.coalesce("authors", F.array().cast("array<struct<name:string>>")), lambda a: _or_empty(a["name"]))
    model = F.transform(F.filter(F.coalesce("s2FieldsOfStudy", F.array().cast("array<struct<category:string,source:string>>")), lambda f: f["source"] == "s2-fos-model"), lambda f: f["category"])
    return [
        F.lit("semanticscholar").alias("source"), _or_empty(C("paperId")).alias("source_id"), X.normalize_doi(C("externalIds.DOI")).alias("doi"), _or_empty(C("title")).alias("title"), _or_empty(F.try_element_at(names, F.lit(1))).alias("first_author"),
        F.array_join(names, " ; ").alias("all_authors"), _or_empty(C("year").cast("string")).alias("year"), _or_empty(C("venue")).alias("journal"), _or_empty(C("abstract")).alias("abstract"), F.lit("").alias("language"), F.lit("").alias("keywords"),
        F.array_join(F.concat(F.coalesce("fieldsOfStudy", F.array().cast("array<string>")), model), " ; ").alias("categories"), _or_empty(C("citationCount").cast("string")).alias("cited_by_count"), F.lit("").alias("affiliations"),
    ]


def entry_work(entry: Column) -> list[Column]:
    """A search entry (JSON) whose field names hold prefixes with colons."""
    fields = F.from_json(entry, "map<string,string>")
    field = lambda k: _or_empty(F.try_element_at(fields, F.lit(k)))
    place = F.from_json(field("affiliation"), "array<struct<affilname:string>>")
    return [
        F.lit("scopus").alias("source"), F.replace(field("dc:identifier"), F.lit("SCOPUS_ID:"), F.lit("")).alias("source_id"), X.normalize_doi(field("prism:doi")).alias("doi"), field("dc:title").alias("title"), field("dc:creator").alias("first_author"),
        field("dc:creator").alias("all_authors"), F.substring(field("prism:coverDate"), 1, 4).alias("year"), field("prism:publicationName").alias("journal"), field("dc:description").alias("abstract"), F.lit("").alias("language"), F.lit("").alias("keywords"),
        field("prism:aggregationType").alias("categories"), field("citedby-count").alias("cited_by_count"), _or_empty(F.try_element_at(place, F.lit(1))["affilname"]).alias("affiliations"),
    ]


def bibliography(entries: DataFrame) -> DataFrame:
    """Entries as references to check: year only where it is a number."""
    field = lambda k: _or_empty(F.try_element_at("fields", F.lit(k)))
    year = F.trim(field("year"))
    return entries.select(C("key").alias("bib_key"), field("title").alias("bib_title"), F.when(year.rlike("^[0-9]+$"), year.try_cast("int")).alias("bib_year"), X.normalize_doi(field("doi")).alias("bib_doi"), field("author").alias("bib_authors"), C("kind").alias("bib_type"))
