"""Queries of the scalar functions: one column each over the proxy works, beside the SQL that defines it."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as T

from . import proxy

C = F.col
GROUPS = {"a": ("the", "and"), "b": ("thon", "hean", "ing"), "c": ("que", "les")}
CLASSES = {"adaptation": ("tion", "aux"), "mitigation": ("ing", "er"), "finance": ("que", "ch"), "other": ("zzz",)}
SAFE, NOISE = ("tion", "eau"), ("the", "der ")
VENUES = (("^src1$", "Journal One"), ("^src1", "Journal Teens"), ("src[2-5]", "Proceedings"))
TYPES = (("(?i)^the", "article"), ("(?i)report|tion", "report"), (r"\*\*\*|###", "junk"))
ACRONYMS = (("the of", "TO"), ("tion", "T"))
PERIODS = ((1995, 1997), (1998, 1999))


def _or(x, words):
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def _sum(x, words):
    return "(" + " + ".join(f"CAST(contains(lower({x}), '{w}') AS INT)" for w in words) + ")"


def _lang_sql(x):
    code = f"lower(trim({x}))"
    whens = " ".join(f"WHEN split_part({code}, '_', 1) IN ({', '.join(repr(n) for n in v.split())}) THEN '{k}'" for k, v in T.LANGUAGES.items())
    return f"CASE WHEN {code} IN ({', '.join(repr(n) for n in T.NO_LANGUAGE)}) THEN NULL WHEN length({code}) = 2 THEN {code} WHEN contains({code}, '_') AND length(split_part({code}, '_', 1)) = 2 THEN split_part({code}, '_', 1) {whens} END"


_RAW_LANG = "CASE work_id % 8 WHEN 0 THEN 'eng' WHEN 1 THEN 'en_US' WHEN 2 THEN 'French' WHEN 3 THEN 'und' WHEN 4 THEN NULL WHEN 5 THEN 'xx' WHEN 6 THEN ' GER ' ELSE 'klingon' END"
_LOCALE = "CASE work_id % 4 WHEN 0 THEN 'en-US' WHEN 1 THEN 'fra-x' WHEN 2 THEN NULL ELSE 'unknown' END"
_DOI = r"coalesce(lower(trim(regexp_replace(trim(doi), '^(https?://(dx\.)?doi\.org/|doi:)', '', 'i'))), '')"
_TITLE = r"coalesce(trim(regexp_replace(regexp_replace(lower(title), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g')), '')"
_ASCII = r"coalesce(trim(regexp_replace(regexp_replace(lower(abstract), '[^a-z0-9 ]', ' ', 'g'), '\s+', ' ', 'g')), '')"
_TOK = r"len([t for t in regexp_split_to_array(trim(abstract), '\s+') if t <> ''])"
_STUB = "(starts_with(lower(abstract), 'no access') OR (contains(lower(abstract), '10.5751/es-') AND length(abstract) < 500) OR contains(lower(abstract), 'not available for this content'))"
_STOCK = f"(length(trim(abstract)) < 30 OR lower(trim(abstract)) IN ('international audience', 'editorial reviewed', 'peer reviewed') OR starts_with(lower(trim(abstract)), 'info:eu-repo/') OR (title <> '' AND lower(trim(abstract)) = lower(trim(title))) OR {_STUB} OR (length(trim(abstract)) < 50 AND trim(abstract) = upper(trim(abstract)) AND NOT (trim(abstract) = lower(trim(abstract)) AND lower(trim(abstract)) <> upper(trim(abstract)))))"
_WORDS = "list_distinct(regexp_extract_all(lower(abstract), '[a-z]{3,}'))"
_HITS = " + ".join(f"CAST(len(list_intersect({_WORDS}, [{', '.join(repr(w) for w in g)}])) > 0 AS INT)" for g in GROUPS.values())
_BEST = "CASE " + " ".join(f"WHEN {_sum('abstract', ws)} > 0 AND {_sum('abstract', ws)} >= greatest({', '.join(_sum('abstract', w2) for w2 in CLASSES.values())}) THEN '{c}'" for c, ws in CLASSES.items()) + " END"
_rule = lambda x, rules, default: "CASE " + " ".join(f"WHEN regexp_matches({x}, '{p}') THEN '{n}'" for p, n in rules) + f" ELSE {default} END"

#: id -> (Spark column, SQL)
COLUMNS = {
    "FN_01_normalize_doi": (lambda: F.when(C("doi").isNotNull(), T.normalize_doi(C("doi"))), f"CASE WHEN doi IS NOT NULL THEN {_DOI} END"),
    "FN_02_normalize_doi_safe": (lambda: T.normalize_doi(C("doi")), _DOI),
    "FN_03_clean_doi": (lambda: T.clean_doi(C("doi")), r"coalesce(lower(regexp_extract(doi, '(10\.\d{4,}\S*)', 1)), '')"),
    "FN_04_normalize_title": (lambda: T.normalize_title(C("title")), _TITLE),
    "FN_05_strip_markup": (lambda: T.strip_markup(F.concat(F.lit("<b>x</b> "), C("title"))), r"trim(regexp_replace(regexp_replace(concat('<b>x</b> ', title), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"),
    "FN_06_ascii_words": (lambda: T.ascii_words(C("abstract")), _ASCII),
    "FN_07_bib_title": (lambda: T.bib_title(F.concat(F.lit(r"{\emph Title} of "), C("title"))), r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(concat('{\emph Title} of ', title)), '\\[a-z]+', '', 'g'), '[{}]', '', 'g'), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"),
    "FN_09_normalize_lang": (lambda: T.normalize_lang(F.expr(_RAW_LANG)), _lang_sql(f"({_RAW_LANG})")),
    "FN_10_is_iso639_1": (lambda: F.coalesce(T.normalize_lang(F.expr(_RAW_LANG)).isin(*T.LANGUAGES), F.lit(False)), f"coalesce(({_lang_sql(f'({_RAW_LANG})')}) IN ({', '.join(repr(k) for k in T.LANGUAGES)}), false)"),
    "FN_12_display_lang": (lambda: T.display_lang(F.expr(_LOCALE)), f"coalesce({_lang_sql(f'split_part(({_LOCALE}), chr(45), 1)')}, 'unknown')"),
    "FN_13_is_missing": (lambda: T.is_missing(C("first_author")), "(first_author IS NULL OR lower(trim(first_author)) IN ('', 'nan', 'none'))"),
    "FN_14_count_tokens": (lambda: T.count_tokens(C("abstract")), _TOK),
    "FN_15_length_class": (lambda: T.length_class(T.count_tokens(C("abstract")), 500), f"CASE WHEN {_TOK} = 0 THEN 'missing' WHEN {_TOK} > 500 THEN 'too_long' ELSE 'ok' END"),
    "FN_16_clean_abstract": (lambda: T.clean_abstract(C("title")), r"CASE WHEN title IS NULL OR length(trim(regexp_replace(regexp_replace(title, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) < 20 THEN '' ELSE trim(regexp_replace(regexp_replace(title, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) END"),
    "FN_17_stock_abstract": (lambda: T.stock_abstract(C("abstract"), C("title")), f"coalesce({_STOCK}, true)"),
    "FN_18_text_to_embed": (lambda: T.text_to_embed(C("title"), C("abstract"), C("keywords")), f"concat_ws('. ', title, CASE WHEN NOT coalesce({_STOCK}, true) THEN abstract END, replace(keywords, ';', ', '))"),
    "FN_19_text_hash": (lambda: F.concat_ws("/", T.text_hash(C("abstract")), T.cache_key(C("abstract"))), "concat_ws('/', substr(md5(abstract), 1, 8), substr(sha256(trim(abstract, ' ')), 1, 16))"),
    "FN_20_work_key": (lambda: T.work_key(C("doi"), F.when(C("work_id") % 2 == 0, C("source_id")), C("title")), f"coalesce(nullif({_DOI}, ''), CASE WHEN work_id % 2 = 0 THEN source_id END, concat('title:', md5(coalesce(title, ''))))"),
    "FN_21_concept_groups": (lambda: T.groups_hit(C("abstract"), GROUPS), _HITS),
    "FN_22_safe_words": (lambda: T.any_contains(F.lower(C("title")), SAFE), f"coalesce({_or('lower(title)', SAFE)}, false)"),
    "FN_23_pattern_mask": (lambda: C("abstract").rlike("(?i)tion|eaux") | C("abstract").rlike("[0-9]{4}"), "(regexp_matches(abstract, '(?i)tion|eaux') OR regexp_matches(abstract, '[0-9]{4}'))"),
    "FN_24_theme_gate": (lambda: C("abstract").rlike(r"(?i)\bthe and\b") | (C("abstract").rlike(r"(?i)\bthe\b") & C("abstract").rlike(r"(?i)\bof\b")), r"(regexp_matches(abstract, '(?i)\bthe and\b') OR (regexp_matches(abstract, '(?i)\bthe\b') AND regexp_matches(abstract, '(?i)\bof\b')))"),
    "FN_25_institutional": (lambda: T.any_contains(F.lower(C("venue")), ("src1", "src7")), f"{_or('lower(venue)', ('src1', 'src7'))}"),
    "FN_26_field_class": (lambda: F.when(F.contains("keywords", F.lit("k1")), "allow").when(F.contains("keywords", F.lit("de;")), "exclude").otherwise("unknown"), "CASE WHEN contains(keywords, 'k1') THEN 'allow' WHEN contains(keywords, 'de;') THEN 'exclude' ELSE 'unknown' END"),
    "FN_27_non_english": (lambda: C("lang").isNotNull() & (C("lang") != "en"), "(lang IS NOT NULL AND lang <> 'en')"),
    "FN_28_keyword_region": (lambda: F.exists(F.array(F.lit("k3"), F.lit("k5"), F.lit("src9")), lambda k: F.contains("keywords", k)), _or("keywords", ("k3", "k5", "src9"))),
    "FN_29_quadrant": (lambda: F.concat(F.when(C("lang") == "en", "EN").otherwise("nonEN"), F.when(C("work_id") % 3 == 0, None).when(C("work_id") % 3 == 1, "-N").otherwise("-S")), "CASE WHEN lang = 'en' THEN 'EN' ELSE 'nonEN' END || CASE work_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '-N' ELSE '-S' END"),
    "FN_30_canonical_venue": (lambda: T.first_rule(C("venue"), VENUES, C("venue")), _rule("venue", VENUES, "venue")),
    "FN_31_venue_type": (lambda: T.first_rule(C("venue"), VENUES[:2], "other"), _rule("venue", VENUES[:2], "'other'")),
    "FN_32_institution_group": (lambda: T.first_rule(C("source_id"), (("-1[0-9]*$", "first"), ("-2", "second")), "rest"), _rule("source_id", (("-1[0-9]*$", "first"), ("-2", "second")), "'rest'")),
    "FN_33_document_type": (lambda: T.first_rule(C("title"), TYPES, "unknown"), _rule("title", TYPES, "'unknown'")),
    "FN_34_topic_classifier": (lambda: T.best_class(C("abstract"), CLASSES), _BEST),
    "FN_35_tradition": (lambda: T.best_class(C("title"), CLASSES, "none"), f"coalesce({_BEST.replace('abstract', 'title')}, 'none')"),
    "FN_36_pole_terms": (lambda: T.hits(C("abstract"), SAFE + NOISE), _sum("abstract", SAFE + NOISE)),
    "FN_37_period": (lambda: T.period(C("year"), PERIODS), "CASE WHEN year BETWEEN 1995 AND 1997 THEN '1995–1997' ELSE '1998–1999' END"),
    "FN_38_acronyms": (lambda: T.replace_all(C("title"), ACRONYMS), "regexp_replace(regexp_replace(title, 'the of', 'TO', 'gi'), 'tion', 'T', 'gi')"),
    "FN_39_clean_term": (lambda: (F.length("title") > 3) & C("title").rlike("^[A-Za-z ]+$") & ~C("title").rlike("(?i)the"), "(length(title) > 3 AND regexp_matches(title, '^[A-Za-z ]+$') AND NOT regexp_matches(title, '(?i)the'))"),
    "FN_42_first_author": (lambda: T.first_author(C("first_author")), "lower(trim(split_part(split_part(first_author, ';', 1), ',', 1)))"),
    "FN_43_alias_map": (lambda: F.coalesce(F.try_element_at(F.create_map(F.lit("src1"), F.lit("One"), F.lit("src2"), F.lit("Two")), C("source")), C("source")), "CASE source WHEN 'src1' THEN 'One' WHEN 'src2' THEN 'Two' ELSE source END"),
    "FN_44_level": (lambda: T.first_rule(C("title"), (("(?i)^th", "master"), ("(?i)^[a-e]", "doctoral")), "other"), _rule("title", (("(?i)^th", "master"), ("(?i)^[a-e]", "doctoral")), "'other'")),
    "FN_46_priority": (lambda: F.round(C("cited_by_count") + 10 * C("source_count") + 0.01 * (C("year") - 1990), 6), "round(CAST(cited_by_count + 10 * source_count + 0.01 * (year - 1990) AS DOUBLE), 6)"),
    "FN_47_archive_url": (lambda: F.when(F.sha1(C("source_id")).rlike("^[0-7][0-9a-f]{39}$"), F.concat(F.lit("https://example.org/"), F.sha1(C("source_id")), F.lit("/pdf"))), "CASE WHEN regexp_matches(sha1(source_id), '^[0-7][0-9a-f]{39}$') THEN concat('https://example.org/', sha1(source_id), '/pdf') END"),
    "FN_49_numbers": (lambda: F.array_join(F.array_except(T.numbers(C("abstract")), F.array(F.lit("1"))), "|"), r"coalesce(list_aggregate([x for x in list_distinct_keep if x <> '1'], 'string_agg', '|'), '')"),
    "FN_51_last_name": (lambda: F.element_at(F.split(T.first_author(C("first_author")), " "), -1), "list_extract(string_split(lower(trim(split_part(split_part(first_author, ';', 1), ',', 1))), ' '), -1)"),
}
#: Where one expression needs another before it.
_FROM = {"FN_49_numbers": r"(SELECT *, (SELECT list(x ORDER BY i) FROM (SELECT x, min(i) AS i FROM (SELECT unnest(regexp_extract_all(abstract, '\d+(?:\.\d+)?')) AS x, unnest(range(len(regexp_extract_all(abstract, '\d+(?:\.\d+)?')))) AS i) GROUP BY x)) AS list_distinct_keep FROM works)"}


def _query(name):
    def run(spark, sf_dir):
        return proxy.view(spark, sf_dir, "works").select("work_id", COLUMNS[name][0]().alias("out"))

    return run


def queries() -> dict:
    return {name: _query(name) for name in COLUMNS}


def oracle_sql() -> dict[str, str]:
    return {name: f"WITH {proxy.sql('works')} SELECT work_id, {sql} AS out FROM {_FROM.get(name, 'works')}" for name, (_, sql) in COLUMNS.items()}
