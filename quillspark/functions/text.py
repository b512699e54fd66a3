"""Scalar functions over bibliographic text, all of them native column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Language names and three-letter codes, by two-letter code.
LANGUAGES = {
    "en": "eng en_us en_gb english", "fr": "fre fra french", "de": "ger deu german", "es": "spa spanish", "pt": "por portuguese",
    "zh": "chi zho chinese", "ja": "jpn japanese", "ko": "kor korean", "ar": "ara arabic", "ru": "rus russian", "it": "ita italian",
    "pl": "pol polish", "tr": "tur turkish", "id": "ind indonesian", "sv": "swe swedish", "uk": "ukr ukrainian", "hu": "hun hungarian",
    "vi": "vie vietnamese", "th": "tha thai", "no": "nob nor norwegian", "da": "dan danish", "fi": "fin finnish", "nl": "dut nld dutch",
    "ca": "cat catalan", "ro": "ron rum romanian", "cs": "ces cze czech", "sk": "slk slo slovak", "hr": "hrv croatian", "sr": "srp serbian",
    "bg": "bul bulgarian", "lt": "lit lithuanian", "lv": "lav latvian", "et": "est estonian", "ms": "may msa malay", "tl": "fil tagalog",
    "ur": "urd urdu", "hi": "hin hindi", "bn": "ben bengali", "fa": "per fas persian", "he": "heb hebrew",
}
#: What stands for an unknown language.
NO_LANGUAGE = ("nan", "none", "", "unknown", "und", "un", "mis", "mul", "zxx")
#: Texts in the place of an abstract, and what is too short for one.
STOCK_ABSTRACTS = ("international audience", "editorial reviewed", "peer reviewed")
MIN_ABSTRACT, SHORT_TITLE = 30, 50


def any_contains(text: Column, words: Iterable[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return F.coalesce(out, F.lit(False))


def is_missing(x: Column) -> Column:
    """Null, blank or one of the spellings of nothing."""
    return x.isNull() | F.lower(F.trim(x)).isin("", "nan", "none")


def normalize_doi(x: Column) -> Column:
    """Without resolver prefix, lower case, trimmed; empty for null."""
    return F.coalesce(F.lower(F.trim(F.regexp_replace(F.trim(x), r"(?i)^(https?://(dx\.)?doi\.org/|doi:)", ""))), F.lit(""))


def clean_doi(x: Column) -> Column:
    """The first 10.NNNN... run anywhere, lower case; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(x, r"(10\.\d{4,}\S*)", 1)), F.lit(""))


def normalize_title(x: Column) -> Column:
    t = F.regexp_replace(F.lower(x), r"(?U)[^\w\s]", "")
    return F.coalesce(F.trim(F.regexp_replace(t, r"(?U)\s+", " ")), F.lit(""))


def ascii_words(x: Column) -> Column:
    """Lower-case ASCII letters and digits, everything else one space; for near-duplicate keys."""
    return F.coalesce(F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9 ]", " "), r"\s+", " ")), F.lit(""))


def bib_title(x: Column) -> Column:
    """Title without braces, commands and punctuation, for matching bibliography entries."""
    t = F.regexp_replace(F.regexp_replace(F.lower(x), r"\\[a-z]+", ""), r"[{}]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, "[^a-z0-9 ]", " "), " +", " "))


def strip_markup(x: Column) -> Column:
    """Tags to spaces, zero-width characters gone, white space collapsed."""
    t = F.regexp_replace(F.regexp_replace(x, "<[^>]+>", " "), "[​‌‍﻿]", "")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def invert_index(x: Column) -> Column:
    """Text of a word -> positions map (as a map column), words in the order of their positions."""
    pairs = F.flatten(F.transform(F.map_entries(x), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda s: s["w"]), " ")


def normalize_lang(x: Column) -> Column:
    """Two-letter code of a code or name; null if unknown. A region after an underscore is dropped."""
    code = F.lower(F.trim(x))
    head = F.split(code, "_")[0]
    names = F.create_map(*[F.lit(v) for k, vs in LANGUAGES.items() for n in vs.split() for v in (n, k)])
    return F.when(code.isin(*NO_LANGUAGE), None).when(F.length(code) == 2, code).when(code.contains("_") & (F.length(head) == 2), head).otherwise(F.try_element_at(names, head))


def display_lang(x: Column) -> Column:
    """Locale after a hyphen dropped, then normalised; "unknown" if that leaves nothing."""
    return F.coalesce(normalize_lang(F.split(x, "-")[0]), F.lit("unknown"))


def count_tokens(x: Column) -> Column:
    return F.when(F.coalesce(F.trim(x), F.lit("")) == "", 0).otherwise(F.size(F.filter(F.split(F.trim(x), r"\s+"), lambda t: t != "")))


def length_class(tokens: Column, most: int) -> Column:
    return F.when(tokens == 0, "missing").when(tokens > most, "too_long").otherwise("ok")


def paywall_stub(x: Column) -> Column:
    low = F.lower(x)
    return low.startswith("no access") | (low.contains("10.5751/es-") & (F.length(low) < 500)) | low.contains("not available for this content")


def clean_abstract(x: Column, least: int = 20) -> Column:
    t = strip_markup(x)
    return F.when(x.isNull() | (F.length(t) < least) | paywall_stub(t), "").otherwise(t)


def stock_abstract(abstract: Column, title: Column) -> Column:
    """Whether an abstract is none: too short, stock phrase, repository address, the title again, a stub or short capitals."""
    s = F.trim(abstract)
    low = F.lower(s)
    capitals = (F.length(s) < SHORT_TITLE) & (s == F.upper(s)) & ~((s == low) & (low != F.upper(low)))
    out = (F.length(s) < MIN_ABSTRACT) | low.isin(*STOCK_ABSTRACTS) | low.startswith("info:eu-repo/") | ((F.coalesce(title, F.lit("")) != "") & (low == F.lower(F.trim(title)))) | paywall_stub(low) | capitals
    return F.coalesce(out, F.lit(True))


def text_to_embed(title: Column, abstract: Column, keywords: Column) -> Column:
    return F.concat_ws(". ", title, F.when(~stock_abstract(abstract, title), abstract), F.replace(keywords, F.lit(";"), F.lit(", ")))


def text_hash(x: Column, digits: int = 8) -> Column:
    return F.substring(F.md5(x), 1, digits)


def cache_key(x: Column) -> Column:
    return F.substring(F.sha2(F.trim(x), 256), 1, 16)


def work_key(doi: Column, source_id: Column, title: Column) -> Column:
    return F.coalesce(F.nullif(normalize_doi(doi), F.lit("")), F.nullif(source_id, F.lit("")), F.concat(F.lit("title:"), F.md5(F.coalesce(title, F.lit("")))))


def groups_hit(x: Column, groups: Mapping[str, Iterable[str]]) -> Column:
    """In how many word groups a text has a word (of three or more a-z)."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit("([a-z]{3,})"), F.lit(1)))
    out = F.lit(0)
    for group in groups.values():
        out = out + F.coalesce(F.arrays_overlap(words, F.array(*[F.lit(w) for w in group])).cast("int"), F.lit(0))
    return out


def hits(x: Column, words: Iterable[str]) -> Column:
    """How many of the words a text contains."""
    out = F.lit(0)
    for w in words:
        out = out + F.coalesce(F.contains(F.lower(x), F.lit(w)).cast("int"), F.lit(0))
    return out


def best_class(x: Column, classes: Mapping[str, Iterable[str]], default: str | None = None) -> Column:
    """The class with most words found, the first of equals; ``default`` if nothing is found."""
    scores = F.array_sort(F.array(*[F.struct((-hits(x, ws)).alias("s"), F.lit(i).alias("i"), F.lit(c).alias("c")) for i, (c, ws) in enumerate(classes.items())]))
    return F.when(scores[0]["s"] < 0, scores[0]["c"]).otherwise(F.lit(default))


def second_class(x: Column, classes: Mapping[str, Iterable[str]], least: int = 2, within: int = 1) -> Column:
    """The runner-up, if it has ``least`` hits and is ``within`` of the best; else empty."""
    s = F.array_sort(F.array(*[F.struct((-hits(x, ws)).alias("s"), F.lit(i).alias("i"), F.lit(c).alias("c")) for i, (c, ws) in enumerate(classes.items())]))
    return F.when((s[1]["s"] <= -least) & (s[1]["s"] - s[0]["s"] <= within), s[1]["c"]).otherwise("")


def first_rule(x: Column, rules: Iterable[tuple[str, str]], default: str | Column) -> Column:
    """The name of the first pattern that a text has."""
    out = None
    for pattern, name in rules:
        out = F.when(x.rlike(pattern), name) if out is None else out.when(x.rlike(pattern), name)
    return out.otherwise(default)


def first_author(x: Column) -> Column:
    return F.lower(F.trim(F.split(F.split(x, ";")[0], ",")[0]))


def replace_all(x: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    for pattern, to in pairs:
        x = F.regexp_replace(x, f"(?i){pattern}", to)
    return x


def period(year: Column, periods: Iterable[tuple[int, int]]) -> Column:
    """Label of the period of a year; the last one for years in none."""
    out, label = None, ""
    for low, high in periods:
        label = f"{low}–{high}"
        out = F.when(year.between(low, high), label) if out is None else out.when(year.between(low, high), label)
    return out.otherwise(label)


def chunks(x: Column, size: int, overlap: int) -> Column:
    """Overlapping pieces of a text, as an array; none for an empty text."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(x) - overlap - 1, F.lit(0)), F.lit(size - overlap))
    return F.when(F.length(x) > 0, F.transform(starts, lambda i: F.substring(x, i + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def numbers(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))


def wilson(successes: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    p, z2 = successes / n, z * z
    mid, half = p + z2 / (2 * n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    return (mid - half) / (1 + z2 / n), (mid + half) / (1 + z2 / n)


def query_slug(term: Column) -> Column:
    """A search term as part of a file name."""
    return F.regexp_replace(F.regexp_replace(F.lower(term), r"(?U)[^\w]", "_"), "^_+|_+$", "")


def search_filter(term: Column, first: Column, last: Column, created: Column | None = None) -> Column:
    """The filter parameter of a works search: term, years from ``first`` to ``last``, records created since ``created``."""
    parts = [F.lit('default.search:"'), term, F.lit('"')]
    if created is not None:
        parts += [F.lit(",from_created_date:"), created]
    return F.concat(*parts, F.lit(",publication_year:>"), (first - 1).cast("string"), F.lit(",publication_year:<"), (last + 1).cast("string"))
