"""Personal data by weak supervision.

Regex, gazetteer and context labelers vote on candidate spans; expectation-maximisation over the whole corpus
estimates how reliable each labeler is; the posteriors train a final span classifier, which decides on every
candidate that the plain patterns do not settle. Base spans (the plain patterns with their checks) always stay.

Votes and features are small integers, so the corpus is summed up as counts of (kind, votes, shape) patterns. Their
number is bounded by the labelers, not by the data, and those counts, over all documents, are all that EM and the
classifier need: they run on the driver over a few hundred rows.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

KINDS = ("email", "ip", "card", "phone")

# Possessive quantifiers and the look-behind change no match: a run of the leading class is taken whole or not at all.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Candidates beyond the base patterns. Every repeat is possessive or bounded and none is tried from inside its own run, so scans
# are linear in the text.
_AT = re.compile(r"\(at\)|\[at\]|\{at\}| at |@")
_SPELT_DOMAIN = re.compile(r" ?[A-Za-z0-9-]++(?:(?: ?(?:\(dot\)|\[dot\]|\{dot\}) ?| dot |\.)[A-Za-z0-9-]++)+")
_V6 = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){1,7}(?::(?:[0-9A-Fa-f]{1,4}:){0,6})?[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+().-])(?:00[1-9][0-9]{0,2}[ -])?(?:\([0-9]{2,5}\)[ -]?|[0-9]{2,5}[ .-])[0-9]{3,4}(?:[ .-]?[0-9]{2,4}){1,2}(?![0-9A-Za-z-])")

# Gazetteers and context words: fixed values.
_TOP_DOMAINS = frozenset(
    "com org net edu gov mil int info biz name pro io co ai app dev me tv cc xyz online site tech store blog cloud eu uk de fr es it nl be ch at pl cz sk hu ro bg gr pt ie dk se no fi is ee lv lt ru ua by tr il ae sa eg za ng ke ma in pk bd lk cn jp kr tw hk sg my th vn id ph au nz us ca mx br ar cl pe ve uy ec bo py cr pa do".split()
)
_CALLING_CODES = frozenset(
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 211 212 213 216 218 220 221 225 233 234 237 243 244 249 250 251 254 255 256 260 263 264 351 352 353 354 355 356 357 358 359 370 371 372 373 374 375 376 377 380 381 382 385 386 387 389 420 421 423 501 502 503 504 505 506 507 509 591 593 595 597 598 852 853 855 856 880 886 961 962 963 964 965 966 967 968 971 972 973 974 975 976 977 992 993 994 995 996 998".split()
)
_CONTEXT = {
    "email": re.compile(r"(?i)e-?mail|contact|write to|reply|mailto|reach|address"),
    "ip": re.compile(r"(?i)\bip(?:v[46])?\b|address|host|server|client|login|subnet|gateway|ping"),
    "card": re.compile(r"(?i)card|visa|master|amex|payment|billing|cvv|credit|debit"),
    "phone": re.compile(r"(?i)\btel|phone|call|mobile|\bcell|fax|sms|dial|whatsapp"),
}
_AGAINST = re.compile(r"(?i)version|\bv[0-9]|section|token|key|isbn|issn|doi|order|invoice|figure|\bid\b|serial|score|tracking|part no|ratio|time")
#: What each labeler looks at: the span's form, its check, gazetteers, words around it, words against it, its edges. None knows
#: whether the span is one of the base patterns. Votes: 0 abstains, 1 for, 2 against.
LABELERS = ("form", "check", "gazetteer", "context", "against", "edges")


def luhn(digits: str) -> bool:
    """The usual checksum over a string of ASCII digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches. Each needs an @, so only the characters around one are looked at."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> tuple[list[tuple[int, int]], ...]:
    """Spans of each kind in KINDS order, by code points, after the checks of each kind."""
    mail = list(emails(text)) if "@" in text else []
    if not _DIGIT.search(text):
        return mail, [], [], []
    ip = [m.span() for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))] if "." in text else []
    card = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(d) <= 19 and luhn(d):
                card.append(m.span())
    phone = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15] if "+" in text else []
    return mail, ip, card, phone


def _spelt(text: str) -> Iterator[tuple[int, int]]:
    """Addresses written out, anchored at their ``at``: runs before it can't reach over an earlier one."""
    end = 0
    for m in _AT.finditer(text):
        start = m.start() - (m.start() > end and text[m.start() - 1] == " " and m[0][0] in "([{")
        low = start
        while low > end and text[low - 1] in _LOCAL:
            low -= 1
        if low < start and (d := _SPELT_DOMAIN.match(text, m.end())):
            yield low, d.end()
            end = d.end()


def _other(text: str, base) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of candidates that overlap no base span."""
    found = []
    if " at " in text or "(at)" in text or "[at]" in text or "{at}" in text or "@" in text:
        found += [(0, *s) for s in _spelt(text)]
    if ":" in text:
        found += [(1, *m.span()) for m in _V6.finditer(text) if m[0].count(":") >= 3 or "::" in m[0]]
    if _DIGIT.search(text):
        found += [(2, *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(_NOT_DIGIT.sub("", m[0])) <= 19]
        found += [(3, *m.span()) for m in _LOCAL_PHONE.finditer(text) if 7 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    if not found:
        return
    taken = sorted(s for spans in base for s in spans)
    starts = [s for s, _ in taken]
    reach = list(itertools.accumulate((e for _, e in taken), max))  # spans of different kinds may overlap
    for k, a, b in found:
        i = bisect.bisect_left(starts, b)
        if not i or reach[i - 1] <= a:
            yield k, a, b


def _form(kind: int, span: str) -> int:
    if kind == 0:
        return 1 if "@" in span or "(" in span or "[" in span or "{" in span or " dot " in span else 2
    if kind == 1:
        parts = span.split(".")
        return 1 if len(parts) == 4 and all(p == "0" or p[:1] != "0" for p in parts) or span.count(":") == 7 and "::" not in span or span.count("::") == 1 and span.count(":") < 8 else 2
    if kind == 2:
        groups = [len(g) for g in re.split("[ -]", span)]
        return 1 if groups in ([16], [15], [4, 4, 4, 4], [4, 6, 5], [13], [14], [4, 6, 4], [19]) else 2
    return 1 if span[:1] in "+(" or re.fullmatch(r"(?:00)?[0-9]{2,5}[ .-][0-9]{3}[ .-]?[0-9]{4}", span) else 0


def _check(kind: int, span: str, digits: str) -> int:
    if kind == 0:
        local = re.split(r"@|[(\[{]| at ", span)[0].strip()
        return 2 if not local or local[0] in ".-" or local[-1] == "." or ".." in local or "-." in span or ".-" in span else 1
    if kind == 1:
        if ":" in span:
            return 1 if any(c in "abcdefABCDEF" for c in span) or span.count(":") == 7 else 2
        return 2 if int(span.split(".")[0] or 0) in (0, *range(240, 256)) else 1
    if kind == 2:
        return 1 if luhn(digits) and len(set(digits)) > 2 else 2
    return 1 if 9 <= len(digits) <= 15 else 0 if len(digits) >= 7 else 2


def _gazetteer(kind: int, span: str, digits: str) -> int:
    if kind == 0:
        return 1 if re.split(r"[^A-Za-z0-9-]+", span.rstrip(")]} "))[-1].lower() in _TOP_DOMAINS else 2
    if kind == 1:
        return 1 if re.match(r"(?i)10\.|127\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|192\.168\.|fe80|2[0-9a-f]{3}:|fd|fc", span) else 0
    if kind == 2:  # issuers' ranges and the lengths they use
        n, lead = len(digits), int(digits[:4])
        known = digits[0] == "4" and n in (13, 16, 19) or (51 <= lead // 100 <= 55 or 2221 <= lead <= 2720) and n == 16 or lead // 100 in (34, 37) and n == 15 or (lead == 6011 or lead // 100 == 65 or 644 <= lead // 10 <= 649) and n >= 16 or 3528 <= lead <= 3589 and n == 16 or lead // 100 in (30, 36, 38, 39) and n == 14
        return 1 if known else 2
    if span.startswith(("+", "00")):
        number = digits.removeprefix("00") if span.startswith("00") else digits
        return 1 if any(number[:i] in _CALLING_CODES for i in (1, 2, 3)) else 2
    return 0


def votes(text: str, kind: int, a: int, b: int) -> tuple[int, ...]:
    """What each labeler says of a span."""
    span = text[a:b]
    digits = _NOT_DIGIT.sub("", span)
    near, after = text[max(0, a - 40) : a], text[b : b + 20]
    context = 1 if _CONTEXT[KINDS[kind]].search(near) or _CONTEXT[KINDS[kind]].search(after) else 0
    against = 2 if _AGAINST.search(near[-25:]) else 0
    edges = 1 if (a == 0 or not text[a - 1].isalnum()) and (b == len(text) or not text[b].isalnum()) else 2
    return _form(kind, span), _check(kind, span, digits), _gazetteer(kind, span, digits), context, against, edges


def shape(text: str, a: int, b: int) -> int:
    """A few bits of form: separators, brackets, length."""
    span = text[a:b]
    return (" " in span) | ("-" in span) << 1 | ("(" in span) << 2 | (b - a > 20) << 3


_DOC = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base", pa.string()), ("spans", pa.list_(pa.int64())), ("codes", pa.list_(pa.int32()))])


def _code(kind: int, vote: tuple[int, ...], form: int) -> int:
    code = kind
    for v in vote:
        code = code * 3 + v
    return code * 16 + form


def _decode(code: int) -> tuple[int, tuple[int, ...], int]:
    form, code = code % 16, code // 16
    vote = []
    for _ in LABELERS:
        vote.append(code % 3)
        code //= 3
    return code, tuple(reversed(vote)), form


def candidates(docs: DataFrame) -> DataFrame:
    """A row for each document: base counts and text, and every candidate as start, end (in spans) and pattern code."""

    def of(batches):
        for b in batches:
            out = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), C.texts(b), strict=True):
                base = base_spans(text)
                spans, codes = [], []
                for k, found in enumerate(base):
                    for s in found:
                        spans += s
                        codes.append(_code(k, votes(text, k, *s), shape(text, *s)))
                for k, *s in _other(text, base):
                    spans += s
                    codes.append(_code(k, votes(text, k, *s), shape(text, *s)))
                out.append((doc_id, *map(len, base), ",".join(f"{KINDS[k]}:{x}:{y}" for k, found in enumerate(base) for x, y in found), spans, codes))
            yield C.rows_out(_DOC, zip(*out, strict=True) if out else [[]] * 8)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(of, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans array<long>, codes array<int>")


def estimate(vote: np.ndarray, count: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, float]:
    """Dawid-Skene EM over vote patterns (0, 1 for, 2 against) with their counts.

    Returns each pattern's posterior, the labelers' tables p(vote | class) of shape (labelers, 2, 3), and the prior.
    It starts from the majority vote; counts of 1/2 keep every estimate inside (0, 1).
    """
    n = len(count)
    yes, no = (vote == 1).sum(1), (vote == 2).sum(1)
    post = (yes + 0.5) / (yes + no + 1.0)
    tables, prior = np.full((vote.shape[1], 2, 3), 1 / 3), 0.5
    for _ in range(rounds):
        both = np.stack([(1 - post) * count, post * count])
        prior = (both[1].sum() + 0.5) / (count.sum() + 1.0)
        for j in range(vote.shape[1]):
            for v in range(3):
                tables[j, :, v] = both[:, vote[:, j] == v].sum(1) + 0.5
            tables[j] /= tables[j].sum(1, keepdims=True)
        log = np.tile(np.log([1 - prior, prior]), (n, 1))
        for j in range(vote.shape[1]):
            log += np.log(tables[j][:, vote[:, j]].T)
        post = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
    return post, tables, float(prior)


def train(codes: list[int], counts: list[int], l2: float = 1.0, rounds: int = 200) -> dict[int, float]:
    """Span probabilities by pattern: EM posteriors by kind are the soft labels of a logistic regression over kind,
    votes and shape (one-hot), fitted with Newton steps on counts."""
    if not codes:
        return {}
    parts = [_decode(c) for c in codes]
    kind, vote, form = np.array([p[0] for p in parts]), np.array([p[1] for p in parts]), np.array([p[2] for p in parts])
    count = np.array(counts, float)
    soft = np.empty(len(codes))
    for k in np.unique(kind):
        soft[kind == k] = estimate(vote[kind == k], count[kind == k])[0]
    cols = [np.ones(len(codes))] + [(kind == k) * 1.0 for k in range(4)] + [(vote[:, j] == v) * 1.0 for j in range(vote.shape[1]) for v in (1, 2)] + [((form >> i) & 1) * 1.0 for i in range(4)]
    x, w = np.stack(cols, 1), np.zeros(len(cols))
    count = count / count.sum() * min(count.sum(), 1e6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (count * (p - soft)) + l2 * w
        hess = (x * (count * p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return dict(zip(codes, (1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))).tolist(), strict=True))


def find_pii(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_added, for every row.

    Spans are ``kind:start:end`` by kind in KINDS order, then start, by code points with the end exclusive. Null or empty
    text has no spans (and the hash of an empty string). Repeated rows give repeated rows, an empty table none; columns
    besides doc_id and text are not looked at. Long texts are scanned whole, in time linear in their length but for one sort of
    their spans. Spans of one kind never overlap base spans of any kind; ties (equal starts) go by kind, then end.
    """
    found = C.saved(candidates(docs))
    seen = found.select(F.explode("codes").alias("code")).groupBy("code").count().orderBy("code").collect()
    chance = docs.sparkSession.sparkContext.broadcast(train([r[0] for r in seen], [r[1] for r in seen]))
    schema = pa.schema([*list(_DOC)[:5], ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])

    def of(batches):
        for b in batches:
            base = b.column("base").to_pylist()
            every, added = [], []
            for spans, codes, text in zip(b.column("spans").to_pylist(), b.column("codes").to_pylist(), base, strict=True):
                n_base, got = text.count(",") + 1 if text else 0, []
                for i, code in enumerate(codes):
                    if i < n_base or chance.value.get(code, 0.0) >= threshold:
                        got.append((_decode(code)[0], spans[2 * i], spans[2 * i + 1]))
                every.append(",".join(f"{KINDS[k]}:{x}:{y}" for k, x, y in sorted(got)))
                added.append(len(got) - n_base)
            yield C.rows_out(schema, [*[b.column(i) for i in range(5)], [hashlib.sha256(t.encode()).hexdigest() for t in base], every, added])

    return found.mapInArrow(of, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
