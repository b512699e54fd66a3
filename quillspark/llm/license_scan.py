"""License scans: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

Fingerprints (hashes of GRAM tokens, the least of each window of WINDOW) of all templates are an inverted index of checked size,
since templates are a parameter and not data. A document's fingerprints, winnowed the same way, hit it; hits of one template on
about one diagonal are a candidate place, where a banded alignment of template against text counts matched tokens and is traced
back to the first and last of them. Text and template that share GRAM + WINDOW - 1 tokens in a row share a fingerprint.
"""

from __future__ import annotations

import bisect
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from . import common as C
from .license_texts import templates as production_templates

GRAM, WINDOW, BAND = 3, 2, 2
#: Most templates' tokens that the broadcast index may hold.
INDEX_TOKENS = 200_000
_TOKEN = re.compile(rb"[a-z0-9\x80-\xff]+")


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _Hashes()


def tokens(text: bytes) -> tuple[list[bytes], bytes]:
    low = text.lower()
    return _TOKEN.findall(low), low


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def grams(h: np.ndarray) -> np.ndarray:
    n = len(h) - GRAM + 1
    if n < 1:
        return np.zeros(0, np.int64)
    out = np.zeros(n, np.int64)
    for i in range(GRAM):
        out = C.mixed(out ^ h[i : i + n].astype(np.int64))
    return out


def winnow(g: np.ndarray) -> np.ndarray:
    """Positions of the least gram of each window of WINDOW, the rightmost on ties; of all grams if there are fewer."""
    n = len(g)
    if n <= WINDOW:
        return np.unique([n - 1 - int(np.argmin(g[::-1]))]) if n else np.zeros(0, np.int64)
    w = np.lib.stride_tricks.sliding_window_view(g, WINDOW)[:, ::-1]
    return np.unique(np.arange(len(w)) + WINDOW - 1 - np.argmin(w, 1))


def align(template: np.ndarray, text: np.ndarray, width: int, near: int = 0) -> tuple[int, int, int]:
    """(matched tokens, first, end) of the longest common subsequence of ``template`` and ``text`` in which template token i meets
    text tokens i to i + width - 1 only; ``first`` and ``end`` are those of the matched text tokens. Among equally long ones that
    match the template's last token it ends nearest to offset ``near``, else as early as it can; traced back, it begins as late
    as it can."""
    m, n = len(template), len(text)
    score = np.zeros((m + 1, width + 1), np.int32)  # the last column stands for no text beyond the band
    padded = np.concatenate([text, np.full(max(0, m + width - n), -1, text.dtype)])
    same = np.lib.stride_tricks.sliding_window_view(padded, width)[:m] == template[:, None]
    for i in range(m):
        score[i + 1, :width] = np.maximum.accumulate(np.maximum(score[i, :width] + same[i], score[i, 1:]))
        score[i + 1, width] = 0
    best = int(score[m, :width].max())
    if not best:
        return 0, 0, 0
    last = np.flatnonzero(same[m - 1] & (score[m - 1, :width] + 1 == best))
    d = int(last[np.argmin(np.abs(last - near))]) if len(last) else int(np.argmax(score[m, :width]))
    i, first, end = m, 0, 0
    while i and score[i, d]:
        now = score[i, d]
        if same[i - 1, d] and now == score[i - 1, d] + 1:  # template token i - 1 meets text token i - 1 + d
            first, end = i - 1 + d, end or i + d
            i -= 1
        elif now == score[i - 1, d + 1]:
            i, d = i - 1, d + 1
        elif d and now == score[i, d - 1]:
            d -= 1
        else:
            i -= 1
    return best, first, end


class Scanner:
    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        self.words = [hashes(tokens(t.encode())[0]).astype(np.int64) for t in templates.values()]
        if sum(map(len, self.words)) > INDEX_TOKENS:
            raise ValueError("templates exceed the size that is broadcast")
        index: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.need, self.band = [], [max(BAND, len(w) // 6) for w in self.words]
        for t, w in enumerate(self.words):
            g = grams(w)
            at = winnow(g)
            self.need.append(max(1, len(at) // 8))  # hits on two neighbouring diagonals that make a candidate
            for p in at:
                index[int(g[p])].append((t, int(p)))
        self.index = dict(index)
        self.bits = np.zeros(1 << 16, bool)
        self.bits[np.array(list(index), np.int64) & 0xFFFF] = True

    def scan(self, text: bytes, coverage: float) -> list[tuple[str, int, int, int, int]]:
        """(name, matched, size, first byte, end byte) of every place with enough coverage; of places that overlap the one with
        most matched tokens after two off for each missing one, ties to the larger template, the earlier place, the earlier name."""
        words, low = tokens(text)
        if len(words) < GRAM:
            return []
        h = hashes(words).astype(np.int64)
        g = grams(h)
        at = winnow(g)
        hits: dict[tuple[int, int], int] = defaultdict(int)
        for p in at[self.bits[g[at] & 0xFFFF]]:
            for t, q in self.index.get(int(g[p]), ()):
                hits[t, (int(p) - q) // self.band[t]] += 1
        found = []
        for (t, k), n in hits.items():
            if n + hits.get((t, k + 1), 0) < self.need[t]:
                continue
            w, band = self.words[t], self.band[t]
            lo = (k - 1) * band  # where the band begins; positions before the text match nothing
            part = h[max(0, lo) : max(0, lo + len(w) + 4 * band)]
            if lo < 0:
                part = np.concatenate([np.full(-lo, -1, np.int64), part])
            score, a, b = align(w, part, 4 * band, band + band // 2)
            if score and score >= coverage * len(w):
                found.append((t, score, len(w), lo + a, lo + b))
        found.sort(key=lambda x: (2 * (x[2] - x[1]) - x[1], -x[2], x[3], x[0]))
        starts: list[int] = []
        kept: list[tuple] = []  # apart from each other, in text order
        for x in found:
            i = bisect.bisect_right(starts, x[3])
            if (i == 0 or kept[i - 1][4] <= x[3]) and (i == len(kept) or x[4] <= kept[i][3]):
                starts.insert(i, x[3])
                kept.insert(i, x)
        if not kept:
            return []
        spans = [m.span() for m in _TOKEN.finditer(low)]
        return [(self.names[t], s, n, spans[a][0], spans[b - 1][1]) for t, s, n, a, b in kept]


_OUT = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("matched", pa.int64()), ("size", pa.int64()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())])


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = 0.8) -> DataFrame:
    """doc_id, license, matched, size, coverage, start, end: a row for each place in a text that covers a template (of
    ``templates``, label to text; those of license_texts if not given). Places of one document don't overlap.

    Tokens are runs of ASCII letters (any case), digits and bytes above 127. ``start`` and ``end`` (exclusive) are code points.
    A document without license text, or with a null or empty one, gives no rows; repeated rows repeat; an empty table gives
    none; rows that repeat an id are scanned each; other columns are not looked at. Whole texts are scanned, in time linear in
    their length and, where a template repeats, in its places.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(production_templates() if templates is None else templates))

    def of(batches):
        for b in batches:
            out = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), C.text_bytes(b), strict=True):
                for name, matched, size, a, z in shared.value.scan(text, coverage):
                    start = len(text[:a].decode("utf-8", "ignore"))
                    out.append((doc_id, name, matched, size, matched / size, start, start + len(text[a:z].decode("utf-8", "ignore"))))
            if out:
                yield C.rows_out(_OUT, zip(*out, strict=True))

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(of, "doc_id long, license string, matched long, size long, coverage double, start long, end long")
