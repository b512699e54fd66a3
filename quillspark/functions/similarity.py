"""String similarities that columns can't express, over Arrow batches."""

from __future__ import annotations

import difflib
import functools
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    if a == b:
        return len(a)
    same = 0
    while same < min(len(a), len(b)) and a[same] == b[same]:
        same += 1
    a, b = a[same:], b[same:]
    if not a or not b:
        return same
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return same + len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """0 to 100: twice the common subsequence over both lengths."""
    return 100.0 * 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def short_ratios(x: list[str], y: list[str], least: float, same: bool = False, cells: int = 4_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in ``x`` and ``y`` and ``ratio`` of all pairs that reach ``least``, of strings up to 64 characters; ``same``: x and y
    are one list, each pair of places once. Pairs fall out by lengths and by counts of characters, the rest is done together."""
    if not x or not y:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    order = np.argsort([len(s) for s in y], kind="stable")
    text = np.array([*x, *(y[i] for i in order)], "U64")
    known, code = np.unique(text.view(np.uint32).reshape(len(text), -1), return_inverse=True)
    code, pad = code.reshape(len(text), -1), known == 0
    size = (~pad)[code].sum(axis=1)
    held = np.zeros((32, len(text)), np.uint8)
    for p in range(code.shape[1]):
        at = np.flatnonzero(size > p)
        held[known[code[at, p]] % 32, at] += 1
    a, b, hx, hy, cx, cy = size[: len(x)], size[len(x) :], held[:, : len(x)], held[:, len(x) :], code[: len(x)], code[len(x) :]
    percent = lambda n, total: np.where(total > 0, 200.0 * n / np.maximum(total, 1), 100.0)
    out, step = [], max(1, cells // len(known))
    for lo in range(0, len(x), step):
        mask = np.zeros((min(step, len(x) - lo), len(known)), np.uint64)
        rows = np.arange(len(mask))
        for p in range(cx.shape[1]):
            mask[rows, cx[lo : lo + step, p]] |= np.uint64(1 << p)
        mask[:, pad] = 0
        pairs = []
        for i in range(lo, lo + len(mask)):
            near = np.flatnonzero(percent(np.minimum(np.arange(65), a[i]), np.arange(65) + a[i]) >= least)
            f, t = np.searchsorted(b, near[0], "left"), np.searchsorted(b, near[-1], "right")
            common = np.minimum(hy[:, f:t], hx[:, i : i + 1]).sum(axis=0, dtype=np.uint8)
            j = f + np.flatnonzero(percent(common.astype(np.int64), a[i] + b[f:t]) >= least)
            pairs.append((np.full(len(j), i), j) if not same else (np.full((order[j] > i).sum(), i), j[order[j] > i]))
        every = [np.concatenate(v) for v in zip(*pairs, strict=True)]
        for s in range(0, len(every[0]), 100_000):
            i, j = every[0][s : s + 100_000], every[1][s : s + 100_000]
            row = np.full(len(i), ~np.uint64(0))
            for p in range(int(b[j].max())):
                hit = row & mask[i - lo, cy[j, p]]
                row = (row + hit) | (row - hit)
            full = np.where(a[i] == 64, ~np.uint64(0), (np.uint64(1) << (a[i] % 64).astype(np.uint64)) - np.uint64(1))
            score = percent(np.bitwise_count(~row & full).astype(np.int64), a[i] + b[j])
            ok = score >= least
            out.append((i[ok], order[j[ok]], score[ok]))
    return tuple(np.concatenate(v) for v in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


@functools.lru_cache(4096)
def sorted_tokens(a: str) -> str:
    return " ".join(sorted(re.findall(r"\w+", a.lower())))


@F.pandas_udf(T.DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio(sorted_tokens(x), sorted_tokens(y)) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.StringType())
def token_sorted(a: pd.Series) -> pd.Series:
    return a.map(lambda x: None if x is None else sorted_tokens(x))


@F.pandas_udf(T.DoubleType())
def subsequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def ratios(a: list[str], b: list[str], longest: int = 1_500, cells: int = 2_000_000) -> np.ndarray:
    """``ratio`` of each pair. Pairs up to ``longest`` characters are done together, those of like length at once: rows of bits as
    numbers of 63 bits, the last one free for the carry."""
    la, lb = (np.array([len(s) for s in v], np.int64) for v in (a, b))
    out = np.full(len(a), 100.0)
    together = np.flatnonzero((np.maximum(la, lb) <= longest) & (la + lb > 0))
    for i in np.flatnonzero(np.maximum(la, lb) > longest):
        out[i] = ratio(a[i], b[i])
    together, at = together[np.argsort(la[together], kind="stable")], 0
    low = np.uint64((1 << 63) - 1)
    while at < len(together):
        n = 1_024
        while True:  # fewer at once where there are many characters
            g = together[at : at + n]
            x, y = (np.array([v[i] for i in g], f"U{max(1, size[g].max())}").view(np.uint32).reshape(len(g), -1) for v, size in ((a, la), (b, lb)))
            seen = np.zeros(0x110000, bool)
            seen[x], seen[y], seen[0] = True, True, True
            limbs, known = -(-x.shape[1] // 63), int(seen.sum())
            if len(g) * limbs * known <= cells or n == 1:
                break
            n = max(1, min(n // 2, cells // (limbs * known)))
        code = np.cumsum(seen, dtype=np.int32) - 1
        x, y, rows = code[x], code[y].T.copy(), np.arange(len(g)) * known
        mask = np.zeros((limbs, len(g) * known), np.uint64)
        for p in range(x.shape[1]):
            mask[p // 63, rows + x[:, p]] |= np.uint64(1 << p % 63)
        mask[:, rows] = 0  # fills the shorter ones
        row = np.full((limbs, len(g)), low)
        for p in range(len(y)):
            hit, carry = row & mask.take(rows + y[p], axis=1), None
            sums = row + hit
            row -= hit
            for w in range(limbs):
                if carry is not None:
                    sums[w] += carry
                carry = sums[w] >> np.uint64(63)
            sums &= low
            row |= sums
        found = 63 * limbs - np.bitwise_count(row).sum(axis=0, dtype=np.int64)
        out[g] = 200.0 * found / (la[g] + lb[g])
        at += len(g)
    return out


@F.pandas_udf(T.DoubleType())
def sorted_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """``ratio`` of texts whose tokens are in order already."""
    return pd.Series(ratios(a.tolist(), b.tolist()), dtype="float64")


@F.pandas_udf(T.DoubleType())
def title_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    clean = lambda s: re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", (s or "").lower())).strip()
    return pd.Series([difflib.SequenceMatcher(None, clean(x), clean(y)).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.StringType())
def repair_text(x: pd.Series) -> pd.Series:
    """Text that was decoded with the wrong table or escaped twice, put right where that is certain."""
    import html

    def one(s):
        if s is None:
            return None
        if re.search("[ÃÂâ][-¿€-™]", s):
            for table in ("cp1252", "latin-1"):
                try:
                    s = s.encode(table).decode("utf-8")
                    break
                except UnicodeError:
                    continue
        s = html.unescape(html.unescape(s))
        return re.sub(r"\s+", " ", re.sub("[​‌‍﻿]", "", s).replace("\\n", " ")).strip()

    return x.map(one)


#: Frequent words of each language.
STOP_WORDS = {
    "en": "the of and to in is that for it with as on be this are by an from", "fr": "le la les de des et en un une du que est pour dans sur par avec au aux qui",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine", "es": "el la los las de y en que un una por con para del se al es lo",
}


def detect_language(text, least: int = 20):
    """Language with most of its frequent words in a text; null below ``least`` characters or without any. Native."""
    words = F.split(F.lower(text), r"[^\p{L}]+")

    def found(known: str):
        return F.size(F.filter(words, lambda w: w.isin(*known.split())))

    scores = F.array(*[F.struct((-found(v)).alias("s"), F.lit(k).alias("c")) for k, v in STOP_WORDS.items()])
    best = F.array_sort(scores)[0]
    return F.when((F.length(F.trim(text)) >= least) & (best["s"] < 0), best["c"])
