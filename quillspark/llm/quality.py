"""Quality by Bradley-Terry pairwise ranking.

A document's strength is a linear function of its features. Preference pairs (a document marked good over one marked
bad) fit it by logistic loss on feature differences; the strength at which the training sample's lower quantile ends
is the threshold. Features read the whole text: byte classes, words, repeats and lines.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Labelled rows that training looks at, chosen by hash of the id.
SAMPLE_ROWS = 16_000
PAIRS = 120_000
ACCEPT = 0.7

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "stop": b".,;:'?\"()-",
    "bang": b"!",
    "symbol": b"#$%&*@^~+=_",
    "bar": b"|<>{}[]\\/`",
    "blank": b" \t\r\x0b\x0c",
    "line": b"\n",
    "high": bytes(range(128, 256)),
}
_PLACE = np.zeros((256, len(_CLASSES)))
for _i, _v in enumerate(_CLASSES.values()):
    _PLACE[list(_v), _i] = 1.0
FEATURES = (*_CLASSES, "size", "words", "word_length", "distinct", "top_word", "twice", "twice_lines", "line_length", "short_lines", "entropy", "last")


def features(text: bytes) -> list[float]:
    """Shares and logs, all of them about 0 to 10; zeros for an empty text."""
    n = len(text)
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = (counts @ _PLACE) / n
    p = counts[counts > 0] / n
    seen = Counter(words)
    k = len(words)
    twice = sum(map(bytes.__eq__, words, words[1:])) / k
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [
        *np.sqrt(shares).tolist(), math.log1p(n), math.log1p(k), n / k / 4, len(seen) / k, math.sqrt(max(seen.values()) / k), math.sqrt(twice), 1 - len(set(lines)) / len(lines),
        math.log1p(n / len(lines)), sum(len(x) < 40 for x in lines) / len(lines), float(-(p * np.log2(p)).sum()), float(lines[-1].rstrip()[-1:] in (b".", b"!", b"?")),
    ]


def _featured(docs: DataFrame, extra: list[str]) -> DataFrame:
    kinds = dict(docs.dtypes)
    schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in extra], ("x", pa.list_(pa.float64()))])

    def of(batches):
        for b in C.cut(batches):
            yield C.rows_out(schema, [b.column("doc_id").cast(pa.int64()), *[b.column(c).cast(pa.int64()) for c in extra], [features(t) for t in C.text_bytes(b)]])

    assert all(c in kinds for c in extra)
    return docs.select("doc_id", "text", *extra).mapInArrow(of, ", ".join(["doc_id long", *[f"{c} long" for c in extra], "x array<double>"]))


class BradleyTerry:
    """Weights over standardised features, and where on the strength scale the accepted share begins."""

    def __init__(self, mean, scale, weights, threshold: float, slope: float, accept: float = ACCEPT):
        self.mean, self.scale, self.weights, self.threshold, self.slope, self.accept = mean, scale, weights, threshold, slope, accept

    @classmethod
    def fit(cls, x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, reject: float | None = None, l2: float = 1.0, seed: int = 11, accept: float = ACCEPT) -> BradleyTerry:
        """``reject``: share of the training rows below the threshold; their share of bad labels if not given.

        With one kind of label only there are no pairs: all weights are 0 and every score is 0.5.
        """
        d = x.shape[1]
        mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(d), np.ones(d))
        z = np.clip((x - mean) / scale, -8, 8)
        up, down = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
        if not len(up) or not len(down):
            return cls(mean, scale, np.zeros(d), 0.0, 1.0, 0.5)
        r = np.random.default_rng(seed)
        diff = z[r.choice(up, pairs)] - z[r.choice(down, pairs)]
        w = np.zeros(d)
        for _ in range(50):  # Newton steps on mean log(1 + exp(-w . diff))
            p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
            grad = -diff.T @ p + l2 * w
            hess = (diff * (p * (1 - p))[:, None]).T @ diff + (l2 + 1e-6) * np.eye(d)
            step = np.linalg.solve(hess, grad)
            w -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
            if np.abs(step).max() < 1e-6:
                break
        s = z @ w
        threshold = float(np.quantile(s, len(down) / len(s) if reject is None else reject))
        spread = float(np.median(s[up]) - np.median(s[down]))
        return cls(mean, scale, w, threshold, 4.0 / spread if spread > 0 else 1.0, accept)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return self.score(np.array([features(t) for t in texts]).reshape(len(texts), len(FEATURES)))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Rising in strength, from 0 to 1, and ``accept`` at the threshold."""
        s = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights
        start = math.log(self.accept / (1 - self.accept))
        return 1 / (1 + np.exp(-np.clip(self.slope * (s - self.threshold) + start, -30, 30)))


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, **options) -> BradleyTerry:
    """Learns from at most ``rows`` rows of ``labels`` (doc_id, quality), chosen by hash of the id; null labels are left out.
    Labels or documents that repeat an id count once for each label, with the least of their features, so that what reaches the
    driver is bounded by ``rows``. Texts of any length are read whole. An empty table, or labels of one kind only, give a model
    that scores everything 0.5."""
    some = labels.where("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").alias("_id"), F.col("quality").cast("long").alias("quality"))
    some = some.distinct().orderBy(F.xxhash64("_id"), "_id", "quality").limit(rows)
    found = _featured(docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("_id")), ["quality"])
    found = found.groupBy("doc_id", "quality").agg(F.min("x").alias("x")).toArrow()
    if not found.num_rows:
        return BradleyTerry.fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    order = np.lexsort((found.column("quality").to_numpy(), found.column("doc_id").to_numpy()))
    x = np.array(found.column("x").to_pylist())[order]
    return BradleyTerry.fit(x, found.column("quality").to_numpy()[order], **options)


def score_quality(docs: DataFrame, model: BradleyTerry) -> DataFrame:
    """doc_id, score for every row of ``docs`` (doc_id, text). Null text counts as empty; an empty text gets the score of
    all-zero features. Texts of any length are read whole; equal texts have equal scores. Repeated rows repeat; an empty table
    gives none; other columns are not looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def of(batches):
        for b in C.cut(batches):
            yield C.rows_out(schema, [b.column("doc_id").cast(pa.int64()), shared.value.scores(C.text_bytes(b))])

    return docs.select("doc_id", "text").mapInArrow(of, "doc_id long, score double")


def accepted(docs: DataFrame, model: BradleyTerry, accept: float = ACCEPT) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``accept``, with all their columns: each row is judged by its own text, so
    rows that repeat an id don't answer for each other. No shuffle; otherwise as ``score_quality``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(texts: pa.Array) -> pa.Array:
        every = [x or b"" for x in texts.cast(pa.binary()).to_pylist()]
        return pa.array(shared.value.scores(every), pa.float64())

    return docs.where(F.arrow_udf(scored, "double")(F.col("text").cast("string")) >= accept)
