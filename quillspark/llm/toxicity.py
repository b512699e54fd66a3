"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Presence of words, word pairs and pairs with one word between, hashed to 2**bits slots. FTRL-proximal gives every
coordinate its own rate and L1 leaves few non-zero weights, which are what scoring tasks get. Training reads a sample of
labelled rows that is bounded in rows and in features, in one task that goes over it row by row as FTRL does; L1 is chosen
among a few values by the loss on a fifth of that sample. Scoring reads every whole text.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BITS = 20
#: Labelled rows that training looks at: so many of either label at most, chosen by hash of the id, and no more than
#: NEGATIVES of label 0 for each of label 1.
SAMPLE_ROWS = {1: 5_000, 0: 9_000}
NEGATIVES = 2
#: Features (4 bytes each) of all training rows together; rows of whole texts are taken in order of the hash while they fit.
SAMPLE_SLOTS = 60_000_000
#: Values of L1 to choose from, and how often each goes over its part of the sample.
L1, TRIAL_EPOCHS = (1.0, 2.0, 4.0, 8.0, 15.0), 2
_TOKEN = re.compile(rb"[a-z0-9\x80-\xff]+")


class _Hashes(dict):
    """Word -> 32-bit hash, kept for the words seen; emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = zlib.crc32(word)
        return h


_HASHES = _Hashes()


def slots(text: bytes, bits: int = BITS) -> np.ndarray:
    """Slots of the features in a text; they may repeat. Slot 0 is the bias and is not among them."""
    words = _TOKEN.findall(text.lower())
    if not words:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    pair = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    skip = h[:-2] * np.uint64(0x165667B19E3779F9) + h[2:] * np.uint64(0x27D4EB2F165667C5)
    every = np.concatenate([h * np.uint64(0xFF51AFD7ED558CCD), pair, skip]) >> np.uint64(64 - bits)
    return np.maximum(every.astype(np.int64), 1)


class Ftrl:
    """FTRL-proximal: z and n for each coordinate; a weight is 0 while |z| is at most l1."""

    def __init__(self, bits: int = BITS, alpha: float = 1.0, beta: float = 1.0, l1: float = 15.0, l2: float = 1.0):
        self.bits, self.alpha, self.beta, self.l1, self.l2 = bits, alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-min(max(w.sum(), -30.0), 30.0))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g

    def compact(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(np.abs(self.z) > self.l1)
        return at, self.weights(at)


def _learned(rows: np.ndarray, at: list, label: np.ndarray, hashes: np.ndarray, epochs: int, seed: int, bits: int, **rates) -> Ftrl:
    """A model that went over ``rows`` ``epochs`` times, each time in a seeded order."""
    model = Ftrl(bits, **rates)
    for e in range(epochs):
        for i in rows[np.argsort(C.mixed(hashes[rows] + np.int64(seed + e)), kind="stable")]:
            model.learn(np.concatenate([[0], at[i]]), int(label[i]))
    return model


def choose_l1(rows: np.ndarray, at: list, label: np.ndarray, hashes: np.ndarray, seed: int, bits: int) -> float:
    """The value of L1 with the least logistic loss on a fifth of ``rows``, learned on the others; the largest of equal ones."""
    apart = C.mixed(hashes[rows] + np.int64(seed + 1000)) % 5 == 0
    if not apart.any() or len(np.unique(label[rows[~apart]])) < 2:
        return L1[0]
    best = (float("inf"), L1[0])
    for l1 in L1:
        model = _learned(rows[~apart], at, label, hashes, TRIAL_EPOCHS, seed, bits, l1=l1)
        loss = 0.0
        for i in rows[apart]:
            s = float(np.clip(model.weights(np.concatenate([[0], at[i]])).sum(), -30, 30))
            loss += np.log1p(np.exp(-s if label[i] else s))
        if loss <= best[0]:
            best = (loss, l1)
    return best[1]


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE_ROWS, most_slots: int = SAMPLE_SLOTS, epochs: int = 6, bits: int = BITS, seed: int = 5, **rates) -> tuple[np.ndarray, np.ndarray]:
    """(slots, weights) that are not 0, learned from ``labels`` (doc_id, toxic; other values and nulls are left out) joined to
    ``docs``. L1 is chosen on the sample unless given.

    The sample: at most ``sample`` rows of each label by hash of the id, and of those as many whole texts, in that order, as
    have ``most_slots`` features together. Rows that repeat id and label count once, with the least of their feature lists.
    Without any labelled row there are no weights and every score is 0.5.
    """
    some = labels.where("doc_id is not null and toxic in (0, 1)").select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).distinct()
    some = [some.where(F.col("toxic") == k).orderBy(F.xxhash64("_id"), "_id").limit(n) for k, n in sample.items()]
    some = some[0].unionByName(some[1])
    schema = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("at", pa.list_(pa.int32()))])

    def featured(batches):
        for b in batches:
            yield C.rows_out(schema, [b.column("doc_id").cast(pa.int64()), b.column("toxic").cast(pa.int32()), [np.unique(slots(t, bits)).astype(np.int32) for t in C.text_bytes(b)]])

    def trained(batches):
        ids, label, at, held, last = [], [], [], 0, None
        for b in batches:
            for doc_id, toxic, x in zip(b.column("doc_id").to_pylist(), b.column("toxic").to_pylist(), b.column("at"), strict=True):
                if (doc_id, toxic) == last or held + len(x) > most_slots:
                    continue
                last, held = (doc_id, toxic), held + len(x)
                ids.append(doc_id)
                label.append(toxic)
                at.append(x.values.to_numpy().astype(np.int32))
        label = np.array(label, int)
        hashes = C.mixed(np.array(ids, np.int64))
        no = np.flatnonzero(label == 0)
        no = no[np.argsort(hashes[no], kind="stable")][: max(1, NEGATIVES * int(label.sum()))]
        used = np.sort(np.concatenate([np.flatnonzero(label == 1), no]))
        chosen = rates if "l1" in rates else rates | {"l1": choose_l1(used, at, label, hashes, seed, bits)}
        keep, w = _learned(used, at, label, hashes, epochs, seed, bits, **chosen).compact()
        yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64()), pa.array(w, pa.float64())], names=["slot", "weight"])

    rows = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "toxic")
    rows = rows.mapInArrow(featured, "doc_id long, toxic int, at array<int>").withColumn("h", F.xxhash64("doc_id"))
    # Streamed in the order of the hash: one task, whose memory most_slots bounds, and equal rows follow each other.
    ordered = rows.repartition(1).sortWithinPartitions("h", "doc_id", "toxic", "at").drop("h")
    got = ordered.mapInArrow(trained, "slot long, weight double").toArrow()
    return got.column("slot").to_numpy(), got.column("weight").to_numpy()


def score_toxicity(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], bits: int = BITS) -> DataFrame:
    """doc_id, score for every row of ``docs`` (doc_id, text). Null text counts as empty; a text without words gets the
    score of the bias alone. Texts of any length are read whole; equal texts have equal scores. Repeated rows repeat; an empty table gives none; other columns are not looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def of(batches):
        w = np.zeros(1 << bits)
        w[shared.value[0]] = shared.value[1]
        on = w != 0

        def score(text: bytes) -> float:
            at = slots(text, bits)
            s = w[0] + w[np.unique(at[on[at]])].sum()
            return 1 / (1 + np.exp(-min(max(s, -30.0), 30.0)))

        for b in batches:
            yield C.rows_out(schema, [b.column("doc_id").cast(pa.int64()), [score(t) for t in C.text_bytes(b)]])

    return docs.select("doc_id", "text").mapInArrow(of, "doc_id long, score double")
