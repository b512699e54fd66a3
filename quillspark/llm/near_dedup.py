"""MinHash near-dedup with sequential Bayesian verification.

Documents with the same shingle set are one class. Classes share bands of MinHash values; candidate pairs compare their
signatures batch by batch and are dropped as soon as the posterior chance that they are similar falls below the chosen
miss probability; survivors are verified exactly on their full shingle sets.

Only links that join components are worth finding, so nothing lists all pairs of a group. First every band bucket
compares its members with its smallest member. Buckets that still hold several components are then looked at as a whole,
in blocks: a pair is compared in the first band it shares, and each block gives at most a spanning forest of its verified
links. Whatever a bucket's size, a block bounds memory and what it returns is linear.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import components

HASHES, ROWS, BANDS = 64, 3, 16  # 16 bands of 3: a pair at 0.8 shares none with chance (1 - 0.8**3)**16 = 1e-5
BATCH = 16  # signature positions compared at a time
MISS = 1e-5
BLOCK = 8_000

_R = np.random.default_rng(20240607)
_MUL = (_R.integers(0, 1 << 32, HASHES, dtype=np.uint32) | 1)[:, None]
_ADD = _R.integers(0, 1 << 32, HASHES, dtype=np.uint32)[:, None]
_P = np.uint64(0x9E3779B97F4A7C15)
_SIG = pa.schema([("doc_id", pa.int64()), ("carried", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])


class _Words(dict):
    """Word -> 64-bit hash for the words seen; emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def shingles(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a text, A-Z taken as a-z; of all its words if fewer."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    k = min(k, len(h))
    n = len(h) - k + 1
    s = h[:n].copy()
    for i in range(1, k):
        s *= _P
        s ^= s >> np.uint64(29)
        s += h[i : i + n]
    s ^= s >> np.uint64(32)
    s *= np.uint64(0xD6E8FEB86659FD93)
    s ^= s >> np.uint64(32)
    return np.unique(s)


def signature(s: np.ndarray) -> np.ndarray:
    """HASHES minima of a non-empty set, each under its own hash function."""
    low = s.astype(np.uint32)[None, :]
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, low.shape[1], 1024):
        part = low[:, at : at + 1024] * _MUL
        part += _ADD
        np.minimum(out, part.min(1), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig[: ROWS * BANDS].reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        key = C.mixed((key * _P) ^ rows[:, i]).astype(np.uint64)
    return key.astype(np.int64)


def short(sig: np.ndarray) -> bytes:
    """A byte of each minimum, for comparing."""
    return ((sig * np.uint32(0x85EBCA6B)) >> np.uint32(24)).astype(np.uint8).tobytes()


def posterior_floors(threshold: float, miss: float) -> list[int]:
    """For each number of compared positions, BATCH and its multiples: the fewest matches at which the chance of a similarity
    of ``threshold`` or more, under a uniform prior, is still above ``miss``. A byte matches by accident once in 256."""
    grid = (np.arange(2000) + 0.5) / 2000
    p = grid + (1 - grid) / 256
    floors = []
    for n in range(BATCH, HASHES + 1, BATCH):
        for m in range(n + 1):
            log = m * np.log(p) + (n - m) * np.log1p(-p + 1e-15)
            like = np.exp(log - log.max())
            if like[grid >= threshold].sum() / like.sum() >= miss:
                floors.append(m)
                break
    return floors


def likely(a: np.ndarray, b: np.ndarray, floors: list[int]) -> np.ndarray:
    """Which rows of two byte signature arrays (broadcast together) survive every batch."""
    shape = np.broadcast_shapes(a.shape, b.shape)[0]
    alive, match = np.arange(shape), np.zeros(shape, np.int64)
    for i, floor in enumerate(floors):
        at = slice(i * BATCH, (i + 1) * BATCH)
        x = a[alive, at] if len(a) > 1 or shape == 1 else a[:, at]
        y = b[alive, at] if len(b) > 1 or shape == 1 else b[:, at]
        match[alive] += (x == y).sum(1)
        alive = alive[match[alive] >= floor]
        if not len(alive):
            break
    out = np.zeros(shape, bool)
    out[alive] = True
    return out


def similar(both, one, other, percent: int):
    """100 * intersection >= percent * union, in whole numbers."""
    return 100 * both >= percent * (one + other - both)


def identity(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def signatures(docs: DataFrame, k: int, carry: str | None = None) -> DataFrame:
    """A row for each of ``docs``: id, the carried number (null without one), and size, identity, band keys and bytes of its set."""

    def of(batches):
        for b in C.cut(batches):
            out = []
            for doc_id, carried, text in zip(b.column("doc_id").to_pylist(), b.column("carried").to_pylist(), C.text_bytes(b), strict=True):
                s = shingles(text, k)
                if len(s):
                    sig = signature(s)
                    out.append((doc_id, carried, len(s), *identity(s), band_keys(sig), short(sig)))
                else:
                    out.append((doc_id, carried, 0, 0, 0, None, None))
            yield C.rows_out(_SIG, zip(*out, strict=True) if out else [[]] * 7)

    carried = (F.col(carry) if carry else F.lit(None)).cast("long").alias("carried")
    return docs.select(F.col("doc_id").cast("long"), "text", carried).mapInArrow(of, "doc_id long, carried long, n long, h1 long, h2 long, bands array<long>, sig binary")


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """cls, set (sorted 64-bit hashes as bytes) of the classes in ``wanted`` (cls, h1, h2, n, some_id), from the texts. A bounded
    bitmap of one id of each class passes over nearly all other texts before any work; what tells classes apart is the set."""
    bitmap = docs.sparkSession.sparkContext.broadcast(C.KeyFilter.of(wanted.select(F.xxhash64("some_id").alias("h")), "h"))
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int64()), ("set", pa.binary())])

    def of(batches):
        for b in C.cut(batches):
            b = b.filter(pa.array(bitmap.value.has(b.column("h").to_numpy())))
            if b.num_rows:
                sets = [shingles(t, k) for t in C.text_bytes(b)]
                one, other = zip(*map(identity, sets), strict=True)
                yield C.rows_out(schema, [one, other, list(map(len, sets)), [s.tobytes() for s in sets]])

    ids = docs.where("doc_id is not null").select("text", F.xxhash64(F.col("doc_id").cast("long")).alias("h"))
    found = ids.mapInArrow(of, "h1 long, h2 long, n long, set binary")
    return found.join(wanted.select("cls", "h1", "h2", "n"), ["h1", "h2", "n"]).groupBy("cls").agg(F.min("set").alias("set"))


def _pair_links(pairs: DataFrame, sigs: DataFrame, sets: DataFrame, floors: list[int], percent: int) -> DataFrame:
    """The pairs (a, b) that are similar: signatures first, then full sets of the survivors."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def prune(batches):
        for x in batches:
            if x.num_rows:
                one, other = (np.frombuffer(b"".join(x.column(c).to_pylist()), np.uint8).reshape(-1, HASHES) for c in ("siga", "sigb"))
                yield x.select(["a", "b"]).filter(pa.array(likely(one, other, floors)))

    def verify(batches):
        for x in batches:
            keep = []
            for s, t in zip(x.column("seta").to_pylist(), x.column("setb").to_pylist(), strict=True):
                s, t = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
                keep.append(bool(similar(len(np.intersect1d(s, t, assume_unique=True)), len(s), len(t), percent)))
            yield pa.RecordBatch.from_arrays([x.column("a").filter(pa.array(keep, pa.bool_())), x.column("b").filter(pa.array(keep, pa.bool_()))], schema=schema)

    left = sigs.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("sig").alias("siga"))
    right = sigs.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sigb"))
    near = pairs.join(left, "a").join(right, "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").select("a", "b", "siga", "sigb")
    near = near.mapInArrow(prune, "a long, b long")
    full = near.join(sets.select(F.col("cls").alias("a"), F.col("set").alias("seta")), "a").join(sets.select(F.col("cls").alias("b"), F.col("set").alias("setb")), "b")
    return full.mapInArrow(verify, "a long, b long")


class _Block:
    """Rows of one or two blocks of a bucket: components, signatures, band keys, sizes and (at the end) sets."""

    def __init__(self, slices, with_sets: bool):
        self.ids, self.label, self.n, self.side = (np.concatenate([s.column(c).to_numpy() for s in slices]) for c in ("cls", "label", "n", "side"))
        self.sig = np.frombuffer(b"".join(x for s in slices for x in s.column("sig").to_pylist()), np.uint8).reshape(-1, HASHES)
        self.bands = np.concatenate([s.column("bands").flatten().to_numpy().reshape(-1, BANDS) for s in slices])
        order = np.argsort(self.ids, kind="stable")
        self.sets = [np.frombuffer(x, np.uint64) for s in slices for x in s.column("set").to_pylist()] if with_sets else None
        self.ids, self.label, self.n, self.side, self.sig, self.bands = (x[order] for x in (self.ids, self.label, self.n, self.side, self.sig, self.bands))
        if with_sets:
            self.sets = [self.sets[i] for i in order]

    def partners(self, i: int, band: int, pair: bool, root: np.ndarray, floors: list[int], percent: int) -> np.ndarray:
        """Rows after ``i`` of other components that first meet it in this band and whose signatures don't rule it out."""
        j = np.arange(i + 1, len(self.ids))
        j = j[root[j] != root[i]]
        if pair:  # both blocks' own pairs are seen elsewhere
            j = j[self.side[j] != self.side[i]]
        if len(j):
            low, high = np.minimum(self.n[j], self.n[i]), np.maximum(self.n[j], self.n[i])
            j = j[100 * low >= percent * high]
        if len(j) and band:
            j = j[~(self.bands[j, :band] == self.bands[i, :band]).any(1)]
        return j[likely(self.sig[i : i + 1], self.sig[j], floors)] if len(j) else j


def _band_of(block: _Block, key: int) -> int:
    return int(np.flatnonzero(block.bands[0] == key)[0])


def _bucket_rows(rows: DataFrame, sizes: DataFrame, blocks: int) -> DataFrame:
    """Rows of each bucket (key, ...), once for every pair of blocks that they belong to. A bucket of up to ``blocks`` rows
    is one block; ``task`` numbers the pairs and ``side`` tells its blocks apart."""
    g = F.ceil(F.col("rows") / F.lit(blocks)).cast("int")
    x = rows.join(sizes, "key").withColumn("g", g).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("g")).cast("int"))
    x = x.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    low, high = F.least("own", "with"), F.greatest("own", "with")
    return x.withColumn("task", low * F.col("g") + high).withColumn("side", F.col("own").cast("long")).withColumn("two", (low != high)).drop("g", "own", "with", "rows")


def _rest_links(mixed: DataFrame, sets: DataFrame, floors: list[int], percent: int, blocks: int) -> DataFrame:
    """Verified links (a, b) that join the components which buckets still hold: at most a forest for each block pair.

    ``mixed``: key, cls, label, n, sig, bands, of buckets with several labels.
    """
    sizes = mixed.groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    dealt = _bucket_rows(mixed, sizes, blocks)
    touched = pa.schema([("key", pa.int64()), ("cls", pa.int64()), ("task", pa.int32()), ("side", pa.int64()), ("two", pa.bool_())])
    links = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def survivors(batches):
        for (key, _), slices in C.runs(batches, ["key", "task"]):
            x = _Block(slices, False)
            pair, hit = slices[0].column("two")[0].as_py(), np.zeros(len(x.ids), bool)
            band = _band_of(x, key)
            for i in range(len(x.ids) - 1):
                j = x.partners(i, band, pair, x.label, floors, percent)
                if len(j):
                    hit[i] = hit[j] = True
            at = np.flatnonzero(hit)
            if len(at):
                task = slices[0].column("task")[0].as_py()
                yield C.rows_out(touched, [np.full(len(at), key), x.ids[at], np.full(len(at), task), x.side[at], np.full(len(at), pair)])

    def forest(batches):
        for (key, _), slices in C.runs(batches, ["key", "task"]):
            x = _Block(slices, True)
            pair, band = slices[0].column("two")[0].as_py(), _band_of(x, key)
            root = np.unique(x.label, return_inverse=True)[1].astype(np.int64)
            lengths = np.array([len(s) for s in x.sets])
            owner = np.repeat(np.arange(len(lengths)), lengths)
            values, where = np.unique(np.concatenate(x.sets), return_inverse=True)
            by_value = np.argsort(where, kind="stable")
            owners, starts = owner[by_value], np.concatenate([[0], np.cumsum(np.bincount(where, minlength=len(values)))])
            ends = np.cumsum(lengths)
            out = []
            for i in range(len(x.ids) - 1):
                j = x.partners(i, band, pair, root, floors, percent)
                if not len(j):
                    continue
                mine = where[ends[i] - lengths[i] : ends[i]]
                counts = starts[mine + 1] - starts[mine]
                at = np.repeat(starts[mine] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
                both = np.bincount(owners[at], minlength=len(lengths))
                for y in j[similar(both[j], lengths[i], lengths[j], percent)]:
                    if root[y] != root[i]:
                        out.append((x.ids[i], x.ids[y]))
                        root[root == root[y]] = root[i]
            if out:
                yield C.rows_out(links, zip(*out, strict=True))

    kinds = "key long, cls long, task int, side long, two boolean"
    order = ["key", "task"]
    some = C.saved(dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(survivors, kinds))
    attributes = mixed.select("cls", "label", "n", "sig", "bands").dropDuplicates(["cls"])
    full = some.join(attributes, "cls").join(sets, "cls")
    return full.repartition(*order).sortWithinPartitions(*order).mapInArrow(forest, "a long, b long")


def near_groups(docs: DataFrame, k: int = 5, threshold: float = 0.8, miss: float = MISS, block: int = BLOCK, carry: str | None = None) -> DataFrame:
    """doc_id, carried, n_shingles, component for every row of ``docs`` (doc_id, text and the column that ``carry`` names).

    Rows, not ids, are what is linked, so rows that repeat an id with other texts are documents of their own. ``component``
    is a number of this call that the rows of a group share; null for a row without an id or without words, which is linked
    with nothing. Equal sets are one class, known by its 128-bit identity and size, and numbered by one of its rows.
    """
    percent, floors = round(100 * threshold), posterior_floors(threshold, miss)
    every = C.saved(signatures(docs, k, carry).withColumn("row", F.monotonically_increasing_id()))
    real = every.where("n > 0 and doc_id is not null")
    alike = F.first(F.struct("bands", "sig")).alias("m")
    classes = C.saved(real.groupBy("h1", "h2", "n").agg(F.min("row").alias("cls"), F.min("doc_id").alias("some_id"), alike).select("h1", "h2", "n", "cls", "some_id", "m.*"))
    bands = classes.select(F.explode("bands").alias("key"), "cls")
    stars = bands.groupBy("key").agg(F.min("cls").alias("center"), F.max("cls").alias("other")).where("center < other").select("key", "center")
    buckets = C.saved(bands.join(stars, "key"))
    active = C.saved(classes.join(buckets.select("cls").distinct(), "cls", "left_semi"))
    sigs = active.select("cls", "n", "sig", "bands")
    sets = C.saved(_sets(docs, active, k))
    pairs = buckets.where("cls <> center").select(F.col("center").alias("a"), F.col("cls").alias("b")).distinct()
    links = C.saved(_pair_links(pairs, sigs, sets, floors, percent))
    first = components(links)

    now = buckets.join(first.withColumnRenamed("node", "cls"), "cls", "left").select("key", "cls", F.coalesce("label", "cls").alias("label"))
    several = now.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    mixed = C.saved(now.join(several, "key").join(sigs, "cls"))
    more = C.saved(_rest_links(mixed, sets, floors, percent, block))
    hung = first.select(F.col("node").alias("a"), F.col("label").alias("b"))
    final = components(hung.unionByName(more)).select(F.col("node").alias("cls"), "label")
    owner = classes.select("h1", "h2", "n", "cls").join(final, "cls", "left").select("h1", "h2", "n", F.coalesce("label", "cls").alias("component"))
    kept = ("doc_id", "carried", "row", F.col("n").alias("n_shingles"))
    placed = real.join(owner, ["h1", "h2", "n"]).select(*kept, "component")
    alone = every.where("n = 0 or doc_id is null").select(*kept, F.lit(None).cast("long").alias("component"))
    return placed.unionByName(alone)


def near_dedup(docs: DataFrame, k: int = 5, threshold: float = 0.8, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Sets hold distinct k-word shingles of the whole lower-cased (A-Z) text, or the whole sequence when it has fewer words;
    a text without words (or null) has none and is linked with nothing. Two documents are linked when their Jaccard
    similarity is at least ``threshold`` (compared in whole percents); ``component_id`` is the smallest id of the rows that
    links reach, and a row is kept if that is its own id. Rows that repeat an id are rows of their own: with one text they
    are linked like any copies (and kept or dropped together), with different texts only their own links count. A row with
    a null id is linked with nothing and kept, its component null. A text of any length is read whole. Ties can't arise: the
    smallest id is one number. An empty table gives no rows; other columns are not looked at.
    """
    rows = C.saved(near_groups(docs, k, threshold, miss, block))
    linked = rows.where("component is not null")
    found = linked.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    alone = rows.where("component is null").withColumn("component_id", F.col("doc_id"))
    out = linked.join(found, "component").drop("component").unionByName(alone.drop("component"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, k: int = 5, threshold: float = 0.8, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` but for all of each near-duplicate group save one: that with the smallest id, of rows that repeat
    it any one. Columns are those of ``docs``; rows without an id or words stay."""
    row = C.unused(docs, "row")
    numbered = C.numbered(docs, row)
    rows = C.saved(near_groups(numbered, k, threshold, miss, block, carry=row).where("component is not null").select("component", "doc_id", "carried"))
    stays = rows.groupBy("component").agg(F.min(F.struct("doc_id", "carried")).alias("s"), F.count(F.lit(1)).alias("size")).where("size > 1")
    gone = rows.join(stays, "component").where("carried <> s.carried").select(F.col("carried").alias(row))
    return C.keep_only(numbered, C.saved(gone), row).select(*docs.columns)
