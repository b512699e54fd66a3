"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors go to L tables of buckets floor((a . x + b) / w), M of them joined to a key, with Gaussian (2-stable) directions a.
Vectors are scaled by the largest norm and given one more component so that Euclidean distance orders them as the inner
product with a unit query does. A query visits its own bucket and then perturbed ones in the order of their estimated
success: a fixed sequence of sets over coordinates ranked by how near the query lies to their edge. Candidates of all
tables are reranked by the exact inner product of the original vectors, which is also what a bucket picks them by: products are
summed component by component in double precision, so equal scores are equal numbers and ties go by identifier.

How many values join to a key and how many buckets a query visits is chosen on a bounded sample against brute force.
Equal vectors are one class, which stands for at most k + 1 smallest ids: no others can be in a result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Rows of the sample on which the plan of the index is chosen, and queries among them.
SAMPLE_ROWS, SAMPLE_QUERIES = 4_000, 200
TABLES, WIDTH = 6, 2.0
SALT_ROWS = 20_000  # stored rows of a bucket that one task holds
VISIT_ROWS = 50_000  # queries in a block; only a split bucket sees more than one block
_HELD = 300_000


def perturbations(m: int, most: int) -> list[tuple[int, ...]]:
    """The ``most`` best sets of ranks 0..2m-1 (rank j and 2m-1-j are the two sides of one coordinate), by expected score;
    the empty set comes first."""
    j = np.arange(1, 2 * m + 1)
    up = 2 * m + 1 - j
    cost = np.where(j <= m, j * (j + 1) / (4 * (m + 1) * (m + 2)), 1 - up / (m + 1) + up * (up + 1) / (4 * (m + 1) * (m + 2)))
    out, heap = [()], [(cost[0], (0,))]
    while heap and len(out) < most:
        score, s = heapq.heappop(heap)
        if not any(2 * m - 1 - x in s for x in s):
            out.append(s)
        last = s[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (score - cost[last] + cost[last + 1], (*s[:-1], last + 1)))
            heapq.heappush(heap, (score + cost[last + 1], (*s, last + 1)))
    return out


class Index:
    """Directions and offsets of all tables, made from a seed."""

    def __init__(self, dim: int, m: int, probes: int, scale: float, tables: int = TABLES, width: float = WIDTH, seed: int = 3):
        r = np.random.default_rng(seed)
        self.m, self.tables, self.width, self.scale = m, tables, width, scale
        self.a, self.b = r.standard_normal((tables, dim + 1, m)), r.random((tables, m)) * width
        self.sets = perturbations(m, probes)

    def _at(self, x: np.ndarray, table: int) -> np.ndarray:
        return (x @ self.a[table] + self.b[table]) / self.width

    def _key(self, cells: np.ndarray, table: int) -> np.ndarray:
        key = np.full(cells.shape[:-1], table, np.int64)
        for i in range(self.m):
            key = C.mixed(key ^ C.mixed(cells[..., i].astype(np.int64)))
        return key

    def keys(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables) bucket keys of stored vectors."""
        y = x / self.scale
        y = np.hstack([y, np.sqrt(np.maximum(0, 1 - (y * y).sum(1)))[:, None]])
        return np.stack([self._key(np.floor(self._at(y, t)), t) for t in range(self.tables)], 1)

    def probes(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables * probes) bucket keys that queries visit."""
        y = np.hstack([x / np.sqrt((x * x).sum(1))[:, None], np.zeros((len(x), 1))])
        out = []
        for t in range(self.tables):
            at = self._at(y, t)
            base = np.floor(at)
            frac = at - base
            order = np.argsort(np.hstack([frac, 1 - frac]), axis=1, kind="stable")
            # rank j and its mirror 2m-1-j are the same coordinate because the two distances add up to 1
            dims, step = order % self.m, np.where(order < self.m, -1, 1)
            rows = np.arange(len(x))
            for s in self.sets:
                cells = base.copy()
                for j in s:
                    cells[rows, dims[:, j]] += step[:, j]
                out.append(self._key(cells, t))
        return np.stack(out, 1)


def choose(sample: np.ndarray, scale: float, k: int, recall: float = 0.96) -> Index:
    """The plan that looks at the smallest share of the sample (a visit counts as a small share too) among those that find at
    least ``recall`` of its queries' neighbours; the one of best recall if none does. On more rows neighbours are nearer, so
    the recall there is no less than on the sample."""
    dim = sample.shape[1]
    q = sample[:: max(1, len(sample) // SAMPLE_QUERIES)]
    exact = q @ sample.T
    exact[np.arange(len(q)), np.arange(0, len(sample), max(1, len(sample) // SAMPLE_QUERIES))] = -np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return Index(dim, 4, 1, scale)
    true = np.argpartition(-exact, k - 1, axis=1)[:, :k]
    best = None
    for m in (4, 6, 8, 10):
        index = Index(dim, m, 480, scale)
        stored, visits = index.keys(sample), index.probes(q).reshape(len(q), TABLES, -1)
        n = visits.shape[2]
        # the rank of the visit at which each query reaches each stored vector, by table
        first = np.full((len(q), len(sample)), n)
        for t in range(TABLES):
            order = np.argsort(stored[:, t], kind="stable")
            sorted_keys = stored[order, t]
            for i in range(len(q)):
                low, high = np.searchsorted(sorted_keys, visits[i, t], "left"), np.searchsorted(sorted_keys, visits[i, t], "right")
                for p in np.flatnonzero(high > low):
                    rows = order[low[p] : high[p]]
                    first[i, rows] = np.minimum(first[i, rows], p)
        for probes in (1, 5, 10, 20, 30, 45, 60, 90, 120, 180, 240, 360, 480):
            found = float((np.take_along_axis(first, true, 1) < probes).mean())
            cost = float((first < probes).mean()) + 0.0002 * probes * TABLES
            rank = (found < recall, cost if found >= recall else -found)
            if best is None or rank < best[0]:
                best = (rank, m, min(probes, n))
    return Index(dim, best[1], best[2], scale)


def _top(q: np.ndarray, c: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best distinct (by c) of each q: larger s, then smaller c."""
    order = np.lexsort((c, -s, q))
    q, c, s = q[order], c[order], s[order]
    same = np.zeros(len(q), bool)
    same[1:] = (q[1:] == q[:-1]) & (c[1:] == c[:-1])  # a class has one score, so its repeats are neighbours
    q, c, s = q[~same], c[~same], s[~same]
    new = np.ones(len(q), bool)
    new[1:] = q[1:] != q[:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(len(q)), 0))
    keep = np.arange(len(q)) - start < k
    return q[keep], c[keep], s[keep]


def inner(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed from the first component to the last, as the columns' expression does."""
    s = np.zeros(len(q))
    for i in range(q.shape[1]):
        s += q[:, i] * v[:, i]
    return s


def best_of(q: np.ndarray, v: np.ndarray, cls: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, class, product) of each query's ``most`` best rows of ``v``: larger product, then smaller class. Rough products
    leave the rows that can be among them, ties of the last place included, and these are computed exactly."""
    rough = q @ v.T
    if rough.shape[1] > most:
        last = np.partition(rough, -most, axis=1)[:, -most]
        slack = 1e-12 * q.shape[1] * np.sqrt((q * q).sum(1)) * np.sqrt((v * v).sum(1).max())
        at, row = np.nonzero(rough >= (last - slack)[:, None])
    else:
        at, row = np.divmod(np.arange(rough.size), rough.shape[1])
    exact = np.concatenate([inner(q[at[i : i + 100_000]], v[row[i : i + 100_000]]) for i in range(0, len(at), 100_000)])
    return _top(at, cls[row], exact, most)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, recall: float = 0.96) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each row of ``queries`` among ``vectors`` (both vec_id,
    embedding of one length), by largest inner product in double precision, ties to the smaller vec_id, the query's own id
    left out; all candidates if fewer.

    Vectors that are null, empty, zero or hold null or non-finite components take no part on either side, nor do rows with
    a null id. Rows that repeat an id count once, with the least of their vectors. Scores are of the vectors as given, single or
    double precision. Empty tables give
    no rows. Vectors of any (one) length work. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    double = any(f.elementType.typeName() == "double" for f in (vectors.schema["embedding"].dataType, queries.schema["embedding"].dataType))
    kind = "double" if double else "float"

    def clean(df):
        ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
        vector = F.transform("embedding", lambda x: F.when(x == 0, F.lit(0)).otherwise(x).cast(kind))  # -0.0 is 0.0
        return df.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ok).select(F.col("vec_id").cast("long"), vector.alias("embedding")).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))

    all_rows = clean(vectors)
    by = Window.partitionBy("embedding").orderBy("vec_id")
    ranked = all_rows.withColumn("r", F.row_number().over(by)).where(F.col("r") <= k + 1)
    classes = C.saved(ranked.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("cls", F.element_at("ids", 1)))
    asked = C.saved(clean(queries))
    q_classes = C.saved(asked.groupBy("embedding").agg(F.min("vec_id").alias("q")))

    norm2 = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    largest = classes.agg(F.max(norm2)).first()[0]
    schema = "query_id long, rank int, vec_id long, score double"
    if largest is None:
        return spark.createDataFrame([], schema)
    some = classes.orderBy(F.xxhash64("cls"), "cls").limit(SAMPLE_ROWS).select("embedding").toArrow().column("embedding").to_pylist()
    index = spark.sparkContext.broadcast(choose(np.array(some, float), float(np.sqrt(largest)) or 1.0, k, recall))
    best = k + 1  # classes: one may be the query's own
    numbers = pa.float64() if double else pa.float32()
    rows = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("x", pa.list_(numbers))])

    def dealt(column, visits):
        def of(batches):
            for b in batches:
                for at in range(0, b.num_rows, 2_000 if not visits else 200):
                    part = b.slice(at, 2_000 if not visits else 200)
                    vec = part.column("embedding")
                    x = vec.flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                    keys = index.value.probes(x.astype(float)) if visits else index.value.keys(x.astype(float))
                    take = pa.array(np.repeat(np.arange(part.num_rows), keys.shape[1]))
                    yield C.rows_out(rows, [keys.ravel(), part.column(column).take(take), vec.take(take).cast(pa.list_(numbers))])

        return of

    kinds = f"key long, id long, x array<{kind}>"
    stored = classes.select("cls", "embedding").mapInArrow(dealt("cls", False), kinds)
    visits = q_classes.select("q", "embedding").mapInArrow(dealt("q", True), kinds)
    # A bucket with very many vectors is split in parts, and its visitors in blocks; each part meets each block in a task of its
    # own. Buckets of one part see all their visitors in a row, one batch after the other.
    blocks = max(1, -(-q_classes.count() // VISIT_ROWS))
    sizes = stored.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(SALT_ROWS)).cast("int").alias("parts"))
    hot = C.sized(C.saved(sizes.where("parts > 1")))

    def split(df, own, all_of, n_own, n_all):
        df = df.join(hot, "key", "left")
        place = F.pmod(F.xxhash64("id"), F.when(F.col("parts").isNull(), 1).otherwise(n_own)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.when(F.col("parts").isNull(), 1).otherwise(n_all) - 1))
        return df.withColumn(own, place).withColumn(all_of, every).drop("parts")

    stored = split(stored, "salt", "block", F.col("parts"), F.lit(blocks)).withColumn("side", F.lit(0))
    visits = split(visits, "block", "salt", F.lit(blocks), F.col("parts")).withColumn("side", F.lit(1))
    out = pa.schema([("q", pa.int64()), ("cls", pa.int64()), ("s", pa.float64())])
    order = ["key", "salt", "block"]

    def matched(batches):
        held, n = [], 0
        ids, x, now = [], [], None
        cls = v = None
        for (*key, side), slices in C.slices(batches, [*order, "side"]):
            if key != now:
                ids, x, now, v = [], [], key, None
            for s in slices:
                one, vec = s.column("id").to_numpy(), s.column("x").flatten().to_numpy().reshape(s.num_rows, -1)
                if side == 0:
                    ids.append(one)
                    x.append(vec)
                    continue
                if not ids:
                    continue
                if v is None:
                    cls, v = np.concatenate(ids), np.concatenate(x).astype(float)
                for at in range(0, len(one), 512):
                    q, c, score = best_of(vec[at : at + 512].astype(float), v, cls, best)
                    held.append((one[at : at + 512][q], c, score))
                    n += len(q)
                    if n > _HELD:
                        held = [_top(*map(np.concatenate, zip(*held, strict=True)), best)]
                        n = len(held[0][0])
                        if n > _HELD // 2:
                            yield C.rows_out(out, held.pop())
                            n = 0
        if held:
            yield C.rows_out(out, _top(*map(np.concatenate, zip(*held, strict=True)), best))

    both = visits.unionByName(stored)
    found = both.repartition(*order).sortWithinPartitions(*order, "side").mapInArrow(matched, "q long, cls long, s double")
    near = found.groupBy("q", "cls").agg(F.max("s").alias("s"))
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "cls"))).where(F.col("r") <= best)
    dot = F.aggregate(F.zip_with("qv", "embedding", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    scored = near.select("q", "cls").join(q_classes.withColumnRenamed("embedding", "qv"), "q").join(classes, "cls").select("q", "ids", dot.alias("score"))
    listed = scored.select("q", "score", F.explode("ids").alias("vec_id"))
    listed = listed.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1).drop("r")
    every = asked.join(q_classes, "embedding").select(F.col("vec_id").alias("query_id"), "q").join(listed, "q").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
