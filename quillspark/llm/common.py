"""What the operators of this subpackage share: shared-folder tables, checked broadcasts, bounded id filters.

Nothing here touches a machine-local folder: tables that cut lineage go to the folder the session names in
``spark.checkpoint.dir``, which every executor can read again after a loss.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side with at most this many rows of a few numbers is small enough to send to every executor.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a folder of this machine only where none is set (tests, local mode)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
        path = tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` saved with a number of its own for each row in the new column ``name``, so that rows that repeat an id, or
    everything, can be told apart in any later job."""
    return saved(df.withColumn(name, F.monotonically_increasing_id()))


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``most`` rows, found without counting further than that."""
    return df.limit(most + 1).count() <= most


def sized(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if its checked size allows it, else as it is (a shuffled join then)."""
    return F.broadcast(df) if small(df, most) else df


def keep_only(docs: DataFrame, dropped: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose key is not in ``dropped`` (one column ``key``). Rows with a null key stay."""
    return docs.join(sized(dropped.select(key)), key, "left_anti")


def cut(batches: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """Batches in slices of at most ``rows`` rows, so that lists of Python objects stay small; memory that Arrow holds back goes
    back to the system after the last one, since workers outlive their tasks."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A string column's values as UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A string column's values; null counts as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def rows_out(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(columns, schema.types, strict=True)], schema=schema)


class KeyFilter:
    """A bitmap over 64-bit keys with a fixed number of bits: it never misses a key and its size never grows.

    Built by an aggregation of at most ``2**bits / 64`` rows, so what reaches the driver is bounded whatever the
    input. On inputs that fill the bitmap everything passes, which costs a larger shuffle and no result.
    """

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    @classmethod
    def of(cls, keys: DataFrame, key: str, bits: int = 22) -> KeyFilter:
        slot = F.col(key).bitwiseAND(F.lit((1 << bits) - 1))
        found = (
            keys.select(F.shiftright(slot, 6).alias("w"), F.expr(f"shiftleft(1L, cast({key} & 63 as int))").alias("m"))
            .groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
        )
        words = np.zeros(1 << (bits - 6), np.int64)
        words[found.column("w").to_numpy()] = found.column("m").to_numpy()
        return cls(words, bits)

    def has(self, keys: np.ndarray) -> np.ndarray:
        slot = keys.astype(np.int64) & ((1 << self.bits) - 1)
        return ((self.words[slot >> 6] >> (slot & 63)) & 1).astype(bool)


def mixed(keys: np.ndarray) -> np.ndarray:
    """64-bit integers spread over all bits (splitmix64), as int64."""
    z = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))).astype(np.int64)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Consecutive rows with the same key, as (key, slices), from batches sorted by ``keys``."""
    now, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change)
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            key = tuple(c[a] for c in cols)
            if held and key != now:
                yield now, held
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield now, held


def slices(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """As ``runs``, but a run is given out batch by batch, so none is held as a whole."""
    for batch in batches:
        yield from runs(iter([batch]), keys)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves ``part`` when divided by ``parts``; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
