"""Exact dedup with Patricia-trie owners.

Length and content hash deal texts to partitions; in each, one compressed radix trie takes in the whole byte strings of all its
texts, whose terminal nodes hold the owner. Hashes are compared first: a text whose (length, hash) is found once in the whole
corpus has no equal, so only texts whose key repeats are moved. Every scan partition merges its own copies in a trie before
anything is shuffled, a salted round merges those, and a last round sees at most a few rows for each text, however many
copies it has. Rows stream into the tries one at a time, and a trie beyond its budget spills its heaviest subtrees, so a task
holds the budget and one text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

_KEY = pa.schema([("doc_id", pa.int64()), ("carried", pa.int64()), ("n_bytes", pa.int64()), ("h", pa.int64()), ("sha", pa.string())])
_OWN = pa.schema([("n_bytes", pa.int64()), ("h", pa.int64()), ("salt", pa.int32()), ("body", pa.binary()), ("owner", pa.int64()), ("copies", pa.int64())])
_END = pa.schema([("n_bytes", pa.int64()), ("sha", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
#: Bytes of texts in one batch that a task gives out.
_OUT_BYTES = 4_000_000


def normal(text: bytes) -> bytes:
    """A-Z to a-z, nothing else: ``bytes.lower`` leaves all other bytes alone."""
    return text.lower()


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class PatriciaTrie:
    """A compressed radix trie over byte strings. A terminal node holds [owner, copies].

    ``size`` counts the bytes on edges. ``spill(budget)`` takes out the heaviest subtrees, those of the root's edges or, where
    one of them holds nearly everything, of the edges below it, as (text, owner, copies) rows; its texts may be added again
    later, since owners and copies merge.
    """

    def __init__(self, largest: bool = False):
        self.largest, self.children, self.size = largest, {}, 0

    def add(self, text: bytes, owner: int, copies: int = 1) -> None:
        node, at = self.children, 0
        while True:
            rest = text[at:] if at else text
            first = rest[:1]
            edge = node.get(first)
            if edge is None:  # [label, children, terminal]
                node[first] = [rest, {}, [owner, copies]]
                self.size += len(rest)
                return
            n = _common(edge[0], rest)
            if n < len(edge[0]):  # split this edge
                low = [edge[0][n:], edge[1], edge[2]]
                edge[0], edge[1], edge[2] = edge[0][:n], {low[0][:1]: low}, None
            if n == len(rest):
                if edge[2] is None:
                    edge[2] = [owner, copies]
                else:
                    edge[2][0] = (max if self.largest else min)(edge[2][0], owner)
                    edge[2][1] += copies
                return
            node, at = edge[1], at + n

    @staticmethod
    def _walk(edge: list, head: bytes) -> Iterator[tuple[bytes, int, int]]:
        stack = [(edge, head)]
        while stack:
            (label, children, end), head = stack.pop()
            text = head + label
            if end is not None:
                yield text, end[0], end[1]
            stack += [(x, text) for x in children.values()]

    def rows(self) -> Iterator[tuple[bytes, int, int]]:
        for edge in self.children.values():
            yield from self._walk(edge, b"")

    @staticmethod
    def _weight(edge: list) -> int:
        total, stack = 0, [edge]
        while stack:
            label, children, _ = stack.pop()
            total += len(label)
            stack += children.values()
        return total

    def spill(self, budget: int = 0) -> Iterator[tuple[bytes, int, int]]:
        """Rows of the subtrees taken out until ``size`` is at most ``budget``, of all of them if it is 0. Each is weighed once."""
        node, head = self.children, b""
        while len(node) == 1:  # every text begins alike: spill below the common part
            only = next(iter(node.values()))
            if only[2] is not None or not only[1]:
                break
            node, head = only[1], head + only[0]
        for weight, first in sorted(((self._weight(e), k) for k, e in node.items()), reverse=True):
            if 0 < budget >= self.size:
                break
            edge = node.pop(first)
            self.size -= weight
            yield from self._walk(edge, head)
        if not node:
            self.children, self.size = {}, 0


def keys(docs: DataFrame, carry: str | None = None) -> DataFrame:
    """doc_id, carried (a number that ``carry`` names, or null), n_bytes, h (the first 64 bits of the hash), sha of every row's
    normalised text."""

    def of(batches):
        for b in C.cut(batches):
            got = [normal(x) for x in C.text_bytes(b)]
            sums = [hashlib.sha256(x) for x in got]
            yield C.rows_out(_KEY, (b.column("doc_id"), b.column("carried"), [len(x) for x in got], [int.from_bytes(s.digest()[:8], "big", signed=True) for s in sums], [s.hexdigest() for s in sums]))

    carried = (F.col(carry) if carry else F.lit(None)).cast("long").alias("carried")
    return docs.select(F.col("doc_id").cast("long"), "text", carried).mapInArrow(of, "doc_id long, carried long, n_bytes long, h long, sha string")


def _batches(schema: pa.Schema, rows: Iterator[tuple], size) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about _OUT_BYTES, as ``size`` tells of each."""
    some, held = [], 0
    for row in rows:
        some.append(row)
        held += size(row)
        if held > _OUT_BYTES:
            yield C.rows_out(schema, zip(*some, strict=True))
            some, held = [], 0
    if some:
        yield C.rows_out(schema, zip(*some, strict=True))


def _local_owners(docs: DataFrame, wanted, largest: bool, salts: int, trie_bytes: int) -> DataFrame:
    """One row for each text of a scan partition whose key ``wanted`` (a broadcast KeyFilter) may hold, more for a text that
    comes again after its subtree was spilled."""

    def merged(batches):
        trie, salt = PatriciaTrie(largest), hash_salt(salts)

        def out(rows):
            for text, owner, copies in rows:
                yield len(text), int.from_bytes(hashlib.sha256(text).digest()[:8], "big", signed=True), salt, text, owner, copies

        for b in C.cut(batches):
            for doc_id, raw in zip(b.column("doc_id").to_pylist(), C.text_bytes(b), strict=True):
                text = normal(raw)
                h = int.from_bytes(hashlib.sha256(text).digest()[:8], "big", signed=True)
                slot = h & ((1 << wanted.value.bits) - 1)
                if not (int(wanted.value.words[slot >> 6]) >> (slot & 63)) & 1:
                    continue
                trie.add(text, absent(largest) if doc_id is None else doc_id)
                if trie.size > trie_bytes:
                    yield from out(trie.spill(trie_bytes // 2))
        yield from out(trie.rows())

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda batches: _batches(_OWN, merged(batches), lambda r: r[0] + 100), "n_bytes long, h long, salt int, body binary, owner long, copies long")


def absent(largest: bool) -> int:
    """Stands for a null identifier: every number goes before it."""
    return -(1 << 63) if largest else (1 << 63) - 1


def hash_salt(salts: int) -> int:
    """The same for every attempt of a task: its partition's number."""
    from pyspark import TaskContext

    return TaskContext.get().partitionId() % salts


def _merged(parts: DataFrame, by: list[str], largest: bool, last: bool, trie_bytes: int) -> DataFrame:
    """Tries over the rows that ``by`` deals to each partition. Rows come sorted by ``by``, so all copies of a text follow each
    other but for texts of equal keys: subtrees are spilled only where the key changes, and none of their texts comes again."""

    def merged(batches):
        trie, now = PatriciaTrie(largest), None

        def out(rows):
            for text, owner, copies in rows:
                digest = hashlib.sha256(text)
                yield (len(text), digest.hexdigest(), owner, copies) if last else (len(text), int.from_bytes(digest.digest()[:8], "big", signed=True), 0, text, owner, copies)

        for b in batches:
            columns = [b.column(c).to_pylist() for c in by]
            bodies = b.column("body")
            for i, key in enumerate(zip(*columns, strict=True)):
                if key != now:
                    now = key
                    if trie.size > trie_bytes:
                        yield from out(trie.spill(trie_bytes // 2))
                trie.add(bodies[i].as_py(), b.column("owner")[i].as_py(), b.column("copies")[i].as_py())
        yield from out(trie.rows())

    schema = "n_bytes long, sha string, keep_id long, group_size long" if last else parts.schema
    sizes = (_END, lambda r: 200) if last else (_OWN, lambda r: r[0] + 100)
    return parts.repartition(*by).sortWithinPartitions(*by).mapInArrow(lambda batches: _batches(sizes[0], merged(batches), sizes[1]), schema)


def exact_groups(docs: DataFrame, largest: bool, carry: str | None, salts: int, trie_bytes: int, filter_bits: int) -> DataFrame:
    """doc_id, carried, keep_id, group_size, sha of every row."""
    every = C.saved(keys(docs, carry))
    spark = docs.sparkSession
    repeated = every.groupBy("n_bytes", "sha").agg(F.first("h").alias("h"), F.count(F.lit(1)).alias("n")).where("n > 1")
    wanted = spark.sparkContext.broadcast(C.KeyFilter.of(repeated, "h", filter_bits))
    parts = _local_owners(docs, wanted, largest, salts, trie_bytes)
    parts = _merged(parts, ["n_bytes", "h", "salt"], largest, False, trie_bytes)
    owners = _merged(parts, ["n_bytes", "h"], largest, True, trie_bytes).where("group_size > 1")
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.nullif(F.col("keep_id"), F.lit(absent(largest))))
    size = F.coalesce("group_size", F.lit(1)).cast("long")
    return every.join(owners, ["n_bytes", "sha"], "left").select("doc_id", "carried", keep_id.alias("keep_id"), size.alias("group_size"), "sha")


def exact_dedup(docs: DataFrame, keep: str = "smallest", salts: int = 16, trie_bytes: int = 24_000_000, filter_bits: int = 22) -> DataFrame:
    """Groups of equal texts (after A-Z to a-z): doc_id, keep_id, group_size, kept, text_sha256, a row for each input row.

    ``keep``: which identifier owns a group, "smallest" or "largest". Null text counts as empty, and all empty texts
    are one group. Texts of any length are compared whole; a task holds ``trie_bytes`` of them and one text more. A null doc_id
    ranks below every number; its row gets a keep_id like any other and is kept only if its whole group has null ids. Rows that
    repeat both id and text are kept or dropped together (``drop_exact_copies`` keeps one of them); rows that repeat an id with
    different texts are in the groups of their texts. An empty table gives no rows; columns besides doc_id and text are not
    looked at.
    """
    found = exact_groups(docs, keep == "largest", None, salts, trie_bytes, filter_bits)
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, keep: str = "smallest", salts: int = 16, trie_bytes: int = 24_000_000, filter_bits: int = 22) -> DataFrame:
    """The rows of ``docs`` but for all of each group of equal texts save one: its owner's, of rows that repeat the owner's id
    any one. Columns are those of ``docs``; everything else as for ``exact_dedup``."""
    row = C.unused(docs, "row")
    numbered = C.numbered(docs, row)
    copies = C.saved(exact_groups(numbered, keep == "largest", row, salts, trie_bytes, filter_bits).where("group_size > 1").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id"))))
    stays = copies.where("kept").groupBy("sha").agg(F.min("carried").alias("stays"))
    gone = copies.join(stays, "sha").where("carried <> stays").select(F.col("carried").alias(row))
    return C.keep_only(numbered, C.saved(gone), row).select(*docs.columns)
