"""Fuzzy links between titles: a join on shared words that moves no pair, and all pairs of the shortest."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import similarity as S
from quillspark.operators import relational as R
from quillspark.session import saved

C = F.col
CHUNK = 1_000_000


def fuzzy_links(df: DataFrame, key: str, text: str, least: float = 75.0, short: int = 64) -> DataFrame:
    """a, b, score (a < b): rows whose ``token_sort_ratio`` is ``least`` or more. Compared are all pairs that share half of the
    distinct words of the one with more of them, words as the score takes them, and all pairs of at most ``short`` (up to 64)
    characters. ``key`` is a number and unique."""
    t = saved(df.where(C(text).isNotNull()).select(C(key).alias("id"), S.token_sorted(text).alias("s")))
    p = sharing_half(t, short, least)
    p = p.join(t.select(C("id").alias("a"), C("s").alias("sa")), "a").join(t.select(C("id").alias("b"), C("s").alias("sb")), "b")
    p = p.select("a", "b", S.sorted_ratio("sa", "sb").alias("score")).where(C("score") >= least)
    return p.unionByName(short_links(t.where(F.length("s") <= short), least))


def sharing_half(t: DataFrame, short: int, least: float, cells: int = 8_000_000, hot: int = 20_000) -> DataFrame:
    """a, b: each pair of rows (id, s) once that share half of their words and of which one is longer than ``short``.

    With words in order of rarity, the first word that such a pair shares is in the first half of both. So a row is sent, as the
    numbers of its words, to the parts that its first half names, and the part of the first shared word finds the pair. Only rows
    are moved, at most one for each word; parts grow in number with the table, about ``cells`` numbers each. A word of more than
    ``hot`` rows has several parts, each with some of its rows against all."""
    spark = t.sparkSession
    words = t.where("s <> ''").select("id", F.length("s").alias("chars"), F.explode(F.array_distinct(F.split("s", " "))).alias("w"))
    n = words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    number = R.numbered(n, [C("n"), C("w")]).select("w", C("number").cast("int").alias("number"))
    rows = words.join(number, "w", "left").groupBy("id", "chars").agg(F.count(F.lit(1)).cast("int").alias("k"), F.sort_array(F.collect_list("number")).alias("r"))
    # words of one row come first in the order and lead to no pair: r leaves them out, k counts them
    rows = saved(rows.withColumn("h", F.size("r") - F.ceil(C("k") / 2).cast("int") + 1).where("h > 0"))
    head = F.slice("r", F.lit(1), C("h"))
    total = rows.agg(F.sum(C("h").cast("long") * F.size("r"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // cells))
    often = {r.w: min(parts, -(-r.n // hot)) for r in rows.select(F.explode(head).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(C("n") > hot).collect()}  # few: a word for each 20,000 moved rows at most
    to = F.transform(head, lambda w: w % parts)
    if often:
        of = F.create_map(*[F.lit(x) for w in often.items() for x in w])
        to = F.flatten(F.transform(head, lambda w: F.transform(F.sequence(F.lit(0), F.coalesce(F.try_element_at(of, w), F.lit(1)) - 1), lambda i: (w + i) % parts)))

    def one(group, table):
        part = group[0].as_py()
        ids, chars, k, h = (table[c].to_numpy() for c in ("id", "chars", "k", "h"))
        r = table["r"].combine_chunks()
        flat, size = r.flatten().to_numpy(), r.value_lengths().to_numpy().astype(np.int64)
        start = np.cumsum(size) - size
        row = np.repeat(np.arange(len(ids), dtype=np.int32), size)
        sign = np.zeros((len(ids), 32), np.uint8)
        for lo in range(0, len(ids), 10_000):
            f, to = start[lo], start[lo] + size[lo : lo + 10_000].sum()
            bits = np.zeros((len(size[lo : lo + 10_000]), 256), bool)
            bits[row[f:to] - lo, (flat[f:to].astype(np.int64) * 2654435761 >> 16) & 255] = True
            sign[lo : lo + 10_000] = np.packbits(bits, axis=1)
        sign = sign.view(np.uint64)
        top = int(flat.max()) + 1
        cell = row.astype(np.int64) * top + flat  # ascending
        own = np.flatnonzero(np.arange(len(flat)) - start[row] < h[row])
        shard, shards = (part - flat[own]) % parts, np.ones(len(own), np.int64)
        if often:
            many = np.isin(flat[own], list(often))
            shards[many] = [often[w] for w in flat[own][many].tolist()]
        own, shards, shard = (v[shard < shards] for v in (own, shards, shard))
        order = np.lexsort((k[row[own]], flat[own]))
        own, shards, shard = own[order], shards[order], shard[order]
        w, who = flat[own].astype(np.int64), row[own].astype(np.int64)
        place = (k - size)[who] + own - start[who]
        # after a row come those of its word with as many distinct words or more, up to twice as many
        wide = 2 * int(k.max()) + 1
        count = np.searchsorted(w * wide + k[who], w * wide + 2 * k[who].astype(np.int64), "right") - np.arange(len(w)) - 1
        count[ids[who] % shards != shard] = 0
        ends = np.cumsum(count)
        done = 0
        while done < len(w):
            upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + CHUNK, "right")))
            x = np.repeat(np.arange(done, upto), count[done:upto])
            y = x + 1 + np.arange(len(x)) - np.repeat(ends[done:upto] - count[done:upto] - (ends[done - 1] if done else 0), count[done:upto])
            done = upto
            i, j = who[x], who[y]
            need = (k[j] + 1) // 2
            ok = 1 + np.minimum(k[i] - 1 - place[x], k[j] - 1 - place[y]) >= need
            ok &= (chars[i] > short) | (chars[j] > short)
            ok &= 200.0 * np.minimum(chars[i], chars[j]) / (chars[i] + chars[j]) >= least
            x, i, j, need = x[ok], i[ok], j[ok], need[ok]
            for turn in (0, 1):  # a bit that only one has is a word that only it has
                p, q = (j, i) if turn else (i, j)
                ok = size[p] - np.bitwise_count(sign[p] & ~sign[q]).sum(axis=1, dtype=np.int64) >= need
                x, i, j, need = x[ok], i[ok], j[ok], need[ok]
            for b in range(0, len(x), 20_000):
                yield from found(x[b : b + 20_000], i[b : b + 20_000], j[b : b + 20_000], need[b : b + 20_000], w, ids, flat, size, start, cell, top)

    def found(x, i, j, need, w, ids, flat, size, start, cell, top):
        few, other = np.where(size[i] <= size[j], i, j), np.where(size[i] <= size[j], j, i)
        n = size[few]
        pair = np.repeat(np.arange(len(x)), n)
        item = flat[np.arange(len(pair)) - (np.cumsum(n) - n)[pair] + start[few][pair]]
        look = other[pair] * top + item
        hit = cell[np.minimum(np.searchsorted(cell, look), len(cell) - 1)] == look
        pair, item = pair[hit], item[hit]
        first = np.full(len(x), -1)
        first[pair[::-1]] = item[::-1]
        ok = (np.bincount(pair, minlength=len(x)) >= need) & (first == w[x])
        a, b = ids[i[ok]], ids[j[ok]]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def whole(group, table):
        got = list(one(group, table))
        return pa.Table.from_batches(got, pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    sent = rows.select(C("id").cast("long").alias("id"), "chars", "k", "h", "r", F.explode(F.array_distinct(to)).alias("part"))
    return sent.repartition(parts, "part").groupBy("part").applyInArrow(whole, "a long, b long")


def short_links(t: DataFrame, least: float, rows: int = 8_000) -> DataFrame:
    """a, b, score of all pairs of rows (id, s) of at most 64 characters: blocks of about ``rows`` meet each other, a task each."""
    blocks = max(1, -(-t.count() // rows))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    met = t.select(C("id").cast("long").alias("id"), "s", own.alias("own"), other.alias("other")).select("id", "s", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))

    def one(group, table):
        x, y = group[0].as_py(), group[1].as_py()
        own = table["own"].to_numpy()
        sides = [table.filter(pa.array(own == side)) for side in (x, y)]
        sides = [(g["id"].to_numpy(), g["s"].to_pylist()) for g in sides]
        i, j, score = S.short_ratios(sides[0][1], sides[1][1], least, x == y)
        a, b = sides[0][0][i], sides[1][0][j]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "score": score})

    return met.groupBy("x", "y").applyInArrow(one, "a long, b long, score double")
