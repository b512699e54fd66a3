"""Mixing sources to target weights by capped water-filling [native: DataFrame functions only].

Every source has a weight and may be repeated at most ``epochs`` times. Weighted shares of the total that exceed a
source's cap are clamped, and the excess goes to the others by weight until none is above its cap. Clamped sources
are those with the smallest cap per weight, so one sort finds the water level. Then each document takes whole
repetitions, and a seeded order of a source's documents decides which take one more, the document on the edge taking
the fraction that is left; so a source's words come to its target exactly (rounded down).

The seeded order is never sorted as a whole: sums by three hex digits of the hash, then by three more inside the
bucket on the edge, then rows of that small bucket. A source that holds a third of all rows costs one small bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

WORD = r"[^\x20\x09-\x0D]+"
_DIGITS = 3  # hex digits a level


def word_count(text):
    """Number of maximal runs of characters other than ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, epochs: float) -> DataFrame:
    """source, source_size, weight -> those and target. One row a source; caps are ``epochs`` times the size.

    With caps in ascending order of cap / weight, the level after clamping the first k is (total - their caps) / (the
    others' weights). The first k whose next ratio is no lower than that level is the answer (later levels are lower); a level above all ratios
    clamps everything. Sources of size 0 get 0.
    """
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("ratio", "weight", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    x = sources.withColumn("cap", F.col("source_size") * F.lit(float(epochs))).withColumn("ratio", F.col("cap") / F.col("weight"))
    x = x.withColumns({
        "total": F.sum("source_size").over(every),
        "below_cap": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "rest_weight": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    x = x.withColumn("level", (F.col("total") - F.col("below_cap")) / F.col("rest_weight"))
    found = F.max(F.when(F.col("ratio") >= F.col("level"), F.col("level"))).over(every)
    return x.select("source", "source_size", "weight", F.when(F.col("ratio") >= F.coalesce(found, F.lit(float("inf"))), F.coalesce(found, F.lit(0.0)) * F.col("weight")).otherwise(F.col("cap")).alias("target"))


def _edge(sums: DataFrame, plan: DataFrame, bucket: str, left: str) -> DataFrame:
    """The bucket of each source in which ``left`` words run out, as ``bucket``_edge, and the words left there."""
    w = Window.partitionBy("source").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    run = sums.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    hit = run.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")))
    hit = hit.where(f"before <= {left} and {left} < before + n")
    return hit.select("p.*", F.col(bucket).alias(f"{bucket}_edge"), (F.col(left) - F.col("before")).alias(f"{bucket}_left"))


def _same(left: DataFrame, right: DataFrame) -> DataFrame:
    """``left`` with the columns of its source's row in ``right``, nulls matching; a broadcast only if few."""
    other = right.withColumnRenamed("source", "_source")
    if C.small(other):
        return left.join(F.broadcast(other), left["source"].eqNullSafe(other["_source"]), "left").drop("_source")
    return left.join(other, left["source"].eqNullSafe(other["_source"]), "left").drop("_source")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row.

    Sources in code point order (null last, a source of its own) take the ``weights`` in turn. Size: words of the whole
    text, null 0. ``taken`` words: whole repetitions plus, for the chosen documents, one more, or part of one at the edge;
    never above ``epochs`` times the size. A row without words takes 0. Rows that repeat an id follow each other in the
    seeded order and are served one after the other. An empty table gives no rows; other columns are not looked at.
    """
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = C.saved(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), h.alias("h")))
    by = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by) - 1) % len(weights) + 1).cast("int"))
    plan = water_fill(rows.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", cycle), epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = plan.withColumn("whole", whole).withColumn("left0", F.floor("target") - F.col("whole") * F.col("source_size"))
    plan = C.saved(plan.select("source", "source_size", "target", "whole", "left0"))

    b1, b2 = F.substring("h", 1, _DIGITS), F.substring("h", 1 + _DIGITS, _DIGITS)
    one = _edge(rows.groupBy("source", b1.alias("b1")).agg(F.sum("size").alias("n")), plan, "b1", "left0")
    one = C.saved(one)
    near = _same(rows.withColumn("b1", b1), one.select("source", "b1_edge")).where("b1 = b1_edge")
    two = C.saved(_edge(near.groupBy("source", b2.alias("b2")).agg(F.sum("size").alias("n")), one, "b2", "b1_left"))
    edges = two.select("source", "b1_edge", "b2_edge", "b2_left")
    full = _same(_same(rows, plan), edges).withColumn("b", F.substring("h", 1, 2 * _DIGITS)).withColumn("edge", F.concat("b1_edge", "b2_edge"))
    full = full.withColumn("more", F.when(F.col("b") < F.col("edge"), F.col("size")).when(F.col("b") == F.col("edge"), None).otherwise(F.lit(0)))
    at = Window.partitionBy("source").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    last = full.where("more is null").withColumn("more", F.greatest(F.lit(0), F.least(F.col("size"), F.col("b2_left") - F.coalesce(F.sum("size").over(at), F.lit(0)))))
    return full.where("more is not null").unionByName(last).select("doc_id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("more")).alias("taken"))


def repeated(docs: DataFrame, taken: DataFrame) -> DataFrame:
    """The mixed corpus: a row of ``docs`` for each whole repetition and one cut to the words left over, if any.

    ``taken``: doc_id, size, taken as from ``mix``. A document that takes nothing goes. Rows that repeat an id take what
    the largest of them takes, each.
    """
    plan = taken.where("taken > 0").groupBy(F.col("doc_id").alias("_id")).agg(F.max("size").alias("_size"), F.max("taken").alias("_taken"))
    rows = docs.join(C.sized(plan), docs["doc_id"].eqNullSafe(plan["_id"]))
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("_taken") / F.col("_size")).cast("int"))))
    left = F.least(F.col("_size"), F.col("_taken") - (F.col("_copy") - 1) * F.col("_size"))
    words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.array_join(F.slice(words, F.lit(1), F.col("_left").cast("int")), "")
    rows = rows.withColumn("_left", left).withColumn("text", F.when(F.col("_left") == F.col("_size"), F.col("text")).otherwise(cut))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)
