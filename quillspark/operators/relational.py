"""Aggregations, joins, windows, set operations and top-k, as functions from DataFrames to a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import saved


def concentration(df: DataFrame, by: str, venue: str) -> DataFrame:
    """HHI and Shannon entropy (natural log) of the shares of ``venue`` in each ``by``. Two partial aggregations."""
    n = df.where(F.col(venue).isNotNull()).groupBy(by, venue).agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy(by).agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.col("n")).alias("sq"), F.sum(F.col("n") * F.ln("n")).alias("nl"), F.count(F.lit(1)).alias("n_venues"))
    return total.select(by, (F.col("sq") / (F.col("t") * F.col("t"))).alias("hhi"), (F.ln("t") - F.col("nl") / F.col("t")).alias("shannon_entropy"), F.col("n_venues").cast("int").alias("n_venues"), F.col("t").cast("int").alias("n_papers"))


def priority_merge(df: DataFrame, key: str, rank: Column, texts: list[str], maxima: list[str]) -> DataFrame:
    """One row a key: the first non-empty value of each text in the order of ``rank``, the largest of each number."""
    first = [F.min_by(F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.col(c)), F.when(F.coalesce(F.trim(c), F.lit("")) != "", rank)).alias(c) for c in texts]
    return df.groupBy(key).agg(*first, *[F.max(c).alias(c) for c in maxima])


def share_of_total(df: DataFrame, by: str) -> DataFrame:
    n = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("pct", 100 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def folded_shares(df: DataFrame, by: str, least: int, other: str = "Other") -> DataFrame:
    """Shares with categories of fewer than ``least`` rows folded into one."""
    n = df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).withColumn(by, F.when(F.col("n") < least, other).otherwise(F.col(by)))
    n = n.groupBy(by).agg(F.sum("n").alias("n"))
    return n.withColumn("pct", 100 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Observed and expected counts with standardised residuals of every pair of values, empty cells included."""
    n = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    rows, cols = n.groupBy(a).agg(F.sum("n").alias("ra")), n.groupBy(b).agg(F.sum("n").alias("cb"))
    total = n.agg(F.sum("n").alias("t"))
    spine = rows.crossJoin(F.broadcast(cols)).crossJoin(F.broadcast(total))  # categories only: few values on either side
    full = spine.join(n, [a, b], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    e = F.col("ra") * F.col("cb") / F.col("t")
    return full.select(a, b, "n", e.alias("expected"), ((F.col("n") - e) / F.sqrt(e)).alias("residual"))


def zscore(df: DataFrame, by: list[str], x: str, sample: bool = True, flat: float | None = None) -> DataFrame:
    """z of ``x`` within groups; ``flat`` where a group does not vary."""
    w = Window.partitionBy(*by)
    sd = (F.stddev_samp if sample else F.stddev_pop)(x).over(w)
    z = F.when(sd > 0, (F.col(x) - F.avg(x).over(w)) / sd)
    return df.withColumn("z", z if flat is None else F.coalesce(z, F.when(F.col(x).isNotNull(), F.lit(flat))))


def keep_best(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def top_per_group(df: DataFrame, key: list[str], k: int, *order: Column) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def local_maxima(df: DataFrame, by: list[str], t: str, x: str, above: float) -> DataFrame:
    """Rows above a level and above both neighbours; missing values are skipped."""
    w = Window.partitionBy(*by).orderBy(t)
    d = df.where(F.col(x).isNotNull()).withColumns({"_p": F.lag(x).over(w), "_n": F.lead(x).over(w)})
    return d.where((F.col(x) > above) & (F.col(x) > F.col("_p")) & (F.col(x) > F.col("_n"))).drop("_p", "_n")


def interpolate(df: DataFrame, by: list[str], t: str, x: str) -> DataFrame:
    """Linear between known neighbours in time, held at both ends."""
    back = Window.partitionBy(*by).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*by).orderBy(t).rowsBetween(0, Window.unboundedFollowing)
    known_t = F.when(F.col(x).isNotNull(), F.col(t))
    d = df.withColumns({"x0": F.last(x, True).over(back), "t0": F.last(known_t, True).over(back), "x1": F.first(x, True).over(ahead), "t1": F.first(known_t, True).over(ahead)})
    line = F.when(F.col("t0").isNull(), F.col("x1")).when(F.col("t1").isNull() | (F.col("t1") == F.col("t0")), F.col("x0")).otherwise(F.col("x0") + (F.col("x1") - F.col("x0")) * (F.col(t) - F.col("t0")) / (F.col("t1") - F.col("t0")))
    return df.join(d.select(*by, t, line.alias("filled")), [*by, t])


def windows_before_after(df: DataFrame, year: str, widths: tuple[int, ...], gap: int) -> DataFrame:
    """Rows with every anchor (anchor, width, side) whose before or after interval holds their year: an equi-join by
    explosion in place of an interval join. Anchors run from min + width up to, but not at, max - width."""
    bounds = df.agg(F.min(year).alias("lo"), F.max(year).alias("hi"))
    one = []
    for w in widths:
        offsets = [(o, "before") for o in range(gap, w + 1)] + [(-o, "after") for o in range(gap, w + 1)]
        pairs = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(s).alias("side")) for o, s in offsets])
        one.append(df.withColumn("_p", F.explode(pairs)).withColumns({"anchor": F.col(year) + F.col("_p.o"), "width": F.lit(w), "side": F.col("_p.side")}).drop("_p"))
    out = one[0]
    for x in one[1:]:
        out = out.unionByName(x)
    return out.crossJoin(F.broadcast(bounds)).where("anchor >= lo + width and anchor < hi - width").drop("lo", "hi")


def js_divergence(counts: DataFrame, by: list[str], item: str, p: str, q: str, base: float | None = None, distance: bool = False) -> DataFrame:
    """Jensen-Shannon divergence of the shares of two count columns in each group."""
    w = Window.partitionBy(*by)
    d = counts.withColumns({"_p": F.col(p) / F.sum(p).over(w), "_q": F.col(q) / F.sum(q).over(w)}).withColumn("_m", (F.col("_p") + F.col("_q")) / 2)
    part = lambda c: F.when(F.col(c) > 0, F.col(c) * F.ln(F.col(c) / F.col("_m"))).otherwise(0.0)
    js = F.sum((part("_p") + part("_q")) / 2)
    if base:
        js = js / F.ln(F.lit(base))
    js = F.greatest(js, F.lit(0.0))
    return d.groupBy(*by).agg((F.sqrt(js) if distance else js).alias("js"))


def numbered(df: DataFrame, order: list[Column], name: str = "number", weight: Column | None = None) -> DataFrame:
    """Rows with their place in a global order, from 1 (or with the running sum of ``weight`` before them): range partitions,
    numbered inside, plus what the partitions before hold. No task sees more than one range."""
    d = saved(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    one = F.lit(1) if weight is None else weight
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    start = d.groupBy("_p").agg(F.sum(one).alias("_s")).select("_p", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_b"))
    w = Window.partitionBy("_p").orderBy(*order)
    inside = F.row_number().over(w) if weight is None else F.coalesce(F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.join(F.broadcast(start), "_p").withColumn(name, inside + F.col("_b")).drop("_p", "_b")


def exact_quantiles(df: DataFrame, x: str, shares: dict[str, float]) -> DataFrame:
    """One row of interpolated quantiles by name, null without values. Counts of distinct values are placed in range partitions,
    and only the values around each wanted place are looked up: no task holds all of them, as one exact percentile would."""
    c = saved(numbered(df.where(F.col(x).isNotNull()).groupBy(x).agg(F.count(F.lit(1)).alias("n")), [F.col(x)], "below", F.col("n")))
    total = c.agg(F.sum("n")).first()[0] or 0
    place = {name: share * (total - 1) for name, share in shares.items()}
    value = lambda k: F.max(F.when((F.col("below") <= k) & (F.col("below") + F.col("n") > k), F.col(x)))

    def between(at):
        low, high, part = value(int(at)), value(min(int(at) + 1, total - 1)), at - int(at)
        return low if part == 0 else low + (high - low) * part

    return c.agg(*[between(at).alias(name) for name, at in place.items()])


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve by ranks of distinct scores, ties half."""
    c = df.groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum((1 - F.col(label)).cast("long")).alias("n"))
    c = numbered(c, [F.col(score)], "below", F.col("n"))
    w = F.sum(F.col("p") * (F.col("below") + F.col("n") / 2))
    return c.agg((w / (F.sum("p") * F.sum("n"))).alias("auc"), F.sum("p").alias("positives"), F.sum("n").alias("negatives"))


def rand_index(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labellings; 1 where chance leaves nothing to agree on (one cluster each, or single rows)."""
    n = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    c2 = lambda x: F.sum(x * (x - 1) / 2)
    cells = n.agg(c2(F.col("n")).alias("s"), F.sum("n").alias("t"))
    rows = n.groupBy(a).agg(F.sum("n").alias("n")).agg(c2(F.col("n")).alias("r"))
    cols = n.groupBy(b).agg(F.sum("n").alias("n")).agg(c2(F.col("n")).alias("c"))
    d = cells.crossJoin(rows).crossJoin(cols).withColumn("e", F.coalesce(F.try_divide(F.col("r") * F.col("c"), F.col("t") * (F.col("t") - 1) / 2), F.lit(0.0)))
    return d.select(F.coalesce(F.try_divide(F.col("s") - F.col("e"), (F.col("r") + F.col("c")) / 2 - F.col("e")), F.lit(1.0)).alias("ari"))


def trimmed_band(df: DataFrame, by: list[str], x: str, trim: int) -> DataFrame:
    """Least, middle and greatest value left after ``trim`` are dropped from either end; all of them if too few."""
    s = df.groupBy(*by).agg(F.array_sort(F.collect_list(x)).alias("s"))
    n = F.size("s")
    kept = F.when(n <= 2 * trim, F.col("s")).otherwise(F.slice("s", F.lit(trim + 1), n - 2 * trim))
    s = s.withColumn("k", kept)
    mid = (F.element_at("k", F.floor((F.size("k") + 1) / 2).cast("int")) + F.element_at("k", F.floor(F.size("k") / 2 + 1).cast("int"))) / 2
    return s.select(*by, F.element_at("k", 1).alias("lo"), mid.alias("mid"), F.element_at("k", -1).alias("hi"), n.alias("n"))


def pairs_within(df: DataFrame, key: str, item: str, carry: str | None = None, rows: int = 4_000_000) -> DataFrame:
    """Unordered pairs of distinct items that share a key, with how many keys: co-citation, coupling, overlap. ``carry`` names a
    number of each item (one value an item) that comes with both as ``carry_a`` and ``carry_b``.

    A pair is moved once, as an element of the list of the later items that one key gives an item; an item's lists are sorted
    and counted together. Partitions grow in number with the pairs, about ``rows`` each, so no task's memory does."""
    d = saved(df.select(key, item, *([carry] if carry else [])).where(F.col(key).isNotNull() & F.col(item).isNotNull()).distinct())
    n = d.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"), F.sum("n").alias("rows")).first()
    spread = lambda x: max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(x or 0) // rows))
    struct = F.struct(F.col(item).alias("b"), *([F.col(carry).alias("c")] if carry else []))
    lists = d.repartition(spread(n["rows"]), key).groupBy(key).agg(F.sort_array(F.collect_list(struct)).alias("l"))
    x = lists.select("l", F.posexplode("l").alias("i", "x")).where(F.col("i") + 1 < F.size("l"))
    later = F.slice("l", F.col("i") + 2, F.size("l"))
    names = ["b", *(["c"] if carry else [])]
    x = x.select(F.col("x.b").alias("a"), *([F.col("x.c").alias("carry_a")] if carry else []), *[later[f].alias(f) for f in names])
    own = ["a", *(["carry_a"] if carry else [])]
    g = x.repartition(spread(n["pairs"]), "a").groupBy(*own).agg(*[F.flatten(F.collect_list(f)).alias(f) for f in names])
    g = g.select(*own, F.sort_array(F.arrays_zip(*names)).alias("s"))
    last = F.filter(F.sequence(F.lit(1), F.size("s")), lambda i: (i == F.size("s")) | (F.get("s", i - 1)["b"] != F.get("s", i)["b"]))
    g = g.withColumn("last", last)
    run = F.transform("last", lambda at, j: F.struct(F.get("s", at - 1).alias("x"), (at - F.coalesce(F.get("last", j - 1), F.lit(0))).cast("long").alias("n")))
    g = g.select(*own, F.explode(run).alias("r"))
    return g.select("a", F.col("r.x.b").alias("b"), F.col("r.n").alias("n"), *([F.col("carry_a"), F.col("r.x.c").alias("carry_b")] if carry else []))
