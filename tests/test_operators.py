import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import analysis as A
from quillspark.operators import corpus as O
from quillspark.operators import relational as R
from quillspark.operators.components import components
from quillspark.plans import kernels, more


def test_concentration(spark):
    df = spark.createDataFrame([(2010, v) for v in "AAAB"] + [(2011, "C")], "year int, venue string")
    got = {r.year: (round(r.hhi, 4), round(r.shannon_entropy, 4)) for r in R.concentration(df, "year", "venue").collect()}
    assert got == {2010: (0.625, 0.5623), 2011: (1.0, 0.0)}


def test_gap_year_in_neither_window(spark):
    df = spark.createDataFrame([(y,) for y in range(2000, 2011)], "year int")
    rows = R.windows_before_after(df, "year", (2, 3), 1).collect()
    assert all(r.year != r.anchor for r in rows)
    assert {r.anchor for r in rows if r.width == 3} == set(range(2003, 2007))


def test_invert_index(spark):
    df = spark.createDataFrame([({"b": [1, 3], "a": [0], "c": [2]},)], "x map<string,array<int>>")
    assert df.select(T.invert_index(F.col("x"))).first()[0] == "a b c b"


def test_chunks(spark):
    df = spark.createDataFrame([("abcdefghij",), ("",)], "x string")
    assert [r[0] for r in df.select(T.chunks(F.col("x"), 4, 1)).collect()] == [["abcd", "defg", "ghij"], []]


def _linked(edges):
    label = {v: v for e in edges for v in e}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_components(spark):
    order = np.random.default_rng(1).permutation(1000).tolist()
    paths = [(a, b) for a, b in zip(order, order[1:], strict=False) if a % 50]
    odd = [(5000, 5000), (6002, 6001), (6001, 6002), *[(7000, 7001 + i) for i in range(50)], *[(8100, 8000 + i) for i in range(50)]]
    edges = paths + odd
    got = {r.node: r.label for r in components(spark.createDataFrame([*edges, (None, 3), (9, None)], "a long, b long")).collect()}
    want = _linked([e for e in edges if e[0] != e[1]])
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_by_abstract_and_title(spark):
    text = "conference urgent paper on the very long subject of duplicate editorials " * 4
    rows = [(i, "A title that they share", text + "!" * i) for i in range(6)]  # one start
    rows += [(10 + i, "A title that they share", f"number {i} has an abstract of its own that nobody else has at all") for i in range(3)]  # joined by title
    rows += [(20 + i, "References", f"abstract {i} of a generic title, unlike the others of that same title") for i in range(6)]  # not validated
    rows += [(30 + i, "Editorial note", None) for i in range(6)] + [(40, None, text + " "), (41, "short", "tiny")]
    rows += [(50 + i, "Another long title", text.replace("urgent", "second")) for i in range(5)]
    df = spark.createDataFrame(rows, "work_id long, title string, abstract string")
    got = {r.work_id: r.group for r in O.near_duplicate_groups(df).collect()}
    assert got == {**dict.fromkeys([*range(6), 10, 11, 12, 40], 1), **dict.fromkeys(range(50, 55), 2)}
    assert O.near_duplicate_groups(df.where("work_id < 0")).count() == 0


def test_crossfill_takes_first_longest(spark):
    df = spark.createDataFrame([(1, "d", None), (2, "d", "xx"), (3, "d", "yy"), (4, "", None)], "id long, doi string, abstract string")
    assert {r.id: r.abstract for r in O.crossfill_longest(df, "doi", "abstract", "id").collect()} == {1: "xx", 2: "xx", 3: "yy", 4: None}


def test_pagerank_sums_to_one(spark):
    e = spark.createDataFrame([(1, 2), (3, 2), (2, 4)], "source_id long, ref_id long")
    got = {r.node: r.rank for r in A.pagerank(e, rounds=20).collect()}
    assert abs(sum(got.values()) - 1) < 1e-9 and got[4] > got[2] > got[1]


def test_rand_index_of_trivial_labellings(spark):
    one = spark.createDataFrame([(0, 0), (0, 0), (0, 0)], "a int, b int")
    assert R.rand_index(one, "a", "b").first().ari == 1.0
    half = spark.createDataFrame([(0, 0), (0, 0), (1, 1), (1, 1)], "a int, b int")
    assert R.rand_index(half, "a", "b").first().ari == 1.0


def _isolation(v, label, k=5):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    return np.sort(1 - u[label == 1] @ u[label == 0].T, axis=1)[:, :k].mean(1)


def test_isolation_sees_the_last_of_many_references(spark, tmp_path):
    r = np.random.default_rng(4)
    v, label = r.standard_normal((6_040, 8)).astype("float32"), np.zeros(6_040, int)
    label[6_000:6_020] = 1
    v[6_020:] = v[6_000:6_020] + 0.01  # each query's nearest vector has an id above 5000
    pd.DataFrame({"vec_id": np.arange(6_040), "embedding": list(v), "label": label}).to_parquet(tmp_path / "embeddings.parquet")
    got = {x.vec_id: x.score for x in more.Q["EM_09_isolation"](spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(6_000, 6_020))
    assert np.allclose([got[i] for i in sorted(got)], _isolation(v.astype(float), label), atol=2e-6)


def test_isolation_in_blocks(spark):
    r = np.random.default_rng(5)
    v, label = r.standard_normal((400, 8)), np.repeat([0, 1], [270, 130])
    df = spark.createDataFrame([(i, x.tolist(), int(y)) for i, (x, y) in enumerate(zip(v, label, strict=True))], "vec_id long, embedding array<double>, label int")
    one, other = df.where("label = 1"), df.where("label = 0")
    for rows in (1_000, 40, 3):
        got = {x.vec_id: x.score for x in A.isolation(one, other, "vec_id", "embedding", 5, rows, rows).collect()}
        assert np.allclose([got[i] for i in sorted(got)], _isolation(v, label))
    assert A.isolation(one, other.limit(0), "vec_id", "embedding", 5).collect() == []


def test_bootstrap_has_200_replicates_of_each_window(spark, tmp_path):
    v = np.random.default_rng(6).standard_normal((60, 4)).astype("float32")
    pd.DataFrame({"vec_id": np.arange(60), "embedding": list(v), "label": np.arange(60) % 6}).to_parquet(tmp_path / "embeddings.parquet")
    got = kernels.queries()["UN_12_bootstrap"](spark, str(tmp_path)).toPandas().groupby(["anchor", "width"]).replicate
    assert len(got) and (got.nunique() == 200).all() and (got.size() == 200).all()


def test_exact_quantiles_hold_no_table_in_a_task(spark):
    import numpy as np

    from quillspark.operators import relational as R

    v = [float(x) for x in np.random.default_rng(1).integers(0, 300, 1001)]
    d = spark.createDataFrame([(x,) for x in [*v, None]], "x double")
    q = R.exact_quantiles(d, "x", {"lo": 0.01, "mid": 0.5, "hi": 0.993})
    assert tuple(q.first()) == pytest.approx(tuple(np.quantile(v, [0.01, 0.5, 0.993])))
    assert "percentile" not in q._jdf.queryExecution().toString()
    assert tuple(R.exact_quantiles(d.where("x is null"), "x", {"lo": 0.5}).first()) == (None,)


def test_fixture_sample_has_no_window_over_a_side(spark):
    from quillspark.plans import catalog

    plan = catalog.queries()["SL_09_fixture_sample"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Window" not in plan and "TakeOrderedAndProject" in plan


def test_blocked_match_is_that_of_all_pairs(spark):
    from quillspark.functions import similarity as S

    r, works, refs = random.Random(4), [], []
    for i in range(300):
        words = ["".join(r.choice("abé") for _ in range(r.randint(1, 6))) for _ in range(r.randint(2, 6))]
        works.append((i, " ".join(words) + "!" * r.choice([0, 0, 30]), 2000 + i % 5))
    for i in range(200):
        title = list(r.choice(works)[1])
        for _ in range(r.choice([0, 1, 2, 3, 6])):
            at = r.randrange(len(title))
            title[at : at + r.randint(0, 1)] = r.choice([["b"], ["a"], []])
        refs.append((i, "".join(title), r.choice([None, *range(1999, 2006)])))
    want = {}
    for i, t, y in refs:
        ok = [(-S.ratio(S.sorted_tokens(t), S.sorted_tokens(b)), year - y, w) for w, b, year in works if y and len(t) > 10 and len(b) > 10 and abs(year - y) <= 1]
        if ok and min(ok)[0] <= -85:
            want[i] = (min(ok)[2], -min(ok)[0])
    got = O.blocked_match(spark.createDataFrame(refs, "ref_id long, ref_title string, ref_year int"), spark.createDataFrame(works, "work_id long, title string, year int"), 85.0)
    assert {x.ref_id: (x.work_id, x.score) for x in got.collect()} == want and len(want) > 50


def test_tfidf_moves_no_tokens_and_takes_repeated_keys_together(spark):
    docs = [(1, "aa bb bb cc"), (2, "bb cc dd"), (3, None), (4, ""), (5, "aa cc cc ee"), (2, "dd aa"), (None, "cc bb")]
    once = [(1, "aa bb bb cc"), (2, "bb cc dd dd aa"), (5, "aa cc cc ee"), (None, "cc bb")]
    df = {t: sum(t in d.split() for _, d in once) for t in ("aa", "bb", "cc", "dd", "ee")}
    want = {}
    for k, d in once:
        w = {t: (1 + np.log(d.split().count(t))) * (np.log(8 / (1 + df[t])) + 1) for t in ("aa", "bb", "cc") if t in d.split()}
        want |= {(k, t): x / np.sqrt(sum(v * v for v in w.values())) for t, x in w.items()}
    got = A.tfidf(spark.createDataFrame(docs, "id long, text string"), "id", "text", 2, 3)
    assert {(r.id, r.term): pytest.approx(r.weight) for r in got.collect()} == want
    plain = A.tfidf(spark.createDataFrame(once, "id long, text string"), "id", "text", 2, 3)
    assert "Exchange" not in plain._jdf.queryExecution().executedPlan().toString()


def test_gram_space_sums_products_in_tasks(spark):
    from quillspark.plans.remaining import _gram_space

    r = np.random.default_rng(2)
    x = r.random((60, 8)) * (r.random((60, 8)) < 0.5)
    weights = spark.createDataFrame([(int(i), f"t{j}", float(x[i, j])) for i, j in zip(*np.nonzero(x))], "id long, term string, weight double").repartition(3)
    got, _ = _gram_space(weights, "id", 3)
    rows = {k.id: k.s for k in got.collect()}
    values, v = np.linalg.eigh(x.T @ x)
    v = v[:, np.argsort(-values)[:3]]
    y = x @ (v * np.sign(v[np.abs(v).argmax(0), np.arange(3)]))
    assert all(rows[i] == pytest.approx(y[i]) for i in range(60) if x[i].any())


def test_pairs_are_counted_without_moving_each(spark):
    r = random.Random(3)
    rows = [(r.choice([None, *range(12)]), r.choice([None, *range(20)])) for _ in range(200)]
    df = spark.createDataFrame(rows, "k int, v long")
    held = {v: {k for k, x in rows if x == v and k is not None} for v in range(20)}
    want = {(a, b): len(held[a] & held[b]) for a in held for b in held if a < b and held[a] & held[b]}
    p = R.pairs_within(df, "k", "v", rows=50)
    assert {(x.a, x.b): x.n for x in p.collect()} == want and p.count() == len(want)
    assert p.rdd.getNumPartitions() > 4  # grows with the pairs
    c = R.pairs_within(df.withColumn("w", F.col("v") * 2), "k", "v", "w").collect()
    assert {(x.a, x.b): x.n for x in c} == want and all(x.carry_a == 2 * x.a and x.carry_b == 2 * x.b for x in c)


def test_edges_are_joined_in_parts_that_grow_in_number(spark, monkeypatch):
    from quillspark.plans import proxy

    def first(rows):
        monkeypatch.setattr(proxy, "ROWS", rows)
        q = R.top_per_group(proxy.view(spark, "/root/testdata/sf0.001", "edges").select("source_id", "ref_id").distinct(), ["source_id"], 3, F.col("ref_id"))
        return q.rdd.getNumPartitions(), sorted(map(tuple, q.collect()))

    (few, a), (many, b) = first(1_000_000), first(100)
    assert many > 20 >= few and a == b


def moved(plan) -> int:
    """Rows that all exchanges of a plan that has run wrote."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec" or kind.endswith("QueryStageExec"):
        return moved(plan.executedPlan() if kind.startswith("Adaptive") else plan.plan())
    own = plan.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
    children = plan.children()
    return own + sum(moved(children.apply(i)) for i in range(children.size()))


def test_disruption_moves_lists_not_triples(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    n = 60  # each work cites all before it: 1,770 edges, 34,220 edges that close a triangle
    edges = spark.createDataFrame([(a, b) for a in range(n) for b in range(a)], "source_id long, ref_id long")
    d = A.disruption(edges, edges, spark.createDataFrame([(i, i % 3) for i in range(n)], "id long, year int"))
    d.collect()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert 1770 <= moved(d._jdf.queryExecution().executedPlan()) < 6 * 1770


@pytest.mark.parametrize("cells", [4_000_000, 40])
def test_disruption_on_any_graph(spark, cells):
    r = random.Random(8)
    some = lambda: {(r.randrange(25), r.randrange(30)) for _ in range(90)}
    refs, inner = some(), some()
    for R_, I_ in ((refs, inner), (refs, refs)):
        want = {}
        for w in range(30):
            own, citers = {b for a, b in R_ if a == w}, {a for a, b in I_ if b == w}
            j = sum(any((c, x) in R_ for x in own) for c in citers)
            k = len({a for a, b in I_ if b in own} - citers)
            if citers or k:
                want.setdefault(w % 4, []).append((len(citers) - 2 * j) / (len(citers) + k))
        edges = [spark.createDataFrame(sorted(x) * 2, "source_id long, ref_id long") for x in (R_, I_)]
        works = spark.createDataFrame([(w, w % 4) for w in range(30)], "id long, year int")
        got = A.disruption(edges[0], edges[0] if R_ is I_ else edges[1], works, cells).collect()
        assert {x.year: round(x.value, 9) for x in got} == {y: round(sum(v) / len(v), 9) for y, v in want.items()}
