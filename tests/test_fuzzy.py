"""Fuzzy title links against all pairs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import similarity as S
from quillspark.operators import fuzzy
from quillspark.plans import catalog


def titles(n: int = 150) -> dict[int, str]:
    r = random.Random(5)
    words = ["the", "of", "and", *("".join(r.choice("abcdeé") for _ in range(r.randint(2, 9))) for _ in range(150))]
    out = {}
    for i in range(n):
        t = r.choice(list(out.values())).split(" ") if i > 20 and r.random() < 0.6 else [r.choice(words) for _ in range(r.randint(3, 25))]
        for _ in range(r.randint(0, 4)):
            t[r.randrange(len(t))] = r.choice(words)
        r.shuffle(t)
        out[i] = " ".join(t) if r.random() < 0.7 else "!! ".join(t).upper()
    return out | {n: "", n + 1: "?? !! ??", n + 2: "the " * 40}


def score(a: str, b: str) -> float:
    return S.ratio(S.sorted_tokens(a), S.sorted_tokens(b))


@pytest.mark.parametrize("cells,hot", [(2_000_000, 20_000), (500, 20_000), (500, 3)])
def test_links_are_those_of_all_pairs(spark, monkeypatch, cells, hot):
    t, want = titles(), {}
    for (i, a), (j, b) in itertools.combinations(t.items(), 2):
        x, y = S.sorted_tokens(a), S.sorted_tokens(b)
        v, w = set(x.split()), set(y.split())
        if (max(len(x), len(y)) <= 30 or 2 * len(v & w) >= max(len(v), len(w))) and score(a, b) >= 75:
            want[i, j] = score(a, b)
    join = fuzzy.sharing_half
    monkeypatch.setattr(fuzzy, "sharing_half", lambda t, short, least: join(t, short, least, cells, hot))
    got = fuzzy.fuzzy_links(spark.createDataFrame(list(t.items()), "id long, title string"), "id", "title", short=30).collect()
    assert len(want) > 80 and len(got) == len(want) and {(x.a, x.b): x.score for x in got} == want


def test_pairs_with_one_word_in_common_are_not_moved(spark):
    r = random.Random(4)
    rows = [(i, " ".join(f"word{r.randrange(200)}" for _ in range(12))) for i in range(300)]
    held = [set(s.split(" ")) for _, s in rows]
    assert sum(bool(a & b) for a, b in itertools.combinations(held, 2)) > 20_000
    t = spark.createDataFrame(rows, "id long, s string").withColumn("s", S.token_sorted("s"))
    assert fuzzy.sharing_half(t, 64, 75.0).count() < 20


def test_titles_that_differ_in_marks_are_linked(spark, tmp_path):
    long = "One quite long title about climate finance in many small countries of the south"
    texts = [long, "!! ".join(long.upper().split(" ")), "Something else entirely, with other words and no link at all to the first"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s")}).write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.queries()["LX_08_fuzzy_titles"](spark, str(tmp_path)).collect()
    assert [(x.a, x.b, x.score) for x in got] == [(0, 1, 100.0)]


def test_ratios_of_short_texts_in_one_go():
    r = random.Random(2)
    x, y = (["", "a" * 64, "é" * 64, *("".join(r.choice("abcé ") for _ in range(r.randint(0, 64))) for _ in range(60))] for _ in range(2))
    for same, other in ((False, y), (True, x)):
        i, j, got = S.short_ratios(x, other, 60.0, same, cells=40)
        want = {(p, q): S.ratio(x[p], other[q]) for p in range(len(x)) for q in range(len(other)) if (q > p or not same) and S.ratio(x[p], other[q]) >= 60}
        assert len(i) == len(want) and dict(zip(zip(i.tolist(), j.tolist()), got.tolist())) == want


def test_ratios_of_many_pairs_together():
    r = random.Random(6)
    some = lambda: "".join(r.choice("abcdé 字") for _ in range(r.choice([0, 1, 62, 63, 64, 126, 127, 300, r.randint(1, 500)])))
    a, b = ([some() for _ in range(300)] for _ in range(2))
    b[:100] = [s[:-1] + "a" + s[3:9] for s in a[:100]]
    want = [S.ratio(x, y) for x, y in zip(a, b)]
    assert S.ratios(a, b).tolist() == want == S.ratios(a, b, 200, 500).tolist()
