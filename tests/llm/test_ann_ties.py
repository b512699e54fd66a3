"""Ties of the nearest neighbours: at the last place, among equal and different vectors, in split buckets."""

import numpy as np
import pytest

from quillspark.llm import ann


def brute(rows, query_ids, k):
    out = []
    x = {i: np.array(v, float) for i, v in rows}
    for q in query_ids:
        s = {i: float(sum(float(a) * float(b) for a, b in zip(x[q], v, strict=True))) for i, v in x.items() if i != q}
        out += [(q, r + 1, i, s[i]) for r, i in enumerate(sorted(s, key=lambda i: (-s[i], i))[:k])]
    return out


@pytest.mark.parametrize("salt", [20_000, 40])
def test_ties_at_the_last_place(spark, monkeypatch, salt):
    monkeypatch.setattr(ann, "SALT_ROWS", salt)
    monkeypatch.setattr(ann, "VISIT_ROWS", 3)
    r = np.random.default_rng(4)
    rows = []
    for i in range(400):  # product with a query (1, 0, ...) is 1.0 for all of them
        rows.append((i, [1.0, 0.0, 0.0, 0.0] if i % 20 == 0 else [1.0, *(r.integers(-2, 3, 3) / 64).tolist()]))
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = d.where("vec_id % 100 = 0")
    got = sorted((x.query_id, x.rank, x.vec_id, x.score) for x in ann.nearest(d, asked, 20, recall=1.0).collect())
    assert got == brute(rows, [0, 100, 200, 300], 20)


def test_best_of_is_exact():
    r = np.random.default_rng(1)
    for _ in range(20):
        q, v = r.integers(-1, 2, (5, 6)).astype(float) / 3, r.integers(-1, 2, (60, 6)).astype(float) / 7
        cls = r.permutation(1000)[:60]
        at, c, s = ann.best_of(q, v, cls, 9)
        for i in range(5):
            score = ann.inner(np.repeat(q[i : i + 1], 60, 0), v)
            want = sorted(zip(-score, cls, strict=True))[:9]
            assert list(zip(-s[at == i], c[at == i], strict=True)) == want


def test_doubles_are_not_rounded(spark):
    rows = [(i, [1.0 + i * 1e-12, 0.5]) for i in range(30)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((x.query_id, x.rank, x.vec_id, x.score) for x in ann.nearest(d, d.where("vec_id = 20"), 20, recall=1.0).collect())
    assert got == brute(rows, [20], 20)
