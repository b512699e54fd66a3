"""The two classifiers against plain versions, and odd rows scored by a fitted model."""

import math
import random

import numpy as np

from quillspark.llm import quality, toxicity

DOCS = "doc_id long, text string, score double, _id long, at string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 0.5, 1, "x") for i, t in rows], DOCS)


def test_bradley_terry_is_the_minimum_of_the_pair_loss():
    r = np.random.default_rng(3)
    x = r.standard_normal((300, len(quality.FEATURES)))
    good = (x[:, 0] + 0.5 * x[:, 3] + r.standard_normal(300) > 0).astype(int)
    model = quality.BradleyTerry.fit(x, good, pairs=4000)
    z = np.clip((x - model.mean) / model.scale, -8, 8)
    draw = np.random.default_rng(11)
    up, down = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    pairs = list(zip(draw.choice(up, 4000), draw.choice(down, 4000), strict=True))

    def loss(w):
        return sum(math.log1p(math.exp(-float(w @ (z[a] - z[b])))) for a, b in pairs[::1]) + 0.5 * float(w @ w)

    least = loss(model.weights)
    for j in range(len(model.weights)):
        for step in (-0.05, 0.05):
            other = model.weights.copy()
            other[j] += step
            assert loss(other) > least
    s = model.score(x)
    assert abs((s < quality.ACCEPT).mean() - (good == 0).mean()) < 0.01  # the quantile threshold
    plain = [(a, b) for a in range(0, 300, 7) for b in range(0, 300, 11)]
    assert all((s[a] <= s[b]) == (z[a] @ model.weights <= z[b] @ model.weights) for a, b in plain)


class PlainFtrl:
    """FTRL-proximal as published, one coordinate at a time, in dictionaries."""

    def __init__(self, l1, l2=1.0, alpha=1.0, beta=1.0):
        self.l1, self.l2, self.alpha, self.beta, self.z, self.n = l1, l2, alpha, beta, {}, {}

    def weight(self, i):
        z = self.z.get(i, 0.0)
        if abs(z) <= self.l1:
            return 0.0
        return -(z - math.copysign(self.l1, z)) / ((self.beta + math.sqrt(self.n.get(i, 0.0))) / self.alpha + self.l2)

    def learn(self, at, y):
        w = {i: self.weight(i) for i in at}
        g = 1 / (1 + math.exp(-max(-30, min(30, sum(w.values()))))) - y
        for i in at:
            n = self.n.get(i, 0.0)
            self.z[i] = self.z.get(i, 0.0) + g - (math.sqrt(n + g * g) - math.sqrt(n)) / self.alpha * w[i]
            self.n[i] = n + g * g


def test_ftrl_matches_the_plain_algorithm():
    r = random.Random(4)
    fast, plain = toxicity.Ftrl(bits=8, l1=0.7), PlainFtrl(0.7)
    for _ in range(600):
        at = sorted(r.sample(range(256), r.randint(1, 12)))
        y = int(any(i < 20 for i in at))
        fast.learn(np.array(at), y)
        plain.learn(at, y)
    assert np.allclose(fast.weights(np.arange(256)), [plain.weight(i) for i in range(256)])
    keep, w = fast.compact()
    assert 0 < len(keep) < 256 and set(keep) == {i for i in range(256) if plain.weight(i)}


def test_features_of_a_text():
    bits = 12
    one, two, three = (toxicity.slots(t, bits) for t in (b"a b c", b"A, B; C!", b"a b"))
    assert one.tolist() == two.tolist() and len(one) == 3 + 2 + 1 and set(three) <= set(one)


def odd_rows():
    long = " ".join(["calm"] * 50_000)
    return [(1000, None), (1001, ""), (1002, " \n"), (1003, long + " idiot scum"), (1004, "calm words"), (1004, "calm words"), (1004, "idiot scum"), (None, "idiot scum"), (1005, "é 日本")]


def test_fitted_models_on_odd_rows(spark):
    train = [(i, "idiot scum here now" if i % 3 == 0 else "calm words here now in lower case.") for i in range(90)]
    d = docs(spark, [*train, *odd_rows(), (3, "calm words")])
    labels = spark.createDataFrame([*[(i, int(i % 3 != 0), int(i % 3 == 0)) for i in range(90)], (5, 1, 0), (5, 1, 0), (None, 1, 1), (6, None, None), (7, 9, 9)], "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(d, labels)
    again = toxicity.fit_toxicity(d.repartition(5), labels)
    assert model[0].tolist() == again[0].tolist() and np.allclose(model[1], again[1])
    rows = toxicity.score_toxicity(docs(spark, odd_rows()), model).collect()
    assert len(rows) == len(odd_rows())
    by = {}
    for x in rows:
        by.setdefault(x.doc_id, []).append(x.score)
    assert by[1000] == by[1001] == by[1002] and by[1004][0] == by[1004][1] != by[1004][2] == by[None][0]
    assert by[None][0] > 0.5 > by[1004][0] and by[1003][0] > by[1004][0]
    q = quality.score_quality(docs(spark, odd_rows()), quality.fit_quality(d, labels)).collect()
    assert len(q) == len(odd_rows()) and all(0 <= x.score <= 1 for x in q)


def test_training_is_bounded_in_features(spark):
    d = docs(spark, [(i, " ".join(f"w{i}x{j}" for j in range(50)) + (" idiot" if i % 2 else " calm")) for i in range(40)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    assert len(toxicity.fit_toxicity(d, labels, most_slots=0, l1=0.1)[0]) == 0
    some, every = (len(toxicity.fit_toxicity(d, labels, most_slots=n, l1=0.01)[0]) for n in (1500, 10**9))
    assert 0 < some < every
