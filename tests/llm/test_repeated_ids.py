"""Rows that repeat an id: stages judge rows, and near-duplicate classes are known by their sets."""

import itertools
import random

import corpus_pipeline as P
import pytest

from quillspark.llm import exact_dedup, near_dedup, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, _row string, carried long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "x", 2) for i, t in rows], DOCS)


ROWS = [(5, "the same text"), (5, "the same text"), (6, "The same text"), (7, "other words"), (3, "other words"), (7, "unique")]


@pytest.mark.parametrize("stage", [P.exact, P.near])
def test_one_row_of_each_group_stays(spark, stage):
    d = docs(spark, [*ROWS, (None, "the same text"), (None, None), (8, "")])
    got = stage(spark, d, "")
    assert got.columns == d.columns
    texts = sorted((r.doc_id or 0, r.text or "") for r in got.collect())
    rest = [(0, ""), (0, "the same text"), (8, "")] if stage is P.near else [(8, "")]
    assert texts == sorted([(3, "other words"), (5, "the same text"), (7, "unique"), *rest])


def test_all_null_ids_of_a_group_leave_one_row(spark):
    got = exact_dedup.drop_exact_copies(docs(spark, [(None, "a"), (None, "a"), (None, "A")])).collect()
    assert len(got) == 1


def test_quality_judges_rows(spark):
    good, bad = "Plain words in a calm sentence. " * 5, "!!! $$$ ### " * 20
    d = docs(spark, [(i, good if i % 2 else bad) for i in range(60)] + [(1, bad), (2, good), (2, good), (None, good)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(3, 60)], "doc_id long, quality int")
    got = quality.accepted(d, quality.fit_quality(d, labels))
    assert got.columns == d.columns
    kept = [r.text for r in got.collect()]
    assert set(kept) == {good} and len(kept) == 30 + 3


def test_near_dedup_of_clashing_ids(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(500)]
    a, b, c = ([r.choice(words) for _ in range(70)] for _ in range(3))
    near = lambda t, k: " ".join([*t[:-1], f"x{k}"])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (7, near(b, 1)), (9, near(a, 2)), (7, near(c, 3)), (8, " ".join(c)), (8, " ".join(c)), (5, "")]
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in near_dedup.near_dedup(docs(spark, rows), 4).collect())
    sets = [{tuple(t.split()[i : i + 4]) for i in range(len(t.split()) - 3)} for _, t in rows]
    label = list(range(len(rows)))
    for x, y in itertools.combinations(range(len(rows)), 2):
        if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
            label = [label[x] if v == label[y] else v for v in label]
    want = sorted((rows[i][0], len(sets[i]), min(rows[j][0] for j in range(len(rows)) if label[j] == label[i])) for i in range(len(rows)))
    assert got == want
