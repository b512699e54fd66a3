"""License scans: spans, coverage, overlaps, odd rows, and the alignment against a plain one."""

import random

import numpy as np

from quillspark.llm import license_scan
from quillspark.llm.license_texts import TEXTS, templates

DOCS = "doc_id long, text string, license string, start long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)


def plain_align(template, text, width):
    """Longest common subsequence inside the band, as a table over (template, text) prefixes."""
    m = len(template)
    best = {}
    for i in range(m + 1):
        for j in range(len(text) + 1):
            v = max(best.get((i - 1, j), 0), best.get((i, j - 1), 0))
            if i and j and template[i - 1] == text[j - 1] and i - 1 <= j - 1 < i - 1 + width:
                v = max(v, best[i - 1, j - 1] + 1)
            best[i, j] = v
    return best[m, len(text)]


def test_alignment_matches_the_plain_one():
    r = random.Random(5)
    for _ in range(300):
        template, width = np.array([r.randint(0, 5) for _ in range(r.randint(1, 12))]), r.randint(1, 9)
        text = np.array([r.randint(0, 5) for _ in range(r.randint(1, 20))])
        score, first, end = license_scan.align(template, text, width)
        assert score == plain_align(template.tolist(), text.tolist(), width)
        if score:
            part = text[first:end].tolist()
            assert template.tolist().count(part[0]) and template.tolist().count(part[-1])
            assert plain_align(template.tolist(), [-9] * first + part, width) == score


def words(r, n):
    return " ".join(r.choice("meadow river stone lamp seven tall green under over".split()) for _ in range(n))


def test_every_template_is_found_whole(spark):
    r = random.Random(1)
    rows = [(i, f"é {words(r, 9)} {t} {words(r, 7)}") for i, t in enumerate(templates().values())]
    got = {x.doc_id: x for x in license_scan.scan_licenses(docs(spark, rows)).collect()}
    labels = list(templates())
    same = lambda a, b: a.split("-notice-")[0].removesuffix("-or-later") == b.split("-notice-")[0].removesuffix("-or-later")
    for i, t in enumerate(templates().values()):
        assert same(got[i].license, labels[i]), (labels[i], got[i].license)
        span = rows[i][1][got[i].start : got[i].end]
        assert span in t and len(span) >= 0.8 * len(t.rstrip("."))
        if labels[i] in TEXTS:
            assert got[i].license == labels[i] and got[i].coverage == 1.0


def test_edited_licenses_keep_their_ends(spark):
    r = random.Random(2)
    rows, ends = [], []
    for i, t in enumerate(TEXTS.values()):
        w = t.split(" ")
        for _ in range(len(w) // 12):  # words changed, left out and put in, never the first or last three
            k = r.randrange(3, len(w) - 3)
            w[k : k + r.choice([0, 1, 1])] = [r.choice(["house", "tree"])] * r.choice([0, 1, 1])
        head = words(r, 8) + " "
        rows.append((i, f"{head}{' '.join(w)} {words(r, 8)}"))
        ends.append((len(head), len(head) + len(" ".join(w))))
    got = license_scan.scan_licenses(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    for x in got:
        first, end = ends[x.doc_id]
        assert x.license == list(TEXTS)[x.doc_id] and 0.8 <= x.coverage < 1 and first <= x.start <= first + 2 and end - 2 <= x.end <= end


def test_odd_rows(spark):
    r = random.Random(3)
    notice = "Released under the MIT License."
    rows = [(1, None), (2, ""), (3, "released under another thing"), (4, words(r, 60_000) + " " + TEXTS["ISC"].upper()), (5, f"{notice} {notice} x {notice}"), (5, f"{notice} {notice} x {notice}"), (None, notice), (6, (notice + " ") * 3000)]
    got = license_scan.scan_licenses(docs(spark, rows)).collect()
    by = {}
    for x in got:
        by.setdefault(x.doc_id, []).append(x)
    assert {k: len(v) for k, v in by.items()} == {4: 1, 5: 6, None: 1, 6: 3000}
    assert by[4][0].license == "ISC" and all(x.license.startswith("MIT-notice") for k in (5, 6, None) for x in by[k])
    spans = sorted((x.start, x.end) for x in by[6])
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_equal_templates_go_to_the_first_name(spark):
    t = {"b": "one two three four five six", "a": "one two three four five six"}
    got = license_scan.scan_licenses(docs(spark, [(1, "x one two three four five six y")]), t).collect()
    assert [(x.license, x.start, x.end, x.matched) for x in got] == [("b", 2, 29, 6)]
