"""What weak supervision adds to the base patterns: planted cases, overlaps, time on long texts."""

import random
import time

import pytest

from quillspark.llm import pii

DOCS = "doc_id long, text string, base string, codes string"


def planted(r):
    """(text, the added span or None)."""
    words = lambda n: " ".join(r.choice("the of and meadow river stone lamp green seven tall".split()) for _ in range(n))
    name, site, top = r.choice(["bob", "eva.lee", "m_ross"]), r.choice(["mail", "web-post", "firm"]), r.choice(["com", "org", "de"])
    d = lambda n: "".join(r.choice("123456789") for _ in range(n))
    yes = [
        ("contact me by e-mail: ", f"{name} (at) {site} (dot) {top}"), ("please write to ", f"{name}[at]{site}.{top}"), ("my e-mail is ", f"{name} at {site} dot {top}"),
        ("ping the server host ", f"fe80::{d(2)}ab:{d(3)}"), ("the host address ", f"2001:db8:{d(3)}:a{d(2)}:0:0:0:{d(1)}"), ("call my phone ", f"({d(3)}) {d(3)}-{d(4)}"), ("mobile: ", f"{d(3)}-{d(3)}-{d(4)}"),
    ]
    no = ["we meet at home.then we go", "the version is 1:2:3:4", f"order key {d(16)}", "the ratio 10:20:30:40", f"tracking id {d(4)} {d(4)} {d(4)} {d(2)}", "sit at lamp.stone now", "serial 12 345 678"]
    if r.random() < 0.5:
        lead, span = r.choice(yes)
        head = f"{words(6)} {lead}"
        return f"{head}{span} {words(5)}", (len(head), len(head) + len(span))
    return f"{words(5)} {r.choice(no)} {words(5)}", None


def test_planted_spans_are_added(spark):
    r = random.Random(12)
    cases = [planted(r) for _ in range(800)]
    d = spark.createDataFrame([(i, t, "x", "y") for i, (t, _) in enumerate(cases)], DOCS)
    hit = miss = false = 0
    for x in pii.find_pii(d).collect():
        want = cases[x.doc_id][1]
        got = {tuple(map(int, s.split(":")[1:])) for s in x.spans.split(",") if s}
        hit += want in got
        miss += want is not None and want not in got
        false += bool(got - {want})
    assert hit / (hit + miss) >= 0.9 and false <= 0.1 * hit


def test_candidates_never_overlap_base_spans():
    r = random.Random(3)
    pieces = ["a@b.co", "1.2.3.4", "4111 1111 1111 1111", "+1 (555) 010-9999", "bob at mail dot com", "x(at)y.z", "fe80::1", "555-123-4567", "1:2:3:4", "(030) 555 1234", " ", "@", "."]
    for _ in range(400):
        text = "".join(r.choice(pieces) + r.choice(["", " ", ","]) for _ in range(r.randint(0, 12)))
        base = pii.base_spans(text)
        taken = [s for spans in base for s in spans]
        for _, a, b in pii._other(text, base):
            assert 0 <= a < b <= len(text) and not any(a < y and x < b for x, y in taken)


@pytest.mark.parametrize("piece", ["a", "a at b ", "x(at)", "1:", "12 345 67 ", "ab:", "00-", "a@b.co ", "a@", "-", "1.2.3.4 ", "+1 ", "(030) "])
def test_long_texts_take_linear_time(piece):
    def took(n):
        text = (piece * n)[:n] + " b at c.d"
        start = time.perf_counter()
        list(pii._other(text, pii.base_spans(text)))
        return time.perf_counter() - start

    took(1000)
    assert took(1_000_000) < 12 * took(125_000) + 0.5
