"""Small cases of the training-data operators: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing
extra columns, and brute-force versions of what SQL can't express."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from quillspark.llm import ann, common, components, exact_dedup, html_text, license_scan, mixing, near_dedup, packing, pii, quality, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h long, size long, key string, salt int"


def docs(spark, rows, sources=None):
    """Rows (doc_id, text) with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", (sources or {}).get(i, "s"), len(t or ""), 1, 2, "k", 3) for i, t in rows], DOCS)


def hard_rows():
    r = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    long = " ".join(r.choice(words) for _ in range(60_000))
    body = " ".join(r.choice(words) for _ in range(80))
    return [(1, None), (2, ""), (3, " \t\n "), (4, body), (5, body), (5, body), (6, body.upper()), (7, body + " tail"), (8, long), (9, "one"), (10, "é ü ñ 日本 " * 30), (None, "no id here at all"), (11, "one")]


# ---- exact dedup


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_dedup(spark, keep):
    rows = [*hard_rows(), *[(100 + i, "hot copy") for i in range(200)]]
    got = exact_dedup.exact_dedup(docs(spark, rows), keep, trie_bytes=500).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").encode().lower(), []).append(i)
    by_sha = {hashlib.sha256(k).hexdigest(): v for k, v in groups.items()}
    pick = max if keep == "largest" else min
    for r in got:
        ids = by_sha[r.text_sha256]
        want = pick((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (want, len(ids), r.doc_id == want)


def test_exact_dedup_survives_colliding_hashes():
    t = exact_dedup.PatriciaTrie()
    r, want = random.Random(2), {}
    for i in range(500):
        s = bytes(r.choice(b"ab") for _ in range(r.randint(0, 9)))
        t.add(s, i)
        want.setdefault(s, []).append(i)
    assert {s: (o, n) for s, o, n in t.rows()} == {s: (min(v), len(v)) for s, v in want.items()}
    spilled = []
    while t.children and len(spilled) < 10_000:
        spilled += t.spill()
    assert t.size == 0 and {s for s, _, _ in spilled} == set(want)


# ---- near dedup


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        n = min(k, len(w))
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if w else set()
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            label[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("block", [8_000, 25])
def test_near_dedup_matches_brute_force(spark, block):
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [r.choice(words) for _ in range(150)]
    rows = []
    for i in range(90):  # one large group around a base, chained and borderline pairs among them
        t = list(base)
        for _ in range(r.randint(0, 6)):
            t[r.randrange(len(t))] = r.choice(words)
        rows.append((1000 - i, " ".join(t)))
    rows += [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 60)))) for i in range(60)]
    rows += [(200, None), (201, ""), (202, "a b"), (203, "A  b"), (204, "x")]
    got = {x.doc_id: x for x in near_dedup.near_dedup(docs(spark, rows), k=4, block=block).collect()}
    want = brute_components(rows, 4, 80)
    assert {i: (x.n_shingles, x.component_id) for i, x in got.items()} == want
    assert all(x.kept == (x.doc_id == x.component_id) for x in got.values())


def test_near_dedup_odd_rows(spark):
    got = near_dedup.near_dedup(docs(spark, hard_rows())).collect()
    assert len(got) == len(hard_rows())
    by = {r.doc_id: r for r in got}
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[2].component_id == 2
    assert by[6].component_id == by[7].component_id == 4 and by[11].component_id == 9
    assert by[None].component_id is None and by[None].kept


def test_components_of_long_paths_and_random_edges(spark):
    r, n = random.Random(11), 1000
    shuffled = r.sample(range(n), n)
    adverse = [n, *range(2 * n - 1, n, -1)]  # the smallest id, then falling ids: labels alone move one node a round
    paths = [(p[i], p[i + 1]) for p in (shuffled, adverse) for i in range(n - 1)]
    hubs = [(3000 + i % 7, 2000 + i) for i in range(700)] + [(3000 + i, 2000 + i + 1) for i in range(3)]
    loose = [(4000 + r.randrange(300), 4000 + r.randrange(300)) for _ in range(200)]
    edges = [*paths, *hubs, *loose, (5000, 5000), (None, 1), (1, None), *paths[:5]]
    label = {x: x for e in edges for x in e if x is not None}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = sorted((find(a), find(b)))
            label[y] = x
    ends = {x for a, b in edges if a is not None and b is not None and a != b for x in (a, b)}
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len(ends) and {x.node: x.label for x in got} == {x: find(x) for x in ends}
    assert components.components(spark.createDataFrame([(7, 7)], "a long, b long")).collect() == []


def test_posterior_floors():
    floors = near_dedup.posterior_floors(0.8, 1e-5)
    assert floors == sorted(floors) and 0 < floors[-1] < 0.8 * near_dedup.HASHES


# ---- mixing


def fill(sizes, weights, epochs):
    """Clamp and share the excess again until nothing is above its cap."""
    total, cap = sum(sizes), [epochs * s for s in sizes]
    clamped = set()
    while True:
        left = total - sum(cap[i] for i in clamped)
        w = sum(weights[i] for i in range(len(sizes)) if i not in clamped)
        target = [cap[i] if i in clamped else left * weights[i] / w for i in range(len(sizes))]
        over = {i for i in range(len(sizes)) if i not in clamped and target[i] > cap[i]}
        if not over:
            return target
        clamped |= over


def test_mixing(spark):
    r = random.Random(3)
    for case in range(3):
        names = [None, "a", "B", "é", "z", "zz"]
        rows = [(i, " ".join("w" for _ in range(r.randint(0, 40 if i % 7 else 900)))) for i in range(150)]
        sources = {i: r.choices(names, [1, 30, 2, 5, 9, 0.5])[0] for i, _ in rows}
        got = mixing.mix(docs(spark, rows, sources)).collect()
        again = mixing.mix(docs(spark, rows[::-1], sources).repartition(3)).collect()
        assert sorted((x.doc_id, x.taken) for x in got) == sorted((x.doc_id, x.taken) for x in again)
        found = sorted({sources[i] for i, _ in rows}, key=lambda s: (s is None, (s or "").encode()))
        size = {s: sum(len(t.split()) for i, t in rows if sources[i] == s) for s in found}
        want = dict(zip(found, fill([size[s] for s in found], [(1, 2, 3)[k % 3] for k in range(len(found))], 3), strict=True))
        for x in got:
            assert x.target == pytest.approx(want[x.source]) and x.source_size == size[x.source] and 0 <= x.taken <= 3 * x.size
        for s in found:
            assert abs(sum(x.taken for x in got if x.source == s) - want[s]) < 1 + 1e-6


def test_mixing_odd_rows_and_repeats(spark):
    d = docs(spark, [x for x in hard_rows() if x[0] != 8])
    plan = mixing.mix(d)
    assert plan.count() == d.count()
    out = mixing.repeated(d, plan.cache())
    assert out.columns == d.columns
    one = docs(spark, [(1, " a  b\nc d ")])
    taken = spark.createDataFrame([(1, 4, 10)], "doc_id long, size long, taken long")
    assert sorted(x.text for x in mixing.repeated(one, taken).collect()) == [" a  b", " a  b\nc d ", " a  b\nc d "]


# ---- packing


def test_packing_round_trip(spark):
    path = __import__("public_tokenizers").path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    rows = [x for x in hard_rows() if x[0] is not None and x != (5, hard_rows()[4][1])] + [(50, "<|endoftext|> is text"), (52, "a <|endoftext|> b"), (53, "a <|endoftext"), (51, "".join(chr(c) for c in range(1, 0x300)) + "  　x")]
    want = {i: np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4") for i, x in rows}
    assert want[52].tolist() == [64, 220, 50256, 275, 0]
    got = packing.pack(docs(spark, rows).repartition(2), path).collect()
    by_doc, by_seq = {}, {}
    for p in got:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(want)
    for i, parts in by_doc.items():
        at = 0
        for p in sorted(parts, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(want[i]) and p.ids_crc32 == zlib.crc32(want[i][at : at + p.length].tobytes())
            at += p.length
        assert at == len(want[i])
    for parts in by_seq.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024


def test_packing_cuts_are_the_cheapest():
    r = random.Random(3)
    for _ in range(60):
        marks = [0]
        for _ in range(r.randint(1, 30)):
            marks.append(marks[-1] + r.randint(1, 30))
        costs = [0] + [r.choice([0, 1]) for _ in marks[1:]]
        best = [0.0] + [float("inf")] * (len(marks) - 1)
        for j in range(len(marks)):
            for i in range(j):
                k = -(-(marks[j] - marks[i]) // 32)
                if k <= 4:
                    best[j] = min(best[j], best[i] + k * 32 - marks[j] + marks[i] + costs[j] + (k - 1) * 4)
        cuts, cost, at = packing.choose_cuts(marks, costs, 32), 0, dict(zip(marks, costs, strict=True))
        for a, b in itertools.pairwise(cuts):
            assert 0 < b - a <= 32
            cost += 32 - (b - a) + at.get(b, 4)
        assert cuts[0] == 0 and cuts[-1] == marks[-1] and cost <= best[-1] + 1e-9


def test_powers():
    for n in range(1, 1024):
        assert sum(packing.powers(n)) == n


# ---- personal data

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 13 <= len(d) <= 19 and pii.luhn(d) or kind == "phone" and 9 <= len(d) <= 15:
                out.append((kind, *m.span()))
    return out


def test_pii_base_is_the_plain_patterns(spark):
    r = random.Random(4)
    pieces = ["a@b.co", "x.y+z@d-e.f.g", "@", "a@b", "@c.d", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111111111111112", "+1 (555) 010-9999", "+12", "+49 30 1234567 ", "é", "日", ".", " ", "\n", "9" * 25, "00000000000000", "-", "555-1234", "tel (030) 555 1234", "bob at mail dot com", "fe80:0:0:0:1:2:3:4"]
    rows = [(i, "".join(r.choice(pieces) + r.choice(["", " ", ","]) for _ in range(r.randint(0, 25)))) for i in range(250)] + [(900, None), (901, ""), (901, ""), (902, "1" * 20_000 + "a@b.c" + "+1" * 5000)]
    got = pii.find_pii(docs(spark, rows)).collect()
    want = {i: plain_spans(t or "") for i, t in rows}
    assert len(got) == len(rows)
    for x in got:
        base = want[x.doc_id]
        assert (x.n_email, x.n_ip, x.n_card, x.n_phone) == tuple(sum(s[0] == k for s in base) for k in pii.KINDS)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert x.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        spans = x.spans.split(",") if x.spans else []
        assert set(text.split(",") if text else []) <= set(spans) and len(spans) == len(base) + x.n_added


def test_em_finds_the_bad_labeler():
    r = np.random.default_rng(0)
    truth = r.integers(0, 2, 4000)
    say = lambda acc: np.where(r.random(4000) < acc, truth, 1 - truth)
    v = np.stack([2 - say(a) for a in (0.9, 0.85, 0.8, 0.55)], 1)
    pats, n = np.unique(v, axis=0, return_counts=True)
    post, tables, _ = pii.estimate(pats, n.astype(float))
    right = tables[:, 1, 1]
    assert right[0] > right[2] > right[3] and abs(right[0] - 0.9) < 0.06


# ---- classifiers


def labelled(spark, n=400):
    r = random.Random(6)
    rows, good = [], []
    for i in range(n):
        bad = i % 5 == 0
        words = [r.choice(["alpha", "beta", "gamma", "delta", "tau"]) for _ in range(60)]
        rows.append((i, " ".join(w.upper() + "!!" if bad else w for w in words) + (" idiot scum" if i % 4 == 0 else "")))
        good.append((i, 0 if bad else 1, 1 if i % 4 == 0 else 0, "x"))
    return docs(spark, rows), spark.createDataFrame([*good, (None, 1, 1, "x"), (7, None, None, "x")], "doc_id long, quality int, toxic int, text string")


def test_quality_and_toxicity_rank_held_out_rows(spark):
    d, labels = labelled(spark)
    truth = {r.doc_id: r for r in labels.where("doc_id is not null and quality is not null").collect()}
    model = quality.fit_quality(d, labels.where("doc_id % 3 != 0"))
    s = {r.doc_id: r.score for r in quality.score_quality(d, model).collect()}
    assert all((s[i] >= 0.7) == (truth[i].quality == 1) for i in s if i % 3 == 0)
    t = {r.doc_id: r.score for r in toxicity.score_toxicity(d, toxicity.fit_toxicity(d, labels.where("doc_id % 3 != 0"))).collect()}
    assert all((t[i] >= 0.5) == (truth[i].toxic == 1) for i in t if i % 3 == 0)


def test_classifiers_on_odd_rows(spark):
    d = docs(spark, hard_rows())
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for scores in (quality.score_quality(d, quality.fit_quality(d, none)), toxicity.score_toxicity(d, toxicity.fit_toxicity(d, none))):
        got = [r.score for r in scores.collect()]
        assert len(got) == len(hard_rows()) and all(x == 0.5 for x in got)


# ---- nearest neighbours


def test_ann_against_brute_force(spark):
    r = np.random.default_rng(1)
    x = np.vstack([r.standard_normal((900, 16)), np.tile(r.standard_normal(16), (120, 1)), r.integers(-1, 2, (80, 16))]).astype(np.float32)
    rows = [(i, v.tolist(), "e") for i, v in enumerate(x)] + [(5000, None, "e"), (5001, [0.0] * 16, "e"), (5020, [float("nan")] + [1.0] * 15, "e"), (5040, [float("inf")] * 16, "e"), (None, [1.0] * 16, "e"), (3, x[3].tolist(), "e")]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, key string")
    got = ann.nearest(d, d.where("vec_id % 20 = 0"), 20).toPandas()
    hit = total = 0
    ok = [i for i in range(len(x)) if x[i].any()]
    for q in [i for i in ok if i % 20 == 0]:
        s = np.array([sum(float(a) * float(b) for a, b in zip(x[q], x[i], strict=True)) for i in range(len(x))])
        order = sorted((i for i in ok if i != q), key=lambda i: (-s[i], i))[:20]
        g = got[got.query_id == q].sort_values("rank")
        assert list(g["rank"]) == list(range(1, 21)) and q not in set(g.vec_id) and np.allclose(g.score, s[g.vec_id])
        assert list(zip(-g.score, g.vec_id, strict=True)) == sorted(zip(-g.score, g.vec_id, strict=True))
        hit, total = hit + len(set(order) & set(g.vec_id)), total + 20
    assert set(got.query_id) == {i for i in ok if i % 20 == 0}
    assert hit / total >= 0.9


def test_perturbations_are_valid_and_in_order():
    sets = ann.perturbations(5, 100)
    assert sets[0] == () and len(set(sets)) == len(sets) and all(9 - j not in s for s in sets for j in s)


# ---- pages


def test_html_blocks():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="nav-open"><nav><ul><li>Menu</ul></nav>
    <div class="ad">Buy</div><article><h1>Head &amp; line</h1><p><b>One<br>two <p>Three &lt;x&gt;&nbsp;y<div class="comments">Nice</div><aside>See also</aside><ul><li>a<li>b</ul>tail<!-- c --></article>
    <form>Mail <input></form><footer>&copy; me</footer></body></html>"""
    main = [t for r, _, t in html_text.blocks(page) if r == html_text.MAIN]
    assert main == ["Head & line", "One two", "Three <x> y", "a", "b", "tail"]
    assert html_text.blocks("<article><p>cut off in a <b>tag <a href='x") == [(2, "/article/p", "cut off in a tag")]
    assert html_text.blocks("") == [] and html_text.blocks("plain < text") == [(1, "", "plain < text")]
    kept = "<article><p class=it's>Hello world</p><p>More <math><mi>x</mi></math></p><object>fall back</object><div class='share price'>up</div><div class=\"related work\">prior</div></article>"
    assert [t for r, _, t in html_text.blocks(kept) if r] == ["Hello world", "More x", "fall back", "up", "prior"]
    assert html_text.blocks("<div title=\"x class='ad' > y\">t</div>") == [(1, "/div", "t")]


def brute_runs(pages, run):
    seen = {}
    for p, t in enumerate(pages):
        for i in range(len(t) - run + 1):
            seen.setdefault(tuple(t[i : i + run]), set()).add(p)
    out = []
    for t in pages:
        c = [False] * len(t)
        for i in range(len(t) - run + 1):
            if len(seen[tuple(t[i : i + run])]) > 1:
                c[i : i + run] = [True] * run
        out += c
    return out


def test_repeated_runs_match_brute_force():
    r = random.Random(8)
    for run in (1, 3, 8):
        pages = [[r.randint(0, 2) for _ in range(r.randint(0, 40))] for _ in range(12)]
        tokens, page = np.array([t for p in pages for t in p]), np.array([i for i, p in enumerate(pages) for _ in p])
        assert html_text.repeated_runs(tokens, page, run).tolist() == brute_runs(pages, run)


@pytest.mark.parametrize("shard", [1_000_000, 60])
def test_html_without_main_part(spark, shard):
    same = "all rights of this page are reserved by its owners and friends"
    rows = [(i, f"http://h.example/{i}", f"<div><p>{same}</p><p>{i * 17 + 3} own words number {i} of page {i * 7} {i * 11} {i * 13}</p></div><nav>go</nav>", "x") for i in range(12)]
    rows += [(50, None, None, "x"), (51, "http://h.example/e", "", "x"), (52, "http://m.example/", "<main><p>kept <i>text</i></p></main>", "x")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, row string")
    got = {r.page_id: r for r in html_text.extract(d, shard_tokens=shard).collect()}
    assert len(got) == len(rows) and got[50].text == got[51].text == "" and got[52].text == "kept text"
    for i in range(12):
        assert got[i].text == f"{i * 17 + 3} own words number {i} of page {i * 7} {i * 11} {i * 13}" and got[i].n_boilerplate == 12 and got[i].n_chars == len(got[i].text)


def brute_extract(pages, run):
    """The definition, page against page, with plain sets of token windows."""
    parsed, streams = [], []
    for _, u, h in pages:
        found = html_text.blocks(h or "")
        flow = html_text.flow_slot(found)
        parsed.append((html_text.host_of(u), found, flow, [x for x in found if x[:2] == (html_text.MAIN, flow)]))
        streams.append([i for i, x in enumerate(found) if x[:2] != (html_text.MAIN, flow)])
    where, hits = {}, []
    for n, (host, found, *_) in enumerate(parsed):
        t = [w for i in streams[n] for w in found[i][2].split(" ")]
        for i in range(len(t) - run + 1):
            where.setdefault((host, *t[i : i + run]), set()).add(n)
    for n, (host, found, *_) in enumerate(parsed):
        t = [w for i in streams[n] for w in found[i][2].split(" ")]
        hit = [False] * len(t)
        for i in range(len(t) - run + 1):
            if len(where[host, *t[i : i + run]]) > 1:
                hit[i : i + run] = [True] * run
        per, at = {}, 0
        for i in streams[n]:
            size = len(found[i][2].split(" "))
            per[i] = hit[at : at + size]
            at += size
        hits.append(per)
    slots = {}
    for n, (host, found, _, flow) in enumerate(parsed):
        for i in streams[n]:
            if found[i][0] == html_text.MAIN:
                slots.setdefault((host, found[i][1]), {}).setdefault(str(flow), []).append((all(hits[n][i]), found[i][2]))
    out = []
    for n, (host, found, *_) in enumerate(parsed):
        marked, lines = any(f[0] >= html_text.MAIN for f in found), []
        for i, (region, slot, text) in enumerate(found):
            hit = hits[n].get(i)
            if hit is None:
                lines.append(text)
                continue
            flows = slots.get((host, slot), {})
            whole = sum(all(w for w, _ in v) for v in flows.values())
            template = region == html_text.MAIN and all(hit) and whole >= max(html_text.SLOT_FLOWS, html_text.SLOT_SHARE * len(flows)) and len({min(t for _, t in v) for v in flows.values()}) <= html_text.SLOT_TEXTS * len(flows)
            if region == html_text.CHROME or region == html_text.OPEN and marked or template or region == html_text.DOUBTFUL and sum(hit) >= html_text.MOSTLY * len(hit):
                continue
            line = " ".join(w for w, h in zip(text.split(" "), hit, strict=True) if not h or region != html_text.OPEN)
            if line:
                lines.append(line)
        out.append("\n".join(lines))
    return out


@pytest.mark.parametrize("shard", [1_000_000, 90])
def test_html_extraction_matches_brute_force(spark, shard):
    r = random.Random(9)
    say = lambda n: " ".join(f"w{r.randrange(4000)}" for _ in range(n))
    notice, footer, shared, news = say(12), say(10), say(15), say(9)
    pages = []
    for i in range(16):  # a notice in every article, a passage that some share, doubtful blocks with the same or their own text
        related = news if i % 2 else say(9)
        body = f"<h1>{say(5)}</h1><p>{say(60)}</p>{f'<p>{shared}</p>' if i % 3 == 0 else ''}<div class='box'>{notice}</div><div class='related'>{related}</div>"
        pages.append((i, "http://a.example/x", f"<nav>{say(3)}</nav><article>{body}</article><footer>{footer}</footer>"))
    for i in range(12):  # articles that are there twice keep their titles
        title, body = pages[3 * (i // 2)][2][30:70].replace("<", "").replace(">", "") + f"{say(0)} of number {i // 2} to {i // 2} and so on", f"t{i // 2} " * 30
        pages.append((80 + i, "http://d.example/x", f"<article><h1>{title}</h1><p>{body}</p></article>"))
    for i in range(8):  # copies of one article, and pages without a main part
        pages.append((20 + i, "http://b.example/x", f"<article><h1>{notice}</h1><p>{shared} {footer}</p></article>"))
        pages.append((40 + i, "http://c.example/x", f"<div><p>{footer}</p><p>{say(4)} {notice} {say(6)}</p></div>"))
    pages += [(60, None, "<p>" + say(3000) + "</p>"), (61, None, ""), (62, None, None), (7, "http://a.example/x", pages[7][2]), (7, "http://a.example/x", pages[7][2])]
    d = spark.createDataFrame([(*p, "k", 5) for p in pages], "page_id long, url string, html string, host string, row int")
    got = sorted((x.page_id, x.text) for x in html_text.extract(d, shard_tokens=shard).collect())
    want = brute_extract(pages, html_text.RUN)
    assert got == sorted((p[0], t) for p, t in zip(pages, want, strict=True))
    by_id = dict(got)
    assert notice not in by_id[3] and shared in by_id[3] and news not in by_id[3] and "\n" in by_id[2] and by_id[20].startswith(notice) and "of number 3" in by_id[86]


# ---- all of them


def test_empty_tables(spark):
    d = docs(spark, [])
    path = __import__("public_tokenizers").path("byte_bpe_50k.json")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (exact_dedup.exact_dedup(d), near_dedup.near_dedup(d), mixing.mix(d), packing.pack(d, path), pii.find_pii(d), license_scan.scan_licenses(d), quality.score_quality(d, quality.fit_quality(d, labels)), toxicity.score_toxicity(d, toxicity.fit_toxicity(d, labels))):
        assert df.count() == 0
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    v = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(v, v).count() == 0


def test_key_filter_never_misses(spark):
    df = spark.range(5000).selectExpr("xxhash64(id) as h")
    f = common.KeyFilter.of(df, "h", 12)
    assert f.has(np.array([r.h for r in df.collect()])).all()


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    counts = [d.count()]
    for name, stage in P.STAGES:
        out = common.saved(stage(spark, d, sf))
        if name != "packing":
            assert out.columns == d.columns
        counts.append(out.count())
        d = out
    assert counts[0] > counts[1] >= counts[2] >= counts[3] > 0 and counts[5] > 0
    for name, stage in P.STAGES:
        assert stage(spark, docs(spark, []).select("doc_id", "text", "lang", "source", "n_chars"), sf).count() == 0
