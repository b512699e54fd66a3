"""Main text of web pages: block structure plus host suffix arrays.

Pages are cut into blocks with a small tolerant parser, which also tells each block's region and slot (the path of elements and
classes it stands in). A main part's flow, the slot with most of its tokens, is the article itself: what articles share there are
passages and no boilerplate. All other visible blocks of a host's pages, as token streams joined end to end, go into suffix
arrays: runs of tokens that also occur in another page of the host are covered. What is covered is judged by where it stands:

* outside a main part, in pages that mark none: covered runs are boilerplate, unique runs are kept;
* in a main part, in a slot whose name may mean boilerplate (share, related, notice, ...): a block covered for the most part goes;
* elsewhere in a main part: a wholly covered block goes if its slot is wholly covered beside nearly all different articles of the
  host and has far fewer texts than there are articles; others (titles of copied articles, say) stay.

Menus, forms, adverts and the like that are unique to their page can't be seen by any array; element names and unmistakable
classes settle those.

A host's pages are dealt to shards of bounded size. Runs repeated inside a shard come from its suffix array; hosts with several
shards first exchange hashes of their token windows, and each shard is given those that another one has too.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

RUN = 8  # tokens that count as a long substring
SHARD_TOKENS = 600_000
#: Beside how many different articles a slot must be wholly covered, what share of those that have it, and how many texts of its
#: own for each of them it may have at most, to be boilerplate.
SLOT_FLOWS, SLOT_SHARE, SLOT_TEXTS = 5, 0.8, 0.5
MOSTLY = 0.8  # covered share at which a block in a doubtful slot goes
CHROME, OPEN, MAIN, DOUBTFUL = 0, 1, 2, 3

_RAW = frozenset(("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "select", "noframes"))
_CHROME = frozenset(("nav", "footer", "aside", "form", "button", "dialog", "menu", "header", "fieldset", "label", "input"))
_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = _BLOCK - frozenset(("body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary", "option", "optgroup"))
#: Elements that a start tag of the same group closes, and where the search stops.
_SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "option": ({"option"}, {"select"})}
#: Class and id names that mean boilerplate anywhere, and such that mean it outside a main part only.
_NAMES = re.compile(
    r"(?i)(?:^|[\s_-])(?:ads?|advert\w*|sponsor(?:ed|s)?|promo|sidebar|side-bar|navbar|navigation|breadcrumbs?|footer|masthead|site-header|page-header|topbar|cookies?|gdpr|popup|modal|newsletter|comments|comment-\w+|disqus|pagination|skip-link)(?:$|[\s_-])"
)
_MAYBE = re.compile(
    r"(?i)(?:^|[\s_-])(?:nav\w*|menu\w*|banner|consent|notice|notification|alert|overlay|subscri\w*|sign-?up|login|comment|reply|replies|share|sharing|social|related|recommend\w*|widget|pager|toolbar|promo\w*|sponsor\w*)(?:$|[\s_-])"
)
_ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "menu", "menubar", "toolbar"))
# A quote opens a value only right after an equals sign; anywhere else it is a character like any other.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[A-Za-z](?:[^>=]|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s\"'>][^\s>]*)?)*+(?:>|\Z)", re.S)
_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_PAGE_HEADER = re.compile(r"(?i)(?:^|[\s_-])header(?:$|[\s_-])")
_ATTR = re.compile(r"([^\s=>/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]*)))?")


def _attributes(tag: str) -> dict[str, str]:
    """The attributes that tell a block's region, lower-cased names; the first of a name counts."""
    out: dict[str, str] = {}
    for key, *values in _ATTR.findall(tag, _NAME.match(tag).end()):
        key = key.lower()
        if key in ("class", "id", "role", "hidden", "aria-hidden", "itemprop"):
            out.setdefault(key, "".join(values))
    return out


def _region(name: str, attributes: dict[str, str], now: int) -> int:
    """Region of an element's own blocks inside region ``now``. A header inside the article is its title."""
    if now == CHROME:
        return CHROME
    in_main = now != OPEN
    if name in _CHROME and not (name == "header" and in_main):
        return CHROME
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role", "").lower() in _ROLES:
        return CHROME
    main = name in ("article", "main") or attributes.get("role", "").lower() == "main" or "articlebody" in attributes.get("itemprop", "").lower()
    if name not in ("body", "html", "article", "main"):
        for value in (attributes.get("class", ""), attributes.get("id", "")):
            if not value:
                continue
            if _NAMES.search(value) or not in_main and not main and (_PAGE_HEADER.search(value) or _MAYBE.search(value)):
                return CHROME
            if in_main and _MAYBE.search(value):
                return DOUBTFUL
    return MAIN if main and now == OPEN else now


def blocks(page: str) -> list[tuple[int, str, str]]:
    """(region, slot, text) of each non-empty block in page order. The slot is the path of block elements with their classes.

    White space inside a block is one space, character references are decoded. Script, style, comments and other unseen
    content is no block at all. Unclosed and stray tags are taken as browsers mostly do; a cut-off page ends where it ends.
    """
    out: list[tuple[int, str, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, int, str]] = []  # name, region, slot
    region, slot = OPEN, ""

    def end() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((region, slot, text))
            parts.clear()

    def back_to(n: int) -> None:
        nonlocal region, slot
        if n < len(stack):
            del stack[n:]
            region, slot = stack[-1][1:] if stack else (OPEN, "")

    at = 0
    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            if at < len(page):
                parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
        at, tag = m.end(), m[0]
        if tag[1] in "!?":
            continue
        name = _NAME.match(tag)[1].lower()
        if tag[1] == "/":
            if name in _BLOCK:
                end()
            elif name == "br":
                parts.append(" ")
            for n in range(len(stack) - 1, -1, -1):
                if stack[n][0] == name:
                    end()
                    back_to(n)
                    break
            continue
        if name in _RAW and not tag.endswith("/>"):
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in _BLOCK:
            end()
            if name in _CLOSES_P and stack and stack[-1][0] == "p":
                back_to(len(stack) - 1)
            if name in _SIBLINGS:
                same, stops = _SIBLINGS[name]
                for n in range(len(stack) - 1, -1, -1):
                    if stack[n][0] in same:
                        back_to(n)
                        break
                    if stack[n][0] in stops:
                        break
        if name in _VOID or tag.endswith("/>") and name not in _BLOCK:
            continue
        attributes = _attributes(tag) if "=" in tag or " " in tag else {}
        own = _region(name, attributes, region)
        if name in _BLOCK or own != region:  # inline elements matter only if they change the region
            if name not in _BLOCK:
                end()
            slot = f"{slot}/{name}.{attributes['class']}" if attributes.get("class") else f"{slot}/{name}"
            stack.append((name, own, slot))
            region = own
    end()
    return out


def host_of(url: str | None) -> str:
    """Host of a URL, lower-cased, without user, port and a leading www; empty if there is none."""
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower().removeprefix("www.") if m else ""


def repeated_runs(tokens: np.ndarray, page: np.ndarray, run: int = RUN) -> np.ndarray:
    """Which positions lie in a run of ``run`` or more tokens that also occurs in another page.

    ``tokens``: numbers of the concatenated streams, ``page``: whose each is. The suffix array is built by doubling to
    depth ``run`` (pages end in ranks of their own, so no run crosses pages); equal neighbours of several pages are hits.
    """
    n = len(tokens)
    covered = np.zeros(n + 1, np.int64)
    if n < run:
        return covered[:n].astype(bool)
    last = np.zeros(n, np.int64)  # tokens left in the page, this one included
    ends = np.flatnonzero(np.append(page[1:] != page[:-1], True))
    last = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n) + 1
    rank, depth = np.unique(tokens, return_inverse=True)[1].astype(np.int64), 1
    while depth < run:
        step = min(depth, run - depth)
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        after[last <= step] = 0
        pair = rank * (n + 2) + after
        rank, depth = np.unique(pair, return_inverse=True)[1], depth + step
    suffixes = np.argsort(rank, kind="stable")
    suffixes = suffixes[last[suffixes] >= run]
    if not len(suffixes):
        return covered[:n].astype(bool)
    r, p = rank[suffixes], page[suffixes]
    starts = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
    several = np.minimum.reduceat(p, starts) != np.maximum.reduceat(p, starts)
    hit = suffixes[np.repeat(several, np.diff(np.append(starts, len(r))))]
    np.add.at(covered, hit, 1)
    np.add.at(covered, hit + run, -1) if len(hit) else None
    return np.cumsum(covered)[:n] > 0


def _window_hashes(h: np.ndarray, run: int) -> np.ndarray:
    n = len(h) - run + 1
    out = np.zeros(n, np.int64)
    for i in range(run):
        out = C.mixed(out ^ C.mixed(h[i : i + n] + i))
    return out


_PARSED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("regions", pa.list_(pa.int8())), ("slots", pa.list_(pa.int64())), ("texts", pa.list_(pa.string())), ("live", pa.list_(pa.int32())), ("flow", pa.int64()), ("tokens", pa.int64())])
_PARSED_KIND = "page_id long, url string, host string, regions array<byte>, slots array<long>, texts array<string>, live array<int>, flow long, tokens long"


def flow_slot(found: list[tuple[int, str, str]]) -> str | None:
    """The slot that holds most tokens of a page's main part, the earliest of equal ones; none without a main part."""
    sizes: dict[str, int] = {}
    for region, slot, text in found:
        if region == MAIN:
            sizes[slot] = sizes.get(slot, 0) + text.count(" ") + 1
    return max(sizes, key=sizes.get) if sizes else None


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def parsed(pages: DataFrame) -> DataFrame:
    """A row for each page: its visible blocks with their regions and (hashed) slots, which of them are in the host's stream
    (``live``), how many tokens those have, and a hash of the flow."""

    def of(batches):
        for b in batches:
            out = []
            for page_id, url, page in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), C.texts(b, "html"), strict=True):
                found = blocks(page)
                flow = flow_slot(found)
                live = [i for i, (r, slot, _) in enumerate(found) if r != MAIN or slot != flow]
                body = _hash("\n".join(t for r, slot, t in found if r == MAIN and slot == flow))
                out.append((page_id, url, host_of(url), [r for r, _, _ in found], [_hash(x) for _, x, _ in found], [t for _, _, t in found], live, body, sum(found[i][2].count(" ") + 1 for i in live)))
            yield C.rows_out(_PARSED, zip(*out, strict=True) if out else [[]] * 9)

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(of, _PARSED_KIND)


class _Shard:
    """The pages of one shard as one stream of numbered tokens."""

    def __init__(self, slices: list[pa.RecordBatch]):
        self.rows = np.concatenate([s.column("row").to_numpy() for s in slices])
        self.texts = [t for s in slices for t in s.column("texts").to_pylist()]
        self.number: dict[str, int] = {}
        number = self.number
        words = [x.split(" ") for texts in self.texts for x in texts]
        self.lengths = np.array([len(w) for w in words], np.int64)  # tokens of each block
        self.tokens = np.fromiter((number.setdefault(x, len(number)) for w in words for x in w), np.int64, int(self.lengths.sum()))
        n_blocks = np.array([len(t) for t in self.texts], np.int64)
        self.block_end = np.cumsum(n_blocks)
        self.block_page = np.repeat(np.arange(len(self.texts)), n_blocks)
        self.page = np.repeat(self.block_page, self.lengths)
        self.first = np.concatenate([[0], np.cumsum(self.lengths)])  # where each block begins in the stream

    def windows(self, run: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of ``run`` tokens that lie in one page, and where they begin."""
        n = len(self.tokens) - run + 1
        if n < 1:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = np.array([xxhash.xxh3_64_intdigest(x) for x in self.number], np.uint64).astype(np.int64)[self.tokens]
        at = np.flatnonzero(self.page[:n] == self.page[run - 1 :])
        return _window_hashes(h, run)[at], at


#: What a shard tells of a page: covered tokens of each live block and begin and end of each covered run, where that may change
#: its text, else null; and its live blocks in the main part, by number, slot, hash and whether they are wholly covered.
_COVERED = pa.schema([
    ("row", pa.int64()), ("host", pa.string()), ("flow", pa.int64()), ("counts", pa.list_(pa.int32())), ("spans", pa.list_(pa.int32())),
    ("blocks", pa.list_(pa.int32())), ("slots", pa.list_(pa.int64())), ("hashes", pa.list_(pa.int64())), ("whole", pa.list_(pa.bool_())),
])
_COVERED_KIND = "row long, host string, flow long, counts array<int>, spans array<int>, blocks array<int>, slots array<long>, hashes array<long>, whole array<boolean>"


def _covers(every: DataFrame, run: int, shard_tokens: int) -> DataFrame:
    """_COVERED for the pages that have anything of it to tell."""
    hosts = every.groupBy("host").agg(F.sum("tokens").alias("n")).select("host", F.ceil(F.col("n") / F.lit(shard_tokens)).cast("int").alias("shards")).where("shards > 1")
    split = C.saved(hosts)
    dealt = every.where("tokens > 0").join(C.sized(split), "host", "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
    of_live = lambda c: F.transform("live", lambda i: F.get(c, i)).alias(c)
    marked = F.exists("regions", lambda r: (r == MAIN) | (r == DOUBTFUL)).alias("marked")
    dealt = dealt.select("host", F.pmod(F.xxhash64("row"), F.col("shards")).cast("int").alias("shard"), "shards", "row", "flow", "live", marked, of_live("regions"), of_live("slots"), of_live("texts"))
    order = ["host", "shard"]
    key_schema = pa.schema([("host", pa.string()), ("shard", pa.int32()), ("key", pa.int64())])

    def keyed(batches):
        for (host, shard), slices in C.runs(batches, order):
            keys = np.unique(_Shard(slices).windows(run)[0])
            for a in range(0, len(keys), 100_000):
                part = keys[a : a + 100_000]
                yield C.rows_out(key_schema, [[host] * len(part), [shard] * len(part), part])

    several = dealt.where("shards > 1").select(*order, "row", "texts").repartition(*order).sortWithinPartitions(*order)
    keys = several.mapInArrow(keyed, "host string, shard int, key long")
    shared = keys.groupBy("host", "key").agg(F.collect_set("shard").alias("among")).where(F.size("among") > 1)  # at most a host's shards
    shared = shared.select("host", F.explode("among").alias("shard"), "key").withColumn("side", F.lit(0))
    both = dealt.drop("shards").withColumn("side", F.lit(1)).unionByName(shared, allowMissingColumns=True)

    def covered(batches):
        for (host, _), slices in C.runs(batches, order):
            keys = np.concatenate([s.column("key").filter(s.column("key").is_valid()).to_numpy() for s in slices])
            pages = [s for s in (s.filter(s.column("row").is_valid()) for s in slices) if s.num_rows]
            if not pages:
                continue
            x = _Shard(pages)
            hit = repeated_runs(x.tokens, x.page, run)
            if len(keys):
                hashes, at = x.windows(run)
                at = at[np.isin(hashes, keys)]
                more = np.zeros(len(hit) + 1, np.int64)
                np.add.at(more, at, 1)
                np.add.at(more, at + run, -1)
                hit |= np.cumsum(more)[:-1] > 0
            counts = np.diff(np.concatenate([[0], np.cumsum(hit)])[x.first])
            columns = [[v for s in pages for v in s.column(c).to_pylist()] for c in ("flow", "live", "marked", "regions", "slots")]
            out, b0 = [], 0
            for i, (flow, live, marked, regions, slots) in enumerate(zip(*columns, strict=True)):
                b1 = int(x.block_end[i])
                mine, sizes = counts[b0:b1], x.lengths[b0:b1]
                edit = any(n and (r == DOUBTFUL or r == OPEN and not marked) for n, r in zip(mine, regions, strict=True))
                main = [j for j, r in enumerate(regions) if r == MAIN]
                if edit:
                    step = np.diff(np.concatenate([[0], hit[x.first[b0] : x.first[b1]].astype(np.int8), [0]]))
                    spans = np.stack([np.flatnonzero(step == 1), np.flatnonzero(step == -1)], 1).ravel()
                if edit or main:
                    of_main = ([live[j] for j in main], [slots[j] for j in main], [_hash(x.texts[i][j]) for j in main], [bool(mine[j] == sizes[j]) for j in main])
                    out.append((x.rows[i], host, flow, mine.astype(np.int32) if edit else None, spans.astype(np.int32) if edit else None, *of_main))
                b0 = b1
            if out:
                yield C.rows_out(_COVERED, zip(*out, strict=True))

    return both.repartition(*order).sortWithinPartitions(*order, "side").mapInArrow(covered, _COVERED_KIND)


def _template_blocks(covers: DataFrame) -> DataFrame:
    """row, gone: the main blocks of each page (by number) that are wholly covered and stand in a slot that the host repeats."""
    x = covers.select("row", "host", "flow", F.explode(F.arrays_zip("blocks", "slots", "hashes", "whole")).alias("z")).select("row", "host", "flow", "z.*")
    by_flow = x.groupBy("host", "slots", "flow").agg(F.bool_and("whole").alias("whole"), F.min("hashes").alias("h"))
    slots = by_flow.groupBy("host", "slots").agg(F.count(F.when(F.col("whole"), 1)).alias("n"), F.count(F.lit(1)).alias("flows"), F.countDistinct("h").alias("texts"))
    slots = slots.where((F.col("n") >= SLOT_FLOWS) & (F.col("n") >= SLOT_SHARE * F.col("flows")) & (F.col("texts") <= SLOT_TEXTS * F.col("flows")))
    return x.where("whole").join(slots, ["host", "slots"], "left_semi").groupBy("row").agg(F.collect_set("blocks").alias("gone"))


def extract(pages: DataFrame, run: int = RUN, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """page_id, url, text, n_chars, n_boilerplate for every row of ``pages`` (page_id, url, html).

    Text: blocks of the main part in page order, one line each, without those that the host's suffix arrays show to be
    boilerplate (see above). Pages that mark no main part give their blocks outside menus and the like, without runs of ``run``
    or more tokens found in another page of the host; what unique tokens a block has left stay in its line. ``n_boilerplate``
    counts the tokens that the arrays took out so; what names and classes settle isn't counted. Null or empty html gives an
    empty text; pages without a host share one group. Pages of any length are read whole; one page is never split over shards.
    Repeated rows repeat (and so are boilerplate to each other where no main part is marked); rows that repeat a page_id are
    pages of their own. An empty table gives no rows; other columns are not looked at.

    Only pages whose text the arrays change are shuffled; a bitmap of fixed size passes all others straight through.
    """
    spark = pages.sparkSession
    path = f"{C.shared_dir(spark).rstrip('/')}/tables/pages-{C.uuid.uuid4().hex}"
    parsed(pages).withColumn("row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    every = spark.read.parquet(path)
    covers = C.saved(_covers(every, run, shard_tokens))
    edits = covers.where("counts is not null").select("row", "counts", "spans").join(_template_blocks(covers), "row", "full_outer")
    edits = C.saved(edits)
    touched = spark.sparkContext.broadcast(C.KeyFilter.of(edits.select(F.xxhash64("row").alias("h")), "h"))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_boilerplate", pa.int64())])
    kind = "page_id long, url string, text string, n_boilerplate long"

    def cleaned(edited: bool):
        def of(batches):
            for b in batches:
                if not edited:
                    b = b.filter(pa.array(~touched.value.has(b.column("h").to_numpy())))
                columns = [b.column(c).to_pylist() for c in ("regions", "texts", "live")]
                columns += [b.column(c).to_pylist() if edited else [None] * b.num_rows for c in ("counts", "spans", "gone")]
                got = [_cleaned(regions, texts, dict(zip(live, counts or (), strict=False)), set(live), spans or (), set(gone or ())) for regions, texts, live, counts, spans, gone in zip(*columns, strict=True)]
                yield C.rows_out(schema, [b.column("page_id"), b.column("url"), [t for t, _ in got], [n for _, n in got]])

        return of

    def maybe(batches):
        for b in batches:
            yield b.filter(pa.array(touched.value.has(b.column("h").to_numpy())))

    parts = every.select("page_id", "url", "regions", "texts", "live", "row", F.xxhash64("row").alias("h"))
    plain = parts.mapInArrow(cleaned(False), kind)
    some = parts.mapInArrow(maybe, parts.schema).join(edits, "row", "left")
    done = plain.unionByName(some.mapInArrow(cleaned(True), kind))
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_boilerplate")


def _cleaned(regions: list[int], texts: list[str], counts: dict[int, int], live: set[int], spans: list[int], gone: set[int]) -> tuple[str, int]:
    """(text, boilerplate tokens that the arrays found) of one page; ``counts`` by block number."""
    marked = any(r in (MAIN, DOUBTFUL) for r in regions)
    lines, n, first, at = [], 0, 0, 0  # first: the block's place in the stream
    for i, (region, text) in enumerate(zip(regions, texts, strict=True)):
        if i not in live:
            lines.append(text)
            continue
        size, count = text.count(" ") + 1, counts.get(i, 0)
        if region == CHROME or region == OPEN and marked:
            pass
        elif region == DOUBTFUL and count >= MOSTLY * size or i in gone:
            n += size
        elif region == OPEN and count:
            keep = np.ones(size, bool)
            while at < len(spans) and spans[at + 1] <= first:
                at += 2
            k = at
            while k < len(spans) and spans[k] < first + size:
                keep[max(0, spans[k] - first) : spans[k + 1] - first] = False
                k += 2
            words = text.split(" ")
            n += size - int(keep.sum())
            left = [w for w, ok in zip(words, keep, strict=True) if ok]
            if left:
                lines.append(" ".join(left))
        else:
            lines.append(text)
        first += size
    return "\n".join(lines), n
