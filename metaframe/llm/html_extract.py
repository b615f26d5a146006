"""Main text of web pages: marked structure, and runs that repeat in a suffix array of each host's token streams.

A page becomes blocks of text, each in a zone: chrome (menus, headers, footers, sidebars, notices, adverts,
forms, comments), the article where the page marks one, or neutral text. An article that is smaller than the neutral
text around it is one part of the page's main text; one that is not leaves the text around it out. The token streams of a host's pages are
concatenated and sorted as a suffix array; neighbours with a longest common prefix of RUN tokens or more are one
repeated run, and its distinct pages are counted (pages of one text count once). Boilerplate is

- in neutral text: what runs on PAGES distinct pages cover, wherever those pages have them;
- in a marked article: what runs cover that are in the articles of a share of SHARE of the host's distinct pages, of
  which there are LEAST or more. Less than that stays: pages often print one article, or a line of it as an advert
  elsewhere, and a run that repeats for such a reason is the article's own.

Covered tokens go and unique runs stay. Chrome is left out in any case.

A large host is dealt to shards of about SHARD tokens, each with a suffix array of its own, and the runs' counts are
added up over the shards by the hash of a run's first RUN tokens: a token is covered by a run that is long enough
just if it is covered by such a window. Hosts with neutral text give the counts of all windows, so these are exact.
Others give those that half of SHARE of a shard's pages have; leaving out the rest can only make a count smaller.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaframe.functions.markup import Scanner
from metaframe.llm.kernels import U64, Texts, batches, distinct, list_array, mix, trim
from metaframe.llm.shared import small, written

RUN, PAGES = 8, 4
#: Share of a host's pages, and fewest pages, of what is boilerplate even in a marked article.
SHARE, LEAST = 0.9, 20
#: Tokens of a host that are sorted together; a longer page is by itself.
SHARD = 250_000
CHROME, ARTICLE, NEUTRAL = range(3)

# What elements, roles and class names mean.
RAW = frozenset("script style noscript template svg iframe textarea math object canvas video audio".split())
CHROME_TAGS = frozenset("nav footer aside form button select option dialog label fieldset menu head title".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice newsletter subscribe popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments reply replies disqus related recommended share sharing social widget login signup pagination pager".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
PAGE_TAGS = frozenset(("html", "body"))
SCOPES = frozenset("article section div td th body html main aside nav li blockquote table".split())

_SPACE = re.compile(r"[ \t\n\r\f\v]+")


def _zone_of(tag: str, found: dict[str, str], within: bool) -> int | None:
    """CHROME or ARTICLE if the element says so; within: it lies in an article."""
    if tag in CHROME_TAGS or tag == "header" and not within:
        return CHROME
    if found and tag not in PAGE_TAGS:  # the page's own class ("has-sidebar") tells of parts of it
        words = set() if tag == "main" else set(re.split(r"[^a-z0-9]+", f"{found.get('class', '')} {found.get('id', '')}".lower()))
        if words & CHROME_WORDS or found.get("role", "").lower() in CHROME_ROLES or "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
            return CHROME
        if found.get("role") == "main" or found.get("itemprop") == "articleBody":
            return ARTICLE
    return ARTICLE if tag in ("article", "main") else None


class _Open:
    """The open elements and their zones, with a count of each name, so that a name that is not open costs no search."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int]] = []
        self.count: Counter[str] = Counter()

    def push(self, tag: str, zone: int) -> None:
        self.stack.append((tag, zone))
        self.count[tag] += 1

    def close(self, tag: str, scopes: frozenset[str] = frozenset()) -> bool:
        """Closes the innermost element of the name and all in it, if it is open and no scope is between."""
        if not self.count[tag]:
            return False
        k = len(self.stack) - 1
        while self.stack[k][0] != tag:
            if self.stack[k][0] in scopes:
                return False
            k -= 1
        for name, _ in self.stack[k:]:
            self.count[name] -= 1
        del self.stack[k:]
        return True

    def within(self, tag: str) -> bool:
        """The innermost open element has this name."""
        return bool(self.stack) and self.stack[-1][0] == tag

    @property
    def zone(self) -> int:
        return self.stack[-1][1] if self.stack else NEUTRAL


def blocks(page: str) -> list[tuple[str, int]]:
    """The page's blocks of text and their zones, in page order. Character references are decoded, white space is one space."""
    out: list[tuple[str, int]] = []
    text: list[str] = []
    opened, scan = _Open(), Scanner(page)
    at, block_zone = 0, NEUTRAL

    def close() -> None:
        if text:
            block = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            if block:
                out.append((block, block_zone))
            text.clear()

    while at < len(page):
        found = None
        if page[at] == "<":
            if page[at + 1 : at + 2] in ("!", "?"):
                at = scan.declaration(at)
                continue
            found = scan.tag(at)
        if found is None:
            end = page.find("<", at + 1)
            end = end if end > 0 else len(page)
            if opened.within("head") and page[at:end].strip():
                close()
                opened.close("head")
            if opened.zone != block_zone and text:
                close()
            block_zone = opened.zone
            text.append(page[at:end])
            at = end
            continue
        tag, attributes, slash, at = found
        if tag.lstrip("/") == "br":
            text.append(" ")
        elif tag[0] == "/":
            if tag[1:] not in INLINE and opened.count[tag[1:]]:
                close()
            opened.close(tag[1:])
        else:
            if tag not in INLINE:
                close()
            if tag not in IN_HEAD and opened.within("head"):  # its end tag may be left out
                close()
                opened.close("head")
            if tag in RAW:
                at = scan.skip_raw(tag, at)
                continue
            if tag in CLOSES_P:
                opened.close("p", SCOPES)
            if tag in VOID or slash and tag not in CLOSES_P:
                continue
            zone = opened.zone
            own = _zone_of(tag, attributes, bool(opened.count["article"] or opened.count["main"]) or zone == ARTICLE)
            opened.push(tag, own if zone != CHROME and own is not None else zone)
    close()
    size = Counter[int]()
    for block, zone in out:
        size[zone] += len(block)
    if size[ARTICLE] >= size[NEUTRAL]:  # what a marked article leaves out is not of the article
        return [(b, CHROME if z == NEUTRAL else z) for b, z in out]
    return out  # marks of a smaller part are of teasers or cards; what repeats is found by its runs


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order, and the longest common prefix of each with the one before, by prefix doubling.

    The ranks by the first 1, 2, 4, ... tokens are made until all differ; descending through them gives the prefixes.
    """
    n = len(tokens)
    levels = [np.unique(tokens, return_inverse=True)[1].astype(np.int64)]
    while n and levels[-1].max() + 1 < n:
        rank, step = levels[-1], 1 << (len(levels) - 1)
        after = np.concatenate([rank[step:], np.full(min(step, n), -1)])[:n] + 1
        levels.append(np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64))
    order = np.argsort(levels[-1], kind="stable")
    common = np.zeros(n, dtype=np.int64)
    left, right = order[:-1], order[1:]
    for k in range(len(levels) - 1, -1, -1):
        a, b = left + common[1:], right + common[1:]
        inside = np.maximum(a, b) + (1 << k) <= n
        same = levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)]
        common[1:] += np.where(inside & same, 1 << k, 0)
    return order, common


def repeated_runs(tokens: np.ndarray, first: np.ndarray, main: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pages with bounds `first`, each run of RUN tokens: where it first begins, its distinct pages, and those that have it in main text."""
    n, pages = len(tokens), len(first) - 1
    page = np.repeat(np.arange(pages), np.diff(first))
    place = np.arange(n) + page
    stream = np.empty(n + pages, dtype=np.int64)
    stream[place] = np.unique(tokens, return_inverse=True)[1] + pages
    stream[np.asarray(first[1:]) + np.arange(pages)] = np.arange(pages)  # a mark of its own ends each page, so that no run goes on into the next
    back = np.full(n + pages, -1)
    back[place] = np.arange(n)
    order, common = suffix_array(stream)
    group = np.cumsum(common < RUN)
    token = back[order]
    fits = token >= 0
    fits[fits] = token[fits] + RUN <= first[page[token[fits]] + 1]
    group, token = group[fits], token[fits]
    heads = np.flatnonzero(np.diff(group, prepend=-1))
    which = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(group))))
    begin = np.minimum.reduceat(token, heads) if len(heads) else token
    pages_with = lambda at: np.bincount(distinct(which[at] * pages + page[token[at]]) // pages, minlength=len(heads))
    within = main[token] & main[np.minimum(token + RUN - 1, n - 1)] if n else fits
    return begin, pages_with(slice(None)), pages_with(within)


def windows(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each run of RUN tokens within a page, and the token at which it begins."""
    rolled = np.zeros(max(0, len(hashes) - RUN + 1), dtype=U64)
    for j in range(RUN):
        rolled = rolled * U64(0x5851F42D4C957F2D) + hashes[j : j + len(rolled)]
    left = np.repeat(first[1:], np.diff(first)) - np.arange(len(hashes))
    at = np.flatnonzero(left >= RUN)
    return mix(rolled[at]), at


def _tokens(page: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a page's tokens, and whether each is in main text."""
    words = Texts(pa.array([b for b, _ in page], pa.string())).words(lower=False)
    return words.hashes(), np.repeat([z != CHROME for _, z in page], np.diff(words.first)) if page else np.zeros(0, bool)


def main_text_of(page: list[tuple[str, int]], everywhere: np.ndarray, templates: np.ndarray) -> str:
    """The main text of a page. everywhere: hashes of the runs that count in neutral text; templates: those that count in articles."""
    words = Texts(pa.array([b for b, _ in page], pa.string())).words(lower=False)
    n = len(words.starts)

    def cover(runs: np.ndarray) -> np.ndarray:
        if not len(runs):
            return np.zeros(n, bool)
        run, at = windows(words.hashes(), np.array([0, n]))
        begin = at[np.isin(run, runs)]
        edge = np.zeros(n + 1, dtype=np.int64)
        np.add.at(edge, begin, 1)
        np.add.at(edge, begin + RUN, -1)
        return np.cumsum(edge[:-1]) > 0

    gone = {NEUTRAL: cover(everywhere), ARTICLE: cover(templates)}
    out = []
    for i, (block, zone) in enumerate(page):
        if zone == CHROME:
            continue
        a, b = words.first[i], words.first[i + 1]
        if gone[zone][a:b].any():
            block = " ".join(words.data[words.starts[j] : words.ends[j]].tobytes().decode() for j in range(a, b) if not gone[zone][j])
        if block:
            out.append(block)
    return " ".join(out)


def _packed(page: list[tuple[str, int]], pack: zstandard.ZstdCompressor) -> bytes:
    return pack.compress("\n".join(f"{z}{b}" for b, z in page).encode())


def _unpacked(raw: bytes, unpack: zstandard.ZstdDecompressor) -> list[tuple[str, int]]:
    text = unpack.decompress(raw).decode()
    return [(x[1:], int(x[0])) for x in text.split("\n")] if text else []


def _parsed(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's blocks, packed; fresh: the first of its host with this content in the task (or among its last many)."""
    row, seen, pack = TaskContext.get().partitionId() << 40, set(), zstandard.ZstdCompressor(level=9)
    for batch in batches(stream, 2 << 20):
        found = [blocks(x) if x else [] for x in batch.column(3).to_pylist()]
        raw = [_packed(f, pack) for f in found]
        content = [xxhash.xxh3_64_intdigest(x) for x in raw]
        fresh = []
        for key in zip(batch.column(2).to_pylist(), content, strict=True):
            fresh.append(key not in seen)
            seen.add(key)
        if len(seen) > 200_000:
            seen.clear()
        yield pa.record_batch(
            [pa.array(row + np.arange(len(found))), *batch.columns[:3], pa.array(np.array(content, dtype=U64).view(np.int64)), pa.array(fresh), pa.array([any(z == NEUTRAL for _, z in f) for f in found]), pa.array([sum(len(b) for b, _ in f) // 6 + 1 for f in found], pa.int64()), pa.array(raw, pa.binary())],
            names=["row", "page_id", "url", "host", "content", "fresh", "neutral", "size", "packed"],
        )
        row += len(found)


def _run_counts(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by host and shard: the pages of each shard's runs. A row without a window counts the shard's distinct pages."""
    unpack = zstandard.ZstdDecompressor()

    def of(host: str, every: bool, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        tokens, first = np.concatenate([h for h, _ in held]), np.concatenate(([0], np.cumsum([len(h) for h, _ in held])))
        if len(held) == 1:  # nothing to sort for: each run is on this page
            run, at = windows(tokens, first)
            run, place = np.unique(run, return_index=True)
            begin, main = at[place], held[0][1]
            n, m = np.ones(len(run), np.int64), (main[begin] & main[begin + RUN - 1]).astype(np.int64)
        else:
            begin, n, m = repeated_runs(tokens, first, np.concatenate([x for _, x in held]))
            run = windows(tokens, first)[0]
            at = np.cumsum(np.repeat(first[1:], np.diff(first)) - np.arange(len(tokens)) >= RUN) - 1
            run = run[at[begin]]
        usual = len(held) > 1 and m >= max(2, SHARE / 2 * len(held))
        keep = np.flatnonzero(np.full(len(n), every) | usual)
        size = len(keep) + 1
        return pa.record_batch(
            [pa.array([host], pa.string()).take(pa.array(np.zeros(size, np.int32))), pa.array(np.append(run[keep].view(np.int64), 0), mask=np.arange(size) == size - 1), pa.array(np.append(n[keep], len(held))), pa.array(np.append(m[keep], 0))],
            names=["host", "window", "n", "m"],
        )

    now, every, held, seen, size = None, False, [], set(), 0
    for batch in stream:
        for host, shard, content, neutral, raw in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if held and ((host, shard) != now or size > SHARD):
                yield of(now[0], every, held)
                held, size = [], 0
            if (host, shard) != now:
                now, seen = (host, shard), set()
            if content not in seen:
                seen.add(content)
                held.append(_tokens(_unpacked(raw, unpack)))
                every, size = neutral, size + len(held[-1][0])
    if held:
        yield of(now[0], every, held)
    trim()


def _page_runs(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct windows of each page."""
    unpack = zstandard.ZstdDecompressor()
    for batch in stream:
        found = [distinct(windows(h, np.array([0, len(h)]))[0]) for h, _ in (_tokens(_unpacked(x, unpack)) for x in batch.column(2).to_pylist())]
        yield pa.record_batch([batch.column(0), batch.column(1), list_array(np.concatenate([*found, np.zeros(0, U64)]), np.concatenate(([0], np.cumsum([len(x) for x in found], dtype=np.int64))))], names=["row", "host", "windows"])


def _finished(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    runs = lambda x: np.array(x or [], dtype=np.int64).view(U64)
    for batch in batches(stream, 1 << 20, "packed"):
        texts = [main_text_of(_unpacked(raw, unpack), runs(own), runs(of_host)) for raw, own, of_host in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row. Null and empty pages have the empty text; pages without a url are one host.

    Rows that repeat a page get a row each, and their text counts as one page where runs are counted. Tags that
    never end are text. Time is linear in a page's length. Other columns are not looked at.
    """
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), "^[a-zA-Z]+://([^/?#]*)", 1)).alias("host"), F.col(html_col).alias("text"))
    kind = pages.schema["page_id"].dataType.simpleString()
    parsed = written(pages.mapInArrow(_parsed, f"row long, page_id {kind}, url string, host string, content long, fresh boolean, neutral boolean, size long, packed binary"), "parsed")
    hosts = small(written(parsed.groupBy("host").agg(F.ceil(F.sum(F.when(F.col("fresh"), F.col("size"))) / SHARD).cast("int").alias("shards"), F.max("neutral").alias("every")), "hosts"))
    dealt = parsed.where("fresh").join(hosts, "host").select("host", F.pmod("content", "shards").alias("shard"), "content", "every", "packed")
    counts = dealt.repartition("host", "shard").sortWithinPartitions("host", "shard", "content").mapInArrow(_run_counts, "host string, window long, n long, m long")
    counts = written(counts.groupBy("host", "window").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "runs")
    sizes = counts.where("window is null").select("host", F.col("n").alias("pages"))
    usual = counts.where(F.col("window").isNotNull() & (F.col("m") >= SHARE * LEAST)).join(sizes, "host").where((F.col("pages") >= LEAST) & (F.col("m") >= SHARE * F.col("pages")))
    templates = written(usual.groupBy("host").agg(F.collect_list("window").alias("of_host")), "templates")  # by host no more than its average page has
    own = written(parsed.where("neutral").select("row", "host", "packed").mapInArrow(_page_runs, "row long, host string, windows array<long>").select("row", "host", F.explode("windows").alias("window")).join(counts.where(F.col("n") >= PAGES), ["host", "window"]).groupBy("row").agg(F.collect_list("window").alias("own")), "own")
    ready = parsed.join(small(own), "row", "left").join(small(templates), "host", "left")
    return ready.select("page_id", "url", "packed", "own", "of_host").mapInArrow(_finished, f"page_id {kind}, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
