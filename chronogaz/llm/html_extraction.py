"""Main text of web pages by host suffix arrays, with the page's structure as a hint.

A page is read as a stream of blocks, each in a zone. Elements, roles and whole class or id names that name menus,
headers, footers, notices, adverts, forms, comments and the like make boilerplate (zone 0); `article` and `main` make
article text (2); a class or id that has such a name as a part only (`share-price`) makes a suspect, in (3) or outside
(4) the article; the rest lies outside (1).

The token streams of a host's pages, article text left out, are concatenated with a break after each block, and a
suffix array over the tokens finds every substring of `least` tokens, and every whole shorter block, that stands on two
or more distinct pages. They decide:

- Article blocks stay, however many pages carry them: stories are mirrored and quoted.
- A suspect loses the tokens covered by any repeated substring.
- On a page that names no article, text outside loses the tokens covered by substrings that stand on `share` of the
  host's pages (shorter whole blocks: on three pages and half of the host's). If that takes all of a page's text, the
  page is a mirror of others, and its blocks that stand on the fewest pages stay.

A hot host is no single task: each task sorts the suffixes of its own pages and gives each distinct substring once with
its number of pages, and only these are joined across tasks.

Null or empty html gives an empty text. Damaged markup is read as far as it goes: unclosed elements end with their
parents, a cut-off tag ends the page, a quote without its fellow ends with its tag, a head need not be closed. Rows repeat as they do in the input; rows with one page_id are not two pages, but
a page_id that stands in several tasks counts in each; rows without one are pages of their own. Very long pages are one row of a batch of bounded bytes. Columns
besides page_id, url and html are not read, whatever their names.
"""

from __future__ import annotations

import functools
import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronogaz.llm.common import batches, cut, give_back, suffix_array

LEAST, SHARE = 12, 0.3

# What HTML elements are.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe".split())
HELD = set("svg math object select option optgroup button canvas audio video datalist".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSED_BY_BLOCK = {"p"}
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

# Our own choice: elements and names that tell boilerplate, and words that name nothing beside them.
NOT_TEXT = set("nav header footer aside form menu dialog".split()) | HELD
NAMES = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs footer header masthead sidebar cookie cookies consent "
    "notice notices popup modal newsletter subscribe subscription signup login search share sharing social related comment comments commentlist respond disqus widget widgets copyright toolbar pagination pager skip teaser teasers".split()
)
PLAIN = set("site main page top bottom left right list area box container wrapper wrap section block slot bar item items primary secondary global inner outer module panel row col link links buttons button icons icon group unit the".split())

_OPENS = re.compile(r"<(?=[!?]|/?[a-zA-Z])")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_QUOTE = re.compile(r"=\s*([\"'])|>")
_ATTR = re.compile(r"([^\s=/>\"'][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"\s+")
_PARTS = re.compile(r"[-_:]+|(?<=[a-z])(?=[A-Z])")

BOILERPLATE, OUTSIDE, ARTICLE, SUSPECT, SUSPECT_OUTSIDE = range(5)


def _named(value: str) -> int:
    """2: a class or id names boilerplate, 1: one has such a name as a part, 0: none."""
    out = 0
    for name in value.split():
        parts = [p.lower() for p in _PARTS.split(name) if p and not p.isdigit()]
        if any(p in NAMES for p in parts) or name.lower() in NAMES:
            out = max(out, 2 if all(p in NAMES or p in PLAIN for p in parts) else 1)
    return out


def _zone(tag: str, attrs: str, zone: int) -> int:
    """The zone inside an element that opens in a zone."""
    if zone == BOILERPLATE or tag in NOT_TEXT and not (tag == "header" and zone == ARTICLE):
        return BOILERPLATE
    named, role = 0, ""
    for m in _ATTR.finditer(attrs) if attrs and tag not in ("html", "body") else ():
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name not in ("class", "id", "role", "hidden", "aria-hidden"):
            continue
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value.lower() in ROLES:
            return BOILERPLATE
        if name in ("class", "id"):
            named = max(named, _named(value))
        elif name == "role":
            role = value.lower()
    if named == 2:
        return BOILERPLATE
    if zone == OUTSIDE and (tag in ("article", "main") or role in ("main", "article")):
        return ARTICLE
    return {OUTSIDE: SUSPECT_OUTSIDE, ARTICLE: SUSPECT}.get(zone, zone) if named and tag not in ("article", "main") else zone


def _tag(page: str, at: int) -> tuple[str, str, bool, int]:
    """(name, attributes, whether it closes, end) of the markup that opens at `at`; no name for comments and the like.

    A quote after an equals sign holds until its fellow, if white space, a slash or the tag's end follows that; else it
    stands alone, and the tag ends at the next >."""
    if page.startswith("<!--", at):
        end = page.find("-->", at + 4)
        return "", "", False, len(page) if end < 0 else end + 3
    if page.startswith("<![CDATA[", at):
        end = page.find("]]>", at)
        return "", "", False, len(page) if end < 0 else end + 3
    m = _NAME.match(page, at)
    if m is None:
        end = page.find(">", at)
        return "", "", False, len(page) if end < 0 else end + 1
    pos = m.end()
    while True:
        q = _QUOTE.search(page, pos)
        if q is None:
            return m[1].lower(), page[m.end() :], page[at + 1] == "/", len(page)
        if q[1] is None:
            return m[1].lower(), page[m.end() : q.start()], page[at + 1] == "/", q.end()
        close = page.find(q[1], q.end())
        if close >= 0 and (close + 1 == len(page) or page[close + 1] in " \t\r\n\f/>"):
            pos = close + 1
        else:
            pos = q.end()


def blocks(page: str) -> list[tuple[str, int]]:
    """(text, zone) of each block in page order."""
    out, text = [], []
    stack: list[tuple[str, int]] = []  # open elements and the zone inside them
    count: dict[str, int] = {}  # open elements of each name
    unclosed: set[str] = set()
    zone, at, end = OUTSIDE, 0, len(page)

    def flush():
        got = _SPACE.sub(" ", html.unescape("".join(text))).strip()
        text.clear()
        if got:
            out.append((got, zone))

    def pop() -> str:
        tag, _ = stack.pop()
        count[tag] -= 1
        return tag

    while at < end:
        m = _OPENS.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        text.append(page[at : m.start()])
        tag, attrs, closes, at = _tag(page, m.start())
        if not tag:
            continue
        if closes:
            if count.get(tag):
                flush() if tag in BLOCK or tag in NOT_TEXT else None
                while pop() != tag:
                    pass
                new = stack[-1][1] if stack else OUTSIDE
                if new != zone:
                    flush()
                    zone = new
            elif tag in BLOCK:
                flush()
            continue
        if tag in RAW:
            if not attrs.rstrip().endswith("/"):
                close = None if tag in unclosed else _closing(tag).search(page, at)
                if close:
                    at = close.end()
                else:  # a title ends with the next tag, what else is unclosed with the page
                    unclosed.add(tag)
                    at = page.find("<", at) if tag == "title" else end
                    at = end if at < 0 else at
            continue
        if tag in HELD and tag not in unclosed:  # left out whole if the next tag of its name closes it, else as it stands
            same = _same(tag).search(page, at)
            if same is None:
                unclosed.add(tag)
            elif same[1]:
                at = same.end()
                continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in BLOCK:
            flush()
            while stack and stack[-1][0] not in BLOCK:  # inline elements do not reach over blocks
                pop()
            if stack and stack[-1][0] in CLOSED_BY_BLOCK:
                pop()
            zone = stack[-1][1] if stack else OUTSIDE
        if tag in VOID or attrs.rstrip().endswith("/"):
            continue
        inside = _zone(tag, attrs, zone)
        if inside != zone and tag not in BLOCK:
            flush()
        stack.append((tag, inside))
        count[tag] = count.get(tag, 0) + 1
        zone = inside
    flush()
    return out


@functools.cache
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\s*>", re.I)


@functools.cache
def _same(tag: str) -> re.Pattern:
    return re.compile(rf"<(/?){re.escape(tag)}(?:\s[^>]*)?>", re.I)


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1)), F.lit(""))


PARTS = "array<struct<zone:int,text:string>>"


def parse(pages: DataFrame) -> DataFrame:
    """Per page: row, page_id, url, host; text where structure settles it, else null; parts: all blocks where it does
    not, else those outside the article."""

    def run(it):
        for b in (s for x in it for s in batches([x], column="html")):
            texts, parts = [], []
            for page in b.column(4).to_pylist():
                got = blocks(page or "")
                zones = {z for _, z in got}
                settled = SUSPECT not in zones if ARTICLE in zones else not zones & {OUTSIDE, SUSPECT, SUSPECT_OUTSIDE}
                texts.append("\n".join(t for t, z in got if z == ARTICLE) if settled else None)
                parts.append([(z, t) for t, z in got if not settled or z != ARTICLE])
            ends = np.append(0, np.cumsum(list(map(len, parts)))).astype(np.int32)
            values = pa.StructArray.from_arrays([pa.array([z for p in parts for z, _ in p], pa.int32()), pa.array([t for p in parts for _, t in p], pa.string())], ["zone", "text"])
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(texts, pa.string()), pa.ListArray.from_arrays(pa.array(ends), values)], ["row", "page_id", "url", "host", "text", "parts"])
        give_back()

    url = F.col("url").cast("string")
    given = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), url.alias("url"), host_of(url).alias("host"), F.col("html").cast("string").alias("html"))
    return given.mapInArrow(run, f"row long, page_id long, url string, host string, text string, parts {PARTS}")


def windows(texts: list[list[str]], least: int) -> list[tuple[int, int, int, int, int]]:
    """(page, block, first token, tokens, hash) of each substring of `least` tokens of a block and each shorter block.

    They come in suffix order, so equal ones stand together and are hashed once."""
    import xxhash

    tokens = [t.split(" ") for page in texts for t in page]
    page = [p for p, page in enumerate(texts) for _ in page]
    number = [k for page in texts for k in range(len(page))]
    vocabulary: dict[str, int] = {}
    codes = np.array([vocabulary.setdefault(t, len(vocabulary) + 1) for ts in tokens for t in [*ts, ""]], np.int64)
    size = np.array([len(ts) for ts in tokens], np.int64)
    block = np.repeat(np.arange(len(tokens)), size + 1)
    at = np.arange(len(codes)) - np.repeat(np.cumsum(size + 1) - size - 1, size + 1)
    left = size[block] - at
    order = suffix_array(codes, least + 1)  # with the break, so that a whole block stands apart from longer ones
    order = order[(left[order] >= least) | (at[order] == 0) & (left[order] > 0)]
    out, last, h = [], None, 0
    for i in order.tolist():
        b, o = int(block[i]), int(at[i])
        w = tokens[b][o : o + least]
        if w != last:
            last, h = w, xxhash.xxh3_64_intdigest(" ".join(w).encode(), len(w)) - (1 << 63)
        out.append((page[b], number[b], o, len(w), h))
    return out


def repeated(parsed: DataFrame, least: int = LEAST) -> DataFrame:
    """(host, w, pages, of_host): substrings on two or more distinct pages of a host, outside articles."""

    def run(it):
        for b in it:
            by_host: dict[str, list[int]] = {}
            for i, h in enumerate(b.column(1).to_pylist()):
                by_host.setdefault(h, []).append(i)
            ids, parts, out = [-2 - r if p is None else p for p, r in zip(b.column(0).to_pylist(), b.column(3).to_pylist())], b.column(2).to_pylist(), []
            for h, rows in by_host.items():
                found: dict[int, set[int]] = {}
                for p, _, _, _, w in windows([[x["text"] for x in parts[i] if x["zone"] != ARTICLE] for i in rows], least):
                    found.setdefault(w, set()).add(ids[rows[p]])
                out += [(h, w, min(ps), max(ps), len(ps)) for w, ps in found.items()]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64() if k else pa.string()) for k in range(5)], ["host", "w", "lo", "hi", "n"])
        give_back()

    got = parsed.select("page_id", "host", "parts", "row").mapInArrow(run, "host string, w long, lo long, hi long, n long")
    shared = got.groupBy("host", "w").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("pages")).where("lo < hi")
    hosts = parsed.groupBy("host").agg(F.count("*").alias("of_host"))
    return shared.join(hosts, "host").select("host", "w", "pages", "of_host")


def kept_text(parts: list[tuple[int, str]], found: list[tuple[int, int, int, int, int]], share: float = SHARE) -> str:
    """The text of a page that structure does not settle; found: (block, token, tokens, pages, pages of the host) of its
    repeated substrings."""
    named = any(z in (ARTICLE, SUSPECT) for z, _ in parts)
    own = (ARTICLE, SUSPECT) if named else (OUTSIDE, SUSPECT, SUSPECT_OUTSIDE)
    tokens = {k: t.split(" ") for k, (z, t) in enumerate(parts) if z in own}
    hide, most = {k: np.zeros(len(ts), bool) for k, ts in tokens.items()}, dict.fromkeys(tokens, 1)
    for k, at, n, pages, of_host in found:
        if k in tokens and parts[k][0] != ARTICLE:
            most[k] = max(most[k], pages)
            whole = n == len(tokens[k])
            enough = 2 if parts[k][0] != OUTSIDE else max(3, of_host / 2) if whole and n < LEAST else max(2, share * of_host)
            if pages >= enough:
                hide[k][at : at + n] = True
    out = [" ".join(w for w, h in zip(ts, hide[k]) if not h) for k, ts in tokens.items()]
    if not any(out) and not named:
        out = [parts[k][1] for k in tokens if most[k] == min(most.values())]
    return "\n".join(x for x in out if x)


def unsettled_text(parsed: DataFrame, shared: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """(page_id, url, text) of the pages whose text structure does not settle."""
    rest = parsed.where("text is null").select("row", "page_id", "url", "host", "parts")

    def places(it):
        for b in it:
            rows, hosts, out = b.column(0).to_pylist(), b.column(1).to_pylist(), []
            for row, host, parts in zip(rows, hosts, b.column(2).to_pylist()):
                number = [k for k, x in enumerate(parts) if x["zone"] != ARTICLE]
                out += [(host, row, number[k], at, n, w) for _, k, at, n, w in windows([[parts[k]["text"] for k in number]], least)]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64() if k else pa.string()) for k in range(6)], ["host", "row", "block", "at", "n", "w"])

    def decide(it):
        for b in it:
            texts = []
            for parts, found in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                texts.append(kept_text([(x["zone"], x["text"]) for x in parts], [tuple(f.values()) for f in found or []], share))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    seen = rest.select("row", "host", "parts").mapInArrow(places, "host string, row long, block long, at long, n long, w long")
    found = seen.join(shared, ["host", "w"]).groupBy("row").agg(F.collect_list(F.struct("block", "at", "n", "pages", "of_host")).alias("found"))  # of one page
    return rest.join(found, "row", "left").select("page_id", "url", "parts", "found").mapInArrow(decide, "page_id long, url string, text string")


def extract(pages: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """Per page: page_id, url, text, n_chars. Pages are parsed once, into a table."""
    parsed = cut(parse(pages))
    shared = cut(repeated(parsed, least))
    settled = parsed.where("text is not null").select("page_id", "url", "text")
    out = settled.unionByName(unsettled_text(parsed, shared, least, share))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
