"""Main text of web pages by nearest-URL page differencing.

Within a host, pages are ordered by URL path and each meets its nearest
neighbour in that order. The text lines of both are aligned by their longest
common subsequence: lines that the two share in the same order are the site's,
not the page's, and are deleted.

A check on the markup follows. A page says itself what part of it is the
article (article, main, or an element so named). Shared lines of that part are
put back: two articles may quote one passage, and an advert beside one may be a
sentence of the other. What the markup calls menu, header, footer, sidebar,
notice, advert, form or comments goes, shared or not. A page without a named
part, which is most of the open web, is left to differencing; one with a named
part and no neighbour keeps that part only.

Lines are blocks: the text between block-level tags, character references
decoded, white space turned to single blanks.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, partitions, small_batches

#: A tag, comment or declaration; quoted attribute values may hold ">". No part of it backtracks.
_TAG = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>|<[!?][^>]*+>", re.S)
_OPENS = re.compile(r"<(?=[a-zA-Z/!?])")
#: An attribute with its value, read in order, so that no name is found inside a value or a longer name.
_ATTR = re.compile(r"([^\s=\"'/>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
#: HTML elements that start a new block.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Their content is no text.
RAW = ("script", "style", "textarea", "template", "noscript", "iframe", "noembed", "noframes", "svg")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never the article's text.
BOILER = frozenset("nav footer aside form head title label button select dialog menu".split())
_BOILER_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?|banner|sidebar|side-bar|aside|menu|nav|navbar|navigation|breadcrumbs?|header|masthead|footer|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|comments?|commentlist|disqus|replies|respond|widget|toolbar|pagination|pager|search|copyright|disclaimer|skip)(?:$|[\s_-])",
    re.I,
)
_BOILER_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_MAIN_NAME = re.compile(r"(?:^|\s)(?:article|article-?body|post-?body|post-?content|entry-?content|main-?content|content-?main|story-?body)(?:$|\s)", re.I)
_CLOSES_P = BLOCKS - {"p", "option", "optgroup", "legend", "title", "head", "html", "body"}


_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_IN_ARTICLE = re.compile(r"(?:^|[\s_-])(?:header|masthead)(?:$|[\s_-])", re.I)


def _boiler_name(tag: str, value: str, in_article: bool) -> bool:
    """Whether a class or id calls an element boilerplate. In an article its headings are text, and its header, as the element of that name, is."""
    if in_article and tag in _HEADINGS:
        return False
    return bool(_BOILER_NAME.search(_IN_ARTICLE.sub(" ", value) if in_article else value))


def _role(tag: str, attrs: str, in_article: bool) -> str:
    """"boiler", "main" or "" of an element by its name and attributes."""
    if tag in BOILER or (tag == "header" and not in_article):
        return "boiler"
    role = "main" if tag in ("article", "main") else ""
    if attrs:
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none", value, re.I)) or (key == "role" and value.lower() in _BOILER_ROLE):
                return "boiler"
            if key in ("class", "id"):
                if role != "main" and _MAIN_NAME.search(value):
                    role = "main"
                elif tag not in ("article", "main", "body", "html") and _boiler_name(tag, value, in_article):
                    return "boiler"
            elif (key == "itemprop" and value == "articleBody") or (key == "role" and value.lower() in ("main", "article")):
                role = "main"
    return role


def blocks(source: str) -> list[tuple[str, int]]:
    """(text, zone) of the page's blocks in order; zone 1: in the part named as the article, 0: elsewhere, -1: boilerplate by markup.

    Boilerplate inside a line of text (a button, an advert in a span) is a block
    of its own; the line around it goes on after it.
    """
    out: list[tuple[str, int]] = []
    buffer: list[str] = []
    stack: list[tuple[str, str]] = []
    boiler = main = 0
    open_tags: dict[str, int] = {}
    open_blocks: list[int] = []  # their places in the stack
    around: list[list[str]] = []  # the texts that inline boilerplate interrupts

    def flush() -> None:
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                out.append((text, -1 if boiler else 1 if main else 0))

    def pop() -> None:
        nonlocal boiler, main, buffer
        tag, role = stack[-1]
        if role and tag not in BLOCKS:
            flush()
            if role == "boiler":
                buffer = around.pop()
        stack.pop()
        open_tags[tag] -= 1
        if open_blocks and open_blocks[-1] == len(stack):
            open_blocks.pop()
        boiler -= role == "boiler"
        main -= role == "main"

    at = 0
    lowered = None
    while source.find(">", at) >= 0 and (m := _TAG.search(source, at)):
        if m.start() > at:
            buffer.append(source[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCKS:
                flush()
            if open_tags.get(tag):
                if tag in BLOCKS or stack[-1][0] == tag:
                    while stack[-1][0] != tag:
                        pop()
                    if tag in BLOCKS:
                        flush()
                    pop()
                else:  # misnested inline: only this one ends, or with a role all in it
                    i = len(stack) - 1
                    while stack[i][0] != tag:
                        i -= 1
                    if stack[i][1]:
                        while len(stack) > i:
                            pop()
                        continue
                    open_tags[tag] -= 1
                    del stack[i]
                    for k in range(len(open_blocks) - 1, -1, -1):
                        if open_blocks[k] < i:
                            break
                        open_blocks[k] -= 1
            continue
        if tag in RAW:
            if tag in ("svg", "template", "noscript", "iframe"):
                buffer.append(" ")
            lowered = lowered if lowered is not None else source.lower()
            end = lowered.find(f"</{tag}", at)
            close = source.find(">", end) if end >= 0 else -1
            at = close + 1 if close >= 0 else len(source)
            continue
        if tag in BLOCKS:
            flush()
            if tag in _CLOSES_P or tag == "p":
                k = open_blocks[-1] if open_blocks else -1
                if k >= 0 and stack[k][0] == "p":
                    while len(stack) > k + 1:
                        pop()
                    flush()
                    pop()
            if stack and tag in ("li", "option", "tr", "td", "th", "dd", "dt") and stack[-1][0] == tag:
                pop()
        elif tag in ("br", "img", "input", "wbr"):
            buffer.append("" if tag == "wbr" else " ")
        if tag in VOID or m[3].endswith("/"):
            continue
        role = _role(tag, m[3], main > 0)
        if role and tag not in BLOCKS:
            if role == "boiler":
                around.append(buffer)
                buffer = []
            else:
                flush()
        if tag in BLOCKS:
            open_blocks.append(len(stack))
        stack.append((tag, role))
        open_tags[tag] = open_tags.get(tag, 0) + 1
        boiler += role == "boiler"
        main += role == "main"
    buffer.append(_OPENS.split(source[at:], maxsplit=1)[0])  # a tag that never ends is no text
    flush()
    while around:
        pop()
        flush()
    return out


def _by_matches(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """A longest common subsequence over matching pairs (Hunt-Szymanski): few where lines are mostly distinct."""
    where: dict[int, list[int]] = {}
    for j, y in enumerate(b):
        where.setdefault(y, []).append(j)
    tails: list[int] = []
    links: list[tuple] = []
    for i, x in enumerate(a):
        for j in reversed(where.get(x, ())):
            k = bisect_left(tails, j)
            link = (i, j, links[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                links.append(link)
            else:
                tails[k] = j
                links[k] = link
    out, link = [], links[-1] if links else None
    while link:
        out.append(link[:2])
        link = link[2]
    return out[::-1]


def _by_bits(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """The same by rows of bits, whatever repeats: every row is one sum of whole numbers, and only every k-th is kept for the way back."""
    n, m = len(a), len(b)
    where: dict[int, list[int]] = {}
    for j, y in enumerate(b):
        where.setdefault(y, []).append(j)
    masks: dict[int, int] = {}

    def mask(x: int) -> int:
        if x in masks:
            return masks[x]
        bits = bytearray(m // 8 + 1)
        for j in where.get(x, ()):
            bits[j >> 3] |= 1 << (j & 7)
        out = int.from_bytes(bits, "little")
        if len(where.get(x, ())) > 4:
            masks[x] = out
        return out

    full = (1 << m) - 1

    def row(v: int, x: int) -> int:
        u = v & mask(x)
        return ((v + u) | (v - u)) & full

    step = max(1, int(n**0.5))
    v, kept = full, []
    for i, x in enumerate(a):
        if i % step == 0:
            kept.append(v)
        v = row(v, x)
    out, i, j, base, rows = [], n, m, n, []
    while i and j:
        if i - 1 < base:  # rows of the block that ends here: before each of its lines, and after the last
            base = (i - 1) // step * step
            rows = [kept[base // step]]
            for x in a[base:i]:
                rows.append(row(rows[-1], x))
        if rows[i - base] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            # the row before: the first of this block, or full
            if i and not (rows[i - base] >> (j - 1) & 1):
                continue
            out.append((i, j - 1))
            j -= 1
    return out[::-1]


def shared_lines(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """(i, j) of a longest common subsequence of a and b, ascending."""
    head, end = 0, min(len(a), len(b))
    while head < end and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < end - head and a[len(a) - 1 - tail] == b[len(b) - 1 - tail]:
        tail += 1
    ia, ib = range(head, len(a) - tail), range(head, len(b) - tail)
    both = {a[i] for i in ia} & {b[j] for j in ib}
    ia, ib = [i for i in ia if a[i] in both], [j for j in ib if b[j] in both]
    x, y = [a[i] for i in ia], [b[j] for j in ib]
    counts = Counter(y)
    way = _by_matches if sum(counts[v] for v in x) <= 16 * (len(x) + len(y)) else _by_bits
    inner = [(ia[i], ib[j]) for i, j in way(x, y)]
    return [(i, i) for i in range(head)] + inner + [(len(a) - tail + k, len(b) - tail + k) for k in range(tail)]


def article(lines: list[str], zones: list[int], shared: set[int], differed: bool = True) -> list[str]:
    """What stays: differencing deletes shared lines, then the markup has its say. Without a page to differ from, a named article is all that stays."""
    named = 1 in zones and not differed
    return [line for i, (line, zone) in enumerate(zip(lines, zones, strict=True)) if zone == 1 or (i not in shared and zone >= named)]


def _nearest(keys: DataFrame) -> DataFrame:
    """(rid, partner): the next page of the host in order of (path, rid), for the last one the page before.

    The order is total over all hosts: range partitions sorted inside, with the
    rows at both ends of each partition joined across, so a host may be any
    share of the table.
    """
    ordered = keys.repartitionByRange(partitions(keys.sparkSession), "host", "path", "rid").sortWithinPartitions("host", "path", "rid").withColumn("pid", F.spark_partition_id()).withColumn("no", F.monotonically_increasing_id())
    ordered = cut(ordered)
    inside = Window.partitionBy("pid").orderBy("no")
    near = ordered.select("rid", "pid", "host", F.lead(F.struct("rid", "host")).over(inside).alias("after"), F.lag(F.struct("rid", "host")).over(inside).alias("before"))
    ends = ordered.groupBy("pid").agg(F.min_by(F.struct("rid", "host"), "no").alias("first"), F.max_by(F.struct("rid", "host"), "no").alias("last"))  # a row a partition
    across = Window.orderBy("pid")
    ends = ends.select("pid", F.lead("first").over(across).alias("next_first"), F.lag("last").over(across).alias("prev_last"))
    near = near.join(F.broadcast(ends), "pid")
    after, before = F.coalesce("after", "next_first"), F.coalesce("before", "prev_last")
    return near.select("rid", F.when(after["host"] == F.col("host"), after["rid"]).when(before["host"] == F.col("host"), before["rid"]).alias("partner"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars, n_lines, n_shared.

    n_lines counts the page's blocks, n_shared those on the longest common
    subsequence with the nearest page. Null html is an empty page (text "").
    Null URLs form one host of their own; equal URLs order by content. Equal
    rows share their result. Ids may be null or repeat; other columns are ignored.
    """
    small_batches(pages.sparkSession, 128)
    url, source = F.col(url_col).cast("string"), F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), source.alias("html"), F.xxhash64(id_col, url, source).alias("rid"))

    def parse(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            found = [blocks(s) for s in pdf["html"]]
            yield pd.DataFrame({
                "page_id": pdf["page_id"], "url": pdf["url"], "rid": pdf["rid"],
                "lines": [[t for t, _ in f] for f in found], "zones": [np.array([z for _, z in f], dtype="i1") for f in found],
                "hashes": [np.array([xxhash.xxh3_64_intdigest(t) for t, _ in f], dtype="u8").astype("i8") for f in found],
            })

    parsed = rows.mapInPandas(parse, "page_id long, url string, rid long, lines array<string>, zones array<tinyint>, hashes array<bigint>")
    address = F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://([^/?#]*))?([^?#]*)", 1)
    path = F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://([^/?#]*))?([^?#]*)", 2)
    keys = rows.select("rid", F.lower(address).alias("host"), path.alias("path")).groupBy("rid").agg(F.first("host").alias("host"), F.first("path").alias("path"))
    pairs = _nearest(keys)
    theirs = parsed.select(F.col("rid").alias("partner"), F.col("hashes").alias("theirs")).join(pairs, "partner").groupBy("rid").agg(F.first("theirs").alias("theirs"))

    def differ(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            texts, shared = [], []
            for lines, zones, mine, other in zip(pdf["lines"], pdf["zones"], pdf["hashes"], pdf["theirs"], strict=True):
                common = {i for i, _ in shared_lines(mine.tolist(), other.tolist())} if other is not None else set()
                texts.append("\n".join(article(list(lines), list(zones), common, other is not None)))
                shared.append(len(common))
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts], "n_lines": [len(x) for x in pdf["lines"]], "n_shared": shared})

    return parsed.join(theirs, "rid", "left").select("page_id", "url", "lines", "zones", "hashes", "theirs").mapInPandas(differ, "page_id long, url string, text string, n_chars long, n_lines long, n_shared long")
