"""HTML extraction with site template removal.

1. Each page is cut into its element subtrees. A subtree is known by a hash of its start tag, its own text (white space
   collapsed) and its children's hashes, built from the leaves upwards, together with its host.
2. Spark counts, for each host, on how many distinct pages each subtree occurs, and the pages of the host. Copies of a page
   and versions of one url are one page.
3. Subtrees that recur on at least ``MIN_PAGES`` pages, and one more for each tenfold of ``FEW_PAGES`` that the host has, are
   the site's template and are deleted from each page, however small their share of a large host. A share is needed besides
   where the page's own text may recur, since articles quote each other and sites print articles twice: prose
   (paragraphs, headings, quotes, list items) within the article goes from ``PROSE_PAGES`` pages and ``PROSE_SHARE`` on;
   prose of a page without article or main element, and what holds the page's largest article or half of an article or
   main element, from ``MIN_PAGES`` and ``SHARE`` on. The page's largest article and main elements always stay.
4. Of what stays, elements that declare what they are (nav, header, footer, aside, form, script, style and the
   like, or such a role, class or id) go too: a menu may differ on each page. Within an article or main element a class or id must
   be made up of such names alone, and paragraphs and the like have no name. Main elements, and articles beside them,
   give the text, all they hold, in page order. Without main it is the smallest element around all articles that are left
   and the headline (an h1 in one of them, else the first h1); without either, the whole page.

Text: character references decoded, white space within a block (line breaks too) made one space, trimmed, blocks in
page order joined by two ``\\n``. Nothing else is dropped.

The templates of all hosts are keys of 8 bytes. Where these are at most ``BROADCAST_KEYS`` (counted) they travel with the
tasks, else each page's keys are joined to them in Spark; both give the same text.

Defined cases: null or empty html gives an empty text; an empty table gives an empty table; a null url or one without host belongs to the host ''; repeated
rows count as one page; unclosed elements end with their parent, a cut-off page at its end; of equally large articles the first
is the page's largest; very long and deeply nested pages take time linear in their length; extra columns pass through, whatever
their names (``text`` and ``n_chars`` are taken over).
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import free_name, written

MIN_PAGES = 5
FEW_PAGES = 100
SHARE = 0.2
PROSE_PAGES = 10
PROSE_SHARE = 0.5
BROADCAST_KEYS = 500_000

# Element names by their role in HTML.
RAW = "script style noscript template textarea title svg math iframe object canvas video audio select button"
DROPPED = "head nav header footer aside form dialog menu fieldset"
PROSE = "p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th tr figcaption address caption"
WRAPPERS = "html body main article section div ul ol dl table thead tbody tfoot figure details summary center hgroup search"
ROLES = "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar"
NAMES = (
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside ad ads advert adverts advertisement "
    "advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice popup modal overlay newsletter "
    "subscribe signup login share sharing social related recommended recommendations comment comments commentlist disqus "
    "replies respond widget toolbar pagination pager skip"
)
_PROSE, _DROPPED, _ROLES, _NAMES = ({*x.split()} for x in (PROSE, DROPPED, ROLES, NAMES))
_BLOCKS = _PROSE | _DROPPED | {*WRAPPERS.split()}
_SECTIONS = {"article", "main"}
#: A start tag ends an open element of the same family, up to the nearest of the bounds.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}

_STRIP = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW.replace(' ', '|')})(?=[\s/>])[^>]*(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S | re.I)
_RAW_END = re.compile(rf"</({RAW.replace(' ', '|')})(?=[\s/>])[^>]*>", re.I)
_SPACE = re.compile(r"\s+")
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*?)(?:>|\Z)""")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)


class Element:
    __slots__ = ("attributes", "end", "inner", "parent", "start", "tag")

    def __init__(self, tag: str, attributes: str, start: int, inner: int, parent: Element | None):
        self.tag, self.attributes, self.start, self.inner, self.parent, self.end = tag, attributes, start, inner, parent, -1


def clean(html: str | None) -> str:
    """Without comments, declarations and elements whose content is no text; white space collapsed.

    Of such an element that nothing closes only the tag goes, unless it is a script or style, which then runs to the end of the page;
    svg and math may close themselves. Names with more to them (``<video-player>``) are other elements.
    """
    html = html or ""
    ends: dict[str, list[tuple[int, int]]] = {}
    for m in _RAW_END.finditer(html):
        ends.setdefault(m[1].lower(), []).append(m.span())
    kept, at = [], 0
    while m := _STRIP.search(html, at):
        kept += [html[at : m.start()], " "]
        at, name = m.end(), (m[1] or "").lower()
        if name and not (name in ("svg", "math") and m[0].endswith("/>")):
            i = bisect_left(closing := ends.get(name, []), (at,))
            at = closing[i][1] if i < len(closing) else len(html) if name in ("script", "style") else at
    return _SPACE.sub(" ", "".join([*kept, html[at:]]))


def elements(page: str) -> list[Element]:
    """All block and structure elements of a cleaned page in the order of their start tags, with their ends."""
    found: list[Element] = []
    stack: list[Element] = []
    opened: Counter[str] = Counter()  # open elements by tag, so that the stack is searched only for what it holds

    def close(down_to: int, at: int) -> None:
        for e in stack[down_to:]:
            e.end = at
            opened[e.tag] -= 1
        del stack[down_to:]

    for m in _TAG.finditer(page):
        tag = m[2].lower()
        if tag not in _BLOCKS:
            continue
        if m[1]:
            for i in range(len(stack) - 1, -1, -1) if opened[tag] else ():
                if stack[i].tag == tag:
                    close(i + 1, m.start())
                    close(i, m.end())
                    break
            continue
        same, bounds = _ENDS.get(tag, ((), ()))
        for i in range(len(stack) - 1, -1, -1) if opened["p"] or any(opened[x] for x in same) else ():
            if stack[i].tag == "p":
                close(i, m.start())
                break
            if stack[i].tag in same:
                close(i, m.start())
                if tag != "tr":
                    break
            elif stack[i].tag in bounds:
                break
        e = Element(tag, m[3], m.start(), m.end(), stack[-1] if stack else None)
        found.append(e)
        if tag in ("head",) or not m[3].endswith("/"):
            stack.append(e)
            opened[tag] += 1
        else:
            e.end = m.end()
    close(0, len(page))
    return found


def subtree_keys(host: str, page: str, found: list[Element]) -> list[int]:
    """A signed 64-bit key of host and subtree for each element: a hash of its own markup and text and of its children's hashes."""
    seed, digest = xxhash.xxh3_64_intdigest(host), xxhash.xxh3_64_intdigest
    hashes = [0] * len(found)
    #: For each element that has children read already: where its text goes on, from the end, and what follows there.
    tails: dict[int, tuple[int, list[str]]] = {}
    for i in range(len(found) - 1, -1, -1):  # children stand after their parents and are hashed before them
        e = found[i]
        upto, parts = tails.pop(id(e), (e.end, []))
        parts.append(page[e.start : upto])
        hashes[i] = digest("\0".join(parts), seed)
        if e.parent is not None:
            upto, siblings = tails.get(id(e.parent)) or (e.parent.end, [])
            siblings += (page[e.end : upto], f"{hashes[i]:x}")
            tails[id(e.parent)] = e.start, siblings
    return [h - (1 << 63) for h in hashes]


def _within(found: list[Element]) -> list[bool]:
    """Of each element, whether it lies in an article or main element."""
    out: dict[int, bool] = {}
    for e in found:
        p = e.parent
        out[id(e)] = p is not None and (p.tag in _SECTIONS or out[id(p)])
    return [out[id(e)] for e in found]


def _outer(found: list[Element], inside: list[bool]) -> Element | None:
    """The largest article or main element that lies in no other."""
    return max((e for e, w in zip(found, inside) if e.tag in _SECTIONS and not w), key=lambda e: e.end - e.start, default=None)


#: What a subtree is to its page, which says how often it must recur.
SITE, UNMARKED, IN_ARTICLE = 0, 1, 2


def kinds(found: list[Element]) -> list[int]:
    """IN_ARTICLE: prose within an article. UNMARKED: prose of a page without one, or what holds the largest or half of one. Else SITE."""
    inside = _within(found)
    outer = _outer(found, inside)
    holders: set[int] = set()
    e = outer
    while e is not None:
        holders.add(id(e))
        e = e.parent
    section: dict[int, Element | None] = {}
    out = []
    for e, w in zip(found, inside):
        p = e.parent
        around = section[id(e)] = None if not w else section[id(p)] or p
        prose, bulk = e.tag in _PROSE, around is not None and 2 * (e.end - e.start) >= around.end - around.start
        out.append(IN_ARTICLE if w and prose else UNMARKED if bulk or id(e) in holders or prose and outer is None else SITE)
    return out


def _declared(e: Element, titled: bool, inside: bool, within: bool) -> bool:
    """Whether an element says it is no part of an article. titled: it holds an h1, an article or main. within: it lies within an
    article or main, inside: it does or is one."""
    if e.tag in _DROPPED:
        return not titled or not inside and e.tag != "header" and e.tag != "form"
    if not e.attributes or e.tag in ("html", "body"):
        return False
    for name, value in _ATTRIBUTE.findall(e.attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if name == "role" and value in _ROLES and not titled:
            return True
        if name in ("class", "id") and not titled:
            names = [set(re.findall(r"[a-z]+", x)) for x in value.split()]
            # Within an article a word of a longer name ("related-work", "notice-board") says nothing, nor does the name of a paragraph.
            if e.tag not in _PROSE and any(x and x <= _NAMES for x in names) if within else any(x & _NAMES for x in names):
                return True
    return False


def _holds(around: Element, e: Element) -> bool:
    return around.start <= e.start and e.end <= around.end


def main_text(page: str, found: list[Element], templates: set[int], keys: list[int]) -> str:
    """The text of a cleaned page without template subtrees and declared boilerplate."""
    inside = _within(found)
    # What holds the headline or the largest article is no boilerplate, whatever its name says.
    outer = _outer(found, inside)
    titled: set[int] = set()
    for e in found:
        if e.tag == "h1" or e is outer:
            p = e.parent
            while p is not None and id(p) not in titled:
                titled.add(id(p))
                p = p.parent
    gone: list[tuple[int, int]] = []
    sections: list[Element] = []
    headlines: list[Element] = []
    until = -1
    for e, key, w in zip(found, keys, inside):
        if e.start < until:
            continue
        own = e.tag in _SECTIONS and not w
        stays = e is outer or own and e.tag == "main"
        if not stays and key in templates and e.tag not in ("html", "body") or _declared(e, id(e) in titled, w or own, w):
            gone.append((e.start, e.end))
            until = e.end
        elif own:
            sections.append(e)
        elif e.tag == "h1":
            headlines.append(e)
    if sections and all(e.tag == "article" for e in sections):
        starts = [a.start for a in sections]  # in page order, none within another
        titled_one = any(at and _holds(sections[at - 1], h) for h in headlines for at in (bisect_right(starts, h.start),))
        titles = [] if titled_one else headlines[:1]
        around: Element | None = sections[0]
        low, high = min(e.start for e in sections + titles), max(e.end for e in sections + titles)
        while around is not None and not (around.start <= low and high <= around.end):
            around = around.parent
        sections = [around] if around is not None else []
    spans = [(e.start, e.end) for e in sections] or [(0, len(page))]
    begins, ends = [a for a, _ in gone], [b for _, b in gone]
    blocks, parts, last, end = [], [], 0, -1
    for low, high in spans:
        if high <= end:
            continue
        low = max(low, end)
        cut = gone[bisect_right(ends, low) : bisect_left(begins, high)]  # both in page order and disjoint
        last = low
        for a, b in [*cut, (high, high)]:
            _blocks(page, last, a, blocks, parts)
            _flush(blocks, parts)
            last = max(last, b)
        end = high
    return "\n\n".join(blocks)


def _flush(blocks: list[str], parts: list[str]) -> None:
    if parts:
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            blocks.append(text)
        parts.clear()


def _blocks(page: str, start: int, end: int, blocks: list[str], parts: list[str]) -> None:
    at = start
    for m in _TAG.finditer(page, start, end):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        tag = m[2].lower()
        if tag in _BLOCKS or tag == "hr":
            _flush(blocks, parts)
        elif tag == "br" or tag == "img":
            parts.append(" ")
    if at < end:
        parts.append(page[at:end])


def _keyed(pages: DataFrame) -> DataFrame:
    """(host_key, key, kind, copy, address): of each page the distinct subtrees, with keys of its content and of its url."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hosts, keys, ranks, copies, addresses = [], [], [], [], []
            for host, url, html in zip(batch.host, batch.url, batch.html):
                page = clean(html)
                found = elements(page)
                own: dict[int, int] = {}
                for key, kind in zip(subtree_keys(host, page, found), kinds(found)):
                    own[key] = min(kind, own.get(key, kind))
                copy = xxhash.xxh3_64_intdigest(page) - (1 << 63)
                hosts += [xxhash.xxh3_64_intdigest(host) - (1 << 63)] * len(own)
                keys += own.keys()
                ranks += own.values()
                copies += [copy] * len(own)
                addresses += [copy if url is None else xxhash.xxh3_64_intdigest(url) - (1 << 63)] * len(own)
            longs = {"host_key": hosts, "key": keys, "kind": ranks, "copy": copies, "address": addresses}
            yield pd.DataFrame({name: np.array(values, np.int64) for name, values in longs.items()})

    return pages.mapInPandas(cut, "host_key long, key long, kind long, copy long, address long")


def _distinct_pages() -> Column:
    return F.least(F.count_distinct("copy"), F.count_distinct("address"))


def template_keys(pages: DataFrame) -> DataFrame:
    """(key): the template subtrees of all hosts; pages has host, url and html."""
    counts = _keyed(pages).groupBy("host_key", "key").agg(_distinct_pages().alias("pages"), F.min("kind").alias("kind"))
    often = counts.filter(F.col("pages") >= F.when(F.col("kind") == IN_ARTICLE, PROSE_PAGES).otherwise(MIN_PAGES))

    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in texts], dtype="int64")

    def host_pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            copies = hashed(batch.html.map(clean))
            addresses = [c if u is None else xxhash.xxh3_64_intdigest(u) - (1 << 63) for c, u in zip(copies, batch.url)]
            yield pd.DataFrame({"host_key": hashed(batch.host), "copy": copies, "address": np.array(addresses, np.int64)})

    sizes = pages.mapInPandas(host_pages, "host_key long, copy long, address long").groupBy("host_key").agg(_distinct_pages().alias("all"))
    tenfolds = F.greatest(F.lit(0.0), F.log10(F.col("all") / FEW_PAGES))
    least = (
        F.when(F.col("kind") == SITE, MIN_PAGES + F.floor(tenfolds))
        .when(F.col("kind") == UNMARKED, SHARE * F.col("all"))
        .otherwise(PROSE_SHARE * F.col("all"))
    )
    return often.join(sizes, "host_key").filter(F.col("pages") >= least).select("key")


def extract(pages: DataFrame, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """pages with ``text`` and ``n_chars``."""
    ship(pages.sparkSession)
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    own, page_key, answer = (free_name(pages, f"_{x}") for x in ("host", "page", "answer"))
    named = pages.withColumn(own, host)
    plain = named.select(F.col(own).alias("host"), "url", "html")
    templates = written(template_keys(plain), "templates")

    if templates.count() <= broadcast_keys:
        known = {r.key for r in templates.collect()}  # counted before: at most broadcast_keys longs

        @F.pandas_udf("string")
        def text_of(hosts: pd.Series, htmls: pd.Series) -> pd.Series:
            return pd.Series([page_text(h, x, known) for h, x in zip(hosts, htmls)], dtype=object)

        done = named.withColumn(answer, text_of(F.col(own), F.col("html")))
    else:
        named = named.withColumn(page_key, F.xxhash64(own, "html"))

        def of_page(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for number, host_name, html in zip(batch.page, batch.host, batch.html):
                    page = clean(html)
                    keys = {*subtree_keys(host_name, page, elements(page))}
                    yield pd.DataFrame({"page": np.int64(number), "key": np.array([*keys], np.int64)})

        keyed = named.select(F.col(page_key).alias("page"), F.col(own).alias("host"), "html").mapInPandas(of_page, "page long, key long")
        present = keyed.join(templates, "key").groupBy("page").agg(F.collect_set("key").alias("keys"))
        joined = named.join(present, named[page_key] == present.page, "left")

        @F.pandas_udf("string")
        def text_with(hosts: pd.Series, htmls: pd.Series, keys: pd.Series) -> pd.Series:
            return pd.Series([page_text(h, x, {*(() if k is None else k)}) for h, x, k in zip(hosts, htmls, keys)], dtype=object)

        done = joined.withColumn(answer, text_with(F.col(own), F.col("html"), F.col("keys"))).drop("page", "keys")
    return done.withColumn("text", F.col(answer)).withColumn("n_chars", F.length(answer).cast("long")).drop(own, page_key, answer)


def page_text(host: str, html: str | None, templates: set[int]) -> str:
    page = clean(html)
    found = elements(page)
    return main_text(page, found, templates, subtree_keys(host, page, found))
