"""Main text of web pages by template deduction over the pages of a host.

1. Every page becomes a sequence of tokens: block-level tags and block texts, each with the path of
   the containers around it.
2. Per host and token, the occurrence vector (how often each page has the token) is condensed to
   sums of page hashes, which map-side combine adds up. Tokens with one vector form an
   equivalence class. Classes that most pages of the host share make its template; a template is
   no longer than about two pages.
3. On each page a class is valid if its tokens come in the same order in every round of their
   occurrences; valid classes are nested by the slot of the larger class they lie in.
   Text in template tokens is the site's, not the page's; what is left are the slots.
4. The article is what stands in slots within <article> or <main> if the page has them, else in all
   slots; slots inside menus, headers, footers, sidebars, notices, adverts, forms, reader comments
   and hidden elements are left out, wherever they stand.

Rules for the text: character references are decoded; white space inside a block becomes one space,
blocks are joined by one space in page order. Inline tags join their text to the text around it.

Defined results: a NULL or empty page gives an empty text; so does one without an article text. Ties between classes
of one size go by their hash; a very long page is one row like any other; formulas are text. A
NULL url, or one without a host, has no template and is read by step 4 alone, as is a page of a
host with fewer than MIN_PAGES different pages. Repeated rows give repeated results and count once
for the template; an empty table gives an empty result. Only the three named columns are read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.bounds import settle
from tallyforge.llm.common import rows_of

# A class belongs to the template if at least this share of a host's pages has it, and the host
# has at least MIN_PAGES pages; copies of one page count as one.
TEMPLATE_SHARE = 0.5
MIN_PAGES = 3
# Text inside an article is the site's only if nearly all of many pages have it.
ARTICLE_SHARE = 0.9
ARTICLE_PAGES = 8

# What HTML says about elements.
RAW = "script|style|noscript|template|iframe|textarea|svg|object|select"
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr "
    # formulas
    "math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mpadded mphantom mtable mtr mtd semantics".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("html head body main article section div nav header footer aside form ul ol dl menu table figure dialog details fieldset button blockquote".split())
SITE = frozenset("head nav footer aside form menu dialog button fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
# Words in class or id names that tell what an element is for.
HINTS = frozenset(
    "nav navbar navigation menu menus footer sidebar aside ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice notices banner breadcrumb breadcrumbs comment comments disqus respond replies share sharing social related "
    "newsletter subscribe signup login popup modal overlay toolbar widget pagination pager masthead topbar".split()
)
# An article element of these classes is a comment or an advert; an element with one of these classes holds the page.
SMALL_ARTICLES = frozenset("comment comments reply respond ad ads advert sponsored promo".split())
WRAPPERS = frozenset("content main article post entry page wrapper container layout story".split())
# Elements that may stand in a head; any other one ends it.
HEAD = frozenset("title meta link base style script".split())

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<({RAW})(?=[\s/>])[^>]*(?:/>|>.*?(?:</\1\s*>|\Z))"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|\Z)", re.I)


@dataclass(slots=True)
class Token:
    key: int  # hash of the token and its path
    text: str | None  # None for a tag
    inside: bool  # within an article or main element
    site: bool  # within an element of the site (menu, footer, advert ...)


def site_element(name: str, attributes: str, inside: bool) -> tuple[bool, str]:
    """(is it an element of the site, its class and id as written)."""
    found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
    mark = f"{found.get('class', '')} {found.get('id', '')}".lower()
    if name in ("html", "body", "main"):
        return False, mark
    if name == "article":
        return bool(set(re.split(r"[^a-z0-9]+", mark)) & SMALL_ARTICLES), mark
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I)
    words = set(re.split(r"[^a-z0-9]+", mark))
    if not inside and (name == "header" or "header" in words):
        return True, mark
    hinted = words & HINTS and not set(mark.split()) & WRAPPERS
    return bool(hidden or name in SITE or found.get("role", "").lower() in ROLES or hinted), mark


def tokens(page: str) -> list[Token]:
    """The tokens of a page in order; every block of text is one token, white space condensed."""
    out: list[Token] = []
    stack: list[tuple[str, bool, bool, int]] = []  # name, site, inside, path
    buffer: list[str] = []

    def key(what: str) -> int:
        path = stack[-1][3] if stack else 0
        return xxhash.xxh64_intdigest(what.encode("utf-8", "replace"), path & 0xFFFFFFFFFFFFFFFF) - (1 << 63)

    def flush() -> None:
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                top = stack[-1] if stack else ("", False, False, 0)
                out.append(Token(key(text), text, top[2], top[1]))

    at = 0
    for m in TAG.finditer(page):
        if m.start() > at:
            buffer.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        name = m.group(3)
        if name is None:
            continue  # comments, scripts, declarations
        name, closing = name.lower(), m.group(2)
        if name == "br":
            buffer.append(" ")
            continue
        if closing:
            known = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if name not in INLINE or known is not None:
                flush()
                if name not in INLINE:
                    out.append(Token(key("</" + name), None, False, False))
            if known is not None:
                del stack[known:]
            continue
        if stack and stack[-1][0] == "head" and name not in HEAD:
            flush()
            stack.pop()
        top = stack[-1] if stack else ("", False, False, 0)
        site, mark = site_element(name, m.group(4), top[2])
        holds = name not in VOID and not m.group(4).rstrip().endswith("/") and (name in CONTAINERS or site)
        if name not in INLINE or holds:
            flush()
            out.append(Token(key(f"<{name} {mark}"), None, False, False))
        if holds:
            path = xxhash.xxh64_intdigest(f"{name} {mark}".encode("utf-8", "replace"), top[3])
            stack.append((name, top[1] or site, top[2] or name in ("article", "main"), path))
    if at < len(page):
        buffer.append(entities.unescape(page[at:]))
    flush()
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, page hash, html): one row per page and token (host, token, page, times, place)."""
    for b in rows_of(batches, 256):
        host, token, page, times, place = [], [], [], [], []
        for h, p, t in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
            seen: dict[int, list[int]] = {}
            for i, x in enumerate(tokens(t or "")):
                e = seen.setdefault(x.key, [0, i])
                e[0] += 1
            for k, (n, i) in seen.items():
                host.append(h)
                token.append(k)
                page.append(p)
                times.append(n)
                place.append(i)
        cols = [pa.array(host, pa.string()), *[pa.array(c, pa.int64()) for c in (token, page, times, place)]]
        yield pa.record_batch(cols, names=["host", "token", "page", "times", "place"])


def host_of(url: Column) -> Column:
    """Host of a url in lower case; NULL if there is none."""
    found = F.lower(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)", 1))
    return F.when(found != "", found)


def templates(pages: DataFrame) -> DataFrame:
    """(host, n, template): pages (host, html) condensed to the classes most different pages of a host share.

    Copies are found by hashes alone; only pages that have copies are dealt by page, to keep one of each.

    template has (token, class, support) in the order of the tokens' mean places. Sums of two
    32-bit halves of page hashes, weighted by the number of occurrences, stand for the vectors.
    """
    d = pages.where("host is not null").select("host", F.xxhash64("html").alias("page"), "html")
    copies = settle(d.groupBy("host", "page").agg(F.count("*").alias("copies")), "page-copies")
    counts = copies.groupBy("host").agg(F.count("*").alias("n"))
    repeated = settle(copies.where("copies > 1").select("host", "page"), "repeated-pages")
    single, once = d.join(repeated, ["host", "page"], "left_anti"), d.join(repeated, ["host", "page"], "left_semi").dropDuplicates(["host", "page"])
    kind = "host string, token bigint, page bigint, times bigint, place bigint"
    seen = single.mapInArrow(_count, kind).unionByName(once.mapInArrow(_count, kind))
    part = lambda s: F.sum(F.shiftrightunsigned(F.xxhash64("page", "times", F.lit(s)), 32))
    vectors = seen.groupBy("host", "token").agg(part(0).alias("a"), part(1).alias("b"), F.count("*").alias("support"), F.avg("place").alias("place"))
    common = vectors.join(counts, "host").where((F.col("support") >= TEMPLATE_SHARE * F.col("n")) & (F.col("n") >= MIN_PAGES))
    item = F.struct("place", "token", F.xxhash64("a", "b", "support").alias("class"), "support")
    return common.groupBy("host", "n").agg(F.array_sort(F.collect_list(item)).alias("template"))


def valid_classes(page: list[Token], classes: dict[int, list[int]]) -> set[int]:
    """Tokens of the classes whose order holds on this page in every round of their occurrences.

    Classes are nested largest first: one that straddles a token of a class it began inside of,
    between two of its own tokens of a round, is not valid.
    """
    where: dict[int, list[int]] = {}
    of = {t: c for c, ts in classes.items() for t in ts}
    for i, x in enumerate(page):
        if x.key in of:
            where.setdefault(x.key, []).append(i)
    good: set[int] = set()
    slot = [0] * (len(page) + 1)
    for c in sorted(classes, key=lambda c: (-len(classes[c]), c)):
        members = [t for t in classes[c] if t in where]
        rounds = {len(where[t]) for t in members}
        if not members or len(rounds) != 1 or len(members) < len(classes[c]):
            continue
        n = rounds.pop()
        members.sort(key=lambda t: where[t][0])
        flat = [where[t][k] for k in range(n) for t in members]
        if any(x >= y for x, y in zip(flat, flat[1:], strict=False)):
            continue
        if n > 1 and any(slot[where[members[0]][k]] != slot[where[members[-1]][k]] for k in range(n)):
            continue
        good.update(members)
        if n == 1:  # its tokens bound the slots that other classes nest in
            bounds = set(flat)
            now = 0
            for i in range(len(page)):
                now += i in bounds
                slot[i] = slot[i] * (len(page) + 1) + now
            names: dict[int, int] = {}
            slot = [names.setdefault(s, len(names)) for s in slot]
    return good


def main_text(page: str, template: list[dict] | None = None, n: int = 0) -> str:
    """The article text of one page, given the template of its host."""
    seq = tokens(page)
    site: dict[int, int] = {}
    if template:
        classes: dict[int, list[int]] = {}
        for x in template:
            classes.setdefault(x["class"], []).append(x["token"])
        support = {x["token"]: x["support"] for x in template}
        site = {t: support[t] for t in valid_classes(seq, classes)}
    landmark = any(x.inside and x.text for x in seq)

    def slot(x: Token) -> bool:
        if x.site or (landmark and not x.inside):
            return False
        shared = site.get(x.key)
        if shared is None:
            return True
        return x.inside and not (n >= ARTICLE_PAGES and shared >= ARTICLE_SHARE * n)

    return " ".join(x.text for x in seq if x.text and slot(x))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in rows_of(batches, 256):
        texts = [main_text(h or "", t, n or 0) for h, t, n in zip(*[b.column(i).to_pylist() for i in (2, 3, 4)], strict=True)]
        chars = pa.array([len(t) for t in texts], pa.int64())
        yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), chars], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) per row of ``pages``.

    The template table is written first, so the planner sees its size: small ones reach the pages by
    broadcast, large ones by a join on the host that the adaptive planner splits if a host is hot.
    """
    d = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    deduced = settle(templates(d.select("host", "html")), "templates")
    joined = d.join(deduced, "host", "left").select("page_id", "url", "html", "template", "n")
    kind = d.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars bigint")
