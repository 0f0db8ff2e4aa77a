"""Main-text extraction with site-template removal.

1. Every page is parsed on the executors (once for its outline, once for its text:
   a written copy of the parsed pages would be as large as they are).  Elements that are no article
   text by their kind (menus, headers, footers, asides, forms, scripts ...) or by
   their class, id or role (adverts, notices, comments ...) go at once.  A class or id
   removes no element that holds the page's ``main``, an ``article`` or the only ``h1``
   (one for comments, adverts or other articles goes with the articles in it, if the page
   has ``main`` or an ``article`` elsewhere), and in an article no heading; there
   a class only counts if all its words are marks or say nothing, and an id if it says
   nothing but comments or adverts.  Of what
   is left, the text of the page's ``article`` elements counts, else of its
   ``main`` element, else of its body without link lists: lists (never headings or
   paragraphs outside of lists) without a heading, of whose characters at least
   ``LINK_SHARE`` stand in links, and most of whose items have no word outside of
   links.  A link is an ``a`` with ``href``, up to its end, the next ``a`` or the end of
   the block it stands in.  Articles that all stand in elements with such a class or id
   count alone only if they have half of that text, and never if the class is one for
   comments, adverts or other articles.
2. Every remaining element's subtree (tag, text, children) is hashed.  Spark
   counts per host in how many different pages a subtree stands, and in how many of
   them with different content besides.  The site's templates, deleted from all of its
   pages, are those that stand

   * in at least ``MIN_PAGES`` and a share of ``MIN_SHARE`` of the host's pages, or
   * with different content in at least ``MIN_PAGES``, a share of the host's pages (``PART_SHARE`` for
     containers, ``PARAGRAPH_SHARE`` for paragraphs and what else holds text itself)
     and a share of ``OWN_PAGES`` of those it stands in, or
   * with different content in at least ``FEW_PAGES`` and a share of ``MIN_SHARE`` of the host's pages;

   the last two but for headings, list items and parts of tables, which recur among
   content too.  Pages with the same content count once, so that copies of an
   article do not make it a template.  A page has different content besides a subtree if at least
   ``OWN_SHARE`` of its other text stands on no other page of the host: blocks are compared by the
   lowest and the highest hash of their shingles, so that an edited copy's paragraphs are no content of its own.

Scale: the outlines of the pages (hashes, no text) are written once.  Counts are keyed by
(host, subtree) or (host, shingle) after partial aggregation, so a host
with a third of all pages is spread over them; the templates go back to
the pages by a join that adaptive execution may split.  No list of pages is
ever collected.

A block is the text between two block tags; white space inside becomes one
space, blocks are joined by two line feeds in page order.

Defined cases: a null or empty page has an empty text; a null URL is a site of
its own without a name, whose pages are never compared; a tag cut off by the end
of the page is dropped, unclosed elements end with the page; a very long page is
read whole; repeated rows give a row each; an empty table gives an empty
result; other columns are kept (``text`` and ``n_chars`` of the input are
replaced).
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.llm.common import materialize, unused
from spendlens.llm.url_filter import url_host

MIN_PAGES, MIN_SHARE = 10, 0.5
FEW_PAGES, PART_SHARE, PARAGRAPH_SHARE = 3, 0.05, 0.25
OWN_SHARE, OWN_PAGES = 0.1, 0.25
SHINGLE = 4  # words
LINK_SHARE = 0.5  # of a list's characters, where a page has neither article nor main

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary "
    "table tbody td template tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr keygen basefont bgsound".split())
RAW = frozenset("script style textarea title iframe noembed noframes".split())
CLOSE_P = BLOCKS - frozenset("body head html td th tr tbody thead tfoot caption template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FRAGMENTS = HEADINGS | frozenset("li dt dd caption colgroup td th tr tbody thead tfoot".split())
CONTAINERS = frozenset("div section ul ol dl dir table figure details hgroup center".split())
CONTAINER, PARAGRAPH, FRAGMENT = range(3)  # kinds of subtrees
LISTS, ITEMS = frozenset("ul ol dl dir".split()), frozenset("li dt dd".split())
# elements that are never article text
GONE = frozenset(
    "head script style noscript template textarea title iframe noembed noframes nav footer aside form button select option optgroup "
    "datalist fieldset legend input object embed applet audio video canvas map svg annotation annotation-xml menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form tablist".split())
# words of class, id and role that mark what is no article text wherever they stand
MARKS = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising advertorial sponsor sponsored sponsors promoted outbrain taboola "
    "nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager sidebar footer masthead topbar toolbar "
    "comment comments commentlist disqus respond replies cookie cookies consent gdpr newsletter subscribe subscription signup "
    "share sharing related recommended recommendations trending popup modal overlay paywall skip".split())
# words that do so unless the element says that it is content
WEAK = frozenset("header banner notice notices alert social promo promotion widget widgets search login register meta tags byline rail".split())
NOTICES = frozenset("banner notice notices promo promotion widget widgets".split())  # those of them that do so in an article too
CONTENT = frozenset("article content main post entry story body text".split())
# words that say nothing of what an element holds: in an article a class marks it only if all its other words are marks
NEUTRAL = frozenset("box container wrapper wrap inner outer block unit slot area panel section bar list item items links link buttons button form "
                    "articles posts stories story small large top bottom left right".split())
UNLESS = frozenset("has with no without is".split())  # what follows in a class or id says nothing of the element
# marks of elements that may hold articles that are not the page's
OTHERS = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising advertorial sponsor sponsored sponsors promoted outbrain taboola "
    "comment comments commentlist disqus respond replies related recommended recommendations trending".split())
# all that an id in an article may say to mark its element: others are made from titles
IDS = frozenset("ad ads adbox adsense advert adverts advertisement comment comments commentlist disqus outbrain taboola".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</(?![a-zA-Z])[^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPLIT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HREF = re.compile(r"(?:^|[\s\"'])href\s*=", re.I)
_EMPTY = re.compile(r"(?:^|[\s\"'])/$")  # the end of <a href="x"/>, but not of <a href=x/>
_LETTER = re.compile(r"[^\W\d_]")


def boilerplate(tag: str, attributes: str, in_article: bool) -> tuple[bool, frozenset | set]:
    """Whether an element is no article text by its kind, role or style, and the words of its class and id that say so."""
    none: frozenset = frozenset()
    if tag in GONE or tag == "header" and not in_article:
        return True, none
    if not attributes or tag in ("html", "body"):
        return False, none
    words: set[str] = set()
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True, none
        if name == "style" and "display:none" in value.replace(" ", "").lower():
            return True, none
        if name == "role" and value.strip().lower() in ROLES:
            return True, none
        if name in ("class", "id"):
            for one in value.split():
                parts = [w.lower() for w in _SPLIT.findall(one)]
                own = next((k for k, w in enumerate(parts) if w in UNLESS), len(parts))
                if name == "class" or not in_article or IDS.issuperset(parts):
                    words.update(parts[:own])
    if tag == "main" or in_article and tag in HEADINGS:
        return False, none
    if tag == "article":
        return False, words & {"comment", "comments", "ad", "ads", "advert", "advertisement", "related", "sponsored", "promoted"}
    if in_article:
        return False, words & (MARKS | NOTICES) if words - NEUTRAL <= MARKS | WEAK else none
    return False, words & MARKS or (words & WEAK if not words & CONTENT and tag not in HEADINGS else none)


class _Element:
    __slots__ = ("tag", "gone", "kind", "marks", "article", "main", "parts", "index", "anchor")

    def __init__(self, tag: str, gone: bool, kind: bool, marks: frozenset | set, article: int, main: bool, index: int):
        self.tag, self.gone, self.article, self.main, self.index = tag, gone, article, main, index
        self.kind, self.marks = kind, marks  # gone by kind, in itself or around it; marked by words
        self.parts: list[bytes] = []
        self.anchor = tag in ("html", "body", "main", "article")  # holds the article: no template


def _link_lists(blocks: list[tuple], kinds: dict[int, str]) -> set[int]:
    """The lists of links, from the blocks and the kinds (tags) of the lists, items and headings they stand in."""
    lists: dict[int, list] = {}
    for text, inside, _, _, linked, words in blocks:
        parts = [e for e in inside if e in kinds]
        for k, e in enumerate(parts):
            if kinds[e] in LISTS:
                one = lists.setdefault(e, [0, 0, {}, False])
                one[0] += len(text)
                one[1] += linked
                item = next((x for x in parts[k + 1:] if kinds[x] in ITEMS), e)
                one[2][item] = one[2].get(item, False) or words
                one[3] = one[3] or any(kinds[x] in HEADINGS for x in parts[k + 1:])
    return {e for e, (size, linked, items, heading) in lists.items()
            if not heading and linked >= LINK_SHARE * size and 2 * sum(items.values()) < len(items)}


def _kept(holders: list[tuple[str, list[_Element]]], n_titles: int) -> tuple[set[int], set[int], bool]:
    """The marked elements that stay for what they hold, those of them that do so for an article, and whether that may count alone.

    ``holders``: the page's main, outer article and h1 elements, each with the marked elements around it.
    """
    kept = {e.index for kind, around in holders if kind == "main" or kind == "h1" and n_titles == 1 for e in around}
    articles = [[e for e in around if e.index not in kept] for kind, around in holders if kind == "article"]
    levels = [sum(bool(e.marks & OTHERS) for e in around) for around in articles]
    least = 0 if any(kind == "main" for kind, _ in holders) else min(levels, default=0)
    weak = {e.index for around, n in zip(articles, levels, strict=True) if n == least for e in around}
    return kept | weak, weak, not least


def kind_of(tag: str) -> int:
    return FRAGMENT if tag in FRAGMENTS else CONTAINER if tag in CONTAINERS else PARAGRAPH


def parse_page(page: str | None) -> tuple[list[tuple[str, list[int]]], list[tuple[int, int, int]]]:
    """The blocks of the content, each with the elements it stands in, and (element, hash, kind) of the subtrees."""
    content, kept = _parse(page, (set(), set(), True))
    return _parse(page, kept)[0] if kept[0] else content  # the elements are numbered alike in both


def _parse(page: str | None, kept: tuple[set[int], set[int], bool]) -> tuple[tuple, tuple[set[int], set[int], bool]]:
    """``parse_page`` with these marked elements kept, and those that ought to be (``_kept``)."""
    blocks: list[tuple[str, list[int], int, bool, int, bool]] = []
    holders: list[tuple[str, list[_Element]]] = []
    n_titles = 0
    subtrees: list[tuple[int, int, int]] = []
    stack = [_Element("", False, False, frozenset(), 0, False, 0)]
    count, at = 1, 0
    links = 0  # inside a link: how many elements were open where it began
    kinds: dict[int, str] = {}  # the tags of lists, items and headings
    buffer: list[str] = []
    linked, words = 0, False  # characters of the buffer inside links, and whether it has a letter outside
    page = page or ""

    def flush() -> None:
        nonlocal linked, words
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:  # what is gone is not in the buffer
                top = next(e for e in reversed(stack) if not e.gone)
                blocks.append((text, [e.index for e in stack[1:] if not e.gone], top.article, top.main, linked, words))
                top.parts.append(text.encode("utf-8", "replace"))
            buffer.clear()
        linked, words = 0, False

    def pop() -> None:
        nonlocal links
        flush()
        e = stack.pop()
        if len(stack) < links:
            links = 0
        if not e.gone and e.parts:
            digest = hashlib.blake2b(b"\x00".join([e.tag.encode(), *e.parts]), digest_size=8).digest()
            stack[-1].parts.append(digest)
            if e.anchor:
                stack[-1].anchor = True
            else:
                subtrees.append((e.index, int.from_bytes(digest, "little", signed=True), kind_of(e.tag)))
        elif e.anchor:
            stack[-1].anchor = True

    def pop_to(tags: frozenset | set, within: frozenset | set = frozenset()) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                while len(stack) > i:
                    pop()
                return
            if stack[i].tag in within:
                return

    def add(text: str) -> None:
        nonlocal linked, words
        if text and not stack[-1].gone:
            text = entities.unescape(text)
            buffer.append(text)
            if links:
                linked += len(" ".join(text.split()))
            elif not words and _LETTER.search(text):
                words = True

    while at < len(page):
        m = TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at:m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if closing:
            if tag == "a":
                links = 0
            if tag in HEADINGS:
                pop_to(HEADINGS, {"td", "th"})
            elif tag in BLOCKS:
                flush()
                pop_to({tag}, {"td", "th"} if tag not in ("table", "tbody", "thead", "tfoot", "tr", "td", "th") else {"table"} - {tag})
            elif stack[-1].tag == tag:
                e = stack[-1]
                if e.gone:
                    stack.pop()
                    links = links if links <= len(stack) else 0
                else:
                    pop()
            continue
        if tag == "br":
            if not stack[-1].gone:
                buffer.append(" ")
            continue
        if tag == "a":
            links = len(stack) if _HREF.search(attributes) and not _EMPTY.search(attributes) else 0
        top = stack[-1]
        if tag in BLOCKS:
            flush()
            if tag in CLOSE_P:
                pop_to({"p"}, {"td", "th", "button", "object", "blockquote", "div", "li", "article", "section", "aside", "main"})
            if tag == "li":
                pop_to({"li"}, {"ul", "ol", "menu", "dir"})
            elif tag in ("dd", "dt"):
                pop_to({"dd", "dt"}, {"dl"})
            elif tag in ("td", "th"):
                pop_to({"td", "th"}, {"table"})
            elif tag == "tr":
                pop_to({"tr"}, {"table"})
            elif tag == "body":
                pop_to({"head"})
            top = stack[-1]
        kind, marks = (True, frozenset()) if top.kind else boilerplate(tag, attributes, bool(top.article))
        if tag in RAW:  # up to its end tag, whatever stands there
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            at = end.start() if end else len(page)
            continue
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS:
            continue
        n_titles += tag == "h1"
        if tag in BLOCKS or not top.kind and (kind or marks):  # of inline elements only those that go
            gone = top.gone or kind or bool(marks) and count not in kept[0]
            main = tag == "main" or 'role="main"' in attributes
            article = top.article
            around = [e for e in stack if e.marks] if not kind and (main or tag in ("article", "h1")) else []
            if tag == "article" and not article:
                article = 1 if any(e.index in kept[1] for e in around) else 2  # 1: stays for the article's sake
            stack.append(_Element(tag, gone, kind, marks, article, top.main or main, count))
            if not kind:
                if main:
                    holders.append(("main", around))
                if tag == "h1":
                    holders.append(("h1", [*around, stack[-1]] if marks else around))
                if tag == "article" and not top.article and not marks:
                    holders.append(("article", around))
            if tag in LISTS or tag in ITEMS or tag in HEADINGS:
                kinds[count] = tag
            count += 1
    while len(stack) > 1:
        pop()
    flush()
    if any(b[2] == 2 for b in blocks):
        chosen = [b for b in blocks if b[2]]
    else:
        lists = _link_lists(blocks, kinds)
        has_main = any(b[3] for b in blocks)
        chosen = [b for b in blocks if (b[2] or b[3] if has_main else lists.isdisjoint(b[1]))]
        articles = [b for b in chosen if b[2]]
        if kept[2] and articles and 2 * sum(len(b[0]) for b in articles) >= sum(len(b[0]) for b in chosen):
            chosen = articles
    used = {i for b in chosen for i in b[1]}
    content = [(b[0], b[1]) for b in chosen], [s for s in subtrees if s[0] in used]
    return content, _kept(holders, n_titles)


_OUTLINE = T.StructType([T.StructField("content", T.LongType()), T.StructField("size", T.LongType())] + [
    T.StructField(name, T.ArrayType(kind)) for name, kind in (
        ("hashes", T.LongType()), ("sizes", T.LongType()), ("kinds", T.IntegerType()), ("shingles", T.LongType()), ("weights", T.LongType()))])


def _number(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def outline_page(page: str | None) -> tuple:
    """A hash of the page's content and its characters; the distinct subtrees with theirs; two shingles of each block, weighted with its."""
    blocks, subtrees = parse_page(page)
    inside: dict[int, int] = {}
    shingles: dict[int, int] = {}
    for text, elements in blocks:
        for e in elements:
            inside[e] = inside.get(e, 0) + len(text)
        words = text.encode("utf-8", "replace").split()
        parts = [b" ".join(x) for x in zip(*(words[k:] for k in range(SHINGLE)))] or [b" ".join(words)]  # noqa: B905 - of different length
        for part in (min(parts, key=crc32), max(parts, key=crc32)):
            key = _number(part)
            shingles[key] = shingles.get(key, 0) + len(text)
    found: dict[int, list] = {}
    for e, h, kind in subtrees:
        found.setdefault(h, [0, kind])[0] += inside[e]
    content = _number("\x00".join(b[0] for b in blocks).encode("utf-8", "replace"))
    return (content, sum(len(b[0]) for b in blocks), list(found), [v[0] for v in found.values()], [v[1] for v in found.values()],
            list(shingles), list(shingles.values()))


@F.pandas_udf(_OUTLINE)
def outline(pages: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([outline_page(page) for page in pages], columns=_OUTLINE.names)


@F.pandas_udf(T.StringType())
def main_text(pages: pd.Series, templates: pd.Series) -> pd.Series:
    """The blocks that stand in no template, joined."""
    out = []
    for page, template in zip(pages, templates, strict=True):
        blocks, subtrees = parse_page(page)
        if template is not None and len(template):
            known = set(template.tolist())
            gone = {e for e, h, _ in subtrees if h in known}
            blocks = [b for b in blocks if gone.isdisjoint(b[1])]
        out.append("\n\n".join(b[0] for b in blocks))
    return pd.Series(out, dtype="object")


def site_templates(pages: DataFrame, url: str = "url", html: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE,
                   few_pages: int = FEW_PAGES, part_share: float = PART_SHARE, paragraph_share: float = PARAGRAPH_SHARE) -> DataFrame:
    """``host`` and ``hashes`` of the subtrees that recur on the host.

    A host has at most 1 / ``part_share`` times as many as its pages have subtrees
    on average, so a list does not grow with the number of pages.
    """
    outlines = materialize(pages.where(F.col(url).isNotNull()).select(url_host(F.col(url)).alias("host"), outline(F.col(html)).alias("o"))
                           .select("host", "o.*"), "outlines")
    key = ["host", "content"]
    shingles = outlines.select(*key, F.explode(F.arrays_zip("shingles", "weights")).alias("s")).select(*key, "s.*").distinct()
    alone = shingles.groupBy("host", "shingles").agg(F.min("content").alias("content"), F.max("content").alias("other"), F.sum("weights").alias("weight"))
    own = alone.where("content = other").groupBy(*key).agg(F.sum("weight").alias("own"))  # twice the characters: two shingles a block
    whole = F.array(F.struct(F.lit(None).cast("bigint").alias("hashes"), F.lit(0).cast("bigint").alias("sizes"), F.lit(FRAGMENT).alias("kinds")))  # the page itself
    rows = outlines.select(*key, "size", F.explode(F.concat(F.arrays_zip("hashes", "sizes", "kinds"), whole)).alias("s")).select(*key, "size", "s.*")
    rows = rows.distinct().join(own, key, "left")
    different = F.coalesce(F.col("own"), F.lit(0)) >= F.greatest(F.lit(1.0), 2 * OWN_SHARE * (F.col("size") - F.col("sizes")))
    counts = materialize(rows.groupBy("host", F.col("hashes").alias("hash")).agg(
        F.count(F.lit(1)).alias("n"), F.sum((different & (F.col("kinds") != FRAGMENT)).cast("bigint")).alias("d"),
        F.max("kinds").alias("kind"))  # a subtree's hash has its tag: one kind
        .where((F.col("n") >= min(min_pages, few_pages)) | F.col("hash").isNull()), "recurring")
    n, d, n_pages = F.col("n"), F.col("d"), F.col("n_pages")
    often = (n >= min_pages) & (n >= min_share * n_pages)
    share = F.when(F.col("kind") == CONTAINER, part_share).otherwise(paragraph_share)
    in_part = (d >= min_pages) & (d >= share * n_pages) & (d >= OWN_PAGES * n)
    of_few = (d >= few_pages) & (d >= min_share * n_pages)
    sites = counts.where("hash IS NULL").select("host", n.alias("n_pages"))
    found = counts.where("hash IS NOT NULL").join(sites, "host").where(often | in_part | of_few)
    return found.groupBy("host").agg(F.collect_set("hash").alias("hashes"))


def extract_text(pages: DataFrame, url: str = "url", html: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE,
                 few_pages: int = FEW_PAGES, part_share: float = PART_SHARE, paragraph_share: float = PARAGRAPH_SHARE) -> DataFrame:
    """The pages' other columns, ``text`` and ``n_chars`` (code points)."""
    host, hashes, text = (unused(pages, c) for c in ("_host", "_hashes", "_text"))
    keep = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    # written, so that the planner knows its size: most often the pages need no shuffle for it
    templates = materialize(site_templates(pages, url, html, min_pages, min_share, few_pages, part_share, paragraph_share), "site-templates")
    rows = pages.withColumn(host, F.when(F.col(url).isNotNull(), url_host(F.col(url))))
    rows = rows.join(templates.select(F.col("host").alias(host), F.col("hashes").alias(hashes)), host, "left")
    rows = rows.select(*keep, main_text(F.col(html), F.col(hashes)).alias(text))
    return rows.select(*keep, F.col(text).alias("text"), F.length(text).cast("bigint").alias("n_chars"))
