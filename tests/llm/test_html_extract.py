"""Main text: single pages by hand, templates per site, defined cases."""

import random

import pytest

from spendlens.llm import html_extract as H
from spendlens.llm.html_extract import extract_text, parse_page


def text(page):
    return "\n\n".join(b for b, _ in parse_page(page)[0])


def test_page_parts():
    page = """<!DOCTYPE html><html><head><title>x</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><div class="cookie-banner">We use</div><nav>a</nav><main><article class="post"><header><h1>T &amp; U</h1></header>
<p>One
  1<p>Two <span class="ad">buy</span> end<ul><li>a<li>b</ul><table><tr><td>x<td>y</table><section id="comments"><article>c1</article></section>
<form>f</form><blockquote>q</blockquote>tail</article><aside>s</aside></main><footer>f</footer></body></html>"""
    assert text(page) == "T & U\n\nOne 1\n\nTwo end\n\na\n\nb\n\nx\n\ny\n\nq\n\ntail"


def test_open_and_cut_elements():
    assert text("<article><h1>A</h1><p><b>x<br><p>y</p>z &lt;3") == "A\n\nx\n\ny\n\nz <3"
    assert text("<article><p>a</p></arti") == "a"
    assert text("<article><p>a<a href=\"x") == "a"
    assert text("<article>a <!-- <p>b</p> --> c<!-- d") == "a c"
    assert text("<article>a<script>if (a < b) {</scrip") == "a"
    assert text("<article>5 < 6 & 7</article>") == "5 < 6 & 7"
    assert text("<ARTICLE><P HIDDEN>h</P><p style='display: none'>i</p>k</ARTICLE>") == "k"


def test_without_article():
    assert text("<main><p>a</p></main><p>b</p>") == "a"
    assert text("<body><p>a long text</p><ul><li><a href=x>link</a></li></ul></body>") == "a long text"
    assert text(None) == text("") == text("<p></p>") == ""


def test_only_lists_of_links_go():
    assert text("<h1><a href=/x>Title</a></h1><p><a href=/y>all of it a link</a></p><div><a href=z>d</a></div>") == "Title\n\nall of it a link\n\nd"
    references = "<ol><li><a href=/1>A rather long title</a> Miller 1999<li><a href=/2>Another rather long title</a> Smith</ol>"
    assert text(f"<p>a</p>{references}") == "a\n\nA rather long title Miller 1999\n\nAnother rather long title Smith"
    assert text("<p>a</p><ul><li><a href=/1>Home</a> (1)<li>Here<li><a href=/2>News</a><ul><li><a href=/3>Old</a></ul></ul><p>b</p>") == "a\n\nb"
    for anchor in ('<a name="s1">', '<a id="x"/>', '<a name=x href="/y"/>', '<p><a href="/x">', '<a data-href=x>'):
        assert text(f"<body><div>{anchor}</div><ul><li>one<li>two</ul><p>three</p></body>") == "one\n\ntwo\n\nthree"
    assert text("<body><a name=s1><ul><li>one</ul><p><a href=x>l<a name=y>three</p><ul><li>four</ul>") == "one\n\nlthree\n\nfour"


def test_words_that_remove_no_article():
    for around in ("page-with-sidebar", "layout-sidebar", "nav-layout", "ad-page"):
        assert text(f'<div>x</div><div class="{around}"><main><article><p>A</p></article><p>b</p></main></div>') == "A"
        assert text(f'<div class="{around}"><div id="skip"><article><p>A</p></article></div></div>') == "A"
    assert text('<div class="layout-sidebar">m<nav>n<article>o</article></nav></div><p>A</p>') == "A"  # gone by its kind
    assert text('<div class="masthead"><h1>T</h1></div><p>A</p><div class="masthead">m</div>') == "T\n\nA"
    assert text('<h1>S</h1><div class="masthead"><h1>T</h1></div><p>A</p>') == "S\n\nA"
    assert text('<span class="skip"><main><p>A</p></main></span>') == "A"
    assert text('<article><section id="related-work"><h2 id="sharing-data" class="share">S</h2><p>A <i class="ad">x</p></section><p id="ad-1">y') == "S\n\nA"
    # other articles, and comments that are some, go where the page has its own
    others = '<div class="related"><article>o</article></div>'
    assert text(f'<article>A</article>{others}') == text(f'<main>A</main>{others}') == text(f'<div class="ads-page"><article>A</article>{others}</div>') == "A"
    assert text('<article>A</article><div class="share-page"><article>B</article></div>') == "A\n\nB"
    # without one nothing of the page is lost for them
    assert text(f'<p>A long text</p>{others}') == "A long text\n\no"
    assert text('<p>A long text</p><div class="sidebar"><article>s</article></div>') == "A long text\n\ns"


def test_site_templates(spark):
    rows = []
    for i in range(12):
        rows.append((i, f"http://A.com/{i}", f"<article><p>own {i}</p><div>read us daily</div></article>", "t", 1))
        rows.append((100 + i, f"http://b.com/{i}", "<article><p>copied page</p><p>x</p></article>", "t", 1))
    rows += [(200, None, "<article>n</article>", "t", 1), (None, "http://a.com/", None, None, None), (201, "none", "", "t", 1), (201, "none", "", "t", 1),
             (202, "http://c.com/", "<article>" + "w " * 50_000 + "</article>", "t", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, _uid int").repartition(3)
    out = extract_text(pages).collect()
    assert sorted(out[0].asDict()) == ["_uid", "n_chars", "page_id", "text", "url"] and len(out) == len(rows)
    got = {r.page_id: r.text for r in out}
    assert all(got[i] == f"own {i}" for i in range(12))  # in many different pages of the site
    assert all(got[100 + i] == "copied page\n\nx" for i in range(12))  # copies are one page
    assert (got[200], got[None], got[201]) == ("n", "", "") and len(got[202]) == 99_999
    assert all(r.n_chars == len(r.text) for r in out)
    assert extract_text(pages.limit(0)).count() == 0


def test_templates_of_a_part_and_of_small_sites(spark):
    rows = []
    for i in range(100):  # a notice on 30 % of a host's pages, a heading and an item too
        notice = "<div>Lesen Sie uns</div><p>every day</p><h2>Intro</h2><ul><li>yes<li>row " + f"{i}</ul>" if i % 10 < 3 else ""
        rows.append((i, f"http://big.com/{i}", f"<article><p>own {i}</p>{notice}</article>"))
    for i in range(5):
        rows.append((200 + i, f"http://small.com/{i}", f"<article><p>own {i}</p><div>read us</div></article>"))
    base = [" ".join(f"w{k}x{j}" for j in range(60)) for k in range(8)]
    for i in range(40):  # edited copies of an article, each in three of its paragraphs, beside other articles
        copy = [p.replace(f"x{(7 * i + k) % 50} ", f"x{i}new ") if (i + k) % 8 < 3 else p for k, p in enumerate(base)]
        rows.append((300 + i, f"http://copies.com/{i}", "<article>" + "".join(f"<p>{p}</p>" for p in copy) + "</article>"))
        rows += [(400 + 60 * m + i, f"http://copies.com/{m}/{i}", f"<article><p>other {i} {m}</p></article>") for m in range(2)]
    got = {r.page_id: r for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert all(got[i].text == (f"own {i}\n\nIntro\n\nyes\n\nrow {i}" if i % 10 < 3 else f"own {i}") for i in range(100))
    assert all(got[200 + i].text == f"own {i}" for i in range(5))
    assert all(got[300 + i].text.count("\n\n") == 7 for i in range(40))


def test_class_words_inside_an_article():
    kept = ['<section class="related-work">', '<blockquote class="social">', '<p class="search results">', '<div class="comment-on-the-text">', '<p class="tags">']
    for tag in kept:
        assert text(f"<article><p>a</p>{tag}b</{tag[1:].split()[0]}><p>c</p></article>") == "a\n\nb\n\nc", tag
    gone = ['<ul class="menu">', '<div class="ad-box">', '<div class="ads">', '<section class="related articles">', '<div class="share-buttons">', '<p class="cookie-notice">',
            '<div class="newsletter-signup">', '<div class="notice">']
    for tag in gone:
        assert text(f"<article><p>a</p>{tag}b</{tag[1:].split()[0]}><p>c</p></article>") == "a\n\nc", tag


def test_formulas_and_inline_controls():
    assert text("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> hold</p></article>") == "Let x=2 hold"
    assert text("<article><p>one <select><option>a<option selected>b</select> two <input value=v> three <legend>l</legend> four</p></article>") == "one two three four"
    assert text("<article><p>one <select><optgroup label=g><option>a</option></optgroup></select> two</p><p>x <option>o</option> y</p></article>") == "one two\n\nx y"
    assert text("<article><p>one <select><option>a<p>two</article>") == "one\n\ntwo"


def plain_templates(pages):
    """Hosts' templates by the rules of the module, counted page by page."""
    sites = {}
    for url, html in pages:
        host = url.split("://")[1].split("/")[0]
        blocks, subtrees = parse_page(html)
        sites.setdefault(host, {})["\0".join(b for b, _ in blocks)] = (blocks, subtrees)  # pages of equal content once
    out = {}
    for host, found in sites.items():
        shingled = {}
        for content, (blocks, _) in found.items():
            weights = {}
            for b, _ in blocks:
                for part in shingles(b):
                    weights[part] = weights.get(part, 0) + len(b)
            shingled[content] = weights
        stands = {}
        for weights in shingled.values():
            for part in weights:
                stands[part] = stands.get(part, 0) + 1
        n, d, kinds = {}, {}, {}
        for content, (blocks, subtrees) in found.items():
            own = sum(w for part, w in shingled[content].items() if stands[part] == 1)
            total = sum(len(b) for b, _ in blocks)
            size = {}
            for e, h, kind in subtrees:
                size[h] = size.get(h, 0) + sum(len(b) for b, inside in blocks if e in inside)
                kinds[h] = kind
            for h, s in size.items():
                n[h] = n.get(h, 0) + 1
                d[h] = d.get(h, 0) + (kinds[h] != H.FRAGMENT and own >= max(1, 2 * H.OWN_SHARE * (total - s)))
        many = len(found)
        part = {h: H.PART_SHARE if kinds[h] == H.CONTAINER else H.PARAGRAPH_SHARE for h in n}
        hit = {h for h in n if n[h] >= 10 and n[h] >= many / 2 or d[h] >= 10 and d[h] >= part[h] * many and d[h] >= H.OWN_PAGES * n[h] or d[h] >= 3 and d[h] >= many / 2}
        if hit:
            out[host] = hit
    return out


def shingles(block):
    words = block.encode().split()
    parts = [b" ".join(words[k:k + H.SHINGLE]) for k in range(len(words) - H.SHINGLE + 1)] or [b" ".join(words)]
    return min(parts, key=H.crc32), max(parts, key=H.crc32)


@pytest.mark.parametrize("seed", [1, 2])
def test_templates_against_a_plain_count(spark, seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    prose = lambda n: " ".join(word() for _ in range(n))
    pages = []
    for host, n_pages in (("a.org", 60), ("b.org", 25), ("c.org", 7), ("d.org", 3)):
        parts = [(f"<{tag}><p>{prose(6)}</p></{tag}>", rnd.random()) for tag in ("div", "section", "ul", "blockquote") for _ in range(3)]
        parts += [(f"<{tag}>{prose(5)}</{tag}>", rnd.random()) for tag in ("p", "p", "p", "h2", "li")]
        stock = [prose(12) for _ in range(5)]
        for k in range(n_pages):
            body = [f"<p>{rnd.choice(stock) if rnd.random() < 0.2 else prose(rnd.randint(1, 25))}</p>" for _ in range(rnd.randint(0, 4))]
            body += [part for part, often in parts if rnd.random() < often * rnd.choice([0.2, 1])]
            rnd.shuffle(body)
            page = "".join(body)
            pages += [(f"http://{host}/{k}", f"<article>{page}</article>")] * rnd.choice([1, 1, 2])
    df = spark.createDataFrame(pages, "url string, html string").repartition(3)
    assert {r.host: set(r.hashes) for r in H.site_templates(df).collect()} == plain_templates(pages)


def test_a_paragraph_of_a_twentieth_of_the_pages_stays(spark):
    """A container on a tenth of a host's pages is a template, a paragraph only from a quarter on."""
    rnd = random.Random(3)
    prose = lambda: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(30))
    pages = []
    for k in range(200):
        box = "<div><p>In a box.</p></div>" if k % 10 == 0 else ""
        closing = "<p>Closing words.</p>" if k % 10 == 1 else ""
        often = "<p>On many pages.</p>" if k % 10 < 3 else ""
        pages.append((k, f"http://x.org/{k}", f"<article><p>{prose()}</p>{box}{closing}{often}</article>"))
    got = {r.k: r.text for r in extract_text(spark.createDataFrame(pages, "k long, url string, html string")).collect()}
    assert all("In a box" not in t and "On many" not in t for t in got.values())
    assert sum("Closing words." in t for t in got.values()) == 20
