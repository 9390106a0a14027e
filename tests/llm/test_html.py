import pytest

from glyphlake.llm import html_template as H

PAGE = """<!DOCTYPE html><html lang="en"><head><title>T &amp; t</title><style>p{{}}</style><script>var t="</p><article>no";</script></head><body>
<header class="top"><p>Site header</p></header><nav><ul><li><a href="/a">Menu {0}</a></li><li>Other</ul></nav><!-- ad --><div class="ad">Buy {0}</div>
<div id="cookie-notice"><p>We use cookies.</p></div><aside><p>Aside {0}</p></aside>
<article><header><h1>Title {0}</h1></header><p><b>Bold</b>ly   written&nbsp;text &lt;{0}&gt;.<br><p>Second é &#233;.</p><div class="share-buttons">Share</div><form><p>Subscribe</p></form></article>
<section class="comments"><p>First! {0}</p></section><footer>&copy; {0}</footer></body></html>"""


def test_main_text():
    assert H.main_text(PAGE.format(7)) == "Title 7 Boldly written text <7>. Second é é."


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("just text", "just text"), ("<p>a<p>b", "a b"), ("<article><h1>A</h1><p>b &am", "A b &am"), ("<p>x</p></article></div>", "x"), ("<script>no", ""), ("<!-- never closed", ""), ("a < b <p>c", "a < b c"),
    ("<ul><li>a<li>b</ul>", "a b"), ("<table><tr><td>1<td>2</table>", "1 2"), ("<p>" + "w " * 50_000, " ".join(["w"] * 50_000)), ("<div class='ad'>x</div>y", "y"), ("<main><p>m</p></main><p>o</p>", "m"),
])
def test_pages(page, text):
    assert H.main_text(page) == text


def host_pages(n, host="h.example"):
    return [(i, f"https://{host}/{i}", f"<html><body><div class='bar'><p>Welcome to our shop</p></div><div class='body'><p>Story {i} is told here at some length.</p><p>Part two of {i}.</p></div><div class='bottom'><p>Call us</p></div></body></html>") for i in range(n)]


def test_template_text_goes(spark):
    """No element says what it is: what all pages of a host share is the template's."""
    rows = host_pages(12) + [(100, None, "<p>alone</p>"), (101, "http://other.example/", "<p>alone too</p>"), (None, "https://h.example/x", None)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, host string, own string").repartition(4)
    out = {r.page_id: r for r in H.extract(df).collect()}
    assert out[3].text == "Story 3 is told here at some length. Part two of 3." and out[3].n_chars == len(out[3].text)
    assert out[100].text == "alone" and out[101].text == "alone too" and out[None].text == ""
    template = H.templates(df).collect()
    assert [t.host for t in template] == ["h.example"] and template[0].main == "/html/body/div.body" and len(template[0].own) == 2


def test_copies_of_a_page_stay(spark):
    rows = [(i, f"https://c.example/{i}", "<article><h1>Same</h1><p>The same article on every page.</p></article>") for i in range(9)]
    out = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in out} == {"Same The same article on every page."}


def test_equal_vectors_are_a_class(spark):
    found = H.classes(spark.createDataFrame(host_pages(10), "page_id long, url string, html string")).collect()
    once = {r["class"] for r in found if r.path in ("/html", "/html/body", "/html/body/div.bar", "/html/body/div.body")}
    twice = {r["class"] for r in found if r.path == "/html/body/div.body/p"}
    assert len(once) == 1 and len(twice) == 1 and once != twice


def test_empty(spark):
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_linear():
    import time

    began = time.time()
    H.main_text("<div " * 50_000 + "<p>" * 20_000 + "\"'" * 10_000)
    assert time.time() - began < 30


def deduced(spark, pages, host="o.example"):
    """(texts, templates) of pages of one host."""
    df = spark.createDataFrame([(i, f"https://{host}/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in sorted(H.extract(df).collect(), key=lambda r: r.page_id)], H.templates(df).collect()


def test_order_makes_a_class_valid(spark):
    """Elements that swap places are no template; the same elements in one order are."""
    bar, body = "<div class='bar'><p>Welcome to our shop</p></div>", "<div class='body'><p>Story {0} is told here at length.</p></div>"
    pages = [(bar + body if i % 2 else body + bar).format(i) for i in range(10)]
    texts, found = deduced(spark, pages)
    assert all("Welcome" in t for t in texts) and [t.own for t in found] == [[]]
    texts, found = deduced(spark, [(bar + body).format(i) for i in range(10)])
    assert texts == [f"Story {i} is told here at length." for i in range(10)] and [len(t.own) for t in found] == [1]


def test_text_of_a_class_without_elements_stays(spark):
    """Nine of ten pages have the sentence, which no element's vector equals: a page's own."""
    pages = [f"<div class='bar'><p>Call us</p></div><div class='body'><p>Story {i} is told here at length.</p>{'<p>Shared by most.</p>' if i else '<p>Not by this.</p>'}</div>" for i in range(10)]
    texts, _ = deduced(spark, pages)
    assert texts[3] == "Story 3 is told here at length. Shared by most."


def test_uneven_nesting_is_no_class():
    """p and div equally often on each page, but not each p in a div of its own."""
    def seen(page):
        elements, _ = H.parse(page)
        number = {p: k for k, p in enumerate(dict.fromkeys(e.path for e in elements))}
        return set(H.places(list(number), [number[e.path] for e in elements], [], {H.key("/div"): 1, H.key("/div/p"): 1}))

    assert len(seen("<div><p>a</p></div><div><p>b</p></div>")) == 2 and len(seen("<div><p>a</p><p>b</p></div><div></div>")) > 2


def test_two_layouts_of_a_host(spark):
    """Neither layout is on most of the host's pages; each loses its own menu."""
    one = "<div class='bar'><p>Welcome to our shop</p></div><div class='body'><p>Story {0} is told here at length.</p></div>"
    two = "<section class='top'><p>All our photos</p></section><section class='film'><p>Film {0} shows much of that.</p></section>"
    texts, _ = deduced(spark, [(two if i % 2 else one).format(i) for i in range(12)])
    assert texts == [f"Film {i} shows much of that." if i % 2 else f"Story {i} is told here at length." for i in range(12)]


def test_two_pages_are_a_template(spark):
    texts, _ = deduced(spark, [f"<div class='bar'><p>Welcome</p></div><div class='body'><p>Story {i} is told here.</p></div>" for i in range(2)])
    assert texts == ["Story 0 is told here.", "Story 1 is told here."]


def test_short_and_long_articles_lose_the_same(spark):
    pages = [f"<article><p>{f'Part {i}. ' * (200 if i % 2 else 1)}</p><div class='end'><p>Read this and much more in our own application.</p></div></article>" for i in range(8)]
    texts, _ = deduced(spark, pages)
    assert texts == [" ".join(f"Part {i}." for _ in range(200 if i % 2 else 1)) for i in range(8)]


def test_shared_sentence_of_articles_stays(spark):
    texts, _ = deduced(spark, [f"<article><p>A long story number {i} that fills most of the page.</p><p>The end.</p></article>" for i in range(10)])
    assert texts == [f"A long story number {i} that fills most of the page. The end." for i in range(10)]


@pytest.mark.parametrize("page, text", [
    ("<div class='has-sidebar'><p>x</p><article><p>t</p></article></div>", "t"), ("<form><main><p>t</p></main></form>", "t"), ("<form><article><p>t</p></article></form>", "t"),
    ("<div class='search'><main><p>t</p><div class='share'>s</div></main></div>", "t"), ("<div class='comments'><article><p>c</p></article></div><p>t</p>", "t"),
    ("<aside><article><p>c</p></article></aside><p>t</p>", "t"), ("<div class='related-posts'><article><p>c</p></article></div><article><p>t</p></article>", "t"),
])
def test_articles_end_inherited_chrome(page, text):
    assert H.main_text(page) == text


def bare(page):
    """The page without classes, and with a div for each container."""
    import re

    return re.sub(r"<(/?)(article|section|nav|aside|footer|header|main)\b", r"<\1div", re.sub(r" (class|id)=('[^']*'|\"[^\"]*\")", "", page))


def test_names_blanked_out(spark):
    """Where no name tells anything, slots of valid classes alone find the same text; a page's advert may be there or not."""
    def page(i):
        advert = f"<div class='ad'>Buy number {i % 5} now</div>" if i % 3 else ""
        return (f"<nav><ul><li>Home {i}</li><li>News</li></ul></nav>{advert}<article><h1>Title {i}</h1><p>Story {i} is told here at some length, with all that was seen.</p>"
                + f"<p>More of it, part {i}.</p>" * (i % 4) + f"</article><footer>All rights of {i} are with us</footer>")

    pages = [f"<html><body>{page(i)}</body></html>" for i in range(24)]
    named, _ = deduced(spark, pages)
    blank, found = deduced(spark, [bare(p) for p in pages])
    assert named == blank and len({t.main for t in found}) == 2
    assert all(H.main_text(bare(p)) != t for p, t in zip(pages, blank))


def brute_classes(pages):
    """Tokens on most pages of a layout by their whole occurrence vectors."""
    parsed = [H.parse(p) for p in pages]
    layouts = {}
    for n, (elements, blocks) in enumerate(parsed):
        frame = tuple(sorted({e.path for e in elements if e.name in H.FRAME and e.article in (0, min(e.depth, H.DEPTH))}))
        layouts.setdefault(frame, []).append([H.key(e.path) for e in elements] + [H.key(b.path, b.text) for b in blocks if not b.chrome])
    found = set()
    for held in layouts.values():
        if len(held) < H.LEAST_PAGES:
            continue
        groups = {}
        for t in {t for tokens in held for t in tokens}:
            vector = tuple(tokens.count(t) for tokens in held)
            if sum(map(bool, vector)) >= max(H.LEAST_PAGES, -(-len(held) * int(10 * H.SUPPORT) // 10)):
                groups.setdefault(vector, set()).add(t)
        found |= {frozenset(g) for g in groups.values()}
    return found


def test_classes_against_whole_vectors(spark):
    import random

    rng = random.Random(4)
    parts = ["<div class='a'><p>Welcome</p></div>", "<div class='b'><p>x{0}</p><p>y{0}</p></div>", "<ul><li>one</li><li>two</li></ul>", "<section><h2>t{0}</h2><p>shared</p></section>", "<p>lone {0}</p>", "<div><div>deep</div></div>"]
    for k in range(3):
        pages = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 3))).format(rng.randint(0, 3)) + parts[k] for _ in range(14)]
        rows = H.classes(spark.createDataFrame([(i, "https://b.example/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")).collect()
        groups = {}
        for r in rows:
            groups.setdefault((r.layout, r["class"]), set()).add(r.token)
        assert {frozenset(g) for g in groups.values()} == brute_classes(pages)


@pytest.mark.parametrize("page, text", [
    ("<article><h2 id='social-history'>Social history</h2><p class='notice-period'>The notice period is long.</p><p>x</p></article>", "Social history The notice period is long. x"),
    ("<article><p>t</p><div class='share-buttons'>s</div><div class='related-posts'><p>r</p></div><ul class='comment-list'><li>c</ul></article>", "t"),
    ("<article><p class='search-party'>a</p><p class='reply-all-affair'>b</p><p class='promotion-of-health'>c</p></article>", "a b c"),
    ("<p title='a > b'>t", "t"), ("<p title='open>t<p>u", "t u"), ("<p class=\"x'>t</p>", "t"), ("a <b", "a <b"), ("<script/>t", "t"), ("<p>a<!x>b<?y>c", "abc"), ("x<svg><p>s</p></svg>y", "xy"),
])
def test_names_of_several_words_and_odd_tags(page, text):
    assert H.main_text(page) == text


@pytest.mark.parametrize("page", [
    "<div a='" * 130_000, "<div>" * 4000 + "</p>" * 16_000, "<div>" * 60_000, "".join(f"<div class='c{i}'>" for i in range(40_000)), "<li><x>" * 60_000, "<" * 1_000_000, "<a" * 500_000, "<!--" * 250_000,
    "<script>" * 120_000, "<div class=" * 90_000 + ">x", "<p " + "\"'" * 400_000,
])
def test_hostile_pages(page):
    import time
    import tracemalloc

    began = time.time()
    H.parse(page)
    assert time.time() - began < 6
    tracemalloc.start()
    H.parse(page)
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    del began
