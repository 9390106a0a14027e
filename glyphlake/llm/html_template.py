"""Main text of web pages by equivalence classes of page tokens.

Tokens are a page's elements, told apart by their path of block elements with class and id, and its text blocks by path and content.  Pages of a
host with the same frame of containers are a layout; a token's occurrence vector is its count in each page of the same layout, and tokens with equal
vectors form a class.  Vectors may be as long as a host has pages, so they are kept as sums of page hashes weighted by counts, which Spark adds up
before it shuffles, and equal sums mean equal vectors.

A class on most of a layout's pages is valid if its elements come in one cyclic order at each of their occurrences; a text of the class
belongs to it if it always follows the same one of these.  So elements that swap places, or nest now and now not, are no template.  What is
between a valid class's elements are slots, named by the element they lie in.  Valid classes' texts are the template's own, with two exceptions: in an
article only slots without any other text are, and a layout without any other text has none of its own.

Slots whose elements' names say that they are menus, headers, footers, sidebars, notices, adverts, forms or comments are no text.  Of the others, the
deepest that holds most of the layout's text is its main slot; a page's text is what its main slot holds, in its articles if it has any, without the
template's own text.  Where a layout has no template, the page's articles are taken, or all that is left.

Elements without class and id are told apart by their place among their equals, so a template is found in bare markup as well.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections.abc import Iterable
from urllib.parse import urlsplit

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, prepare, task_base, written

#: A class is part of the template if it is on this share of a layout's pages, of which there are at least LEAST_PAGES.
SUPPORT, LEAST_PAGES = 0.8, 2
#: A slot that holds this share of a host's text outside of menus and the like is the main one where no article is marked.
MAIN_SHARE = 0.6

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements within a block; all others begin and end one.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Elements whose content is not markup, or never text of the page.
RAW = "script|style|noscript|template|textarea|iframe|title|svg|math|object|select|noframes|xmp"
DROPPED = frozenset("head nav aside footer form button dialog menu fieldset canvas audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar toolbar form".split())
CHROME = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup login sidebar side aside rail menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar comment comments disqus reply replies respond related recommended "
    "share sharing social widget widgets toolbar pagination pager skip search form".split())
#: Parts of names that say nothing of what is inside: related-posts is a menu by its first part, social-history is none.
PLAIN = frozenset(
    "area articles bar block body bottom box btn button buttons center col column container content entry footer form group head header icon icons inner input item items label large left link links list "
    "main medium message module more news nav outer page panel post posts right row section site small stories story text title top up unit view wrap wrapper js is has no the on in to at us".split())
#: Block levels that a path tells; deeper elements have the path of the last one.  Places among equals, and characters of a class and id, that it tells.
DEPTH, SIBLINGS, MARK = 40, 4, 200
CONTAINERS = frozenset("body div section article main td".split())
#: Elements that make a page's layout, outside of articles.
FRAME = frozenset("html body div section article main nav header footer aside form".split())
#: Words of wrappers whose articles are no main text.
TEASERS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion comment comments disqus reply replies respond related recommended widget widgets".split())
CLOSED_BY = {"p": frozenset("address article aside blockquote details div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()), "li": frozenset(["li"]),
             "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}

TAG = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW.split("|")}
STOPS = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Names of wrappers that tell of a part of the page, not of themselves.
WRAPPER = re.compile(r" (?:has|with|no|is)-\S+ ")
NUMBER = re.compile(r"[0-9]+")


class Element:
    __slots__ = ("name", "path", "chrome", "article", "depth", "children")

    def __init__(self, name: str, parent: Element | None, attributes: str):
        found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)} if attributes and "=" in attributes else {}
        mark = ".".join(sorted(found.get("class", "").split())) + ("#" + found["id"] if "id" in found else "")
        if name in ("html", "body"):  # there is one, and its classes often name the page
            mark = ""
        if len(mark) > MARK:
            mark = hashlib.blake2b(mark.encode("utf-8", "replace"), digest_size=8).hexdigest()
        self.name, self.children = name, {}
        self.depth = parent.depth + 1 if parent else 1
        part = f"{name}{'.' + NUMBER.sub('0', mark) if mark else ''}"
        if parent is not None and not mark and name in FRAME and name != "body":
            before = parent.children[name] = parent.children.get(name, 0) + 1
            part += f"[{min(before, SIBLINGS)}]" if before > 1 else ""
        self.path = f"{parent.path if parent else ''}/{part}" if self.depth <= DEPTH else parent.path
        inside = parent is not None and parent.article > 0
        begins = name in ("article", "main") or found.get("role") in ("main", "article")
        #: Depth of the outermost article or main element, or 0.
        self.article = parent.article if inside else min(self.depth, DEPTH) if begins else 0
        # a name says what is inside if all its parts do, or say nothing; outside of articles one part of it is a weak sign
        sure = weak = False
        for word in (w for key in ("class", "id") for w in found.get(key, "").split()):
            parts = {p.lower() for p in PART.findall(word)}
            said = (parts & CHROME) - ({"header"} if self.article else set())  # an article's own header, with its title, is text
            sure = sure or (bool(said) and (parts <= CHROME | PLAIN or bool(said & TEASERS and not inside)))
            weak = weak or (bool(said) and not inside)
        # 2 if an article can't end it, 1 if it is a whole-page form or a word of a compound such as has-sidebar
        own = 0
        if name in DROPPED or (name == "header" and not inside) or found.get("role") in ROLES:
            own = 1 if name == "form" and found.get("role") not in ROLES else 2
        if name not in ("html", "body", "article", "main"):
            own = max(own, 2 if sure and not WRAPPER.search(f" {found.get('class', '')} {found.get('id', '')} ") else 1 if sure or weak else 0)
        inherited = parent.chrome if parent else 0
        if begins and not inside and (inherited == 1 or name == "main" or found.get("role") == "main"):
            inherited = 0
        self.chrome = max(own, inherited)


class Block:
    __slots__ = ("path", "text", "chrome", "article", "after")

    def __init__(self, element: Element | None, text: str):
        self.path, self.text = (element.path if element else ""), text
        self.chrome, self.article = (element.chrome, element.article) if element else (0, 0)


def tags(page: str) -> Iterable[tuple[int, int, str, bool, str]]:
    """(start, end, name, whether it closes, attributes) of a page's tags; comments, declarations and raw elements have the name ''.

    Each character is looked at a bounded number of times.  A quote that is never closed is a character; a tag that never ends because of its quotes
    makes quotes characters from there on; one that never ends at all is text.  What is not closed of comments and raw elements reaches to the end.
    """
    at, quotes = 0, {'"': True, "'": True}
    while m := TAG.search(page, at):
        start = m.start()
        if m[1]:
            end = page.find("-->", m.end())
            at = len(page) if end < 0 else end + 3
            yield start, at, "", False, ""
            continue
        end = -1
        if not m[2]:
            k = m.end()
            while stop := STOPS.search(page, k):
                k = stop.end()
                if stop[0] == ">":
                    end = stop.start()
                    break
                if quotes[stop[0]]:
                    close = page.find(stop[0], k)
                    if close < 0:
                        quotes[stop[0]] = False
                    else:
                        k = close + 1
            else:
                quotes = dict.fromkeys(quotes, False)
        if end < 0:
            end = page.find(">", m.end())
            if end < 0:
                return
        name, attributes = (m[4] or "").lower(), page[m.end() : end]
        at = end + 1
        if name in RAW_END and not m[3] and not attributes.endswith("/"):
            close = RAW_END[name].search(page, at)
            at, name = close.end() if close else len(page), ""
        yield start, at, name, bool(m[3]), attributes


def parse(page: str) -> tuple[list[Element], list[Block]]:
    """Block elements and text blocks, each in page order.  Never fails: unclosed and misplaced tags close where the next block says so.

    Time and memory grow with the page, however tags are nested, unclosed or unmatched.
    """
    stack: list[Element] = []
    opened: dict[str, int] = {}
    elements: list[Element] = []
    blocks: list[Block] = []
    held: list[str] = []

    def flush():
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                blocks.append(Block(stack[-1] if stack else None, text))
                blocks[-1].after = len(elements)
            held.clear()

    def close(k: int):
        for e in stack[k:]:
            opened[e.name] -= 1
        del stack[k:]

    at = 0
    for start, end, name, closes, attributes in tags(page):
        if start > at:
            held.append(page[at:start])
        at = end
        if not name or name in INLINE or name == "wbr":
            continue
        flush()
        if closes:
            if opened.get(name):
                k = len(stack) - 1
                while stack[k].name != name:
                    k -= 1
                close(k)
        elif name not in VOID:
            for k in range(len(stack) - 1, max(-1, len(stack) - 1 - DEPTH), -1):
                if name in CLOSED_BY.get(stack[k].name, ()):
                    close(k)
                    break
                if stack[k].name in ("ul", "ol", "table", "div", "section", "article"):
                    break
            element = Element(name, stack[-1] if stack else None, attributes)
            elements.append(element)
            if not attributes.endswith("/"):
                stack.append(element)
                opened[name] = opened.get(name, 0) + 1
    if at < len(page):
        held.append(page[at:])
    flush()
    return elements, blocks


def key(path: str, text: str | None = None) -> int:
    return int.from_bytes(hashlib.blake2b(path.encode("utf-8", "replace") if text is None else f"{path}\n{text}".encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def host_of(url: str | None) -> str:
    try:
        return (urlsplit((url or "").strip()).hostname or "").lower()
    except ValueError:
        return ""


PARSED = "page_id long, url string, host string, layout long, parsed binary"


def _parsed(batches):
    """(page_id, url, page) with host, layout and the parsed page: distinct paths, elements as places in these, text blocks."""
    z = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        hosts, layouts, packed = [], [], []
        for url, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            elements, blocks = parse(page or "")
            number: dict[str, int] = {}
            order = [number.setdefault(e.path, len(number)) for e in elements]
            frame = {e.path for e in elements if e.name in FRAME and e.article in (0, min(e.depth, DEPTH))}
            hosts.append(host_of(url))
            layouts.append(key("\n".join(sorted(frame))))
            texts = [(number.setdefault(b.path, len(number)), b.text, b.article, b.after) for b in blocks if not b.chrome]
            packed.append(z.compress(json.dumps((list(number), order, texts)).encode()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(hosts, pa.string()), pa.array(layouts, pa.int64()), pa.array(packed, pa.binary())], names=["page_id", "url", "host", "layout", "parsed"])


def parsed_pages(df: DataFrame, row_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Each page parsed once, written for the passes over it."""
    prepare(df.sparkSession)
    source = df.select(F.col(row_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).alias("page"))
    return written(source.mapInArrow(lean(_parsed), PARSED), "pages", "none")[0]


def _unpacked(column: pa.Array) -> Iterable[tuple[list[str], list[int], list[list]]]:
    z = zstandard.ZstdDecompressor()
    for p in column:
        yield json.loads(z.decompress(p.as_buffer()))


TOKENS = "host string, layout long, token long, path string, within long, article long, length long, sum1 long, sum2 long, pages long, total long, most long, chars long"


def _tokens(batches):
    """(host, layout, parsed) to sums over the pages of a batch for each host, layout and token; the path '' stands for the page itself."""
    row = task_base()
    for batch in batches:
        sums: dict[tuple[str, int, int], list] = {}
        for host, layout, (paths, order, texts) in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _unpacked(batch.column(2))):
            row += 1
            d = hashlib.blake2b(row.to_bytes(8, "big"), digest_size=8).digest()
            one, two = int.from_bytes(d[:4], "big") >> 2, int.from_bytes(d[4:], "big") >> 2
            keys = [key(p) for p in paths]
            found: dict[int, list] = {0: ["", None, 0, 0, 1, 0]}
            for k in order:
                found.setdefault(keys[k], [paths[k], None, 0, 0, 0, 0])[4] += 1
            for k, text, article, _ in texts:
                found.setdefault(key(paths[k], text), [None, keys[k], article, len(text), 0, 0])[4] += 1
                found[0][5] += len(text)
                at = paths[k]
                while at:
                    if f := found.get(key(at) if at != paths[k] else keys[k]):
                        f[5] += len(text)
                    at = at.rpartition("/")[0]
            for token, (path, within, article, length, n, chars) in found.items():
                s = sums.setdefault((host, layout, token), [host, layout, token, path, within, article, length, 0, 0, 0, 0, 0, 0])
                for k, v in enumerate((n * one, n * two, 1, n)):
                    s[7 + k] += v
                s[11] = max(s[11], n)
                s[12] += chars
        if sums:
            columns = list(zip(*sums.values()))
            names = [f.split()[0] for f in TOKENS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k in (0, 3) else pa.int64()) for k, c in enumerate(columns)], names=names)


def classes(df: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """The tokens that may be a template's: host, layout, class, token, path (null for text), pages, total, most, chars and others.

    `class` names tokens of a layout with equal occurrence vectors.  Only tokens on SUPPORT of at least LEAST_PAGES pages are kept, so a
    layout has at most 1 / SUPPORT times as many as a page has on average.
    """
    return _classes(parsed_pages(df.withColumn("__none", F.lit(None)), "__none", url, page))


def _classes(pages: DataFrame) -> DataFrame:
    grouped = pages.where("host <> ''").select("host", "layout", "parsed").mapInArrow(lean(_tokens), TOKENS).groupBy("host", "layout", "token").agg(
        *(F.min(c).alias(c) for c in ("path", "within", "article", "length")), *(F.sum(c).alias(c) for c in ("sum1", "sum2", "pages", "total")), F.max("most").alias("most"), F.sum("chars").alias("chars"))
    grouped, _ = written(grouped.where(f"pages >= {LEAST_PAGES}"), "tokens", narrow=True)
    whole = grouped.where("token = 0").select("host", "layout", F.col("pages").alias("layout_pages"), F.col("chars").alias("layout_chars"))
    kept = grouped.where("token <> 0").join(whole, ["host", "layout"]).where(F.col("pages") >= F.ceil(SUPPORT * F.col("layout_pages")))
    return kept.select(
        "host", "layout", F.xxhash64("sum1", "sum2", "pages", "total").alias("class"), "token", "path", "within", "article", "length", "pages", "total", "most", "chars", "layout_pages", "layout_chars")


PLACES = "host string, layout long, token long, first long, last long"


def places(paths: list[str], order: list[int], texts: list[list], class_of: dict[int, int]) -> Iterable[tuple[int, int]]:
    """(token, place) for each occurrence of a class's token on a page.

    The place is the element of its class before it, for the first one the last, and whether the token itself is the first.
    """
    keys = [key(p) for p in paths]
    events = [(k, -1, keys[p], True) for k, p in enumerate(order)] + [(after - 1, n, key(paths[p], text), False) for n, (p, text, _, after) in enumerate(texts)]
    last = {class_of[keys[p]]: keys[p] for p in order if keys[p] in class_of}
    heads = {keys[p] for p in {class_of[keys[p]]: p for p in reversed(order) if keys[p] in class_of}.values()}
    for _, _, token, element in sorted(events):
        c = class_of.get(token)
        if c is not None:
            yield token, last.get(c, 0) ^ (token in heads)
            if element:
                last[c] = token


def _places(batches):
    """(host, layout, parsed, tokens) to the least and greatest place of each token over the pages of a batch."""
    for batch in batches:
        found: dict[tuple[str, int, int], list] = {}
        known: dict[tuple[str, int], dict[int, int]] = {}
        listed = batch.column(3)
        for i, (host, layout, (paths, order, texts)) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _unpacked(batch.column(2)))):
            if (host, layout) not in known:
                known[host, layout] = {t["token"]: t["class"] for t in listed[i].as_py()}
            for token, place in places(paths, order, texts, known[host, layout]):
                f = found.setdefault((host, layout, token), [host, layout, token, place, place])
                f[3], f[4] = min(f[3], place), max(f[4], place)
        if found:
            columns = list(zip(*found.values()))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k else pa.string()) for k, c in enumerate(columns)], names=["host", "layout", "token", "first", "last"])


def templates(df: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """One row for each layout with a template: host, layout, own (tokens of its own text), main (path of its main slot or null), classes (JSON).

    `classes` is the nested template: for each valid class its element paths, how often it occurs, and the element that holds it.
    """
    return _templates(parsed_pages(df.withColumn("__none", F.lit(None)), "__none", url, page))


def _templates(pages: DataFrame) -> DataFrame:
    found, _ = written(_classes(pages), "classes", narrow=True)
    listed = found.groupBy("host", "layout").agg(F.collect_list(F.struct("token", "class")).alias("tokens"))
    placed = pages.where("host <> ''").join(listed, ["host", "layout"]).select("host", "layout", "parsed", "tokens").mapInArrow(lean(_places), PLACES)
    placed = placed.groupBy("host", "layout", "token").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    ordered = found.join(placed.select("host", "layout", "token", (F.col("first") == F.col("last")).alias("ordered")), ["host", "layout", "token"])
    fields = ("path", "class", "token", "within", "article", "length", "pages", "total", "most", "chars", "layout_chars", "ordered")
    rows = ordered.groupBy("host", "layout").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("tokens"))

    def run(batches):
        for batch in batches:
            made = [(host, layout, *template(tokens)) for host, layout, tokens in zip(*(batch.column(k).to_pylist() for k in range(3)))]
            kinds = (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds)], names=["host", "layout", "own", "main", "classes"])

    return rows.mapInArrow(lean(run), "host string, layout long, own array<long>, main string, classes string")


def _container(path: str) -> bool:
    return re.split(r"[.#\[]", path.rsplit("/", 1)[-1], maxsplit=1)[0] in CONTAINERS


def template(tokens: list[dict]) -> tuple[list[int], str | None, str]:
    """(own, main, classes) of a layout from its tokens."""
    groups: dict[int, list[dict]] = {}
    for t in tokens:
        groups.setdefault(t["class"], []).append(t)
    valid = {c: g for c, g in groups.items() if _nests(g)}
    path_of = {t["token"]: t["path"] for t in tokens if t["path"]}  # a text's element is on the pages that have the text
    # a text of a class without elements is a page's own
    texts = [t for g in valid.values() if any(x["path"] for x in g) for t in g if t["path"] is None and t["ordered"]]
    # slots: the elements that each page has once, with the text in them that is not the template's
    slots = {t["path"]: t for g in valid.values() for t in g if t["path"] and t["most"] == 1}
    outer = sorted(slots, key=len)
    other = {path: e["chars"] for path, e in slots.items()}
    at_of = {}
    for t in texts:
        at = at_of[t["token"]] = path_of.get(t["within"], "")
        while at:
            if at in other:
                other[at] -= t["length"] * t["total"]
            at = at.rpartition("/")[0]
    left = tokens[0]["layout_chars"] - sum(t["length"] * t["total"] for t in texts)
    own = []
    for t in texts:
        at = at_of[t["token"]]
        if t["article"]:
            while at.count("/") > t["article"] and not (_container(at) and at in other):
                at = at.rpartition("/")[0]
            if at.count("/") <= t["article"] or other[at] > 0 or not any(o > 0 for p, o in other.items() if p.count("/") == t["article"] and at.startswith(p + "/")):
                continue
        if left > 0:
            own.append(t["token"])
    main = None
    total = max(1, left if left > 0 else tokens[0]["layout_chars"])
    for path in outer:  # the deepest slot that holds most text; elements nest, so there is one line of them
        if _container(path) and (other[path] if left > 0 else slots[path]["chars"]) >= MAIN_SHARE * total:
            main = path
    tree = []
    for g in valid.values():
        paths = [t["path"] for t in g if t["path"]]
        if paths:
            top = min(paths, key=len)
            holder = next((p for p in reversed(outer) if top.startswith(p + "/")), None)
            tree.append({"paths": sorted(paths), "pages": g[0]["pages"], "total": g[0]["total"], "in": holder})
    return own, main, json.dumps(tree)


def _nests(group: list[dict]) -> bool:
    """A class is valid if each of its elements always follows the same other one, around the circle."""
    return all(t["ordered"] for t in group if t["path"])


def chosen(blocks: Iterable[tuple[str, str, int]], own: frozenset[int] = frozenset(), main: str | None = None) -> str:
    """The main text from (path, text, article) of the blocks that are no menu and the like, given the layout's template."""
    left = list(blocks)
    if main:
        left = [b for b in left if b[0] == main or b[0].startswith(main + "/")] or left
    left = [b for b in left if b[2]] or left
    return " ".join(text for path, text, _ in left if not own or key(path, text) not in own)


def main_text(page: str | None, own: frozenset[int] = frozenset(), main: str | None = None) -> str:
    """The main text of a page, given its layout's template."""
    return chosen(((b.path, b.text, b.article) for b in parse(page or "")[1] if not b.chrome), own, main)


def extract(df: DataFrame, row_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each row; null and empty pages have the text ''.

    Repeated rows get the same text, an empty table gives an empty result, and hostile or very long pages take time and memory in proportion.  Ids may repeat or be null; pages whose url is null or has no host are read without a template.  Parsed pages and templates are written first: small
    templates are broadcast under Spark's own size limit, large ones joined by layout, where Spark splits a layout that has many of the pages.
    """
    pages = parsed_pages(df, row_id, url, page)
    known, _ = written(_templates(pages), "templates", narrow=True)
    joined = pages.join(known.select("host", "layout", "own", "main"), ["host", "layout"], "left").select("page_id", "url", "parsed", "own", "main")

    def run(batches):
        sets: dict[tuple, frozenset] = {}
        for batch in batches:
            texts = []
            for (paths, _, blocks), own, main in zip(_unpacked(batch.column(2)), *(batch.column(k).to_pylist() for k in (3, 4))):
                own = tuple(own or ())
                if own not in sets:
                    if len(sets) > 1000:
                        sets.clear()
                    sets[own] = frozenset(own)
                texts.append(chosen(((paths[k], text, article) for k, text, article, _ in blocks), sets[own], main))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(lean(run), "page_id long, url string, text string, n_chars long")
