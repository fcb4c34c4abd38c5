"""Pages: one scan in linear time, content parts and scores against plain versions, answers of providers."""

import html.parser
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from atomloom.functions import pages, text
from atomloom.sources import providers

SIZE = 1 << 20
ODD = ["<script>", "<!--", '<div class="content ', '<div class="', "<", "<div>", "<a", "<title>", "</div>", "<nav>", "<article>", "<p", "<div class='content content", "<div><a href='x'>", "<h2>", "<body>", "&amp;", "<li class=\"b_algo\">", "<div class=\"result\"><a class=\"result__a\" href=\"", "<!-- -->", "<script></script"]


@pytest.mark.parametrize("piece", ODD)
def test_a_megabyte_takes_less_than_two_seconds(piece):
    page = piece * (SIZE // len(piece))
    began = time.process_time()
    read = pages.Page(page)
    assert isinstance(read.lines(), str) and isinstance(read.title(), str)
    assert time.process_time() - began < 2


def test_odd_answers_take_time_in_proportion(spark):
    parsers = [providers.list_items, providers.result_blocks, providers.redirect_links]
    rows = spark.createDataFrame([(p * (SIZE // 4 // len(p)),) for p in ODD], "body string").repartition(4)
    began = time.time()
    assert rows.select(*[F.size(f(F.col("body"))).alias(f.__name__) for f in parsers]).count() == len(ODD)
    rows.select(*[F.size(f(F.col("body"))).alias(f.__name__) for f in parsers]).collect()
    assert time.time() - began < 60


class Tree(html.parser.HTMLParser):
    """A tree of elements by the standard library's parser: [name, attributes, children], texts as strings."""

    def __init__(self, page):
        super().__init__(convert_charrefs=False)
        self.root = ["", {}, []]
        self.path = [self.root]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = [tag, dict(attrs), []]
        self.path[-1][2].append(node)
        if tag not in ("br", "hr", "meta", "link", "img", "input"):
            self.path.append(node)

    def handle_endtag(self, tag):
        if any(n[0] == tag for n in self.path[1:]):
            while self.path.pop()[0] != tag:
                pass

    def handle_data(self, data):
        self.path[-1][2].append(data)

    def handle_entityref(self, name):
        self.path[-1][2].append(f"&{name};")

    def handle_charref(self, name):
        self.path[-1][2].append(f"&#{name};")


def walk(node, path=()):
    for child in node[2]:
        if isinstance(child, str):
            yield child, path
        elif child[0] not in pages.NOISE:
            yield child, path
            yield from walk(child, (*path, child))


def plain_lines(page):
    """The content by trying every element, with sums over all texts for each."""
    root = Tree(page).root
    nodes = [n for n, _ in walk(root) if not isinstance(n, str)]
    parts = [next((n for n in nodes if n[0] == tag and (tag != "div" or re.search("content|article|post", n[1].get("class") or "", re.I))), None) for tag in ("article", "main", "div")]
    chosen = next((n for n in parts if n is not None and n[2]), None)
    if chosen is None:
        points, texts = {}, {}
        # units: texts in a row without a block element between them
        units, now = [], []
        flat = []

        def lay(node, path):
            for child in node[2]:
                if isinstance(child, str):
                    flat.append((child, path))
                elif child[0] not in pages.NOISE:
                    flat.append((None if child[0] in pages.BREAKS else "", path))
                    lay(child, (*path, child))
                    flat.append((None if child[0] in pages.BREAKS else "", path))
        lay(root, ())
        for piece, path in [*flat, (None, ())]:
            if piece is None:
                units.append(now)
                now = []
            else:
                now.append((piece, path))
        for unit in units:
            size = sum(len(t.strip()) for t, _ in unit)
            linked = sum(len(t.strip()) for t, path in unit if any(n[0] == "a" for n in path))
            if not size:
                continue
            holders = [n for n in unit[0][1] if n[0] in pages.HOLDERS][::-1][:2]
            for n in (n for n in unit[0][1] if n[0] in pages.HOLDERS):
                s = texts.setdefault(id(n), [0, 0])
                s[0] += size
                s[1] += linked
            if size - linked >= pages.LEAST and 2 * linked <= size:
                worth = 1 + sum(t.count(",") for t, _ in unit) + min((size - linked) // 100, 3)
                for n, share in zip(holders, (1, 0.5), strict=False):
                    points[id(n)] = points.get(id(n), 0) + share * worth
        best = -1
        for n in nodes:
            if id(n) in points and points[id(n)] * (1 - texts[id(n)][1] / texts[id(n)][0]) > best + 1e-12:
                chosen, best = n, points[id(n)] * (1 - texts[id(n)][1] / texts[id(n)][0])
    if chosen is None:
        chosen = next((n for n in nodes if n[0] == "body"), ["", {}, []])
    out = "\n".join(t if isinstance(t, str) else "\n" for t in _texts(chosen))
    for entity, sign in pages.ENTITIES:
        out = out.replace(entity, sign)
    return [x for line in out.split("\n") if (x := line.strip(" \t\n\r\x0b\f"))]


def _texts(node):
    whole = []
    for child in node[2]:
        if isinstance(child, str):
            if whole and isinstance(whole[-1], str) and (child.startswith("&") or whole[-1].endswith(";")):
                whole[-1] += child  # entities don't part texts
            else:
                whole.append(child)
        elif child[0] not in pages.NOISE:
            whole += [None, *_texts(child), None]
        else:
            whole.append(None)
    return whole


def built(rng, depth=0):
    """A well nested page body, with links, noise and blocks."""
    out = []
    for _ in range(rng.randrange(1, 5)):
        words = ", ".join("word" * rng.randrange(1, 3) for _ in range(rng.randrange(1, 12)))
        kind = rng.randrange(8)
        if kind < 3 or depth > 4:
            out.append(f"<p>{words}</p>")
        elif kind == 3:
            out.append(f"<a href='x'>{words}</a> {words[:9]}")
        elif kind == 4:
            out.append(f"<{(t := rng.choice(pages.NOISE))}>{words}</{t}>")
        else:
            tag = rng.choice(["div", "section", "td", "span", "div class='side'"])
            out.append(f"<{tag}>{built(rng, depth + 1)}</{tag.split()[0]}>")
    return "".join(out)


def test_scores_are_those_of_trying_every_element():
    rng = random.Random(6)
    chosen = 0
    for _ in range(400):
        page = f"<html><body>{built(rng)}</body></html>"
        read = pages.Page(page)
        chosen += read.part() is None and read.best() is not None
        assert read.lines().split("\n") == (plain_lines(page) or [""])
    assert chosen > 300


def test_content_without_a_named_part(spark):
    menu = "<div class='menu'>" + "".join(f"<a href='{k}'>a link of the menu number {k}</a> " for k in range(30)) + "</div>"
    story = "<div id='s'><p>It was a dark night, and the rain fell, in torrents, on all the roofs.</p><p>Nobody, it seems, had thought of that before it was too late.</p></div>"
    page = f"<html><head><title>A &lt; B</TITLE ></head><body>{menu}{story}<div>Copyright, all rights reserved</div></body></html>"
    got = spark.createDataFrame([(page,), (None,)], "html string").select(text.html_text("html").alias("t"), text.html_title("html").alias("title")).collect()
    assert got[0].t == "It was a dark night, and the rain fell, in torrents, on all the roofs.\nNobody, it seems, had thought of that before it was too late."
    assert got[0].title == "A &lt; B" and got[1].t is None and got[1].title is None


def test_all_pages_are_read_as_by_a_parser(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/pages.parquet").select("html").distinct().collect()
    assert len(rows) > 50
    for r in rows:
        assert pages.Page(r.html).lines().split("\n") == (plain_lines(r.html) or [""])
