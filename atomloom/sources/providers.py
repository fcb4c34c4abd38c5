"""Answers of web search providers as result rows (``schemas.SEARCH_RESULTS``), all as Column expressions.

Each parser takes a column with the body of an answer and gives an array of (title, url, snippet, date), best first, at
most ``most``. A body that is null or of another form gives an empty array, so that a failing provider has no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atomloom.functions.text import snippet, strip

HIT = "array<struct<title:string,url:string,snippet:string,date:string>>"
NAMED = r"(?i)\bclass=[\"']([^\"']*)[\"']"
MARK = "\x01"


def plain(c: Column) -> Column:
    """The text of a piece of HTML; a "<" whose tag has no end stays."""
    pieces = F.split(c, "<")
    rest = F.transform(F.slice(pieces, 2, F.size(pieces)), lambda p: F.when(F.instr(p, ">") > 0, F.split(p, ">", 2)[1]).otherwise(F.concat(F.lit("<"), p)))
    text = F.concat(pieces[0], F.array_join(rest, ""))
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return strip(text)


def after_tags(body: Column, tag: str) -> Column:
    """What comes behind each "<tag", up to the next one: the rest of the tag, ">" and its content."""
    pieces = F.split(body, rf"(?i)<{tag}\b")
    return F.slice(pieces, 2, F.size(pieces))


def has_class(piece: Column, name: str) -> Column:
    """Whether the tag that a piece goes on with is closed and has a class."""
    classes = F.split(F.regexp_extract(F.substring_index(piece, ">", 1), NAMED, 1), r"\s+")
    return (F.instr(piece, ">") > 0) & F.array_contains(F.transform(classes, F.lower), name.lower())


def blocks(body: Column, tag: str, name: str) -> Column:
    """What each element with a class holds, up to the next such element: all that follows its tag.

    The page is cut at all tags of that kind, marked at those with the class, put together again and cut at the marks.
    """
    pieces = after_tags(F.translate(body, MARK, " "), tag)
    marked = F.transform(pieces, lambda p: F.when(has_class(p, name), F.concat(F.lit(MARK), F.split(p, ">", 2)[1])).otherwise(F.concat(F.lit(f"<{tag}"), p)))
    parts = F.split(F.array_join(marked, ""), MARK)
    return F.slice(parts, 2, F.size(parts))


def inside(html: Column, tag: str) -> Column:
    """What the first element of a kind holds, up to its end tag; empty without one."""
    first = F.get(F.split(html, rf"(?i)<{tag}\b", 2), 1)
    content = F.get(F.split(F.when(F.instr(first, ">") > 0, F.split(first, ">", 2)[1]), rf"(?i)</{tag}\s*>", 2), 0)
    closed = F.size(F.split(first, rf"(?i)</{tag}\s*>", 2)) > 1
    return F.when(closed, F.coalesce(content, F.lit(""))).otherwise("")


def link(html: Column, name: str | None = None) -> Column:
    """(href, text) of the first link that has an address (and a class); empty ones without such a link."""
    held = after_tags(html, "a")
    address = lambda p: F.regexp_extract(F.substring_index(p, ">", 1), r"(?i)\bhref=[\"']([^\"']*)[\"']", 1)
    fits = F.filter(held, lambda p: (F.instr(p, ">") > 0) & (has_class(p, name) if name else F.substring_index(p, ">", 1).rlike(r"(?i)\bhref=[\"'][^\"']*[\"']")))
    first = F.coalesce(F.get(fits, 0), F.lit(""))
    text = F.split(F.get(F.split(first, ">", 2), 1), r"(?i)</a\s*>", 2)
    return F.struct(address(first).alias("href"), F.when(F.size(text) > 1, text[0]).otherwise("").alias("text"))


def hit(title: Column, url: Column, text: Column, date: Column | None = None) -> Column:
    return F.struct(title.alias("title"), url.alias("url"), snippet(text).alias("snippet"), (F.lit(None).cast("string") if date is None else date).alias("date"))


def _first(hits: Column, most: int) -> Column:
    return F.coalesce(F.slice(hits, 1, most), F.array()).cast(HIT)


def list_items(body: Column, most: int = 6) -> Column:
    """Results as ``li.b_algo``: the link of the heading; the caption's paragraph, else any, else the caption."""

    def one(b: Column) -> Column:
        head = link(inside(b, "h2"))
        caption = F.get(F.split(F.coalesce(F.get(blocks(b, "div", "b_caption"), 0), F.lit("")), r"(?i)</div\s*>", 2), 0)
        texts = F.array(plain(inside(caption, "p")), plain(inside(b, "p")), plain(caption))
        text = F.coalesce(F.get(F.filter(texts, lambda t: t != ""), 0), F.lit(""))
        return hit(plain(head["text"]), head["href"], text)

    return _first(F.filter(F.transform(blocks(body, "li", "b_algo"), one), lambda h: h["url"].startswith("http")), most)


def result_blocks(body: Column, most: int = 8) -> Column:
    """Results as ``div.result`` with a link ``result__a`` and a text ``result__snippet``."""

    def one(b: Column) -> Column:
        head = link(b, "result__a")
        return hit(plain(head["text"]), head["href"], plain(link(b, "result__snippet")["text"]))

    return _first(F.filter(F.transform(blocks(body, "div", "result"), one), lambda h: (h["url"] != "") & (h["title"] != "")), most)


def redirect_links(body: Column, most: int = 8) -> Column:
    """Results as links ``/url?q=``, each target once; the text is a span of 40 to 300 characters soon after the link."""
    parts = F.split(body, r"<a\s+href=\"(?=/url\?q=)")

    def one(b: Column) -> Column:
        url = F.try_url_decode(F.replace(F.regexp_extract(b, r"^/url\?q=([^\"&]+)", 1), F.lit("+"), F.lit("%2B")))
        title = plain(F.regexp_extract(b, r"(?s)^[^\"]*\"[^>]*>(.*?)</a>", 1))
        near = F.regexp_extract(F.substring(b, 1, 2000), r"<span[^>]*>([^<]{40,300})</span>", 1)
        return hit(title, url, F.when(F.length(strip(near)) > 30, strip(near)).otherwise(""))

    hits = F.transform(F.slice(parts, 2, F.size(parts)), one)
    outside = F.filter(hits, lambda h: h["url"].isNotNull() & (h["url"] != "") & ~h["url"].contains("google.com") & ~h["url"].contains("youtube.com/sorry") & ~h["url"].startswith("/"))
    urls = F.transform(outside, lambda h: h["url"])
    new = F.filter(outside, lambda h, i: F.array_position(urls, h["url"]) == i + 1)
    return _first(F.filter(new, lambda h: F.length(h["title"]) >= 3), most)


def encyclopedia_json(body: Column, most: int = 5) -> Column:
    """An encyclopedia's search API: titles, marked snippets, timestamps; the address follows from the title."""
    got = F.from_json(body, "query struct<search:array<struct<title:string,snippet:string,timestamp:string>>>")["query"]["search"]
    site = F.lit("https://en.wikipedia.org/wiki/")
    unmarked = lambda s: F.regexp_replace(F.coalesce(s, F.lit("")), r"<span class=\"searchmatch\">|</span>", "")
    made = F.transform(got, lambda r: hit(F.coalesce(r["title"], F.lit("")), F.concat(site, F.replace(F.coalesce(r["title"], F.lit("")), F.lit(" "), F.lit("_"))), unmarked(r["snippet"]), r["timestamp"]))
    return _first(made, most)


def metasearch_json(body: Column, most: int = 5) -> Column:
    """A metasearch API: title, url, content and date of publication."""
    got = F.from_json(body, "results array<struct<title:string,url:string,content:string,publishedDate:string>>")["results"]
    text = lambda c: F.coalesce(c, F.lit(""))
    return _first(F.transform(got, lambda r: hit(text(r["title"]), text(r["url"]), text(r["content"]), r["publishedDate"])), most)


def result_rows(answers: DataFrame, parsers: dict[str, Callable[[Column], Column]], body: str = "body", provider: str = "provider") -> DataFrame:
    """Answers (provider, body, ...) as one row for each result, with its place ``pos``; unknown providers have none."""
    hits = F.array().cast(HIT)
    for name, parse in parsers.items():
        hits = F.when(F.col(provider) == name, parse(F.col(body))).otherwise(hits)
    rest = [c for c in answers.columns if c != body]
    return answers.select(*rest, F.posexplode(hits).alias("pos", "__hit")).select(*rest, "pos", "__hit.*")
