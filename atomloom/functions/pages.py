"""What a web page says: one linear scan of its tags, content parts, and scores for pages that name none.

``Page`` reads a page once. Whatever a page holds ("<" without an end, comments or scripts that never close, tags nested
ten thousand deep), each character is looked at a bounded number of times. The content is that of the first article, main
or content division; else of the element that the scores prefer; else of the body.

Scores: texts between block elements are units. A unit of ``LEAST`` characters or more outside links, with no more than half
of it inside links, gives 1, one for each comma, and one for each hundred characters up to three: to the element that holds
it, and half as much to the one around that. An element's score counts by the share of its text that is outside links.
The best element wins, the first of equal ones; none wins without a score.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements that hold no content, and those among them whose content is no markup.
NOISE = ("script", "style", "nav", "footer", "header", "aside", "form", "iframe", "noscript")
RAW = ("script", "style", "iframe", "noscript")
#: Elements that hold texts, and those that end a text.
HOLDERS = frozenset(("article", "main", "section", "div", "td", "body", "blockquote"))
BREAKS = HOLDERS | frozenset("p li ul ol dl dt dd table tr th h1 h2 h3 h4 h5 h6 pre br hr html head title figure figcaption".split())
PAIRED = frozenset((*NOISE, *HOLDERS, "a"))
LEAST = 25
#: What the class of a division that holds the content has in it.
CONTENT = ("content", "article", "post")
CLASS, QUOTE, TITLE_END = re.compile(r"class=[\"']", re.I), re.compile("[\"']"), re.compile(r"</title\s*>", re.I)
NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9]*")
END = {t: re.compile(rf"</{t}\b", re.I) for t in RAW}
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def names_content(tag: str) -> bool:
    """Whether a tag's class says that it holds the content."""
    for found in CLASS.finditer(tag):
        end = QUOTE.search(tag, found.end())
        if end is None:
            return False
        value = tag[found.end() : end.start()].lower()
        if any(w in value for w in CONTENT):
            return True
    return False


class Page:
    """The tags of a page in order: ``names`` (closing ones start with "/"), where each begins and ends, and its partner."""

    def __init__(self, page: str):
        self.page, self.names, self.starts, self.ends = page, [], [], []
        at, over = 0, set()  # over: what is known not to come any more
        while (at := page.find("<", at)) >= 0:
            if page.startswith("<!--", at):
                end = -1 if "-->" in over else page.find("-->", at + 4)
                if end >= 0:
                    self._add("!", at, end + 3)
                    at = end + 3
                    continue
                over.add("-->")
            end = -1 if ">" in over else page.find(">", at)
            if end < 0:
                break
            closing = page.startswith("/", at + 1)
            found = NAME.match(page, at + 1 + closing)
            name = (found[0] if found else "!").lower()
            self._add("/" + name if closing else name, at, end + 1)
            at = end + 1
            if name in END and not closing and name not in over:
                close = END[name].search(page, at)
                if close is None:
                    over.add(name)
                else:
                    at = close.start()
        self.partner = self._pairs()
        self.shown = self._shown()

    def _add(self, name: str, start: int, end: int) -> None:
        self.names.append(name)
        self.starts.append(start)
        self.ends.append(end)

    def _pairs(self) -> dict[int, int]:
        """Opening tag -> the closing one of its own element; elements of one name nest."""
        opened: dict[str, list[int]] = {}
        out = {}
        for k, name in enumerate(self.names):
            if name in PAIRED:
                opened.setdefault(name, []).append(k)
            elif name[1:] in PAIRED and opened.get(name[1:]):
                out[opened[name[1:]].pop()] = k
        return out

    def _shown(self) -> list[int]:
        """The tags outside noise elements that have an end; a noise element counts as the tag that opens it."""
        out, k = [], 0
        while k < len(self.names):
            out.append(k)
            k = self.partner[k] + 1 if self.names[k] in NOISE and k in self.partner else k + 1
        return out

    def pieces(self, first: int, last: int) -> list[str]:
        """The texts between the shown tags from ``first`` (an opening tag, -1: the page's start) to ``last`` (a closing one)."""
        out, at = [], self.ends[first] if first >= 0 else 0
        for k in self.shown[bisect_left(self.shown, first + 1) :]:
            if k >= last:
                break
            out.append(self.page[at : self.starts[k]])
            at = self.ends[self.partner[k]] if self.names[k] in NOISE and k in self.partner else self.ends[k]
        out.append(self.page[at : self.starts[last]] if last < len(self.names) else self.page[at:])
        return out

    def part(self) -> tuple[int, int] | None:
        """The first article, else main, else content division that holds anything, to its own end or that of the page."""
        for tag in ("article", "main", "div"):
            for k in self.shown:
                if self.names[k] == tag and (tag != "div" or names_content(self.page[self.starts[k] : self.ends[k]])):
                    last = self.partner.get(k, len(self.names))
                    if (self.starts[last] if last < len(self.names) else len(self.page)) > self.ends[k]:
                        return k, last
                    break
        return None

    def units(self):
        """(characters, characters in links, commas, holder, holder around it) of each text between block elements."""
        holders, links, size, linked, commas, at = [], 0, 0, 0, 0, 0
        for k in [*self.shown, len(self.names)]:
            end = self.starts[k] if k < len(self.names) else len(self.page)
            text = self.page[at:end].strip()
            size, commas = size + len(text), commas + text.count(",")
            linked += len(text) if links else 0
            name = self.names[k] if k < len(self.names) else "html"
            if name.removeprefix("/") in BREAKS or k == len(self.names):
                if size:
                    yield size, linked, commas, (holders[-1] if holders else None), (holders[-2] if len(holders) > 1 else None)
                size = linked = commas = 0
            if k == len(self.names):
                break
            if name == "a":
                links += k in self.partner
            elif name == "/a":
                links = max(0, links - 1)
            elif name in HOLDERS and k in self.partner:
                holders.append(k)
            elif name[1:] in HOLDERS and holders and self.partner[holders[-1]] <= k:
                while holders and self.partner[holders[-1]] <= k:
                    holders.pop()
            at = self.ends[self.partner[k]] if name in NOISE and k in self.partner else self.ends[k]

    def best(self) -> tuple[int, int] | None:
        """The element that the scores prefer."""
        points: dict[int, float] = {}
        sums: dict[int, list[int]] = {}
        for size, linked, commas, holder, around in self.units():
            for h in (holder, around):
                if h is not None:
                    sums.setdefault(h, [0, 0])
            if holder is not None:
                sums[holder][0] += size
                sums[holder][1] += linked
            if size - linked >= LEAST and 2 * linked <= size:
                worth = 1 + commas + min((size - linked) // 100, 3)
                for h, share in ((holder, 1.0), (around, 0.5)):
                    if h is not None:
                        points[h] = points.get(h, 0.0) + share * worth
        # texts of inner elements count as those of the outer ones: inner ones come later, so sums go outwards from the end
        total = {h: list(s) for h, s in sums.items()}
        open_: list[int] = []
        around_of = {}
        for h in sorted(total):
            while open_ and self.partner[open_[-1]] < h:
                open_.pop()
            around_of[h] = open_[-1] if open_ else None
            open_.append(h)
        for h in sorted(total, reverse=True):
            if around_of[h] is not None:
                total[around_of[h]][0] += total[h][0]
                total[around_of[h]][1] += total[h][1]
        scored = [(points[h] * (1 - total[h][1] / total[h][0]), -h) for h in points]
        if not scored:
            return None
        h = -max(scored)[1]
        return h, self.partner[h]

    def body(self) -> tuple[int, int]:
        for k in self.shown:
            if self.names[k] == "body":
                return k, self.partner.get(k, len(self.names))
        return len(self.names), len(self.names)

    def lines(self) -> str:
        """The lines of the content, without markup; nothing if the page has no content, score or body."""
        first, last = self.part() or self.best() or self.body()
        if first == len(self.names):
            return ""
        text = "\n".join(self.pieces(first, last))
        for entity, sign in ENTITIES:
            text = text.replace(entity, sign)
        return "\n".join(x for line in text.split("\n") if (x := line.strip(" \t\n\r\x0b\f")))

    def title(self) -> str:
        """The text of the title, up to its end."""
        for k, name in enumerate(self.names):
            if name == "title":
                end = TITLE_END.search(self.page, self.ends[k])
                return self.page[self.ends[k] : end.start()].strip(" \t\n\r\x0b\f") if end else ""
        return ""


@F.pandas_udf(T.StructType([T.StructField("title", T.StringType()), T.StructField("lines", T.StringType())]))
def read_page(pages: pd.Series) -> pd.DataFrame:
    """(title, content lines) of pages; nulls for null."""
    read = [None if p is None else Page(p) for p in pages]
    return pd.DataFrame({"title": [r and r.title() for r in read], "lines": [r and r.lines() for r in read]}, dtype=object)
