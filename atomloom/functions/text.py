"""Text functions as Column expressions: all stay in the JVM and in code generation, but for the scan of pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from atomloom.config import GATE_STOPWORDS, STOPWORDS
from atomloom.functions.pages import read_page

#: ASCII white space, as the strip of most languages takes it.
BLANK = " \t\n\r\x0b\x0c"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANK))


def words_of(c: Column) -> Column:
    """Split at white space; an empty text has no words."""
    return F.filter(F.split(c, r"[ \t\n\r\x0b\f]+"), lambda w: w != "")


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def contains_any(c: Column, phrases: list[str]) -> Column:
    """Whether one of a list of literal phrases is in the text: one pattern, so ``c`` is computed once."""
    return c.rlike("|".join(rf"\Q{p}\E" for p in phrases)) if phrases else F.lit(False)


def collapse(c: Column) -> Column:
    """Three or more newlines become two, runs of blanks one space."""
    return F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"[ \t]{2,}", " ")


def clean_text(c: Column) -> Column:
    """Collapse; strip lines; drop lines of one to three characters."""
    lines = F.transform(F.split(collapse(c), "\n"), strip)
    return strip(F.array_join(F.filter(lines, lambda x: (F.length(x) > 3) | (x == "")), "\n"))


def clean_pdf_text(c: Column) -> Column:
    """Strip lines; drop page numbers (up to three digits) and rules; collapse."""
    lines = F.transform(F.split(c, "\n"), strip)
    kept = F.filter(lines, lambda x: ~(x.rlike(r"^[0-9]{1,3}$") | x.rlike(r"^[-_=]{3,}$")))
    return strip(collapse(F.array_join(kept, "\n")))


def cap(c: Column, limit: int = 20_000, marker: str = "\n\n[Content truncated...]") -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(marker))).otherwise(c)


def word_count(c: Column) -> Column:
    return F.size(words_of(c))


def snippet(c: Column, limit: int = 500) -> Column:
    s = strip(F.regexp_replace(c, r"[ \t\n\r\x0b\f]+", " "))
    return F.when(F.length(s) > limit, F.concat(F.substring(s, 1, limit), F.lit("..."))).otherwise(s)


def search_tokens(c: Column, stopwords: list[str] | None = None) -> Column:
    """Lower-case words of a-z and 0-9, longer than one, that are no stopwords."""
    stop = STOPWORDS if stopwords is None else stopwords
    words = F.split(F.lower(c), r"[^a-z0-9]+")  # a set of literals is looked up by hash
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(stop))


def bm25_tokens(c: Column) -> Column:
    return words_of(F.lower(c))


def estimated_tokens(c: Column) -> Column:
    return F.floor(F.length(c) / 4)


def embedding_input(c: Column, kind: str = "passage", limit: int = 2000) -> Column:
    return F.concat(F.lit(f"{kind}: "), F.substring(c, 1, limit))


def entities(c: Column) -> Column:
    """A deterministic stand-in for a name tagger: the distinct capitalised words of a text."""
    found = F.regexp_extract_all(c, F.lit(r"([A-Z][a-z]{2,})"), 1)
    return F.array_sort(F.array_distinct(F.transform(found, F.lower)))


def preview(c: Column, limit: int = 100) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("..."))).otherwise(c)


def safe_key(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{N}_-]", "_")


def masked(c: Column) -> Column:
    return F.when(F.length(c) > 8, F.concat(F.substring(c, 1, 4), F.lit("..."), F.substring(c, -4, 4))).otherwise(F.lit("****"))


def title(c: Column) -> Column:
    """A chat title from a model's answer."""
    t = strip(c)
    for p in ("Title:", "Chat Title:", "Topic:", "Subject:"):
        t = F.when(F.lower(t).startswith(p.lower()), strip(F.substr(t, F.lit(len(p) + 1)))).otherwise(t)
    for mark in "\"'*#":
        t = F.btrim(t, F.lit(mark))
    t = strip(t)
    w = words_of(t)
    t = F.when(F.size(w) > 8, F.array_join(F.slice(w, 1, 6), " ")).otherwise(t)
    return F.when(t.isNull() | (F.length(t) < 2), F.lit("New Chat")).otherwise(F.initcap(t))


def smart_truncate(c: Column, limit: int = 12_000, target: int = 4_000) -> Column:
    """The beginning, the middle and the end of a long text."""
    part = target // 3
    middle = F.floor(F.length(c) / 2).cast("int") - part // 2 + 1
    cut = F.concat(F.substring(c, 1, part), F.lit("\n\n[... middle section of response ...]\n\n"), F.substr(c, middle, F.lit(part)), F.lit("\n\n[... end section of response ...]\n\n"), F.substring(c, -part, part))
    return F.when(F.length(c) > limit, cut).otherwise(c)


def relevant(content: Column, query: Column, step: Column | None = None, sample: int = 12_000) -> Column:
    """The two-tier relevance gate: a core term must occur, and 8 % of a set of five terms or more."""
    stop = strings(GATE_STOPWORDS)

    def terms(c: Column) -> Column:
        return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit("([a-z]{3,})"), 1), lambda w: ~F.array_contains(stop, w)))

    text, core = F.lower(F.substring(content, 1, sample)), terms(query)
    every = core if step is None else F.array_union(core, terms(step))

    def found(t: Column) -> Column:
        return F.size(F.filter(t, lambda w: text.contains(w)))

    hard = (F.size(core) > 0) & (F.length(content) >= 300) & (found(core) == 0)
    soft = (F.size(every) >= 5) & (found(every) / F.size(every) < 0.08)
    blank = content.isNull() | (content == "") | query.isNull() | (query == "")
    return blank | ~(hard | soft)


def html_title(c: Column) -> Column:
    return read_page(c)["title"]


def html_text(c: Column) -> Column:
    """Plain text of a page: its content part, else what the scores prefer, else the body (``functions/pages.py``)."""
    return clean_text(read_page(c)["lines"])
