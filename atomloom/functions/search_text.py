"""Query rewriting and routing as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from atomloom.config import FORCE_WEB, GENERIC_WORDS, INSTRUCTION_VERBS, INTENTS, PLAN_SITE_KEYWORDS, SITE_KEYWORDS
from atomloom.functions.text import contains_any, strings, strip, words_of

SITE = r"(?i)site:([^ \t\n\r\x0b\f]+)"


def _squeezed(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"[ \t\n\r\x0b\f]+", " "))


def _keyword(dom: Column, table: dict[str, str]) -> Column:
    """The keyword of the first known domain within ``dom``."""
    out = F.lit("")
    for known, word in reversed(table.items()):
        out = F.when(dom.contains(known), F.lit(word)).otherwise(out)
    return out


def strip_operators(c: Column) -> Column:
    """``site:`` becomes a keyword in place, other operators go; a query of nothing else stays as it was."""
    start = strip(c)
    found = F.regexp_extract_all(start, F.lit(SITE), 0)
    q = F.aggregate(found, start, lambda t, m: strip(F.replace(t, m, _keyword(F.substr(F.lower(m), F.lit(6)), SITE_KEYWORDS))))
    for op in ("filetype", "inurl", "intitle", "inanchor", "cache"):
        q = F.regexp_replace(q, rf"(?i){op}:[^ \t\n\r\x0b\f]+", "")
    q = _squeezed(q)
    return F.when(q != "", q).otherwise(start)


def sanitize(c: Column) -> Column:
    """``site:`` goes and its keyword is appended where the query lacks it."""
    start = strip(c)
    found = F.transform(F.regexp_extract_all(start, F.lit(SITE), 1), F.lower)

    def step(t: Column, d: Column) -> Column:
        word = _keyword(d, PLAN_SITE_KEYWORDS)
        cut = F.regexp_replace(t, F.concat(F.lit(r"(?i)site:\Q"), d, F.lit(r"\E[ \t\n\r\x0b\f]*")), F.lit(""))
        return F.when((word != "") & ~cut.contains(word), F.concat(strip(cut), F.lit(" "), word)).otherwise(cut)

    q = _squeezed(F.aggregate(found, start, step))
    return F.when(q != "", q).otherwise(start)


def strip_command(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?i)^(please\s+)?(search\s+(the\s+web\s+)?for|find|google)\s+", ""))


def fallbacks(c: Column) -> Column:
    """Up to two simpler queries: the first four words; without years; with "research"."""
    w = words_of(c)
    undated = _squeezed(F.regexp_replace(c, r"\b(20\d{2})\b", ""))
    options = F.array(
        F.when(F.size(w) > 4, F.array_join(F.slice(w, 1, 4), " ")),
        F.when((undated != "") & (undated != c) & (F.length(undated) > 5), undated),
        F.when(~F.lower(c).contains("paper") & ~F.lower(c).contains("research"), F.concat(c, F.lit(" research"))),
    )
    return F.slice(F.filter(options, lambda x: x.isNotNull()), 1, 2)


def anchored(c: Column, original: Column) -> Column:
    """``c`` with up to three distinctive words of the original query in front, unless it holds one of them."""
    generic = strings(GENERIC_WORDS)
    terms = F.filter(F.regexp_extract_all(original, F.lit("([A-Za-z]{4,})"), 1), lambda w: ~F.array_contains(generic, F.lower(w)))
    held = F.exists(terms, lambda w: F.lower(c).contains(F.lower(w)))
    return F.when((F.size(terms) == 0) | held, c).otherwise(F.concat(F.array_join(F.slice(terms, 1, 3), " "), F.lit(" "), c))


def intent(c: Column) -> Column:
    q = strip(F.lower(c))
    starts = "|".join(rf"\Q{p}\E" for p in INTENTS["conversational"])
    out = F.when(q.rlike(f"^({starts})"), "conversational")
    for name, phrases in list(INTENTS.items())[1:]:
        out = out.when(contains_any(q, phrases), name)
    return out.otherwise("explanatory")


def conversational(c: Column) -> Column:
    """A long query with an instruction in it."""
    return (F.size(words_of(c)) > 6) & contains_any(F.lower(c), INSTRUCTION_VERBS)


def sufficiency(query: Column, n_results: Column, evidence: Column, max_score: Column) -> Column:
    """``sufficient``, or the reason why local evidence isn't."""
    names = F.array_distinct(F.regexp_extract_all(query, F.lit(r"\b([A-Z][a-z]{2,})\b"), 1))
    missing = F.exists(names, lambda w: ~F.lower(evidence).contains(F.lower(w)))
    return (
        F.when(contains_any(F.lower(query), FORCE_WEB), "forced_web").when(F.coalesce(n_results, F.lit(0)) == 0, "no_results")
        .when(F.length(strip(evidence)) < 100, "short_evidence").when(missing, "missing_entity")
        .when(F.coalesce(max_score, F.lit(0.0)) < 0.7, "low_score").otherwise("sufficient")
    )
