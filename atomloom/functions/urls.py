"""URL functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from atomloom.config import PRIORITY_DOMAINS, URL_HINTS
from atomloom.functions.text import contains_any, strip

TRACKING = r"[?&](utm_\w+|ref|source|fbclid|gclid)=[^&]*"
#: Locale segments of a path, language and region.
LOCALE = r"(?i)/(en|ja|de|fr|pt|ko|zh|es|it|nl|ru|ar|tr|pl|sv|da|fi|nb|cs|hu|ro|uk)[-_](us|gb|jp|de|fr|br|kr|cn|es|it|nl|ru|ar|tr|pl|se|dk|fi|no|cz|hu|ro|ua|in|au|ca|mx)(?=/|$)"
ENGLISH = ("/en-us/", "/en-gb/", "/en/", "/english/")


def for_scraping(c: Column) -> Column:
    """With a scheme, without tracking parameters and trailing marks; null for null and empty."""
    u = strip(c)
    u = F.when(u.startswith("http://") | u.startswith("https://"), u).otherwise(F.concat(F.lit("https://"), u))
    u = F.regexp_replace(F.rtrim(u, F.lit("/")), TRACKING, "")
    return F.when(c.isNotNull() & (c != ""), F.rtrim(u, F.lit("?&")))


def for_search(c: Column) -> Column:
    """Redirects unwrapped; without scheme, www, query and fragment; lower case."""
    u = F.rtrim(strip(c), F.lit("/"))
    u = F.when(u.contains("uddg="), F.try_url_decode(F.split_part(F.split_part(u, F.lit("uddg="), F.lit(2)), F.lit("&"), F.lit(1)))).otherwise(u)
    u = F.regexp_replace(u, r"^https?://(www\.)?", "")
    return F.lower(F.split_part(F.split_part(u, F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1)))


def netloc(c: Column) -> Column:
    return F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def path(c: Column) -> Column:
    return F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def domain(c: Column) -> Column:
    return F.replace(netloc(c), F.lit("www."), F.lit(""))


def hinted(c: Column) -> Column:
    return contains_any(F.lower(c), URL_HINTS)


def priority(c: Column) -> Column:
    """10 for a priority domain, 5 for a hint in the URL, else 0."""
    return F.when(contains_any(F.lower(domain(c)), PRIORITY_DOMAINS), 10).when(hinted(c), 5).otherwise(0)


def blocked(dom: Column, domains: list[str]) -> Column:
    return contains_any(F.lower(dom), domains)


def content_key(c: Column) -> Column:
    """What URLs of the same page in other locales share: host and path without the locale."""
    return F.concat(F.lower(netloc(c)), F.lower(F.rtrim(F.regexp_replace(path(c), LOCALE, ""), F.lit("/"))))


def english(c: Column) -> Column:
    return contains_any(F.lower(c), list(ENGLISH))


def arxiv_pdf(c: Column) -> Column:
    """The PDF address of an abstract page; other URLs as they are."""
    return F.when(c.contains("arxiv.org/abs/"), F.concat(F.replace(c, F.lit("/abs/"), F.lit("/pdf/")), F.lit(".pdf"))).otherwise(c)


def kind(c: Column) -> Column:
    return F.when(c.contains("youtube.com") | c.contains("youtu.be"), "youtube").otherwise("web")
