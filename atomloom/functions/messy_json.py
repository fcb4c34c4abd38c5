"""JSON out of free text: fences, leading prose, trailing commas, single quotes. A scan of brackets needs a loop."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S)


def _first_balanced(text: str, quoted: bool) -> tuple[int, int] | None:
    """(start, end) of the first balanced span; ``quoted``: whether the text begins inside a string."""
    open_, held, skip, best = [], {"[": 0, "{": 0}, False, None
    for at, c in enumerate(text):
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "[{":
            open_.append((c, at))
            held[c] += 1
        elif c in "]}" and held["[" if c == "]" else "{"]:
            # brackets opened inside and never closed are given up
            kind, start = None, at
            while kind != ("[" if c == "]" else "{"):
                kind, start = open_.pop()
                held[kind] -= 1
            if best is None or start < best[0]:
                best = start, at + 1
            if not open_:
                return best
    return best


def balanced(text: str) -> str | None:
    """The first object or array whose brackets match, outside strings.

    A bracket that never closes, and a closing one that was never opened, are passed over. What a quote means depends on
    how many came before, so there are two readings of the text, each in one pass.
    """
    found = [x for x in (_first_balanced(text, False), _first_balanced(text, True)) if x]
    return text[slice(*min(found))] if found else None


def repaired(text: str | None) -> str | None:
    """The text's JSON in normal form, or None."""
    if not text:
        return None
    fenced = _FENCE.search(text)
    for candidate in (text, fenced and fenced[1], balanced(text)):
        if not candidate:
            continue
        plain = re.sub(r",\s*([\]}])", r"\1", candidate.strip())
        for form in (candidate, plain, re.sub(r"(?<![A-Za-z0-9])'|'(?![A-Za-z0-9])", '"', plain)):
            try:
                value = json.loads(form)
            except ValueError:
                continue
            if isinstance(value, (dict, list)):
                return json.dumps(value, sort_keys=True)
    return None


@F.pandas_udf(StringType())
def json_in(texts: pd.Series) -> pd.Series:
    return texts.map(repaired)
