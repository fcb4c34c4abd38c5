"""Scores of judged responses: eleven dimensions from 1 to 10."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atomloom.config import JUDGE_WEIGHTS

DIMENSIONS = list(JUDGE_WEIGHTS)


def filled() -> dict[str, Column]:
    """Each dimension, or the mean of the present ones to one decimal (5 if there is none)."""
    present = sum(F.when(F.col(d).isNotNull(), 1).otherwise(0) for d in DIMENSIONS)
    total = sum(F.coalesce(F.col(d).cast("double"), F.lit(0.0)) for d in DIMENSIONS)
    mean = F.when(present > 0, F.round(total / present, 1)).otherwise(5.0)
    return {d: F.coalesce(F.col(d).cast("double"), mean) for d in DIMENSIONS}


def overall(values: dict[str, Column] | None = None) -> Column:
    """The weighted mean of the dimensions that are present, to one decimal; 5 if there is none."""
    cols = values or {d: F.col(d) for d in DIMENSIONS}
    weight = sum(F.when(c.isNotNull(), JUDGE_WEIGHTS[d]).otherwise(0.0) for d, c in cols.items())
    score = sum(F.coalesce(c.cast("double") * JUDGE_WEIGHTS[d], F.lit(0.0)) for d, c in cols.items())
    return F.when(weight > 0, F.round(score / weight, 1)).otherwise(5.0)


def verdict(score: Column) -> Column:
    return F.when(score >= 8, "excellent").when(score >= 6, "good").when(score >= 4, "fair").otherwise("poor")


def valid(c: dict[str, Column] | None = None) -> Column:
    """Relevance, accuracy and helpfulness are there and between 1 and 10."""
    cols = c or {d: F.col(d) for d in DIMENSIONS}
    out = F.lit(True)
    for d in ("relevance", "accuracy", "helpfulness"):
        out = out & F.coalesce(cols[d].between(1, 10), F.lit(False))
    return out


def evaluation_rows(answers: DataFrame, limit: int = 2000) -> DataFrame:
    """Evaluations as they are stored: dimensions and the overall score 5 where missing, "fair", the response cut.

    ``answers``: message_id, updated_at, response and any of the dimensions, overall_score, verdict and reasoning.
    """

    def or_else(name: str, value: object) -> Column:
        return F.coalesce(F.col(name), F.lit(value)) if name in answers.columns else F.lit(value)

    scores = [or_else(d, 5).cast("double").alias(d) for d in DIMENSIONS]
    overall_score, response = or_else("overall_score", 5.0).cast("double"), F.substring(or_else("response", ""), 1, limit)
    return answers.select("message_id", *scores, overall_score.alias("overall_score"), or_else("verdict", "fair").alias("verdict"), or_else("reasoning", "").alias("reasoning"), response.alias("response"), "updated_at")


def final_score(given: Column, computed: Column) -> Column:
    """The score as given, unless it is missing or exactly the default of 5."""
    return F.when(given.isNull() | (given == 5.0), computed).otherwise(given)


def recovered(raw: Column) -> dict[str, Column]:
    """Dimensions read from free text such as ``"relevance": 8`` or ``Factual grounding = 7``; out of range is null."""
    out = {}
    for d in DIMENSIONS:
        found = F.lit(None).cast("int")
        for pattern in (rf"(?i){d.replace('_', ' ')}\s*[:=]\s*(\d+)", rf"(?i){d}\s*[:=]\s*(\d+)", rf'(?i)"{d}"\s*:\s*(\d+)'):
            n = F.regexp_extract(raw, pattern, 1).try_cast("int")
            found = F.when(n.between(1, 10), n).otherwise(found)
        out[d] = found
    return out


def recovered_enough(found: dict[str, Column], least: int = 3) -> Column:
    return sum(F.when(c.isNotNull(), 1).otherwise(0) for c in found.values()) >= least
