"""Scores, labels, costs and texts that depend on them, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.config import DEFAULT, Settings

#: Criteria in the order that decides ties, and what they are called in a summary.
CRITERIA = (("problem_similarity", "problem definition"), ("method_similarity", "methodology"), ("domain_overlap", "application domain"), ("contribution_similarity", "contributions"))
#: Fixed value: the summary of an idea for which no paper was found.
NO_PAPERS = "No similar papers were found. Your idea appears to be highly original, though this may indicate a gap in the search rather than true novelty."


def rounded(value: Column, digits: int = 6) -> Column:
    """A double to so many digits, as databases round: the scaled double to a whole number, halves away from zero.

    ``F.round`` rounds the shortest decimal that tells the double, which differs where that ends in a 5.
    """
    return F.round(value * 10.0**digits) / 10.0**digits


def millionths(total: Column, n: Column) -> Column:
    """To six digits the mean of ``n`` numbers of six digits, whose ``total`` is one of ``whole`` millionths: whatever their order."""
    return F.round(total / n) / 1e6


def whole(value: Column) -> Column:
    return F.round(value * 1e6).cast("long")


def overlap_label(overlap: Column, cfg: Settings = DEFAULT) -> Column:
    return F.when(overlap >= cfg.low_overlap, "low").when(overlap >= cfg.medium_overlap, "medium").otherwise("high")


def originality(overlap: Column) -> Column:
    """0 to 100, cut off, not rounded."""
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), (F.lit(1.0) - overlap) * 100)).cast("int")


def score_label(score: Column, cfg: Settings = DEFAULT) -> Column:
    return F.when(score >= cfg.high_score, "high").when(score >= cfg.medium_score, "medium").otherwise("low")


def main_criterion(values: list[Column]) -> Column:
    """struct<value, name> of the largest; the first of equals."""
    options = F.array(*(F.struct(F.coalesce(v, F.lit(0.0)).alias("value"), F.lit(-i).alias("turn"), F.lit(name).alias("name")) for i, (v, (_, name)) in enumerate(zip(values, CRITERIA, strict=True))))
    return F.array_max(options)


def summary(score: Column, values: list[Column], red: Column, yellow: Column, green: Column) -> Column:
    # The wording of a summary.
    level = F.when(score >= 70, "high").when(score >= 40, "moderate").otherwise("low")
    top = main_criterion(values)
    note = F.when(top["value"] > 0.5, F.concat(F.lit(" Main overlap detected in "), top["name"], F.lit("."))).otherwise("")
    return F.concat(
        F.lit("Your idea shows "), level, F.lit(" originality (score: "), score.cast("string"), F.lit("/100)."), note, F.lit(" "), red.cast("string"), F.lit(" sentences have significant overlap, "),
        yellow.cast("string"), F.lit(" have moderate overlap, and "), green.cast("string"), F.lit(" appear novel."),
    )


def adjusted(score: Column, exists: Column, confidence: Column, similarity: Column) -> Column:
    """What a reality check leaves of a score: up to 80 % less, but 5 at least, if the idea exists."""
    penalty = (score * (confidence * similarity) * F.lit(0.8)).cast("int")
    return F.when(exists, F.greatest(F.lit(5), score - penalty)).otherwise(score)


def token_cost(tokens: Column, input_share: float, cfg: Settings = DEFAULT) -> Column:
    """US dollars for ``tokens``, ``input_share`` of which went in."""
    return tokens * input_share / 1e6 * cfg.input_price + tokens * (1 - input_share) / 1e6 * cfg.output_price


def warning(exists: Column, confidence: Column, example: Column, assessment: Column, advice: Column) -> Column:
    """``example``: struct<name, similarity> or null."""
    # The wording of a warning.
    percent = F.concat(F.round(example["similarity"] * 100).cast("int").cast("string"), F.lit("%"))
    long = F.concat(F.lit("⚠️ **Warning: This idea may already exist!**\n\nYour idea closely resembles **"), F.coalesce(example["name"], F.lit("existing products")), F.lit("** (similarity: "), percent, F.lit(").\n\n*"), assessment, F.lit("*\n\n**Recommendation:** "), advice)
    short = F.concat(F.lit("⚠️ **Note:** Similar concepts may exist.\n\n*"), assessment, F.lit("*"))
    return F.when(exists & (confidence >= 0.8) & example.isNotNull(), long).when(exists & (confidence >= 0.5), short)
