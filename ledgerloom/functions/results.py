"""Columns derived from a result."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def checked_confidence(confidence: Column) -> Column:
    """The confidence; fails the query outside 0 to 1."""
    return F.when(confidence.between(0, 1) | confidence.isNull(), confidence).otherwise(F.raise_error(F.lit("confidence must be between 0 and 1")).cast("double"))


def high_confidence(success: Column, confidence: Column, least: float = 0.8) -> Column:
    return success & (confidence >= least)


def success_share(results: Column) -> Column:
    """Share of an array of results that succeeded; 0 for none."""
    return F.when(F.size(results) > 0, F.size(F.filter(results, lambda r: r["success"])) / F.size(results)).otherwise(0.0)


def cost_breakdown(strategy: Column, cost: Column) -> Column:
    return F.create_map(strategy, cost)


def is_free_method(strategy: Column) -> Column:
    """No strategy counts as free; what local models do is counted by their calls."""
    return F.lit(False)


def free_success_share(results: Column) -> Column:
    """Share of an array of results that are free and succeeded; 0 for none."""
    return F.when(F.size(results) > 0, F.size(F.filter(results, lambda r: r["success"] & is_free_method(r["strategy"]))) / F.size(results)).otherwise(0.0)


def summary(success: Column, document_id: Column, document_type: Column, strategy: Column, confidence: Column, error: Column, cost: Column | None = None, seconds: Column | None = None) -> Column:
    """One line for people: state, document, strategy, confidence in percent, cost and time where given, error."""
    more = [F.format_string(" %s%.4f%s", F.lit(a), F.coalesce(c.cast("double"), F.lit(0.0)), F.lit(b)) for c, a, b in ((cost, "$", ""), (seconds, "", "s")) if c is not None]
    line = F.format_string("%s %s (%s) %s %.2f%%", F.when(success, "SUCCESS").otherwise("FAILED"), F.coalesce(document_id, F.lit("?")), F.coalesce(document_type, F.lit("?")), F.coalesce(strategy, F.lit("N/A")), F.coalesce(confidence, F.lit(0.0)) * 100)
    return F.concat(line, *more, F.coalesce(F.concat(F.lit(" Error: "), error), F.lit("")))
