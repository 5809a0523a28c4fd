"""The ledger as a stream (an extension: nothing of the kind is in the model for this library)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_cost(calls: DataFrame, late: str = "30 days") -> DataFrame:
    """Calls and cost a day of a stream of priced calls, each delivery counted once within the watermark."""
    once = calls.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["call_id"])
    return once.groupBy(F.window("timestamp", "1 day").alias("w")).agg(F.count("*").alias("calls"), F.sum("cost_units").alias("cost_units")).select(F.to_date("w.start").alias("day"), "calls", "cost_units")
