"""Results and calls written as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def result_json(results: DataFrame, pretty: bool = False) -> DataFrame:
    """``(document_id, json)`` of successful results; nulls are kept."""
    options = {"ignoreNullFields": "false"} | ({"pretty": "true"} if pretty else {})
    return results.where("success").select("document_id", F.to_json("data", options).alias("json"))


def write_results(results: DataFrame, path: str) -> None:
    results.select("document_id", "data").write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def log_lines(calls: DataFrame) -> DataFrame:
    """One nested JSON line a call."""
    line = F.struct(
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), "model", "strategy",
        F.struct(F.col("input_tokens").alias("input"), F.col("output_tokens").alias("output"), F.col("total_tokens").alias("total")).alias("tokens"),
        "cost", "document_id", "success", "error",
    )
    return calls.select(F.to_json(line, {"ignoreNullFields": "false"}).alias("value"))


def append_log(calls: DataFrame, path: str) -> None:
    log_lines(calls).write.mode("append").text(path)


def read_log(spark, path: str) -> DataFrame:
    kind = "timestamp timestamp_ntz, model string, strategy string, tokens struct<input:long,output:long,total:long>, cost double, document_id string, success boolean, error string"
    return spark.read.schema(kind).json(path)
