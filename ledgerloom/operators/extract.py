"""Documents to typed records through a model: prompt, call, JSON, validation, retry, ledger.

All that is an expression runs before and after the one Python stage, which makes
its provider once a partition, streams Arrow batches, carries the other columns
through and turns every failure into a row.  Each call of each attempt comes out
for the ledger, where it is priced and held against the limits.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from datetime import datetime

import pyarrow as pa
from pydantic import BaseModel, ValidationError
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ledgerloom.functions import schemas
from ledgerloom.functions import text as tx
from ledgerloom.functions.results import cost_breakdown
from ledgerloom.operators import ledger
from ledgerloom.providers.base import Provider
from ledgerloom.session import written

ATTEMPTS = 3
CONFIDENCE = 0.85
_CALLS = "array<struct<attempt:int,timestamp:timestamp_ntz,input_tokens:bigint,output_tokens:bigint,success:boolean,error:string>>"
_ANSWER = f"_ok boolean, json string, response string, _error string, attempt int, input_tokens bigint, output_tokens bigint, seconds double, calls {_CALLS}"
# How failures are told
FAILED, VISION_FAILED = "Extraction failed: ", "Vision extraction failed: "
UNSUCCESSFUL, NO_JSON, TEXT_NO_JSON, INVALID, BLIND = "Provider returned unsuccessful result", "Failed to parse JSON response: ", "Extraction failed: Failed to parse JSON: ", "Validation failed after {} attempts: ", "Model {} does not support vision"


def span(response: str) -> str:
    a, b = response.find("{"), response.rfind("}")
    return response[a : b + 1] if 0 <= a < b else response


def parsed(response: str, schema: type[BaseModel]) -> str:
    """The validated record as JSON; raises ValueError or ValidationError."""
    return schema(**json.loads(span(response))).model_dump_json()


def asked(provider: Provider, prompt: str, image: bytes | None, media: str | None, schema: type[BaseModel], attempts: int) -> dict:
    """The answer to one document: up to ``attempts`` calls while only the validation fails, one for an image."""
    began, calls, row = time.monotonic(), [], {}
    failed = VISION_FAILED if image is not None else FAILED
    for attempt in range(1, (1 if image is not None else attempts) + 1):
        at = datetime.now()
        c = provider.ask(prompt, image, media or "image/jpeg") if image is not None else provider.ask(prompt)
        calls.append({"attempt": attempt, "timestamp": at, "input_tokens": c.input_tokens, "output_tokens": c.output_tokens, "success": c.success, "error": c.error})
        row = {"_ok": False, "json": None, "response": c.content, "attempt": attempt, "input_tokens": 0, "output_tokens": 0}
        if not c.success:
            row["_error"] = failed + (c.error or UNSUCCESSFUL)
            break
        try:
            row |= {"json": parsed(c.content, schema), "_ok": True, "_error": None, "input_tokens": c.input_tokens, "output_tokens": c.output_tokens}
            break
        except ValidationError as e:
            row["_error"] = f"{failed}{e}" if image is not None else f"{INVALID.format(attempts)}{e}"
        except ValueError as e:
            row["_error"] = f"{NO_JSON if image is not None else TEXT_NO_JSON}{e}"
            break
        except (TypeError, RecursionError) as e:
            row["_error"] = failed + str(e)
            break
    return row | {"seconds": time.monotonic() - began, "calls": calls}


def _run(batches: Iterator[pa.RecordBatch], make: Callable[[], Provider], schema: type[BaseModel], attempts: int, out: pa.Schema) -> Iterator[pa.RecordBatch]:
    try:
        provider, broken = make(), None
    except Exception as e:  # noqa: BLE001 - no provider: every document fails, the job does not
        provider, broken = None, str(e)
    names = out.names[-len(_ANSWER.split(", ")) :]
    for b in batches:
        answers = []
        for prompt, image, media in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("prompt", "image", "media_type")), strict=True):
            if prompt is None:
                answers.append({})
            elif provider is None:
                answers.append({"_ok": False, "_error": (VISION_FAILED if image is not None else FAILED) + broken, "attempt": 1, "calls": []})
            else:
                answers.append(asked(provider, prompt, image, media, schema, attempts))
        kept = [b.column(i) for i, n in enumerate(b.schema.names) if n not in ("prompt", "image")]
        more = [pa.array([x.get(n) for x in answers], out.field(n).type) for n in names]
        yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(kept, out, strict=False)), *more], names=out.names)


def extract(docs: DataFrame, schema: type[BaseModel], make: Callable[[], Provider], model: str, provider: str, vision: bool = True, doc_type: str | None = None, language: str = "en", max_chars: int | None = None, attempts: int = ATTEMPTS) -> DataFrame:
    """One result a document of :func:`ledgerloom.sources.documents.routed`, with its calls.

    Documents with an error already, and images for a model without vision, are
    not sent; a null text is sent as an empty one.  A provider that cannot be made
    (an unknown model, a missing key) fails every document that would be sent.
    Costs are null until :func:`charged`.  Write the result before using it twice:
    a second run would pay again.
    """
    kind = tx.given(F.lit(doc_type or ""), tx.document_type(F.lit(schema.__name__)))
    text = F.coalesce("text", F.lit(""))
    image = F.col("route") == "image"
    gate = F.when(F.col("error").isNull() & image & F.lit(not vision), F.lit(BLIND.format(model)))
    ready = docs.withColumn("error", F.coalesce("error", gate)).withColumn("_short", tx.truncated(text, max_chars)).withColumn("_cut", F.length("_short") < F.length(text))
    prompt = F.when(F.col("error").isNull(), F.when(image, schemas.vision_prompt(kind, schema)).otherwise(schemas.text_prompt(F.col("_short"), kind, schema)))
    carried = ready.select("ord", "document_id", "path", "file_size_bytes", "error", "route", "media_type", F.substring("_short", 1, 500).alias("_head"), "_cut", prompt.alias("prompt"), F.when(image & F.col("error").isNull(), F.col("content")).alias("image"))
    kinds = StructType([*carried.drop("prompt", "image").schema.fields, *StructType.fromDDL(_ANSWER).fields])
    arrow = to_arrow_schema(kinds)
    rows = carried.mapInArrow(lambda it: _run(it, make, schema, attempts, arrow), kinds)
    ok = F.coalesce("_ok", F.lit(False))
    strategy = tx.strategy(F.lit(provider))
    data = F.from_json("json", schemas.spark_schema(schema))
    metadata = F.map_filter(
        F.create_map(F.lit("model"), F.lit(model), F.lit("provider"), F.lit(provider), F.lit("attempt"), F.when(~image, F.col("attempt").cast("string")), F.lit("truncated"), F.when(~image, F.col("_cut").cast("string")), F.lit("vision"), F.when(image, "true"), F.lit("media_type"), F.when(image, F.col("media_type"))),
        lambda k, v: v.isNotNull(),
    )
    result = F.struct(
        ok.alias("success"), data.alias("data"), strategy.alias("strategy"), F.when(ok, tx.raw_prefix(F.when(image, F.col("response")).otherwise(F.col("_head")))).alias("raw_text"), F.when(ok, CONFIDENCE).otherwise(0.0).alias("confidence"), F.coalesce("seconds", F.lit(0.0)).alias("processing_time"),
        F.lit(None).cast("double").alias("cost"), F.coalesce(F.col("input_tokens") + F.col("output_tokens"), F.lit(0).cast("long")).alias("tokens_used"), F.coalesce("error", "_error").alias("error"), F.array().cast("array<string>").alias("warnings"), metadata.alias("metadata"), F.get("calls", F.size("calls") - 1)["timestamp"].alias("timestamp"),
    )
    return rows.select(
        "ord", ok.alias("success"), "document_id", kind.alias("document_type"), data.alias("data"), F.when(F.col("_ok").isNotNull(), F.array(result)).otherwise(F.array()).alias("extraction_results"), F.when(F.col("_ok").isNotNull(), strategy).alias("final_strategy"), F.when(ok, CONFIDENCE).otherwise(0.0).alias("final_confidence"),
        F.coalesce("seconds", F.lit(0.0)).alias("total_time"), F.coalesce("error", "_error").alias("error"), F.lit(False).alias("partial_result"), F.col("path").alias("file_path"), "file_size_bytes", F.lit(language).alias("language"), F.localtimestamp().alias("timestamp"),
        F.lit(None).cast("double").alias("total_cost"), F.lit(None).cast("map<string,double>").alias("cost_breakdown"), F.lit(None).cast("string").alias("validation"), F.coalesce("calls", F.array().cast(_CALLS)).alias("calls"),
    )


def call_rows(results: DataFrame, model: str, provider: str) -> DataFrame:
    """The ledger's rows of a written result, one a call: those of :mod:`ledgerloom.operators.ledger` and of the call log.

    ``call_id`` is a hash of the document's number and the attempt; a call's cost
    comes with :func:`ledgerloom.operators.ledger.priced`.
    """
    called = results.select("ord", "document_id", F.explode("calls").alias("c"))
    return called.select(F.xxhash64("ord", "c.attempt").alias("call_id"), "ord", F.col("c.attempt").alias("attempt"), F.col("c.timestamp").alias("timestamp"), F.lit(model).alias("model"), tx.strategy(F.lit(provider)).alias("strategy"), "c.input_tokens", "c.output_tokens", (F.col("c.input_tokens") + F.col("c.output_tokens")).alias("total_tokens"), "document_id", "c.success", "c.error")


def ledger_rows(calls: DataFrame, models: DataFrame, document_limit: int, day_limit: int | None = None, booked: DataFrame | None = None) -> DataFrame:
    """``calls`` (of :func:`call_rows`) with ``cost_units``, ``cost`` in USD, ``verdict`` and what a rejected call is told.

    A call that gave no answer costs nothing and is not booked; the other ones are
    admitted in order of time, after those ``booked`` before.  Rows whose verdict
    is ``admitted`` are the ledger.
    """
    calls = written(ledger.priced(calls.where("success"), models), "call-rows")
    columns = ("call_id", "timestamp", "document_id", "cost_units")
    before = calls.select(*columns) if booked is None else calls.select(*columns).unionByName(booked.where("verdict = 'admitted'").select(*columns))
    judged = ledger.admit_both(before, day_limit, document_limit)
    return calls.join(judged, "call_id").withColumn("cost", F.col("cost_units") / ledger.UNITS).withColumn("rejection", ledger.rejection(F.col("verdict"), day_limit, document_limit))


def charged(results: DataFrame, rows: DataFrame) -> DataFrame:
    """``results`` with costs from :func:`ledger_rows`, and failed where a call went over a limit.

    The cost of a success is that of the answer that was taken; a failed one has
    0, though its calls are booked.  Documents of which a call was rejected fail
    with what that call was told: no later attempt counts.
    """
    last = rows.groupBy("ord").agg(F.max_by("cost", "attempt").alias("_cost"), F.min_by("rejection", F.when(F.col("rejection").isNotNull(), F.col("attempt"))).alias("_rejected"))
    joined = results.join(last, "ord", "left")
    rejected = F.col("_rejected").isNotNull()
    ok = F.col("success") & ~rejected
    cost = F.when(ok, F.coalesce("_cost", F.lit(0.0))).otherwise(0.0)
    error = F.when(rejected, F.concat(F.lit(FAILED), F.col("_rejected"))).otherwise(F.col("error"))
    each = F.transform("extraction_results", lambda r: r.withField("cost", cost).withField("success", r["success"] & ~rejected).withField("error", F.when(rejected, error).otherwise(r["error"])).withField("data", F.when(~rejected, r["data"])).withField("confidence", F.when(rejected, 0.0).otherwise(r["confidence"])).withField("raw_text", F.when(~rejected, r["raw_text"])).withField("tokens_used", F.when(rejected, F.lit(0).cast("long")).otherwise(r["tokens_used"])))
    changed = {
        "success": ok, "data": F.when(~rejected, F.col("data")), "extraction_results": each, "final_confidence": F.when(rejected, 0.0).otherwise(F.col("final_confidence")), "error": error,
        "total_cost": cost, "cost_breakdown": F.when(F.col("final_strategy").isNotNull(), cost_breakdown(F.col("final_strategy"), cost)).otherwise(F.create_map().cast("map<string,double>")),
    }
    return joined.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in results.columns))
