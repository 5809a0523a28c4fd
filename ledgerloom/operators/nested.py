"""Deeply nested records as related flat tables (problem 2).

One pass over each record: a depth-first visitor emits a row per object with the
tag of its table, its own key, its parent's key and the rest of the object as
payload.  The rows are written partitioned by tag, and a schema is put on each
table when it is read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fields that hold items; those of an item are its components.
ITEM_FIELDS = ("line_items", "items", "components")
KEYS = "tag string, parent_table string, parent_id long, result_no int, item_no int, parent_item_no int"
ITEM = T.StructType().add("name", "string").add("amount", "double").add("quantity", "double").add("unit_price_with_taxes", "double").add("unit_price_without_taxes", "double").add("discount", "double").add("discount_percentage", "double").add("taxes", "double").add("taxes_percentage", "double")
#: Tag -> schema of its payload.
TABLES = {"invoice_item": ITEM, "receipt_item": ITEM, "result_item": ITEM, "component": ITEM}


def _items(value) -> list[dict]:
    """The item objects of one item field: a list, numbered objects, a single object, or JSON in a string."""
    if isinstance(value, str):
        try:
            value = json.loads(value)
        except (ValueError, RecursionError):
            return []
    if isinstance(value, dict):
        numbered = bool(value) and all(k.strip().isdigit() for k in value)
        value = list(value.values()) if numbered else [value] if value else []
    return [x for x in value if isinstance(x, dict)] if isinstance(value, list) else []


def visit(record) -> Iterator[tuple[int, int, dict]]:
    """``(item_no, parent_item_no, item)`` of every item, depth first, a parent before its components."""
    number = 0
    stack: list[tuple[object, int, bool]] = [(record, 0, False)]
    while stack:
        value, parent, is_item = stack.pop()
        if isinstance(value, list):
            stack.extend((x, parent, False) for x in reversed(value) if isinstance(x, dict | list))
            continue
        if is_item:
            number += 1
            yield number, parent, value
            parent = number
        inner: list[tuple[object, int, bool]] = []
        for key, x in value.items():
            if key in ITEM_FIELDS:
                inner.extend((item, parent, True) for item in _items(x))
            elif isinstance(x, dict | list):
                inner.append((x, parent, False))
        stack.extend(reversed(inner))


def _payload(item: dict) -> str:
    return json.dumps({k: v for k, v in item.items() if k not in ITEM_FIELDS}, ensure_ascii=False)


def json_items(records: DataFrame, payload: bool = True) -> DataFrame:
    """Rows of every item in ``records(parent_table, parent_id, result_no, data)``, ``data`` being JSON.

    Text that is no JSON, or nested beyond what can be read, gives one row of
    tag ``unreadable`` with item_no 0; a null gives none.
    """
    schema = KEYS + (", payload string" if payload else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["tag", "parent_table", "parent_id", "result_no", "item_no", "parent_item_no", "payload"][: 7 if payload else 6]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
        for b in batches:
            rows: list[tuple] = []
            for table, key, no, data in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if data is None:
                    continue
                try:
                    record = json.loads(data)
                except (ValueError, RecursionError):
                    rows.append(("unreadable", table, key, no, 0, 0, data))
                    continue
                if isinstance(record, dict | list):
                    for item_no, parent, item in visit(record):
                        rows.append(("component" if parent else "result_item", table, key, no, item_no, parent, _payload(item) if payload else None))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns[: len(names)], kinds, strict=False)], names=names)

    return records.select("parent_table", F.col("parent_id").cast("long"), F.col("result_no").cast("int"), F.col("data").cast("string")).mapInArrow(run, schema)


def column_items(records: DataFrame, key: str, items: str, parent_table: str, tag: str, payload: bool = True) -> DataFrame:
    """Rows of the items in a native array column; null elements are no items."""
    numbered = records.select(F.col(key).cast("long").alias("parent_id"), F.posexplode(F.filter(items, lambda x: x.isNotNull())).alias("at", "item"))
    rows = numbered.select(F.lit(tag).alias("tag"), F.lit(parent_table).alias("parent_table"), "parent_id", F.lit(0).alias("result_no"), (F.col("at") + 1).alias("item_no"), F.lit(0).alias("parent_item_no"), *([F.to_json("item").alias("payload")] if payload else []))
    return rows


def tagged_items(invoices: DataFrame, receipts: DataFrame, harvests: DataFrame, payload: bool = True) -> DataFrame:
    """All item rows of the three tables, tagged.

    Null and empty arrays, null results and null ``data`` give no rows; repeated
    input rows give repeated output rows; other columns are not looked at.
    """
    results = harvests.select(F.lit("harvests").alias("parent_table"), F.col("harvest_id").alias("parent_id"), F.posexplode("extraction_results").alias("result_no", "r")).select("parent_table", "parent_id", "result_no", F.col("r.data").alias("data"))
    return (
        column_items(invoices, "record_id", "line_items", "invoices", "invoice_item", payload)
        .unionByName(column_items(receipts, "record_id", "items", "receipts", "receipt_item", payload))
        .unionByName(json_items(results, payload))
    )


def write_tables(tagged: DataFrame, path: str) -> None:
    """One folder a tag, so that a reader of one table reads no other."""
    tagged.write.mode("overwrite").partitionBy("tag").parquet(path)


def read_table(spark, path: str, tag: str) -> DataFrame:
    """One table with its schema; what the schema lacks stays in ``rest``."""
    rows = spark.read.schema(KEYS + ", payload string").parquet(path).where(F.col("tag") == tag)
    parsed = F.from_json("payload", TABLES[tag])
    return rows.withColumn("item", parsed).select("parent_table", "parent_id", "result_no", "item_no", "parent_item_no", "item.*", F.col("payload").alias("rest"))
