"""Driver queries of the core and their SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import results, schemas
from ledgerloom.functions import text as tx
from ledgerloom.operators import extract, ledger, nested, timestamps, units
from ledgerloom.providers.base import StubProvider
from ledgerloom.plans import expected
from ledgerloom.session import new_path, table, written

AS_OF = datetime.datetime(2024, 12, 31)
TOTALS = ("total_calls", "cost_units", "total_tokens", "daily_cost_units", "daily_calls", "documents")
EXTRACT_LIMIT = 15_000
DOCUMENT_LIMIT, DAY_LIMIT = 4_000_000, 2_000_000  # 1e-8 USD


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return units.usd_cents(*(table(spark, root, t) for t in ("invoices", "receipts", "harvests", "source_systems", "currencies")))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    items = nested.tagged_items(*(table(spark, root, t) for t in ("invoices", "receipts", "harvests")), payload=False)
    return items.where("tag <> 'unreadable'").select("parent_table", "parent_id", "result_no", "item_no", "parent_item_no")


def _tables(spark: SparkSession, root: str) -> str:
    """All items with their payload, written partitioned by tag."""
    path = new_path(spark, "item-tables")
    nested.write_tables(nested.tagged_items(*(table(spark, root, t) for t in ("invoices", "receipts", "harvests"))), path)
    return path


def p2_items(spark: SparkSession, root: str) -> DataFrame:
    """The table of invoice items, from the tables written by tag."""
    return nested.read_table(spark, _tables(spark, root), "invoice_item").select("parent_id", "item_no", "name", "amount", "quantity")


def p2_tables(spark: SparkSession, root: str) -> DataFrame:
    """Rows, parents, named items and quantities of every table, each read back with its schema."""
    path, out = _tables(spark, root), None
    for tag in nested.TABLES:
        one = nested.read_table(spark, path, tag).agg(F.count("*").alias("items"), F.count_distinct("parent_table", "parent_id", "result_no").alias("parents"), F.count("name").alias("named"), F.coalesce(F.sum(F.round(F.col("quantity") * 100).cast("long")), F.lit(0).cast("long")).alias("hundredths")).select(F.lit(tag).alias("tag"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    systems = table(spark, root, "source_systems")
    return timestamps.days(table(spark, root, "invoices"), systems, ("date", "due_date")).unionByName(timestamps.instants(table(spark, root, "receipts"), systems))


def _calls(spark: SparkSession, root: str) -> DataFrame:
    return ledger.priced(ledger.distinct_calls(table(spark, root, "api_calls")), table(spark, root, "models"))


def _queries() -> dict:
    documents = lambda s, d: table(s, d, "documents").where("text is not null")
    paths = lambda s, d: table(s, d, "harvests").where("file_path is not null")
    return {
        "cost_by_model": lambda s, d: ledger.by_model(_calls(s, d)),
        "cost_by_strategy": lambda s, d: ledger.by_strategy(_calls(s, d)),
        "daily_cost": lambda s, d: ledger.by_day(_calls(s, d)),
        "document_cost": lambda s, d: ledger.by_document(_calls(s, d)),
        "call_cost": lambda s, d: _calls(s, d).select("call_id", "model", "cost_units"),
        "ledger_totals": lambda s, d: ledger.totals(_calls(s, d), F.lit(AS_OF)).select(*TOTALS, F.floor("average_units").alias("average_units"), *(F.to_json(F.col(c)).alias(c) for c in ("calls_by_model", "cost_units_by_model"))),
        "cost_report": lambda s, d: ledger.report(_calls(s, d), F.lit(AS_OF), 90).withColumn("average_units", F.floor("average_units")).withColumn("cost_units_by_strategy", F.to_json("cost_units_by_strategy")),
        "admit_per_document": lambda s, d: ledger.admit(_calls(s, d), F.col("document_id"), DOCUMENT_LIMIT),
        "admit_daily": lambda s, d: ledger.admit(_calls(s, d), F.to_date("timestamp"), DAY_LIMIT),
        "admit_both": lambda s, d: ledger.admit_both(_calls(s, d), DAY_LIMIT, DOCUMENT_LIMIT),
        "truncate_documents": lambda s, d: documents(s, d).select("doc_id", F.length(tx.truncated(F.col("text"))).alias("chars"), F.md5(tx.truncated(F.col("text"))).alias("digest"), tx.was_truncated(F.col("text")).alias("was_truncated")),
        "raw_prefix": lambda s, d: documents(s, d).select("doc_id", F.md5(tx.raw_prefix(F.col("text"))).alias("digest")),
        "json_span": lambda s, d: documents(s, d).select("doc_id", F.md5(tx.json_span(F.col("text"))).alias("digest"), F.length(tx.json_span(F.col("text"))).alias("chars")),
        "file_identity": lambda s, d: paths(s, d).select("harvest_id", tx.base_name(F.col("file_path")).alias("base"), tx.stem(F.col("file_path")).alias("stem"), tx.extension(F.col("file_path")).alias("ext"), tx.media_type(F.col("file_path")).alias("media_type"), tx.route(F.col("file_path")).alias("route")),
        "text_prompt": lambda s, d: documents(s, d).select("doc_id", F.md5(schemas.text_prompt(F.col("text"), tx.document_type(F.lit("InvoiceData")), schemas.InvoiceData)).alias("digest")),
        "vision_prompt": lambda s, d: table(s, d, "harvests").select(F.coalesce("document_type", F.lit("document")).alias("t")).distinct().select("t", F.md5(schemas.vision_prompt(F.col("t"), schemas.ReceiptData)).alias("digest")),
        "model_catalog": lambda s, d: table(s, d, "models").select("name", "provider", "model_id", tx.strategy(F.col("provider")).alias("strategy"), "supports_vision"),
        "models_by_provider": lambda s, d: table(s, d, "models").groupBy("provider").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("names")),
        "strategy_success": lambda s, d: table(s, d, "harvests").select("harvest_id", F.size("extraction_results").alias("results"), F.size(F.filter("extraction_results", lambda r: r["success"])).alias("successes")).where("results >= 0"),
        "cost_breakdown": lambda s, d: table(s, d, "harvests").where("final_strategy is not null").select("harvest_id", F.explode(results.cost_breakdown(F.col("final_strategy"), F.col("total_cost"))).alias("strategy", "cost")),
        "confidence_by_strategy": lambda s, d: table(s, d, "harvests").where("final_strategy is not null").groupBy("final_strategy").agg(F.count("*").alias("harvests"), F.count(F.when(results.high_confidence(F.col("success"), F.col("final_confidence")), 1)).alias("high")),
        "document_types": lambda s, d: table(s, d, "harvests").select(tx.given(F.col("document_type"), tx.document_type(F.lit("IDDocumentOutput"))).alias("document_type")).groupBy("document_type").agg(F.count("*").alias("n")),
        "success_share": lambda s, d: table(s, d, "harvests").select("harvest_id", results.success_share(F.col("extraction_results")).alias("share")),
        "result_summary": lambda s, d: table(s, d, "harvests").select("harvest_id", results.summary(*(F.col(c) for c in ("success", "document_id", "document_type", "final_strategy", "final_confidence", "error"))).alias("line")),
        "free_success_share": lambda s, d: table(s, d, "harvests").select("harvest_id", results.free_success_share(F.col("extraction_results")).alias("share")),
        "cost_of_documents": lambda s, d: ledger.document_cost(_calls(s, d), table(s, d, "harvests").select("document_id").where("document_id is not null").distinct()),
        "extract_stub": extract_stub, "extract_retry": extract_retry, "extract_ledger": extract_ledger,
    }


def _notes(spark: SparkSession, root: str) -> DataFrame:
    """Notes of invoices as documents."""
    return table(spark, root, "invoices").where("notes is not null").select(F.col("record_id").alias("ord"), F.lit(None).cast("string").alias("path"), F.lit("t.txt").alias("filename"), "document_id", F.lit(None).cast("binary").alias("content"), F.col("notes").alias("text"), F.octet_length("notes").cast("long").alias("file_size_bytes"), F.lit(None).cast("string").alias("error"), F.lit("text").alias("route"), F.lit(None).cast("string").alias("media_type"))


def _stub() -> StubProvider:
    return StubProvider(lambda p: f'Here: {{"invoice_number": "N{len(p) % 97}", "total_amount": "{len(p)}.5"}} done')


def extract_stub(spark: SparkSession, root: str) -> DataFrame:
    """Notes of invoices through the whole extraction with a provider that answers from the prompt's length."""
    out = extract.extract(_notes(spark, root), schemas.InvoiceData, _stub, "stub", "ollama")
    return out.select(F.col("ord").alias("record_id"), "success", "document_type", F.col("data.invoice_number").alias("invoice_number"), F.col("data.total_amount").alias("total_amount"), F.size("calls").alias("calls"))


def extract_retry(spark: SparkSession, root: str) -> DataFrame:
    """The same with answers that are no record, no JSON, or none at all, by the prompt's length."""

    def answer(p: str) -> str:
        kind = len(p) % 4
        if kind == 3:
            raise RuntimeError("down")
        return ('{"total_amount": "1.5"}', '{"total_amount": "much"}', "no answer")[kind]

    out = extract.extract(_notes(spark, root), schemas.InvoiceData, lambda: StubProvider(answer), "stub", "openai")
    return out.select(F.col("ord").alias("record_id"), "success", F.size("calls").alias("calls"), F.regexp_extract("error", "^(?:Extraction failed: Failed to parse JSON|Extraction failed: down|Validation failed after 3 attempts)", 0).alias("error"))


def extract_ledger(spark: SparkSession, root: str) -> DataFrame:
    """From extraction to the ledger: costs, rejections over a document's limit, failed results; calls are taken in order of record_id."""
    out = written(extract.extract(_notes(spark, root), schemas.InvoiceData, _stub, "quill-mini", "anthropic"), "extracted")
    calls = extract.call_rows(out, "quill-mini", "anthropic").withColumn("timestamp", F.timestamp_seconds("ord").cast("timestamp_ntz"))
    rows = written(extract.ledger_rows(calls, table(spark, root, "models"), EXTRACT_LIMIT), "extracted-ledger")
    done = extract.charged(out, rows).select("ord", "success", "total_cost", "error", F.try_element_at("cost_breakdown", F.lit("llm_anthropic")).alias("by_strategy"))
    return done.join(rows.select("ord", "cost_units", "verdict"), "ord").select(F.col("ord").alias("record_id"), "success", "cost_units", "verdict", "total_cost", "by_strategy", "error")


def queries() -> dict:
    return {"p1_found": p1_found, "p2_found": p2_found, "p5_found": p5_found, "p2_items": p2_items, "p2_tables": p2_tables} | _queries()


_PRICED = """WITH c AS (SELECT DISTINCT * FROM api_calls), p AS (SELECT name, CAST(round(input_price * 100) AS BIGINT) AS i, CAST(round(output_price * 100) AS BIGINT) AS o FROM models),
calls AS (SELECT c.*, coalesce(c.input_tokens * p.i + c.output_tokens * p.o, 0)::BIGINT AS cost_units FROM c LEFT JOIN p ON c.model = p.name)"""
_HEAD = "Extract structured data from this "


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _admit_sql(key: str, limit: int) -> str:
    return f"""{_PRICED.replace("WITH", "WITH RECURSIVE", 1)},
    k AS (SELECT {key} AS key, call_id, cost_units, row_number() OVER (PARTITION BY {key} ORDER BY timestamp, call_id) AS rn FROM calls),
    f AS (SELECT key, call_id, rn, (cost_units <= {limit}) AS admitted, CASE WHEN cost_units <= {limit} THEN cost_units ELSE 0 END AS spent FROM k WHERE rn = 1 AND key IS NOT NULL AND key <> ''
      UNION ALL SELECT k.key, k.call_id, k.rn, (f.spent + k.cost_units <= {limit}), CASE WHEN f.spent + k.cost_units <= {limit} THEN f.spent + k.cost_units ELSE f.spent END FROM f JOIN k ON k.key = f.key AND k.rn = f.rn + 1)
    SELECT call_id, admitted FROM f UNION ALL SELECT call_id, true FROM k WHERE key IS NULL OR key = ''"""


def oracle_sql() -> dict[str, str]:
    ask, vision = expected.TEXT_PROMPT, expected.VISION_PROMPT
    asked = f"{len(_HEAD + 'invoice' + ask) + len(expected.TEXT_END)} + length({{}})"
    stamp = f"TIMESTAMP '{AS_OF}'"
    note = "chr(10) || chr(10) || '[... ' || (length(substr(text, 4801, length(text) - 7200)) - length(replace(substr(text, 4801, length(text) - 7200), chr(10), ''))) || ' lines removed (' || (length(text) - 7200) || ' chars) ...]' || chr(10) || chr(10)"
    cut = f"CASE WHEN length(text) <= 8000 THEN text ELSE substr(text, 1, 4800) || {note} || right(text, 2400) END"
    brace = "CASE WHEN position('{' IN text) > 0 AND position('}' IN substr(text, position('{' IN text))) > 0 THEN substr(text, position('{' IN text), length(text) - position('}' IN reverse(text)) + 2 - position('{' IN text)) ELSE text END"
    base = "regexp_extract(file_path, '([^/]*)/*$', 1)"
    ext = f"lower(regexp_extract({base}, '^.+(\\.[^.]+)$', 1))"
    return {
        "cost_by_model": f"{_PRICED} SELECT model, count(*) AS calls, sum(cost_units)::BIGINT AS cost_units, sum(total_tokens)::BIGINT AS tokens FROM calls GROUP BY model",
        "cost_by_strategy": f"{_PRICED} SELECT strategy, count(*) AS calls, sum(cost_units)::BIGINT AS cost_units FROM calls GROUP BY strategy",
        "daily_cost": f"{_PRICED} SELECT CAST(timestamp AS DATE) AS day, count(*) AS calls, sum(cost_units)::BIGINT AS cost_units FROM calls GROUP BY 1",
        "document_cost": f"{_PRICED} SELECT document_id, count(*) AS calls, sum(cost_units)::BIGINT AS cost_units FROM calls WHERE document_id IS NOT NULL AND document_id <> '' GROUP BY 1",
        "call_cost": f"{_PRICED} SELECT call_id, model, cost_units FROM calls",
        "ledger_totals": f"{_PRICED} SELECT count(*) AS total_calls, coalesce(sum(cost_units), 0)::BIGINT AS cost_units, coalesce(sum(total_tokens), 0)::BIGINT AS total_tokens, coalesce(sum(cost_units) FILTER (timestamp::DATE = {stamp}::DATE), 0)::BIGINT AS daily_cost_units, count(*) FILTER (timestamp::DATE = {stamp}::DATE) AS daily_calls, count(DISTINCT nullif(document_id, '')) AS documents, floor(CASE WHEN count(DISTINCT nullif(document_id, '')) > 0 THEN coalesce(sum(cost_units), 0) / count(DISTINCT nullif(document_id, '')) ELSE 0 END)::BIGINT AS average_units, (SELECT chr(123) || coalesce(string_agg(chr(34) || m || chr(34) || ':' || n, ',' ORDER BY m), '') || chr(125) FROM (SELECT coalesce(model, '?') AS m, count(*) AS n FROM calls GROUP BY 1)) AS calls_by_model, (SELECT chr(123) || coalesce(string_agg(chr(34) || m || chr(34) || ':' || n, ',' ORDER BY m), '') || chr(125) FROM (SELECT coalesce(model, '?') AS m, sum(cost_units)::BIGINT AS n FROM calls GROUP BY 1)) AS cost_units_by_model FROM calls",
        "cost_report": f"{_PRICED}, r AS (SELECT * FROM calls WHERE timestamp >= {stamp} - INTERVAL 90 DAYS), d AS (SELECT document_id, bool_and(success) AS ok FROM r WHERE document_id IS NOT NULL AND document_id <> '' GROUP BY 1) SELECT (SELECT count(*) FROM d) AS total_documents, (SELECT count(*) FROM d WHERE ok) AS successful_documents, (SELECT count(*) FROM d WHERE ok IS NOT TRUE) AS failed_documents, count(*) AS calls, coalesce(sum(cost_units), 0)::BIGINT AS cost_units, count(*) FILTER (strategy LIKE '%ollama' AND success) AS free_successes, (SELECT floor(CASE WHEN count(*) > 0 THEN (SELECT sum(cost_units) FROM r) / count(*) ELSE 0 END)::BIGINT FROM d) AS average_units, (SELECT chr(123) || coalesce(string_agg(chr(34) || m || chr(34) || ':' || n, ',' ORDER BY m), '') || chr(125) FROM (SELECT coalesce(strategy, '?') AS m, sum(cost_units)::BIGINT AS n FROM r GROUP BY 1)) AS cost_units_by_strategy FROM r",
        "admit_per_document": _admit_sql("document_id", DOCUMENT_LIMIT),
        "admit_daily": _admit_sql("CAST(timestamp::DATE AS VARCHAR)", DAY_LIMIT),
        "truncate_documents": f"SELECT doc_id, length({cut})::INT AS chars, md5({cut}) AS digest, length({cut}) < length(text) AS was_truncated FROM documents WHERE text IS NOT NULL",
        "raw_prefix": "SELECT doc_id, md5(substr(text, 1, 500)) AS digest FROM documents WHERE text IS NOT NULL",
        "json_span": f"SELECT doc_id, md5({brace}) AS digest, length({brace})::INT AS chars FROM documents WHERE text IS NOT NULL",
        "file_identity": f"SELECT harvest_id, {base} AS base, CASE WHEN {ext} = '' THEN {base} ELSE regexp_extract({base}, '^(.+)\\.[^.]+$', 1) END AS stem, {ext} AS ext, CASE WHEN file_path = '' THEN 'image/jpeg' WHEN {ext} = '.jpg' THEN 'image/jpeg' ELSE 'image/' || replace({ext}, '.', '') END AS media_type, CASE WHEN {ext} IN ('.jpg', '.jpeg', '.png', '.gif', '.webp') THEN 'image' WHEN {ext} IN ('.txt', '.pdf') THEN 'text' END AS route FROM harvests WHERE file_path IS NOT NULL",
        "text_prompt": f"SELECT doc_id, md5({_sql_text(_HEAD + 'invoice' + ask)} || text || {_sql_text(expected.TEXT_END)}) AS digest FROM documents WHERE text IS NOT NULL",
        "vision_prompt": f"SELECT t, md5({_sql_text(_HEAD)} || t || {_sql_text(vision)}) AS digest FROM (SELECT DISTINCT coalesce(document_type, 'document') AS t FROM harvests)",
        "model_catalog": "SELECT name, provider, model_id, CASE WHEN provider IN ('anthropic', 'openai', 'ollama') THEN 'llm_' || provider ELSE 'llm_anthropic' END AS strategy, supports_vision FROM models",
        "models_by_provider": "SELECT provider, string_agg(name, ',' ORDER BY name) AS names FROM models GROUP BY provider",
        "strategy_success": "SELECT harvest_id, len(extraction_results)::INT AS results, len(list_filter(extraction_results, lambda r: r.success))::INT AS successes FROM harvests WHERE extraction_results IS NOT NULL",
        "cost_breakdown": "SELECT harvest_id, final_strategy AS strategy, total_cost AS cost FROM harvests WHERE final_strategy IS NOT NULL",
        "confidence_by_strategy": "SELECT final_strategy, count(*) AS harvests, count(*) FILTER (success AND final_confidence >= 0.8) AS high FROM harvests WHERE final_strategy IS NOT NULL GROUP BY 1",
        "document_types": "SELECT coalesce(nullif(document_type, ''), 'i_d_document') AS document_type, count(*) AS n FROM harvests GROUP BY 1",
        "success_share": "SELECT harvest_id, CASE WHEN len(extraction_results) > 0 THEN len(list_filter(extraction_results, lambda r: r.success)) / len(extraction_results) ELSE 0.0 END AS share FROM harvests",
        "result_summary": "SELECT harvest_id, printf('%s %s (%s) %s %.2f%%', CASE WHEN success THEN 'SUCCESS' ELSE 'FAILED' END, coalesce(document_id, '?'), coalesce(document_type, '?'), coalesce(final_strategy, 'N/A'), coalesce(final_confidence, 0.0) * 100) || coalesce(' Error: ' || error, '') AS line FROM harvests",
        "extract_stub": f"SELECT record_id, true AS success, 'invoice' AS document_type, 'N' || (n % 97) AS invoice_number, n + 0.5::DOUBLE AS total_amount, 1::INT AS calls FROM (SELECT record_id, {asked.format(cut.replace('text', 'notes'))} AS n FROM invoices WHERE notes IS NOT NULL)",
        "extract_retry": f"SELECT record_id, n % 4 = 0 AS success, CASE n % 4 WHEN 1 THEN 3 ELSE 1 END::INT AS calls, CASE n % 4 WHEN 1 THEN 'Validation failed after 3 attempts' WHEN 2 THEN 'Extraction failed: Failed to parse JSON' WHEN 3 THEN 'Extraction failed: down' END AS error FROM (SELECT record_id, {asked.format(cut.replace('text', 'notes'))} AS n FROM invoices WHERE notes IS NOT NULL)",
        "extract_ledger": f"""WITH RECURSIVE n AS (SELECT record_id, document_id, {asked.format(cut.replace('text', 'notes'))} AS n FROM invoices WHERE notes IS NOT NULL),
    c AS (SELECT record_id, document_id, ((n // 4) * CAST(round(input_price * 100) AS BIGINT) + (length('Here: {{"invoice_number": "N' || (n % 97) || '", "total_amount": "' || n || '.5"}} done') // 4) * CAST(round(output_price * 100) AS BIGINT))::BIGINT AS cost_units FROM n, models WHERE name = 'quill-mini'),
    k AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY record_id) AS rn FROM c),
    f AS (SELECT document_id, record_id, rn, cost_units, cost_units <= {EXTRACT_LIMIT} AS ok, CASE WHEN cost_units <= {EXTRACT_LIMIT} THEN cost_units ELSE 0 END AS spent FROM k WHERE rn = 1 AND document_id <> ''
      UNION ALL SELECT k.document_id, k.record_id, k.rn, k.cost_units, f.spent + k.cost_units <= {EXTRACT_LIMIT}, CASE WHEN f.spent + k.cost_units <= {EXTRACT_LIMIT} THEN f.spent + k.cost_units ELSE f.spent END FROM f JOIN k ON k.document_id = f.document_id AND k.rn = f.rn + 1),
    v AS (SELECT record_id, cost_units, ok FROM f UNION ALL SELECT record_id, cost_units, true FROM k WHERE document_id IS NULL OR document_id = '')
    SELECT record_id, ok AS success, cost_units, CASE WHEN ok THEN 'admitted' ELSE 'document' END AS verdict, CASE WHEN ok THEN cost_units / 1e8 ELSE 0.0 END AS total_cost, CASE WHEN ok THEN cost_units / 1e8 ELSE 0.0 END AS by_strategy, CASE WHEN NOT ok THEN 'Extraction failed: Per-document limit of $0.00 would be exceeded' END AS error FROM v""",
        "free_success_share": "SELECT harvest_id, 0.0::DOUBLE AS share FROM harvests",
        "cost_of_documents": f"{_PRICED} SELECT d.document_id, coalesce(sum(cost_units), 0)::BIGINT AS cost_units FROM (SELECT DISTINCT document_id FROM harvests WHERE document_id IS NOT NULL) d LEFT JOIN calls ON calls.document_id = d.document_id AND d.document_id <> '' GROUP BY 1",
        "admit_both": f"""{_PRICED.replace("WITH", "WITH RECURSIVE", 1)},
    k AS MATERIALIZED (SELECT timestamp::DATE AS day, CASE WHEN sum(cost_units) OVER (PARTITION BY document_id) > {DOCUMENT_LIMIT} THEN coalesce(document_id, '') ELSE '' END AS doc, call_id, cost_units AS c, row_number() OVER (ORDER BY timestamp, call_id) AS rn FROM calls),
    f AS (SELECT 0::BIGINT AS rn, NULL::BIGINT AS call_id, NULL::DATE AS day, 0::BIGINT AS today, MAP([]::VARCHAR[], []::BIGINT[]) AS docs, '' AS verdict
      UNION ALL SELECT rn, call_id, day, before + CASE verdict WHEN 'admitted' THEN c ELSE 0 END, CASE WHEN verdict = 'admitted' AND doc <> '' AND c > 0 THEN map_concat(docs, MAP([doc], [spent + c])) ELSE docs END, verdict
      FROM (SELECT *, CASE WHEN before + c > {DAY_LIMIT} THEN 'daily' WHEN doc <> '' AND spent + c > {DOCUMENT_LIMIT} THEN 'document' ELSE 'admitted' END AS verdict
        FROM (SELECT k.*, f.docs, CASE WHEN k.day = f.day THEN f.today ELSE 0 END AS before, coalesce(f.docs[k.doc], 0) AS spent FROM f JOIN k ON k.rn = f.rn + 1)))
    SELECT call_id, verdict FROM f WHERE rn > 0""",
        "p2_items": "SELECT record_id AS parent_id, row_number() OVER (PARTITION BY record_id ORDER BY pos)::INT AS item_no, i.name AS name, i.amount AS amount, i.quantity AS quantity FROM (SELECT record_id, unnest(line_items) AS i, generate_subscripts(line_items, 1) AS pos FROM invoices) WHERE i IS NOT NULL",
    }
