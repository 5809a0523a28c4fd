"""The ledger of calls: costs, admission in call order, statistics and reports.

Costs are whole numbers of 1e-8 USD: tokens times cents a million tokens.  Sums
are exact and do not depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import bounded, written

#: 1e-8 USD in one USD.
UNITS = 100_000_000
#: Rounds of :func:`admit` that settle ranges of time in parallel before what is left is taken call by call.
ROUNDS = 4
#: More days than this are not broadcast (a century has 36,525).
MOST_DAYS = 40_000


def distinct_calls(calls: DataFrame, key: str = "call_id") -> DataFrame:
    """Calls without repeated deliveries of a whole row; two rows of one key that differ anywhere both stay.

    Rows are told apart by their key and a hash of all columns, so that only the
    columns a query needs are shuffled.
    """
    return calls.withColumn("_row", F.xxhash64(*calls.columns)).dropDuplicates([key, "_row"]).drop("_row")


def priced(calls: DataFrame, models: DataFrame) -> DataFrame:
    """``calls`` with ``cost_units``; a model that is not listed costs nothing."""
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    price = models.select(F.col("name").alias("_model"), cents("input_price").alias("_in"), cents("output_price").alias("_out"))
    joined = calls.join(bounded(price), F.col("model") == F.col("_model"), "left")
    units = F.coalesce(F.col("input_tokens") * F.col("_in") + F.col("output_tokens") * F.col("_out"), F.lit(0).cast("long"))
    return joined.withColumn("cost_units", units).drop("_model", "_in", "_out")


def by_model(calls: DataFrame) -> DataFrame:
    return calls.groupBy("model").agg(F.count("*").alias("calls"), F.sum("cost_units").alias("cost_units"), F.sum("total_tokens").alias("tokens"))


def by_strategy(calls: DataFrame) -> DataFrame:
    return calls.groupBy("strategy").agg(F.count("*").alias("calls"), F.sum("cost_units").alias("cost_units"))


def by_day(calls: DataFrame) -> DataFrame:
    return calls.groupBy(F.to_date("timestamp").alias("day")).agg(F.count("*").alias("calls"), F.sum("cost_units").alias("cost_units"))


def _named(calls: DataFrame) -> DataFrame:
    return calls.where(F.col("document_id").isNotNull() & (F.col("document_id") != ""))


def by_document(calls: DataFrame) -> DataFrame:
    return _named(calls).groupBy("document_id").agg(F.count("*").alias("calls"), F.sum("cost_units").alias("cost_units"))


def document_cost(calls: DataFrame, documents: DataFrame) -> DataFrame:
    """``documents(document_id)`` with ``cost_units``; 0 for one without calls."""
    return documents.select("document_id").join(by_document(calls), "document_id", "left").select("document_id", F.coalesce("cost_units", F.lit(0).cast("long")).alias("cost_units"))


def _map(key: str, value: str, kept: Column) -> Column:
    """An aggregate: the map of ``key`` to ``value`` of the ``kept`` rows, in order of the key; a null key is ``?``."""
    entry = F.when(kept, F.struct(F.coalesce(key, F.lit("?")).alias("k"), F.col(value).alias("v")))
    return F.map_from_entries(F.array_sort(F.collect_list(entry))).alias(f"{value}_by_{key}")


def totals(calls: DataFrame, as_of: Column) -> DataFrame:
    """One row: all calls, those of the day of ``as_of``, documents, average cost of a document, calls and cost by model.

    One pass: calls are added up by document, model and day, these by document
    and by model as grouping sets; the maps have an entry a model.
    """
    today = (F.to_date("timestamp") == F.to_date(as_of)).alias("today")
    part = calls.groupBy(F.nullif("document_id", F.lit("")).alias("document_id"), "model", today).agg(F.count("*").alias("calls"), F.sum("cost_units").alias("cost_units"), F.sum("total_tokens").alias("tokens"))
    daily = [F.sum(F.when(F.col("today"), F.col(c))).alias(f"daily_{c}") for c in ("calls", "cost_units")]
    sets = part.groupingSets([["document_id"], ["model"]], "document_id", "model").agg(F.grouping("document_id").alias("g"), *(F.sum(c).alias(c) for c in ("calls", "cost_units", "tokens")), *daily)
    model, zero = F.col("g") == 1, F.lit(0).cast("long")
    sums = [F.coalesce(F.sum(F.when(model, F.col(c))), zero).alias(c) for c in ("calls", "cost_units", "tokens", "daily_calls", "daily_cost_units")]
    one = sets.agg(*sums, F.count(F.when(~model, F.col("document_id"))).alias("documents"), _map("model", "calls", model), _map("model", "cost_units", model))
    average = F.when(F.col("documents") > 0, F.col("cost_units") / F.col("documents")).otherwise(0.0)
    return one.select(F.col("calls").alias("total_calls"), "cost_units", F.col("tokens").alias("total_tokens"), "daily_cost_units", "daily_calls", "documents", average.alias("average_units"), "calls_by_model", "cost_units_by_model")


def report(calls: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """One row over the last days: documents, those without a failed call, calls, cost, average and cost by strategy.

    One pass: calls are added up by document and strategy, these by document and
    by strategy as grouping sets.
    """
    recent = calls.where(F.col("timestamp") >= as_of - F.expr(f"INTERVAL {int(days)} DAYS"))
    free = F.col("strategy").endswith("ollama") & F.col("success")
    part = recent.groupBy(F.nullif("document_id", F.lit("")).alias("document_id"), "strategy").agg(F.count("*").alias("calls"), F.sum("cost_units").alias("cost_units"), F.count(F.when(free, 1)).alias("free"), F.bool_and(F.coalesce("success", F.lit(False))).alias("ok"))
    sets = part.groupingSets([["document_id"], ["strategy"]], "document_id", "strategy").agg(F.grouping("document_id").alias("g"), F.bool_and("ok").alias("ok"), *(F.sum(c).alias(c) for c in ("calls", "cost_units", "free")))
    strategy, zero = F.col("g") == 1, F.lit(0).cast("long")
    named = ~strategy & F.col("document_id").isNotNull()
    one = sets.agg(F.count(F.when(named, 1)).alias("total_documents"), F.count(F.when(named & F.col("ok"), 1)).alias("successful_documents"), *(F.coalesce(F.sum(F.when(strategy, F.col(c))), zero).alias(c) for c in ("calls", "cost_units", "free")), _map("strategy", "cost_units", strategy))
    average = F.when(F.col("total_documents") > 0, F.col("cost_units") / F.col("total_documents")).otherwise(0.0)
    return one.select("total_documents", "successful_documents", (F.col("total_documents") - F.col("successful_documents")).alias("failed_documents"), "calls", "cost_units", F.col("free").alias("free_successes"), average.alias("average_units"), "cost_units_by_strategy")


def summary_lines(stats: dict, day_limit_units: int | None = None) -> list[str]:
    """The row of :func:`totals` for people; with a limit of the day, what is left of it."""
    usd = lambda u: f"{u / UNITS:.4f}"
    out = [f"total: {usd(stats['cost_units'])} USD, {stats['total_calls']} calls, {stats['total_tokens']} tokens", f"documents: {stats['documents']}, {usd(stats['average_units'])} USD each", f"today: {usd(stats['daily_cost_units'])} USD, {stats['daily_calls']} calls"]
    out += [f"  {m}: {n} calls, {usd(stats['cost_units_by_model'][m])} USD" for m, n in sorted(stats["calls_by_model"].items())]
    if day_limit_units:
        out.append(f"limit of the day: {usd(day_limit_units - stats['daily_cost_units'])} USD left, {100 * stats['daily_cost_units'] / day_limit_units:.1f} % used")
    return out


def _fold(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Rows ``(key, call_id, cost_units, before)`` in order; ``before`` is what the key has spent when its first row comes."""
    key, spent = None, 0
    for b in batches:
        names, ids, costs, before = (b.column(i).to_pylist() for i in range(4))
        admitted, after = [], []
        for k, cost, start in zip(names, costs, before, strict=True):
            if k != key:
                key, spent = k, start
            ok = spent + cost <= limit
            if ok:
                spent += cost
            admitted.append(ok)
            after.append(spent)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(ids, pa.int64()), pa.array(admitted, pa.bool_()), pa.array(after, pa.int64())], names=["key", "call_id", "admitted", "spent"])


def _folded(rows: DataFrame, limit: int) -> DataFrame:
    ordered = rows.repartition("key").sortWithinPartitions("key", "timestamp", "call_id").select("key", "call_id", "cost_units", "spent")
    return ordered.mapInArrow(lambda it: _fold(it, limit), "key string, call_id long, admitted boolean, spent long")


def admit(calls: DataFrame, key: Column, limit_units: int, span: str = "HOUR") -> DataFrame:
    """``(call_id, admitted)``: a call is admitted if its key's admitted cost stays within the limit.

    A rejected call spends nothing, so this is a fold and no running sum; calls
    are taken by time and id.  What needs no order is settled before: calls
    without a key and free ones are admitted, those dearer than the limit are not,
    and all others of a key whose whole cost fits are.  The rest goes by ranges of time (``span``), whose sums are added up in
    parallel.  Ranges before the first that goes over a key's limit are admitted
    as they are; that one is folded call by call; of the later calls those dearer
    than what is then left are rejected, and the others begin anew.  A hot key so
    never is one task.  What ``ROUNDS`` leave is folded in order.
    """
    rows = calls.select(key.cast("string").alias("key"), "timestamp", F.col("call_id").cast("long"), "cost_units")
    keyless = F.col("key").isNull() | (F.col("key") == "")
    plain = F.when(keyless | (F.col("cost_units") == 0), True).when(F.col("cost_units") > limit_units, False)
    told = written(rows.withColumn("admitted", plain).withColumn("range", F.date_trunc(span, "timestamp")), "admission")
    tight = written(told.where("admitted is null").groupBy("key").agg(F.sum("cost_units").alias("c")).where(F.col("c") > limit_units).select("key", F.lit(True).alias("tight")), "admission-tight")
    marked = told.join(bounded(tight), "key", "left")
    out = marked.where("admitted is not null or tight is null").select("call_id", F.coalesce("admitted", F.lit(True)).alias("admitted"))
    if not tight.limit(1).count():
        return out
    open_ = marked.where("admitted is null and tight").select("key", "range", "timestamp", "call_id", "cost_units", F.lit(0).cast("long").alias("spent"))
    for _ in range(ROUNDS):
        sums = open_.groupBy("key", "range").agg(F.sum("cost_units").alias("cost"), F.first("spent").alias("spent"))
        ordered = Window.partitionBy("key").orderBy("range")
        state = sums.withColumn("after", F.col("spent") + F.sum("cost").over(ordered)).withColumn("over", F.min(F.when(F.col("after") > limit_units, F.col("range"))).over(Window.partitionBy("key")))
        state = state.select("key", "range", "over", (F.col("after") - F.col("cost")).alias("before"))
        placed = written(open_.drop("spent").join(state, ["key", "range"]), "admission-ranges")
        out = out.unionByName(placed.where("over is null or range < over").select("call_id", F.lit(True).alias("admitted")))
        folded = written(_folded(placed.where("range = over").withColumnRenamed("before", "spent"), limit_units), "admission-folded")
        out = out.unionByName(folded.select("call_id", "admitted"))
        left = folded.groupBy("key").agg(F.max("spent").alias("spent"))
        later = placed.where("range > over").select("key", "range", "timestamp", "call_id", "cost_units").join(left, "key")
        out = out.unionByName(later.where(F.col("cost_units") + F.col("spent") > limit_units).select("call_id", F.lit(False).alias("admitted")))
        open_ = written(later.where(F.col("cost_units") + F.col("spent") <= limit_units), "admission-left")
        if not open_.limit(1).count():
            return out
    return out.unionByName(_folded(open_, limit_units).select("call_id", "admitted"))


def _fold_both(batches: Iterator[pa.RecordBatch], day_limit: int | None, document_limit: int) -> Iterator[pa.RecordBatch]:
    part, day, today, by_doc = None, None, 0, {}
    for b in batches:
        out = []
        for p, d, doc, cost in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
            if p != part:
                part, day, today, by_doc = p, None, 0, {}
            if d != day:
                day, today = d, 0
            if day_limit is not None and today + cost > day_limit:
                out.append("daily")
            elif doc and by_doc.get(doc, 0) + cost > document_limit:
                out.append("document")
            else:
                today += cost
                if doc:
                    by_doc[doc] = by_doc.get(doc, 0) + cost
                out.append("admitted")
        yield pa.RecordBatch.from_arrays([b.column(3), pa.array(out, pa.string())], names=["call_id", "verdict"])


def admit_both(calls: DataFrame, day_limit: int | None, document_limit: int) -> DataFrame:
    """``(call_id, verdict)`` under both limits; the day's is looked at first, and none or 0 means there is none.

    Days whose whole cost fits the day's limit, and documents whose whole cost
    fits theirs, can never reject: calls of such a document on such a day are
    admitted at once, as are free ones.  The others fall into parts that share
    neither a day nor a document that can reject: each is folded in order, the
    parts beside each other.  Parts are found over the days, of which there are
    as many as the calendar has.
    """
    day_limit = day_limit or None
    rows = written(calls.select(F.to_date("timestamp").cast("string").alias("day"), F.nullif("document_id", F.lit("")).alias("document_id"), F.col("call_id").cast("long"), "cost_units", "timestamp"), "both")
    paid = rows.where("cost_units > 0")
    days = paid.groupBy("day").agg(F.sum("cost_units").alias("c"))
    tight_days = written((days.where(F.col("c") > day_limit) if day_limit else days.where("false")).select("day", F.col("day").alias("label")), "tight-days")
    tight_documents = written(paid.where("document_id is not null").groupBy("document_id").agg(F.sum("cost_units").alias("c")).where(F.col("c") > document_limit).select("document_id", F.lit(True).alias("tight")), "tight-documents")
    marked = written(rows.join(tight_documents, "document_id", "left").join(bounded(tight_days.select("day", F.lit(True).alias("full")), MOST_DAYS), "day", "left"), "both-marked")
    loose = F.col("cost_units").isNull() | (F.col("cost_units") == 0) | (F.col("tight").isNull() & F.col("full").isNull())
    # parts: the smallest day that can be reached over days and documents that can reject
    touching = written(marked.where("tight and full and cost_units > 0").select("day", "document_id").distinct(), "both-touching")
    label = tight_days
    while True:
        by_document = touching.join(bounded(label, MOST_DAYS), "day").groupBy("document_id").agg(F.min("label").alias("least"))
        seen = touching.join(by_document, "document_id").groupBy("day").agg(F.min("least").alias("least"))
        new = written(label.join(seen, "day", "left").select("day", F.least("label", F.coalesce("least", "label")).alias("label")), "both-labels")
        changed = new.join(label.withColumnRenamed("label", "_old"), "day").where("label <> _old").limit(1).count()
        label = new
        if not changed:
            break
    of_document = touching.join(bounded(label, MOST_DAYS), "day").groupBy("document_id").agg(F.min("label").alias("of_document"))
    bound = marked.where(~loose).join(bounded(label, MOST_DAYS), "day", "left").join(of_document, "document_id", "left")
    part = F.when(F.col("full"), F.col("label")).otherwise(F.coalesce("of_document", F.concat(F.lit("d:"), "document_id")))
    # only a document that can reject is looked up while folding
    ordered = bound.select(part.alias("part"), "day", F.when(F.col("tight"), F.col("document_id")).alias("document_id"), "call_id", "cost_units", "timestamp").repartition("part").sortWithinPartitions("part", "timestamp", "call_id")
    folded = ordered.select("part", "day", "document_id", "call_id", "cost_units").mapInArrow(lambda it: _fold_both(it, day_limit, document_limit), "call_id long, verdict string")
    return marked.where(loose).select("call_id", F.lit("admitted").alias("verdict")).unionByName(folded)


def rejection(verdict: Column, day_limit: int | None, document_limit: int) -> Column:
    """What a rejected call is told; null for an admitted one."""
    # The texts of the two rejections
    daily, document = "Daily limit of $%.2f would be exceeded", "Per-document limit of $%.2f would be exceeded"
    return F.when(verdict == "daily", F.lit(daily % ((day_limit or 0) / UNITS))).when(verdict == "document", F.lit(document % (document_limit / UNITS)))
