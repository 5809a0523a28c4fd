"""Amounts of different currencies and scales in one unit (problem 1).

What a record says of itself is read first.  For the rest, the scale of each
source is settled between sources: the same party seen by two sources gives a
difference of log amounts, the median over all shared parties is the pairwise
scale, it is snapped to the known conversions (between major units, minor units
and thousands) and carried through the graph of sources, best linked pairs first.
That settles the sources of a connected part relative to each other; its level is
the one that agrees with most of what they declare, by number of links.  So a
source that declares nothing, or something else than its amounts show, is put
right by its neighbours, over any number of steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.currency import Currencies, sentence_scale
from ledgerloom.functions.ngrams import plain
from ledgerloom.session import bounded, written

#: A pair of sources counts with so many shared parties, and if its median is so near a conversion (in powers of ten).
LEAST_LINKS, NEAREST = 50, 0.2
#: Powers of ten by which the amount of a currency with two decimal digits is too large.
POWERS = {"major": 0, "minor": 2, "thousand": -3}
#: Forms of law, which spellings of one party have or leave out.
LEGAL = ("ltd", "limited", "gmbh", "ag", "llc", "inc", "bv", "b", "v", "sarl", "s", "a", "r", "l", "co", "company", "and", "firma", "fa", "the", "messrs", "m")


def entries_to_codes(entries: DataFrame, currencies: Currencies) -> DataFrame:
    """``(entry, code, shared)`` of distinct ``entries(entry)``; what names no listed currency has null and false."""
    read = entries.where(F.col("entry").isNotNull()).distinct().withColumn("_s", currencies.stripped(F.col("entry")))
    read = read.select("entry", currencies.exact(F.col("_s")).alias("code"), currencies.is_shared(F.col("_s")).alias("shared"), plain(F.col("_s")).alias("_p"))
    # a column of its own, so that it is worked out once a row
    read = read.withColumn("_ranked", F.when(F.col("code").isNull() & ~F.col("shared"), currencies.ranked(F.col("_p")))).withColumn("_near", currencies.mistyped(F.col("_p"), F.col("_ranked")))
    return read.select("entry", F.coalesce("code", F.when(~F.col("shared"), F.col("_near"))).alias("code"), (F.col("code").isNull() & F.col("shared")).alias("shared"))


def party_key(name: Column) -> Column:
    """Words of a name in order of the alphabet, without forms of law and accents; null for an empty one."""
    words = F.array_sort(F.filter(F.array_except(F.split(plain(name), " "), F.array(*(F.lit(x) for x in LEGAL))), lambda w: w != ""))
    return F.nullif(F.array_join(words, " "), F.lit(""))


def invoice_amounts(invoices: DataFrame, currencies: Currencies) -> DataFrame:
    """``(record_id, source_system, party, amount, code, shared, scale, other)`` as the invoices themselves tell it.

    A currency entry is looked at before the notes; where both are silent the
    columns are null.  ``other`` is the notes' currency beside an entry whose sign
    is shared, for sources without a default.  An invoice without a total gives
    no row.
    """
    rows = invoices.where(F.col("total_amount").isNotNull()).select("record_id", "source_system", party_key(F.col("vendor_name")).alias("party"), F.col("total_amount").alias("amount"), F.col("currency").alias("entry"), "notes")
    codes = entries_to_codes(rows.select("entry"), currencies).withColumnsRenamed({"code": "_code", "shared": "_shared"})
    said = rows.join(codes, "entry", "left").withColumn("_form", currencies.sentence_currency(F.col("notes")))
    by_entry = F.col("_code").isNotNull() | F.coalesce(F.col("_shared"), F.lit(False))
    return said.select(
        "record_id", "source_system", "party", "amount",
        F.when(by_entry, F.col("_code")).otherwise(currencies.lookup(F.col("_form"))).alias("code"),
        F.when(by_entry, F.col("_shared")).otherwise(F.coalesce(currencies.is_shared(F.col("_form")), F.lit(False))).alias("shared"),
        F.coalesce(F.when(by_entry, currencies.entry_scale(F.col("entry"))), sentence_scale(F.col("notes"))).alias("scale"),
        F.when(F.coalesce(F.col("_shared"), F.lit(False)), currencies.lookup(F.col("_form"))).alias("other"),
    )


def receipt_amounts(receipts: DataFrame, harvests: DataFrame, currencies: Currencies) -> DataFrame:
    """The same of receipts, from the text of the successful result of their harvest.

    Only what the text tells is joined, not the text.
    """
    text = F.get(F.filter("extraction_results", lambda r: r["success"] & r["raw_text"].isNotNull()), F.lit(0))["raw_text"]
    pages = harvests.select("harvest_id", text.alias("_t")).where(F.col("_t").isNotNull())
    told = pages.select("harvest_id", F.coalesce(currencies.sentence_currency(F.col("_t")), currencies.total_currency(F.col("_t"))).alias("_form"), sentence_scale(F.col("_t")).alias("scale")).where("_form is not null or scale is not null")
    rows = receipts.where(F.col("total").isNotNull()).select("record_id", "harvest_id", "source_system", party_key(F.col("merchant_name")).alias("party"), F.col("total").alias("amount"))
    return rows.join(told, "harvest_id", "left").select("record_id", "source_system", "party", "amount", currencies.lookup(F.col("_form")).alias("code"), F.coalesce(currencies.is_shared(F.col("_form")), F.lit(False)).alias("shared"), "scale", F.lit(None).cast("string").alias("other"))


def _factor(scale: Column, code: Column, currencies: Currencies) -> Column:
    """What an amount is multiplied by to be in major units."""
    minor = F.pow(F.lit(10.0), -currencies.by_code({k: float(v) for k, v in currencies.digits.items()}, code))
    return F.when(scale == "thousand", 1000.0).when(scale == "minor", minor).otherwise(1.0)


def pairwise_scales(amounts: DataFrame, currencies: Currencies) -> DataFrame:
    """``(a, b, d, links)``: by how many powers of ten the amounts of source ``a`` exceed those of ``b``.

    The median over the parties both have, each with the median of its amounts.
    Currencies whose minor unit is not a hundredth tell nothing of the scale.
    """
    known = amounts.where(F.col("scale").isNull() & F.col("code").isNotNull() & (F.col("amount") != 0) & F.col("party").isNotNull() & F.col("source_system").isNotNull())
    log = F.log10(F.abs("amount") * currencies.by_code(currencies.rate, F.col("code")))
    digits = currencies.by_code({k: float(v) for k, v in currencies.digits.items()}, F.col("code"))
    party = known.where(digits == 2).groupBy("party", "source_system").agg(F.percentile_approx(log, 0.5).alias("y"))
    a, b = party.select("party", F.col("source_system").alias("a"), F.col("y").alias("ya")), party.select("party", F.col("source_system").alias("b"), F.col("y").alias("yb"))
    return a.join(b, "party").where("a < b").groupBy("a", "b").agg(F.percentile_approx(F.col("ya") - F.col("yb"), 0.5).alias("d"), F.count("*").alias("links"))


def propagated(declared: dict[str, str | None], edges: list[tuple[str, str, float, int]]) -> dict[str, dict]:
    """Unit of every source, from what they declare and the pairwise scales ``(a, b, d, links)``.

    ``part`` numbers the connected parts; a source that no pair reaches keeps what
    it declares.  Where a part's declarations weigh as much for one level as for
    another, each source keeps its own.
    """
    steps = sorted({x - y for x in POWERS.values() for y in POWERS.values()})
    sure = []
    for a, b, d, links in edges:
        step = min(steps, key=lambda k: abs(d - k))
        if links >= LEAST_LINKS and abs(d - step) <= NEAREST and a in declared and b in declared:
            sure.append((links, a, b, step))
    part = {s: i for i, s in enumerate(sorted(declared))}
    relative, weight = dict.fromkeys(declared, 0), dict.fromkeys(declared, 0)
    for links, a, b, step in sorted(sure, key=lambda e: (-e[0], e[1], e[2])):
        weight[a] += links
        weight[b] += links
        if part[a] != part[b]:  # the part of b moves so that the pair agrees
            shift, old = relative[a] - step - relative[b], part[b]
            for s in declared:
                if part[s] == old:
                    relative[s] += shift
                    part[s] = part[a]
    out = {}
    for p in set(part.values()):
        mine = [s for s in declared if part[s] == p]
        votes = {0: 0}
        for s in mine:
            if declared[s] in POWERS:
                level = POWERS[declared[s]] - relative[s]
                votes[level] = votes.get(level, 0) + max(weight[s], 1)
        ranked = sorted(votes.items(), key=lambda v: -v[1])
        settled = len(mine) > 1 and ranked[0][1] > 0 and (len(ranked) == 1 or ranked[0][1] > ranked[1][1])
        for s in mine:
            found = next((u for u, x in POWERS.items() if settled and x == relative[s] + ranked[0][0]), None)
            out[s] = {"declared": declared[s], "part": p, "links": weight[s], "found": found, "unit": found or declared[s]}
    return out


def source_scales(amounts: DataFrame, systems: DataFrame, currencies: Currencies) -> dict[str, dict]:
    """Per source the declared unit, the one found through the graph, and the one to use.

    ``amounts`` holds rows with ``source_system, party, amount, code, scale``.
    The source list is a parameter table; of the data one row a pair of sources
    comes to the driver.
    """
    declared = {r["source_system"]: r["amount_unit"] for r in systems.select("source_system", "amount_unit").collect()}
    edges = [(r["a"], r["b"], r["d"], r["links"]) for r in pairwise_scales(amounts.where(F.col("source_system").isin(*declared)), currencies).collect()]
    return propagated(declared, edges)


def usd_cents(invoices: DataFrame, receipts: DataFrame, harvests: DataFrame, systems: DataFrame, currency_table: DataFrame) -> DataFrame:
    """``(record_id, usd_cents)`` of every total whose currency can be told.

    Null totals give no row, nor do records whose currency neither their text
    nor their source tells; repeated rows give repeated rows.
    """
    spark = invoices.sparkSession
    currencies = Currencies(currency_table)
    told = written(invoice_amounts(invoices, currencies).unionByName(receipt_amounts(receipts, harvests, currencies)), "amounts")
    scales = source_scales(told, systems, currencies)
    units = spark.createDataFrame([(s, v["unit"]) for s, v in scales.items()] or [("", None)], "source_system string, _unit string")
    source = systems.select("source_system", F.col("default_currency").alias("_default")).join(units, "source_system", "left")
    rows = told.join(bounded(source), "source_system", "left")
    code = F.coalesce("code", F.when(F.col("shared"), F.col("_default")), "other", "_default")
    scale = F.coalesce(F.col("scale"), F.col("_unit"))
    cents = F.round(F.col("amount") * _factor(scale, code, currencies) * currencies.by_code(currencies.rate, code) * 100).cast("long")
    return rows.select("record_id", cents.alias("usd_cents")).where(F.col("usd_cents").isNotNull())
