"""Typed entries as entries of a reference list (problem 4).

Distinct entries are written plainly, candidates come from an inverted index of
character n-grams over all known forms of the list, the best weighted cosine
must reach a threshold and lead by a margin, else the entry is unmatched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.currency import Currencies
from ledgerloom.functions.ngrams import plain
from ledgerloom.session import bounded, written

UNMATCHED = "UNMATCHED"
THRESHOLD, MARGIN = 0.3, 0.02
#: Further ways to say a payment method, which no spelling of the listed ones leads to.
PAYMENT_FORMS = {
    "cash": ["bar", "bar bezahlt", "barzahlung", "efectivo", "comptant", "csh", "cash money", "in cash", "paid cash", "liquide", "contanti"],
    "credit_card": ["cc", "credit", "card credit", "credit crd", "crd card", "tarjeta de credito", "kredit karte", "creditcard", "visa", "mastercard"],
    "debit_card": ["ec", "ec karte", "debit", "card debit", "account card debit", "debit crd", "dc debit", "tarjeta de debito", "girocard", "girokarte", "carte bancaire"],
    "bank_transfer": ["virement", "wire", "wire transfer", "sepa transfer", "bacs style transfer", "bacs transfer", "transfer bank", "bank tfr", "bank transf", "electronic bank transfer", "transferencia bancaria", "bankuberweisung", "sepa uberweisung"],
    "cheque": ["check", "chq", "personal check", "paper cheque", "by cheque", "schek"],
    "mobile_wallet": ["mobile", "e wallet", "mob wallet", "phone wallet", "wallet phone", "mobile pay", "mobile payment", "tap phone", "mobile wallet app", "handyzahlung", "handy", "digital wallet"],
    "gift_card": ["gift", "giftcard", "gc gift", "gift voucher card", "gutscheinkarte", "geschenk karte", "tarjeta regalo"],
    "direct_debit": ["dd", "dir debit", "sepa direct debit", "lastschr", "einzug lastschrift", "bankeinzug", "sepa lastschrift", "prelevement automatique"],
    "meal_voucher": ["meal vchr", "lunch voucher", "meal ticket", "titres repas", "essenmarke", "essensgutschein", "ticket restaurant"],
    "store_credit": ["shop credit", "store crdt", "return credit store", "avoir", "guthaben kunde"],
    "cash_on_delivery": ["cod", "c o d", "cash delivery", "paid on delivery in cash", "per nachnahme", "contre remb", "contre remboursement"],
    "money_order": ["m o", "postal order", "money ordr", "mandat poste", "mandat", "post anweisung"],
}


def grams(text: Column, n: int = 2) -> Column:
    """The distinct n-grams of a text between two marks; a null has none."""
    s = F.concat(F.lit("^"), text, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - (n - 1), F.lit(1))), lambda i: F.substring(s, i, F.lit(n))))


def nearest(values: DataFrame, forms: DataFrame, threshold: float, margin: float, short: int = 4, edits: float = 0.28) -> DataFrame:
    """``(value, code, score)`` of every ``values(value)`` that is near enough to one ``forms(form, code)``.

    Both sides are plain text (see :func:`plain`).  Candidates come from an
    inverted index of the forms' bigrams; a value is accepted if the best code's
    cosine reaches ``threshold`` and leads the next code by ``margin``, and if
    the edit distance to the form is at most ``edits`` of the longer text.  Forms
    of up to ``short`` letters must agree exactly.  A value that is a form is
    that form.  Ties between codes are not accepted.
    """
    known = written(forms.where(F.length("form") > 0).select("form", "code").distinct(), "forms")
    n = known.select("form").distinct().count()
    posted = known.select("form", "code", F.explode(grams(F.col("form"))).alias("gram"))
    df = posted.groupBy("gram").agg(F.countDistinct("form").alias("df"))
    weighted = posted.join(df, "gram").withColumn("w", F.log(1 + F.lit(float(n)) / F.col("df")))
    norms = weighted.groupBy("form", "code").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    # written, so that the plan of the values reads it and does not hold how it came about
    index = written(weighted.select("gram", "form", "code", "w").join(norms, ["form", "code"]).groupBy("gram").agg(F.first("w").alias("w"), F.collect_list(F.struct("form", "code", "norm")).alias("posts")), "form-index")
    asked = values.where(F.length("value") > 0).select("value").distinct()
    # A gram that no form has weighs as much as the rarest.
    exploded = asked.select("value", F.explode(grams(F.col("value"))).alias("gram")).join(bounded(index), "gram", "left").withColumn("w", F.coalesce("w", F.log(1 + F.lit(float(n)))))
    scored = (
        exploded.groupBy("value")
        .agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("vnorm"), F.collect_list(F.struct(F.coalesce("posts", F.array().cast("array<struct<form:string,code:string,norm:double>>")).alias("posts"), "w")).alias("hits"))
        .select("value", "vnorm", F.explode("hits").alias("h"))
        .select("value", "vnorm", F.col("h.w").alias("w"), F.explode("h.posts").alias("p"))
        .groupBy("value", "p.form", "p.code")
        .agg((F.sum(F.col("w") * F.col("w")) / F.first(F.col("vnorm") * F.col("p.norm"))).alias("score"))
        .withColumn("score", F.when(F.col("value") == F.col("form"), 1.0).when((F.length("form") <= short) | (F.levenshtein("value", "form") > F.greatest(F.lit(2.0), edits * F.greatest(F.length("value"), F.length("form")))), 0.0).otherwise(F.least(F.col("score"), F.lit(0.9999))))
    )
    by_code = scored.groupBy("value", "code").agg(F.max("score").alias("score"))
    ranked = by_code.groupBy("value").agg(F.sort_array(F.collect_list(F.struct("score", "code")), asc=False).alias("r"))
    first, second = F.col("r")[0], F.coalesce(F.get("r", F.lit(1))["score"], F.lit(0.0))
    return ranked.where((first["score"] >= threshold) & ((first["score"] - second >= margin) | ((first["score"] == 1) & (second < 1)))).select("value", first["code"].alias("code"), first["score"].alias("score"))


def match(entries: DataFrame, forms: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """``(value, code)`` of distinct plain ``entries(value)``; those near nothing have no row."""
    return nearest(entries.select("value"), forms.select("form", "code"), threshold, margin).select("value", "code")


def _bare(entry: Column) -> Column:
    """A payment entry without openings, card numbers and case."""
    s = F.regexp_replace(F.lower(entry), r"^\s*(?:paid|payment|pay)\s*:\s*|\*+\s*\d+|(?:n°|\bno\.?|\bnr\.?)\s*\d+|#\s*\d+|\b\d{3,}\b", " ")
    return plain(s)


def _labelled(rows: DataFrame, found: DataFrame, value: str = "value") -> DataFrame:
    return rows.join(found, value, "left")


def payment_codes(receipts: DataFrame, methods: DataFrame) -> DataFrame:
    """``(record_id, canonical)`` of every receipt with a payment_method; empty entries are unmatched."""
    spark = receipts.sparkSession
    listed = methods.select("code", F.explode(F.concat(F.array("label", F.replace("code", F.lit("_"), F.lit(" "))), F.coalesce("local_names", F.array().cast("array<string>")))).alias("raw")).where("raw is not null")
    forms = listed.select(plain(F.col("raw")).alias("form"), "code").unionByName(_extra(spark, PAYMENT_FORMS, methods)).distinct()
    rows = receipts.where(F.col("payment_method").isNotNull()).select("record_id", _bare(F.col("payment_method")).alias("value"))
    return _labelled(rows, match(rows, forms)).select("record_id", F.coalesce("code", F.lit(UNMATCHED)).alias("canonical"))


def _extra(spark, forms: dict[str, list[str]], methods: DataFrame) -> DataFrame:
    """The further forms of the codes that are listed."""
    more = spark.createDataFrame([(f, c) for c, fs in forms.items() for f in fs], "form string, code string")
    return more.join(bounded(methods.select("code").distinct()), "code", "left_semi").select("form", "code")


def currency_codes(invoices: DataFrame, systems: DataFrame, currency_table: DataFrame) -> DataFrame:
    """``(record_id, canonical)`` of every invoice with a currency entry.

    Words of scale and subunits are taken off first.  A sign that several listed
    currencies share means the default of the source system, and nothing where
    that has none.
    """
    spark = invoices.sparkSession
    known = Currencies(currency_table)
    rows = invoices.where(F.col("currency").isNotNull()).select("record_id", "source_system", known.stripped(F.col("currency")).alias("stripped"))
    # signs have no letters: the index holds them as they are
    distinct = rows.select("stripped").distinct().select("stripped", known.is_shared(F.col("stripped")).alias("shared"), known.exact(F.col("stripped")).alias("exact"), plain(F.col("stripped")).alias("plain"))
    asked = distinct.where("not shared").select("stripped", F.coalesce(F.lower("exact"), "plain").alias("value"))
    found = match(asked.select("value"), known.table(spark))
    named = distinct.join(asked.join(found, "value", "left").select("stripped", "code"), "stripped", "left").select("stripped", "shared", "code")
    default = systems.select("source_system", F.col("default_currency").alias("_default"))
    joined = _labelled(rows, named, "stripped").join(bounded(default), "source_system", "left")
    return joined.select("record_id", F.coalesce(F.when(F.col("shared"), F.col("_default")).otherwise(F.col("code")), F.lit(UNMATCHED)).alias("canonical"))


def canonical(invoices: DataFrame, receipts: DataFrame, systems: DataFrame, currencies: DataFrame, methods: DataFrame) -> DataFrame:
    """Both fields together; null entries have no row, repeated rows are repeated."""
    return currency_codes(invoices, systems, currencies).unionByName(payment_codes(receipts, methods))
