"""Driver queries of the subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import addresses, canonical, mixing, names, pii, splitting, tokens
from ledgerloom.session import table


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return names.same_names(table(spark, root, "invoices"), table(spark, root, "receipts"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return canonical.canonical(*(table(spark, root, t) for t in ("invoices", "receipts", "source_systems", "currencies", "payment_methods")))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return addresses.same_addresses(table(spark, root, "invoices"), table(spark, root, "receipts"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    invoices, receipts, harvests = (table(spark, root, t) for t in ("invoices", "receipts", "harvests"))
    found = pii.found(invoices, receipts, harvests, pii.list_terms(table(spark, root, "currencies"), table(spark, root, "payment_methods")))
    return found.select("field", "row_id", "result_no", "pii_type", "value").distinct()


def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, root, "documents"))


def p9_mix(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mixed(table(spark, root, "documents"), table(spark, root, "mix_targets"))


def p9_report(spark: SparkSession, root: str) -> DataFrame:
    targets = table(spark, root, "mix_targets")
    return mixing.report(mixing.mixed(table(spark, root, "documents"), targets), targets)


def p10_pieces(spark: SparkSession, root: str) -> DataFrame:
    return splitting.split(table(spark, root, "documents"), table(spark, root, "split_limits"))


def queries() -> dict:
    return {"p3_found": p3_found, "p4_found": p4_found, "p6_found": p6_found, "p7_found": p7_found, "p8_ids": p8_ids, "p9_mix": p9_mix, "p9_report": p9_report, "p10_pieces": p10_pieces}


def oracle_sql() -> dict[str, str]:
    return {}
