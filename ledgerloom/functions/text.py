"""Names, prefixes and spans of texts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
CLASS_SUFFIXES = ("Schema", "Output", "Data", "Model")
IMAGE_TYPES = ("jpg", "jpeg", "png", "gif", "webp")
TEXT_TYPES = ("txt", "pdf")
MAX_INPUT_CHARS = 8000
PREFIX_CHARS = 500


def document_type(class_name: Column) -> Column:
    """Type of document from the name of its schema: one suffix off, words apart, lower case."""
    bare = class_name
    taken = F.when(F.lit(False), class_name)
    for suffix in CLASS_SUFFIXES:
        taken = taken.when(class_name.endswith(suffix), F.substr(class_name, F.lit(1), F.length(class_name) - len(suffix)))
    bare = taken.otherwise(class_name)
    return F.lower(F.regexp_replace(bare, "(?<!^)(?=[A-Z])", "_"))


def given(value: Column, default: Column) -> Column:
    """``value``, or ``default`` if it is null or empty."""
    return F.coalesce(F.nullif(value, F.lit("")), default)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def extension(path: Column) -> Column:
    """Lower-case suffix with its dot; empty for names that begin or end with the only dot."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    name = base_name(path)
    return F.when(extension(path) == "", name).otherwise(F.regexp_extract(name, r"^(.+)\.[^.]+$", 1))


def auto_id(as_of: Column) -> Column:
    return F.concat(F.lit("doc_"), F.date_format(as_of, "yyyyMMdd_HHmmss"))


def media_type(path: Column) -> Column:
    kind = F.replace(extension(path), F.lit("."), F.lit(""))
    return F.when(path.isNull() | (path == ""), "image/jpeg").when(kind == "jpg", "image/jpeg").otherwise(F.concat(F.lit("image/"), kind))


def route(path: Column) -> Column:
    """``image``, ``text``, or null for a suffix that nothing reads."""
    kind = extension(path)
    return F.when(kind.isin(*("." + x for x in IMAGE_TYPES)), "image").when(kind.isin(*("." + x for x in TEXT_TYPES)), "text")


def truncated(text: Column, max_chars: int | None = None) -> Column:
    """Beginning and end of a long text around a note of what was left out."""
    most = max_chars or MAX_INPUT_CHARS
    if most < 4:
        raise ValueError("max_chars must be at least 4")
    head, tail = int(most * 0.6), int(most * 0.3)
    middle = F.substr(text, F.lit(head + 1), F.length(text) - (head + tail))
    lines = F.length(middle) - F.length(F.replace(middle, F.lit("\n"), F.lit("")))
    note = F.format_string("\n\n[... %d lines removed (%d chars) ...]\n\n", lines, F.length(text) - (head + tail))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substr(text, F.lit(1), F.lit(head)), note, F.right(text, F.lit(tail))))


def was_truncated(text: Column, max_chars: int | None = None) -> Column:
    return F.length(truncated(text, max_chars)) < F.length(text)


def raw_prefix(text: Column) -> Column:
    return F.substr(text, F.lit(1), F.lit(PREFIX_CHARS))


def json_span(response: Column) -> Column:
    """From the first opening to the last closing brace; all of it if there is no such span."""
    return given(F.regexp_extract(response, r"(?s)\{.*\}", 0), response)


def data_url(content: Column, kind: Column) -> Column:
    return F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.regexp_replace(F.base64(content), r"[\r\n]", ""))


def strategy(provider: Column) -> Column:
    return F.when(provider.isin("anthropic", "openai", "ollama"), F.concat(F.lit("llm_"), provider)).otherwise("llm_anthropic")
