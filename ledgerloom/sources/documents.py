"""Documents from files, bytes, streams and texts as one DataFrame; what cannot be read is a row with an error."""

from __future__ import annotations

import io
import re
from collections.abc import Iterable, Iterator
from datetime import datetime
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text as tx

# How failures are told
NOT_FOUND, UNSUPPORTED_SOURCE, UNSUPPORTED_FILE = "File not found: ", "Unsupported source type: {}. Use str, Path, bytes, or file-like object.", "Unsupported file type: "
NO_PDF_TEXT, NO_PDF_READER = "No text found in PDF (might need OCR)", "pdfplumber not installed. Install with: pip install pdfplumber"
COLUMNS = "ord long, path string, filename string, document_id string, content binary, text string, file_size_bytes long, error string"


def _qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme and one slash behind it."""
    if not re.match(r"[a-zA-Z][a-zA-Z0-9]+:/", path):
        path = "file:" + str(Path(path).resolve())
    return re.sub(r"^file:/+", "file:/", path)


def _is_file(spark: SparkSession, path: str) -> bool:
    if path.startswith("file:"):
        return Path(path[5:]).is_file()
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(system.exists(at) and system.getFileStatus(at).isFile())


def from_paths(spark: SparkSession, paths: Iterable[str | Path], filename: str | None = None) -> DataFrame:
    """One row a requested path, in order of ``ord``; a missing path, and a folder, has an error.

    A path may be local or of any file system that the session knows
    (``scheme://``).  Those that exist are found on the driver, as the list of
    paths is there; their bytes are read by the executors.
    """
    wanted = [(i, str(p), _qualified(spark, str(p))) for i, p in enumerate(paths)]
    manifest = spark.createDataFrame(wanted, "ord long, path string, full string")
    found = sorted({w[2] for w in wanted if _is_file(spark, w[2])})
    if found:
        escaped = [re.sub(r"([\[\]{}*?\\])", r"\\\1", f) for f in found]
        files = spark.read.format("binaryFile").load(escaped).select(F.regexp_replace("path", "^file:/+", "file:/").alias("full"), "length", "content")
    else:
        files = spark.createDataFrame([], "full string, length long, content binary")
    joined = manifest.join(files, "full", "left")
    name = F.lit(filename).cast("string")
    missing = F.col("length").isNull()
    return joined.select("ord", "path", tx.given(name, tx.base_name(F.col("path"))).alias("filename"), tx.stem(F.col("path")).alias("document_id"), "content", F.lit(None).cast("string").alias("text"), F.col("length").alias("file_size_bytes"), F.when(missing, F.concat(F.lit(NOT_FOUND), "path")).alias("error"))


def from_contents(spark: SparkSession, sources: Iterable, filename: str | None = None, document_id: str | None = None, as_of: datetime | None = None) -> DataFrame:
    """Rows of byte strings and open binary files; any other source has an error."""
    stamp = "doc_" + (as_of or datetime.now()).strftime("%Y%m%d_%H%M%S")
    rows = []
    for i, s in enumerate(sources):
        if isinstance(s, bytes | bytearray):
            rows.append((i, None, filename or "", document_id or (Path(filename).stem if filename else stamp), bytes(s), None, len(s), None))
        elif isinstance(s, io.IOBase) or hasattr(s, "read"):
            data = s.read()
            own = getattr(s, "name", None)
            own = own if isinstance(own, str) else None
            rows.append((i, None, filename or own or "", document_id or (Path(own or filename).stem if own or filename else stamp), data, None, len(data), None))
        else:
            rows.append((i, None, filename or "", document_id or "unknown", None, None, None, UNSUPPORTED_SOURCE.format(type(s))))
    return spark.createDataFrame(rows, COLUMNS)


def from_texts(df: DataFrame, text: str = "text", document_id: str | None = None, as_of: datetime | None = None) -> DataFrame:
    """Rows of a DataFrame's text column; a text without an id gets one with its ``ord``, so that no two share one."""
    stamp = F.concat(tx.auto_id(F.lit(as_of or datetime.now())), F.lit("_"), F.monotonically_increasing_id())
    key = tx.given(F.col(document_id).cast("string"), stamp) if document_id else stamp
    return df.select(F.monotonically_increasing_id().alias("ord"), F.lit(None).cast("string").alias("path"), F.lit("text.txt").alias("filename"), key.alias("document_id"), F.lit(None).cast("binary").alias("content"), F.col(text).alias("text"), F.octet_length(text).cast("long").alias("file_size_bytes"), F.lit(None).cast("string").alias("error"))


def _pdf_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, errors = [], []
        for data in b.column(b.schema.get_field_index("content")).to_pylist():
            try:
                import pdfplumber

                with pdfplumber.open(io.BytesIO(data)) as pdf:
                    pages = [t for p in pdf.pages if (t := p.extract_text())]
                texts.append("\n\n".join(pages) or None)
                errors.append(None if pages else NO_PDF_TEXT)
            except ImportError:
                texts.append(None)
                errors.append(NO_PDF_READER)
            except Exception as e:  # noqa: BLE001 - one bad file is one bad row
                texts.append(None)
                errors.append(str(e))
        out = {n: b.column(i) for i, n in enumerate(b.schema.names)}
        out |= {"text": pa.array(texts, pa.string()), "error": pa.array([None if e is None else f"Extraction failed: {e}" for e in errors], pa.string())}
        yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))


def routed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``route``, ``media_type`` and the text of text files; errors are rows.

    The route comes from the name, so that contents nothing reads are not loaded.
    Only PDF contents go through Python.
    """
    kind = tx.extension(F.col("filename"))
    way = tx.route(F.col("filename"))
    supported = ", ".join("." + x for x in (*tx.IMAGE_TYPES, *tx.TEXT_TYPES))
    named = docs.select("*", way.alias("route"), F.when(way == "image", tx.media_type(F.col("filename"))).alias("media_type"), kind.alias("_kind"))
    valid = F.is_valid_utf8(F.col("content"))
    plain = named.withColumn("text", F.when((F.col("_kind") == ".txt") & F.col("text").isNull() & valid, F.decode("content", "UTF-8")).otherwise(F.col("text")))
    plain = plain.withColumn("error", F.coalesce("error", F.when(F.col("route").isNull(), F.concat(F.lit(UNSUPPORTED_FILE), "_kind", F.lit(". Supported: " + supported))), F.when((F.col("_kind") == ".txt") & F.col("content").isNotNull() & ~valid, "Extraction failed: invalid UTF-8")))
    paged = F.coalesce((F.col("_kind") == ".pdf") & F.col("content").isNotNull() & F.col("error").isNull() & F.col("text").isNull(), F.lit(False))
    rest, pdf = plain.where(~paged).drop("_kind"), plain.where(paged).drop("_kind")
    return rest.unionByName(pdf.mapInArrow(_pdf_pages, pdf.schema))
