"""One call from a source to a result: the settings of a run, and the run."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import datetime
from pathlib import Path
from typing import Any

from pydantic import BaseModel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import extract as ex
from ledgerloom.operators import ledger
from ledgerloom.providers.base import CATALOG, DEFAULT_MODEL, Provider, make, resolve
from ledgerloom.session import local_session, written
from ledgerloom.sources import documents


class CostLimitExceeded(Exception):
    """A call went over a limit, and the caller wanted to be told so."""


@dataclass(frozen=True)
class Engine:
    """Model, limits in USD and where calls go; checked when it is made: an unknown model or a missing key raises ValueError.

    ``models`` is the table of prices (``name, input_price, output_price``);
    without it calls cost nothing.  ``provider`` stands in for the model's own.
    ``booked`` holds earlier rows of the ledger (see
    :func:`ledgerloom.operators.extract.ledger_rows`), which count against the limits.
    """

    model: str = DEFAULT_MODEL
    api_key: str | None = None
    base_url: str | None = None
    document_limit: float = 0.10
    day_limit: float | None = None
    catalog: dict[str, tuple[str, str, bool]] = field(default_factory=lambda: dict(CATALOG))
    models: DataFrame | None = None
    provider: Provider | None = None
    booked: DataFrame | None = None

    def __post_init__(self) -> None:
        self.maker()()

    def maker(self) -> Callable[[], Provider]:
        given, model, catalog, key, url = self.provider, self.model, self.catalog, self.api_key, self.base_url
        return (lambda: given) if given is not None else (lambda: make(model, catalog, key, url))

    def _named(self) -> tuple[str, bool]:
        if self.provider is not None:
            return self.provider.name, self.provider.vision
        name, _, vision = resolve(self.model, self.catalog)
        return name, vision

    def run(self, docs: DataFrame, schema: type[BaseModel], doc_type: str | None = None, language: str = "en") -> tuple[DataFrame, DataFrame]:
        """Results and ledger rows of documents (see :mod:`ledgerloom.sources.documents`), both written: no call is made twice."""
        name, vision = self._named()
        told = written(ex.extract(documents.routed(docs), schema, self.maker(), self.model, name, vision, doc_type, language), "results")
        prices = self.models if self.models is not None else docs.sparkSession.createDataFrame([], "name string, input_price decimal(8,2), output_price decimal(8,2)")
        limits = (round(self.document_limit * ledger.UNITS), round(self.day_limit * ledger.UNITS) if self.day_limit else None)
        rows = written(ex.ledger_rows(ex.call_rows(told, self.model, name), prices, *limits, booked=self.booked), "ledger")
        return written(ex.charged(told, rows), "charged"), rows

    def harvest(self, source: Any, schema: type[BaseModel], doc_type: str | None = None, document_id: str | None = None, language: str = "en", filename: str | None = None, strict: bool = False) -> Row:
        """The result of one path, byte string or open binary file; ``strict`` raises where a limit was exceeded."""
        spark = SparkSession.getActiveSession() or local_session(2)
        if isinstance(source, str | Path):
            docs = documents.from_paths(spark, [source], filename)
            docs = docs.withColumn("document_id", F.lit(document_id)) if document_id else docs
        else:
            docs = documents.from_contents(spark, [source], filename, document_id)
        return self._one(docs, schema, doc_type, language, strict)

    def harvest_text(self, text: str, schema: type[BaseModel], doc_type: str | None = None, document_id: str | None = None, language: str = "en", strict: bool = False) -> Row:
        """The result of a text."""
        spark = SparkSession.getActiveSession() or local_session(2)
        stamp = document_id or "doc_" + datetime.now().strftime("%Y%m%d_%H%M%S")
        docs = documents.from_texts(spark.createDataFrame([(text, stamp)], "text string, document_id string"), document_id="document_id")
        return self._one(docs, schema, doc_type, language, strict)

    def _one(self, docs: DataFrame, schema: type[BaseModel], doc_type: str | None, language: str, strict: bool) -> Row:
        results, rows = self.run(docs, schema, doc_type, language)
        row = results.first()
        if strict and (told := rows.where("rejection is not null").first()):
            raise CostLimitExceeded(told["rejection"])
        return row

    def harvest_batch(self, files: Iterable[str | Path], schema: type[BaseModel], doc_type: str | None = None, language: str = "en") -> DataFrame:
        """Results of many paths, with ``ord`` for their order."""
        spark = SparkSession.getActiveSession() or local_session(2)
        return self.run(documents.from_paths(spark, list(files)), schema, doc_type, language)[0]


def harvest(source: Any, schema: type[BaseModel], doc_type: str | None = None, language: str = "en", model: str = DEFAULT_MODEL, api_key: str | None = None, filename: str | None = None, base_url: str | None = None, **settings: Any) -> Row:
    """One source to one result; ``settings`` are those of :class:`Engine`."""
    return Engine(model=model, api_key=api_key, base_url=base_url, **settings).harvest(source, schema, doc_type, language=language, filename=filename)
