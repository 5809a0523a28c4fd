"""Structured extraction from documents as Spark DataFrames."""

from ledgerloom.engine import CostLimitExceeded, Engine, harvest
from ledgerloom.functions.schemas import SCHEMAS, InvoiceData, LineItem, ReceiptData, schema_by_name
from ledgerloom.operators.extract import call_rows, charged, extract, ledger_rows
from ledgerloom.providers.base import CATALOG, DEFAULT_MODEL, PROVIDERS, AnthropicProvider, Completion, ModelNotSupported, OllamaProvider, OpenAIProvider, Provider, StubProvider, make, resolve
from ledgerloom.sources.documents import from_contents, from_paths, from_texts, routed

__version__ = "0.1.0"
__all__ = [
    "CATALOG", "DEFAULT_MODEL", "PROVIDERS", "SCHEMAS", "AnthropicProvider", "Completion", "CostLimitExceeded", "Engine", "InvoiceData", "LineItem", "ModelNotSupported", "OllamaProvider", "OpenAIProvider", "Provider", "ReceiptData", "StubProvider",
    "call_rows", "charged", "extract", "from_contents", "from_paths", "from_texts", "harvest", "ledger_rows", "make", "resolve", "routed", "schema_by_name",
]
