"""Output schemas: fields, prompts and Spark types from pydantic models."""

from __future__ import annotations

import datetime
import decimal
import types
from typing import Any, Optional, Union, get_args, get_origin

from pydantic import BaseModel, Field
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABELS = {str: "string", int: "integer", float: "number", bool: "boolean"}
SPARK = {str: T.StringType(), int: T.LongType(), float: T.DoubleType(), bool: T.BooleanType(), datetime.date: T.DateType(), datetime.datetime: T.TimestampNTZType(), decimal.Decimal: T.DecimalType(38, 18)}
# The wording of the prompts.
HEAD = "Extract structured data from this "
ASK = "Return a JSON object with the following fields:"
RULES = "Extract all available information. If a field is not found, use null.\nReturn only the JSON object, no other text."


def _bare(hint: Any) -> tuple[Any, bool]:
    """The first member of a union that is not None, and whether None is one."""
    if get_origin(hint) in (Union, types.UnionType):
        some = [a for a in get_args(hint) if a is not type(None)]
        return (some[0] if some else None), type(None) in get_args(hint)
    return hint, False


def label(hint: Any) -> str:
    hint, _ = _bare(hint)
    if hint is None:
        return "any"
    origin, args = get_origin(hint), get_args(hint)
    if origin is list:
        return f"list of {label(args[0])}" if args else "list"
    if origin is dict:
        return "object"
    if hint in LABELS:
        return LABELS[hint]
    if isinstance(hint, type) and issubclass(hint, BaseModel):
        return f"object ({hint.__name__})"
    return hint.__name__.lower() if hasattr(hint, "__name__") else str(hint)


def fields(schema: type[BaseModel]) -> list[dict]:
    """Name, type, description and requiredness of the fields, in order."""
    out = []
    for name, info in schema.model_fields.items():
        hint, optional = _bare(info.annotation)
        out.append({"name": name, "type": label(hint), "description": info.description or name.replace("_", " ").capitalize(), "required": not optional and info.is_required()})
    return out


def field_lines(schema: type[BaseModel]) -> str:
    return "\n".join(f"- {f['name']}: {f['description']} [{f['type']}] ({'required' if f['required'] else 'optional'})" for f in fields(schema))


def text_prompt(text: Column, doc_type: Column, schema: type[BaseModel]) -> Column:
    """The prompt of each text; what does not depend on the row is a literal."""
    return F.concat(F.lit(HEAD), doc_type, F.lit(f".\n\n{ASK}\n{field_lines(schema)}\n\n{RULES}\n\nDocument text:\n"), text, F.lit("\n\nJSON:"))


def vision_prompt(doc_type: Column, schema: type[BaseModel]) -> Column:
    return F.concat(F.lit(HEAD), doc_type, F.lit(f" image.\n\n{ASK}\n{field_lines(schema)}\n\n{RULES}"))


def spark_type(hint: Any) -> T.DataType:
    hint, _ = _bare(hint)
    origin, args = get_origin(hint), get_args(hint)
    if origin is list or hint is list:
        return T.ArrayType(spark_type(args[0]) if args else T.StringType())
    if origin is dict or hint is dict:
        return T.MapType(T.StringType(), spark_type(args[1]) if len(args) == 2 else T.StringType())
    if isinstance(hint, type) and issubclass(hint, BaseModel):
        return spark_schema(hint)
    return SPARK.get(hint, T.StringType())


def spark_schema(schema: type[BaseModel]) -> T.StructType:
    """A struct with each field's description and requiredness as metadata."""
    known = {f["name"]: f for f in fields(schema)}
    return T.StructType([T.StructField(n, spark_type(i.annotation), True, {"comment": known[n]["description"], "required": known[n]["required"]}) for n, i in schema.model_fields.items()])


def json_schema(schema: type[BaseModel]) -> dict:
    return schema.model_json_schema()


def _optional(kind: type, text: str):
    return (Optional[kind], Field(None, description=text))


class LineItem(BaseModel):
    """One item of an invoice or receipt."""

    # Field names and their descriptions.
    name: str = Field(description="Item name")
    amount: Optional[float] = Field(None, description="Total amount for this item")
    quantity: Optional[float] = Field(None, description="Quantity of items")
    unit_price_with_taxes: Optional[float] = Field(None, description="Price per unit with taxes")
    unit_price_without_taxes: Optional[float] = Field(None, description="Price per unit without taxes")
    discount: Optional[float] = Field(None, description="Discount amount per item")
    discount_percentage: Optional[float] = Field(None, description="Discount percentage per item")
    taxes: Optional[float] = Field(None, description="Taxes amount per item")
    taxes_percentage: Optional[float] = Field(None, description="Taxes percentage per item")


def _model(name: str, doc: str, spec: list[tuple[str, type, str]]) -> type[BaseModel]:
    from pydantic import create_model

    return create_model(name, __doc__=doc, **{n: _optional(t, d) for n, t, d in spec})


# Field names, types and descriptions of the built-in schemas.
InvoiceData = _model(
    "InvoiceData",
    "Fields of an invoice.",
    [
        ("invoice_number", str, "The unique invoice number or ID"), ("date", str, "Invoice issue date"), ("due_date", str, "Payment due date"), ("po_number", str, "Purchase order number if referenced"),
        ("vendor_name", str, "Vendor/seller company name"), ("vendor_address", str, "Vendor address"), ("vendor_email", str, "Vendor email address"), ("vendor_tax_id", str, "Vendor tax ID (GSTIN, VAT, EIN, etc.)"),
        ("customer_name", str, "Customer/buyer company or person name"), ("customer_address", str, "Customer billing address"), ("customer_email", str, "Customer email address"), ("customer_phone", str, "Customer phone number"),
        ("line_items", list[LineItem], "List of invoice line items"), ("subtotal", float, "Subtotal before tax"), ("tax_amount", float, "Total tax amount"), ("discount", float, "Discount amount if any"), ("total_amount", float, "Total amount due"),
        ("currency", str, "Currency code (USD, EUR, etc.)"), ("bank_name", str, "Bank name for payment"), ("bank_account", str, "Bank account number"), ("bank_routing", str, "Bank routing/SWIFT/BIC code"), ("notes", str, "Special notes or payment terms"),
    ],
)
ReceiptData = _model(
    "ReceiptData",
    "Fields of a receipt.",
    [
        ("merchant_name", str, "Store or merchant name"), ("merchant_address", str, "Store address"), ("date", str, "Transaction date"), ("time", str, "Transaction time"), ("items", list[LineItem], "List of purchased items"),
        ("subtotal", float, "Subtotal before tax"), ("tax", float, "Tax amount"), ("total", float, "Total amount paid"), ("payment_method", str, "Payment method used"), ("card_last_four", str, "Last 4 digits of card if applicable"),
    ],
)
SCHEMAS = {"InvoiceData": InvoiceData, "ReceiptData": ReceiptData}


def schema_by_name(name: str) -> type[BaseModel]:
    if name not in SCHEMAS:
        raise ValueError(f"Unknown schema: {name}. Available: {', '.join(SCHEMAS)}")
    return SCHEMAS[name]
