"""Prompts written out, for the SQL that checks them."""

# What the two prompts say behind the type of document, and what ends the first
TEXT_PROMPT = """.

Return a JSON object with the following fields:
- invoice_number: The unique invoice number or ID [string] (optional)
- date: Invoice issue date [string] (optional)
- due_date: Payment due date [string] (optional)
- po_number: Purchase order number if referenced [string] (optional)
- vendor_name: Vendor/seller company name [string] (optional)
- vendor_address: Vendor address [string] (optional)
- vendor_email: Vendor email address [string] (optional)
- vendor_tax_id: Vendor tax ID (GSTIN, VAT, EIN, etc.) [string] (optional)
- customer_name: Customer/buyer company or person name [string] (optional)
- customer_address: Customer billing address [string] (optional)
- customer_email: Customer email address [string] (optional)
- customer_phone: Customer phone number [string] (optional)
- line_items: List of invoice line items [list of object (LineItem)] (optional)
- subtotal: Subtotal before tax [number] (optional)
- tax_amount: Total tax amount [number] (optional)
- discount: Discount amount if any [number] (optional)
- total_amount: Total amount due [number] (optional)
- currency: Currency code (USD, EUR, etc.) [string] (optional)
- bank_name: Bank name for payment [string] (optional)
- bank_account: Bank account number [string] (optional)
- bank_routing: Bank routing/SWIFT/BIC code [string] (optional)
- notes: Special notes or payment terms [string] (optional)

Extract all available information. If a field is not found, use null.
Return only the JSON object, no other text.

Document text:
"""
TEXT_END = "\n\nJSON:"
VISION_PROMPT = """ image.

Return a JSON object with the following fields:
- merchant_name: Store or merchant name [string] (optional)
- merchant_address: Store address [string] (optional)
- date: Transaction date [string] (optional)
- time: Transaction time [string] (optional)
- items: List of purchased items [list of object (LineItem)] (optional)
- subtotal: Subtotal before tax [number] (optional)
- tax: Tax amount [number] (optional)
- total: Total amount paid [number] (optional)
- payment_method: Payment method used [string] (optional)
- card_last_four: Last 4 digits of card if applicable [string] (optional)

Extract all available information. If a field is not found, use null.
Return only the JSON object, no other text."""
