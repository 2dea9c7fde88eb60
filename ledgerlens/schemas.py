"""Schemas of the extraction record and its parts (explicit, never inferred)."""

from __future__ import annotations

from pyspark.sql import types as T

CONFIDENCES = ("high", "medium", "low")
SEVERITIES = ("info", "warning", "error")


def field_struct(value_type: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("value", value_type, True),
        T.StructField("confidence", T.StringType(), True),
        T.StructField("reasoning", T.StringType(), True),
    ])


VENDOR = T.StructType([
    T.StructField("name", T.StringType(), True),
    T.StructField("address", T.StringType(), True),
    T.StructField("confidence", T.StringType(), True),
    T.StructField("reasoning", T.StringType(), True),
])

LINE_ITEM = T.StructType([
    T.StructField("description", T.StringType(), True),
    T.StructField("quantity", T.DoubleType(), True),
    T.StructField("unit_price", T.DoubleType(), True),
    T.StructField("amount", T.DoubleType(), True),
    T.StructField("reasoning", T.StringType(), True),
])

FLAG = T.StructType([
    T.StructField("severity", T.StringType(), True),
    T.StructField("message", T.StringType(), True),
])

STRING_FIELDS = ("invoice_number", "bill_date", "due_date", "po_number", "currency")
NUMBER_FIELDS = ("subtotal", "tax", "total")

RECORD = T.StructType([
    T.StructField("invoice_number", field_struct(T.StringType()), True),
    T.StructField("vendor", VENDOR, True),
    T.StructField("bill_date", field_struct(T.StringType()), True),
    T.StructField("due_date", field_struct(T.StringType()), True),
    T.StructField("po_number", field_struct(T.StringType()), True),
    T.StructField("subtotal", field_struct(T.DoubleType()), True),
    T.StructField("tax", field_struct(T.DoubleType()), True),
    T.StructField("total", field_struct(T.DoubleType()), True),
    T.StructField("currency", field_struct(T.StringType()), True),
    T.StructField("line_items", T.ArrayType(LINE_ITEM, True), True),
    T.StructField("flags", T.ArrayType(FLAG, True), True),
])

# The nine scored fields, in report order (fixed values).
GROUND_TRUTH_FIELDS = ("invoice_number", "vendor_name", "bill_date", "due_date",
                       "po_number", "subtotal", "tax", "total", "currency")
STRING_SCORED = ("invoice_number", "vendor_name", "po_number", "currency")
DATE_SCORED = ("bill_date", "due_date")
NUMBER_SCORED = ("subtotal", "tax", "total")

GROUND_TRUTH = T.StructType(
    [T.StructField(f, T.DoubleType() if f in NUMBER_SCORED else T.StringType(), True)
     for f in GROUND_TRUTH_FIELDS])

# The nine fields whose confidence is counted (record field names).
CONFIDENCE_FIELDS = ("invoice_number", "vendor", "bill_date", "due_date", "po_number",
                     "subtotal", "tax", "total", "currency")
