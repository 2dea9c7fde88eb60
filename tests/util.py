"""Builders for small record fixtures."""

from __future__ import annotations

from ledgerlens import schemas as S


def fld(value, confidence="high", reasoning="r"):
    return {"value": value, "confidence": confidence, "reasoning": reasoning}


def record(invoice_number="INV-1", vendor="Acme", bill="2026-04-01", due="2026-05-01", po="PO-1",
           subtotal=100.0, tax=8.0, total=108.0, currency="USD", items=None, flags=None,
           confidence="high"):
    return {
        "invoice_number": fld(invoice_number, confidence),
        "vendor": {"name": vendor, "address": "1 Main St", "confidence": confidence, "reasoning": "v"},
        "bill_date": fld(bill, confidence), "due_date": fld(due, confidence), "po_number": fld(po, confidence),
        "subtotal": fld(subtotal, confidence), "tax": fld(tax, confidence), "total": fld(total, confidence),
        "currency": fld(currency, confidence),
        "line_items": items if items is not None else [],
        "flags": flags if flags is not None else [],
    }


def item(description="Widget", quantity=1.0, unit_price=10.0, amount=10.0, reasoning="li"):
    return {"description": description, "quantity": quantity, "unit_price": unit_price, "amount": amount,
            "reasoning": reasoning}


def records_df(spark, recs):
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("order_key", T.LongType()),
                           T.StructField("category", T.StringType()), T.StructField("record", S.RECORD)])
    rows = [(f"D{i}", i, "cat", r) for i, r in enumerate(recs)]
    return spark.createDataFrame(rows, schema)
