"""J4 as a stream: arriving edits over a table of records. The state of a document is the last valid edit of each field, by (ts, seq), so
an edit that arrives late never replaces a later one and a repeated one changes nothing. Only documents with a change in a micro-batch
come out: they are joined to the records, overlaid, and their flags derived anew. ``version`` counts a document's changes; the row of the highest
version is what the batch operators give."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerlens.operators.edits import EDITABLE, coerce_sql, overlay, with_display_flags
from ledgerlens.streaming.state import with_state


class LastEdits(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fields = handle.getMapState("fields", "field string", "ts long, seq long, num double, text string")
        self.version = handle.getValueState("version", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {k[0]: tuple(v) for k, v in self.fields.iterator()}
        changed = set()
        for pdf in rows:
            for field, ts, seq, num, text in zip(*(pdf[c].tolist() for c in ("field", "ts", "seq", "num", "text"))):
                if field not in held or (ts, seq) > held[field][:2]:
                    held[field] = (int(ts), int(seq), None if num is None or num != num else float(num), text)
                    changed.add(field)
        if not changed:
            return
        for field in changed:
            self.fields.updateValue((field,), held[field])
        version = (self.version.get()[0] if self.version.exists() else 0) + 1
        self.version.update((version,))
        row: dict = {"doc_id": key[0], "version": version}
        for f, (_, kind) in EDITABLE.items():
            row[f"has_{f}"] = f in held
            row[f"new_{f}"] = held[f][2 if kind == "money" else 3] if f in held else None
        yield pd.DataFrame([row]).astype({f"new_{f}": "float64" for f, (_, kind) in EDITABLE.items() if kind == "money"})

    def close(self) -> None:
        pass


def stream_latest_edits(edits: DataFrame) -> DataFrame:
    """edits: streaming (doc_id, field, raw, ts, seq), ts a timestamp or a whole number -> a row per document with a change."""
    c = coerce_sql()
    ts = "unix_micros(CAST(ts AS TIMESTAMP))" if isinstance(edits.schema["ts"].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)) else "CAST(ts AS BIGINT)"
    valid = edits.selectExpr("doc_id", "field", f"{ts} AS ts", "CAST(seq AS BIGINT) AS seq", f"{c['valid']} AS valid",
                             f"{c['num']} AS num", f"{c['text']} AS text").where("valid AND doc_id IS NOT NULL").drop("valid")
    known = valid.where(F.col("field").isin(*EDITABLE))
    out = ", ".join(f"has_{f} boolean, new_{f} {'double' if kind == 'money' else 'string'}" for f, (_, kind) in EDITABLE.items())
    return with_state(known, "doc_id", LastEdits(), f"doc_id string, version long, {out}")


def stream_edited_records(edits: DataFrame, records: DataFrame, as_of: str) -> DataFrame:
    """Changed documents with ``edited``, ``edited_fields`` and ``flags``; ``records`` is a static table (doc_id, record, ...)."""
    return with_display_flags(overlay(stream_latest_edits(edits).join(records, "doc_id")), as_of)
