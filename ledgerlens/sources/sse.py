"""Server-sent-event text -> (event, data) messages.

Split on a blank line; the last part is the unfinished remainder; in each
complete message the last ``event: `` line names the event (default
``message``), the last ``data: `` line is the payload; messages without
data are dropped. Column expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.sql import js_trim


def _message_sql(msg: str) -> tuple[str, str]:
    """Event name and payload of one complete message."""
    ev = (f"try_element_at(filter(transform(split({msg}, '\\n', -1), l -> CASE WHEN startswith(l, 'event: ') "
          f"THEN {js_trim('substr(l, 8)')} END), x -> x IS NOT NULL), -1)")
    data = (f"try_element_at(filter(transform(split({msg}, '\\n', -1), l -> CASE WHEN startswith(l, 'data: ') "
            "THEN substr(l, 7) END), x -> x IS NOT NULL), -1)")
    return f"coalesce({ev}, 'message')", data


def parse_messages(messages: DataFrame, *keep: str) -> DataFrame:
    """Complete messages ``msg`` with the columns of ``keep`` -> these, ``event`` and ``data``; those without data are dropped."""
    ev, data = _message_sql("msg")
    return (messages.filter(f"{js_trim('msg')} <> ''").selectExpr(*keep, f"{ev} AS event", f"{data} AS data")
            .filter("data IS NOT NULL AND data <> ''"))


def parse_sse(df: DataFrame, text_col: str = "text", keep=("doc_id",)) -> DataFrame:
    parts = f"split({text_col}, '\\n\\n', -1)"
    msgs = df.selectExpr(*keep, f"posexplode(slice({parts}, 1, size({parts}) - 1)) AS (at, msg)",
                         f"element_at({parts}, -1) AS remainder").withColumn("pos", F.col("at").cast("bigint"))
    return parse_messages(msgs, *keep, "pos", "remainder").select(*keep, "pos", "event", "data", "remainder")


def encode_sse(event: str, data: str) -> str:
    """SQL for one framed message (the encoder of the stream route)."""
    return f"concat('event: ', {event}, '\\n', 'data: ', {data}, '\\n\\n')"
