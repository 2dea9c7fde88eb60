"""S9 as a stream of pieces: a response's event-stream text arrives cut anywhere, in any order, and each complete message comes out
once. The state of a response is the unfinished rest (kept on to the next piece), the number of messages so far and the pieces that
arrived early; it ends with the piece marked ``last``, or after ``idle_timeout_ms`` without pieces, and what is unfinished then is dropped, as at
the end of a text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerlens.sources.sse import parse_messages
from ledgerlens.streaming.state import with_state

END = "\n\n"


class Messages(StatefulProcessor):
    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "next_seq long, last_seq long, pos long, rest string, timer long")
        self.early = handle.getMapState("early", "seq long", "piece string")
        self.ended = handle.getValueState("ended", "pos long", ttlDurationMs=self.idle_ms)

    def _end(self, pos: int) -> None:
        self.at.clear()
        self.early.clear()
        self.ended.update((pos,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.ended.exists():
            self.ended.update(self.ended.get())
            for _ in rows:
                pass
            return
        seq, last, pos, rest, timer = self.at.get() if self.at.exists() else (0, None, 0, "", None)
        given: dict[int, str] = {}
        for pdf in rows:
            for s, piece, end in zip(pdf["seq"].tolist(), pdf["piece"].tolist(), pdf["last"].tolist()):
                if s >= seq:
                    given.setdefault(int(s), piece or "")
                if end:
                    last = int(s)
        new = []
        while True:
            if seq in given:
                new.append(given.pop(seq))
            elif self.early.containsKey((seq,)):
                new.append(self.early.getValue((seq,))[0])
            else:
                break
            self.early.removeKey((seq,))
            seq += 1
        *whole, rest = (rest + "".join(new)).split(END)
        out = [(key[0], pos + i, m) for i, m in enumerate(whole)]
        pos += len(whole)
        if timer is not None:
            self.handle.deleteTimer(timer)
        if last is not None and seq > last:
            self._end(pos)
        else:
            for s, piece in given.items():
                if s >= seq and not self.early.containsKey((s,)):
                    self.early.updateValue((s,), (piece,))
            timer = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(timer)
            self.at.update((seq, last, pos, rest, timer))
        if out:
            yield pd.DataFrame(out, columns=["response_id", "pos", "msg"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.at.exists():
            self._end(self.at.get()[2])
        yield from ()

    def close(self) -> None:
        pass


def stream_sse(pieces: DataFrame, idle_timeout_ms: int = 600_000) -> DataFrame:
    """pieces: streaming (response_id, seq, piece, last) -> (response_id, pos, event, data), the rows of ``sources.sse.parse_sse`` over
    the whole text."""
    whole = with_state(pieces, "response_id", Messages(idle_timeout_ms), "response_id string, pos long, msg string")
    return parse_messages(whole, "response_id", "pos")
