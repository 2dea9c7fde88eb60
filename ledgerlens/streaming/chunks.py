"""R1/R2 as streams, with typed state. Chunks are taken in order of ``seq``, each once, so repeated batches and a restart change nothing.

* ``stream_field_events`` (R1): an event for each field as its value closes, and one closing row: ``complete`` in place of the field
  name when all keys are out, ``error`` after ``idle_timeout_ms`` without chunks (processing time). State per response id: the parser's
  places (a value), the text so far (a list that is only appended to), the places of the keys found (a map) and chunks that arrived
  early (a map). A micro-batch reads the new text and a few characters before it; the text is read again only to give out a value
  that began in an earlier batch.
* ``stream_outcomes`` (R2): the response ends with the chunk marked ``last``; its whole text then goes on to the schema check, the
  merge of rule flags, the join with the (static) calls and the cost gate, and one closing row comes out. A response that is idle
  too long ends as an error of its own. State per bucket of response ids: which chunks of its open responses are there (a value), their
  text (a map that is only added to) and the ended ones (a list). A response that begins and ends in one micro-batch costs no call of
  the state store of its own.
* ``stream_gated_outcomes`` (R2 with W1): the cost gate is a second stateful operator behind the first, with the history of accepted
  costs of each key as its state.

An ended response keeps only a mark, for one more timeout (state TTL), so trailing or repeated chunks neither start it again nor add rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerlens.operators.chunks import FIELD_EVENT_SCHEMA, STREAM_KEYS, FieldParser, _KeyScan, final_outcome
from ledgerlens.streaming.gates import MedianCap
from ledgerlens.streaming.state import with_state

COMPLETE, ERROR = "complete", "error"
WHOLE_SCHEMA = "response_id string, text string, n_chunks long, timed_out boolean"
_EVENT = [c.split()[0] for c in FIELD_EVENT_SCHEMA.split(", ")]
_WHOLE = [c.split()[0] for c in WHOLE_SCHEMA.split(", ")]


class Responses(StatefulProcessor):
    """Takes chunks in order and gives out field events."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "next_seq long, base long, buffer string, searched long, timer long")
        self.parts = handle.getListState("parts", "text string")
        self.keys = handle.getMapState("keys", "field string", "located long, start long, open string, i long, depth int, "
                                                               "in_str boolean, done boolean, emitted boolean")
        self.early = handle.getMapState("early", "seq long", "chunk string")
        self.ended = handle.getValueState("ended", "seq long", ttlDurationMs=self.idle_ms)

    def _text(self) -> str:
        return "".join(p[0] or "" for p in self.parts.get())

    def _restore(self) -> tuple[FieldParser, int, int | None]:
        parser, self.saved = FieldParser(self._text), {}
        if not self.at.exists():
            return parser, 0, None
        seq, parser.base, parser.buffer, parser._searched, timer = self.at.get()
        self.saved = dict((k[0], tuple(v)) for k, v in self.keys.iterator())
        for field, (located, start, open_c, i, depth, in_str, done, emitted) in self.saved.items():
            parser._located[field] = located
            if emitted:
                parser.emitted.add(field)
            if start is not None:
                scan = parser.scans[field] = _KeyScan(start, open_c)
                scan.i, scan.depth, scan.in_str, scan.done = i, depth, in_str, done
        return parser, seq, timer

    def _save(self, parser: FieldParser, seq: int, timer: int) -> None:
        if gone := parser.forget():
            self.parts.appendValue((gone,))
        for field, located in parser._located.items():
            scan = parser.scans.get(field)
            places = (scan.start, scan.open_c, scan.i, scan.depth, scan.in_str, scan.done) if scan else (None,) * 6
            if self.saved.get(field) != (now := (located, *places, field in parser.emitted)):
                self.keys.updateValue((field,), now)
        self.at.update((seq, parser.base, parser.buffer, parser._searched, timer))

    def _end(self, seq: int) -> None:
        for state in (self.at, self.parts, self.keys, self.early):
            state.clear()
        self.ended.update((seq,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rid = key[0]
        if self.ended.exists():
            self.ended.update(self.ended.get())
            for _ in rows:
                pass
            return
        parser, seq, timer = self._restore()
        given: dict[int, str] = {}
        for pdf in rows:
            for s, c in zip(pdf["seq"].tolist(), pdf["chunk"].tolist()):
                if s >= seq:
                    given.setdefault(int(s), c or "")
        out, done = [], False
        while not done:
            if seq in given:
                chunk = given.pop(seq)
            elif self.early.containsKey((seq,)):
                chunk = self.early.getValue((seq,))[0]
            else:
                break
            self.early.removeKey((seq,))
            out += [(rid, k, STREAM_KEYS.index(k), seq, len(v), v) for k, v in parser.feed(chunk)]
            seq += 1
            done = len(parser.emitted) == len(STREAM_KEYS)
        if timer is not None:
            self.handle.deleteTimer(timer)
        if done:
            out.append((rid, COMPLETE, -1, seq - 1, 0, None))
            self._end(seq)
        else:
            for s, c in given.items():
                if s >= seq and not self.early.containsKey((s,)):
                    self.early.updateValue((s,), (c,))
            timer = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(timer)
            self._save(parser, seq, timer)
        if out:
            yield pd.DataFrame(out, columns=_EVENT)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.at.exists():
            seq = self.at.get()[0]
            self._end(seq)
            yield pd.DataFrame([(key[0], ERROR, -1, seq, 0, None)], columns=_EVENT)

    def close(self) -> None:
        pass


def _with(runs: list[int], seqs: list[int]) -> list[int]:
    """Runs of chunk numbers (from, to, from, to ...; the end is not part of a run) with more numbers."""
    out: list[int] = []
    for a, b in sorted([*zip(runs[::2], runs[1::2]), *((s, s + 1) for s in seqs)]):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += (a, b)
    return out


class WholeTexts(StatefulProcessor):
    """The responses of a bucket: gives out the whole text of each that ends. All that a micro-batch brings for the bucket is taken at
    once, so the calls of the state store do not grow with the responses: which chunks are there is one value for all open
    responses, those that ended are a list with TTL. Only the text of a response that stays open is put down by itself, one entry for each micro-batch
    that brings some of it, and read once, when it ends."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "ids array<string>, runs array<array<long>>, last array<long>, parts array<int>, "
                                                 "until array<long>, timer long")
        self.texts = handle.getMapState("texts", "response_id string, part int", "seqs array<long>, chunks array<string>")
        self.ended = handle.getListState("ended", "ids array<string>", ttlDurationMs=self.idle_ms)

    def _restore(self) -> None:
        """``at``: id -> runs of the chunks that are there, number of the last one, entries of its text, when it has been idle too long."""
        saved = self.open.get()
        self.at = dict(zip(saved[0], zip(*saved[1:5]))) if saved else {}
        self.known, self.timer = bool(saved), saved[5] if saved else None

    def _texts(self, ended: list) -> dict[str | None, dict[int, str]]:
        """Removes the responses from those open and returns their chunks."""
        held = [(rid, part) for rid in ended for part in range(self.at[rid][2])]
        for rid in ended:
            del self.at[rid]
        found: dict[str | None, dict[int, str]] = {rid: {} for rid in ended}
        if held and not self.at:            # all at once
            entries = [(k[0], v) for k, v in self.texts.iterator()]
            self.texts.clear()
        else:
            entries = [(k[0], self.texts.getValue(k)) for k in held]
            for k in held:
                self.texts.removeKey(k)
        for rid, (seqs, chunks) in entries:
            found[rid].update(zip(seqs, chunks))
        return found

    def _save(self, ended: list) -> None:
        if ended:
            self.ended.appendValue((ended,))
        due = min((p[3] for p in self.at.values()), default=None)
        # a time stays set while it is not later than the first that is due
        if self.timer is not None and (due is None or due < self.timer):
            self.handle.deleteTimer(self.timer)
            self.timer = None
        if due is not None and self.timer is None:
            self.handle.registerTimer(due)
            self.timer = due
        if self.at:
            self.open.update((list(self.at), *(list(x) for x in zip(*self.at.values())), self.timer))
        elif self.known:
            self.open.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._restore()
        gone = {rid for row in self.ended.get() for rid in row[0]}
        given: dict[str | None, dict[int, str]] = {}
        lasts: dict[str | None, int] = {}
        again: dict[str | None, None] = {}
        for pdf in rows:
            for rid, s, c, end in zip(*(pdf[x].tolist() for x in ("response_id", "seq", "chunk", "last"))):
                if rid in gone:
                    again[rid] = None
                    continue
                mine = given.setdefault(rid, {})
                if s >= 0:
                    mine.setdefault(int(s), c or "")
                if end:
                    lasts[rid] = int(s)
        until, done = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms, []
        for rid, mine in given.items():
            runs, last, parts, _ = self.at.get(rid, ([], None, 0, None))
            last = lasts.get(rid, last)
            for s in [s for s in mine if bisect_right(runs, s) % 2]:     # is there already
                del mine[s]
            runs = _with(runs, list(mine))
            if last is not None and runs and runs[0] == 0 and runs[1] > last:
                done.append(rid)
            elif mine:
                self.texts.updateValue((rid, parts), (list(mine), list(mine.values())))
                parts += 1
            self.at[rid] = (runs, last, parts, until)
        ends = {rid: self.at[rid][1] for rid in done}
        whole = self._texts(done)
        self._save([*again, *done])
        if done:
            out = []
            for rid, last in ends.items():
                chunks = whole[rid] | given[rid]
                out.append((rid, "".join(chunks[s] for s in range(last + 1)), last + 1, False))
            yield pd.DataFrame(out, columns=_WHOLE)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._restore()
        now, self.timer = timerValues.getCurrentProcessingTimeInMs(), None      # the time that came is unset by the engine
        late = {rid: runs[1] if runs and runs[0] == 0 else 0 for rid, (runs, _, _, until) in self.at.items() if until <= now}
        self._texts(list(late))
        self._save(list(late))
        if late:
            yield pd.DataFrame([(rid, None, n, True) for rid, n in late.items()], columns=_WHOLE)

    def close(self) -> None:
        pass


def stream_field_events(chunks: DataFrame, idle_timeout_ms: int = 600_000) -> DataFrame:
    """Streaming DataFrame of (response_id, seq, chunk) -> field events and one closing row per response."""
    return with_state(chunks, "response_id", Responses(idle_timeout_ms), FIELD_EVENT_SCHEMA)


#: Buckets of response ids. A response's state is found by its bucket, so a checkpoint keeps the number it began with.
BUCKETS = 8192


def stream_whole_texts(chunks: DataFrame, idle_timeout_ms: int = 600_000, buckets: int = BUCKETS) -> DataFrame:
    """Streaming (response_id, seq, chunk, last) -> (response_id, text, n_chunks, timed_out), once per response."""
    dealt = chunks.selectExpr(f"CAST(pmod(xxhash64(response_id), {buckets}) AS INT) AS bucket", "response_id", "seq", "chunk", "last")
    return with_state(dealt, "bucket", WholeTexts(idle_timeout_ms), WHOLE_SCHEMA)


def _checked(whole: DataFrame) -> DataFrame:
    from ledgerlens.sources.records import parse_records
    return parse_records(whole, "text").withColumn("error", F.expr("CASE WHEN timed_out THEN 'timeout' ELSE error END"))


def stream_outcomes(chunks: DataFrame, calls: DataFrame, as_of: str, idle_timeout_ms: int = 600_000, shown: str = "record") -> DataFrame:
    """R2: closing rows as ``operators.chunks.final_outcome`` gives them. ``calls``: static (response_id, cost, cap)."""
    done = _checked(stream_whole_texts(chunks, idle_timeout_ms)).select("response_id", "n_chunks", "record", "error")
    return final_outcome(done, calls, as_of, shown)


def stream_gated_outcomes(chunks: DataFrame, calls: DataFrame, as_of: str, idle_timeout_ms: int = 600_000,
                          evict_after_ms: int = 30 * 86_400_000) -> DataFrame:
    """R2 with W1: the cap follows from the last accepted costs of a response's key. ``calls``: static (response_id, key, cost), one row
    per response; a null cost is not gated, and a text that can't be used doesn't count. Responses are decided as they end, those that end in one micro-batch
    by id."""
    whole = _checked(stream_whole_texts(chunks, idle_timeout_ms)).select("response_id", "text", "n_chunks", "timed_out", "error")
    priced = whole.join(calls, "response_id", "left").withColumn("key", F.coalesce("key", F.lit("")))
    priced = priced.withColumn("gated", F.expr("CASE WHEN error IS NULL THEN cost END"))
    carried = "response_id string, text string, n_chunks long, timed_out boolean, cost double"
    names = [c.split()[0] for c in carried.split(", ")]
    gate = with_state(priced.select("key", *names, "gated"), "key",
                      MedianCap("gated", names, ["response_id"], evict_after_ms), f"{carried}, exceeded boolean, cap double, median double")
    done = _checked(gate).select("response_id", "n_chunks", "record", "error", "cost", "cap")
    return final_outcome(done, None, as_of)
