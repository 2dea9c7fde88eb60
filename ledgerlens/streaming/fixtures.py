"""S7 / J8 as files arrive: the parts of a fixture (expected.json, meta.json, the document) come in any order. The state of a folder is
the parts that are there; when all are, the fixture comes out once, and a folder that waits longer than ``wait_ms`` (processing time) for
a part comes out as skipped, with the missing parts named. A folder that has come out keeps a mark for one more wait (state TTL); parts that
arrive again meanwhile change nothing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerlens import schemas as S
from ledgerlens.sources.fixtures import META_SCHEMA
from ledgerlens.streaming.state import with_state

PARTS = ("document", "expected.json", "meta.json")


class Fixtures(StatefulProcessor):
    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "part string", "payload string")
        self.timer = handle.getValueState("timer", "at long")
        self.ended = handle.getValueState("ended", "missing string", ttlDurationMs=self.wait_ms)

    def _out(self, folder: str, held: dict, missing: str | None) -> pd.DataFrame:
        self.parts.clear()
        self.timer.clear()
        self.ended.update((missing or "",))
        return pd.DataFrame([(folder, *(held.get(p) for p in PARTS), missing)], columns=["folder", "document_path", "expected", "meta", "missing"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        given = {part: payload for pdf in rows for part, payload in zip(pdf["part"], pdf["payload"])}
        if self.ended.exists():
            return
        held = {k[0]: v[0] for k, v in self.parts.iterator()}
        for part, payload in given.items():
            if part not in held:
                held[part] = payload
                self.parts.updateValue((part,), (payload,))
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
        if len(held) == len(PARTS):
            yield self._out(key[0], held, None)
            return
        at = timerValues.getCurrentProcessingTimeInMs() + self.wait_ms
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.timer.exists():
            held = {k[0]: v[0] for k, v in self.parts.iterator()}
            yield self._out(key[0], held, ", ".join(p for p in PARTS if p not in held))

    def close(self) -> None:
        pass


def stream_parts(spark: SparkSession, root: str, document_name: str = "invoice.pdf") -> DataFrame:
    """(folder, part, payload) of arriving files: the text of a JSON file, the path of a document."""
    folder = F.regexp_extract("_metadata.file_path", "/([^/]+)/[^/]+$", 1).alias("folder")

    def files(name: str):
        return spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", name)
    out = None
    for name in PARTS[1:]:
        part = files(name).format("text").option("wholetext", True).load(root).select(folder, F.lit(name).alias("part"), F.col("value").alias("payload"))
        out = part if out is None else out.union(part)
    # a document's bytes are not read: its path is the payload
    docs = files(document_name).schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").load(root)
    return out.union(docs.select(F.regexp_extract("path", "/([^/]+)/[^/]+$", 1).alias("folder"), F.lit("document").alias("part"), F.col("path").alias("payload")))


def stream_corpus(parts: DataFrame, wait_ms: int = 3_600_000) -> DataFrame:
    """Fixtures as ``sources.fixtures.read_corpus`` gives them, and skipped folders with ``missing``."""
    rows = with_state(parts, "folder", Fixtures(wait_ms), "folder string, document_path string, expected string, meta string, missing string")
    return rows.select(
        F.when(F.col("missing").isNull(), F.from_json("expected", S.GROUND_TRUTH)).alias("e"), F.from_json("meta", META_SCHEMA).alias("m"),
        "folder", "document_path", "missing").select("e.*", "folder", "m.*", "document_path", "missing")
