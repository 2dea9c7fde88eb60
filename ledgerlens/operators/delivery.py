"""S14 as a sink: payloads with their idempotency key, delivered once each.

``PayloadSink`` is a Python data source: every task writes one staged file of JSON lines, and the commit writes a small list that names
the files (and counts) of the batch; readers see only what a list names. A batch that fails is aborted, and its staged files, which no
list names, are removed where they can be reached. ``deliver`` leaves out what has been delivered before and keeps one row of each key, so a
repeated batch, or one that failed half-way and runs again, leaves every key once. Targets are folders; nothing is sent over a network.

Rows without a key have nothing to be told apart by, and are all delivered, each time. A null payload is delivered as null.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

SCHEMA = "idempotency_key string, payload string"
BATCHES, PARTS = "_batches", "parts"


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{os.path.abspath(uri)}")


@dataclass
class Part(WriterCommitMessage):
    name: str
    rows: int


class PayloadWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator) -> Part:
        fs, path = _filesystem(self.path)
        name, rows = f"{uuid.uuid4().hex}.jsonl", 0
        fs.create_dir(f"{path}/{PARTS}", recursive=True)
        with fs.open_output_stream(f"{path}/{PARTS}/{name}") as out:
            for row in iterator:
                out.write((json.dumps({"idempotency_key": row["idempotency_key"], "payload": row["payload"]}) + "\n").encode())
                rows += 1
        return Part(name, rows)

    def commit(self, messages: list[Part | None]) -> None:
        parts = [{"name": m.name, "rows": m.rows} for m in messages if m and m.rows]
        if parts:
            fs, path = _filesystem(self.path)
            fs.create_dir(f"{path}/{BATCHES}", recursive=True)
            with fs.open_output_stream(f"{path}/{BATCHES}/{uuid.uuid4().hex}.json") as out:     # one small file: there or not
                out.write(json.dumps({"parts": parts}).encode())

    def abort(self, messages: list[Part | None]) -> None:
        fs, path = _filesystem(self.path)
        for m in messages:
            if m:
                fs.delete_file(f"{path}/{PARTS}/{m.name}")


class PayloadSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "payloads"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> PayloadWriter:
        if overwrite:
            raise ValueError("deliveries are only added to")
        return PayloadWriter(self.options["path"])


def read_deliveries(spark: SparkSession, path: str) -> DataFrame:
    """What has been delivered: the rows of committed batches."""
    fs, local = _filesystem(path)
    info = fs.get_file_info(pafs.FileSelector(f"{local}/{BATCHES}", allow_not_found=True))
    if not info:
        return spark.createDataFrame([], SCHEMA)
    lists = spark.read.schema("parts ARRAY<STRUCT<name: STRING, rows: BIGINT>>").json(f"{path}/{BATCHES}")
    named = lists.selectExpr("inline(parts)").select("name")
    rows = spark.read.schema(SCHEMA).json(f"{path}/{PARTS}").withColumn("name", F.regexp_extract(F.input_file_name(), "([^/]+)$", 1))
    return rows.join(named, "name", "left_semi").drop("name")


def deliver(payloads: DataFrame, path: str) -> None:
    """Adds the payloads (idempotency_key, payload) whose key has not been delivered yet."""
    spark = payloads.sparkSession
    spark.dataSource.register(PayloadSink)
    rows = payloads.select("idempotency_key", "payload")
    keyed = rows.where("idempotency_key IS NOT NULL").dropDuplicates(["idempotency_key"])
    fresh = keyed.join(read_deliveries(spark, path).select("idempotency_key"), "idempotency_key", "left_anti")
    (fresh.select("idempotency_key", "payload").union(rows.where("idempotency_key IS NULL"))
     .write.format("payloads").mode("append").option("path", path).save())
