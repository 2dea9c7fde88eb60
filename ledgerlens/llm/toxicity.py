"""Toxicity: a character n-gram linear classifier with naive Bayes scaled features.

A document's features are the presence of its character n-grams (``ORDERS`` code points, lower case, hashed to
``BUCKETS`` buckets). Each present feature has the value r, the log ratio of the smoothed shares of toxic and
clean training documents that hold it; a logistic regression with L2 penalty is fitted on those values. Only buckets
whose ratio is at least ``MIN_RATIO`` on at least ``MIN_DOCS`` documents take part.

Document counts per bucket come from all labelled training rows. The weights are fitted on up to ``MAX_FIT_ROWS`` of them
(by a hash of the id, a documented bound on what is fitted): half of each label, and all rows of a label with fewer. Every whole text is
scored, in windows, so memory follows the window and not the text.

Edge cases: null and empty texts get the score of no features; rows without label, or with a null id, are not learned
from; several labels of one id all count; without rows of both labels the score is the share of
label 1 (0 without any); repeated rows score alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, fold, no_text, text_batches, without

ORDERS = (4, 5, 6)
BUCKET_BITS = 20
BUCKETS = 1 << BUCKET_BITS
MAX_FIT_ROWS = 12_000
MIN_RATIO, MIN_DOCS = 2.0, 4
L2, STEPS = 1e-3, 150
WINDOW = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)


def _codes(text: str) -> np.ndarray:
    """Code points of the lowered text between two spaces."""
    return np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def ngram_buckets(codes: np.ndarray) -> np.ndarray:
    """Buckets of all n-grams, repeats included."""
    out, h = [], codes
    for n in range(2, max(ORDERS) + 1):
        if len(codes) < n:
            break
        h = h[: len(codes) - n + 1] * _BASE + codes[n - 1:]
        if n in ORDERS:
            out.append(((h + np.uint64(n)) * _MIX >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
    return np.concatenate(out) if out else np.empty(0, np.int32)


def present(text: str | None, seen: np.ndarray, wanted: np.ndarray | None = None) -> np.ndarray:
    """The distinct buckets of a text (those ``wanted``); ``seen`` is a zeroed scratch table, left zeroed."""
    codes, found = _codes(text or ""), []
    for at in range(0, len(codes), WINDOW):
        b = ngram_buckets(codes[at: at + WINDOW + max(ORDERS) - 1])
        if wanted is not None:
            b = b[wanted[b]]
        b = b[seen[b] == 0]
        place = np.arange(1, len(b) + 1, dtype=np.int32)
        seen[b] = place
        b = b[seen[b] == place]
        seen[b] = 1
        found.append(b)
    out = np.concatenate(found)
    seen[out] = 0
    return out


def _doc_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's documents per bucket and label, in 64 slices."""
    seen = np.zeros(BUCKETS, np.int32)
    n = np.zeros((2, BUCKETS), np.int32)
    for b in batches:
        for text, label in zip(b.column("t").to_pylist(), b.column("label").to_pylist()):
            n[label][present(text, seen)] += 1
    parts = n.reshape(2, 64, -1)
    yield pa.RecordBatch.from_arrays(
        [pa.array(range(64), pa.int32()), pa.array([zlib.compress(parts[:, i].tobytes(), 1) for i in range(64)], pa.binary())],
        names=["slice", "n"])


def _sum_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for k, n in zip(b.column("slice").to_pylist(), b.column("n").to_pylist()):
            total[k] = total.get(k, 0) + np.frombuffer(zlib.decompress(n), np.int32).astype(np.int64)
    for k, n in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([n.tobytes()], pa.binary())], names=["slice", "n"])


def _features(wanted: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, ok = np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, bool)
        ok[wanted] = True
        for b in batches:
            rows = [present(t, seen, ok).tobytes() for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(rows, pa.binary())], names=["label", "f"])
    return run


def fit_weights(rows: list[np.ndarray], y: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, float]:
    """L2-penalised logistic regression by accelerated gradient steps; returns weights and intercept."""
    at = np.concatenate(rows) if rows else np.empty(0, np.int64)
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    x = value[at]
    rate = y.mean()
    weight = np.where(y == 1, 0.5 / rate, 0.5 / (1 - rate)) / len(y)
    w, b = np.zeros(len(value)), 0.0
    pw, pb = w, b
    norm = np.bincount(doc, weights=x * x, minlength=len(rows))
    rate_w = 4.0 / (float(np.dot(weight, norm)) * 1.5 + 1.0)
    for k in range(STEPS):
        m = k / (k + 3)
        vw, vb = w + m * (w - pw), b + m * (b - pb)
        z = np.bincount(doc, weights=x * vw[at], minlength=len(rows)) + vb
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        pw, pb = w, b
        w = vw - rate_w * (np.bincount(at, weights=x * g[doc], minlength=len(value)) + L2 * vw)
        b = vb - rate_w * g.sum()
    return w, b


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic",
          max_rows: int = MAX_FIT_ROWS) -> dict:
    """The model as arrays of a fixed size: weight per bucket (float32) and an intercept."""
    text_batches(df.sparkSession)
    marked = labels.select(F.col(id_col).alias("i"), F.col(label).cast("int").alias("label")).where("label in (0, 1) and i is not null")
    learn = (df.select(F.col(id_col).alias("i"), no_text(text).alias("t")).where(fold("i") != 0))
    spread = 1 << 40
    marked = marked.where(fold("i") != 0).withColumn("h", F.pmod(F.xxhash64(F.col("i").cast("string")), F.lit(spread)))
    found = {r["label"]: r for r in learn.select("i").join(marked, "i").groupBy("label").agg(F.count("*").alias("n"), F.min("h").alias("least")).collect()}
    zero = np.zeros(BUCKETS, np.float32)
    if len(found) < 2:
        return {"w": zero, "b": float(30 if 1 in found else -30)}
    count = {x: r["n"] for x, r in found.items()}
    # texts are shuffled once at every size, whatever the size of the labels: disk grows in proportion
    everything = learn.join(marked.hint("merge"), "i").select("t", "label")
    if sum(count.values()) > max_rows:      # in expectation; by a hash of the id, so reruns agree
        take = {x: min(count[x], max(max_rows // 2, max_rows - count[1 - x])) for x in count}
        cut = {x: max(take[x] * spread // count[x], found[x]["least"] + 1) for x in count}
        picked = marked.where(F.col("h") < F.when(F.col("label") == 1, F.lit(cut[1])).otherwise(F.lit(cut[0])))
        sample = checkpoint(learn.join(F.broadcast(picked), "i").select("t", "label").repartition(12))
    else:
        sample = everything = checkpoint(everything.repartition(12))
    docs = np.zeros((2, 64, BUCKETS // 64), np.int64)
    for r in everything.mapInArrow(_doc_counts, "slice int, n binary").repartition("slice").mapInArrow(_sum_slices, "slice int, n binary").collect():
        docs[:, r["slice"]] += np.frombuffer(r["n"], np.int64).reshape(2, -1)
    docs = docs.reshape(2, -1)
    ratio = np.log((docs[1] + 0.5) / (count[1] + 1)) - np.log((docs[0] + 0.5) / (count[0] + 1))
    wanted = np.flatnonzero((np.abs(ratio) >= MIN_RATIO) & (docs.sum(0) >= MIN_DOCS))
    place = np.full(BUCKETS, -1, np.int64)
    place[wanted] = np.arange(len(wanted))
    got = sorted(sample.mapInArrow(_features(wanted), "label int, f binary").collect())     # in one order, so reruns agree
    rows = [np.sort(place[np.frombuffer(r["f"], np.int32)]) for r in got]
    w, b = fit_weights(rows, np.array([r["label"] for r in got], float), ratio[wanted])
    zero[wanted] = (w * ratio[wanted]).astype(np.float32)
    return {"w": zero, "b": float(b)}


def score(df: DataFrame, model: dict, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the probability of label 1; keeps all columns, but a given column of that name is replaced."""
    spark = df.sparkSession
    text_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    rest = without(df, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b0 = shared.value["w"], shared.value["b"]
        seen, ok = np.zeros(BUCKETS, np.int32), w != 0
        for b in batches:
            z = np.array([np.sort(w[present(t, seen, ok)]).sum(dtype=np.float64) + b0 for t in b.column(text).to_pylist()])
            p = pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), p], names=[*rest, out])
    return df.mapInArrow(run, T.StructType([*(df.schema[c] for c in rest), T.StructField(out, T.DoubleType())]))


def keep_clean(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows whose score is below 0.5; all columns are kept."""
    cols = df.columns
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), no_text(text).alias("t"))
    scored = score(packed, train(df, labels, id_col, text), "t")
    return scored.where("score < 0.5").select(*[F.col(f"row.`{c}`") for c in cols])
