"""Embedding near-duplicates: spherical k-means cells and blocked cosine products.

Vectors meet only with vectors of their own label and length. Labels over ``CELL_TARGET`` distinct vectors get spherical
k-means centroids, fitted on a bounded sample. A vector belongs to the cell of its best centroid and is also
held against every cell j that a partner could lie in: a partner at cosine >= t is at most
d = sqrt(2 - 2t) away, so it can be nearer to centroid j only if x.c_own - x.c_j <= d |c_own - c_j|. That bound
is exact, so no link is lost to the cells; on vectors without structure it keeps most cells, and the work is that
of blocked products within a label.

Cells are cut into blocks of about ``BLOCK`` rows and every task multiplies two blocks, so no cell, label or group of
copies is gathered whole. Equal vectors are one row with a count. A task returns each vector's number of links and a
star per group of linked vectors, never all pairs. Of a group (a component of links) the smallest id is kept.

Edge cases: a null label, and a vector that is null, empty, zero or has a null or non-finite component, link with
nothing (0 links, own component, kept); equal vectors link with each other; a null id has a null component; repeated rows are
linked copies; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint
from .components import components, spanning

THRESHOLD = 0.93
BLOCK = 2048
CELL_TARGET = 4096
MAX_CENTROIDS = 1024
SAMPLE_PER_CENTROID = 64
ROUNDS = 8
SLACK = 1e-9


def _matrix(col: pa.Array) -> np.ndarray:
    return np.array(col.to_pylist(), np.float64)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 2) -> np.ndarray:
    """Unit centroids of unit vectors."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 0, total / np.where(size > 0, size, 1), c)
    return c


def _centroids(vectors: DataFrame, sizes: DataFrame) -> dict:
    """(label, dim) -> centroids, for labels over ``CELL_TARGET``: the largest first, ``MAX_CENTROIDS`` in all. Labels without
    centroids are one cell."""
    big = sizes.where(F.col("n") > CELL_TARGET).orderBy(F.desc("n"), "label", "dim").limit(MAX_CENTROIDS // 2).collect()
    total = sum(r["n"] for r in big)
    out: dict = {}
    if not big:
        return out
    want = {(r["label"], r["dim"]): max(2, min(-(-r["n"] // CELL_TARGET), MAX_CENTROIDS * r["n"] // (2 * total))) for r in big}
    spark = vectors.sparkSession
    plan = spark.createDataFrame([(*k, v, float(v * SAMPLE_PER_CENTROID)) for k, v in want.items()], "label long, dim int, k int, s double")
    share = F.pmod(F.xxhash64("nid"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = (vectors.join(sizes, ["label", "dim"]).join(F.broadcast(plan), ["label", "dim"]).where(share < F.col("s") / F.col("n"))
              .select("label", "dim", "k", "nid", "v"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("nid")
        x = np.array(pdf["v"].tolist(), np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        c = spherical_kmeans(x, int(pdf["k"].iloc[0]))
        return pd.DataFrame({"label": pdf["label"].iloc[0], "dim": pdf["dim"].iloc[0], "c": [c.tobytes()]})
    for r in sample.groupBy("label", "dim").applyInPandas(fit, "label long, dim int, c binary").collect():
        out[r["label"], r["dim"]] = np.frombuffer(r["c"]).reshape(-1, r["dim"])
    return out


def _assign(centroids, reach: float):
    """Own cell and the cells to meet (the own one included)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = centroids.value
        for b in batches:
            own, meet = [], []
            for label, dim, v in zip(b.column("label").to_pylist(), b.column("dim").to_pylist(), b.column("v").to_pylist()):
                c = book.get((label, dim))
                if c is None:
                    own.append(0)
                    meet.append([0])
                    continue
                x = np.array(v, np.float64)
                x /= np.sqrt(x @ x)
                s = c @ x
                i = int(np.argmax(s))
                gap = np.sqrt(((c[i] - c) ** 2).sum(1))
                own.append(i)
                meet.append(sorted({i, *np.flatnonzero(s[i] - s <= reach * gap + SLACK).tolist()}))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.int32()), pa.array(meet, pa.list_(pa.int32()))],
                                             names=[*b.schema.names, "cell", "meet"])
    return run


def _products(threshold: float):
    """One pair of blocks: links per vector, and a star over linked vectors."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("nid")
        x = np.array(pdf["v"].tolist(), np.float64)
        size = np.sqrt((x * x).sum(1))
        side, n, nid = pdf["side"].to_numpy(), pdf["n"].to_numpy(), pdf["nid"].to_numpy()
        one = bool(pdf["one"].iloc[0])
        a = np.arange(len(x)) if one else np.flatnonzero(side == 0)
        b = a if one else np.flatnonzero(side == 1)
        links = np.zeros(len(x), np.int64)
        u, v, held = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
        for at in range(0, len(a), 512):
            i = a[at:at + 512]
            near = (x[i] @ x[b].T) / size[i, None] / size[None, b] >= threshold
            if one:
                near[np.arange(len(i)), at + np.arange(len(i))] = False
            links[i] += near @ n[b]
            if not one:
                links[b] += n[i] @ near
            r, c = np.nonzero(near)
            u.append(nid[i[r]])
            v.append(nid[b[c]])
            held += len(r)
            if held > 1 << 19:
                x0, y0 = spanning(np.concatenate(u), np.concatenate(v))
                u, v, held = [x0], [y0], len(x0)
        star = dict(zip(*(z.tolist() for z in spanning(np.concatenate(u), np.concatenate(v)))))
        got = np.flatnonzero(links)
        return pd.DataFrame({"nid": nid[got], "links": links[got], "root": [star.get(k, k) for k in nid[got].tolist()]})
    return run


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label",
                    threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: id, ``n_links`` (other vectors linked directly), ``component_id`` (smallest id reachable by links),
    ``kept`` (it is that id)."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    fine = ("label is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) "
            "and abs(x) < double('infinity')) and exists(v, x -> x != 0)")
    good = F.coalesce(F.expr(fine), F.lit(False))
    # a square must not overflow or vanish; other vectors stay as they are
    largest = F.array_max(F.transform("v", F.abs))
    rows = rows.withColumn("v", F.when(good & ((largest > 1e100) | (largest < 1e-100)), F.transform("v", lambda x: x / largest)).otherwise(F.col("v")))
    valid = rows.where(good)
    vectors = checkpoint(valid.groupBy("label", "v").agg(F.min("id").alias("low"), F.count("*").alias("n"))
                         .select("label", F.size("v").alias("dim"), "v", "low", "n", F.monotonically_increasing_id().alias("nid")))
    sizes = vectors.groupBy("label", "dim").agg(F.count("*").alias("n"))
    book = spark.sparkContext.broadcast(_centroids(vectors.select("label", "dim", "nid", "v"), sizes))
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    cells = checkpoint(vectors.select("label", "dim", "nid", "n", "v").mapInArrow(
        _assign(book, reach), "label long, dim int, nid long, n long, v array<double>, cell int, meet array<int>"))
    blocks = cells.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("p"))
    mine = cells.join(blocks.withColumnRenamed("p", "own_p"), ["label", "dim", "cell"]).withColumn(
        "piece", F.pmod(F.xxhash64("nid"), F.col("own_p")))
    met = (mine.select("label", "dim", "nid", "n", "v", "cell", "piece", F.explode("meet").alias("other"))
           .join(blocks.withColumnRenamed("cell", "other"), ["label", "dim", "other"])
           .select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("p") - 1)).alias("q")))
    me, you = F.struct("cell", "piece"), F.struct(F.col("other").alias("cell"), F.col("q").alias("piece"))
    units = met.select("label", "dim", "nid", "n", "v", F.least(me, you).alias("i"), F.greatest(me, you).alias("j"),
                       (me > you).cast("int").alias("side"), (me == you).alias("one"))
    found = checkpoint(units.groupBy("label", "dim", "i", "j").applyInPandas(_products(threshold), "nid long, links long, root long"))
    links = found.groupBy("nid").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("nid").alias("u"), F.col("root").alias("v")))
    named = (vectors.select("nid", "low", "n", "label", "v").join(links, "nid", "left")
             .join(groups, F.col("nid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "nid")))
    first = named.groupBy("root").agg(F.min("low").alias("component_id"))
    out = named.join(first, "root").select("label", "v", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    linked = valid.join(out, ["label", "v"]).select("id", "n_links", "component_id")
    alone = rows.where(~good).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias(id_col), "n_links", "component_id",
                                      F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
