"""Exact top-k search by integer inner product, without random access.

Vectors are scaled to whole numbers. The rows to search are dealt out in blocks of at most ``BLOCK`` rows, and every block sorts its rows once
for each component. A query reads these lists in order, all to the same depth: from the top where its own component is positive,
from the bottom where it is negative. What a row has shown so far gives a lower and an upper bound of its score: a component not yet seen
is at worst the last of its list, at best the last that was read. Reading stops when no more than ``FEW`` rows have an upper bound that
reaches the k-th best lower bound (rows not seen at all have the sum of the last values read as their bound); all others cannot qualify. The final scores
of those left are then resolved in whole numbers, so ties are exact.

A task holds one block and streams a group of queries (at most about ``GROUP``) past it, in batches; it returns k rows for each query.
The best of them over all blocks come from a ranked window, which keeps k rows for each query before its shuffle.

Edge cases: vectors that are null, or hold null or non-finite components, take no part, nor do those with a scaled component of 2^26
or more (scores are exact and fit a long for up to 2,048 components below that). Only vectors of one length meet; two empty ones score 0. A row never
meets itself, but a repeated row meets its copies. A null id is no query and comes last among ties; rows with equal scores and ids are alike.
Other columns are not read. No rows, or no queries, give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

SCALE, K = 256, 5
BLOCK, GROUP, BATCH = 4096, 16384, 256
DEPTHS = (0.125, 0.25, 0.375, 0.5, 0.75)
FEW = 64
LARGEST = 1 << 26


class SortedLists:
    """A block of vectors of one length, sorted by every component."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray):
        self.ids, self.rows, self.vectors = ids, rows, vectors      # ids are masked where null
        self.order = np.argsort(vectors, axis=0, kind="stable")
        self.place = np.argsort(self.order, axis=0, kind="stable")
        self.most = np.abs(vectors).max(initial=0)
        self.read: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def seen(self, depth: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """For reading from the top and from the bottom (side by side) to ``depth``: the components if every one not yet seen were
        the last of its list, and if it were the last that was read."""
        if depth not in self.read:
            v, n = self.vectors, len(self.vectors)
            top, bottom = self.place >= n - depth, self.place < depth
            first, last = self.order[depth - 1], self.order[n - depth]
            at = np.arange(v.shape[1])
            low = np.hstack([np.where(top, v, v[self.order[0], at]), np.where(bottom, v, v[self.order[-1], at])])
            high = np.hstack([np.where(top, v, v[last, at]), np.where(bottom, v, v[first, at])])
            self.read[depth] = low.astype(kind), high.astype(kind)
        return self.read[depth]

    def best(self, queries: np.ndarray, query_rows: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query (its number, places in the block, scores), best first; a row with the query's row number is left out."""
        n = len(self.vectors)
        size = float(np.abs(queries).max(initial=0)) * float(self.most) * max(1, queries.shape[1])
        kind = np.float32 if size < 1 << 24 else np.float64
        slack = 0.0 if size < 1 << 53 else size * 1e-12         # sums beyond are not exact
        both = np.hstack([np.maximum(queries, 0), np.minimum(queries, 0)]).astype(kind)
        own = np.searchsorted(self.rows, query_rows)
        own = np.where((own < n) & (self.rows[np.minimum(own, n - 1)] == query_rows), own, -1)
        left: list[np.ndarray | None] = [None] * len(queries)
        todo = np.arange(len(queries))
        if n > max(FEW, k + 1):
            for part in DEPTHS:
                low, high = self.seen(max(1, int(n * part)), kind)
                lower, upper = both[todo] @ low.T, both[todo] @ high.T
                mine = np.flatnonzero(own[todo] >= 0)
                lower[mine, own[todo][mine]] = upper[mine, own[todo][mine]] = -np.inf
                bar = np.partition(lower, n - k, axis=1)[:, n - k] - slack
                may = upper >= bar[:, None]
                done = may.sum(1) <= FEW
                for i in np.flatnonzero(done):
                    left[todo[i]] = np.flatnonzero(may[i])
                todo = todo[~done]
                if not len(todo):
                    break
        for i, q in enumerate(queries):
            at = np.arange(n) if left[i] is None else left[i]       # not narrowed down: the lists are read to their ends
            at = at[at != own[i]]
            score = self.vectors[at] @ q
            if len(at) > 4 * k:
                keep = score >= np.partition(score, len(at) - k)[len(at) - k]
                at, score = at[keep], score[keep]
            ids = self.ids[at]
            order = np.lexsort((ids.filled(0), np.ma.getmaskarray(ids), -score))[:k]
            yield i, at[order], score[order]


def scaled(vector: Column | str, scale: int = SCALE) -> Column:
    """Whole-number components, or null for a vector that takes no part."""
    v = F.col(vector) if isinstance(vector, str) else vector
    v = v.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < F.lit(float(LARGEST - 1))))
    return F.when(fine, F.transform(v, lambda x: F.floor(x * scale).cast("int")))


def _search(k: int):
    names = ["query_row", "query_id", "score", "vec_id", "row"]

    def lists(batches: list[pa.RecordBatch]) -> dict[int, SortedLists]:
        rows = pa.Table.from_batches(batches)
        length = np.array(pc.list_value_length(rows["v"]).to_numpy())
        out = {}
        for size in np.unique(length).tolist():
            some = rows.filter(pa.array(length == size))
            ids = some["id"].to_pylist()
            ids = np.ma.array([x or 0 for x in ids], np.int64, mask=[x is None for x in ids])
            out[size] = SortedLists(ids, some["row"].to_numpy(), _matrix(some["v"], size))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, block = None, [], None
        for b in batches:
            units, asks = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(units) != 0) | (np.diff(asks) != 0)) + 1
            for at, to in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
                if at == to:
                    continue
                if units[at] != unit:
                    unit, held, block = units[at], [], None
                part = b.slice(at, to - at).select(["row", "id", "v"])
                if not asks[at]:
                    held.append(part)
                    continue
                if block is None:
                    block, held = lists(held) if held else {}, []
                length = pc.list_value_length(part["v"]).to_numpy()
                for size in set(length.tolist()) & block.keys():
                    some = part.filter(pa.array(length == size))
                    row, ids, found = some["row"].to_numpy(), some["id"].to_numpy(), block[size]
                    asked = _matrix(some["v"], size)
                    for s in range(0, len(row), BATCH):
                        best = list(found.best(asked[s:s + BATCH], row[s:s + BATCH], k))
                        q = np.repeat([s + i for i, _, _ in best], [len(p) for _, p, _ in best]).astype(np.int64)
                        p = np.concatenate([p for _, p, _ in best])
                        score = np.concatenate([x for _, _, x in best]).astype(np.int64)
                        other = found.ids[p]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(row[q]), pa.array(ids[q]), pa.array(score),
                             pa.array(other.filled(0), mask=np.ma.getmaskarray(other)), pa.array(found.rows[p])], names=names)
    return run


def _matrix(lists: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    flat = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return flat.flatten().to_numpy().astype(np.int64).reshape(len(lists), size)


def top_k(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector: str = "embedding", k: int = K) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row that ``is_query`` holds for, the k other rows of the highest scores; ties go
    to the smaller id. Ids are whole numbers."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), scaled(vector).alias("v"))
    rows = checkpoint(rows.where("v is not null").withColumn("row", F.monotonically_increasing_id()))
    # blocks: stretches of the checkpoint's partitions
    rows = rows.withColumn("part", F.shiftright("row", 33)).withColumn("piece", F.floor(F.col("row").bitwiseAND((1 << 33) - 1) / BLOCK))
    sizes = rows.groupBy("part", "piece").agg(F.count("*").alias("n"), F.count_if("asks").alias("asking"))
    blocks = checkpoint(sizes.withColumn("block", F.row_number().over(Window.orderBy("part", "piece")) - 1))
    total = blocks.agg(F.count("*").alias("n"), F.sum("asking").alias("q")).first()
    groups = max(1, -(-(total["q"] or 0) // GROUP))
    units = max(1, total["n"] * groups)
    tasks = min(units, max(int(spark.conf.get("spark.sql.shuffle.partitions")), units // 8))
    group = F.pmod(F.xxhash64("row"), F.lit(groups))
    searched = (rows.join(blocks.select("part", "piece", "block"), ["part", "piece"])
                .select("block", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(0).alias("ask"), "row", "id", "v"))
    asked = (rows.where("asks").select(
        F.explode(F.sequence(F.lit(0), F.lit(max(total["n"], 1) - 1))).alias("block"), group.cast("int").alias("g"), F.lit(1).alias("ask"), "row", "id", "v"))
    unit = (F.col("block") * groups + F.col("g")).cast("long")
    dealt = (searched.unionByName(asked).select(unit.alias("unit"), "ask", "row", "id", "v")
             .repartitionById(tasks, F.pmod(F.col("unit"), F.lit(tasks)).cast("int")).sortWithinPartitions("unit", "ask", "row"))
    found = dealt.mapInArrow(_search(k), "query_row long, query_id long, score long, vec_id long, row long")
    first = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return (found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
