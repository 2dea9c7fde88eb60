"""SimHash near-duplicates.

A document's fingerprint has a bit set where over half of its shingle hashes have it. The
fingerprint is embedded as 32 counts of set bits, one per two-bit segment. The Manhattan distance
of two embeddings never exceeds the Hamming distance of the fingerprints, so it is a lower
bound. The range join "distance at most 3" runs over a grid: the segments form six groups, and
a total distance of 3 leaves at least three groups equal; so each fingerprint is put into the
20 cells given by three groups' counts, and two fingerprints within range share a cell. Pairs in
a cell are held against the embedding's distance, then against the exact Hamming distance.

A cell over ``CELL_BLOCK`` fingerprints is dealt out as pairs of blocks, and every task reduces
the links that it finds to a spanning forest: no cell is gathered whole, no group is emitted as
all pairs, and no link between components is lost.

Edge cases: null and empty texts, and texts of white space, have fingerprint zero and link like any
other; fewer words than a shingle give one shingle; repeated rows share a fingerprint; a null id
takes part, and is the smallest id only of a group without other ids; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, stored, text_batches
from .components import components, spanning

SHINGLE, MAX_BITS, SEED = 3, 3, 42
CELL_BLOCK = 2048
HASH_BLOCK = 1 << 15
GROUPS = 6


def fingerprint(text: bytes | None, k: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of a whole text (UTF-8)."""
    words = (text or b"").lower().split()       # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(islice(words, i, None) for i in range(k)))) if len(words) >= k \
        else iter([b" ".join(words)])
    ones, n = np.zeros(64, np.int64), 0
    while block := list(islice(shingles, HASH_BLOCK)):
        h = np.fromiter(map(xxhash.xxh64_intdigest, block, repeat(SEED)), np.uint64, len(block))
        bits = np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(0, dtype=np.int32)
        n += len(block)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def with_fingerprints(df: DataFrame, text: str = "text", out: str = "fp", k: int = SHINGLE) -> DataFrame:
    """Adds the fingerprint of ``text``; keeps all other columns."""
    text_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(text).cast(pa.binary()).to_pylist()
            fps = pa.array([fingerprint(t, k) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, fps], names=[*b.schema.names, out])
    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.LongType())]))


def embed(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 two-bit segments, each in unary (00, 01, 11): the Manhattan distance
    of two embeddings is the number of bits in which these words differ."""
    low = np.uint64(0x5555555555555555)
    fp = fp.astype(np.uint64)
    half = fp >> np.uint64(1)
    return ((fp | half) & low) | (((fp & half) & low) << np.uint64(1))


def cell_masks() -> list[int]:
    """Signed masks of three out of six groups of segments: one per grid."""
    edges = [round(i * 32 / GROUPS) * 2 for i in range(GROUPS + 1)]
    group = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(GROUPS)]
    masks = [sum(group[i] for i in c) for c in combinations(range(GROUPS), GROUPS - MAX_BITS)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _links(key: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between rows of equal key (rows sorted by key)."""
    emb, ufp = embed(fp.view(np.uint64)), fp.view(np.uint64)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    n, at, step, held = len(key), np.arange(len(key)), 1, 0
    while len(at):
        at = at[at + step < n]
        at = at[key[at] == key[at + step]]
        if not len(at):
            break
        near = at[np.bitwise_count(emb[at] ^ emb[at + step]) <= max_bits]
        near = near[np.bitwise_count(ufp[near] ^ ufp[near + step]) <= max_bits]
        if len(near):
            out.append((fp[near], fp[near + step]))
            held += len(near)
        if held > 1 << 19:
            out = [spanning(np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out]))]
            held = len(out[0][0])
        step += 1
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return spanning(np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out]))


def _unit_links(max_bits: int):
    """Streams rows sorted by unit; holds back the last unit of a batch until it is whole.
    A unit has at most two blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def found(rows: np.ndarray) -> pa.RecordBatch:
            key = np.cumsum(np.concatenate([[0], (rows[1:, 1:] != rows[:-1, 1:]).any(1)]))
            u, v = _links(key, np.ascontiguousarray(rows[:, 0]), max_bits)
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())],
                                              names=["u", "v"])
        for b in batches:
            if not b.num_rows:
                continue
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns], 1)
            same = (rows[:, 1:] == rows[-1, 1:]).all(1)
            cut = len(rows) - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield found(np.concatenate([*held, rows[:cut]]))
                held = []
            elif held and (held[-1][-1, 1:] != rows[0, 1:]).any():
                yield found(np.concatenate(held))
                held = []
            held.append(rows[cut:])
        if held:
            yield found(np.concatenate(held))
    return run


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``fps(fp)``, distinct -> links ``(u, v)`` that connect the fingerprints within ``max_bits``
    as all such pairs would."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"max_bits must be 0 to {MAX_BITS}: the grid is built for that")
    low = F.lit(0x5555555555555555)
    half = F.shiftrightunsigned("fp", 1)
    emb = F.col("fp").bitwiseOR(half).bitwiseAND(low).bitwiseOR(
        F.shiftleft(F.col("fp").bitwiseAND(half).bitwiseAND(low), 1))
    cells = F.array(*[F.struct(F.lit(i).cast("long").alias("grid"), emb.bitwiseAND(F.lit(m)).alias("cell"))
                      for i, m in enumerate(cell_masks())])
    rows = fps.select("fp", F.explode(cells).alias("c")).select("fp", "c.grid", "c.cell")
    hot = (rows.groupBy("grid", "cell").count().where(F.col("count") > CELL_BLOCK)
           .withColumn("p", F.ceil(F.col("count") / CELL_BLOCK)).drop("count"))
    own = F.pmod(F.xxhash64("fp"), F.col("p"))
    dealt = (rows.join(hot, ["grid", "cell"], "left").withColumn("p", F.coalesce("p", F.lit(1).cast("long")))
             .withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("p") - 1)))
             .select("fp", "grid", "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")))
    unit = ["grid", "cell", "i", "j"]
    return dealt.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(_unit_links(max_bits), "u long, v long")


def fingerprint_groups(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``fps(fp)``, repeats allowed -> ``(fp, root)``: root names the group of linked fingerprints."""
    fps = checkpoint(fps.select("fp").distinct())
    found = components(fingerprint_links(fps, max_bits))
    return fps.join(found, fps["fp"] == found["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """One row per input row: the id, ``fingerprint`` (16 hex digits), ``component_id`` (smallest id
    reachable by links)."""
    docs = with_fingerprints(df.select(F.col(id_col).alias("id"), F.col(text).alias("text")), k=k)
    docs = checkpoint(docs.select("id", "fp"))
    groups = fingerprint_groups(docs, max_bits)
    low = docs.groupBy("fp").agg(F.min("id").alias("low")).join(groups, "fp")
    first = low.groupBy("root").agg(F.min("low").alias("component_id"))
    named = low.join(first, "root").select("fp", "component_id")
    return docs.join(named, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = SHINGLE,
             max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``df`` that stay: of each group the one with the smallest id (null ids last;
    of repeated rows one). All columns are kept."""
    cols = df.columns
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"),
                       F.col(text).alias("t"), F.monotonically_increasing_id().alias("rid"))
    table = stored(with_fingerprints(packed, "t", k=k).drop("t"), "fingerprints")
    groups = fingerprint_groups(table, max_bits)
    ids = table.select("fp", "rid", F.col(f"row.`{id_col}`").alias("id"))
    order = F.struct(F.isnull("id").alias("n"), "id", "rid")
    one = ids.groupBy("fp").agg(F.min(order).alias("o")).join(groups, "fp").groupBy("root").agg(F.min("o").alias("o"))
    return table.join(one.select("o.rid"), "rid", "left_semi").select(*[F.col(f"row.`{c}`") for c in cols])
