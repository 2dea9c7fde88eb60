"""Mixing sources to target weights by cube-method balanced sampling.

Each source gets a target of words: its weight's share of all words, at most ``MAX_REPEAT`` times its own
words, the excess reshared by weight until no source is above. A document's expected number of
copies is target / source size; the whole part is taken as it is, the fraction is an inclusion
probability. The cube method turns those into 0 or 1: a flight phase moves the probabilities of three
documents at a time along the null space of the two balancing equations (document total and word
total of the source), until one of them is 0 or 1. Blocks of a source fly on their own, in parallel;
what a block leaves (two documents at most) meets in the blocks of the next round, and only the last
block of a source lands by chance.

All random choices follow from the seed, the source, the round and the ids, so reruns agree.

Edge cases: null text has no words; a null source is a source of its own, ordered last; sources without
words have target 0; documents without words are taken 0 times (0 words); repeated rows are
units of their own; no rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpoint, no_text, stored

MAX_REPEAT = 3
BLOCK = 4096
EPS = 1e-9


def source_weights(sizes: DataFrame) -> DataFrame:
    """Adds ``w``: 1, 2, 3, repeating, over the sources by code point, null last.

    The rank is dealt out: range parts of the sources are numbered on their own, and only the parts'
    counts are summed in one place."""
    parts = (sizes.repartitionByRange(F.isnull("source"), "source")
             .withColumn("part", F.spark_partition_id()))
    parts = checkpoint(parts)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("part").agg(F.count("*").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.isnull("source"), "source"))
    return (parts.withColumn("rn", rank).join(starts, "part")
            .select("source", "source_size", "n_docs", ((F.col("start") + F.col("rn") - 1) % 3 + 1).alias("w")))


def source_targets(sizes: DataFrame) -> DataFrame:
    """``(source, source_size, n_docs)`` -> the same with ``target``. The share for one unit of weight rises
    round by round as sources reach their ceiling; only sums reach the driver."""
    weighted = checkpoint(source_weights(sizes))
    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    ceiling = F.col("source_size") * F.lit(MAX_REPEAT)
    share = 0.0
    while True:
        full = F.col("w") * F.lit(share) >= ceiling
        kept, weight = weighted.agg(F.sum(F.when(full, ceiling).otherwise(0)),
                                    F.sum(F.when(full, 0).otherwise(F.col("w")))).first()
        if not weight:
            break
        nxt = (total - kept) / weight
        if nxt <= share * (1 + 1e-12):
            break
        share = nxt
    target = F.least(F.col("w") * F.lit(share), ceiling.cast("double")) if share else F.lit(0.0)
    return weighted.select("source", "source_size", "n_docs", target.cast("double").alias("target"))


def _null_vector(sizes: list[float]) -> list[float] | None:
    """A direction that changes neither the documents' nor the words' total."""
    if len(sizes) == 3:
        a, b, c = sizes
        if a == b:
            return [1.0, -1.0, 0.0]
        m = max(abs(c - b), abs(a - c), abs(b - a))
        return [(c - b) / m, (a - c) / m, (b - a) / m]
    return [1.0, -1.0] if len(sizes) == 2 and sizes[0] == sizes[1] else None


def flight(pi: np.ndarray, size: np.ndarray, rng: np.random.Generator, land: bool) -> np.ndarray:
    """Cube method over one block: probabilities moved to 0 or 1, but for the last two at most; with
    ``land`` those too (one equation given up, then none)."""
    p = pi.astype(float).tolist()
    s = size.astype(float).tolist()
    draw = rng.random(2 * len(p) + 8).tolist()
    todo = [i for i in range(len(p) - 1, -1, -1) if EPS < p[i] < 1 - EPS]
    held: list[int] = []
    while True:
        while len(held) < 3 and todo:
            held.append(todo.pop())
        u = _null_vector([s[i] for i in held])
        if u is None and land and len(held) == 2:
            u = [1.0, -1.0]
        if u is None:
            break
        up = min(((1 - p[i]) / x if x > 0 else -p[i] / x) for i, x in zip(held, u) if x)
        down = min((p[i] / x if x > 0 else (p[i] - 1) / x) for i, x in zip(held, u) if x)
        step = up if draw.pop() * (up + down) < down else -down
        for i, x in zip(held, u):
            p[i] += step * x
        held = [i for i in held if EPS < p[i] < 1 - EPS]
    if land:
        for i in held:
            p[i] = float(draw.pop() < p[i])
    out = np.array(p, float)
    out[out <= EPS] = 0.0
    out[out >= 1 - EPS] = 1.0
    return out


def _round(units: DataFrame, seed: int, level: int, one: int) -> DataFrame:
    """One round: units(rid, skey, size, pi, ord, n), n at least the units of a source, in blocks of about ``one`` at most."""
    units = units.withColumn("blocks", F.ceil(F.col("n") / one)).withColumn(
        "block", F.pmod(F.xxhash64("ord", F.lit(seed + level)), F.col("blocks")))

    def fly(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ord", "size", "rid"], kind="stable")
        key = [seed, level, int(pdf["skey"].iloc[0]) & 0xFFFFFFFF, int(pdf["block"].iloc[0])]
        pi = flight(pdf["pi"].to_numpy(), pdf["size"].to_numpy(), np.random.default_rng(key),
                    int(pdf["blocks"].iloc[0]) == 1)
        # a block leaves two units at most
        return pdf[["rid", "skey", "size", "ord"]].assign(pi=pi, n=2 * pdf["blocks"])
    return units.groupBy("skey", "block").applyInPandas(fly, "rid long, skey long, size long, ord long, pi double, n long")


def choose(units: DataFrame, seed: int = 8) -> DataFrame:
    """``units(rid, skey, size, pi, ord, n)``, n at least the units of the row's source, 0 < pi < 1 -> ``(rid, extra)`` with extra 0 or 1."""
    done, level = None, 0
    todo = units
    while True:
        out = checkpoint(_round(todo, seed, level, BLOCK))
        fixed = out.where("pi = 0 or pi = 1").select("rid", F.col("pi").cast("long").alias("extra"))
        done = fixed if done is None else done.union(fixed)
        todo, level = out.where("pi > 0 and pi < 1"), level + 1
        if todo.isEmpty():
            return done


def mix(rows: DataFrame, seed: int = 8) -> DataFrame:
    """``rows(rid, id, source, size)``, rid unique -> ``(rid, source_size, target, copies)``."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    goal = checkpoint(source_targets(sizes).withColumn(
        "e", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)))
    planned = rows.join(goal, rows["source"].eqNullSafe(goal["source"])).select(
        "rid", "size", "source_size", "target", "e", F.col("n_docs").alias("n"), F.xxhash64(rows["source"], F.isnull(rows["source"])).alias("skey"),
        F.xxhash64(F.col("id").cast("string"), "size").alias("ord"))
    whole = F.floor(F.col("e") + EPS)
    planned = planned.withColumn("whole", whole).withColumn("pi", F.greatest(F.col("e") - whole, F.lit(0.0)))
    units = planned.where((F.col("pi") > EPS) & (F.col("size") > 0)).select("rid", "skey", "size", "pi", "ord", "n")
    extra = choose(units, seed)
    return planned.join(extra, "rid", "left").select(
        "rid", "source_size", "target", (F.col("whole") + F.coalesce("extra", F.lit(0))).cast("long").alias("copies"))


def _numbered(df: DataFrame, id_col: str, source: str, size, **more) -> DataFrame:
    return df.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"),
                     F.col(source).cast("string").alias("source"), size.cast("long").alias("size"),
                     *[c.alias(k) for k, c in more.items()])


def size_of(text: str = "text"):
    return F.regexp_count(no_text(text), F.lit(WORD))


def mix_report(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source",
               seed: int = 8) -> DataFrame:
    """One row per document: size, source_size, target, taken words and ``copies``."""
    rows = stored(_numbered(df, id_col, source, size_of(text)), "sizes")
    return rows.join(mix(rows, seed), "rid").select(
        F.col("id").alias(id_col), "size", "source_size", "target",
        (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix_documents(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source",
                  seed: int = 8) -> DataFrame:
    """The mix itself: every document as many times as it is taken; all columns are kept."""
    cols = df.columns
    row = F.struct(*[F.col(f"`{c}`") for c in cols])
    table = stored(_numbered(df, id_col, source, size_of(text), row=row), "mix")
    taken = mix(table.select("rid", "id", "source", "size"), seed).where("copies > 0")
    return (table.select("rid", "row").join(taken.select("rid", "copies"), "rid")
            .select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
            .select(*[F.col(f"row.`{c}`") for c in cols]))
