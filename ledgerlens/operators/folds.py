"""Ordered per-key folds with feedback (W1 rolling-median cap, W3 sliding
window admission).

Each decision depends on earlier *decisions* of the same key (rejected
costs never enter the median history; refused requests are not counted).
A fold's state is small (50 costs, or ``limit`` times), so a key need not be one task: the rows are range-partitioned on
(key, order), and a hot key's blocks are folded side by side, each from a guessed start state (the last raw costs before it, or
an empty window). Then the end state of each block is held against the start that the next one assumed, and only blocks whose start was wrong are
folded again, until all agree; the decisions come from a last pass with the right starts. End states soon forget how a block
began, so few blocks repeat; in the worst case (a window that never idles) they repeat one after the other, which is the work
of one task. What the driver holds is one state per block.
"""

from __future__ import annotations

import math
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.session import ensure_checkpoint_dir


class Fold:
    """A state machine over the rows of one key: ``load`` a state from a list of numbers, ``step`` it over row ``i`` of the
    columns (giving out the decision), and ``guess`` the list that some rows may leave, if all of them were accepted."""

    def __init__(self, load, step, guess=None):
        self.load, self.step, self.guess = load, step, guess


def _keys(pdf: pd.DataFrame, key: list[str]) -> list[tuple]:
    return list(zip(*[[None if x != x else x for x in pdf[k].tolist()] for k in key]))       # one null, whatever its kind


def _edges(ranged: DataFrame, key: list[str], fold: Fold) -> list:
    """Per block its first and last key, and the guess that the last key's rows in it give."""
    fields = [T.StructField("_pid", T.IntegerType())]
    fields += [T.StructField(f"{side}{i}", ranged.schema[k].dataType) for side in ("first", "last") for i, k in enumerate(key)]
    fields += [T.StructField("guess", T.ArrayType(T.DoubleType()))]

    def fn(it):
        first = last = None
        guess: list[float] = []
        for pdf in it:
            if pdf.empty:
                continue
            keys = _keys(pdf, key)
            first = first or keys[0]
            if keys[-1] != last:
                guess = []
            last = keys[-1]
            if fold.guess:
                own = np.array([k == last for k in keys])
                guess = fold.guess(guess, {c: pdf[c].to_numpy()[own] for c in pdf.columns})
            pid = int(pdf["_pid"].iloc[0])
        if first is not None:
            yield pd.DataFrame([(pid, *first, *last, guess)], columns=[f.name for f in fields])
    n = len(key)
    return sorted((r["_pid"], tuple(r)[1:1 + n], tuple(r)[1 + n:1 + 2 * n], list(r["guess"]))
                  for r in ranged.mapInPandas(fn, T.StructType(fields)).collect())


def _block_ends(ranged: DataFrame, key: list[str], fold: Fold, starts: dict[int, list], last: dict[int, tuple]) -> dict[int, list]:
    """End states of the last key of the blocks in ``starts``."""
    shared = ranged.sparkSession.sparkContext.broadcast((starts, last))

    def fn(it):
        starts, last = shared.value
        state = pid = None
        for pdf in it:
            if pdf.empty:
                continue
            if pid is None:
                pid = int(pdf["_pid"].iloc[0])
                state = fold.load(starts[pid])
            own = pdf[np.array([k == last[pid] for k in _keys(pdf, key)])]
            cols = {c: own[c].to_numpy() for c in own.columns}
            for i in range(len(own)):
                state, _ = fold.step(state, cols, i)
        if pid is not None:
            yield pd.DataFrame({"_pid": [pid], "state": [[float(x) for x in state]]})
    rows = ranged.where(F.col("_pid").isin(sorted(starts))).mapInPandas(fn, "_pid int, state array<double>").collect()
    return {r["_pid"]: list(r["state"]) for r in rows}


def _starts(ranged: DataFrame, key: list[str], fold: Fold) -> dict[int, list]:
    """The state that each block's first key begins with."""
    edges = _edges(ranged, key, fold)
    last = {pid: e for pid, _, e, _ in edges}
    before: dict[int, int] = {}             # block -> the one before it, if its first key goes on from there
    for (p, _, e, _), (q, f, _, _) in zip(edges, edges[1:]):
        if e == f:
            before[q] = p
    whole = {pid for pid, f, e, _ in edges if f == e}       # blocks of one key: their end depends on their start
    start: dict[int, list] = {pid: [] for pid in last}
    if fold.guess:
        carried: list = []
        for pid, _, _, guess in edges:
            if pid in before:
                start[pid] = carried
            tail = (carried if pid in before and pid in whole else []) + guess
            carried = tail[-fold.load.most:]
    ends: dict[int, list] = {}
    wanted = set(before.values())           # blocks whose end another one goes on from
    todo = {p: start[p] if p in whole else [] for p in wanted}
    while todo:
        ends |= _block_ends(ranged, key, fold, todo, last)
        wrong = [q for q, p in before.items() if ends[p] != start[q]]
        for q in wrong:
            start[q] = ends[before[q]]
        todo = {q: start[q] for q in wrong if q in wanted and q in whole}
    return start


def _run_fold(df: DataFrame, key: list[str], order: list[str], fold: Fold, out_fields: list[T.StructField],
              num_partitions: int | None):
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType(df.schema.fields + out_fields)
    names = [f.name for f in out_fields]
    ranged = (df.repartitionByRange(n, *key, *order).sortWithinPartitions(*key, *order)
              .withColumn("_pid", F.spark_partition_id()).checkpoint())
    shared = spark.sparkContext.broadcast(_starts(ranged, key, fold))

    def fn(it):
        last_key, state, begun = None, None, False
        for pdf in it:
            if pdf.empty:
                continue
            if not begun:
                begun, state = True, fold.load(shared.value[int(pdf["_pid"].iloc[0])])
                last_key = _keys(pdf.head(1), key)[0]
            keys = _keys(pdf, key)
            cols = {c: pdf[c].to_numpy() for c in pdf.columns}
            res = {nm: [] for nm in names}
            for i in range(len(pdf)):
                if keys[i] != last_key:
                    last_key, state = keys[i], fold.load([])
                state, vals = fold.step(state, cols, i)
                for nm, v in zip(names, vals):
                    res[nm].append(v)
            out = pdf.drop(columns=["_pid"])
            for nm in names:
                out[nm] = pd.Series(res[nm], dtype="object", index=out.index)
            yield out
    return ranged.mapInPandas(fn, schema)


def sliding_window_admission(df: DataFrame, key: list[str], ts_us: str, order: list[str],
                             limit: int, window_us: int, num_partitions: int | None = None) -> DataFrame:
    """Keep admitted times with ``t > now - window``; at ``limit`` or more
    the call is refused (``retry_after_s = ceil(max(0, oldest + window - now)
    / 1s)``, reset at ``oldest + window``); else admitted, ``remaining =
    limit - count``, reset at ``now + window``. Refused calls are not
    counted."""
    def step(q, cols, i):
        now = int(cols[ts_us][i])
        while q and q[0] <= now - window_us:
            q.popleft()
        if len(q) >= limit:
            oldest = q[0]
            retry = math.ceil(max(0, oldest + window_us - now) / 1_000_000)
            return q, (False, 0, retry, oldest + window_us)
        q.append(now)
        return q, (True, max(0, limit - len(q)), 0, now + window_us)
    out = [T.StructField("ok", T.BooleanType()), T.StructField("remaining", T.LongType()),
           T.StructField("retry_after_s", T.LongType()), T.StructField("reset_at_us", T.LongType())]
    def load(times):
        return deque(int(x) for x in times)
    return _run_fold(df, key, [ts_us, *order], Fold(load, step), out, num_partitions)


HISTORY_CAP = 50
CAP_MULTIPLIER = 3.0
ABSOLUTE_CEILING_USD = 1.0


def _median(h) -> float | None:
    if not h:
        return None
    s = sorted(h)
    m = len(s) // 2
    return (s[m - 1] + s[m]) / 2 if len(s) % 2 == 0 else s[m]


def median_cost_cap(df: DataFrame, key: list[str], cost: str, order: list[str],
                    num_partitions: int | None = None) -> DataFrame:
    """Per call with a cost: ``cost > 1.0`` -> exceeded (cap 1.0); else
    no median (or 0) -> pass; else exceeded iff ``cost > 3 * median`` of the
    last 50 *accepted* costs. Accepted finite, non-negative costs enter the
    history. Calls without a cost pass through with nulls."""
    def step(h, cols, i):
        c = cols[cost][i]
        if c is None or (isinstance(c, float) and np.isnan(c)):
            return h, (None, None, None)
        c = float(c)
        med = _median(h)
        if c > ABSOLUTE_CEILING_USD:
            return h, (True, ABSOLUTE_CEILING_USD, med)
        if med is None or med == 0:
            exceeded, cap = False, None
        else:
            cap = med * CAP_MULTIPLIER
            exceeded = c > cap
        if not exceeded and math.isfinite(c) and c >= 0:
            h.append(c)
        return h, (exceeded, cap, med)
    out = [T.StructField("exceeded", T.BooleanType()), T.StructField("cap", T.DoubleType()),
           T.StructField("median", T.DoubleType())]

    def load(costs):
        return deque(costs, maxlen=HISTORY_CAP)

    def guess(before, cols):
        c = pd.to_numeric(pd.Series(cols[cost]), errors="coerce").to_numpy(dtype=float)
        return (before + c[(c >= 0) & (c <= ABSOLUTE_CEILING_USD)][-HISTORY_CAP:].tolist())[-HISTORY_CAP:]
    load.most = HISTORY_CAP
    return _run_fold(df, key, order, Fold(load, step, guess), out, num_partitions)


def segmented_admission(df: DataFrame, key: str, ts_us: str, order: list[str], limit: int,
                        window_us: int, num_partitions: int | None = None) -> DataFrame:
    """W3 for one key column. After an idle time of one window every admitted time has lapsed, so a block that holds one ends alike
    whatever it began with, and is folded once."""
    return sliding_window_admission(df, [key], ts_us, order, limit, window_us, num_partitions)
