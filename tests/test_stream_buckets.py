"""F1 (round 4): completion as a stream costs the state store little for each response, and only what is shown travels to the calls."""

import random

import pandas as pd
from pyspark.sql import functions as F

from ledgerlens.operators import chunks as CH
from ledgerlens.plans.replays import replay
from ledgerlens.sources.invoices import AS_OF, invoice_records
from ledgerlens.streaming import chunks as SC


class Store:
    """Typed state of one key in memory; counts its calls."""

    def __init__(self):
        self.values, self.lists, self.maps, self.timers, self.calls, self.now = {}, {}, {}, set(), 0, 0

    def getValueState(self, name, schema, ttlDurationMs=None):
        store = self

        class Value:
            def get(self):
                store.calls += 1
                return store.values.get(name)

            def update(self, v):
                store.calls += 1
                store.values[name] = v

            def clear(self):
                store.calls += 1
                store.values.pop(name, None)
        return Value()

    def getListState(self, name, schema, ttlDurationMs=None):
        store, rows = self, self.lists.setdefault(name, [])

        class Rows:
            def get(self):
                store.calls += 1
                return iter([v for until, v in rows if until > store.now])

            def appendValue(self, v):
                store.calls += 1
                rows.append((store.now + ttlDurationMs, v))
        return Rows()

    def getMapState(self, name, key, schema, ttlDurationMs=None):
        store, m = self, self.maps.setdefault(name, {})

        class Entries:
            def getValue(self, k):
                store.calls += 1
                return m[k]

            def updateValue(self, k, v):
                store.calls += 1
                assert k not in m
                m[k] = v

            def removeKey(self, k):
                store.calls += 1
                del m[k]

            def iterator(self):
                store.calls += 1
                return iter(list(m.items()))

            def clear(self):
                store.calls += 1
                m.clear()
        return Entries()

    def registerTimer(self, at):
        self.calls += 1
        assert all(t <= self.now for t in self.timers)          # the engine unsets a time that came after its call
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)

    def getCurrentProcessingTimeInMs(self):
        return self.now


def fed(store, rows, idle=100):
    """One micro-batch through a processor that begins anew with the state: its closing rows, and those of the times that came."""
    p, out = SC.WholeTexts(idle), []
    p.init(store)
    if rows:
        pdf = pd.DataFrame(rows, columns=["response_id", "seq", "chunk", "last"])
        out += [pdf[:len(pdf) // 2], pdf[len(pdf) // 2:]]
        out = [tuple(r) for d in p.handleInputRows((0,), iter([x for x in out if len(x)]), store) for r in d.itertuples(index=False)]
    for at in [t for t in store.timers if t <= store.now]:
        out += [tuple(r) for d in p.handleExpiredTimer((0,), store, None) for r in d.itertuples(index=False)]
        store.timers.discard(at)
    return out


def test_responses_of_one_batch_need_few_calls_of_the_store():
    counts = []
    for n in (10, 2000):
        store = Store()
        rows = [(f"R{i}", s, f"{i}-{s};", s == 2) for i in range(n) for s in (2, 0, 1)]
        out = fed(store, rows)
        assert sorted(out) == sorted((f"R{i}", f"{i}-0;{i}-1;{i}-2;", 3, False) for i in range(n))
        assert fed(store, rows) == []               # a repeated batch adds nothing
        counts.append(store.calls)
    assert counts[0] == counts[1] < 12


def test_any_order_and_cutting_gives_each_text_once():
    rnd = random.Random(11)
    for _ in range(150):
        texts = {f"R{i}": [rnd.choice(["", "a", "bc", "{", "é"]) for _ in range(rnd.randrange(1, 9))] for i in range(rnd.randrange(1, 6))}
        rows = [(r, s, c or None, s == len(cs) - 1) for r, cs in texts.items() for s, c in enumerate(cs)]
        rows += rnd.sample(rows, len(rows) // 3)
        rnd.shuffle(rows)
        store, got = Store(), []
        while rows:
            n = rnd.randrange(1, 9)
            store.now += rnd.randrange(0, 20)
            got += fed(store, rows[:n], idle=10_000)
            rows = rows[n:]
        assert sorted(got) == sorted((r, "".join(cs), len(cs), False) for r, cs in texts.items())
        assert not store.timers and not store.values and not store.maps["texts"]


def test_each_response_is_idle_for_itself():
    store = Store()
    assert fed(store, [("a", 0, "x", False), ("b", 1, "y", False)]) == []
    store.now = 60
    assert fed(store, [("c", 0, "z", True), ("b", 5, "w", False)]) == [("c", "z", 1, False)]
    store.now = 100
    assert fed(store, []) == [("a", None, 1, True)]                 # b had chunks later
    store.now = 120
    assert fed(store, [("a", 1, "late", True)]) == []               # ended: only its mark is left, renewed
    store.now = 159
    assert fed(store, []) == [] and store.timers == {160}
    store.now = 160
    assert fed(store, []) == [("b", None, 0, True)] and not store.timers and not store.maps["texts"]
    store.now = 219
    assert fed(store, [("a", 0, "x", True)]) == []
    store.now = 400
    assert fed(store, [("a", 0, "x", True)]) == [("a", "x", 1, False)]


def test_text_of_an_open_response_is_written_and_read_once():
    """Many micro-batches: a response's text is put down as it comes, not again with each batch."""
    costs = []
    for n in (10, 200):
        store = Store()
        for s in range(n):
            out = fed(store, [("R", s, "x" * 10, s == n - 1)])
        assert out == [("R", "x" * 10 * n, n, False)]
        costs.append(store.calls / n)
    assert costs[1] <= costs[0] * 1.1


def test_only_what_is_shown_travels_to_the_calls(spark, sf_small):
    done = invoice_records(spark, sf_small).selectExpr("doc_id AS response_id", "record", "CAST(NULL AS STRING) AS error")
    calls = done.selectExpr("response_id", "0.2D AS cost", "0.5D AS cap")
    whole = CH.final_outcome(done, calls, AS_OF)
    narrow = CH.final_outcome(done, calls, AS_OF, shown="size(record.flags) AS n_flags")
    assert narrow.columns == ["response_id", "type", "code", "message", "n_flags", "cost"]
    assert whole.selectExpr(*narrow.columns[:4], "size(record.flags) AS n_flags", "cost").exceptAll(narrow).isEmpty() and narrow.count() == 1500
    join = narrow._jdf.queryExecution().optimizedPlan()
    while "Join" not in join.nodeName():
        join = join.children().apply(0)
    assert "record" not in join.left().output().mkString(" ")


def test_dealt_rows_are_computed_once_and_arrive_part_by_part(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    rows = spark.range(0, 1000, numPartitions=4).mapInArrow(count, "id long")
    got = replay([rows], lambda s: s.select("id", F.current_timestamp().alias("batch")), deal=("1 - id % 2", 2))
    odd, even = got.groupBy((F.col("id") % 2).alias("odd")).agg(
        F.count("*").alias("n"), F.count_distinct("batch").alias("batches"), F.min("batch").alias("at")).orderBy(F.desc("odd")).collect()
    assert seen.value == 1000 and (odd.n, even.n, odd.batches, even.batches) == (500, 500, 1, 1) and odd["at"] < even["at"]


def test_dealt_rows_are_not_sorted_by_their_part(spark):
    """A sort of whole texts spills; the setting that spares it is put back."""
    import glob
    import json
    import os
    import subprocess
    import sys
    import tempfile
    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    code = f"""
from ledgerlens.plans.replays import replay
from ledgerlens.session import get_spark
s = get_spark("local[2]", extra={{"spark.eventLog.enabled": "true", "spark.eventLog.dir": "file://{d}", "spark.eventLog.compress": "false",
                                 "spark.eventLog.rolling.enabled": "false", "spark.checkpoint.dir": "file://{d}/shared",
                                 "spark.shuffle.spill.numElementsForceSpillThreshold": "10"}})
assert replay([s.range(1000)], lambda x: x.select("id"), deal=("id % 2", 2)).count() == 1000
assert s.conf.get("spark.sql.maxConcurrentOutputFileWriters", "0") == "0"
s.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, env=os.environ | {"PYTHONPATH": os.getcwd()}, timeout=200)
    events = [json.loads(x) for x in open(glob.glob(f"{d}/local-*")[0])]
    first = next(e["physicalPlanDescription"] for e in events if "InsertIntoHadoopFsRelationCommand" in e.get("physicalPlanDescription", ""))
    assert "Sort" not in first
    assert sum(e["Task Metrics"]["Memory Bytes Spilled"] for e in events if e["Event"] == "SparkListenerTaskEnd") == 0
