"""Streams in several micro-batches give what the batch form gives."""

import datetime as dt

import pandas as pd

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelyard.operators import ledger as LG
from panelyard.streaming import alerts as A, ledger_stream as S
from panelyard.streaming.common import new_folder, run_to_end
from test_ledger import SCHEMA, random_ledger


def files(spark, parts, schema, folder):
    import time
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def sink(folder):
    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
    return write


def test_account_state_over_batches(spark):
    rows = random_ledger(21, 240)
    order = np.random.default_rng(3).permutation(240)      # trades arrive in any order
    parts = [[rows[i] for i in order[k::4]] for k in range(4)]
    folder = new_folder(spark, "t")
    stream = files(spark, parts, SCHEMA, f"{folder}/in")
    out = run_to_end(S.account_state(stream, span=7), folder, "update", sink(folder), partitions=2)
    got = spark.read.parquet(out)
    assert got.select("batch").distinct().count() >= 4
    last = got.groupBy("code").agg(F.max_by(F.struct("shares", "avg_cost"), "batch").alias("r")).select("code", "r.*").where("shares > 0")
    got = {r.code: (r.shares, r.avg_cost) for r in last.collect()}
    want = {r.code: (r.shares, r.avg_cost) for r in LG.positions(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == set(want)
    for c in want:
        assert got[c][0] == want[c][0] and got[c][1] == pytest.approx(want[c][1])


def test_breaker_over_batches_equals_a_loop(spark):
    rng = np.random.default_rng(5)
    rows = []
    for a in ("x", "y"):
        nav = 100.0
        for i in range(60):
            new = nav * (1 + rng.normal(0, 0.03))
            rows.append((a, dt.date(2024, 1, 1) + dt.timedelta(days=i), nav, new))
            nav = new
    rows.sort(key=lambda r: r[1])
    order = rng.permutation(len(rows))                      # returns arrive in any order
    schema = "account string, date date, start_nav double, current_nav double"
    folder = new_folder(spark, "t")
    stream = files(spark, [[rows[i] for i in order[k::4]] for k in range(4)], schema, f"{folder}/in")
    out = run_to_end(A.circuit_breaker(stream), folder, "update", sink(folder), partitions=2)
    last = spark.read.parquet(out).groupBy("account", "date").agg(F.max_by(F.struct("allowed", "reason"), "batch").alias("r"))
    got = {(r.account, r.date): (r.r.allowed, r.r.reason) for r in last.collect()}
    step, state = A.Breaker(), {}
    for a, d, start, now in rows:
        tripped, recent = state.get(a, (False, []))
        tripped, recent, why = step.step(tripped, recent, (now - start) / start)
        state[a] = (tripped, recent)
        assert got[(a, d)] == (not tripped, why)
    assert {w for _, w in got.values()} >= {"", "day_loss", "blocked", "recovered"}


def test_breaker_needs_hysteresis():
    with pytest.raises(ValueError):
        A.Breaker(0.05, -0.05)


def test_ingest_rejects_repeats_within_and_across_batches(spark):
    schema = SCHEMA + ", created_at timestamp, position_after_shares long"
    row = lambda i, h, shares=100: (f"e{i}", dt.date(2024, 1, 1), "000001.SH", "buy", shares, 9.0, 0.0, 0.0, 0.0, True, i, dt.datetime(2024, 1, 1, h), 0)
    parts = [[row(1, 9), row(1, 9), row(2, 9, 50)], [row(1, 10), row(3, 10)], [row(3, 11), row(4, 11)]]
    folder = new_folder(spark, "t")
    stream, write = S.ingest(files(spark, parts, schema, f"{folder}/in"), folder)
    out = run_to_end(stream, folder, each_batch=write, partitions=2)
    assert sorted(r.execution_id for r in spark.read.parquet(f"{out}/accepted").collect()) == ["e1", "e3", "e4"]
    assert [r.execution_id for r in spark.read.parquet(f"{out}/quarantine").collect()] == ["e2"]


def test_ingest_checks_rules_before_repeats(spark):
    """Records without an id are kept apart one by one, and a faulty record does not hide its corrected successor."""
    schema = SCHEMA + ", created_at timestamp, position_after_shares long"
    row = lambda i, m, shares=100: (i, dt.date(2024, m, 1), "000001.SH", "buy", shares, 9.0, 0.0, 0.0, 0.0, True, m, dt.datetime(2024, m, 1, 9), 0)
    parts = [[row(None, 1), row(None, 2), row("a", 1, 50)], [row(None, 3), row("a", 1)], [row(None, 3), row("b", 2), row("a", 1)], [row("b", 2), row("a", 1, 50)]]
    folder = new_folder(spark, "t")
    stream, write = S.ingest(files(spark, parts, schema, f"{folder}/in"), folder)
    out = run_to_end(stream, folder, each_batch=write, partitions=2)
    assert sorted(r.execution_id for r in spark.read.parquet(f"{out}/accepted").collect()) == ["a", "b"]
    bad = [r.execution_id for r in spark.read.parquet(f"{out}/quarantine").collect()]
    assert len(bad) == 6 and bad.count(None) == 4 and bad.count("a") == 2


def test_account_state_counts_trades_of_closed_days(spark):
    day = dt.date(2024, 1, 1)
    row = lambda i, d, side="buy": (f"e{i}", day + dt.timedelta(days=d), "000001.SH", side, 100, 9.0, 0.0, 0.0, 0.0, True, i)
    parts = [[row(1, 0)], [row(2, 30)], [row(3, 1), row(4, 29)]]
    folder = new_folder(spark, "t")
    out = run_to_end(S.account_state(files(spark, parts, SCHEMA, f"{folder}/in"), keep=10), folder, "update", sink(folder), partitions=2)
    last = spark.read.parquet(out).orderBy(F.desc("batch")).first()
    assert (last.shares, last.rows, last.late) == (300, 1, 1)


def test_ingest_keeps_late_records(spark):
    schema = SCHEMA + ", created_at timestamp, position_after_shares long"
    row = lambda i, m: (f"e{i}", dt.date(2024, m, 1), "000001.SH", "buy", 100, 9.0, 0.0, 0.0, 0.0, True, i, dt.datetime(2024, m, 1, 9), 0)
    parts = [[row(1, 3), row(2, 3)], [row(3, 1)], [row(4, 1), row(1, 3), row(3, 1)], [row(5, 2)]]
    folder = new_folder(spark, "t")
    stream, write = S.ingest(files(spark, parts, schema, f"{folder}/in"), folder)
    out = run_to_end(stream, folder, each_batch=write, partitions=2)
    assert sorted(r.execution_id for r in spark.read.parquet(f"{out}/accepted").collect()) == ["e1", "e2", "e3", "e4", "e5"]


def test_rate_alerts(spark):
    base = dt.datetime(2024, 1, 1, 9, 30)
    rows = [(base + dt.timedelta(milliseconds=100 * i), i) for i in range(8)] + [(base + dt.timedelta(seconds=5), 99)]
    folder = new_folder(spark, "t")
    stream = files(spark, [rows], "ts timestamp, id int", f"{folder}/in")
    out = run_to_end(A.rate_alerts(stream, 5), folder, "update", sink(folder))
    assert [(str(r.start), r.orders) for r in spark.read.parquet(out).collect()] == [("2024-01-01 09:30:00", 8)]


class CountedState(dict):
    """A map state in memory that counts its calls."""

    calls = 0

    def iterator(self):
        self.calls += 1
        return iter([(k, v) for k, v in self.items()])

    def updateValue(self, key, value):
        self.calls += 1
        self[key] = value

    def removeKey(self, key):
        self.calls += 1
        del self[key]


class Handle:
    def __init__(self):
        self.maps = CountedState()

    def getMapState(self, *_):
        return self.maps

    def getValueState(self, *_):
        return type("Empty", (), {"exists": lambda self: False})()


def test_breaker_calls_its_state_once_a_slot():
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(1500)]
    navs = pd.DataFrame({"date": days, "start_nav": 100.0, "current_nav": [100 + (i * 37 % 13) - 6.5 for i in range(1500)]})
    whole, b = A.Breaker(), A.Breaker()
    whole.init(Handle())
    b.init(handle := Handle())
    want = next(whole.handleInputRows(("a",), iter([navs]), None))
    got = {}
    for part in (navs[1::3], navs[::3], navs[2::3]):
        got.update({r.date: (r.allowed, r.reason) for r in next(b.handleInputRows(("a",), iter([part]), None)).itertuples()})
    assert got == {r.date: (r.allowed, r.reason) for r in want.itertuples()}
    assert handle.maps.calls <= 3 * (2 + 1500 // A.Breaker.SLOT + 1)


def test_breaker_forgets_in_the_middle_of_a_slot():
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(600)]
    navs = pd.DataFrame({"date": days, "start_nav": 100.0, "current_nav": [100 + (i * 37 % 13) - 6.5 for i in range(600)]})
    whole, b = A.Breaker(), A.Breaker(keep=20)
    whole.init(Handle())
    b.init(handle := Handle())
    want = next(whole.handleInputRows(("a",), iter([navs]), None))
    parts = [next(b.handleInputRows(("a",), iter([navs[k:k + 50]]), None)) for k in range(0, 600, 50)]
    assert pd.concat(parts, ignore_index=True).equals(want)
    assert sum(len(v[2]) for v in handle.maps.values()) == 20


def test_account_state_calls_its_state_once_a_slot():
    day = dt.date(2020, 1, 1)
    rows = pd.DataFrame([(day + dt.timedelta(days=i), i, f"e{i}", "sell" if i % 3 == 2 else "buy", 100 * (1 + i % 5), 9.0 + i % 7) for i in range(900)],
                        columns=["trade_date", "seq", "execution_id", "side", "shares", "price"])
    one, s = S.AccountState(span=180), S.AccountState(span=180)
    one.init(Handle())
    s.init(handle := Handle())
    want = next(one.handleInputRows(("a",), iter([rows]), None)).iloc[0]
    for part in (rows[1::3], rows[::3], rows[2::3]):
        got = next(s.handleInputRows(("a",), iter([part]), None)).iloc[0]
    assert (got.shares, got.available, got.avg_cost, got.last_date) == (want.shares, want.available, want.avg_cost, want.last_date)
    assert handle.maps.calls <= 3 * (1 + 900 // 180 + 1)


def test_account_state_shares_entries_when_nothing_is_closed():
    day = dt.date(2020, 1, 1)
    rows = pd.DataFrame([(day + dt.timedelta(days=i), i, f"e{i}", "sell" if i % 3 == 2 else "buy", 100 * (1 + i % 5), 9.0 + i % 7) for i in range(900)],
                        columns=["trade_date", "seq", "execution_id", "side", "shares", "price"])
    ends = []
    for s, calls in ((S.AccountState(span=180), 3 * 3), (S.AccountState(keep=10 ** 6, span=180), 3 * 7)):
        s.init(handle := Handle())
        for part in (rows[1::3], rows[::3], rows[2::3]):
            got = next(s.handleInputRows(("a",), iter([part]), None)).iloc[0]
        ends.append((got.shares, got.available, got.avg_cost, got.last_date))
        assert handle.maps.calls <= calls
    assert ends[0] == ends[1]


def test_streams_are_written_by_all_tasks(spark):
    """Every task writes to each batch; no row is lost or doubled."""
    from panelyard.plans import streaming_queries as Q
    table = spark.range(0, 1000, 1, 3)
    stream, folder = Q.shuffled(table, "t", ("id",))
    files = len(spark.read.parquet(f"{folder}/in").inputFiles())
    out = run_to_end(stream, folder, "append", Q.by_batch(folder))
    got = [(r.batch, r.id) for r in spark.read.parquet(out).collect()]
    assert files == 3 * Q.BATCHES and sorted(i for _, i in got) == list(range(1000))
    assert len({b for b, _ in got}) == Q.BATCHES
