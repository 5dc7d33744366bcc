"""What passes of retention and reads of a large store move and write, and that their rows stay the same."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F
from test_store_shuffles import T0, file_rows, filled, plan_of

from tidemark.functions.expressions import settled
from tidemark.model import CLEARED, FAILED, LEDGER_SCHEMA, RUN_SCHEMA, RUN_SUCCESS, SUCCESS
from tidemark.operators import state_store
from tidemark.operators.analytics import SUMS, hourly_parts, merged_sums, rollup
from tidemark.operators.state_store import StateStore


def ended(spark, store, *runs):
    for run in runs:
        row = spark.createDataFrame([("ing", T0, T0, RUN_SUCCESS, run)], "ingestion_id string, started_at timestamp, ended_at timestamp, status string, run_id string")
        store.append("runs", "ing", run, "end", row.select(*[(F.col(f.name) if f.name in row.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in RUN_SCHEMA.fields]))


def aged(spark, root) -> StateStore:
    """Files of days 0 to 39, one a day; the first ten loaded twice, day 5 cleared, one without a time, one without a name."""
    store = StateStore(spark, f"file:{root}", fold_after=None)
    ended(spark, store, "one", "two")
    store.append("ledger", "ing", "one", "done", file_rows(spark, *[(f"f{d:02d}", "one", 24 * d, 1, SUCCESS) for d in range(40)], (None, "one", 24 * 12, 1, FAILED)))
    late = file_rows(spark, *[(f"f{d:02d}", "two", 24 * d + 1, 2, CLEARED if d == 5 else SUCCESS) for d in range(10)], ("timeless", "two", 0, 1, FAILED))
    store.append("ledger", "ing", "two", "done", late.withColumn("processed_at", F.when(F.col("file_path") != "timeless", F.col("processed_at"))))
    return store


def paths(rows):
    return sorted((r.file_path or "", r.run_id, r.status) for r in rows.collect())


@pytest.mark.parametrize("jobs", [1, 64])
def test_later_passes_rewrite_buckets_without_dealing_rows(spark, tmp_path, monkeypatch, capsys, jobs):
    monkeypatch.setattr(state_store, "MOVED_BUCKETS", jobs)
    store = aged(spark, tmp_path / "s")
    archive, merged, plans = f"file:{tmp_path}/archive", [], []
    merge, write = StateStore._merged, getattr(StateStore, "_write_base", None)
    monkeypatch.setattr(StateStore, "_merged", lambda self, table, *a: merged.append(table) or merge(self, table, *a))
    if write:
        monkeypatch.setattr(StateStore, "_write_base", lambda self, table, rows, to: plans.append(plan_of(rows, capsys)) or write(self, table, rows, to))
    one = [("f%02d" % d, "two" if d < 10 else "one", SUCCESS) for d in range(40) if d != 5]
    assert store.retire(archive, T0 + timedelta(days=50), 40) == 9
    assert merged.count("ledger") == 1
    assert store.retire(archive, T0 + timedelta(days=50), 30) == 11
    # The base's rows have one place already: the second pass merges none and deals none.
    assert merged.count("ledger") == 1 and not any("Exchange" in p for p in plans[1:])
    assert store.retire(archive, T0 + timedelta(days=50), 30) == 0
    old = spark.read.parquet(archive).drop("pass")
    assert old.columns == LEDGER_SCHEMA.names
    assert paths(old) == sorted([x for x in one if x[0] < "f20"] + [("", "one", FAILED)])
    assert paths(store.state()) == sorted([x for x in one if x[0] >= "f20"] + [("timeless", "two", FAILED)])
    # Of files that two runs have loaded the version stays, whichever pass took them.
    assert sorted(r.file_path for r in store.versions().collect()) == [f"f{d:02d}" for d in range(10) if d != 5]
    assert sorted(map(tuple, store.rolled("day").collect())) == sorted(map(tuple, rollup(store.state(), "day").collect()))
    assert [r.file_path for r in store.file("ing", "f33").collect()] == ["f33"]


@pytest.mark.parametrize("most", [0, 10_000])
def test_rows_that_leave_are_not_dealt(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(state_store, "COUNTED_BYTES", 0)
    monkeypatch.setattr(state_store, "SHARED_HASHES", most)
    store, dealt = aged(spark, tmp_path / "s"), []
    deal = StateStore._dealt
    monkeypatch.setattr(StateStore, "_dealt", lambda self, table, rows, *a: dealt.append(rows.count()) or deal(self, table, rows, *a))
    archive = f"file:{tmp_path}/archive"
    assert store.retire(archive, T0 + timedelta(days=50), 20) == 30
    # Of 52 events 20 are of files with two; of the others 21 leave.
    assert dealt == [31 if most else 52]
    one = [("f%02d" % d, "two" if d < 10 else "one", SUCCESS) for d in range(40) if d != 5]
    old = spark.read.parquet(archive).drop("pass")
    assert old.columns == LEDGER_SCHEMA.names and paths(old) == sorted([x for x in one if x[0] < "f30"] + [("", "one", FAILED)])
    assert paths(store.state()) == sorted([x for x in one if x[0] >= "f30"] + [("timeless", "two", FAILED)])
    assert sorted(r.file_path for r in store.versions().collect()) == [f"f{d:02d}" for d in range(10) if d != 5]
    # A later event of a file in the archive, and one of a file that stays: base and deltas are counted together.
    late = file_rows(spark, ("f00", "three", 900, 3, FAILED), ("f11", "three", 5, 1, FAILED), ("f30", "three", 24 * 29 + 1, 0, FAILED), ("f31", "three", 24 * 49, 2, FAILED))
    store.append("ledger", "ing", "three", "done", late)
    assert store.retire(archive, T0 + timedelta(days=50), 15) == 5
    assert paths(store.state()) == sorted([x for x in one if x[0] >= "f35"] + [("timeless", "two", FAILED), ("f00", "three", FAILED), ("f31", "three", FAILED)])
    assert sorted(map(tuple, store.rolled("day").collect())) == sorted(map(tuple, rollup(store.state(), "day").collect()))


def test_all_rows_may_leave_the_base(spark, tmp_path):
    store = StateStore(spark, f"file:{tmp_path}/s", fold_after=None)
    store.append("ledger", "ing", "one", "done", file_rows(spark, *[(f"f{d}", "one", d, 1, SUCCESS) for d in range(20)]))
    assert store.fold()
    assert store.retire(f"file:{tmp_path}/archive", T0 + timedelta(days=50), 1) == 20
    assert store.state().count() == 0 and store.retire(f"file:{tmp_path}/archive", T0 + timedelta(days=50), 1) == 0


def test_folded_after_a_pass_in_place(spark, tmp_path):
    store = aged(spark, tmp_path / "s")
    assert store.fold() and store.retire(f"file:{tmp_path}/archive", T0 + timedelta(days=50), 30) == 20
    store.append("ledger", "ing", "three", "done", file_rows(spark, ("f00", "three", 900, 3, FAILED), ("f30", "three", 901, 2, FAILED), ("f31", "three", -5, 1, FAILED)))
    assert store.fold()
    got = paths(store.state())
    assert ("f00", "three", FAILED) in got and ("f30", "three", FAILED) in got and ("f31", "one", SUCCESS) in got and len(got) == 22


@pytest.mark.parametrize("most", [0, 10_000])
def test_only_rows_that_share_a_hash_are_ranked(spark, tmp_path, monkeypatch, capsys, most):
    monkeypatch.setattr(state_store, "COUNTED_BYTES", 0)
    monkeypatch.setattr(state_store, "SHARED_HASHES", most)
    store = filled(spark, tmp_path / "s")
    got = {(r.file_path, r.run_id, r.status) for r in store.state().collect()}
    want = {(f"f{n:03d}", "two" if n < 20 else "one", SUCCESS if n == 0 or n >= 20 else FAILED) for n in range(60) if n != 30}
    assert got == want | {("new", "two", SUCCESS), (None, "one", FAILED), (None, "two", SUCCESS)}
    assert store.state().count() == len(got)
    plan = plan_of(store.state(), capsys)
    # Counted rows pass a look-up before any of them is shuffled.
    assert plan.count("Exchange hashpartitioning") == (1 if most else 2) and ("LeftAnti" in plan) == bool(most)
    assert "LeftAnti" not in plan_of(store.state("ing"), capsys)


def test_each_task_sums_up_what_it_reads(spark, capsys):
    rows = spark.range(0, 5000, 1, 3).select(
        F.when(F.col("id") % 7 > 0, F.concat(F.lit("ing"), F.col("id") % 3)).alias("ingestion_id"), (F.col("id") % 2).cast("int").alias("b"),
        F.when(F.col("id") % 11 > 0, F.timestamp_seconds(F.col("id") * 431 - 1_000_000)).alias("processed_at"),
        F.when(F.col("id") % 5 > 0, F.col("id")).alias("records_ingested"), F.col("id").alias("bytes_read"),
        F.when(F.col("id") % 4 > 0, SUCCESS).when(F.col("id") % 8 > 0, FAILED).otherwise(CLEARED).alias("status"),
    )
    for most in (5, 700, 100_000):
        parts = hourly_parts(StateStore._counted(rows, "b"), most)
        assert "Exchange" not in plan_of(parts, capsys)
        want = rollup(rows.filter(F.col("status") != CLEARED), "hour", by=("ingestion_id", "b"))
        got = parts.groupBy("ingestion_id", "b", "window_start").agg(*[F.sum(c).alias(c) for c in SUMS]).select(*want.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        assert sorted(map(str, merged_sums(parts, "day").collect())) == sorted(map(str, rollup(rows.filter(F.col("status") != CLEARED), "day").collect()))


def test_large_folds_are_dealt_to_more_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state_store, "TASK_ROWS", 5)
    store = filled(spark, tmp_path / "s")
    rows = spark.range(60).select((F.col("id") % 8).cast("int").alias("b"), F.lit("i").alias("ingestion_id"), F.col("id").cast("string").alias("file_path"))
    assert store._dealt("ledger", rows, 60).rdd.getNumPartitions() == 12
    before = paths(store.state())
    assert store.fold() and paths(store.state().filter("file_path is not null")) == [x for x in before if x[0]]


def test_moment_of_a_pass_is_settled(spark):
    at = spark.range(1).select(settled(spark, F.current_timestamp()).alias("t")).collect()[0].t
    assert abs((datetime.now() - at.replace(tzinfo=None)).total_seconds()) < 48 * 3600
    same = settled(spark, F.current_timestamp())
    assert len({spark.range(1).select(same.alias("t")).collect()[0].t for _ in range(2)}) == 1
    for given in (datetime(2025, 1, 1, tzinfo=timezone.utc), "2025-01-01 00:00:00", F.lit("2025-01-01 00:00:00").cast("timestamp_ntz"), F.lit(None).cast("timestamp")):
        kind = spark.range(1).select(settled(spark, given).alias("t")).schema["t"].dataType.simpleString()
        assert kind == ("timestamp_ntz" if isinstance(given, str) or "TIMESTAMP_NTZ" in str(given).upper() else "timestamp")
