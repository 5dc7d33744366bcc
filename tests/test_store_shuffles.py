"""How often the state store shuffles its rows, and what stays the same whichever way deltas are merged."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.model import CLEARED, FAILED, LEDGER_SCHEMA, RUN_SCHEMA, RUN_SUCCESS, SUCCESS
from tidemark.operators import state_store
from tidemark.operators.analytics import rollup
from tidemark.operators.ledger import KEY, current_state
from tidemark.operators.state_store import ORDER, StateStore

T0 = datetime(2025, 1, 1, tzinfo=timezone.utc)


def file_rows(spark, *rows):
    """(file, run, hour, seq, status) rows of one ingestion; a file may have no name."""
    given = spark.createDataFrame(
        [("ing", p, run, T0 + timedelta(hours=h), seq, status, 10 * h) for p, run, h, seq, status in rows],
        "ingestion_id string, file_path string, run_id string, event_time timestamp, seq int, status string, records_ingested bigint",
    ).withColumn("processed_at", F.col("event_time"))
    return given.select(*[(F.col(f.name) if f.name in given.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in LEDGER_SCHEMA.fields])


def plan_of(df, capsys) -> str:
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def filled(spark, root) -> StateStore:
    store = StateStore(spark, f"file:{root}", fold_after=None)
    files = [f"f{n:03d}" for n in range(60)]
    store.append("ledger", "ing", "one", "done", file_rows(spark, *[(p, "one", n % 5, 1, SUCCESS) for n, p in enumerate(files)], (None, "one", 1, 1, FAILED)))
    assert store.fold()
    late = [(p, "two", 30 + n % 5, 1, FAILED) for n, p in enumerate(files[:20])]
    late += [(files[30], "two", 40, 1, CLEARED), (files[31], "two", -9, 1, FAILED), ("new", "two", 50, 1, SUCCESS), (None, "two", 60, 1, SUCCESS)]
    store.append("ledger", "ing", "two", "done", file_rows(spark, *late, (files[0], "two", 70, 2, SUCCESS)))
    return store


def test_state_moves_each_row_once(spark, tmp_path, capsys):
    store = filled(spark, tmp_path / "s")
    plan = plan_of(store.state(), capsys)
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan
    per_file = store.state().groupBy("ingestion_id", "retry_count", "file_path").count()
    assert plan_of(per_file, capsys).count("Exchange hashpartitioning") == 2


def test_fold_moves_each_row_once(spark, tmp_path, capsys, monkeypatch):
    seen = []
    merged = StateStore._merged

    def told(self, table, rows, *by):
        out = merged(self, table, rows, *by)
        if table == "ledger":
            seen.append(plan_of(out, capsys))
        return out

    monkeypatch.setattr(StateStore, "_merged", told)
    store = filled(spark, tmp_path / "s")
    assert store.fold() and len(seen) == 2
    # The ended runs are made distinct before they are broadcast; events are dealt once.
    assert all(p.count("Exchange rangepartitioning") == 1 and "SortMergeJoin" not in p for p in seen)
    assert not any("Exchange hashpartitioning(ingestion_id" in p for p in seen)


@pytest.mark.parametrize("share", [0, 1000])
def test_both_ways_of_reading_deltas_agree(spark, tmp_path, monkeypatch, share):
    monkeypatch.setattr(state_store, "DELTA_SHARE", share)
    store = filled(spark, tmp_path / "s")
    got = {(r.file_path, r.run_id, r.status) for r in store.state().collect()}
    want = {(f"f{n:03d}", "two" if n < 20 else "one", SUCCESS if n == 0 or n >= 20 else FAILED) for n in range(60) if n != 30}
    assert got == want | {("new", "two", SUCCESS), (None, "one", FAILED), (None, "two", SUCCESS)}
    assert store.state().count() == len(got)


@pytest.mark.parametrize("grain", ["hour", "day", "week"])
def test_sums_of_deltas_take_out_one_row_of_each_file(spark, tmp_path, grain):
    store = filled(spark, tmp_path / "s")
    assert sorted(map(tuple, store.rolled(grain).collect())) == sorted(map(tuple, rollup(store.state(), grain).collect()))


def test_retired_rows_are_in_base_or_archive(spark, tmp_path):
    store = StateStore(spark, f"file:{tmp_path}/s", fold_after=None)
    for run in ("one", "two"):
        row = spark.createDataFrame([("ing", T0, T0, RUN_SUCCESS, run)], "ingestion_id string, started_at timestamp, ended_at timestamp, status string, run_id string")
        whole = row.select(*[(F.col(f.name) if f.name in row.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in RUN_SCHEMA.fields])
        store.append("runs", "ing", run, "end", whole)
    store.append("ledger", "ing", "one", "done", file_rows(spark, ("a", "one", 0, 1, SUCCESS), ("b", "one", 0, 1, SUCCESS), ("c", "one", 0, 1, FAILED)))
    store.append("ledger", "ing", "two", "done", file_rows(spark, ("a", "two", 1, 1, SUCCESS), ("d", "two", 2000, 1, SUCCESS), ("e", "two", 0, 1, CLEARED)))
    assert store.retire(f"file:{tmp_path}/archive", T0 + timedelta(days=60), 30) == 3
    old = spark.read.parquet(f"file:{tmp_path}/archive").drop("pass")
    assert old.columns == LEDGER_SCHEMA.names
    assert sorted((r.file_path, r.status) for r in old.collect()) == [("a", SUCCESS), ("b", SUCCESS), ("c", FAILED)]
    assert [r.file_path for r in store.state().collect()] == ["d"]
    assert [tuple(r) for r in store.versions().collect()] == [("ing", "a", "two")]
    assert sum(r.file_count for r in store.rolled("day").collect()) == 1
    assert sorted(current_state(store.base("ledger").select(*LEDGER_SCHEMA.names), KEY, ORDER).select("file_path").collect()) == [("d",)]
