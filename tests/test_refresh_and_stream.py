import uuid
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F, types as T

from conftest import land
from tidemark.model import LEDGER_SCHEMA, IngestionConfig
from tidemark.operators import writer
from tidemark.operators.state_store import StateStore
from tidemark.plans.ingest import run_ingestion
from tidemark.plans.refresh import refresh
from tidemark.streaming.ingest import ingest_stream, progress_metrics, read_files, settle_empty_files, write_table

T0 = datetime(2025, 1, 1, tzinfo=timezone.utc)
T1 = datetime(2025, 1, 2, tzinfo=timezone.utc)
SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("seen_at", T.StringType()),
    T.StructField("sensor", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("reading", T.DoubleType()),
])


@pytest.fixture
def job(spark, tmp_path):
    name = f"t_{uuid.uuid4().hex[:8]}"
    config = IngestionConfig("ing1", f"file:{tmp_path}/src", name, file_pattern="*.json",
                             location=f"file:{tmp_path}/table")
    yield config, StateStore(spark, f"file:{tmp_path}/state"), tmp_path / "src"
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_full_refresh(spark, job):
    config, store, src = job
    land(src, 0, 3)
    run_ingestion(spark, config, store, T0, "r1")
    dry = refresh(spark, config, store, "full", T1, dry_run=True)
    assert len(dry["operations"]) == 3 and spark.table(config.table).count() == 3000
    assert dry["impact"]["files_to_process"] == 3 and dry["impact"]["files_skipped"] == 0
    out = refresh(spark, config, store, "full", T1, "r2")
    assert out["status"] == "accepted" and [o[0] for o in out["operations"]] == [
        "table_dropped", "processed_files_cleared", "run_triggered"]
    assert out["operations"][0][2]["existed"] and out["operations"][1][2] == 3
    t = writer.committed(spark, config.table, store)
    assert t.count() == 3000 and t.agg(F.min("id"), F.max("id")).first()[:] == (0, 2999)


def test_new_only_refresh_keeps_history(spark, job):
    config, store, src = job
    land(src, 0, 3)
    run_ingestion(spark, config, store, T0, "r1")
    land(src, 3, 2)
    out = refresh(spark, config, store, "new_only", T1, "r2")
    assert [o[0] for o in out["operations"]] == ["table_dropped", "run_triggered"]
    assert (out["impact"]["files_to_process"], out["impact"]["files_skipped"]) == (2, 3)
    t = writer.committed(spark, config.table, store)
    assert t.count() == 2000 and t.agg(F.min("id"), F.max("id")).first()[:] == (3000, 4999)


def test_refresh_stops_at_first_failing_step(spark, job, monkeypatch):
    config, store, src = job
    land(src, 0, 1, rows=10)
    from tidemark.plans import refresh as plan

    def broken(*a, **k):
        raise RuntimeError("no catalog")

    monkeypatch.setattr(plan, "drop_target", broken)
    out = refresh(spark, config, store, "full", T1)
    assert out["status"] == "partial_failure" and len(out["operations"]) == 1


def test_impact_falls_back_without_listing(spark, job):
    config, store, _ = job
    config.source_path = "nosuchscheme://bucket/x"
    out = refresh(spark, config, store, "full", T1, dry_run=True)
    assert out["impact"]["files_to_process"] == 100 and "estimated" in out["impact"]["warning"]
    out = refresh(spark, config, store, "new_only", T1, dry_run=True)
    assert out["impact"]["files_to_process"] == 10


def test_condition_and_range(spark, job):
    config, store, src = job
    land(src, 0, 2, rows=10)
    out = refresh(spark, config, store, "full", T1, "r1", condition="files_to_process > 100")
    assert out["status"] == "condition_not_met"
    out = refresh(spark, config, store, "full", T1, "r2", start="2999-01-01")
    assert out["status"] == "accepted" and out["run"].success == 0


def test_stream_is_one_run_per_batch_and_restarts_exactly(spark, job):
    config, store, src = job
    config.schema, config.file_pattern = SCHEMA, "*.json"
    land(src, 0, 3, rows=100)
    (src / "cut.json").write_text('{"id": 7}\n{"id": ')
    (src / "empty.json").write_text("")
    ck = f"file:{src.parent}/ck"
    q = ingest_stream(spark, config, store, ck, None, max_files_per_trigger=2)
    q.awaitTermination()
    assert len(q.recentProgress) >= 2 and progress_metrics(q.recentProgress)["records_ingested"] > 0
    land(src, 3, 1, rows=100)
    ingest_stream(spark, config, store, ck, None, max_files_per_trigger=2).awaitTermination()
    t = writer.committed(spark, config.table, store)
    assert t.count() == 400 and t.select("id").distinct().count() == 400
    state = store.state("ing1")
    assert state.filter("status = 'SUCCESS' and records_ingested = 100").count() == 4
    assert state.filter("status = 'FAILED'").count() == 1
    assert state.filter("file_path LIKE '%empty.json'").count() == 0
    assert settle_empty_files(spark, config, store) == 1 and settle_empty_files(spark, config, store) == 0
    done = store.state("ing1").filter("file_path LIKE '%empty.json'").first()
    assert (done.status, done.records_ingested) == ("SUCCESS", 0)
    ends = store.runs().filter("trigger = 'stream'").select("started_at", "ended_at", "bytes_written").collect()
    assert all(r.ended_at >= r.started_at for r in ends) and sum(r.bytes_written for r in ends) > 0


def test_stream_to_table(spark, job):
    config, store, src = job
    land(src, 0, 2, rows=50)
    rows = read_files(spark, config.source_path, "json", SCHEMA, max_files_per_trigger=1)
    q = write_table(rows, config.table, f"file:{src.parent}/ck2", partition_columns=("kind",))
    q.awaitTermination()
    assert spark.table(config.table).count() == 100


def test_compaction_and_retention_keep_the_state(spark, job):
    config, store, src = job
    land(src, 0, 2, rows=10)
    run_ingestion(spark, config, store, T0, "r1")
    land(src, 2, 1, rows=10)
    run_ingestion(spark, config, store, T1, "r2")
    before = store.state("ing1").collect()
    assert store.fold() and not store.delta_folders("ledger") and not store.delta_folders("runs")
    assert sorted(store.state("ing1").collect()) == sorted(before)
    assert writer.committed(spark, config.table, store).count() == 30
    land(src, 3, 1, rows=10)
    assert run_ingestion(spark, config, store, T1, "r3").success == 1
    assert store.state("ing1").count() == 4 and writer.committed(spark, config.table, store).count() == 40
    assert store.fold() and store.runs().count() == 3 and not store.fold()
    # What the first fold has merged is gone by now, the state is not.
    assert not store.events("ing1", "r1").count() and store.state("ing1").count() == 4
    assert run_ingestion(spark, config, store, T1, "r4").success == 0
    assert store.retire(f"{store.root}-archive", "2025-04-01 12:00:00", 90) == 2
    assert store.state("ing1").count() == 2 and writer.committed(spark, config.table, store).count() == 40


def test_clear_by_pattern(spark, job):
    from tidemark.plans.refresh import clear

    config, store, src = job
    land(src, 0, 3, rows=10)
    run_ingestion(spark, config, store, T0, "r1")
    assert clear(store, "ing1", T1, "%batch_1.json") == 1
    assert run_ingestion(spark, config, store, T1, "r2").success == 1


def test_stored_sums_follow_every_change(spark, job):
    from datetime import timedelta

    from tidemark.operators import analytics as A

    _, store, src = job
    store.fold_after = None

    def load(run, files, at, status="SUCCESS"):
        rows = [("ing1", f"f{n}", 10, at, None, status, at, at, at, n, 10, 1, None, None, 0, None, at, 1, run) for n in files]
        store.append("ledger", "ing1", run, "done", spark.createDataFrame(rows, LEDGER_SCHEMA))

    def check():
        for grain in A.ROLLUPS:
            want = sorted(tuple(r) for r in A.rollup(store.state(), grain).collect())
            assert sorted(tuple(r) for r in store.rolled(grain).collect()) == want
        return store.rolled("day").inputFiles()

    assert store.rolled("day").count() == 0
    load("r1", range(40), T1)
    check()
    store.fold()
    files = check()
    assert files and not any("/base/" in p for p in files)  # without deltas the sums are all that is read
    load("r2", [3], T1 + timedelta(days=1), "FAILED")
    load("r3", [100], T1 + timedelta(days=1))
    files = check()
    assert 0 < len({p for p in files if "/base/" in p}) <= 2  # of the base the buckets of the two files
    assert [r.file_count for r in store.rolled("day", "ing1").orderBy("window_start").collect()] == [39, 2] and store.rolled("day", "other").count() == 0
    store.fold()
    assert not any("/base/" in p for p in check())
    load("r4", [3, 4], T1 + timedelta(days=9))
    store.fold()
    check()
    assert store.retire(f"file:{src.parent}/archive", T1 + timedelta(days=95), 90) == 39
    check()
