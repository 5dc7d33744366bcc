"""The end-to-end scenarios: basic, incremental, evolution, bad files, replay."""

import json
import uuid
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from conftest import evolved_record, land
from tidemark.model import IngestionConfig
from tidemark.operators import writer
from tidemark.operators.state_store import StateStore
from tidemark.plans.ingest import run_ingestion

T0 = datetime(2025, 1, 1, tzinfo=timezone.utc)


@pytest.fixture
def job(spark, tmp_path):
    name = f"t_{uuid.uuid4().hex[:8]}"
    config = IngestionConfig("ing1", f"file:{tmp_path}/src", name, file_pattern="*.json",
                             location=f"file:{tmp_path}/table")
    store = StateStore(spark, f"file:{tmp_path}/state")
    yield config, store, tmp_path / "src"
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def rows(spark, config, store):
    return writer.committed(spark, config.table, store)


def test_basic(spark, job):
    config, store, src = job
    land(src, 0, 3)
    r = run_ingestion(spark, config, store, T0, "r1")
    assert (r.status, r.success, r.failed, r.records) == ("success", 3, 0, 3000)
    t = rows(spark, config, store)
    assert sorted(t.columns) == ["id", "kind", "reading", "seen_at", "sensor"]
    assert t.count() == 3000 and t.select("id").distinct().count() == 3000
    run = store.runs().filter("run_id = 'r1'").first()
    assert run.files_processed == 3 and run.error_count == 0 and run.bytes_written > 0
    sizes = sum(p.stat().st_size for p in src.glob("*.json"))
    assert run.bytes_read == sizes


def test_incremental(spark, job):
    config, store, src = job
    land(src, 0, 3)
    run_ingestion(spark, config, store, T0, "r1")
    land(src, 3, 2)
    config.row_count_threshold = 2000
    r = run_ingestion(spark, config, store, T0, "r2")
    assert (r.success, r.records, r.low_row_count) == (2, 2000, False)
    t = rows(spark, config, store)
    assert t.count() == 5000 and t.select("id").distinct().count() == 5000
    r = run_ingestion(spark, config, store, T0, "r3")
    assert (r.status, r.success, r.failed, r.records, r.low_row_count) == ("success", 0, 0, 0, True)


def test_schema_evolution(spark, job):
    config, store, src = job
    land(src, 0, 3)
    run_ingestion(spark, config, store, T0, "r1")
    land(src, 3, 2, evolved_record)
    r = run_ingestion(spark, config, store, T0, "r2")
    assert set(r.added_columns) == {"site", "device"}
    t = rows(spark, config, store)
    assert len(t.columns) == 7 and t.count() == 5000
    old, new = t.filter("id < 3000"), t.filter("id >= 3000")
    assert old.filter("site is null and device is null").count() == 3000
    assert new.filter("site is not null and device.maker is not null").count() == 2000
    versions = {v.version: v.resolution_type for v in store.read("schema_versions").collect()}
    assert versions == {1: "initial", 2: "auto_merge"}


def test_bad_and_empty_files(spark, job):
    config, store, src = job
    land(src, 0, 2)
    (src / "empty.json").write_text("")
    (src / "cut.json").write_text(json.dumps({"id": 9001, "reading": 1.0}) + '\n{"id": 90')
    (src / "conflict.json").write_text(json.dumps({"id": "abc", "reading": 1.0}) + "\n")
    run_ingestion(spark, config, store, T0, "r0", manifest=None)
    state = {r.file_path.rsplit("/", 1)[1]: r for r in store.state("ing1").collect()}
    assert state["empty.json"].status == "SUCCESS" and state["empty.json"].records_ingested == 0
    assert state["cut.json"].status == "FAILED" and state["cut.json"].error_type == "MalformedRecordError"
    assert state["batch_0.json"].records_ingested == 1000
    assert state["conflict.json"].status == "SKIPPED"
    assert dict(rows(spark, config, store).dtypes)["id"] == "bigint"


def test_conflicting_type_is_held_back(spark, job):
    config, store, src = job
    land(src, 0, 1)
    run_ingestion(spark, config, store, T0, "r1")
    (src / "conflict.json").write_text(json.dumps({"id": "abc", "reading": 1.0}) + "\n")
    (src / "names with space [x].json").write_text(json.dumps({"id": 5, "reading": 1}) + "\n")
    r = run_ingestion(spark, config, store, T0, "r2")
    assert (r.success, r.failed, r.skipped) == (1, 0, 1)
    held = store.state("ing1").filter("status = 'SKIPPED'").first()
    assert held.error_type == "SchemaEvolutionError" and "id" in held.error_message
    assert rows(spark, config, store).count() == 1001


def test_explicit_schema_takes_one_scan_and_retracts_bad_files(spark, job):
    config, store, src = job
    config.schema = '{"type":"struct","fields":[{"name":"id","type":"long","nullable":true,"metadata":{}},' \
                    '{"name":"reading","type":"double","nullable":true,"metadata":{}}]}'
    land(src, 0, 2)
    (src / "bad.json").write_text('{"id": 7, "reading": 1.5}\n{"id": "x", "reading": 2}\n')
    r = run_ingestion(spark, config, store, T0, "r1")
    assert (r.status, r.success, r.failed, r.records) == ("partial", 2, 1, 2000)
    t = rows(spark, config, store)
    assert t.columns == ["id", "reading"] and t.count() == 2000 and t.filter("id = 7").count() < 2
    bad = writer.rejected(spark, config.table, store.runs()).collect()
    assert len(bad) == 1 and '"x"' in bad[0]["_corrupt_record"]


def test_quarantine_keeps_good_records(spark, job):
    config, store, src = job
    config.on_bad_records = "quarantine"
    land(src, 0, 1)
    (src / "cut.json").write_text(json.dumps({"id": 9001, "reading": 1.0}) + '\n{"id": 90')
    r = run_ingestion(spark, config, store, T0, "r1")
    assert (r.success, r.failed, r.records) == (2, 0, 1001)
    assert writer.rejected(spark, config.table, store.runs()).count() == 1


def test_crash_leaves_nothing_visible_and_replay_is_idempotent(spark, job, monkeypatch):
    config, store, src = job
    land(src, 0, 3)
    from tidemark.plans import ingest

    def lost(self, files, scans):
        raise RuntimeError("executor lost")

    with monkeypatch.context() as m:
        m.setattr(ingest._Run, "finish_files", lost)
        with pytest.raises(RuntimeError):
            run_ingestion(spark, config, store, T0, "r1")
    assert rows(spark, config, store).count() == 0
    assert store.runs().filter("run_id = 'r1'").first().status == "failed"
    land(src, 3, 1)
    r = run_ingestion(spark, config, store, T0, "r1")
    assert (r.success, r.records) == (3, 3000)
    assert rows(spark, config, store).count() == 3000
    r = run_ingestion(spark, config, store, T0, "r2")
    assert (r.success, r.records) == (1, 1000)
    # A replay with another number of scans leaves no rows of the earlier ones.
    config.files_per_scan = 1
    assert run_ingestion(spark, config, store, T0, "r1").records == 3000
    config.files_per_scan = 50_000
    assert run_ingestion(spark, config, store, T0, "r1").records == 3000
    assert rows(spark, config, store).count() == 4000


def test_several_scans_per_run(spark, job):
    config, store, src = job
    config.files_per_scan = 3
    land(src, 0, 8, rows=10)
    r = run_ingestion(spark, config, store, T0, "r1")
    assert (r.success, r.records) == (8, 80)
    assert rows(spark, config, store).select("id").distinct().count() == 80


def test_partition_and_cluster_columns(spark, job):
    config, store, src = job
    config.partition_columns = ("kind",)
    config.cluster_columns = ("sensor", "id")
    land(src, 0, 2)
    run_ingestion(spark, config, store, T0, "r1")
    parts = [r[0] for r in spark.sql(f"SHOW PARTITIONS {config.table}").collect()]
    assert len(parts) == 4 and all("kind=" in p for p in parts)
    assert rows(spark, config, store).groupBy("kind").count().filter("count = 500").count() == 4


def test_merge_publishes_latest_per_key(spark, job):
    config, store, src = job
    config.write_mode, config.merge_keys = "merge", ("id",)
    land(src, 0, 1, rows=10)
    run_ingestion(spark, config, store, T0, "r1")
    (src / "update.json").write_text("\n".join(json.dumps({"id": i, "reading": -1.0}) for i in (3, 4, 100)) + "\n")
    run_ingestion(spark, config, store, T0, "r2")
    t = spark.table(config.table + "_current")
    assert t.count() == 11 and t.filter("reading = -1.0").count() == 3
    spark.sql(f"DROP VIEW {config.table}_current")


def test_csv_with_two_headers(spark, job):
    config, store, src = job
    config.format, config.format_options, config.file_pattern = "csv", {"header": "true", "delimiter": "|"}, "*.csv"
    src.mkdir(parents=True)
    (src / "a.csv").write_text("id|name\n1|x\n2|y\n")
    (src / "b.csv").write_text("name|extra|id\nz|0.5|3\n")
    r = run_ingestion(spark, config, store, T0, "r1")
    assert (r.success, r.records) == (2, 3)
    got = {tuple(x) for x in rows(spark, config, store).select("id", "name", "extra").collect()}
    assert got == {(1, "x", None), (2, "y", None), (3, "z", 0.5)}


@pytest.mark.parametrize("fmt", ["parquet", "orc"])
def test_corrupt_binary_file_is_isolated(spark, job, fmt):
    config, store, src = job
    config.format, config.file_pattern = fmt, None
    spark.range(100).withColumn("v", F.col("id") * 2).repartition(3).write.format(fmt).save(f"file:{src}")
    (src / f"broken.{fmt}").write_bytes(b"not really a file of this format")
    r = run_ingestion(spark, config, store, T0, "r1")
    assert (r.status, r.success, r.failed, r.records) == ("partial", 3, 1, 100)
    bad = store.state("ing1").filter("status = 'FAILED'").first()
    assert bad.error_type == "CorruptFileError" and bad.file_path.endswith(f"broken.{fmt}")


def test_prefilter_marks_skipped(spark, job):
    config, store, src = job
    config.exclude_pattern = "batch_1"
    land(src, 0, 2, rows=10)
    r = run_ingestion(spark, config, store, T0, "r1")
    assert (r.success, r.skipped) == (1, 1)
    assert store.state("ing1").filter("status = 'SKIPPED'").first().error_message == "excluded"


def test_two_runs_in_one_session_do_not_touch_each_other(spark, job, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    config, store, src = job
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    others = []
    for k in range(2):
        folder = tmp_path / f"src{k}"
        land(folder, k, 1, rows=50)
        others.append(IngestionConfig(f"other{k}", f"file:{folder}", f"{config.table}_{k}", location=f"file:{tmp_path}/table{k}"))
    with ThreadPoolExecutor(2) as pool:
        done = list(pool.map(lambda c: run_ingestion(spark, c, store, T0, f"run-{c.ingestion_id}"), others))
    assert [r.records for r in done] == [50, 50]
    assert [rows(spark, c, store).count() for c in others] == [50, 50]
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == mode
    for c in others:
        spark.sql(f"DROP TABLE {c.table}")


def test_key_only_rows_are_merged(spark, job):
    config, store, src = job
    config.write_mode, config.merge_keys = "merge", ("id",)
    run_ingestion(spark, config, store, T0, "r0")
    src.mkdir()
    (src / "a.json").write_text('{"id": 1}\n{"id": 1}\n{"id": 2}\n')
    run_ingestion(spark, config, store, T0, "r1")
    assert sorted(r.id for r in spark.table(config.table + "_current").collect()) == [1, 2]
    spark.sql(f"DROP VIEW {config.table}_current")


def test_clustering_keeps_all_columns_apart(spark):
    table = spark.range(512).select(*[_bit(k).alias(f"c{k}") for k in range(9)])
    out = writer.cluster(table, tuple(f"c{k}" for k in range(9)), 16)
    assert out.count() == 512 and out.distinct().count() == 512
    assert spark.createDataFrame([(128,) * 9], ", ".join(f"c{k} int" for k in range(9))).select(writer.z_value([f"c{k}" for k in range(9)])).first()[0] == "1" * 9 + "0" * 63
    texts = spark.range(1000).select(F.concat(F.lit("s3a://bucket/very/long/prefix/"), F.lpad("id", 6, "0")).alias("uri"))
    placed = writer.cluster(texts, ("uri",), 8).withColumn("p", F.spark_partition_id())
    ranges = sorted((r.lo, r.hi) for r in placed.groupBy("p").agg(F.min("uri").alias("lo"), F.max("uri").alias("hi")).collect())
    assert len(ranges) > 4 and all(a[1] <= b[0] or a[1][:-2] == b[0][:-2] for a, b in zip(ranges, ranges[1:]))


def _bit(k):
    return F.shiftright(F.col("id").cast("int"), k).bitwiseAND(F.lit(1))
