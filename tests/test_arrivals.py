"""Listings in rounds, streams of listings, and files that can't be read."""

import gzip
import json

import pytest
from pyspark.sql import types as T

from conftest import land
from tidemark.model import IngestionConfig
from tidemark.operators import writer
from tidemark.operators.state_store import StateStore
from tidemark.plans import ingest
from tidemark.plans.ingest import run_ingestion
from tidemark.sources import listing
from tidemark.streaming.ingest import ingest_arrivals


@pytest.fixture
def job(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    table = "arr_" + tmp_path.name.replace("-", "_")
    config = IngestionConfig("arr", f"file:{src}", table, location=f"file:{tmp_path}/table")
    yield config, StateStore(spark, f"file:{tmp_path}/state"), src
    spark.sql(f"DROP TABLE IF EXISTS {table}")


def _rounds(spark, roots, budget):
    """The listing, and the files that the tasks of each of its rounds wrote."""
    found = listing.walk(spark, roots, budget)
    rounds = {}
    for path in found.inputFiles():
        rounds.setdefault(path.rsplit("/", 2)[-2], []).append(path)
    return found, rounds


def test_a_deep_tree_spreads_over_tasks(spark, tmp_path):
    deep = tmp_path / "root" / "only" / "child"
    for a in range(5):
        for b in range(4):
            folder = deep / f"a={a}" / f"b={b}"
            folder.mkdir(parents=True)
            for n in range(3):
                (folder / f"f{n}.json").write_text("x" * n)
    (deep / "_temporary").mkdir()
    (deep / "_temporary" / "no.json").write_text("")
    want = {f"file:{p}": p.stat().st_size for p in deep.rglob("f*.json")}
    found, rounds = _rounds(spark, [f"file:{tmp_path}/root"], 1)
    rows = found.collect()
    assert len(rows) == 60 and {r.path: r.size_bytes for r in rows} == want
    assert len(rounds) > 2 and max(map(len, rounds.values())) > 1  # one child, but a round had several tasks
    small, rounds = _rounds(spark, [f"file:{tmp_path}/root"], listing.FIRST_BUDGET)
    assert small.count() == 60 and set(rounds) == {"round-0"}


def test_listing_of_nothing_and_of_several_roots(spark, tmp_path):
    assert listing.walk(spark, [f"file:{tmp_path}/none"]).count() == 0
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "empty.json").write_text("")
    found = listing.walk(spark, [f"file:{tmp_path}/a", f"file:{tmp_path}/b"]).collect()
    assert [r.size_bytes for r in found] == [0, 0] and all(r.modified_at for r in found)


def test_a_stream_of_listings_has_a_whole_ledger(spark, job):
    config, store, src = job
    land(src, 0, 2, rows=20)
    (src / "empty.json").write_text("")
    ck = f"file:{src.parent}/ck"

    def step():
        ingest_arrivals(spark, config, store, ck).awaitTermination()
        return {r.file_path.rsplit("/", 1)[1]: (r.status, r.records_ingested) for r in store.state("arr").collect()}

    assert step() == {"batch_0.json": ("SUCCESS", 20), "batch_1.json": ("SUCCESS", 20), "empty.json": ("SUCCESS", 0)}
    assert store.runs().count() == 1
    step()
    assert store.runs().count() == 1  # nothing to do leaves no run
    land(src, 2, 1, rows=20)
    (src / "batch_0.json").write_text("")
    (src / "wide.json").write_text(json.dumps({"id": 900, "extra": 1}) + "\n")
    got = step()
    assert got["batch_0.json"] == ("SUCCESS", 0) and got["wide.json"] == ("SUCCESS", 1) and got["batch_2.json"] == ("SUCCESS", 20)
    rows = writer.committed(spark, config.table, store)
    assert sorted(r.id for r in rows.select("id").collect()) == [*range(20, 60), 900] and "extra" in rows.columns


def test_a_batch_that_is_repeated_replaces_itself(spark, job):
    config, store, src = job
    land(src, 0, 2, rows=20)
    run_ingestion(spark, config, store, run_id="arrivals-0000000000", trigger="stream", skip_idle=True)
    land(src, 2, 1, rows=20)  # came after the batch was planned
    ck = f"file:{src.parent}/ck"
    ingest_arrivals(spark, config, store, ck).awaitTermination()
    assert writer.committed(spark, config.table, store).count() == 40
    ingest_arrivals(spark, config, store, ck).awaitTermination()
    assert writer.committed(spark, config.table, store).count() == 60


@pytest.mark.parametrize("given", [False, True])
def test_cut_files_are_found_in_one_job(spark, job, given, monkeypatch):
    config, store, src = job
    config.file_pattern = None
    lines = "\n".join(json.dumps({"id": i, "word": f"w{i * 7919 % 1000}"}) for i in range(3000)).encode()
    whole = gzip.compress(lines)
    for n in range(3):
        (src / f"good{n}.json.gz").write_bytes(whole)
        (src / f"cut{n}.json.gz").write_bytes(whole[: len(whole) * 2 // 3])
    if given:
        config.schema = T.StructType.fromDDL("id bigint, word string")
    calls, writes = [], []
    look, write = ingest._Run.unreadable, writer.write_part
    monkeypatch.setattr(ingest._Run, "unreadable", lambda self, paths: calls.append(len(paths)) or look(self, paths))
    monkeypatch.setattr(writer, "write_part", lambda *a, **k: writes.append(1) or write(*a, **k))
    monkeypatch.setattr(ingest, "unreadable_path", lambda e: pytest.fail("an error's text was read"))
    result = run_ingestion(spark, config, store)
    assert (result.success, result.failed, result.records) == (3, 3, 9000) and calls == [6]
    assert len(writes) == (2 if given else 1)
    assert writer.committed(spark, config.table, store).count() == 9000
    failed = store.state("arr").filter("status = 'FAILED'").collect()
    assert {r.file_path.rsplit("/", 1)[1] for r in failed} == {f"cut{n}.json.gz" for n in range(3)} and all(r.error_type for r in failed)


def test_a_parquet_file_with_a_broken_page(spark, job):
    config, store, src = job
    config.format, config.file_pattern = "parquet", None
    for n in range(3):
        rows = spark.range(n * 1000, n * 1000 + 1000).selectExpr("id", "sha2(string(id), 256) AS word").coalesce(1)
        rows.write.option("compression", "gzip").parquet(f"file:{src}/d{n}")
    broken = next((src / "d1").glob("part-*.parquet"))
    data = bytearray(broken.read_bytes())
    data[200:4000] = b"\x00" * 3800
    broken.write_bytes(bytes(data))
    for crc in src.rglob(".*.crc"):
        crc.unlink()
    result = run_ingestion(spark, config, store)
    assert (result.success, result.failed, result.records) == (2, 1, 2000)
