"""Schemas as rows, reshaping, approvals, the folded store and bucketed merges."""

import json
import uuid
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F, types as T

from tidemark.functions import schema_nodes as N, schema_types as ST
from tidemark.model import IngestionConfig
from tidemark.operators import writer
from tidemark.operators.state_store import StateStore
from tidemark.operators.upsert import Buckets
from tidemark.plans.approval import decide
from tidemark.plans.ingest import run_ingestion

T0 = datetime(2025, 1, 1, tzinfo=timezone.utc)


def at(hours):
    return T0 + timedelta(hours=hours)


@pytest.fixture
def job(spark, tmp_path):
    name = f"t_{uuid.uuid4().hex[:8]}"
    config = IngestionConfig("ing1", f"file:{tmp_path}/src", name, file_pattern="*.json", location=f"file:{tmp_path}/table")
    yield config, StateStore(spark, f"file:{tmp_path}/state", fold_after=None), tmp_path / "src"
    writer.drop_table(spark, name)


def put(folder, name, *records):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in records))


def test_nodes_fold_as_schemas_merge(spark):
    a = ST.from_variant_schema("OBJECT<a: BIGINT, n: OBJECT<x: BIGINT, y: STRING>, l: ARRAY<OBJECT<k: BIGINT>>, v: VOID>")
    b = ST.from_variant_schema("OBJECT<A: DECIMAL(3,1), n: OBJECT<z: BOOLEAN, x: STRING>, l: ARRAY<OBJECT<k: DECIMAL(2,1), m: STRING>>, w: BIGINT>")
    rows = [(f"f{i}", *n) for i, s in enumerate((a, b)) for n in N.nodes(s)]
    for shuffled in (rows, rows[::-1]):
        merged = N.merged_schema(spark.createDataFrame(shuffled, f"first string, {N.NODE}").repartition(3))
        assert merged.simpleString() == "struct<a:double,n:struct<x:string,y:string,z:boolean>,l:array<struct<k:double,m:string>>,v:string,w:bigint>"
    assert N.rebuilt([n[:3] for n in N.nodes(a)]) == a
    with pytest.raises(ValueError):
        N.parse_variant_schema("OBJECT<a BIGINT>")


def test_reshaped_rows_fill_and_cast(spark):
    rows = spark.sql("SELECT 1 AS id, named_struct('a', 1, 'B', 'x') AS s, array(named_struct('k', 1)) AS l, map('m', 2) AS m UNION ALL SELECT 2, NULL, NULL, NULL")
    target = T._parse_datatype_string("id double, s struct<b:string,c:int,a:bigint>, l array<struct<j:string,k:double>>, m map<string,double>, more date")
    got = {r.id: r for r in ST.reshaped_rows(rows, target).collect()}
    assert tuple(got[1].s) == ("x", None, 1) and tuple(got[1].l[0]) == (None, 1.0) and got[1].m == {"m": 2.0} and got[1].more is None
    assert got[2].s is None and got[2].l is None and got[2].m is None


def test_misfits_and_additions():
    table = T._parse_datatype_string("id bigint, s struct<a:bigint>, l array<struct<k:bigint>>")
    found = T._parse_datatype_string("ID double, s struct<a:string,b:int>, l array<struct<k:bigint,m:int>>, n int")
    assert ST.misfits(table, found) == ["ID: double does not fit bigint", "s.a: string does not fit bigint"]
    assert ST.misfits(table, found, widen=True) == ["s.a: string does not fit bigint"]
    assert ST.nested_additions(table, found) == ["s.b", "l[].m"]
    assert ST.extended(table, found, promote=True).simpleString() == "struct<id:double,s:struct<a:string,b:int>,l:array<struct<k:bigint,m:int>>,n:int>"


def test_wider_files_wait_and_are_loaded_once_approved(spark, job):
    config, store, src = job
    put(src, "a.json", {"id": 1, "v": 1})
    run_ingestion(spark, config, store, T0, "r1")
    put(src, "b.json", {"id": 2, "v": 2.5})
    put(src, "c.json", {"id": 3, "v": None})
    r = run_ingestion(spark, config, store, at(1), "r2")
    # A column without any value fits every type.
    assert (r.success, r.skipped) == (1, 1)
    assert decide(store, "ing1", "accept", at(2)) == 1
    assert run_ingestion(spark, config, store, at(3), "r3").success == 1
    assert len(writer.generations(spark, config.table)) == 2
    seen = {(r.id, r.v) for r in writer.committed(spark, config.table, store).collect()}
    assert seen == {(1, 1.0), (2, 2.5), (3, None)}
    assert writer.settle_generations(spark, config.table) == 2
    assert {(r.id, r.v) for r in writer.committed(spark, config.table, store).collect()} == seen
    assert spark.table(config.table).isEmpty()
    put(src, "d.json", {"id": 4, "v": "text"})
    assert run_ingestion(spark, config, store, at(4), "r4").skipped == 1
    decide(store, "ing1", "reject", at(5))
    assert run_ingestion(spark, config, store, at(6), "r5").success == 0


def test_a_broken_run_leaves_no_file_behind(spark, job, monkeypatch):
    """A run that breaks after its files were entered as loaded: readers don't see it, the next run loads them."""
    from tidemark.plans import ingest

    config, store, src = job
    put(src, "a.json", {"id": 1})
    with monkeypatch.context() as m:
        m.setattr(ingest._Run, "complete", lambda self: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            run_ingestion(spark, config, store, T0, "r1")
    assert writer.committed(spark, config.table, store).isEmpty()
    config.max_retries = None
    assert run_ingestion(spark, config, store, at(1), "r2").success == 1
    assert writer.committed(spark, config.table, store).count() == 1


def test_two_folds_at_once_and_a_replayed_run(spark, job):
    config, store, src = job
    for k in range(3):
        put(src, f"{k}.json", {"id": k})
        run_ingestion(spark, config, store, at(k), f"r{k}")
    before = sorted(map(tuple, store.state().collect()))
    other = StateStore(spark, store.root)
    number, old = other.pointer("ledger")
    assert store.fold()
    # The second has seen the pointer from before: its number is taken.
    other.pointer = lambda table: (number, old) if table == "ledger" else StateStore.pointer(other, table)
    other.delta_folders = lambda table, ingestion_id=None: [f"{store.folder(table)}/i=ing1/r=r0"] if table == "ledger" else []
    assert not other._fold("ledger")
    assert sorted(map(tuple, store.state().collect())) == before
    # A run that is written again after it was folded counts as new; merging it twice changes nothing.
    run_ingestion(spark, config, store, at(2), "r2")
    assert [f.rsplit("/", 1)[-1] for f in store.delta_folders("ledger")] == ["r=r2"]
    assert store.fold() and {(r[1], r[5]) for r in map(tuple, store.state().collect())} == {(r[1], r[5]) for r in before}
    assert writer.committed(spark, config.table, store).count() == 3
    one = store.state().first()
    assert store.file("ing1", one.file_path).collect() == [one]


def test_bucketed_merge_is_a_merge(spark, tmp_path):
    name = f"m_{uuid.uuid4().hex[:8]}"
    published = Buckets(spark, name, f"file:{tmp_path}/published", ["k"])
    want = {}
    for step, keys in enumerate(([None, *range(50)], [7], [None, 7, 8, 99], [3])):
        # The last step has a column more, the third another type.
        kind = "double" if step >= 2 else "bigint"
        rows = spark.createDataFrame([(k, step) for k in keys], "k bigint, v bigint").withColumn("v", F.col("v").cast(kind))
        if step == 3:
            rows = rows.withColumn("more", F.lit("x"))
        written = published.merge(rows)
        want |= {k: step for k in keys}
        assert {r.k: r.v for r in spark.table(name).collect()} == want
        assert step not in (1, 3) or len(written) == 1
    assert spark.table(name).filter("more = 'x'").count() == 1
    assert len([p for p in (tmp_path / "published" / "manifest").iterdir() if not p.name.startswith(".")]) == 2


def test_heads_of_files_are_whole_lines(spark, tmp_path):
    """Long files, compressed ones, a first line beyond the bound, no line end, nothing at all."""
    import gzip

    from tidemark.sources import manifest as M
    from tidemark.sources.readers import sample_lines

    lines = [json.dumps({"id": k, "t": "é" * 20}) for k in range(500)]
    (tmp_path / "a.json").write_text("\n".join(lines))
    (tmp_path / "b.json.gz").write_bytes(gzip.compress("\n".join(lines).encode()))
    (tmp_path / "c.json").write_text(json.dumps({"long": "x" * 5000}) + "\n" + lines[0] + "\n")
    (tmp_path / "d.json").write_text(lines[3])
    (tmp_path / "e.json").write_text("")
    found = sample_lines(M.list_files(spark, f"file:{tmp_path}"), head_bytes=1000)
    got = {r[0].rsplit("/", 1)[-1]: r[1] for r in found.groupBy("_source_file").agg(F.collect_list("value")).collect()}
    assert set(got) == {"a.json", "b.json.gz", "c.json", "d.json"}
    for name in ("a.json", "b.json.gz"):
        assert 1 < len(got[name]) < 20 and got[name] == lines[: len(got[name])]
    assert len(json.loads(got["c.json"][0])["long"]) == 5000 and got["d.json"] == [lines[3]]
