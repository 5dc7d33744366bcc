"""Unit tests: decisions, goldens of the impact estimates, and properties of the planner."""

from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F, types as T

from tidemark.functions import schema_types as ST
from tidemark.functions.expressions import glob_to_regex, next_retry_at, parse_timestamps, round_half_even
from tidemark.model import IngestionConfig
from tidemark.operators import analytics as A, impact as R, ledger as L, planning as B, preview as P, records, upsert, writer
from tidemark.operators.schema_infer import column_types, csv_headers, inconsistent_columns, json_file_schemas
from tidemark.sources import manifest as M, paths, readers

MB = 1024**2
T0 = datetime(2025, 1, 1)


def manifest_of(spark, n, mb, ingestion="ing1"):
    rows = [(ingestion, f"s3a://test-bucket/data/file_{i:04d}.json", mb * MB, T0 + timedelta(hours=i), f"etag-{i}") for i in range(n)]
    return spark.createDataFrame(rows, "ingestion_id string, path string, size_bytes bigint, modified_at timestamp_ntz, etag string")


def ledger_of(spark, rows):
    """(path, status, etag, modified, retries) rows of one ingestion."""
    return spark.createDataFrame(
        [("ing1", p, s, e, m, r) for p, s, e, m, r in rows],
        "ingestion_id string, file_path string, status string, file_etag string, file_modified_at timestamp_ntz, retry_count int",
    )


def done(spark, n):
    return ledger_of(spark, [(f"s3a://test-bucket/data/file_{i:04d}.json", "SUCCESS", f"etag-{i}", T0, 0) for i in range(n)])


def one(spark):
    return spark.createDataFrame([("ing1",)], "ingestion_id string")


def test_full_impact_goldens(spark):
    r = R.full_impact(manifest_of(spark, 50, 100), one(spark)).first()
    assert (r.files_to_process, r.files_skipped) == (50, 0)
    assert r.estimated_data_size_gb == 4.88 and r.estimated_cost_usd == 1.22 and r.estimated_duration_minutes == 100
    r = R.full_impact(manifest_of(spark, 10, 500), one(spark)).first()
    assert (r.files_to_process, r.estimated_data_size_gb, r.estimated_cost_usd) == (10, 4.88, 1.22)
    r = R.full_impact(manifest_of(spark, 1, 1), one(spark)).first()
    assert r.estimated_duration_minutes == 5
    r = R.full_impact(manifest_of(spark, 0, 1), one(spark)).first()
    assert (r.files_to_process, r.estimated_data_size_gb, r.estimated_duration_minutes, r.oldest_file_date) == (0, 0.0, 0, None)


def test_incremental_impact_goldens(spark):
    r = R.incremental_impact(manifest_of(spark, 50, 100), done(spark, 40), one(spark)).first()
    assert (r.files_to_process, r.files_skipped, r.files_skipped_present) == (10, 40, 40)
    assert r.estimated_data_size_gb == 0.98 and r.estimated_cost_usd == 0.24
    r = R.incremental_impact(manifest_of(spark, 30, 10), done(spark, 30), one(spark)).first()
    assert (r.files_to_process, r.files_skipped, r.estimated_data_size_gb, r.estimated_cost_usd) == (0, 30, 0.0, 0.0)
    gone = R.incremental_impact(manifest_of(spark, 30, 10), done(spark, 35), one(spark)).first()
    assert (gone.files_skipped, gone.files_skipped_present) == (35, 30)


def test_fallback_and_warnings(spark):
    none = done(spark, 0)
    assert R.fallback_impact(none, one(spark), "full").first().files_to_process == 100
    assert R.fallback_impact(done(spark, 100), one(spark), "full").first().files_to_process == 100
    r = R.fallback_impact(done(spark, 100), one(spark), "new_only").first()
    assert (r.files_to_process, r.files_skipped) == (10, 100)
    row = spark.createDataFrame([("ing1", 1000, 600.0, 150.0)], "ingestion_id string, files_to_process bigint, estimated_data_size_gb double, estimated_cost_usd double")
    assert R.with_warnings(row, "full").first().warnings == ["This operation will reprocess 1000 files (600.0 GB)", "Estimated cost: $150.00"]
    assert R.with_warnings(row, "new_only").first().warnings == ["Estimated cost: $150.00"]
    assert len(R.with_warnings(row, "full", strict=True).first().warnings) == 3


def test_change_detection_prefers_etags(spark):
    later, m = T0 + timedelta(days=9), manifest_of(spark, 6, 1)
    p = [r.path for r in m.orderBy("path").collect()]
    state = ledger_of(spark, [
        (p[0], "SUCCESS", "etag-0", None, 0), (p[1], "SUCCESS", "other", later, 0), (p[2], "SUCCESS", None, T0, 2),
        (p[3], "SUCCESS", "", later, 0), (p[4], "PROCESSING", None, None, 0),
    ])
    got = {r.file_path: (r.action, r.next_retry_count) for r in B.classify(m, state).collect()}
    assert [got[x] for x in p] == [("UNCHANGED", 0), ("CHANGED", 1), ("CHANGED", 3), ("UNCHANGED", 0), ("IN_PROGRESS", 0), ("NEW", 0)]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.sampled_from(["", "SUCCESS", "FAILED", "PROCESSING", "SKIPPED", "PENDING"]), min_size=1, max_size=12))
def test_plan_and_rest_are_the_manifest(spark, statuses):
    m = manifest_of(spark, len(statuses), 1)
    p = [f"s3a://test-bucket/data/file_{i:04d}.json" for i in range(len(statuses))]
    state = ledger_of(spark, [(x, s, f"etag-{i}", T0, 0) for i, (x, s) in enumerate(zip(p, statuses)) if s])
    every = B.classify(m, state)
    planned = {r.file_path for r in B.plan(m, state).collect()}
    assert every.count() == len(statuses)
    assert planned == {x for x, s in zip(p, statuses) if s in ("", "FAILED", "PENDING")}


def test_current_state_keeps_latest_and_drops_cleared(spark):
    e = spark.createDataFrame(
        [("i", "a", "PROCESSING", 1, 0), ("i", "a", "SUCCESS", 1, 1), ("i", "b", "SUCCESS", 1, 1), ("i", "b", "CLEARED", 2, 2)],
        "ingestion_id string, file_path string, status string, event_time int, seq int",
    )
    assert [(r.file_path, r.status) for r in L.current_state(e).collect()] == [("a", "SUCCESS")]


def test_hot_file_is_cut_before_the_shuffle(spark):
    hot = spark.range(20_000).select(
        F.lit("i").alias("ingestion_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("file_path"),
        F.lit("SUCCESS").alias("status"), F.col("id").alias("event_time"), F.lit(0).alias("seq"))
    out = L.current_state(hot)
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    assert out.filter("file_path = 'hot'").first().event_time == 19_998


def test_schema_diff_and_verdict():
    old = T.StructType.fromJson({"type": "struct", "fields": [
        {"name": "a", "type": "long", "nullable": True, "metadata": {}}, {"name": "b", "type": "double", "nullable": True, "metadata": {}},
        {"name": "c", "type": "string", "nullable": True, "metadata": {}}]})
    new = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType()), T.StructField("d", T.LongType())])
    got = {(c.change_type, c.column_name): c.breaking for c in ST.diff(old, new)}
    assert got == {("TYPE_CHANGE", "a"): True, ("TYPE_CHANGE", "b"): False, ("REMOVED_COLUMN", "c"): True, ("NEW_COLUMN", "d"): False}
    assert ST.diff(old, new, strict=True)[1].breaking
    must = T.StructType([T.StructField("a", T.LongType(), False)])
    assert ST.diff(T.StructType(old.fields[:1]), must)[0].breaking


def test_schema_merge():
    a = T.StructType([T.StructField("x", T.IntegerType(), False), T.StructField("y", T.LongType(), False)])
    b = T.StructType([T.StructField("x", T.LongType(), False), T.StructField("z", T.StringType(), False)])
    m = ST.merge(a, b)
    assert [(f.name, f.dataType.simpleString(), f.nullable) for f in m.fields] == [("x", "string", True), ("y", "bigint", False), ("z", "string", True)]
    assert ST.merge(a, b, "widen")["x"].dataType == T.LongType()
    assert [f.name for f in ST.new_columns(T.StructType([T.StructField("ID", T.LongType())]), T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType())]))] == ["n"]


def test_variant_schema_text(spark):
    s = ST.from_variant_schema("OBJECT<`a b`: DECIMAL(21,1), c: ARRAY<OBJECT<d: VOID>>, e: VARIANT, `OBJECT<x: VOID>`: BIGINT>")
    assert s.simpleString() == "struct<a b:double,c:array<struct<d:string>>,e:string,OBJECT<x: VOID>:bigint>"
    assert ST.from_variant_schema("BIGINT") is None


def test_per_file_schemas_and_inconsistency(spark):
    lines = spark.createDataFrame([("f1", '{"a": 1, "b": "x"}'), ("f1", "{bad"), ("f2", '{"a": "one"}'), ("f2", "  "), ("f3", "[1]")], "_source_file string, value string")
    got = {r[0]: (r.variant_schema, r.record_count, r.malformed_count) for r in json_file_schemas(lines).collect()}
    assert got["f1"] == ("OBJECT<a: BIGINT, b: STRING>", 2, 1) and got["f2"][1:] == (1, 0)
    bad = inconsistent_columns(column_types(lines)).filter("inconsistent").collect()
    assert {(r.column_name, r.data_type, r.types) for r in bad} == {("a", "BIGINT", "BIGINT,STRING"), ("a", "STRING", "BIGINT,STRING")}


def test_csv_headers_of_split_files(spark, tmp_path):
    (tmp_path / "big.csv").write_text("id,name\n" + "".join(f"{i},x\n" for i in range(20000)))
    (tmp_path / "other.csv").write_text("name,id\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = {r[0].rsplit("/", 1)[1]: r.header for r in csv_headers(spark, [f"file:{tmp_path}/big.csv", f"file:{tmp_path}/other.csv"]).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {"big.csv": "id,name", "other.csv": "name,id"}


@pytest.mark.parametrize("pattern,path,hit", [
    ("*.json", "s3a://b/x/y.json", True), ("*.json", "s3a://b/x/y.csv", False), ("data-2024-*.parquet", "s3a://b/data-2024-01.parquet", True),
    ("data-*.json", "s3a://b/data-/x.json", False), ("year=202[3-4]/**/*.parquet", "s3a://b/year=2023/month=1/a.parquet", True),
    ("year=202[!3]/*.parquet", "s3a://b/year=2023/a.parquet", False), ("{a,b}?.json", "s3a://x/a1.json", True)])
def test_globs(spark, pattern, path, hit):
    df = spark.createDataFrame([(path,)], "path string")
    assert (M.match_glob(df, pattern).count() == 1) == hit
    assert glob_to_regex(pattern)


def test_suffix_match_is_literal(spark):
    df = spark.createDataFrame([("b/data-1.json",), ("b/x/data-.json",)], "path string")
    assert M.match_suffix(df, "data-*.json").first()[0] == "b/x/data-.json"


def test_uris(spark):
    df = spark.createDataFrame([("s3://bucket/a/b",), ("s3a://bucket",)], "u string")
    assert [r[0] for r in df.select(paths.split_uri(F.col("u"))["uri"]).collect()] == ["s3a://bucket/a/b", "s3a://bucket/"]
    with pytest.raises(Exception, match="Invalid path format"):
        spark.createDataFrame([("ftp://x/y",)], "u string").select(paths.split_uri(F.col("u"))["uri"]).collect()


def test_listing_keeps_empty_files_and_filters(spark, tmp_path):
    (tmp_path / "sub" / "deep").mkdir(parents=True)
    for name, text in (("a.json", "x"), ("sub/b.json", ""), ("sub/deep/c.csv", "yy"), ("_SUCCESS", ""), (".hidden.json", "z")):
        (tmp_path / name).write_text(text)
    found = M.discover(spark, f"file:{tmp_path}")
    assert sorted((r.path.rsplit("/", 1)[1], r.size_bytes) for r in found.collect()) == [("a.json", 1), ("b.json", 0), ("c.csv", 2)]
    assert M.list_binary(spark, f"file:{tmp_path}").count() == 2
    assert M.discover(spark, f"file:{tmp_path}", pattern="*.json", max_files=1).first().path.endswith("a.json")
    assert M.discover(spark, f"file:{tmp_path}", since="2999-01-01 00:00:00").isEmpty()
    assert M.discover(spark, f"file:{tmp_path}/nothing").isEmpty()


def test_notifications_take_all_records(spark):
    rec = '{"eventTime":"2024-01-15T10:30:00Z","s3":{"bucket":{"name":"b"},"object":{"key":"%s","size":7,"eTag":"\\"e\\""}}}'
    msgs = spark.createDataFrame([('{"Records":[%s,%s]}' % (rec % "x", rec % "y"),), ("nonsense",), ('{"Records":[]}',)], "body string")
    found, bad = M.from_notifications(msgs)
    assert {(r.path, r.size_bytes, r.etag) for r in found.collect()} == {("s3a://b/x", 7, "e"), ("s3a://b/y", 7, "e")}
    assert bad.count() == 2


def test_rescue_keeps_what_does_not_fit(spark):
    lines = spark.createDataFrame([('{"id": 1, "x": [1]}',), ('{"id": "no"}',), ("oops",), ('{"id": null}',)], "value string")
    out = records.rescue(lines, T.StructType([T.StructField("id", T.LongType())]))
    assert [tuple(r) for r in out.collect()] == [(1, '{"x":[1]}'), (None, '{"id":"no"}'), (None, "oops"), (None, None)]


def test_merge_with_hot_key(spark):
    target = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id int, v string, t int")
    source = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id").cast("int") + 10).alias("id"), F.col("id").cast("string").alias("v"), F.col("id").cast("int").alias("t"))
    out = upsert.merge_rows(target, source, ["id"], ["t"])
    assert out.count() == 2 + 2000 and out.filter("id = 1").first().v == "2997"
    p = upsert.merge_preview(target, source, ["id"], ["t"]).first()
    assert (p.existing_rows, p.new_rows, p.updated_rows) == (2, 2000, 1)


def test_clustering_narrows_file_ranges(spark, tmp_path):
    df = spark.range(40_000).select((F.col("id") * 7919 % 1000).alias("a"), (F.col("id") * 104729 % 997).alias("b"), F.lit("same").alias("c"))
    out = writer.cluster(df, ("a", "b"), 16)
    spans = out.groupBy(F.spark_partition_id()).agg((F.max("a") - F.min("a")).alias("a"), (F.max("b") - F.min("b")).alias("b"))
    wide = spans.agg(F.avg("a"), F.avg("b")).first()
    assert wide[0] < 600 and wide[1] < 600 and out.count() == 40_000
    hot = writer.cluster(df, ("c",), 8).groupBy(F.spark_partition_id()).count()
    assert hot.agg(F.max("count")).first()[0] < 20_000


def test_small_expressions(spark):
    r = spark.range(1).select(
        round_half_even(F.lit(0.125), 2), parse_timestamps(F.lit("11/02/24"), ["yyyy-MM-dd", "MM/dd/yy"]).cast("date").cast("string"),
        next_retry_at(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.lit(1)).cast("string"), next_retry_at(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.lit(3)),
    ).first()
    assert tuple(r) == (0.12, "2024-11-02", "2024-01-01 00:05:00", None)


def test_config_is_checked():
    for bad in ({"format": "doc"}, {"write_mode": "upsert"}, {"write_mode": "merge"}, {"on_bad_records": "x"}, {"plan_mode": "x"}):
        with pytest.raises(ValueError):
            IngestionConfig("i", "p", "t", **bad)
    assert readers.reader_options({"delimiter": ";", "header": None, "multiline": "true"}) == {"sep": ";", "multiLine": "true"}


def test_avro_without_its_package(spark, tmp_path):
    with pytest.raises(RuntimeError, match="spark-avro"):
        readers.scan(spark, "avro", f"file:{tmp_path}")


def test_null_profile_of_no_rows(spark):
    assert P.null_profile(spark.createDataFrame([], "a int")).first().null_pct is None


def test_rollup_weeks_start_on_monday(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 7, 23),), (datetime(2024, 1, 8, 0),)], "processed_at timestamp_ntz").select(
        "processed_at", F.lit("i").alias("ingestion_id"), F.lit("SUCCESS").alias("status"), F.lit(1).alias("records_ingested"), F.lit(1).alias("bytes_read"))
    got = sorted(str(r.window_start) for r in A.rollup(df, "week").collect())
    assert got == ["2024-01-01 00:00:00", "2024-01-08 00:00:00"]


def test_listed_paths_keep_account_and_host():
    from tidemark.sources.listing import spelling

    def back(uri, found):
        _, prefix, cut = spelling(uri)
        return prefix + found.removeprefix(cut)

    assert back("s3a://b/x", "b/x/f") == back("s3://b/x", "b/x/f") == "s3a://b/x/f" and back("gs://b/x", "b/x/f") == "gs://b/x/f"
    assert back("abfss://c@acc.dfs.core.windows.net/x", "c/x/f") == "abfss://c@acc.dfs.core.windows.net/x/f"
    assert back("wasbs://c@acc.blob.core.windows.net/x", "c/x/f") == "wasbs://c@acc.blob.core.windows.net/x/f"
    assert spelling("wasbs://c@acc.blob.core.windows.net/x")[0] == "abfss://c@acc.dfs.core.windows.net/x"
    assert back("hdfs://nn:8020/x", "/x/f") == "hdfs://nn:8020/x/f"
