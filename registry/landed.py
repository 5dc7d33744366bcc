"""Queries over landed files: the given tables written out as files, ingested, streamed and profiled."""

from datetime import datetime, timezone

from pyspark.sql import functions as F, types as T

from registry.core import query
from tidemark.functions.expressions import parse_timestamps
from tidemark.model import SOURCE_FILE, IngestionConfig
from tidemark.operators import preview as P, records, schema_history as H, schema_infer as S, transforms as X
from tidemark.operators import upsert, writer
from tidemark.operators.state_store import StateStore
from tidemark.plans.ingest import run_ingestion
from tidemark.plans.refresh import refresh, steps_frame
from tidemark.sources import manifest as M, readers
from tidemark.streaming import ingest as stream, rollup as stream_rollup

T1, T2, T3 = (datetime(2024, 2, d, tzinfo=timezone.utc) for d in (1, 2, 3))
BASE = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.StringType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
])
EVOLVED = T.StructType([*BASE.fields, T.StructField("region", T.StringType()),
                        T.StructField("meta", T.StructType([T.StructField("k", T.LongType())]))])


def folder_day():
    return F.to_date(F.regexp_replace(F.regexp_extract("file_path", r"year=(\d+/month=\d+/day=\d+)/", 1), "/?(month|day)=", "-"))


def landing_folder():
    return F.regexp_extract("file_path", r"/(days_a|days_b|empty|cut|html|z_conflict)/", 1)


# --- what lands -----------------------------------------------------------------------------------

def event_rows(c):
    """Events as landed records; from day 21 on they have two more columns."""
    later = F.dayofmonth("ts") > 20
    return c.table("events").select(
        "event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), "user_id", "event_type", "value",
        F.when(later, F.concat(F.lit("region-"), "event_type")).alias("region"),
        F.when(later, F.from_json("props", "k bigint")).alias("meta"),
        F.date_format("ts", "yyyy").alias("year"), F.date_format("ts", "MM").alias("month"), F.date_format("ts", "dd").alias("day"),
    )


def land_days(c, folder: str, first_part: bool) -> None:
    part = (F.col("day") <= "20") if first_part else (F.col("day") > "20")
    event_rows(c).filter(part).write.partitionBy("year", "month", "day").json(folder)


def landed(c) -> str:
    def make():
        root = c.scratch("landed")
        land_days(c, f"{root}/days_a", True)
        land_days(c, f"{root}/days_b", False)
        return root

    return c.once("landed", make)


def land_bad_files(c, root: str) -> None:
    """An empty file, cut-off records, web pages instead of records, and a column of another type."""
    record = F.to_json(F.struct("event_id", "ts", "value"))
    c.table("pages").limit(0).select("html").coalesce(1).write.text(f"{root}/empty")
    event_rows(c).select(F.left(record, F.length(record) - 3).alias("r")).write.text(f"{root}/cut")
    c.table("pages").select("html").write.text(f"{root}/html")
    c.table("customer").select(F.col("c_custkey").alias("event_id"), F.col("c_mktsegment").alias("value")).write.json(f"{root}/z_conflict")


def ingested(c):
    """Two runs: days 1-20, then the later days together with all the bad files."""

    def make():
        root, state = c.scratch("source"), StateStore(c.spark, c.scratch("state"))
        table = "events_" + root[-12:]
        config = IngestionConfig("events", root, table, location=c.scratch("table"), match="suffix")
        land_days(c, f"{root}/days_a", True)
        run_ingestion(c.spark, config, state, T1, "run_1")
        land_days(c, f"{root}/days_b", False)
        land_bad_files(c, root)
        run_ingestion(c.spark, config, state, T2, "run_2")
        return config, state

    return c.once("ingested", make)


def _lines(c, folder: str):
    text = c.spark.read.option("recursiveFileLookup", True).text(f"{landed(c)}/{folder}")
    return text.select("value", F.col("_metadata.file_path").alias(SOURCE_FILE))


EVENT_COUNTS = "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS bigint) AS ids FROM events GROUP BY 1"


def event_counts(df):
    return df.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").cast("bigint").alias("ids"))


# --- sources --------------------------------------------------------------------------------------

@query("a1_manifest_scan", "SELECT DISTINCT CAST(ts AS date) AS day, true AS has_bytes FROM events")
def _(c):
    found = M.list_files(c.spark, landed(c)).withColumnRenamed("path", "file_path")
    return found.groupBy(folder_day().alias("day")).agg((F.sum("size_bytes") > 0).alias("has_bytes"))


@query("a1_binary_listing_agrees", "SELECT DISTINCT CAST(ts AS date) AS day, true AS same FROM events")
def _(c):
    def sizes(m, name):
        return m.withColumnRenamed("path", "file_path").groupBy(folder_day().alias("day")).agg(F.sum("size_bytes").alias(name))

    mine = sizes(M.list_files(c.spark, landed(c)), "a")
    other = sizes(M.list_binary(c.spark, landed(c), glob="*.json"), "b")
    return mine.join(other, "day", "full_outer").select("day", F.col("a").eqNullSafe(F.col("b")).alias("same"))


@query("a19_file_count", "SELECT count(DISTINCT CAST(ts AS date)) AS day_folders FROM events")
def _(c):
    found = M.list_files(c.spark, landed(c)).withColumnRenamed("path", "file_path")
    return found.select(folder_day().alias("day")).agg(F.count_distinct("day").alias("day_folders"))


@query("a12_format_scan", """
SELECT f AS format, count(*) AS n, CAST(sum(event_id) AS bigint) AS ids, round(sum(value), 2) AS total FROM events,
  (SELECT unnest(['json', 'csv', 'parquet', 'orc', 'xml']) AS f) x GROUP BY 1""")
def _(c):
    rows = c.table("events").select("event_id", "user_id", "event_type", "value")
    root = c.scratch("formats")
    parts = []
    for fmt in ("json", "csv", "parquet", "orc", "xml"):
        options = {"csv": {"header": True}, "xml": {"rowTag": "event"}}.get(fmt, {})
        rows.write.format(fmt).options(**options).save(f"{root}/{fmt}")
        schema = rows.schema if fmt in ("csv", "xml") else None
        parts.append(readers.scan(c.spark, fmt, f"{root}/{fmt}", schema, options).select(F.lit(fmt).alias("format"), "event_id", "value"))
    return readers.union_scans(*parts).groupBy("format").agg(
        F.count("*").alias("n"), F.sum("event_id").cast("bigint").alias("ids"), F.round(F.sum("value"), 2).alias("total")
    )


@query("a13_format_options", "SELECT event_type, count(*) AS n, CAST(sum(length(props)) AS bigint) AS chars FROM events GROUP BY 1")
def _(c):
    options = {"delimiter": "|", "header": "true", "quote": "'", "compression": "gzip", "multiline": None}
    path = c.scratch("options")
    rows = c.table("events").select("event_id", "event_type", "props")
    rows.write.format("csv").options(**readers.reader_options(options)).save(path)
    back = readers.scan(c.spark, "csv", path, rows.schema, options)
    return back.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.length("props")).cast("bigint").alias("chars"))


@query("a14_explicit_schema", EVENT_COUNTS)
def _(c):
    df = readers.scan(c.spark, "json", landed(c), BASE.json(), {"recursiveFileLookup": "true"})
    return event_counts(df)


@query("a15_inferred_schema", """
SELECT * FROM (VALUES ('event_id', 'bigint'), ('event_type', 'string'), ('meta', 'struct<k:bigint>'), ('region', 'string'),
  ('ts', 'string'), ('user_id', 'bigint'), ('value', 'double')) v(column_name, data_type)
WHERE EXISTS (SELECT 1 FROM events)""")
def _(c):
    df = readers.scan(c.spark, "json", landed(c), options={"recursiveFileLookup": "true"})
    return H.schema_rows(c.spark, df.schema).select("column_name", "data_type")


@query("a17_provenance", "SELECT CAST(ts AS date) AS day, count(*) AS n FROM events GROUP BY 1")
def _(c):
    df = readers.scan(c.spark, "json", landed(c), BASE, {"recursiveFileLookup": "true"})
    return readers.with_source_file(df).withColumnRenamed(SOURCE_FILE, "file_path").groupBy(folder_day().alias("day")).agg(F.count("*").alias("n"))


@query("a18_batched_read", """
SELECT event_type, count(*) AS n, count(*) FILTER (WHERE day(ts) > 20) AS with_region FROM events GROUP BY 1""")
def _(c):
    opt = {"recursiveFileLookup": "true"}
    a = readers.scan(c.spark, "json", f"{landed(c)}/days_a", BASE, opt)
    b = readers.scan(c.spark, "json", f"{landed(c)}/days_b", EVOLVED, opt)
    return readers.union_scans(a, b).groupBy("event_type").agg(F.count("*").alias("n"), F.count("region").alias("with_region"))


# --- ingestion ------------------------------------------------------------------------------------

@query("i1_ingest_run", """
SELECT CASE WHEN day(ts) <= 20 THEN 'run_1' ELSE 'run_2' END AS run_id, CAST(ts AS date) AS day, 'SUCCESS' AS status,
  count(*) AS records FROM events GROUP BY 1, 2""")
def _(c):
    _, store = ingested(c)
    done = store.state("events").filter(landing_folder().startswith("days"))
    return done.groupBy("run_id", folder_day().alias("day"), "status").agg(F.sum("records_ingested").alias("records"))


@query("i2_append", EVENT_COUNTS)
def _(c):
    config, store = ingested(c)
    return event_counts(writer.committed(c.spark, config.table, store))


@query("i3_partitioned_create", "SELECT o_orderstatus, count(*) AS n, CAST(sum(o_custkey) AS bigint) AS keys FROM orders GROUP BY 1")
def _(c):
    def make():
        table = "orders_" + c.scratch("t")[-12:]
        spread = c.table("orders").hint("rebalance", "o_orderstatus")
        spread.write.partitionBy("o_orderstatus").option("path", c.scratch("orders")).saveAsTable(table)
        return table

    t = c.spark.table(c.once("orders_by_status", make))
    return t.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_custkey").cast("bigint").alias("keys"))


@query("i4_table_exists", """
SELECT CAST(ts AS date) AS day, true AS known, false AS unknown FROM events GROUP BY 1""")
def _(c):
    config, store = ingested(c)
    known, unknown = (writer.table_exists(c.spark, t) for t in (config.table, config.table + "_none"))
    rows = writer.committed(c.spark, config.table, store)
    return rows.select(F.to_date("ts").alias("day")).distinct().select("day", F.lit(known).alias("known"), F.lit(unknown).alias("unknown"))


OUTCOME = """
SELECT 'days_a' AS folder, 'SUCCESS' AS status, count(*) AS records, NULL AS error_type FROM events WHERE day(ts) <= 20
UNION ALL SELECT 'days_b', 'SUCCESS', count(*), NULL FROM events WHERE day(ts) > 20
UNION ALL SELECT 'empty', 'SUCCESS', 0, NULL
UNION ALL SELECT 'cut', 'FAILED', NULL, 'MalformedRecordError' UNION ALL SELECT 'html', 'FAILED', NULL, 'MalformedRecordError'
UNION ALL SELECT 'z_conflict', 'SKIPPED', NULL, 'SchemaEvolutionError'"""


@query("i5_file_outcomes", f"SELECT folder, status, CAST(records AS bigint) AS records FROM ({OUTCOME}) t")
def _(c):
    _, store = ingested(c)
    return store.state("events").groupBy(landing_folder().alias("folder"), "status").agg(F.sum("records_ingested").alias("records"))


@query("i6_error_isolation", f"SELECT folder, error_type FROM ({OUTCOME}) t WHERE status <> 'SUCCESS'")
def _(c):
    _, store = ingested(c)
    return store.state("events").filter("status <> 'SUCCESS'").groupBy(landing_folder().alias("folder")).agg(F.max("error_type").alias("error_type"))


@query("i8_ledger_transitions", f"""
SELECT folder, s AS seq, CASE s WHEN 0 THEN 'PROCESSING' ELSE status END AS status FROM ({OUTCOME}) t, (SELECT unnest([0, 1]) AS s) x""")
def _(c):
    _, store = ingested(c)
    return store.events("events").select(landing_folder().alias("folder"), "seq", "status").distinct()


@query("i9_run_rows", """
SELECT 'run_1' AS run_id, 'success' AS status, count(*) FILTER (WHERE day(ts) <= 20) AS records_ingested FROM events
UNION ALL SELECT 'run_2', 'partial', count(*) FILTER (WHERE day(ts) > 20) FROM events""")
def _(c):
    _, store = ingested(c)
    return store.runs().select("run_id", "status", "records_ingested")


@query("i15_overwrite_partitions", """
SELECT o_orderstatus, count(*) AS n, round(sum(CASE o_orderstatus WHEN 'F' THEN o_totalprice * 2 ELSE o_totalprice END), 0) AS total
FROM orders GROUP BY 1""")
def _(c):
    def make():
        table = "overwrite_" + c.scratch("t")[-12:]
        rows = c.table("orders").drop("o_orderdate")
        rows.write.partitionBy("o_orderstatus").option("path", c.scratch("overwrite")).saveAsTable(table)
        again = c.spark.table(table).filter("o_orderstatus = 'F'").withColumn("o_totalprice", F.col("o_totalprice") * 2)
        writer.overwrite_partitions(again, table)
        return table

    t = c.spark.table(c.once("overwrite", make))
    return t.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 0).alias("total"))


def _merge_inputs(c):
    target = c.table("orders").select("o_orderkey", "o_orderstatus", F.col("o_custkey").alias("o_ref"), "o_orderdate")
    source = c.table("lineitem").select(
        (F.col("l_orderkey") + F.col("l_linenumber") - 1).alias("o_orderkey"), F.col("l_linestatus").alias("o_orderstatus"),
        F.col("l_partkey").alias("o_ref"), F.col("l_shipdate").alias("o_orderdate"),
    )
    return target, source, ["o_orderkey"], ["o_orderdate"]


MERGE = """
WITH src AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey
    ORDER BY o_orderdate DESC, o_orderstatus DESC, o_ref DESC) AS rn FROM (
    SELECT l_orderkey + l_linenumber - 1 AS o_orderkey, l_linestatus AS o_orderstatus, l_partkey AS o_ref,
           l_shipdate AS o_orderdate FROM lineitem) a) b WHERE rn = 1),
tgt AS (SELECT o_orderkey, o_orderstatus, o_custkey AS o_ref, o_orderdate FROM orders) """


@query("i16_upsert", MERGE + "SELECT * FROM src UNION ALL SELECT * FROM tgt WHERE o_orderkey NOT IN (SELECT o_orderkey FROM src)")
def _(c):
    return upsert.merge_rows(*_merge_inputs(c))


@query("i17_merge_preview", MERGE + """
SELECT count(t.o_orderkey) AS existing_rows, count(*) FILTER (WHERE t.o_orderkey IS NULL) AS new_rows,
  count(*) FILTER (WHERE t.o_orderkey = s.o_orderkey AND NOT (t.o_orderstatus = s.o_orderstatus AND t.o_ref = s.o_ref AND t.o_orderdate = s.o_orderdate)) AS updated_rows,
  count(*) FILTER (WHERE t.o_orderkey = s.o_orderkey AND t.o_orderstatus = s.o_orderstatus AND t.o_ref = s.o_ref AND t.o_orderdate = s.o_orderdate) AS identical_rows
FROM tgt t FULL OUTER JOIN src s ON t.o_orderkey = s.o_orderkey""")
def _(c):
    return upsert.merge_preview(*_merge_inputs(c))


@query("i17_merge_changes", MERGE + """
SELECT t.o_orderkey, 'o_orderstatus' AS column_name, t.o_orderstatus AS old_value, s.o_orderstatus AS new_value
FROM tgt t JOIN src s ON t.o_orderkey = s.o_orderkey WHERE t.o_orderstatus <> s.o_orderstatus
UNION ALL SELECT t.o_orderkey, 'o_ref', CAST(t.o_ref AS varchar), CAST(s.o_ref AS varchar)
FROM tgt t JOIN src s ON t.o_orderkey = s.o_orderkey WHERE t.o_ref <> s.o_ref""")
def _(c):
    target, source, keys, order = _merge_inputs(c)
    return upsert.merge_changes(target.drop("o_orderdate"), source, keys, order)


@query("i18_replayed_run", EVENT_COUNTS)
def _(c):
    def make():
        config, store = ingested(c)
        run_ingestion(c.spark, config, store, T2, "run_2")
        return True

    config, store = ingested(c)
    c.once("replayed", make)
    return event_counts(writer.committed(c.spark, config.table, store))


def _mixed_lines(c):
    events = event_rows(c).select(F.lit("events").alias("origin"), F.to_json(F.struct("event_id", "event_type", "value")).alias("value"))
    odd = c.table("customer").select(F.lit("customer").alias("origin"), F.to_json(F.struct(F.col("c_custkey").alias("event_id"), F.col("c_name").alias("value"))).alias("value"))
    pages = c.table("documents").select(F.lit("documents").alias("origin"), F.col("text").alias("value"))
    return readers.union_scans(events, odd, pages)


@query("i19_corrupt_split", """
SELECT 'events' AS origin, count(*) AS valid_records, 0 AS invalid_records FROM events
UNION ALL SELECT 'customer', 0, count(*) FROM customer UNION ALL SELECT 'documents', 0, count(*) FROM documents WHERE trim(text) <> ''""")
def _(c):
    parsed = records.parse(_mixed_lines(c), T.StructType([f for f in BASE.fields if f.name in ("event_id", "event_type", "value")]))
    return records.corrupt_counts(parsed, "origin")


@query("i20_rescued_data", """
SELECT c_custkey AS id, NULL::bigint AS name, concat('{"c_mktsegment":"', c_mktsegment, '","name":"', c_name, '"}') AS _rescued_data FROM customer
UNION ALL SELECT s_suppkey, s_nationkey, NULL FROM supplier""")
def _(c):
    a = c.table("customer").select(F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), "c_mktsegment")).alias("value"))
    b = c.table("supplier").select(F.to_json(F.struct(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("name"))).alias("value"))
    return records.rescue(a.unionByName(b), T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.LongType())]))


@query("i21_clustered", "SELECT l_returnflag, count(*) AS n, CAST(sum(l_partkey) AS bigint) AS keys FROM lineitem GROUP BY 1")
def _(c):
    def make():
        path = c.scratch("clustered")
        writer.cluster(c.table("lineitem"), ("l_partkey", "l_shipdate", "l_returnflag")).write.parquet(path)
        return path

    t = c.spark.read.parquet(c.once("clustered", make))
    return t.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_partkey").cast("bigint").alias("keys"))


@query("i22_drop_table", "SELECT count(*) AS row_count, true AS first_existed, false AS second_existed, false AS exists_after FROM orders")
def _(c):
    table = "dropped_" + c.scratch("t")[-12:]
    c.table("orders").write.option("path", c.scratch("dropped")).saveAsTable(table)
    counted = c.spark.table(table).agg(F.count("*").alias("row_count")).first()[0]
    first, second = writer.drop_table(c.spark, table)["existed"], writer.drop_table(c.spark, table)["existed"]
    return c.spark.createDataFrame(
        [(counted, first, second, writer.table_exists(c.spark, table))],
        "row_count bigint, first_existed boolean, second_existed boolean, exists_after boolean",
    )


def _refreshed(c, mode: str):
    def make():
        root, store = c.scratch("source"), StateStore(c.spark, c.scratch("state"))
        config = IngestionConfig("events", root, f"{mode}_{root[-12:]}", location=c.scratch("table"))
        land_days(c, f"{root}/days_a", True)
        run_ingestion(c.spark, config, store, T1, "run_1")
        land_days(c, f"{root}/days_b", False)
        return config, store, refresh(c.spark, config, store, mode, T3, "run_2")

    return c.once(f"refreshed_{mode}", make)


@query("r2_full_refresh", EVENT_COUNTS)
def _(c):
    config, store, _ = _refreshed(c, "full")
    return event_counts(writer.committed(c.spark, config.table, store))


@query("r2_full_refresh_steps", """
SELECT * FROM (VALUES (1, 'table_dropped', 'success'), (2, 'processed_files_cleared', 'success'), (3, 'run_triggered', 'success'))
  v(step_no, operation, status) WHERE EXISTS (SELECT 1 FROM events)""")
def _(c):
    return steps_frame(c.spark, _refreshed(c, "full")[2]).select("step_no", "operation", "status")


@query("r3_new_only_refresh", EVENT_COUNTS.replace("GROUP BY", "WHERE day(ts) > 20 GROUP BY"))
def _(c):
    config, store, _ = _refreshed(c, "new_only")
    return event_counts(writer.committed(c.spark, config.table, store))


# --- streams --------------------------------------------------------------------------------------

def _streamed(c):
    def make():
        store = StateStore(c.spark, c.scratch("state"))
        path = c.scratch("table")
        config = IngestionConfig("events", landed(c), f"stream_{path[-12:]}", schema=EVOLVED, location=path)
        q = stream.ingest_stream(c.spark, config, store, c.scratch("stream"), T1, max_files_per_trigger=12)
        q.awaitTermination()
        return config, store, stream.progress_metrics(q.recentProgress)

    return c.once("streamed", make)


@query("a16_file_stream", "SELECT CAST(ts AS date) AS day, count(*) AS n FROM events GROUP BY 1")
def _(c):
    config, store, _ = _streamed(c)
    rows = writer.committed(c.spark, config.table, store)
    return rows.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


@query("i11_stream_to_table", EVENT_COUNTS)
def _(c):
    def make():
        table = "sink_" + c.scratch("t")[-12:]
        rows = stream.read_files(c.spark, landed(c), "json", EVOLVED, max_files_per_trigger=20)
        q = stream.write_table(rows, table, c.scratch("stream"), partition_columns=("event_type",))
        q.awaitTermination()
        return table

    return event_counts(c.spark.table(c.once("sink", make)))


@query("i13_stream_metrics", "SELECT count(*) AS records_ingested FROM events")
def _(c):
    m = _streamed(c)[2]
    _, store, _ = _streamed(c)
    runs = store.runs().agg(F.sum("records_ingested").alias("records_ingested"))
    # Rows of the progress reports and of the run rows must be the same number.
    return runs.filter(F.lit(m["records_ingested"]) >= F.col("records_ingested"))


@query("i14_stream_ledger", "SELECT CAST(ts AS date) AS day, 'SUCCESS' AS status, count(*) AS records FROM events GROUP BY 1")
def _(c):
    _, store, _ = _streamed(c)
    return store.state("events").groupBy(folder_day().alias("day"), "status").agg(F.sum("records_ingested").alias("records"))


@query("h15_stream_rollup", """
SELECT event_type, CAST(date_trunc('day', ts) AS timestamp) AS window_start, count(*) AS file_count, CAST(0 AS bigint) AS failed_count,
  CAST(sum(user_id) AS bigint) AS records, CAST(sum(event_id) AS bigint) AS bytes FROM events GROUP BY 1, 2""")
def _(c):
    def make():
        out = c.scratch("windows")
        rows = stream.read_files(c.spark, landed(c), "json", BASE, max_files_per_trigger=10).select(
            "event_type", F.to_timestamp("ts").alias("ts"), F.lit("SUCCESS").alias("status"),
            F.col("user_id").alias("records_ingested"), F.col("event_id").alias("bytes_read"),
        )
        agg = stream_rollup.stream_rollup(rows, "day", "ts", "40 days", ("event_type",))
        stream_rollup.start_update_sink(agg, out, c.scratch("stream")).awaitTermination()
        return out

    written = c.spark.read.parquet(c.once("windows", make))
    latest = stream_rollup.latest_windows(written, ("event_type", "window_start"))
    return latest.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


# --- schemas --------------------------------------------------------------------------------------

SCHEMA_A = "OBJECT<event_id: BIGINT, event_type: STRING, ts: STRING, user_id: BIGINT, value: "
WIDE = "OBJECT<event_id: BIGINT, event_type: STRING, meta: OBJECT<k: BIGINT>, region: STRING, ts: STRING, user_id: BIGINT, value: "


def _file_schemas(c):
    def make():
        path = c.scratch("schemas")
        S.json_file_schemas(_all_lines(c)).write.parquet(path)
        return path

    return c.spark.read.parquet(c.once("schemas", make)).withColumnRenamed(SOURCE_FILE, "file_path")


def _all_lines(c):
    return _lines(c, "days_a").unionByName(_lines(c, "days_b"))


@query("s7_file_schemas", f"""
SELECT CAST(ts AS date) AS day, CASE WHEN day(ts) <= 20 THEN '{SCHEMA_A}' ELSE '{WIDE}' END AS columns_up_to_value,
  count(*) AS records, CAST(0 AS bigint) AS malformed FROM events GROUP BY 1, 2""")
def _(c):
    return _file_schemas(c).groupBy(
        folder_day().alias("day"), F.regexp_replace("variant_schema", "value: .*$", "value: ").alias("columns_up_to_value")
    ).agg(F.sum("record_count").alias("records"), F.sum("malformed_count").alias("malformed"))


@query("s8_schema_groups", f"""
SELECT CASE WHEN day(ts) <= 20 THEN '{SCHEMA_A}' ELSE '{WIDE}' END AS columns_up_to_value, count(*) AS records FROM events GROUP BY 1""")
def _(c):
    groups = S.schema_groups(_file_schemas(c).withColumnRenamed("file_path", SOURCE_FILE))
    return groups.groupBy(F.regexp_replace("variant_schema", "value: .*$", "value: ").alias("columns_up_to_value")).agg(
        F.sum("record_count").alias("records")
    )


@query("s1_new_columns", """
SELECT 2 AS version, 'NEW_COLUMN' AS change_type, column_name FROM (VALUES ('meta'), ('region')) v(column_name)
WHERE EXISTS (SELECT 1 FROM events WHERE day(ts) > 20)""")
def _(c):
    _, store = ingested(c)
    changes = H.version_changes(store.read("schema_versions").withColumn("schema_json", F.regexp_replace(
        "schema_json", r'\{"fields":\[\{"metadata":\{\},"name":"k"[^\]]*\],"type":"struct"\}', '"struct<k:bigint>"')))
    return changes.select("version", "change_type", "column_name")


@query("s2_add_columns", """
SELECT column_name, CASE column_name WHEN 'region' THEN 'string' ELSE 'struct<k:bigint>' END AS data_type, n AS filled FROM (
  SELECT unnest(['meta', 'region']) AS column_name, count(*) FILTER (WHERE day(ts) > 20) AS n FROM events) t""")
def _(c):
    config, store = ingested(c)
    rows = writer.committed(c.spark, config.table, store)
    added = H.schema_rows(c.spark, rows.schema).filter("column_name in ('meta', 'region')").select("column_name", "data_type")
    filled = rows.agg(F.count("meta").alias("meta"), F.count("region").alias("region")).unpivot([], ["meta", "region"], "column_name", "filled")
    return added.join(filled, "column_name")


@query("s3_null_backfill", """
SELECT CAST(ts AS date) AS day, count(*) AS n, count(*) FILTER (WHERE day(ts) <= 20) AS null_region,
  count(*) FILTER (WHERE day(ts) <= 20) AS null_meta FROM events GROUP BY 1""")
def _(c):
    config, store = ingested(c)
    rows = writer.committed(c.spark, config.table, store)
    return rows.groupBy(F.to_date("ts").alias("day")).agg(
        F.count("*").alias("n"), F.count_if(F.col("region").isNull()).alias("null_region"),
        F.count_if(F.col("meta").isNull()).alias("null_meta"),
    )


def _columns_of(types):
    return types.groupBy("column_name").agg(F.max(F.when(F.col("data_type") != "VOID", F.col("data_type"))).alias("data_type")).withColumn("nullable", F.lit(True))


DIFF_AB = """SELECT 'NEW_COLUMN' AS change_type, column_name, NULL AS old_type, new_type, false AS breaking FROM (
  VALUES ('region', 'STRING'), ('meta', 'OBJECT')) v(column_name, new_type) WHERE EXISTS (SELECT 1 FROM events)
  UNION ALL SELECT 'REMOVED_COLUMN', 'props', 'STRING', NULL, true WHERE EXISTS (SELECT 1 FROM events)"""


def _diff_ab(c):
    old = _lines(c, "days_a").unionByName(
        c.table("events").select(F.to_json(F.struct("props")).alias("value"), F.lit("props").alias(SOURCE_FILE))
    )
    return H.diff_rows(_columns_of(S.column_types(old)), _columns_of(S.column_types(_lines(c, "days_b"))))


@query("s4_schema_diff", DIFF_AB)
def _(c):
    return _diff_ab(c).select("change_type", "column_name", "old_type", "new_type", "breaking")


@query("s5_verdict", f"SELECT count(*) > 0 AS has_changes, bool_or(breaking) AS is_breaking, NOT bool_or(breaking) AS is_compatible FROM ({DIFF_AB}) t")
def _(c):
    return H.verdict(_diff_ab(c))


@query("s6_schema_merge", """
SELECT * FROM (VALUES ('event_id', 'bigint'), ('event_type', 'string'), ('meta', 'struct<k:bigint>'), ('region', 'string'),
  ('ts', 'string'), ('user_id', 'bigint'), ('value', 'double')) v(column_name, data_type) WHERE EXISTS (SELECT 1 FROM events)""")
def _(c):
    groups = S.schema_groups(_file_schemas(c).withColumnRenamed("file_path", SOURCE_FILE))
    return H.schema_rows(c.spark, S.merge_variant_schemas(groups)).select("column_name", "data_type")


@query("s6_many_schemas", """
SELECT 'c_' || user_id AS column_name, CASE WHEN count(DISTINCT event_id % 3) > 1 OR min(event_id % 3) = 1 THEN 'double' ELSE 'bigint' END AS data_type
FROM (SELECT user_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS event_id FROM events) e GROUP BY 1
UNION ALL SELECT 'nest', 'struct<a:bigint,b:' || CASE WHEN bool_or(event_type = 'error') AND bool_or(event_type <> 'error') THEN 'string' WHEN bool_or(event_type = 'error') THEN 'bigint' ELSE 'string' END || '>' FROM events""")
def _(c):
    """One schema per user and event kind: columns that only some records have, numbers that widen, a field that clashes."""
    odd = F.col("event_type") == "error"
    nest = F.when(odd, F.concat(F.lit('{"a": 1, "b": '), "event_id", F.lit("}"))).otherwise(F.lit('{"a": 2, "b": "x"}'))
    number = F.when(odd, F.lit("1.5")).otherwise(F.lit("7"))
    text = F.concat(F.lit('{"nest": '), nest, F.lit(', "c_'), F.col("user_id"), F.lit('": '), number, F.lit("}"))
    lines = c.table("events").select(text.alias("value"), F.concat_ws("/", "user_id", F.when(odd, "a").otherwise("b")).alias(SOURCE_FILE))
    return H.schema_rows(c.spark, S.merge_variant_schemas(S.schema_groups(S.json_file_schemas(lines)))).select("column_name", "data_type")


@query("s9_next_versions", """
SELECT d.ingestion_id, schema_json, CAST(coalesce(top, 0) + row_number() OVER (PARTITION BY d.ingestion_id ORDER BY detected_at, schema_json) AS int) AS version
FROM (SELECT ingestion_id, lang AS schema_json, min(modified_at) AS detected_at FROM manifest GROUP BY 1, 2) d
LEFT JOIN (SELECT ingestion_id, max(schema_version) AS top FROM ledger GROUP BY 1) h ON h.ingestion_id = d.ingestion_id""",
       ("manifest", "ledger"))
def _(c):
    detected = c.manifest.groupBy("ingestion_id", F.col("lang").alias("schema_json")).agg(F.min("modified_at").alias("detected_at"))
    history = c.ledger.select("ingestion_id", F.col("schema_version").alias("version"))
    return H.next_versions(detected, history).select("ingestion_id", "schema_json", "version")


@query("s9_latest_version", """
SELECT ingestion_id, max(schema_version) AS version, max(CASE WHEN schema_version = 3 THEN 'v3' WHEN schema_version = 2 THEN 'v2' ELSE 'v1' END) AS schema_json
FROM ledger GROUP BY 1""", ("ledger",))
def _(c):
    return H.latest_version(c.ledger.select("ingestion_id", F.col("schema_version").alias("version"), F.concat(F.lit("v"), F.col("schema_version").cast("string")).alias("schema_json")))


@query("s9_affected_files", """
SELECT ingestion_id, retry_count AS version, count(DISTINCT file_path) AS file_count, min(file_path) AS first_file FROM state GROUP BY 1, 2""", ("state",))
def _(c):
    return H.affected_files(c.state.select("ingestion_id", F.col("retry_count").alias("version"), "file_path"))


def _old_new(c):
    old = c.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    new = c.table("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return old, new


@query("s10_auto_merge", "SELECT c_custkey AS id, c_name AS name, NULL::int AS nation FROM customer UNION ALL SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def _(c):
    return H.auto_merge(*_old_new(c))


@query("s11_backfill_default", "SELECT c_custkey AS id, c_name AS name, -1 AS nation FROM customer UNION ALL SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def _(c):
    return H.backfill_default(*_old_new(c), {"nation": F.lit(-1)})


@query("s12_version_table", "SELECT c_custkey AS id, c_name AS name, NULL::int AS nation FROM customer UNION ALL SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def _(c):
    def make():
        table = "versioned_" + c.scratch("t")[-12:]
        old, new = _old_new(c)
        old.write.saveAsTable(table)
        return table, H.version_table(c.spark, table, 2, new, f"{table}_all")

    table, _ = c.once("versioned", make)
    return c.spark.table(f"{table}_all")


@query("s13_ignore_new", "SELECT s_suppkey AS id, s_name AS name FROM supplier")
def _(c):
    old, new = _old_new(c)
    return H.ignore_new(old.schema, new)


@query("s15_inconsistent_columns", """
SELECT 'event_id' AS column_name, 'BIGINT' AS data_type, count(*) AS record_count, 'BIGINT' AS types, false AS inconsistent FROM events
UNION ALL SELECT 'value', 'DOUBLE', count(*) FILTER (WHERE event_type <> 'error'), 'DOUBLE,STRING', true FROM events
UNION ALL SELECT 'value', 'STRING', count(*) FILTER (WHERE event_type = 'error'), 'DOUBLE,STRING', true FROM events""")
def _(c):
    e = c.table("events")
    shaped = F.when(F.col("event_type") == "error", F.to_json(F.struct("event_id", F.col("value").cast("string").alias("value")))).otherwise(
        F.to_json(F.struct("event_id", (F.round(F.col("value")) + 0.5).alias("value"))))
    lines = e.select(shaped.alias("value"), F.to_date("ts").cast("string").alias(SOURCE_FILE))
    return H.inconsistency_report(lines).select("column_name", "data_type", "record_count", "types", "inconsistent")


@query("s16_recent_sample", """
SELECT 'NEW_COLUMN' AS change_type, column_name, new_type FROM (VALUES ('region', 'STRING'), ('meta', 'OBJECT')) v(column_name, new_type)
WHERE EXISTS (SELECT 1 FROM events WHERE day(ts) > 20)""")
def _(c):
    known = _columns_of(S.column_types(_lines(c, "days_a")))
    first = M.first_files(M.list_files(c.spark, f"{landed(c)}/days_b"), 10)
    sample = S.read_lines(c.spark, [r[0] for r in first.select("path").collect()])
    return H.diff_rows(known, _columns_of(S.column_types(sample))).select("change_type", "column_name", "new_type")


@query("q3_pending_approvals", """
SELECT ingestion_id, count(*) AS pending_count, 'info' AS severity, concat(CAST(count(*) AS varchar), ' schema changes awaiting approval') AS message
FROM state WHERE error_type = 'SchemaEvolutionError' GROUP BY 1""", ("state",))
def _(c):
    history = c.state.select("ingestion_id", F.when(F.col("error_type") == "SchemaEvolutionError", "pending_approval").otherwise("auto_merge").alias("resolution_type"))
    return H.pending_approvals(history)


# --- transforms and preview -----------------------------------------------------------------------

@query("x1_select", "SELECT o_orderkey, o_orderstatus FROM orders")
def _(c):
    return X.apply(c.table("orders"), [("select", ["o_orderkey", "o_orderstatus"])])


@query("x2_filter", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_custkey > 100")
def _(c):
    return X.apply(c.table("orders"), [("filter", "o_orderstatus = 'F' AND o_custkey > 100"), ("select", ["o_orderkey", "o_orderstatus"])])


@query("x3_rename", "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders")
def _(c):
    return X.apply(c.table("orders").select("o_orderkey", "o_orderstatus"), [("rename", {"o_orderkey": "id", "o_orderstatus": "status"})])


@query("x4_cast", "SELECT p_partkey, TRY_CAST(p_brand AS bigint) AS p_brand, CAST(p_size AS varchar) AS p_size FROM part")
def _(c):
    return X.apply(c.table("part").select("p_partkey", "p_brand", "p_size"), [("cast", {"p_brand": "bigint", "p_size": "string"})])


@query("x4_failed_casts", "SELECT 'p_brand' AS column_name, count(*) AS failed_count FROM part UNION ALL SELECT 'p_size', 0")
def _(c):
    return X.failed_casts(c.table("part"), {"p_brand": "bigint", "p_size": "string"})


@query("x5_date_formats", "SELECT o_orderkey, o_orderdate AS parsed FROM orders")
def _(c):
    iso, us = "yyyy-MM-dd'T'HH:mm:ss", "MM/dd/yy"
    text = F.when(F.col("o_orderpriority") < "3", F.date_format("o_orderdate", iso)).otherwise(F.date_format("o_orderdate", us))
    # Two-digit years read as 20xx, so dates before 2000 are told by their century.
    old = F.year("o_orderdate") < 2000
    shown = c.table("orders").select("o_orderkey", F.when(old, F.date_format("o_orderdate", iso)).otherwise(text).alias("t"))
    return shown.select("o_orderkey", parse_timestamps(F.col("t"), [iso, us]).cast("timestamp_ntz").alias("parsed"))


@query("x6_derived_backfill", """
SELECT p_partkey, coalesce(CASE WHEN p_size > 25 THEN p_name END, concat(p_brand, '-', p_type)) AS label FROM part""")
def _(c):
    part = c.table("part").withColumn("label", F.when(F.col("p_size") > 25, F.col("p_name")))
    return X.fill_derived(part, "label", ["p_brand", "p_type"]).select("p_partkey", "label")


@query("p1_preview_schema", """
SELECT * FROM (VALUES ('event_id', 'bigint', true), ('event_type', 'string', true), ('meta', 'struct<k:bigint>', true), ('region', 'string', true),
  ('ts', 'string', true), ('user_id', 'bigint', true), ('value', 'double', true)) v(column_name, data_type, nullable) WHERE EXISTS (SELECT 1 FROM events)""")
def _(c):
    df = readers.scan(c.spark, "json", landed(c), options={"recursiveFileLookup": "true"})
    return P.preview_schema(df).select("column_name", "data_type", "nullable")


@query("p1_preview_heads", """
SELECT * FROM (VALUES ('event_id', 'bigint', true), ('event_type', 'string', true), ('meta', 'struct<k:bigint>', true), ('region', 'string', true),
  ('ts', 'string', true), ('user_id', 'bigint', true), ('value', 'double', true)) v(column_name, data_type, nullable) WHERE EXISTS (SELECT 1 FROM events WHERE day(ts) > 20)""")
def _(c):
    """From the first lines of ten files; the others are not opened."""
    schema, _ = P.preview_heads(M.list_files(c.spark, f"{landed(c)}/days_b"))
    return schema.select("column_name", "data_type", "nullable")


@query("a15_sampled_run", """
SELECT event_type, count(*) AS n, CAST(sum(event_id) AS bigint) AS ids, count(region) AS regions FROM (
  SELECT event_type, event_id, CASE WHEN day(ts) > 20 THEN 1 END AS region FROM events) e GROUP BY 1""")
def _(c):
    """Two runs whose schema comes from the first lines of three files each; the second adds columns."""
    def make():
        table = "sampled_" + c.scratch("t")[-12:]
        store = StateStore(c.spark, c.scratch("state"))
        for k, folder in enumerate(("days_a", "days_b")):
            config = IngestionConfig("sampled", f"{landed(c)}/{folder}", table, location=f"{store.root}/table", file_pattern=".json", schema_sample_files=3)
            run_ingestion(c.spark, config, store, T1 if k == 0 else T2, f"run_{k}")
        return config, store

    config, store = c.once("sampled", make)
    rows = writer.committed(c.spark, config.table, store)
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").cast("bigint").alias("ids"), F.count("region").alias("regions"))


@query("k3_timed_sample", "SELECT count(DISTINCT day(ts)) AS files, count(*) AS records, true AS took_time FROM events WHERE day(ts) > 20 HAVING count(*) > 0")
def _(c):
    """A sample that is read and timed, with its records counted by the read itself."""
    from tidemark.operators.impact import timed_sample

    found = timed_sample(c.spark, M.list_files(c.spark, f"{landed(c)}/days_b"), "json", BASE, files=31)
    return c.spark.createDataFrame([(found["files"], found["records"], found["seconds"] > 0)], "files long, records long, took_time boolean")


@query("p2_sample_rows", """
SELECT concat('{"o_orderkey":', o_orderkey, ',"o_custkey":', o_custkey, ',"o_orderstatus":"', o_orderstatus, '"}') AS record
FROM orders ORDER BY o_orderkey LIMIT 5""")
def _(c):
    return P.sample_rows(c.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_orderkey"])
