"""Continuous arrival: the file source of Structured Streaming into the same table and ledger."""

from __future__ import annotations

import time
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark.model import CORRUPT, FAILED, MALFORMED_ERROR, RUN_RUNNING, RUN_SCHEMA, SOURCE_FILE, SUCCESS, IngestionConfig
from tidemark.operators import planning, writer
from tidemark.operators.state_store import StateStore
from tidemark.plans.ingest import run_ingestion, run_metrics, run_status
from tidemark.sources import listing, manifest as manifests
from tidemark.sources.paths import scanned_file
from tidemark.sources.readers import reader_options

# Fixed value: bytes assumed per written row when only row counts are known.
BYTES_PER_ROW = 100


def read_files(
    spark: SparkSession,
    path: str,
    fmt: str,
    schema: T.StructType,
    options: dict | None = None,
    max_files_per_trigger: int | None = None,
    max_file_age: str | None = None,
) -> DataFrame:
    """Stream of landed files; a file source needs its schema up front."""
    reader = spark.readStream.format(fmt).schema(schema).options(**reader_options(options))
    reader = reader.option("recursiveFileLookup", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if max_file_age:
        reader = reader.option("maxFileAge", max_file_age)
    return reader.load(path)


def trigger_options(trigger: str = "availableNow", interval: str = "10 seconds") -> dict:
    return {"availableNow": True} if trigger == "availableNow" else {"processingTime": interval}


def write_table(
    rows: DataFrame,
    table: str,
    checkpoint: str,
    output_mode: str = "append",
    partition_columns: tuple[str, ...] = (),
    trigger: str = "availableNow",
    interval: str = "10 seconds",
):
    """Starts a query into a table; checkpoint and file sink make the rows exactly-once."""
    out = rows.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint).option("mergeSchema", True)
    if partition_columns:
        out = out.partitionBy(*partition_columns)
    return out.trigger(**trigger_options(trigger, interval)).toTable(table)


def progress_metrics(progress: list) -> dict:
    """Totals over the progress reports of a query."""
    rows = sum(p["numInputRows"] or 0 for p in progress)
    written = sum(max(p["sink"]["numOutputRows"] or 0, 0) for p in progress)
    return {"batches": len(progress), "records_ingested": rows, "bytes_written": written * BYTES_PER_ROW}


def ingest_stream(
    spark: SparkSession,
    config: IngestionConfig,
    store: StateStore,
    checkpoint: str,
    as_of: datetime | None = None,
    max_files_per_trigger: int | None = None,
    trigger: str = "availableNow",
    interval: str = "10 seconds",
    stream_id: str = "stream",
):
    """Starts a query whose every micro-batch is one run of the commit protocol.

    The run id follows from the batch id, so a batch that Spark repeats replaces itself in table and ledger. Each batch
    has its own times, kept with its run row for a repeat; ``as_of`` fixes the time of all instead.
    """
    schema = config.explicit_schema
    if schema is None:
        raise ValueError("a stream needs an explicit schema")
    if not writer.table_exists(spark, config.table):
        writer.create_table(spark, config.table, schema, config.partition_columns, config.location)
    elif config.evolution_enabled:
        writer.evolve_table(spark, config.table, schema)
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    options = {**config.format_options, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    if config.file_pattern:
        options["pathGlobFilter"] = config.file_pattern
    source = read_files(spark, config.source_path, config.format, full, options, max_files_per_trigger, config.max_file_age)
    rows = source.select(
        "*", scanned_file(F.col("_metadata.file_path")).alias(SOURCE_FILE),
        F.col("_metadata.file_size").alias("_size"), F.col("_metadata.file_modification_time").alias("_modified"),
    )

    def batch(df: DataFrame, batch_id: int) -> None:
        commit_batch(df, f"{stream_id}-{batch_id:010d}", config, store, as_of)

    return (
        rows.writeStream.foreachBatch(batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger_options(trigger, interval))
        .start()
    )


def ingest_arrivals(
    spark: SparkSession,
    config: IngestionConfig,
    store: StateStore,
    checkpoint: str,
    as_of: datetime | None = None,
    trigger: str = "availableNow",
    interval: str = "10 seconds",
    stream_id: str = "arrivals",
):
    """Starts a query whose every micro-batch lists the source and runs whatever the ledger says needs it.

    The stream carries moments of listing; what was listed at one is the plan that the batch's run stores, so a batch that
    Spark repeats takes the same files. Empty, changed and failed files come as in any run, and so do new columns; a schema
    may be given or found. A batch without anything to do leaves no trace.
    """
    listing.register(spark)

    def batch(_, batch_id: int) -> None:
        run_ingestion(spark, config, store, as_of, f"{stream_id}-{batch_id:010d}", trigger="stream", skip_idle=True)

    return (
        spark.readStream.format("tidemark_arrivals").load()
        .writeStream.foreachBatch(batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger_options(trigger, interval))
        .start()
    )


def commit_batch(df: DataFrame, run_id: str, config: IngestionConfig, store: StateStore, as_of: datetime | None = None) -> None:
    """Table rows, one ledger event per file, then the run row."""
    spark = df.sparkSession
    clock = time.monotonic()
    begun = as_of or _first_start(store, config.ingestion_id, run_id) or datetime.now(timezone.utc)
    start = (config.ingestion_id, begun, None, RUN_RUNNING, "stream", 0, 0, 0, 0, 0, 0, None, 0, [], config.table, run_id)
    store.append("runs", config.ingestion_id, run_id, "start", spark.createDataFrame([start], RUN_SCHEMA))
    for part in (0, -1):
        writer.drop_run(spark, config.table, run_id, part)
    # Size and time of each file travel with the rows to the ledger, so the batch is scanned twice at most.
    writer.write_part(df.drop("_size", "_modified"), config.table, run_id, 0, config.partition_columns, config.cluster_columns)
    files = df.groupBy(SOURCE_FILE).agg(F.max("_size").alias("size"), F.max("_modified").alias("modified"))
    counts = writer.file_counts(spark, config.table, run_id)
    fail_file = config.on_bad_records == "fail_file"
    failed = counts.filter("bad_count > 0") if fail_file else counts.filter("false")
    bad = F.coalesce(F.col("bad_count"), F.lit(0))
    verdict = F.when(bad > 0, FAILED).otherwise(SUCCESS) if fail_file else F.lit(SUCCESS)
    took = timedelta(0) if as_of else timedelta(seconds=time.monotonic() - clock)
    events = files.join(counts, SOURCE_FILE, "left").withColumn("status", verdict)
    store.append("ledger", config.ingestion_id, run_id, "done", _events(events, config, begun, begun + took))
    if not failed.isEmpty():
        writer.retract_files(spark, config.table, run_id, 0, failed)
    m = run_metrics(store.events(config.ingestion_id, run_id)).first() or (0, 0, 0, 0, 0)
    written = writer.bytes_written(spark, config.table, run_id).first()[0]
    row = (config.ingestion_id, begun, begun + took, run_status(m[0], m[1]), "stream", m[0] + m[1], m[1], m[2], m[3], m[4],
           written, int(took.total_seconds()), m[1], [], config.table, run_id)
    store.append("runs", config.ingestion_id, run_id, "end", spark.createDataFrame([row], RUN_SCHEMA))
    store.fold_if_due()


def _first_start(store: StateStore, ingestion_id: str, run_id: str) -> datetime | None:
    """When a batch was first tried, in UTC."""
    row = store.read("runs", ingestion_id, run_id, "start").select(F.unix_micros("started_at")).first()
    return datetime.fromtimestamp(row[0] / 1e6, timezone.utc) if row else None


def _events(files: DataFrame, config: IngestionConfig, begun: datetime, ended: datetime) -> DataFrame:
    """Ledger events of files with ``status``, size, time and record counts."""
    nothing, start, end = F.lit(None), F.lit(begun), F.lit(ended)
    ok = F.col("status") == SUCCESS
    return files.select(
        F.lit(config.ingestion_id).alias("ingestion_id"), F.col(SOURCE_FILE).alias("file_path"),
        F.col("size").alias("file_size_bytes"), F.col("modified").alias("file_modified_at"),
        nothing.cast("string").alias("file_etag"), "status",
        start.alias("discovered_at"), start.alias("processing_started_at"), end.alias("processed_at"),
        F.when(ok, F.coalesce("good_count", F.lit(0))).alias("records_ingested"),
        F.when(ok, F.col("size")).alias("bytes_read"),
        F.lit(int((ended - begun).total_seconds() * 1000)).cast("bigint").alias("processing_duration_ms"),
        F.when(~ok, F.format_string("%d records do not fit the schema", "bad_count")).alias("error_message"),
        F.when(~ok, MALFORMED_ERROR).alias("error_type"),
        F.lit(0).alias("retry_count"), nothing.cast("int").alias("schema_version"),
        end.alias("event_time"), F.lit(1).alias("seq"),
    )


def settle_empty_files(spark: SparkSession, config: IngestionConfig, store: StateStore, as_of: datetime | None = None) -> int:
    """Enters the empty files of the source, which a stream never sees, as done with 0 records; returns how many.

    Meant to be called now and then, or after a stream that takes what is there and ends.
    """
    at = as_of or datetime.now(timezone.utc)
    found = manifests.discover(spark, config.source_path, pattern=config.file_pattern, match=config.match)
    empty = found.filter("size_bytes = 0").withColumn("ingestion_id", F.lit(config.ingestion_id))
    fresh = planning.new_files(empty, store.state(config.ingestion_id)).select(
        F.col("path").alias(SOURCE_FILE), F.col("size_bytes").alias("size"), F.col("modified_at").cast("timestamp").alias("modified"),
        F.lit(SUCCESS).alias("status"), F.lit(0).cast("bigint").alias("good_count"), F.lit(0).cast("bigint").alias("bad_count"),
    )
    token = f"empty-{at:%Y%m%dT%H%M%S%f}"
    store.append("ledger", config.ingestion_id, token, "done", _events(fresh, config, at, at))
    return store.events(config.ingestion_id, token).count()
