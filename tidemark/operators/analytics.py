"""Monitoring queries over the ledger and the runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.expressions import as_column, minus
from tidemark.model import FAILED, PENDING, PROCESSING, SKIPPED, SUCCESS


def _since(column: str, as_of, **back: int) -> Column:
    return F.col(column) > minus(as_column(as_of), **back)


def _gb(column: str = "bytes_read") -> Column:
    return F.round(F.coalesce(F.sum(column), F.lit(0)) / 1024.0 / 1024.0 / 1024.0, 6)


def _long_sum(c) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("bigint")


def _count(status: str) -> Column:
    return F.count_if(F.col("status") == status)


def run_history(runs: DataFrame, as_of, days: int = 30, limit: int | None = 100, ingestion_id: str | None = None) -> DataFrame:
    """Runs of the last days, newest first."""
    out = runs.filter(F.col("started_at") >= minus(as_column(as_of), days=days))
    if ingestion_id is not None:
        out = out.filter(F.col("ingestion_id") == ingestion_id)
    return out if limit is None else out.orderBy(F.desc("started_at"), "run_id").limit(limit)


def run_by_id(runs: DataFrame, run_id: str) -> DataFrame:
    return runs.filter(F.col("run_id") == run_id)


def runs_of_active(runs: DataFrame, ingestions: DataFrame, tenant: str | None = None) -> DataFrame:
    """Runs of active ingestions, optionally of one tenant."""
    active = ingestions.filter(F.col("status") == "active")
    if tenant is not None:
        active = active.filter(F.col("tenant_id") == tenant)
    return runs.join(active.select("ingestion_id"), "ingestion_id", "left_semi")


def last_run(runs: DataFrame) -> DataFrame:
    return runs.groupBy("ingestion_id").agg(
        F.max_by("run_id", F.struct("started_at", "run_id")).alias("last_run_id"), F.max("started_at").alias("last_run_at")
    )


def health(state: DataFrame, as_of, hours: int = 24) -> DataFrame:
    return state.filter(_since("processed_at", as_of, hours=hours)).groupBy("ingestion_id").agg(
        _count(SUCCESS).alias("success_count"),
        _count(FAILED).alias("failed_count"),
        _count(SKIPPED).alias("skipped_count"),
        F.avg("processing_duration_ms").alias("avg_duration_ms"),
        _long_sum("records_ingested").alias("total_records"),
        _gb().alias("total_gb"),
        F.max("processed_at").alias("last_processed_at"),
    )


def slowest_files(state: DataFrame, as_of, days: int = 7, limit: int = 20) -> DataFrame:
    seconds = F.col("processing_duration_ms") / 1000.0
    return (
        state.filter((F.col("status") == SUCCESS) & _since("processed_at", as_of, days=days))
        .orderBy(F.desc("processing_duration_ms"), "ingestion_id", "file_path")
        .limit(limit)
        .select(
            "file_path",
            seconds.alias("duration_seconds"),
            "records_ingested",
            (F.col("bytes_read") / 1024.0 / 1024.0).alias("size_mb"),
            F.try_divide(F.col("records_ingested").cast("double"), seconds).alias("records_per_second"),
        )
    )


def error_patterns(state: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Errors by type."""
    return _failures(state, as_of, days).groupBy("error_type").agg(
        F.count("*").alias("error_count"),
        F.count_distinct("ingestion_id").alias("affected_ingestions"),
        F.count_distinct(F.left("error_message", F.lit(100))).alias("distinct_messages"),
    )


def error_messages(state: DataFrame, as_of, days: int = 30) -> DataFrame:
    """The messages behind :func:`error_patterns`: one row per type and message head, so none is left out
    and no type with very many messages becomes one huge array."""
    return _failures(state, as_of, days).groupBy(
        "error_type", F.left("error_message", F.lit(100)).alias("message")
    ).agg(F.count("*").alias("error_count"))


def _failures(state: DataFrame, as_of, days: int) -> DataFrame:
    return state.filter((F.col("status") == FAILED) & _since("processed_at", as_of, days=days))


def daily_volume(state: DataFrame, days: int | None = 30) -> DataFrame:
    """Volume per day, for the latest days that have any."""
    per_day = state.filter(F.col("status") == SUCCESS).groupBy(F.to_date("processed_at").alias("date")).agg(
        F.count("*").alias("files_processed"),
        _long_sum("records_ingested").alias("total_records"),
        _gb().alias("total_gb"),
        (F.avg("processing_duration_ms") / 1000.0).alias("avg_duration_seconds"),
    )
    return per_day if days is None else per_day.orderBy(F.desc("date")).limit(days)


def backlog(state: DataFrame, ingestions: DataFrame) -> DataFrame:
    """Pending files per ingestion; counted before the join, so the join sees one row per ingestion."""
    pending = state.filter(F.col("status") == PENDING).groupBy("ingestion_id").agg(
        F.count("*").alias("pending_count"), F.min("discovered_at").alias("oldest_discovered")
    )
    return pending.join(ingestions.select("ingestion_id", "name"), "ingestion_id").select(
        "ingestion_id", F.col("name").alias("ingestion_name"), "pending_count", "oldest_discovered"
    )


def retry_analysis(state: DataFrame) -> DataFrame:
    return state.filter(F.col("retry_count") > 0).groupBy("ingestion_id", "retry_count").agg(
        F.count("*").alias("file_count"),
        _count(SUCCESS).alias("eventually_succeeded"),
        _count(FAILED).alias("still_failing"),
    )


def run_progress(state: DataFrame, run_id: str | None = None) -> DataFrame:
    """Progress per run, or of one run."""
    rows = state if run_id is None else state.filter(F.col("run_id") == run_id)
    out = rows.groupBy("run_id").agg(
        F.count("*").alias("total_files"),
        _count(SUCCESS).alias("success"),
        _count(FAILED).alias("failed"),
        _count(PROCESSING).alias("processing"),
        _count(PENDING).alias("pending"),
        _long_sum("records_ingested").alias("total_records"),
        _long_sum("bytes_read").alias("total_bytes"),
    )
    return out.withColumn(
        "completion_percentage", (F.col("success") + F.col("failed")) / F.col("total_files") * 100.0
    )


def find_file(state: DataFrame, file_path: str) -> DataFrame:
    """Status and failure details of one file."""
    return _details(state.filter(F.col("file_path") == file_path))


def failures(state: DataFrame, as_of=None, days: int | None = None) -> DataFrame:
    bad = state.filter(F.col("status") == FAILED)
    return _details(bad if days is None else bad.filter(_since("processed_at", as_of, days=days)))


def _details(state: DataFrame) -> DataFrame:
    return state.select(
        "ingestion_id", "file_path", "status", "error_type", "error_message", "retry_count", "processing_started_at",
        "processed_at", (F.col("processing_duration_ms") / 1000.0).alias("duration_seconds"), "records_ingested", "bytes_read",
    )


def dashboard(state: DataFrame, ingestions: DataFrame, as_of) -> DataFrame:
    """One row: active ingestions, files and GB of the last day and the day before, success rate, change."""
    now = as_column(as_of)
    day = (F.col("processed_at") > minus(now, hours=24)) & (F.col("processed_at") <= now)
    before = (F.col("processed_at") > minus(now, hours=48)) & (F.col("processed_at") <= minus(now, hours=24))
    ok, bad = F.col("status") == SUCCESS, F.col("status") == FAILED

    def window_sum(w: Column) -> Column:
        return F.coalesce(F.sum(F.when(w & ok, F.col("bytes_read"))), F.lit(0)).cast("bigint")

    two_days = state.filter(F.col("processed_at") > minus(now, hours=48))
    kpis = two_days.agg(
        F.count_if(day & ok).alias("files_24h"),
        F.count_if(before & ok).alias("files_previous_24h"),
        window_sum(day).alias("bytes_24h"),
        window_sum(before).alias("bytes_previous_24h"),
        F.count_if(day & (ok | bad)).alias("_ended"),
    )
    active = ingestions.agg(F.count_if(F.col("status") == "active")).scalar()
    return kpis.select(
        active.alias("active_ingestions"), "files_24h", "files_previous_24h", "bytes_24h", "bytes_previous_24h",
        F.round(F.try_divide(F.col("files_24h") * 100.0, F.col("_ended")), 6).alias("success_rate"),
        F.round(
            F.try_divide((F.col("files_24h") - F.col("files_previous_24h")) * 100.0, F.col("files_previous_24h")), 6
        ).alias("files_change_pct"),
    )


def trend(state: DataFrame, ingestions: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Daily series per ingestion over the last days; days without files count zero."""
    last = F.to_date(as_column(as_of))
    first = F.date_sub(last, days - 1)
    per_day = (
        state.withColumn("day", F.to_date("processed_at"))
        .filter(F.col("day").between(first, last))
        .groupBy("ingestion_id", "day")
        .agg(
            _count(SUCCESS).alias("files"), _count(FAILED).alias("failed_files"),
            F.count_distinct(F.when(F.col("status") == FAILED, F.col("run_id"))).alias("failed_runs"),
            _long_sum("records_ingested").alias("records"), F.avg("processing_duration_ms").alias("avg_duration_ms"),
        )
    )
    calendar = ingestions.select("ingestion_id", F.explode(F.sequence(first, last)).alias("day"))
    return calendar.join(per_day, ["ingestion_id", "day"], "left").fillna(
        0, ["files", "failed_files", "failed_runs", "records"]
    )


# Window lengths of the rollups; weeks start on Monday, four days into the epoch week.
ROLLUPS = {"hour": ("1 hour", "0 hours"), "day": ("1 day", "0 hours"), "week": ("7 days", "4 days")}


def rollup(rows: DataFrame, grain: str, time: str = "processed_at", by: tuple[str, ...] = ("ingestion_id",)) -> DataFrame:
    """Hourly, daily or weekly sums; takes batch and streaming frames alike."""
    length, start = ROLLUPS[grain]
    w = F.window(F.col(time), length, startTime=start)
    return rows.groupBy(*by, w.alias("_w")).agg(
        F.count("*").alias("file_count"),
        F.count_if(F.col("status") == FAILED).alias("failed_count"),
        _long_sum("records_ingested").alias("records"),
        _long_sum("bytes_read").alias("bytes"),
    ).select(*by, F.col("_w.start").alias("window_start"), "file_count", "failed_count", "records", "bytes")


# What a rollup sums up; sums of parts add up to those of the whole.
SUMS = ("file_count", "failed_count", "records", "bytes")


def merged_sums(hourly: DataFrame, grain: str) -> DataFrame:
    """Partial hourly sums, which may be negative corrections, as hours, days or weeks; those without a file are left out."""
    length, start = ROLLUPS[grain]
    w = F.window(F.col("window_start"), length, startTime=start)
    merged = hourly.groupBy("ingestion_id", w.alias("_w")).agg(*[F.sum(c).cast("bigint").alias(c) for c in SUMS])
    return merged.filter("file_count > 0").select("ingestion_id", F.col("_w.start").alias("window_start"), *SUMS)


def hourly_parts(counted: DataFrame, most: int = 100_000) -> DataFrame:
    """Sums of file rows (``SUMS`` and a moment ``window_start``) by hour and all other columns, each task of what it reads.

    Nothing is shuffled, so the sums of an hour are those of its rows. A task holds up to ``most`` sums before it gives them.
    """
    length, start = ROLLUPS["hour"]
    hour = F.window(F.col("window_start"), length, startTime=start)
    rows = counted.withColumn("_w", hour).withColumn("window_start", F.col("_w.start")).drop("_w")
    names, sums = rows.columns, SUMS

    def summed(batches):
        import pyarrow as pa

        keys = [n for n in names if n not in sums]

        def merged(parts):
            found = pa.concat_tables(parts).group_by(keys, use_threads=False).aggregate([(c, "sum") for c in sums])
            return pa.table([found[n if n in keys else f"{n}_sum"] for n in names], names=names)

        parts, held = [], 0
        for batch in batches:
            parts.append(merged([pa.Table.from_batches([batch])]))
            held += parts[-1].num_rows
            if held >= most:
                parts = [merged(parts)]
                held = parts[0].num_rows
                if 2 * held >= most:
                    yield from parts[0].to_batches()
                    parts, held = [], 0
        if parts:
            yield from merged(parts).to_batches()

    return rows.mapInArrow(summed, rows.schema)


def tiered(state: DataFrame, as_of, detail_days: int = 30, aggregate_days: int = 365) -> tuple[DataFrame, DataFrame]:
    """(file rows of the last days, daily sums of the last year)."""
    now = as_column(as_of)
    detail = state.filter(F.col("processed_at") >= minus(now, days=detail_days))
    year = state.filter(F.col("processed_at") >= minus(now, days=aggregate_days))
    return detail, rollup(year, "day")
