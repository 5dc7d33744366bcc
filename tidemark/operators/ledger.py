"""The per-file ledger: an append-only table of state events and the state derived from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.expressions import as_column, error_class, first_per_key, minus
from tidemark.model import (
    CLEARED, FAILED, LEDGER_SCHEMA, PENDING, PERMANENTLY_SKIPPED, PROCESSING, SCHEMA_ERROR, SKIPPED, SUCCESS,
)

KEY = ("ingestion_id", "file_path")


def current_state(events: DataFrame, keys: tuple[str, ...] = KEY, order: tuple[str, ...] = ("event_time", "seq")) -> DataFrame:
    """Latest event per file.

    Spark keeps one row per file and task before the shuffle (the rank filter becomes a group limit), so a
    file with very many events is no burden, and columns the caller drops are never shuffled.
    """
    latest = first_per_key(events, keys, order)
    return latest.filter(F.col("status") != CLEARED)


def recent_state(events: DataFrame, since: Column, keys: tuple[str, ...] = KEY, order: tuple[str, ...] = ("event_time", "seq")) -> DataFrame:
    """Current state of the files with an event from then on: all that were processed since, and perhaps others.

    An event is never older than the processing it tells of, so a report on a time window gets the same rows as
    from the whole state, but only that window of the ledger is read, ranked and shuffled.
    """
    return current_state(events.filter(F.col("event_time") >= since), keys, order)


def processed_paths(state: DataFrame, statuses: tuple[str, ...] = (SUCCESS, SKIPPED)) -> DataFrame:
    """Distinct paths that need no further work."""
    return state.filter(F.col("status").isin(*statuses)).select(*KEY).distinct()


def retryable(state: DataFrame, max_retries: int = 3) -> DataFrame:
    return state.filter((F.col("status") == FAILED) & (F.col("retry_count") < max_retries))


def stale(state: DataFrame, as_of, hours: int = 1) -> DataFrame:
    """Files in flight since before the threshold, most likely left by a lost job."""
    return state.filter(
        (F.col("status") == PROCESSING) & (F.col("processing_started_at") < minus(as_column(as_of), hours=hours))
    )


def stale_reset(state: DataFrame, as_of, hours: int = 2) -> DataFrame:
    """Events that return stale files to PENDING."""
    return transition(
        stale(state, as_of, hours),
        as_of,
        PENDING,
        error_message=F.concat(
            F.lit("Reset from stale PROCESSING state (started "),
            F.date_format("processing_started_at", "yyyy-MM-dd HH:mm:ss"),
            F.lit(")"),
        ),
    )


def transition(state: DataFrame, as_of, status: str | Column, **changes) -> DataFrame:
    """New events for the given files: same rows, new status, time and changed columns."""
    new = {"status": F.lit(status) if isinstance(status, str) else status, **changes}
    new["event_time"] = as_column(as_of).cast(state.schema["event_time"].dataType)
    new["seq"] = F.col("seq") + F.lit(1)
    return state.withColumns({k: v if isinstance(v, Column) else F.lit(v) for k, v in new.items()}).select(*state.columns)


def clear_history(state: DataFrame, as_of, path_like: str | None = None) -> DataFrame:
    """Tombstones for all files, or for the paths matching an SQL LIKE pattern."""
    hit = state if path_like is None else state.filter(F.col("file_path").like(path_like))
    return transition(hit, as_of, CLEARED)


def without_history(state: DataFrame, path_like: str) -> DataFrame:
    """The state after a selective clear."""
    return state.filter(~F.col("file_path").like(path_like))


def read_before_version(state: DataFrame, version: int | None = None, versions: DataFrame | None = None) -> DataFrame:
    """Loaded files whose schema version is older than the given or the latest one."""
    done = state.filter(F.col("status") == SUCCESS)
    if versions is None:
        return done.filter(F.coalesce(F.col("schema_version"), F.lit(0)) < version)
    latest = versions.groupBy("ingestion_id").agg(F.max("version").alias("_latest"))
    return (
        done.join(latest, "ingestion_id")
        .filter(F.coalesce(F.col("schema_version"), F.lit(0)) < F.col("_latest"))
        .drop("_latest")
    )


# What each decision on a schema change does to the files that wait for it.
APPROVAL_STATUS = {"accept": PENDING, "merge": PENDING, "reject": PERMANENTLY_SKIPPED}


def approve_schema(state: DataFrame, action: str, as_of) -> DataFrame:
    """Events for the files a schema change held back."""
    if action not in APPROVAL_STATUS:
        raise ValueError(f"Invalid action: {action}")
    waiting = state.filter((F.col("status") == SKIPPED) & (F.col("error_type") == SCHEMA_ERROR))
    if action == "reject":
        return transition(waiting, as_of, PERMANENTLY_SKIPPED, error_message="Schema change rejected by user")
    return transition(waiting, as_of, PENDING)


def with_error_class(state: DataFrame) -> DataFrame:
    """Failed and skipped files with their error class and what to do about it."""
    bad = state.filter(F.col("status").isin(FAILED, SKIPPED) & F.col("error_type").isNotNull())
    return bad.withColumn("_c", error_class(F.col("error_type"))).select(*state.columns, "_c.*")


def finished_events(
    files: DataFrame, processed_at: Column, verdict: Column, records: Column, error_type: Column, message: Column
) -> DataFrame:
    """Terminal events of in-flight files."""
    ok = verdict == SUCCESS
    return files.withColumns({
        "status": verdict,
        "processed_at": processed_at,
        "records_ingested": F.when(ok, F.coalesce(records, F.lit(0)).cast("bigint")),
        "bytes_read": F.when(ok, F.coalesce(F.col("file_size_bytes"), F.lit(0))),
        "processing_duration_ms": (
            F.unix_millis(processed_at) - F.unix_millis("processing_started_at")
        ),
        "error_type": F.when(~ok, error_type),
        "error_message": F.when(~ok, message),
        "event_time": processed_at,
        "seq": F.col("seq") + F.lit(1),
    }).select(*[f.name for f in LEDGER_SCHEMA.fields])


def with_age(state: DataFrame, as_of, retention_days: int = 90) -> DataFrame:
    """Adds ``archived``: processed before the horizon. Unprocessed files are never old."""
    old = F.col("processed_at") < minus(as_column(as_of), days=retention_days)
    return state.withColumn("archived", F.coalesce(old, F.lit(False)))


def split_by_age(state: DataFrame, as_of, retention_days: int = 90) -> tuple[DataFrame, DataFrame]:
    """(kept, archived) rows."""
    aged = with_age(state, as_of, retention_days)
    return aged.filter(~F.col("archived")).drop("archived"), aged.filter("archived").drop("archived")
