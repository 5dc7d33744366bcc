"""Which files a run takes: manifest against ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.expressions import BYTES_PER_GB, as_column, error_class, minus, next_retry_at
from tidemark.model import FAILED, PERMANENTLY_SKIPPED, PROCESSING, SKIPPED, SUCCESS
from tidemark.sources.manifest import modified_between

NEW, RETRY, CHANGED, UNCHANGED, IN_PROGRESS = "NEW", "RETRY", "CHANGED", "UNCHANGED", "IN_PROGRESS"


def _files(manifest: DataFrame) -> DataFrame:
    return manifest.withColumnRenamed("path", "file_path")


def new_files(manifest: DataFrame, state: DataFrame, statuses: tuple[str, ...] = (SUCCESS, SKIPPED)) -> DataFrame:
    """Manifest rows whose path the ledger does not hold as done."""
    # The current state holds a path once, so no distinct (and no shuffle for it) is needed here.
    done = state.filter(F.col("status").isin(*statuses)).select("ingestion_id", F.col("file_path").alias("path"))
    keys = ["ingestion_id", "path"] if "ingestion_id" in manifest.columns else ["path"]
    return manifest.join(done, keys, "left_anti")


def file_changed(etag: Column, old_etag: Column, modified: Column, old_modified: Column) -> Column:
    """ETags decide when both sides have one, else modification times, else the file is unchanged."""
    has_etags = (F.coalesce(etag, F.lit("")) != "") & (F.coalesce(old_etag, F.lit("")) != "")
    has_times = modified.isNotNull() & old_modified.isNotNull()
    return F.when(has_etags, etag != old_etag).when(has_times, modified > old_modified).otherwise(F.lit(False))


def classify(manifest: DataFrame, state: DataFrame) -> DataFrame:
    """Every manifest row with its action and the retry count a run would give it."""
    keys = ["ingestion_id", "file_path"] if "ingestion_id" in manifest.columns else ["file_path"]
    known = state.select(
        *keys,
        F.col("status").alias("_status"),
        F.col("file_etag").alias("_etag"),
        F.col("file_modified_at").alias("_modified"),
        F.col("retry_count").alias("_retries"),
        *([F.col("error_type").alias("previous_error")] if "error_type" in state.columns else []),
    )
    changed = file_changed(F.col("etag"), F.col("_etag"), F.col("modified_at"), F.col("_modified"))
    action = (
        F.when(F.col("_status").isNull(), NEW)
        .when(F.col("_status") == PROCESSING, IN_PROGRESS)
        .when(F.col("_status") == PERMANENTLY_SKIPPED, UNCHANGED)
        .when(F.col("_status") == SUCCESS, F.when(changed, CHANGED).otherwise(UNCHANGED))
        .otherwise(RETRY)
    )
    return (
        _files(manifest)
        .join(known, keys, "left")
        .withColumn("action", action)
        .withColumn(
            "next_retry_count",
            F.when(F.col("action") == NEW, 0)
            .when(F.col("action").isin(RETRY, CHANGED), F.col("_retries") + 1)
            .otherwise(F.col("_retries"))
            .cast("int"),
        )
        .withColumnRenamed("_status", "previous_status")
        .drop("_etag", "_modified", "_retries")
    )


def plan(manifest: DataFrame, state: DataFrame, mode: str = "changed") -> DataFrame:
    """Files to process. ``path`` drops every path already SUCCESS or SKIPPED; ``changed`` takes changed ones too."""
    sorted_out = classify(manifest, state)
    actions = {"path": (NEW, RETRY), "changed": (NEW, RETRY, CHANGED)}
    if mode not in actions:
        raise ValueError(f"unknown plan mode {mode!r}")
    skipped_before = F.coalesce(F.col("previous_status") == SKIPPED, F.lit(False))
    return sorted_out.filter(F.col("action").isin(*actions[mode]) & ~skipped_before)


def due(files: DataFrame, state: DataFrame, as_of, max_retries: int | None = 3, backoff: bool = False) -> DataFrame:
    """Drops failed files that must not be tried now: retries used up, hopeless until they change, or still to wait.

    A file whose size or time differs from the failed one's is a new try.
    """
    if max_retries is None:
        return files
    keys = ["ingestion_id", "file_path"] if "ingestion_id" in files.columns else ["file_path"]
    wait = F.coalesce(next_retry_at(F.col("processed_at"), F.col("retry_count")) > as_column(as_of), F.lit(False)) if backoff else F.lit(False)
    again = F.col("error_type").isNull() | error_class(F.col("error_type"))["retryable"]
    held = state.filter((F.col("status") == FAILED) & (~again | (F.col("retry_count") >= max_retries) | wait)).select(
        *keys, F.col("file_size_bytes").alias("size_bytes"), F.col("file_modified_at").alias("_failed_modified")
    )
    same = [files[k] == held[k] for k in keys] + [files["size_bytes"].eqNullSafe(held["size_bytes"])]
    same.append(files["modified_at"].cast("timestamp").eqNullSafe(held["_failed_modified"].cast("timestamp")))
    return files.join(held, same, "left_anti")


def prefilter(
    files: DataFrame,
    as_of=None,
    max_size_gb: float | None = None,
    exclude: str | None = None,
    max_age_days: int | None = None,
) -> DataFrame:
    """Adds ``skip_reason``: too large, excluded by name, too old, or NULL for files to process."""
    reason = F.lit(None).cast("string")
    if max_age_days is not None:
        reason = F.when(F.col("modified_at") < minus(as_column(as_of), days=max_age_days), "too_old").otherwise(reason)
    path = "file_path" if "file_path" in files.columns else "path"
    if exclude is not None:
        reason = F.when(F.col(path).rlike(exclude), "excluded").otherwise(reason)
    if max_size_gb is not None:
        reason = F.when(F.col("size_bytes") > max_size_gb * BYTES_PER_GB, "too_large").otherwise(reason)
    return files.withColumn("skip_reason", reason)


def route_by_size(files: DataFrame, max_size_gb: float = 5.0) -> DataFrame:
    """``route``: process or skip; splittable formats need no other treatment for large files."""
    return files.withColumn(
        "route", F.when(F.col("size_bytes") <= max_size_gb * BYTES_PER_GB, "process").otherwise("skip")
    )


def backfill(manifest: DataFrame, state: DataFrame, mode: str, start=None, end=None, activated_at=None) -> DataFrame:
    """Files of a backfill: ``new_only`` since activation, ``include_existing`` or ``from_date``."""
    if mode == "new_only":
        manifest = modified_between(manifest, activated_at)
    elif mode == "from_date":
        manifest = modified_between(manifest, start, end)
    elif mode != "include_existing":
        raise ValueError(f"unknown backfill mode {mode!r}")
    return new_files(manifest, state)
