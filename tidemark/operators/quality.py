"""Quality rules and alerts as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.expressions import as_column
from tidemark.model import FAILED, SUCCESS


def low_row_count(runs: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Runs that brought fewer records than the ingestion's threshold."""
    return runs.join(thresholds.select("ingestion_id", "row_count_threshold"), "ingestion_id").filter(
        F.col("records_ingested") < F.col("row_count_threshold")
    ).select("run_id", "ingestion_id", "records_ingested", "row_count_threshold")


def high_failure_rate(state: DataFrame, max_rate: float, by: str = "run_id") -> DataFrame:
    """Groups whose share of failed files exceeds the limit."""
    sums = state.filter(F.col("status").isin(SUCCESS, FAILED)).groupBy(by).agg(
        F.count_if(F.col("status") == FAILED).alias("failed"), F.count_if(F.col("status") == SUCCESS).alias("success")
    )
    rate = F.col("failed") / (F.col("failed") + F.col("success"))
    return sums.withColumn("failure_rate", rate).filter(rate > max_rate)


def sla_breaches(state: DataFrame, max_seconds: float) -> DataFrame:
    return state.filter(F.col("processing_duration_ms") > max_seconds * 1000).select(
        "ingestion_id", "run_id", "file_path", "processed_at", "processing_duration_ms"
    )


def silent_ingestions(manifest: DataFrame, as_of, days: int = 2, ingestions: DataFrame | None = None) -> DataFrame:
    """Ingestions whose newest file is older than the limit, and those of ``ingestions`` that never got a file."""
    newest = manifest.groupBy("ingestion_id").agg(F.max("modified_at").alias("newest_file"))
    if ingestions is not None:
        newest = ingestions.select("ingestion_id").distinct().join(newest, "ingestion_id", "left")
    idle = F.date_diff(F.to_date(as_column(as_of)), F.to_date("newest_file"))
    return newest.withColumn("idle_days", idle).filter((idle > days) | F.col("newest_file").isNull())


def arrival_gaps(manifest: DataFrame, days: int = 2, time: str = "modified_at") -> DataFrame:
    """Stretches without files. The window runs over distinct days, not over files."""
    per_day = manifest.select("ingestion_id", F.to_date(time).alias("day")).distinct()
    w = Window.partitionBy("ingestion_id").orderBy("day")
    gap = F.date_diff(F.col("day"), F.col("previous_day"))
    return (
        per_day.withColumn("previous_day", F.lag("day").over(w))
        .withColumn("gap_days", gap)
        .filter(F.col("gap_days") > days)
    )


def size_spikes(manifest: DataFrame, factor: float = 5.0, days: int = 7, time: str = "modified_at", size: str = "size_bytes") -> DataFrame:
    """Days whose average file size exceeds the mean of the days before by the factor.

    Files are summed per day first, so the window holds days.
    """
    per_day = manifest.groupBy("ingestion_id", F.to_date(time).alias("day")).agg(
        F.sum(size).cast("bigint").alias("_bytes"), F.count("*").alias("file_count")
    ).withColumn("avg_bytes", F.col("_bytes") / F.col("file_count"))
    w = Window.partitionBy("ingestion_id").orderBy("day").rowsBetween(-days, -1)
    trailing = F.sum("_bytes").over(w) / F.sum("file_count").over(w)
    return (
        per_day.withColumn("trailing_avg_bytes", trailing)
        .withColumn("ratio", F.round(F.col("avg_bytes") / F.col("trailing_avg_bytes"), 6))
        .filter(F.col("ratio") > factor)
        .drop("_bytes")
    )


def null_rule(profile: DataFrame, max_pct: float) -> DataFrame:
    """Columns of a null profile above the limit."""
    return profile.filter(F.col("null_pct") > max_pct)


def duplicate_check(df: DataFrame, key: str) -> DataFrame:
    """Rows, distinct keys and key range.

    Grouped by key first: Spark combines per task before the shuffle, so a hot key costs one row per task.
    """
    per_key = df.groupBy(key).agg(F.count("*").alias("_n"))
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("row_count"),
        F.count(key).alias("distinct_count"),
        F.coalesce(F.sum(F.when(F.col(key).isNotNull(), F.col("_n") - 1)), F.lit(0)).cast("bigint").alias("duplicate_count"),
        F.min(key).alias("min_key"),
        F.max(key).alias("max_key"),
    )


def union_alerts(*alerts: DataFrame) -> DataFrame:
    """Alerts of several rules as (rule, severity, ingestion_id, message) rows."""
    rows = [a.select("rule", "severity", "ingestion_id", "message") for a in alerts]
    return reduce(lambda a, b: a.unionByName(b), rows)
