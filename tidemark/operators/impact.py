"""What a refresh would cost, per ingestion, for any number of ingestions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.expressions import gigabytes, round_half_even, runs_per_month

# Price per GB, minutes per file, least minutes, GB assumed per unseen file.
COST_PER_GB = 0.25
MINUTES_PER_FILE = 2
MIN_MINUTES = 5
FALLBACK_GB_PER_FILE = 0.5
FALLBACK_FILES = 100
FALLBACK_WARNING = "Using estimated values - file discovery unavailable"

# Rates of the monthly estimate.
DBU_HOUR, STORAGE_GB, LIST_PER_1000, CLUSTER_DBUS = 0.40, 0.023, 0.005, 64


def _estimate(files: Column, gb: Column) -> dict[str, Column]:
    return {
        "estimated_data_size_gb": round_half_even(gb, 2),
        "estimated_cost_usd": round_half_even(gb * COST_PER_GB, 2),
        "estimated_duration_minutes": F.when(files == 0, F.lit(0)).otherwise(
            F.greatest(F.lit(MIN_MINUTES), files * MINUTES_PER_FILE)
        ).cast("bigint"),
    }


def _per_ingestion(sums: DataFrame, ingestions: DataFrame) -> DataFrame:
    """Estimates from per-ingestion sums; ingestions without any file stay, with zeros."""
    out = ingestions.select("ingestion_id").join(sums, "ingestion_id", "left")
    n = F.coalesce("_n", F.lit(0))
    gb = gigabytes(F.coalesce("_bytes", F.lit(0)))
    return out.select(
        "ingestion_id",
        n.alias("files_to_process"),
        F.coalesce("_skipped", F.lit(0)).cast("bigint").alias("files_skipped"),
        F.coalesce("_present", F.lit(0)).cast("bigint").alias("files_skipped_present"),
        *[c.alias(k) for k, c in _estimate(n, gb).items()],
        "oldest_file_date",
        "newest_file_date",
    )


def _sums(takes: Column) -> list[Column]:
    return [
        F.count_if(takes).alias("_n"),
        F.sum(F.when(takes, F.col("size_bytes"))).alias("_bytes"),
        F.min(F.when(takes, F.col("modified_at"))).alias("oldest_file_date"),
        F.max(F.when(takes, F.col("modified_at"))).alias("newest_file_date"),
    ]


def full_impact(manifest: DataFrame, ingestions: DataFrame) -> DataFrame:
    sums = manifest.groupBy("ingestion_id").agg(
        *_sums(F.lit(True)), F.lit(0).alias("_skipped"), F.lit(0).alias("_present")
    )
    return _per_ingestion(sums, ingestions)


def incremental_impact(manifest: DataFrame, state: DataFrame, ingestions: DataFrame) -> DataFrame:
    """New files only. ``files_skipped`` counts the ledger, ``files_skipped_present`` those still in storage.

    One join on the full file key gives all the counts.
    """
    done = state.filter(F.col("status").isin("SUCCESS", "SKIPPED")).select(
        "ingestion_id", F.col("file_path").alias("path"), F.lit(True).alias("_done")
    )
    listed = manifest.select("ingestion_id", "path", "size_bytes", "modified_at", F.lit(True).alias("_listed"))
    both = listed.join(done, ["ingestion_id", "path"], "full_outer")
    known = F.col("_done").isNotNull()
    sums = both.groupBy("ingestion_id").agg(
        *_sums(~known), F.count_if(known).alias("_skipped"), F.count_if(known & F.col("_listed").isNotNull()).alias("_present")
    )
    return _per_ingestion(sums, ingestions)


def fallback_impact(state: DataFrame, ingestions: DataFrame, mode: str) -> DataFrame:
    """Guess from the ledger alone, for when files cannot be listed."""
    done = (
        state.filter(F.col("status").isin("SUCCESS", "SKIPPED")).groupBy("ingestion_id").agg(F.count("*").alias("_done"))
    )
    out = ingestions.select("ingestion_id").join(done, "ingestion_id", "left")
    known = F.coalesce("_done", F.lit(0))
    if mode == "full":
        files = F.when(known > 0, known).otherwise(FALLBACK_FILES)
        skipped = F.lit(0)
    else:
        files = F.greatest(F.lit(10), F.floor(known * 0.05))
        skipped = known
    est = _estimate(files, files * FALLBACK_GB_PER_FILE)
    return out.select(
        "ingestion_id",
        files.cast("bigint").alias("files_to_process"),
        skipped.cast("bigint").alias("files_skipped"),
        *[c.alias(k) for k, c in est.items()],
        F.lit(FALLBACK_WARNING).alias("warning"),
    )


def with_warnings(impact: DataFrame, mode: str, strict: bool = False) -> DataFrame:
    """Adds the warning texts; ``strict`` adds the limits for very large operations."""
    cost, files = F.col("estimated_cost_usd"), F.col("files_to_process")
    found = []
    if mode == "full":
        found.append(F.concat(
            F.lit("This operation will reprocess "), files.cast("string"), F.lit(" files ("),
            F.col("estimated_data_size_gb").cast("string"), F.lit(" GB)"),
        ))
    found.append(F.when(cost > 10, F.format_string("Estimated cost: $%.2f", cost)))
    if strict:
        found += [
            F.when(cost > 100, F.format_string("HIGH COST OPERATION: Estimated $%.2f", cost)),
            F.when(files > 1000, F.format_string("LARGE OPERATION: Processing %d files", files)),
            F.when(cost > 500, F.lit("Run with dry_run=true first to review")),
        ]
    return impact.withColumn("warnings", F.array_compact(F.array(*found)))


def refresh_steps(ingestions: DataFrame, mode: str, auto_run: bool = True) -> DataFrame:
    """Ordered operations a refresh would perform, without performing them."""
    steps = ["table_dropped"] + (["processed_files_cleared"] if mode == "full" else []) + (
        ["run_triggered"] if auto_run else []
    )
    return ingestions.select("ingestion_id", F.posexplode(F.array(*[F.lit(s) for s in steps])).alias("step_no", "operation")).select(
        "ingestion_id", (F.col("step_no") + 1).alias("step_no"), "operation"
    )


def refresh_if(impact: DataFrame, condition: str) -> DataFrame:
    """Ingestions whose impact meets an SQL condition, e.g. ``files_to_process > 100``."""
    return impact.filter(F.expr(condition))


def monthly_cost(configs: DataFrame, stats: DataFrame) -> DataFrame:
    """Monthly cost per ingestion from its format, schedule and real file statistics.

    ``configs``: ingestion_id, format, frequency. ``stats``: ingestion_id, file_count, total_bytes.
    """
    joined = configs.join(stats, "ingestion_id", "left")
    files = F.coalesce("file_count", F.lit(0)).cast("double")
    gb = gigabytes(F.coalesce("total_bytes", F.lit(0)))
    minutes = gb * F.when(F.col("format").isin("json", "csv"), 1.0).otherwise(0.5)
    runs = runs_per_month(F.col("frequency"))
    per_run = minutes / 60.0 * CLUSTER_DBUS * DBU_HOUR
    compute, storage = per_run * runs, gb * runs * STORAGE_GB
    discovery = files * runs / 1000.0 * LIST_PER_1000
    return joined.select(
        "ingestion_id",
        runs.alias("runs_per_month"),
        round_half_even(gb, 2).alias("total_gb"),
        round_half_even(minutes, 2).alias("duration_minutes"),
        round_half_even(per_run, 2).alias("compute_per_run"),
        round_half_even(compute, 2).alias("compute_monthly"),
        round_half_even(storage, 2).alias("storage_monthly"),
        round_half_even(discovery, 4).alias("discovery_monthly"),
        round_half_even(compute + storage + discovery, 2).alias("total_monthly"),
    )


def extrapolated_minutes(manifest: DataFrame, sample: DataFrame, sample_seconds: float) -> DataFrame:
    """Duration for the whole manifest from the time a sample of its files took."""
    part = sample.agg(F.sum("size_bytes")).scalar()
    whole = manifest.agg(F.sum("size_bytes").alias("total_bytes")).withColumn("sample_bytes", part)
    minutes = F.col("total_bytes") / F.col("sample_bytes") * F.lit(sample_seconds) / 60.0
    return whole.withColumn("estimated_minutes", round_half_even(minutes, 6))


def timed_sample(spark, manifest: DataFrame, fmt: str, schema, options: dict | None = None, files: int = 10) -> dict:
    """Reads the first files in full and tells how many there were, their bytes and records, and the seconds it took.

    Records are counted by an observation of the read itself. ``extrapolated_minutes`` takes files and seconds.
    """
    import time

    from pyspark.sql import Observation

    from tidemark.sources.manifest import first_files
    from tidemark.sources.readers import scan

    sample = first_files(manifest.filter("size_bytes > 0"), files).select("path", "size_bytes").collect()
    if not sample:
        return {"files": 0, "bytes": 0, "records": 0, "seconds": 0.0}
    seen, clock = Observation(), time.perf_counter()
    rows = scan(spark, fmt, [r.path for r in sample], schema, options, literal_paths=True)
    rows.observe(seen, F.count(F.lit(1)).alias("records")).write.format("noop").mode("overwrite").save()
    took = time.perf_counter() - clock
    return {"files": len(sample), "bytes": sum(r.size_bytes for r in sample), "records": seen.get["records"], "seconds": took}
