"""Refresh: drop the table, optionally forget the history, run again."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.model import IngestionConfig
from tidemark.operators import impact as impacts, ledger, writer
from tidemark.operators.state_store import StateStore
from tidemark.operators.upsert import drop_published
from tidemark.plans.ingest import published_location, published_name, run_ingestion
from tidemark.sources import manifest as manifests
from tidemark.workspace import delete_path

OPERATION = "step_no int, operation string, status string, detail string"


def ingestion_row(spark: SparkSession, config: IngestionConfig) -> DataFrame:
    return spark.createDataFrame([(config.ingestion_id,)], "ingestion_id string")


def impact(spark: SparkSession, config: IngestionConfig, store: StateStore, mode: str, manifest: DataFrame | None = None) -> DataFrame:
    """Impact row with warnings; falls back to the ledger when the source cannot be listed."""
    one = ingestion_row(spark, config)
    state = store.state(config.ingestion_id)
    try:
        if manifest is None:
            manifest = manifests.discover(spark, config.source_path, pattern=config.file_pattern, match=config.match)
        manifest = manifest.withColumn("ingestion_id", F.lit(config.ingestion_id))
        found = impacts.full_impact(manifest, one) if mode == "full" else impacts.incremental_impact(manifest, state, one)
        row = impacts.with_warnings(found, mode)
        row.first()
        return row
    except Exception as e:
        if not _listing_failed(e):
            raise
        return impacts.with_warnings(impacts.fallback_impact(state, one, mode), mode)


def _listing_failed(e: Exception) -> bool:
    """Whether the storage listing, and not the query on it, is what failed."""
    text = str(e)
    return any(s in text for s in ("tidemark_listing", "PYTHON_DATA_SOURCE", "FileNotFoundError", "OSError", "ArrowInvalid"))


def refresh(
    spark: SparkSession,
    config: IngestionConfig,
    store: StateStore,
    mode: str = "new_only",
    as_of: datetime | None = None,
    run_id: str | None = None,
    auto_run: bool = True,
    dry_run: bool = False,
    start=None,
    end=None,
    condition: str | None = None,
) -> dict:
    """Drops the table, clears history when ``mode`` is full, runs. Stops at the first step that fails.

    ``start``/``end`` narrow the run to files modified in that range; ``condition`` is an SQL test on the
    impact row, and nothing happens when it does not hold.
    """
    if mode not in ("full", "new_only"):
        raise ValueError(f"unknown refresh mode {mode!r}")
    at = as_of or datetime.now(timezone.utc)
    estimate = impact(spark, config, store, mode)
    steps = [r.operation for r in impacts.refresh_steps(ingestion_row(spark, config), mode, auto_run).orderBy("step_no").collect()]
    summary = {"mode": mode, "ingestion_id": config.ingestion_id, "impact": estimate.first().asDict(), "run": None}
    if dry_run:
        return {**summary, "status": "dry_run", "operations": [(s, "planned", None) for s in steps]}
    if condition is not None and impacts.refresh_if(estimate, condition).isEmpty():
        return {**summary, "status": "condition_not_met", "operations": []}
    done: list[tuple[str, str, object]] = []
    for step in steps:
        try:
            if step == "table_dropped":
                detail = drop_target(spark, config)
            elif step == "processed_files_cleared":
                detail = clear(store, config.ingestion_id, at)
            else:
                manifest = None
                if start is not None or end is not None:
                    found = manifests.discover(spark, config.source_path, pattern=config.file_pattern, match=config.match)
                    manifest = manifests.modified_between(found, start, end)
                detail = summary["run"] = run_ingestion(spark, config, store, at, run_id, manifest)
            done.append((step, "success", detail))
        except Exception as e:
            done.append((step, "failed", f"{type(e).__name__}: {e}"))
            return {**summary, "status": "partial_failure", "operations": done}
    return {**summary, "status": "accepted", "operations": done}


def drop_target(spark: SparkSession, config: IngestionConfig) -> dict:
    """Drops the table; the files of an external one go with it, so a new table starts empty."""
    if config.write_mode != "append" and writer.table_exists(spark, config.table):
        drop_published(spark, published_name(config), published_location(spark, config))
    places = [writer.table_location(spark, name) for name in writer.generations(spark, config.table)]
    dropped = writer.drop_table(spark, config.table)
    if config.location:
        for place in places:
            delete_path(spark, place)
    return dropped


def clear(store: StateStore, ingestion_id: str, at: datetime, path_like: str | None = None) -> int:
    """Forgets the files of an ingestion, or those whose path matches; returns how many."""
    token = f"clear-{ingestion_id}-{at:%Y%m%dT%H%M%S%f}"
    events = ledger.clear_history(store.state(ingestion_id), F.lit(at), path_like)
    store.append("ledger", ingestion_id, token, "clear", events)
    return store.events(ingestion_id, token).count()


def steps_frame(spark: SparkSession, result: dict) -> DataFrame:
    rows = [(i + 1, s, st, None if d is None else str(d)) for i, (s, st, d) in enumerate(result["operations"])]
    return spark.createDataFrame(rows, OPERATION)
