"""Time rollups over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.operators.analytics import rollup


def stream_rollup(rows: DataFrame, grain: str, time: str, lateness: str, by: tuple[str, ...]) -> DataFrame:
    """Windowed sums that accept records late by up to ``lateness``; state of older windows is dropped."""
    return rollup(rows.withWatermark(time, lateness), grain, time, by)


def start_update_sink(agg: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Writes each batch's changed windows to its own folder; a repeated batch replaces itself.

    In append mode the newest windows would wait for a later watermark, so the sink takes updates and
    :func:`latest_windows` keeps the last one of each window.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch_id:010d}")

    return (
        agg.writeStream.outputMode("update").foreachBatch(batch)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def latest_windows(written: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    rest = [c for c in written.columns if c not in (*keys, "batch")]
    last = written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r"))
    return last.select(*keys, "_r.*")
