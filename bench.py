"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Times are wall-clock seconds of a full evaluation (no-op sink). Ingestion is measured as whole runs, listing
and commit included: the landed days as one file each, and 10 records per file for many small files.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from registry import QUERIES  # noqa: E402
from registry.core import Inputs  # noqa: E402
from tidemark.model import LEDGER_SCHEMA, IngestionConfig  # noqa: E402
from tidemark.operators import analytics as A, planning as B  # noqa: E402
from tidemark.operators.state_store import StateStore  # noqa: E402
from tidemark.plans.ingest import run_ingestion  # noqa: E402
from tidemark.session import builder  # noqa: E402
from tidemark.sources import manifest as M  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "b2_new_files", "b4_classify", "b4_plan_changed_mode", "b5_current_state", "b9_prefilter", "h5_health",
    "h6_slowest_files", "h7_error_patterns", "h8_daily_volume", "h10_retry_analysis", "h11_run_progress",
    "h14_trend", "h15_rollup_day", "q6_size_spikes", "q8_duplicate_check", "r5_full_impact", "r6_incremental_impact",
    "k1_monthly_cost", "i16_upsert", "i17_merge_preview", "i20_rescued_data", "p5_malformed_records", "a10_notifications",
]


def evaluate(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(fn) -> float:
    t = time.perf_counter()
    fn()
    return round(time.perf_counter() - t, 3)


def landed_events(c: Inputs):
    return c.table("events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), "user_id", "event_type", "value")


def ingest(c: Inputs, name: str, root: str) -> dict:
    store = StateStore(c.spark, c.scratch("state"))
    config = IngestionConfig(name, root, f"bench_{name}", location=c.scratch("table"))
    out = {}
    took = timed(lambda: out.update(r=run_ingestion(c.spark, config, store)))
    r = out["r"]
    again = timed(lambda: run_ingestion(c.spark, config, store))
    return {"sec": took, "rerun_sec": again, "files": r.success, "records": r.records,
            "files_per_min": round(r.success / took * 60), "records_per_sec": round(r.records / took)}


def ledger_of_a_year(c: Inputs) -> StateStore:
    """About 3.6 million files at sf0.1 in a store: every processing seen six times, as six weeks of history.

    Five of them are folded, the last lies in deltas of one run a day, as it does before the next fold.
    """
    store = StateStore(c.spark, c.scratch("year"), fold_after=None)
    have = set(c.events_log.columns)
    rows = c.events_log.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in LEDGER_SCHEMA.fields])

    def week(*numbers):
        copies = rows.withColumn("week", F.explode(F.array(*[F.lit(n) for n in numbers])))
        return copies.withColumn("file_path", F.concat("file_path", F.lit("."), F.col("week").cast("string"))).drop("week")

    store.append("ledger", "all", "weeks", "done", week(1, 2, 3, 4, 5))
    store.fold()
    for day in range(7):
        store.append("ledger", "all", f"day_{day}", "done", week(6).filter(f"seq = {day + 1}"))
    return store


def main() -> None:
    spark = (
        builder("bench", f"local[{CPUS}]", int(CPUS))
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    c = Inputs(spark, SF_DIR)
    evaluate(c.table("orders").groupBy("o_orderstatus").count())
    queries: dict[str, float] = {}
    queries["state_store_built"] = timed(lambda: c.store)
    for name in HEADLINE:
        queries[name] = timed(lambda: evaluate(QUERIES[name](spark, SF_DIR)))

    # Starts Python workers and compiles the run's plans, on other data, outside the measured runs.
    root = c.scratch("warm")
    c.table("orders").drop("o_orderdate").write.partitionBy("o_orderpriority").json(root)
    ingest(c, "warm", root)
    root = c.scratch("days")
    landed_events(c).withColumn("day", F.to_date("ts")).write.partitionBy("day").json(root)
    days = ingest(c, "days", root)
    root = c.scratch("small")
    landed_events(c).repartition(int(CPUS)).write.option("maxRecordsPerFile", 10).json(root)
    small = ingest(c, "small", root)
    queries["ingest_days"], queries["ingest_small_files"] = days["sec"], small["sec"]
    queries["ingest_small_files_rerun"] = small["rerun_sec"]

    manifest = M.list_files(spark, root).withColumn("ingestion_id", F.lit("small"))
    state = manifest.select(
        "ingestion_id", F.col("path").alias("file_path"), F.lit("SUCCESS").alias("status"),
        F.col("etag").alias("file_etag"), F.col("modified_at").alias("file_modified_at"), F.lit(0).alias("retry_count"),
    )
    queries["plan_listed_files"] = timed(lambda: evaluate(B.classify(manifest, state)))

    store = ledger_of_a_year(c)
    queries["ledger_one_ingestion"] = timed(lambda: evaluate(store.state().filter("ingestion_id = 'ing7'")))
    queries["ledger_failed_30d"] = timed(lambda: evaluate(A.failures(store.recent("2001-07-16 00:00:00"), "2001-08-15 00:00:00", 30)))
    store.fold()
    queries["ledger_one_ingestion_folded"] = timed(lambda: evaluate(store.state().filter("ingestion_id = 'ing7'")))
    queries["ledger_one_file"] = timed(lambda: evaluate(store.file("ing7", "s3a://landing/ing7/part_7.json.1")))

    total = round(sum(queries.values()), 3)
    print(json.dumps({
        "metric": "headline queries and ingestion runs, total", "value": total, "unit": "sec", "queries": queries,
        "sf": SF_DIR, "cpus": int(CPUS), "ingest_days": days, "ingest_small_files": small,
    }))


if __name__ == "__main__":
    main()
