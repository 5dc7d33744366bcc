"""Run history, ledger analytics, quality rules, impact and cost."""

from pyspark.sql import functions as F

from registry.core import LEDGER_NOW, query
from tidemark.operators import analytics as A, impact as R, quality as Q, preview as P
from tidemark.operators.state_store import StateStore
from tidemark.plans.ingest import run_metrics
from tidemark.sources import manifest as M

NOW = f"TIMESTAMP '{LEDGER_NOW}'"
GB = "1024.0 / 1024.0 / 1024.0"
S, ML, MS = ("state",), ("manifest", "ledger"), ("manifest", "sources")


@query("h1_run_history", f"""
SELECT run_id, ingestion_id, started_at, status FROM (SELECT * FROM runs
  WHERE started_at >= {NOW} - INTERVAL 30 DAY ORDER BY started_at DESC, run_id LIMIT 100) t""", ("runs",))
def _(c):
    return A.run_history(c.runs, LEDGER_NOW).select("run_id", "ingestion_id", "started_at", "status")


@query("h1_runs_of_active", """
SELECT run_id, r.ingestion_id, r.status FROM runs r JOIN ingestions i ON i.ingestion_id = r.ingestion_id
WHERE i.status = 'active'""", ("runs", "ingestions"))
def _(c):
    return A.runs_of_active(c.runs, c.ingestions).select("run_id", "ingestion_id", "status")


@query("h1_runs_of_tenant", """
SELECT run_id, r.ingestion_id, r.status FROM runs r JOIN ingestions i ON i.ingestion_id = r.ingestion_id
WHERE i.status = 'active' AND tenant_id = 'tenant1'""", ("runs", "ingestions"))
def _(c):
    return A.runs_of_active(c.runs, c.ingestions, "tenant1").select("run_id", "ingestion_id", "status")


@query("h1_run_by_id", "SELECT run_id, ingestion_id, status FROM runs WHERE run_id = 'run_42'", ("runs",))
def _(c):
    return A.run_by_id(c.runs, "run_42").select("run_id", "ingestion_id", "status")


@query("h3_last_run", """
SELECT ingestion_id, run_id AS last_run_id, started_at AS last_run_at FROM (
  SELECT *, row_number() OVER (PARTITION BY ingestion_id ORDER BY started_at DESC, run_id DESC) AS rn FROM runs) t
WHERE rn = 1""", ("runs",))
def _(c):
    return A.last_run(c.runs)


HEALTH = f"""
SELECT ingestion_id, count(*) FILTER (WHERE status = 'SUCCESS') AS success_count,
  count(*) FILTER (WHERE status = 'FAILED') AS failed_count, count(*) FILTER (WHERE status = 'SKIPPED') AS skipped_count,
  avg(processing_duration_ms) AS avg_duration_ms, CAST(coalesce(sum(records_ingested), 0) AS bigint) AS total_records,
  round(coalesce(sum(bytes_read), 0) / {GB}, 6) AS total_gb, max(processed_at) AS last_processed_at
FROM state WHERE processed_at > {NOW} - INTERVAL %s GROUP BY ingestion_id"""


@query("h5_health", HEALTH % "24 HOUR", S)
def _(c):
    return A.health(c.recent(LEDGER_NOW, 1), LEDGER_NOW)


@query("h5_health_year", HEALTH % "8760 HOUR", S)
def _(c):
    return A.health(c.recent(LEDGER_NOW, 365), LEDGER_NOW, hours=8760)


@query("h6_slowest_files", f"""
SELECT file_path, processing_duration_ms / 1000.0 AS duration_seconds, records_ingested,
  bytes_read / 1024.0 / 1024.0 AS size_mb, CAST(records_ingested AS double) / (processing_duration_ms / 1000.0) AS records_per_second
FROM (SELECT * FROM state WHERE status = 'SUCCESS' AND processed_at > {NOW} - INTERVAL 700 DAY
  ORDER BY processing_duration_ms DESC, ingestion_id, file_path LIMIT 20) t""", S)
def _(c):
    return A.slowest_files(c.recent(LEDGER_NOW, 700), LEDGER_NOW, days=700)


@query("h7_error_patterns", f"""
SELECT error_type, count(*) AS error_count, count(DISTINCT ingestion_id) AS affected_ingestions,
  count(DISTINCT left(error_message, 100)) AS distinct_messages
FROM state WHERE status = 'FAILED' AND processed_at > {NOW} - INTERVAL 365 DAY GROUP BY 1""", S)
def _(c):
    return A.error_patterns(c.recent(LEDGER_NOW, 365), LEDGER_NOW, days=365)


@query("h7_error_messages", f"""
SELECT error_type, left(error_message, 100) AS message, count(*) AS error_count
FROM state WHERE status = 'FAILED' AND processed_at > {NOW} - INTERVAL 365 DAY GROUP BY 1, 2""", S)
def _(c):
    return A.error_messages(c.recent(LEDGER_NOW, 365), LEDGER_NOW, days=365)


@query("h8_daily_volume", f"""
SELECT CAST(processed_at AS date) AS date, count(*) AS files_processed,
  CAST(sum(records_ingested) AS bigint) AS total_records, round(sum(bytes_read) / {GB}, 6) AS total_gb,
  avg(processing_duration_ms) / 1000.0 AS avg_duration_seconds
FROM state WHERE status = 'SUCCESS' GROUP BY 1 ORDER BY 1 DESC LIMIT 30""", S)
def _(c):
    return A.daily_volume(c.state)


@query("h9_backlog", """
SELECT s.ingestion_id, name AS ingestion_name, count(*) AS pending_count, min(discovered_at) AS oldest_discovered
FROM state s JOIN ingestions i ON i.ingestion_id = s.ingestion_id WHERE s.status = 'PENDING' GROUP BY 1, 2""",
       ("state", "ingestions"))
def _(c):
    return A.backlog(c.state, c.ingestions)


@query("h10_retry_analysis", """
SELECT ingestion_id, retry_count, count(*) AS file_count, count(*) FILTER (WHERE status = 'SUCCESS') AS eventually_succeeded,
  count(*) FILTER (WHERE status = 'FAILED') AS still_failing FROM state WHERE retry_count > 0 GROUP BY 1, 2""", S)
def _(c):
    return A.retry_analysis(c.state)


@query("h11_run_progress", """
SELECT run_id, count(*) AS total_files, count(*) FILTER (WHERE status = 'SUCCESS') AS success,
  count(*) FILTER (WHERE status = 'FAILED') AS failed, count(*) FILTER (WHERE status = 'PROCESSING') AS processing,
  count(*) FILTER (WHERE status = 'PENDING') AS pending, CAST(coalesce(sum(records_ingested), 0) AS bigint) AS total_records,
  CAST(coalesce(sum(bytes_read), 0) AS bigint) AS total_bytes,
  CAST(count(*) FILTER (WHERE status IN ('SUCCESS', 'FAILED')) AS double) / count(*) * 100.0 AS completion_percentage
FROM state GROUP BY 1""", S)
def _(c):
    return A.run_progress(c.state)


@query("h12_find_file", """
SELECT ingestion_id, file_path, status, error_type, error_message, retry_count, processing_started_at, processed_at,
  processing_duration_ms / 1000.0 AS duration_seconds, records_ingested, bytes_read
FROM state WHERE file_path = 's3a://landing/ing79/part_1616.json'""", S)
def _(c):
    return A.find_file(c.state, "s3a://landing/ing79/part_1616.json")


@query("h12_failures", f"""
SELECT ingestion_id, file_path, status, error_type, error_message, retry_count, processing_started_at, processed_at,
  processing_duration_ms / 1000.0 AS duration_seconds, records_ingested, bytes_read
FROM state WHERE status = 'FAILED' AND processed_at > {NOW} - INTERVAL 365 DAY""", S)
def _(c):
    return A.failures(c.recent(LEDGER_NOW, 365), LEDGER_NOW, days=365)


@query("h13_dashboard", """
WITH w AS (SELECT status, bytes_read, processed_at > TIMESTAMP '2000-06-01' - INTERVAL 24 HOUR AND processed_at <= TIMESTAMP '2000-06-01' AS d,
    processed_at > TIMESTAMP '2000-06-01' - INTERVAL 48 HOUR AND processed_at <= TIMESTAMP '2000-06-01' - INTERVAL 24 HOUR AS p FROM state),
  k AS (SELECT count(*) FILTER (WHERE d AND status = 'SUCCESS') AS f1, count(*) FILTER (WHERE p AND status = 'SUCCESS') AS f0,
    CAST(coalesce(sum(bytes_read) FILTER (WHERE d AND status = 'SUCCESS'), 0) AS bigint) AS b1,
    CAST(coalesce(sum(bytes_read) FILTER (WHERE p AND status = 'SUCCESS'), 0) AS bigint) AS b0,
    count(*) FILTER (WHERE d AND status IN ('SUCCESS', 'FAILED')) AS ended FROM w)
SELECT (SELECT count(*) FROM ingestions WHERE status = 'active') AS active_ingestions, f1 AS files_24h, f0 AS files_previous_24h,
  b1 AS bytes_24h, b0 AS bytes_previous_24h, round(f1 * 100.0 / nullif(ended, 0), 6) AS success_rate,
  round((f1 - f0) * 100.0 / nullif(f0, 0), 6) AS files_change_pct FROM k""".replace("WITH w AS", ", w AS", 1),
       ("state", "ingestions"))
def _(c):
    return A.dashboard(c.recent("2000-06-01 00:00:00", 2), c.ingestions, "2000-06-01 00:00:00")


@query("h14_trend", """
, days AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2000-06-24', TIMESTAMP '2000-06-30', INTERVAL 1 DAY)) AS date) AS day),
p AS (SELECT ingestion_id, CAST(processed_at AS date) AS day, count(*) FILTER (WHERE status = 'SUCCESS') AS files,
    count(*) FILTER (WHERE status = 'FAILED') AS failed_files,
    count(DISTINCT CASE WHEN status = 'FAILED' THEN run_id END) AS failed_runs,
    CAST(coalesce(sum(records_ingested), 0) AS bigint) AS records, avg(processing_duration_ms) AS avg_duration_ms
  FROM state WHERE processed_at IS NOT NULL GROUP BY 1, 2)
SELECT i.ingestion_id, d.day, coalesce(files, 0) AS files, coalesce(failed_files, 0) AS failed_files,
  coalesce(failed_runs, 0) AS failed_runs, coalesce(records, 0) AS records, avg_duration_ms
FROM ingestions i CROSS JOIN days d LEFT JOIN p ON p.ingestion_id = i.ingestion_id AND p.day = d.day""",
       ("state", "ingestions"))
def _(c):
    return A.trend(c.recent("2000-06-30 00:00:00", 7), c.ingestions, "2000-06-30 00:00:00")


def _rollup_sql(grain: str, rows: str = "state WHERE processed_at IS NOT NULL") -> str:
    return f"""
SELECT ingestion_id, CAST(date_trunc('{grain}', processed_at) AS timestamp) AS window_start, count(*) AS file_count,
  count(*) FILTER (WHERE status = 'FAILED') AS failed_count, CAST(coalesce(sum(records_ingested), 0) AS bigint) AS records,
  CAST(coalesce(sum(bytes_read), 0) AS bigint) AS bytes FROM {rows} GROUP BY 1, 2"""


def _register_rollup(grain: str) -> None:
    @query(f"h15_rollup_{grain}", _rollup_sql(grain), S)
    def _(c):
        return A.rollup(c.state, grain)

    @query(f"h15_stored_{grain}", _rollup_sql(grain), S)
    def _(c):
        """From the hourly sums kept with the folded state, corrected by two deltas."""
        return c.store.rolled(grain).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


for _grain in A.ROLLUPS:
    _register_rollup(_grain)


@query("h17_tiered_daily", _rollup_sql("day", f"state WHERE processed_at >= {NOW} - INTERVAL 365 DAY"), S)
def _(c):
    return A.tiered(c.state, LEDGER_NOW)[1]


@query("h17_tiered_detail", f"""
SELECT ingestion_id, file_path, status, processed_at FROM state WHERE processed_at >= {NOW} - INTERVAL 300 DAY""", S)
def _(c):
    return A.tiered(c.state, LEDGER_NOW, detail_days=300)[0].select("ingestion_id", "file_path", "status", "processed_at")


def _tiers(c):
    """Two passes over the state, the first half a year before the second."""
    def make():
        from tidemark.operators.tiers import Tiers

        store = StateStore(c.spark, c.scratch("tiers"), fold_after=None)
        store.append("ledger", "all", "seed", "done", c.store.state())
        tiers = Tiers(store, c.scratch("tiers-kept"))
        for moment in ("2001-02-15 00:00:00", LEDGER_NOW):
            tiers.run(moment)
        return tiers

    return c.once("tiers", make)


@query("h17_daily_after_passes", _rollup_sql("day", f"state WHERE processed_at >= {NOW} - INTERVAL 365 DAY AND processed_at < {NOW} - INTERVAL 30 DAY"), S)
def _(c):
    """Daily sums that two passes of retention have kept; they add up by day."""
    return _tiers(c).daily(LEDGER_NOW)


@query("h17_detail_after_passes", f"""
SELECT status, count(*) AS files FROM state WHERE processed_at IS NULL OR processed_at >= {NOW} - INTERVAL 30 DAY GROUP BY 1""", S)
def _(c):
    return _tiers(c).detail().groupBy("status").agg(F.count("*").alias("files"))


@query("i9_run_metrics", """
SELECT run_id, count(*) FILTER (WHERE status = 'SUCCESS') AS success_count, count(*) FILTER (WHERE status = 'FAILED') AS failed_count,
  count(*) FILTER (WHERE status = 'SKIPPED') AS skipped_count,
  CAST(coalesce(sum(records_ingested) FILTER (WHERE status = 'SUCCESS'), 0) AS bigint) AS records_ingested,
  CAST(coalesce(sum(bytes_read) FILTER (WHERE status = 'SUCCESS'), 0) AS bigint) AS bytes_read FROM state GROUP BY 1""", S)
def _(c):
    return run_metrics(c.state, "run_id")


@query("q1_row_count_threshold", """
SELECT run_id, r.ingestion_id, records_ingested, row_count_threshold FROM runs r
JOIN ingestions i ON i.ingestion_id = r.ingestion_id WHERE records_ingested < row_count_threshold""", ("runs", "ingestions"))
def _(c):
    return Q.low_row_count(c.runs, c.ingestions)


@query("q2_failure_rate", """
SELECT run_id, count(*) FILTER (WHERE status = 'FAILED') AS failed, count(*) FILTER (WHERE status = 'SUCCESS') AS success,
  CAST(count(*) FILTER (WHERE status = 'FAILED') AS double) / count(*) AS failure_rate
FROM state WHERE status IN ('SUCCESS', 'FAILED') GROUP BY 1
HAVING CAST(count(*) FILTER (WHERE status = 'FAILED') AS double) / count(*) > 0.2""", S)
def _(c):
    return Q.high_failure_rate(c.state, 0.2)


@query("q4_sla_breach", """
SELECT ingestion_id, run_id, file_path, processed_at, processing_duration_ms FROM state
WHERE processing_duration_ms > 2400000""", S)
def _(c):
    return Q.sla_breaches(c.state, 2400)


@query("q5_silent_ingestions", f"""
SELECT ingestion_id, max(modified_at) AS newest_file,
  CAST(date_diff('day', CAST(max(modified_at) AS date), DATE '2024-02-15') AS int) AS idle_days
FROM manifest GROUP BY 1 HAVING date_diff('day', CAST(max(modified_at) AS date), DATE '2024-02-15') > 2""", ("manifest",))
def _(c):
    return Q.silent_ingestions(c.manifest, "2024-02-15 00:00:00")


@query("q5_arrival_gaps", """
SELECT * FROM (SELECT ingestion_id, day, previous_day, CAST(date_diff('day', previous_day, day) AS int) AS gap_days FROM (
  SELECT ingestion_id, day, lag(day) OVER (PARTITION BY ingestion_id ORDER BY day) AS previous_day FROM (
    SELECT DISTINCT ingestion_id, CAST(discovered_at AS date) AS day FROM state) a) b) d WHERE gap_days > 10""", S)
def _(c):
    return Q.arrival_gaps(c.state, 10, "discovered_at")


@query("q6_size_spikes", """
SELECT * EXCLUDE (bytes) FROM (SELECT *, round(avg_bytes / trailing_avg_bytes, 6) AS ratio FROM (
  SELECT *, CAST(sum(bytes) OVER w AS double) / sum(file_count) OVER w AS trailing_avg_bytes FROM (
    SELECT ingestion_id, CAST(modified_at AS date) AS day, sum(size_bytes) AS bytes, count(*) AS file_count,
           CAST(sum(size_bytes) AS double) / count(*) AS avg_bytes FROM manifest GROUP BY 1, 2) a
  WINDOW w AS (PARTITION BY ingestion_id ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)) b) d
WHERE ratio > 5""", ("manifest",))
def _(c):
    return Q.size_spikes(c.manifest)


@query("q7_null_rule", """
SELECT * FROM (SELECT 'quality' AS column_name, count(*) FILTER (WHERE quality IS NULL) AS null_count, count(*) AS row_count,
  round(count(*) FILTER (WHERE quality IS NULL) * 100.0 / count(*), 6) AS null_pct
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) t WHERE null_pct > 5""")
def _(c):
    profile = P.null_profile(_labelled(c).select("doc_id", "lang", "quality"))
    return Q.null_rule(profile, 5.0)


def _labelled(c):
    return c.table("documents").join(c.table("labels"), "doc_id", "left")


@query("q8_duplicate_check", """
SELECT count(*) AS row_count, count(DISTINCT l_orderkey) AS distinct_count, count(*) - count(DISTINCT l_orderkey) AS duplicate_count,
  min(l_orderkey) AS min_key, max(l_orderkey) AS max_key FROM lineitem""")
def _(c):
    return Q.duplicate_check(c.table("lineitem"), "l_orderkey")


@query("q_alerts", """
SELECT * FROM (SELECT 'failure_rate' AS rule, 'warning' AS severity, ingestion_id,
  concat('High failure rate: ', CAST(count(*) FILTER (WHERE status = 'FAILED') AS varchar), ' failed files') AS message
FROM state WHERE status IN ('SUCCESS', 'FAILED') GROUP BY ingestion_id
HAVING CAST(count(*) FILTER (WHERE status = 'FAILED') AS double) / count(*) > 0.2
UNION ALL SELECT 'row_count', 'warning', r.ingestion_id, concat('Run ', run_id, ' brought ', CAST(records_ingested AS varchar), ' records')
FROM runs r JOIN ingestions i ON i.ingestion_id = r.ingestion_id WHERE records_ingested < row_count_threshold) t""",
       ("state", "runs", "ingestions"))
def _(c):
    rate = Q.high_failure_rate(c.state, 0.2, "ingestion_id").select(
        F.lit("failure_rate").alias("rule"), F.lit("warning").alias("severity"), "ingestion_id",
        F.format_string("High failure rate: %d failed files", "failed").alias("message"),
    )
    low = Q.low_row_count(c.runs, c.ingestions).select(
        F.lit("row_count").alias("rule"), F.lit("warning").alias("severity"), "ingestion_id",
        F.format_string("Run %s brought %d records", "run_id", "records_ingested").alias("message"),
    )
    return Q.union_alerts(rate, low)


def _impact_sql(files: str, skipped: str, present: str) -> str:
    return f"""
SELECT s.ingestion_id, coalesce(n, 0) AS files_to_process, {skipped} AS files_skipped, {present} AS files_skipped_present,
  round_even(coalesce(b, 0) / 1073741824.0, 2) AS estimated_data_size_gb,
  round_even(coalesce(b, 0) / 1073741824.0 * 0.25, 2) AS estimated_cost_usd,
  CASE WHEN n IS NULL THEN 0 ELSE greatest(5, 2 * n) END AS estimated_duration_minutes, oldest_file_date, newest_file_date
FROM sources s LEFT JOIN (SELECT ingestion_id, count(*) AS n, CAST(sum(size_bytes) AS bigint) AS b,
    min(modified_at) AS oldest_file_date, max(modified_at) AS newest_file_date FROM {files} GROUP BY 1) f
  ON f.ingestion_id = s.ingestion_id"""


# Sizes are scaled so that the sums reach gigabytes.
SCALE = "(SELECT * REPLACE (size_bytes * 100000 AS size_bytes) FROM manifest) m"
NOT_DONE = """ WHERE NOT EXISTS (SELECT 1 FROM ledger l WHERE l.ingestion_id = m.ingestion_id
  AND l.file_path = m.path AND status IN ('SUCCESS', 'SKIPPED'))"""
DONE = "coalesce((SELECT count(*) FROM ledger l WHERE l.ingestion_id = s.ingestion_id AND status IN ('SUCCESS', 'SKIPPED')), 0)"


def _scaled(c):
    return c.manifest.withColumn("size_bytes", F.col("size_bytes") * 100000)


@query("r5_full_impact", _impact_sql(SCALE, "CAST(0 AS bigint)", "CAST(0 AS bigint)"), MS)
def _(c):
    return R.full_impact(_scaled(c), c.sources)


@query("r6_incremental_impact", _impact_sql(f"(SELECT * FROM {SCALE}{NOT_DONE}) m", DONE, DONE), (*ML, "sources"))
def _(c):
    return R.incremental_impact(_scaled(c), c.ledger, c.sources)


def _fallback_sql(n: str, skipped: str) -> str:
    return f"""
SELECT ingestion_id, CAST(n AS bigint) AS files_to_process, CAST({skipped} AS bigint) AS files_skipped,
  round_even((n * 0.5)::double, 2) AS estimated_data_size_gb, round_even((n * 0.5 * 0.25)::double, 2) AS estimated_cost_usd,
  CAST(greatest(5, n * 2) AS bigint) AS estimated_duration_minutes,
  'Using estimated values - file discovery unavailable' AS warning
FROM (SELECT ingestion_id, d, {n} AS n FROM (SELECT s.ingestion_id, {DONE} AS d FROM sources s) a) b"""


@query("r7_fallback_full", _fallback_sql("CASE WHEN d > 0 THEN d ELSE 100 END", "0"), ("manifest", "ledger", "sources"))
def _(c):
    return R.fallback_impact(c.ledger, c.sources, "full")


@query("r7_fallback_incremental", _fallback_sql("greatest(10, CAST(floor(d * 0.05) AS bigint))", "d"), ("manifest", "ledger", "sources"))
def _(c):
    return R.fallback_impact(c.ledger, c.sources, "new_only")


@query("r8_warnings", f"""
SELECT ingestion_id, concat('This operation will reprocess ', CAST(files_to_process AS varchar), ' files (',
    CAST(estimated_data_size_gb AS varchar), ' GB)', CASE WHEN estimated_cost_usd > 10
    THEN concat('|Estimated cost: ', printf('$%.2f', estimated_cost_usd)) ELSE '' END) AS warnings
FROM ({_impact_sql("(SELECT * REPLACE (size_bytes * 500000 AS size_bytes) FROM manifest) m", "0", "0")}) t""", MS)
def _(c):
    big = c.manifest.withColumn("size_bytes", F.col("size_bytes") * 500000)
    out = R.with_warnings(R.full_impact(big, c.sources), "full")
    return out.select("ingestion_id", F.array_join("warnings", "|").alias("warnings"))


@query("r4_refresh_plan", """
SELECT mode, ingestion_id, CAST(step_no AS int) AS step_no, operation FROM sources,
  (VALUES ('full', 1, 'table_dropped'), ('full', 2, 'processed_files_cleared'), ('full', 3, 'run_triggered'),
          ('new_only', 1, 'table_dropped'), ('new_only', 2, 'run_triggered')) v(mode, step_no, operation)""", ("sources",))
def _(c):
    return M.union_manifests(*[
        R.refresh_steps(c.sources, m).select(F.lit(m).alias("mode"), "ingestion_id", "step_no", "operation")
        for m in ("full", "new_only")
    ])


@query("r10_range_impact", _impact_sql(
    f"(SELECT * FROM {SCALE} WHERE modified_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20') m",
    "CAST(0 AS bigint)", "CAST(0 AS bigint)"), MS)
def _(c):
    return R.full_impact(M.modified_between(_scaled(c), "2024-01-05 00:00:00", "2024-01-20 00:00:00"), c.sources)


@query("r11_conditional_refresh", "SELECT ingestion_id, count(*) AS files_to_process FROM manifest GROUP BY 1 HAVING count(*) > 45",
       ("manifest",))
def _(c):
    impact = R.full_impact(c.manifest, c.sources)
    return R.refresh_if(impact, "files_to_process > 45").select("ingestion_id", "files_to_process")


RUNS_MONTH = "CASE frequency WHEN 'hourly' THEN 720 WHEN 'daily' THEN 30 WHEN 'weekly' THEN 4 WHEN 'monthly' THEN 1 ELSE 30 END"


@query("k1_monthly_cost", f"""
, t AS (SELECT i.ingestion_id, {RUNS_MONTH} AS runs, coalesce(n, 0) AS n, coalesce(b, 0) / 1073741824.0 AS gb,
    CASE WHEN format IN ('json', 'csv') THEN 1.0::double ELSE 0.5::double END AS f FROM ingestions i LEFT JOIN (
    SELECT ingestion_id, count(*) AS n, CAST(sum(file_size_bytes) AS bigint) AS b FROM state GROUP BY 1) s ON s.ingestion_id = i.ingestion_id)
SELECT ingestion_id, CAST(runs AS int) AS runs_per_month, round_even(gb, 2) AS total_gb, round_even(gb * f, 2) AS duration_minutes,
  round_even(gb * f / 60.0 * 64 * 0.4::double, 2) AS compute_per_run, round_even(gb * f / 60.0 * 64 * 0.4::double * runs, 2) AS compute_monthly,
  round_even(gb * runs * 0.023::double, 2) AS storage_monthly, round_even(n::double * runs / 1000.0 * 0.005::double, 4) AS discovery_monthly,
  round_even(gb * f / 60.0 * 64 * 0.4::double * runs + gb * runs * 0.023::double + n::double * runs / 1000.0 * 0.005::double, 2) AS total_monthly
FROM t""", ("state", "ingestions"))
def _(c):
    files = c.state.select("ingestion_id", F.col("file_path").alias("path"), F.col("file_size_bytes").alias("size_bytes"),
                           F.col("discovered_at").alias("modified_at"))
    return R.monthly_cost(c.ingestions, M.summarize(files, "ingestion_id"))


@query("k2_runs_per_month", f"SELECT ingestion_id, frequency, CAST({RUNS_MONTH} AS int) AS runs_per_month FROM ingestions", ("ingestions",))
def _(c):
    from tidemark.functions.expressions import runs_per_month

    return c.ingestions.select("ingestion_id", "frequency", runs_per_month(F.col("frequency")).alias("runs_per_month"))


@query("k3_extrapolated_duration", """
SELECT CAST(a AS bigint) AS total_bytes, CAST(b AS bigint) AS sample_bytes, round(a / b * 12.0 / 60.0, 6) AS estimated_minutes FROM (
  SELECT (SELECT sum(size_bytes)::double FROM manifest) AS a,
         (SELECT sum(size_bytes)::double FROM (SELECT size_bytes FROM manifest ORDER BY path LIMIT 10) s) AS b) t""", ("manifest",))
def _(c):
    return R.extrapolated_minutes(c.manifest, M.first_files(c.manifest, 10), 12.0)


@query("p3_record_estimate", """
SELECT count(*) AS file_count, count(*) * 1000 AS estimated_records FROM manifest""", ("manifest",))
def _(c):
    return P.estimate_records(c.manifest)


@query("p3_record_estimate_by_size", """
SELECT count(*) AS file_count, CAST(sum(size_bytes) AS bigint) AS total_bytes,
  CAST(round(sum(size_bytes) / (SELECT avg(octet_length(encode(text)) + 1) FROM conversations)) AS bigint) AS estimated_records
FROM manifest""", ("manifest",))
def _(c):
    return P.estimate_records_by_size(c.manifest, c.table("conversations"), "text")


@query("p4_null_profile", """
SELECT unnest(['doc_id', 'lang', 'source', 'quality', 'toxic']) AS column_name,
  unnest([0, 0, 0, q, q]) AS null_count, n AS row_count, round(unnest([0, 0, 0, q, q]) * 100.0 / n, 6) AS null_pct
FROM (SELECT count(*) AS n, count(*) FILTER (WHERE quality IS NULL) AS q FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) t""")
def _(c):
    return P.null_profile(_labelled(c).select("doc_id", "lang", "source", "quality", "toxic"))


@query("p5_malformed_records", """
SELECT origin, count(*) AS record_count, count(*) FILTER (WHERE NOT json_valid(value)) AS malformed_count FROM (
  SELECT 'events' AS origin, props AS value FROM events UNION ALL SELECT 'pages', html FROM pages
  UNION ALL SELECT 'documents', text FROM documents) t WHERE trim(value) <> '' GROUP BY 1""")
def _(c):
    lines = M.union_manifests(*[
        c.table(t).select(F.lit(t).alias("origin"), F.col(col).alias("value"))
        for t, col in (("events", "props"), ("pages", "html"), ("documents", "text"))
    ])
    return P.malformed(lines, "value", "origin")


@query("p6_partition_suggestion", """
SELECT column_name, d BETWEEN 2 AND 1000 AND d * 10 <= n AS suggested FROM (SELECT
  unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderpriority']) AS column_name,
  unnest([count(DISTINCT o_orderkey), count(DISTINCT o_custkey), count(DISTINCT o_orderstatus), count(DISTINCT o_totalprice),
          count(DISTINCT o_orderpriority)]) AS d, count(*) AS n FROM orders) t""")
def _(c):
    return P.suggest_partition_columns(c.table("orders").drop("o_orderdate")).select("column_name", "suggested")


@query("p8_arrival_pattern", """
SELECT CAST(hour(ts) AS int) AS hour, count(*) AS file_count, round(count(*)::double / sum(count(*)) OVER (), 6) AS share
FROM events GROUP BY 1""")
def _(c):
    return P.arrival_pattern(c.table("events"), "ts")


@query("p9_total_size", """
SELECT ingestion_id, count(*) AS file_count, CAST(sum(size_bytes) AS bigint) AS total_bytes,
  round(sum(size_bytes) / 1073741824.0, 6) AS total_gb, min(modified_at) AS oldest_file, max(modified_at) AS newest_file
FROM manifest GROUP BY 1""", ("manifest",))
def _(c):
    return M.summarize(c.manifest, "ingestion_id")


