"""Manifests, planning and the ledger."""

from pyspark.sql import functions as F

from registry.core import MANIFEST_NOW, LEDGER_NOW, STATE_ORDER, query
from tidemark.functions.expressions import next_retry_at
from tidemark.model import LEDGER_SCHEMA
from tidemark.operators import ledger as L, planning as B
from tidemark.operators.state_store import StateStore
from tidemark.sources import manifest as M, paths

CHANGED_SQL = """CASE WHEN coalesce(m.etag, '') <> '' AND coalesce(l.file_etag, '') <> '' THEN m.etag <> l.file_etag
     WHEN m.modified_at IS NOT NULL AND l.file_modified_at IS NOT NULL THEN m.modified_at > l.file_modified_at
     ELSE false END"""
JOINED = "FROM manifest m LEFT JOIN ledger l ON l.ingestion_id = m.ingestion_id AND l.file_path = m.path"
ML = ("manifest", "ledger")


@query("a2_content_fingerprint", "SELECT md5(text) AS etag, count(*) AS copies FROM documents GROUP BY 1")
def _(c):
    docs = c.table("documents").select(M.content_etag(F.col("text")).alias("etag"))
    return docs.groupBy("etag").agg(F.count("*").alias("copies"))


@query("a3_path_split", r"""
SELECT path, 's3a' AS scheme, regexp_extract(path, '^s3a?://([^/]*)/?(.*)$', 1) AS bucket,
       regexp_extract(path, '^s3a?://([^/]*)/?(.*)$', 2) AS prefix FROM manifest""", ("manifest",))
def _(c):
    u = paths.split_uri(F.regexp_replace("path", "^s3a:", "s3:"))
    return c.manifest.select("path", u.alias("u")).select("path", "u.scheme", "u.bucket", "u.prefix")


@query("a4_suffix_filter", "SELECT path, size_bytes FROM manifest WHERE path LIKE '%.json'", ("manifest",))
def _(c):
    return M.match_suffix(c.manifest, "*.json").select("path", "size_bytes")


@query("a5_glob_filter", r"""
SELECT path FROM manifest
WHERE regexp_matches(path, '^(.*/)?src1[^/]*/year=202[3-4]/(.*/)?doc_[^/]*\.json$')""", ("manifest",))
def _(c):
    return M.match_glob(c.manifest, "src1*/year=202[3-4]/**/doc_*.json").select("path")


@query("a6_modified_since", f"SELECT path, modified_at FROM manifest WHERE modified_at >= TIMESTAMP '{MANIFEST_NOW}'",
       ("manifest",))
def _(c):
    return M.modified_since(c.manifest, MANIFEST_NOW).select("path", "modified_at")


@query("a7_file_cap", "SELECT path FROM (SELECT path FROM manifest ORDER BY path LIMIT 100) t", ("manifest",))
def _(c):
    return M.first_files(c.manifest.select("path"), 100)


@query("a8_lookback", f"""
SELECT path FROM manifest WHERE modified_at >= TIMESTAMP '{MANIFEST_NOW}' - INTERVAL 7 DAY""", ("manifest",))
def _(c):
    return M.lookback(c.manifest, MANIFEST_NOW).select("path")


@query("a9_day_partitions", """
SELECT path FROM manifest WHERE CAST(modified_at AS date) BETWEEN DATE '2024-01-10' AND DATE '2024-02-01'""",
       ("manifest",))
def _(c):
    return M.in_day_partitions(c.manifest, "2024-01-10 00:00:00", MANIFEST_NOW).select("path")


def _messages(c):
    record = F.struct(
        F.date_format("modified_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("eventTime"),
        F.struct(
            F.struct(F.lit("landing").alias("name")).alias("bucket"),
            F.struct(
                F.regexp_replace("path", "^s3a://landing/", "").alias("key"), F.col("size_bytes").alias("size"),
                F.concat(F.lit('"'), "etag", F.lit('"')).alias("eTag"),
            ).alias("object"),
        ).alias("s3"),
    )
    good = c.manifest.select(F.to_json(F.struct(F.array(record).alias("Records"))).alias("body"))
    return good.unionByName(c.table("pages").select(F.col("html").alias("body")))


@query("a10_notifications", "SELECT path, size_bytes, modified_at, etag FROM manifest", ("manifest",))
def _(c):
    found, _ = M.from_notifications(_messages(c))
    return found.withColumn("modified_at", F.col("modified_at").cast("timestamp_ntz"))


@query("a10_unreadable_notifications", "SELECT html AS body FROM pages")
def _(c):
    _, rejected = M.from_notifications(_messages(c))
    return rejected.select("body")


@query("a11_multi_source", """
SELECT scheme, count(*) AS file_count, CAST(sum(size_bytes) AS bigint) AS total_bytes FROM (
  SELECT 's3a' AS scheme, size_bytes FROM manifest UNION ALL SELECT 'gs', size_bytes FROM manifest
  UNION ALL SELECT 'wasbs', size_bytes FROM manifest) t GROUP BY scheme""", ("manifest",))
def _(c):
    stores = [
        c.manifest.withColumn("path", F.regexp_replace("path", "^s3a://landing", prefix))
        for prefix in ("s3://landing", "gs://landing", "wasbs://landing@account.blob.core.windows.net")
    ]
    u = paths.split_uri(F.col("path"), ("s3", "s3a", "gs", "wasbs"))
    return M.union_manifests(*stores).groupBy(u["scheme"].alias("scheme")).agg(
        F.count("*").alias("file_count"), F.sum("size_bytes").cast("bigint").alias("total_bytes")
    )


@query("b1_processed_set", """
SELECT DISTINCT ingestion_id, file_path FROM state WHERE status IN ('SUCCESS', 'SKIPPED')""", ("state",))
def _(c):
    return L.processed_paths(c.state)


@query("b2_new_files", """
SELECT ingestion_id, path, size_bytes FROM manifest m WHERE NOT EXISTS (
  SELECT 1 FROM ledger l WHERE l.ingestion_id = m.ingestion_id AND l.file_path = m.path
  AND status IN ('SUCCESS', 'SKIPPED'))""", ML)
def _(c):
    return B.new_files(c.manifest, c.ledger).select("ingestion_id", "path", "size_bytes")


@query("b3_changed_files", f"""
SELECT m.ingestion_id, path AS file_path {JOINED} WHERE status = 'SUCCESS' AND {CHANGED_SQL}""", ML)
def _(c):
    return B.classify(c.manifest, c.ledger).filter("action = 'CHANGED'").select("ingestion_id", "file_path")


@query("b4_classify", f"""
SELECT ingestion_id, file_path, action, CAST(CASE WHEN action = 'NEW' THEN 0 WHEN action IN ('RETRY', 'CHANGED')
       THEN retry_count + 1 ELSE retry_count END AS int) AS next_retry_count
FROM (SELECT m.ingestion_id, path AS file_path, retry_count,
             CASE WHEN status IS NULL THEN 'NEW' WHEN status = 'PROCESSING' THEN 'IN_PROGRESS'
                  WHEN status = 'SUCCESS' THEN CASE WHEN {CHANGED_SQL} THEN 'CHANGED' ELSE 'UNCHANGED' END
                  ELSE 'RETRY' END AS action {JOINED}) t""", ML)
def _(c):
    return B.classify(c.manifest, c.ledger).select("ingestion_id", "file_path", "action", "next_retry_count")


@query("b4_plan_path_mode", """
SELECT m.ingestion_id, path AS file_path, m.size_bytes FROM manifest m
LEFT JOIN ledger l ON l.ingestion_id = m.ingestion_id AND l.file_path = m.path
WHERE status IS NULL OR status = 'FAILED'""", ML)
def _(c):
    return B.plan(c.manifest, c.ledger, "path").select("ingestion_id", "file_path", "size_bytes")


@query("b4_plan_changed_mode", f"""
SELECT m.ingestion_id, path AS file_path, m.size_bytes {JOINED}
WHERE status IS NULL OR status = 'FAILED' OR (status = 'SUCCESS' AND {CHANGED_SQL})""", ML)
def _(c):
    return B.plan(c.manifest, c.ledger, "changed").select("ingestion_id", "file_path", "size_bytes")


B5 = "SELECT ingestion_id, file_path, run_id, status, retry_count, event_time FROM state"


@query("b5_current_state", B5, ("state",))
def _(c):
    """The folded state with the deltas behind it."""
    return c.state.select("ingestion_id", "file_path", "run_id", "status", "retry_count", "event_time")


@query("b5_ranked_log", B5, ("state",))
def _(c):
    """The same from the whole log."""
    return L.current_state(c.events_log, order=STATE_ORDER).select(
        "ingestion_id", "file_path", "run_id", "status", "retry_count", "event_time"
    )


@query("b5_folded_again", B5, ("state",))
def _(c):
    """The state of a store whose base was merged twice, touching only the buckets that the second part concerns."""
    def make():
        store = StateStore(c.spark, c.scratch("folding"), fold_after=None)
        have = set(c.events_log.columns)
        rows = c.events_log.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in LEDGER_SCHEMA.fields])
        few = F.pmod(F.xxhash64("file_path"), F.lit(50)) == 0
        for name, mine in (("most", ~few | (F.col("seq") > 1)), ("rest", few & (F.col("seq") <= 1))):
            store.append("ledger", "all", name, "done", rows.filter(mine))
            store.fold()
        return store

    return c._as_given(c.once("folding", make).state()).select("ingestion_id", "file_path", "run_id", "status", "retry_count", "event_time")


@query("b6_retry_selection", """
SELECT ingestion_id, file_path, retry_count FROM state WHERE status = 'FAILED' AND retry_count < 3""", ("state",))
def _(c):
    return L.retryable(c.state).select("ingestion_id", "file_path", "retry_count")


@query("b7_stale_files", f"""
SELECT ingestion_id, file_path, processing_started_at FROM state
WHERE status = 'PROCESSING' AND processing_started_at < TIMESTAMP '{LEDGER_NOW}' - INTERVAL 1 HOUR""", ("state",))
def _(c):
    return L.stale(c.state, LEDGER_NOW).select("ingestion_id", "file_path", "processing_started_at")


@query("b8_stale_reset", f"""
SELECT ingestion_id, file_path, 'PENDING' AS status, concat('Reset from stale PROCESSING state (started ',
       strftime(processing_started_at, '%Y-%m-%d %H:%M:%S'), ')') AS error_message, seq + 1 AS seq FROM state
WHERE status = 'PROCESSING' AND processing_started_at < TIMESTAMP '{LEDGER_NOW}' - INTERVAL 2 HOUR""", ("state",))
def _(c):
    return L.stale_reset(c.state, LEDGER_NOW).select("ingestion_id", "file_path", "status", "error_message", "seq")


@query("b9_prefilter", f"""
SELECT path, CASE WHEN size_bytes > 0.000004 * 1073741824 THEN 'too_large'
  WHEN regexp_matches(path, 'src7/|src13/') THEN 'excluded'
  WHEN modified_at < TIMESTAMP '{MANIFEST_NOW}' - INTERVAL 20 DAY THEN 'too_old' END AS skip_reason FROM manifest""",
       ("manifest",))
def _(c):
    return B.prefilter(c.manifest, MANIFEST_NOW, 0.000004, "src7/|src13/", 20).select("path", "skip_reason")


@query("b10_size_routing", """
SELECT file_path, CASE WHEN file_size_bytes <= 0.05 * 1073741824 THEN 'process' ELSE 'skip' END AS route
FROM state""", ("state",))
def _(c):
    return B.route_by_size(c.state.withColumn("size_bytes", F.col("file_size_bytes")), 0.05).select("file_path", "route")


@query("b11_backfill_range", """
SELECT path FROM manifest WHERE modified_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'""", ("manifest",))
def _(c):
    return M.modified_between(c.manifest, "2024-01-05 00:00:00", "2024-01-20 00:00:00").select("path")


@query("b12_backfill_modes", """
SELECT mode, ingestion_id, path FROM (SELECT unnest(['new_only', 'include_existing', 'from_date']) AS mode) x,
  manifest m WHERE (mode = 'include_existing' OR (mode = 'new_only' AND modified_at >= TIMESTAMP '2024-01-20')
  OR (mode = 'from_date' AND modified_at >= TIMESTAMP '2024-01-05'))
AND NOT EXISTS (SELECT 1 FROM ledger l WHERE l.ingestion_id = m.ingestion_id AND l.file_path = m.path
  AND status IN ('SUCCESS', 'SKIPPED'))""", ML)
def _(c):
    parts = [
        B.backfill(c.manifest, c.ledger, mode, start="2024-01-05 00:00:00", activated_at="2024-01-20 00:00:00")
        .select(F.lit(mode).alias("mode"), "ingestion_id", "path")
        for mode in ("new_only", "include_existing", "from_date")
    ]
    return M.union_manifests(*parts)


@query("b13_selective_clear", """
SELECT ingestion_id, file_path, status FROM state WHERE NOT file_path LIKE '%/ing1%/part_%'""", ("state",))
def _(c):
    return L.without_history(c.state, "%/ing1%/part_%").select("ingestion_id", "file_path", "status")


@query("b13_clear_and_replay", """
SELECT ingestion_id, file_path, status FROM state WHERE NOT file_path LIKE '%/ing1%/part_%'""", ("state",))
def _(c):
    gone = L.clear_history(c.state, "2099-01-01 00:00:00", "%/ing1%/part_%")
    again = L.current_state(c.events_log.unionByName(gone.select(*c.events_log.columns)), order=STATE_ORDER)
    return again.select("ingestion_id", "file_path", "status")


@query("b14_old_schema_files", """
SELECT ingestion_id, file_path, schema_version FROM ledger JOIN (
  SELECT ingestion_id AS i, max(schema_version) AS latest FROM ledger GROUP BY 1) v ON i = ingestion_id
WHERE status = 'SUCCESS' AND schema_version < latest""", ("ledger",))
def _(c):
    versions = c.ledger.select("ingestion_id", F.col("schema_version").alias("version"))
    return L.read_before_version(c.ledger, versions=versions).select("ingestion_id", "file_path", "schema_version")


@query("b15_same_name_elsewhere", """
SELECT regexp_extract(path, '[^/]*$') AS file_name, count(*) AS places FROM (
  SELECT path FROM manifest UNION ALL SELECT replace(path, 's3a://landing', 's3a://other') FROM manifest) t
GROUP BY 1""", ("manifest",))
def _(c):
    other = c.manifest.withColumn("path", F.regexp_replace("path", "^s3a://landing", "s3a://other"))
    known = c.manifest.select("ingestion_id", F.col("path").alias("file_path"), F.lit("SUCCESS").alias("status"))
    both = M.union_manifests(c.manifest, B.new_files(other, known))
    return both.groupBy(F.regexp_extract("path", "[^/]*$", 0).alias("file_name")).agg(F.count("*").alias("places"))


@query("i7_error_classes", """
SELECT file_path, error_type,
  CASE WHEN error_type = 'JSONDecodeError' THEN 'corrupt' WHEN error_type = 'SchemaEvolutionError' THEN 'schema_mismatch'
       WHEN error_type = 'TimeoutError' THEN 'transient' ELSE 'unknown' END AS error_class,
  error_type IN ('TimeoutError', 'OSError') AS retryable, error_type = 'SchemaEvolutionError' AS action_required
FROM state WHERE status IN ('FAILED', 'SKIPPED') AND error_type IS NOT NULL""", ("state",))
def _(c):
    return L.with_error_class(c.state).select("file_path", "error_type", "error_class", "retryable", "action_required")


@query("i23_backoff", """
SELECT file_path, retry_count, processed_at + to_minutes(CASE retry_count WHEN 0 THEN 1 WHEN 1 THEN 5 WHEN 2 THEN 15 END)
  AS next_retry_at FROM state WHERE status = 'FAILED'""", ("state",))
def _(c):
    failed = c.state.filter("status = 'FAILED'")
    return failed.select(
        "file_path", "retry_count", next_retry_at(F.col("processed_at"), F.col("retry_count")).alias("next_retry_at")
    )


@query("s14_schema_approval", """
SELECT action, ingestion_id, file_path, CASE action WHEN 'reject' THEN 'PERMANENTLY_SKIPPED' ELSE 'PENDING' END AS status
FROM (SELECT unnest(['accept', 'merge', 'reject']) AS action) a, state
WHERE state.status = 'SKIPPED' AND error_type = 'SchemaEvolutionError'""", ("state",))
def _(c):
    return M.union_manifests(*[
        L.approve_schema(c.state, a, LEDGER_NOW).select(F.lit(a).alias("action"), "ingestion_id", "file_path", "status")
        for a in ("accept", "merge", "reject")
    ])


@query("r1_clear_history", "SELECT ingestion_id, count(*) AS files_cleared FROM state GROUP BY 1", ("state",))
def _(c):
    gone = L.clear_history(c.state, LEDGER_NOW)
    return gone.groupBy("ingestion_id").agg(F.count("*").alias("files_cleared"))


@query("h16_retention_archive", f"""
SELECT archived, count(*) AS file_count, CAST(sum(file_size_bytes) AS bigint) AS total_bytes FROM (
  SELECT coalesce(processed_at < TIMESTAMP '{LEDGER_NOW}' - INTERVAL 90 DAY, false) AS archived, file_size_bytes FROM state) t
GROUP BY 1""", ("state",))
def _(c):
    return L.with_age(c.state, LEDGER_NOW).groupBy("archived").agg(
        F.count("*").alias("file_count"), F.sum("file_size_bytes").cast("bigint").alias("total_bytes")
    )
