"""Table schemas, status vocabularies and the ingestion configuration."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import types as T

# File states, in life-cycle order.
DISCOVERED = "DISCOVERED"
PENDING = "PENDING"
PROCESSING = "PROCESSING"
SUCCESS = "SUCCESS"
FAILED = "FAILED"
SKIPPED = "SKIPPED"
PERMANENTLY_SKIPPED = "PERMANENTLY_SKIPPED"
# Tombstone written when history is cleared; never part of a current state.
CLEARED = "CLEARED"
FILE_STATES = (DISCOVERED, PENDING, PROCESSING, SUCCESS, FAILED, SKIPPED, PERMANENTLY_SKIPPED)

# Run states.
RUN_RUNNING, RUN_SUCCESS, RUN_FAILED, RUN_PARTIAL = "running", "success", "failed", "partial"

# Accepted source formats and write modes.
FORMATS = ("json", "csv", "parquet", "avro", "orc", "xml")
WRITE_MODES = ("append", "overwrite", "overwrite_partitions", "merge")
# What a run does with columns and nested fields that the table lacks: add them, add them with a default for the rows that
# are there, keep them in a generation of the table from then on, or hold their files until the change is approved.
ON_NEW_COLUMNS = ("auto_merge", "backfill_default", "version_table", "approve")
BACKFILL_MODES = ("include_existing", "new_only", "from_date")

SCHEMA_ERROR = "SchemaEvolutionError"
# What a plan says of a file whose schema change was approved.
SCHEMA_APPROVED = "SchemaApproved"
PENDING_APPROVAL = "pending_approval"
MALFORMED_ERROR = "MalformedRecordError"
CORRUPT_ERROR = "CorruptFileError"

MANIFEST_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("size_bytes", T.LongType()),
    T.StructField("modified_at", T.TimestampType()),
    T.StructField("etag", T.StringType()),
])

LEDGER_SCHEMA = T.StructType([
    T.StructField("ingestion_id", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("file_size_bytes", T.LongType()),
    T.StructField("file_modified_at", T.TimestampType()),
    T.StructField("file_etag", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("discovered_at", T.TimestampType()),
    T.StructField("processing_started_at", T.TimestampType()),
    T.StructField("processed_at", T.TimestampType()),
    T.StructField("records_ingested", T.LongType()),
    T.StructField("bytes_read", T.LongType()),
    T.StructField("processing_duration_ms", T.LongType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("error_type", T.StringType()),
    T.StructField("retry_count", T.IntegerType()),
    T.StructField("schema_version", T.IntegerType()),
    T.StructField("event_time", T.TimestampType()),
    T.StructField("seq", T.IntegerType()),
    T.StructField("run_id", T.StringType()),
])

RUN_ERROR = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("error_type", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
])

RUN_SCHEMA = T.StructType([
    T.StructField("ingestion_id", T.StringType()),
    T.StructField("started_at", T.TimestampType()),
    T.StructField("ended_at", T.TimestampType()),
    T.StructField("status", T.StringType()),
    T.StructField("trigger", T.StringType()),
    T.StructField("files_processed", T.LongType()),
    T.StructField("files_failed", T.LongType()),
    T.StructField("files_skipped", T.LongType()),
    T.StructField("records_ingested", T.LongType()),
    T.StructField("bytes_read", T.LongType()),
    T.StructField("bytes_written", T.LongType()),
    T.StructField("duration_seconds", T.IntegerType()),
    T.StructField("error_count", T.LongType()),
    T.StructField("errors", T.ArrayType(RUN_ERROR)),
    T.StructField("target", T.StringType()),
    T.StructField("run_id", T.StringType()),
])

SCHEMA_VERSION_SCHEMA = T.StructType([
    T.StructField("ingestion_id", T.StringType()),
    T.StructField("version", T.IntegerType()),
    T.StructField("detected_at", T.TimestampType()),
    T.StructField("schema_json", T.StringType()),
    T.StructField("resolution_type", T.StringType()),
    T.StructField("resolved_at", T.TimestampType()),
    T.StructField("changes_summary", T.StringType()),
    T.StructField("run_id", T.StringType()),
])

# One row per affected file: a version may concern any number of files, so they stay rows.
SCHEMA_FILE_SCHEMA = T.StructType([
    T.StructField("ingestion_id", T.StringType()),
    T.StructField("version", T.IntegerType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("run_id", T.StringType()),
])

# Service columns of every target table; hidden by the committed view.
SOURCE_FILE = "_source_file"
CORRUPT = "_corrupt_record"
RUN_ID = "_run_id"
PART = "_part"
SERVICE_COLUMNS = (SOURCE_FILE, CORRUPT, RUN_ID, PART)


@dataclass
class IngestionConfig:
    """One ingestion: where files land, how they are read, where rows go."""

    ingestion_id: str
    source_path: str
    table: str
    format: str = "json"
    format_options: dict = field(default_factory=dict)
    schema: T.StructType | str | None = None
    evolution_enabled: bool = True
    file_pattern: str | None = None
    match: str = "suffix"
    location: str | None = None
    write_mode: str = "append"
    merge_keys: tuple[str, ...] = ()
    partition_columns: tuple[str, ...] = ()
    cluster_columns: tuple[str, ...] = ()
    on_bad_records: str = "fail_file"
    plan_mode: str = "changed"
    max_files: int | None = None
    max_file_size_gb: float | None = None
    exclude_pattern: str | None = None
    max_file_age_days: int | None = None
    row_count_threshold: int | None = None
    # How many files one scan takes; schemas and verdicts do not depend on it.
    files_per_scan: int = 50_000
    # Failed files are tried again this often, after a growing wait; None tries every failed file in every run.
    max_retries: int | None = 3
    retry_backoff: bool = False
    stale_after_hours: int = 2
    # Columns by which the last row of a merge key wins; without them the newest file does.
    merge_order: tuple[str, ...] = ()
    # Whether a run whose files hold no rows may empty the published table of mode overwrite.
    allow_empty_overwrite: bool = False
    # Steps (name, argument) applied to the rows on their way into the table, see operators.transforms.
    transforms: tuple[tuple[str, object], ...] = ()
    # Only files modified from then on, or the day folders of the last days.
    since: datetime | None = None
    lookback_days: int | None = None
    # How new columns are taken in (see ON_NEW_COLUMNS), and SQL literals by column for ``backfill_default``.
    on_new_columns: str = "auto_merge"
    column_defaults: dict[str, str] = field(default_factory=dict)
    # Whether a wider type is taken in at once, or only for files whose change was approved.
    type_promotion: str = "approve"
    # JSON only: a text column for what neither a column nor its type can hold; such values then hold no file back.
    rescue_column: str | None = None
    # Which files a first load takes: all, those since ``activated_at``, or those modified from ``backfill_start`` on, up to
    # ``backfill_end``.
    backfill_mode: str = "include_existing"
    activated_at: datetime | None = None
    backfill_start: datetime | None = None
    backfill_end: datetime | None = None
    # JSON: the schema comes from the first lines of so many files, and the others are not read for it.
    schema_sample_files: int | None = None
    # Streams: files older than this (``7d``) than the newest one are left out.
    max_file_age: str | None = None

    def __post_init__(self) -> None:
        self.format = self.format.lower()
        if self.format not in FORMATS:
            raise ValueError(f"unsupported format {self.format!r}; expected one of {FORMATS}")
        if self.write_mode not in WRITE_MODES:
            raise ValueError(f"unsupported write mode {self.write_mode!r}; expected one of {WRITE_MODES}")
        if self.write_mode == "merge" and not self.merge_keys:
            raise ValueError("write mode 'merge' needs merge_keys")
        if self.on_bad_records not in ("fail_file", "quarantine"):
            raise ValueError("on_bad_records must be 'fail_file' or 'quarantine'")
        if self.plan_mode not in ("changed", "path"):
            raise ValueError("plan_mode must be 'changed' or 'path'")
        if self.on_new_columns not in ON_NEW_COLUMNS:
            raise ValueError(f"unsupported on_new_columns {self.on_new_columns!r}; expected one of {ON_NEW_COLUMNS}")
        if self.type_promotion not in ("approve", "auto"):
            raise ValueError("type_promotion must be 'approve' or 'auto'")
        if self.backfill_mode not in BACKFILL_MODES:
            raise ValueError(f"unsupported backfill_mode {self.backfill_mode!r}; expected one of {BACKFILL_MODES}")
        if self.backfill_mode == "new_only" and self.activated_at is None:
            raise ValueError("backfill_mode 'new_only' needs activated_at")
        if self.rescue_column and self.format != "json":
            raise ValueError("rescue_column needs format 'json'")
        if self.schema_sample_files and self.format != "json":
            raise ValueError("schema_sample_files needs format 'json'")

    @property
    def explicit_schema(self) -> T.StructType | None:
        if self.schema is None or isinstance(self.schema, T.StructType):
            return self.schema
        return T.StructType.fromJson(json.loads(self.schema))
