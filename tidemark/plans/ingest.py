"""One ingestion run: list, plan, read in few large scans, judge every file, commit."""

from __future__ import annotations

import json
import math
import re
import time
import uuid
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark.functions.schema_nodes import merged_schema, nodes, rebuilt, schema_of, width
from tidemark.functions.schema_types import diff, doubled_names, extended, misfits, nested_additions, new_columns, reshaped_rows, typed
from tidemark.model import (
    CORRUPT, CORRUPT_ERROR, FAILED, MALFORMED_ERROR, MANIFEST_SCHEMA, PENDING, PENDING_APPROVAL, PROCESSING, RUN_FAILED, RUN_PARTIAL,
    RUN_RUNNING, RUN_SCHEMA, RUN_SUCCESS, SCHEMA_APPROVED, SCHEMA_ERROR, SCHEMA_VERSION_SCHEMA, SKIPPED, SOURCE_FILE, SUCCESS, IngestionConfig,
)
from tidemark.operators import planning, transforms, writer
from tidemark.operators.ledger import finished_events
from tidemark.operators.schema_history import user_columns
from tidemark.operators.records import rescue
from tidemark.operators.schema_infer import csv_headers, json_file_schemas, read_lines, sample_schema
from tidemark.operators.state_store import StateStore
from tidemark.operators.upsert import Buckets, dedupe, swap_snapshot
from tidemark.sources import manifest as manifests
from tidemark.sources.listing import footer_schemas, read_through
from tidemark.sources.readers import listing_tasks, scan, scan_permissive
from tidemark.session import ship
from tidemark.workspace import delete_path, materialize, path_exists

VERDICT_COLUMNS = "verdict string, error_type string, message string"
VERDICT_SCHEMA = f"{SOURCE_FILE} string, {VERDICT_COLUMNS}"
PROBE_SCHEMA = f"{SOURCE_FILE} string, found string, {VERDICT_COLUMNS}"
# The run row shows the first errors as a report; the count is full, and all errors are ledger rows of the run.
ERRORS_IN_RUN_ROW = 100


AWAITING = "awaiting approval: "
GROUP_SCHEMA = (
    "found string, approved boolean, first string, problem string, "
    "nodes array<struct<path: array<string>, name: string, kind: string, position: int>>"
)


@dataclass
class RunResult:
    run_id: str
    status: str
    success: int
    failed: int
    skipped: int
    records: int
    bytes_read: int
    bytes_written: int
    added_columns: tuple[str, ...] = ()
    # Whether the run brought fewer records than the ingestion's threshold.
    low_row_count: bool = False


def run_ingestion(
    spark: SparkSession,
    config: IngestionConfig,
    store: StateStore,
    as_of: datetime | None = None,
    run_id: str | None = None,
    manifest: DataFrame | None = None,
    trigger: str = "manual",
    skip_idle: bool = False,
) -> RunResult:
    """Processes the files of ``config`` that need it. ``run_id`` of a lost run replays that run.

    With ``skip_idle`` a run that finds nothing to do leaves no trace.
    """
    started = as_of or datetime.now(timezone.utc)
    run_id = run_id or uuid.uuid4().hex
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", run_id):
        raise ValueError(f"run id {run_id!r} cannot name a partition")
    clock = time.monotonic()
    ship(spark)
    try:
        with listing_tasks(spark):
            result = _Run(spark, config, store, run_id, started, trigger).execute(manifest, skip_idle)
    except Exception as e:
        ended = started + timedelta(seconds=time.monotonic() - clock)
        _write_run(spark, store, config, run_id, started, ended, trigger, RUN_FAILED,
                   errors=[(None, type(e).__name__, str(e), ended)])
        store.fail_in_flight(config.ingestion_id, run_id, ended, type(e).__name__, str(e))
        raise
    return result


class _Run:
    def __init__(self, spark, config, store, run_id, started, trigger):
        self.spark, self.config, self.store = spark, config, store
        self.run_id, self.started, self.trigger = run_id, started, trigger
        self.clock = time.monotonic()
        self.added: list[str] = []
        self.new_versions: list[int] = []
        self.whole = T.StructType([])

    def now(self) -> datetime:
        return self.started + timedelta(seconds=time.monotonic() - self.clock)

    def execute(self, manifest: DataFrame | None, skip_idle: bool = False) -> RunResult:
        config, store = self.config, self.store
        self.begin()
        files = self.fix_plan(manifest)
        if skip_idle and files.isEmpty():
            delete_path(self.spark, store.folder("ledger", config.ingestion_id, self.run_id, "plan"))
            delete_path(self.spark, store.folder("runs", config.ingestion_id, self.run_id, "start"))
            return RunResult(self.run_id, RUN_SUCCESS, 0, 0, 0, 0, 0, 0)
        todo = files.filter(F.col("status") == PROCESSING)
        total, self.approved = todo.agg(F.count("*"), F.count_if(F.col("error_type") == SCHEMA_APPROVED)).first()
        if total:
            # A scan holds its file list on the driver, as every Spark file scan does; beyond the bound the run
            # takes several scans, split by a hash of the path. Schemas and verdicts are decided before, for all.
            scans = math.ceil(total / config.files_per_scan)
            self.judge(todo, scans)
            for k in range(scans):
                self.load_part(k, scans)
            self.finish_files(files, scans)
        return self.complete()

    def begin(self) -> None:
        """Shows the run as running and takes back whatever an earlier attempt of it wrote."""
        config, spark, store = self.config, self.spark, self.store
        delete_path(spark, store.folder("runs", config.ingestion_id, self.run_id, "end"))
        delete_path(spark, store.folder("ledger", config.ingestion_id, self.run_id, "broken"))
        row = (config.ingestion_id, self.started, None, RUN_RUNNING, self.trigger, 0, 0, 0, 0, 0, 0, None, 0, [],
               config.table, self.run_id)
        store.append("runs", config.ingestion_id, self.run_id, "start", spark.createDataFrame([row], RUN_SCHEMA))
        if writer.table_exists(spark, config.table):
            writer.drop_run(spark, config.table, self.run_id)
        store.reset_stale(config.ingestion_id, self.run_id, self.started, config.stale_after_hours)

    def fix_plan(self, manifest: DataFrame | None) -> DataFrame:
        """Plans once and stores it: later steps and a replay see the same files whatever lands meanwhile."""
        config, store = self.config, self.store
        if store.has_plan(config.ingestion_id, self.run_id):
            return store.planned(config.ingestion_id, self.run_id)
        if manifest is None:
            manifest = self.listed()
        if "ingestion_id" not in manifest.columns:
            manifest = manifest.withColumn("ingestion_id", F.lit(config.ingestion_id))
        state = store.state(config.ingestion_id)
        todo = planning.plan(manifest, state, config.plan_mode)
        todo = planning.due(todo, state, F.lit(self.started), config.max_retries, config.retry_backoff)
        todo = planning.prefilter(
            todo, self.started, config.max_file_size_gb, config.exclude_pattern, config.max_file_age_days
        )
        todo = self.in_backfill(todo)
        approved = (F.col("previous_status") == PENDING) & (F.col("previous_error") == SCHEMA_ERROR)
        at = F.lit(self.started)
        skip = F.col("skip_reason").isNotNull()
        rows = todo.select(
            "ingestion_id", "file_path", F.col("size_bytes").alias("file_size_bytes"),
            F.col("modified_at").cast("timestamp").alias("file_modified_at"), F.col("etag").alias("file_etag"),
            F.when(skip, SKIPPED).otherwise(PROCESSING).alias("status"),
            at.alias("discovered_at"), at.alias("processing_started_at"),
            F.when(skip, at).alias("processed_at"),
            F.lit(None).cast("bigint").alias("records_ingested"), F.lit(None).cast("bigint").alias("bytes_read"),
            F.lit(None).cast("bigint").alias("processing_duration_ms"),
            F.col("skip_reason").alias("error_message"),
            F.when(skip, "PreFilter").when(approved, SCHEMA_APPROVED).alias("error_type"),
            F.col("next_retry_count").alias("retry_count"),
            F.lit(None).cast("int").alias("schema_version"),
            at.alias("event_time"), F.lit(0).alias("seq"),
        )
        store.append("ledger", config.ingestion_id, self.run_id, "plan", rows)
        return store.planned(config.ingestion_id, self.run_id)

    def in_backfill(self, todo: DataFrame) -> DataFrame:
        """Of files never seen before only those that the backfill mode takes."""
        config = self.config
        if config.backfill_mode == "include_existing":
            return todo
        bounds = (config.activated_at, None) if config.backfill_mode == "new_only" else (config.backfill_start, config.backfill_end)
        taken = F.lit(True)
        if bounds[0] is not None:
            taken = taken & (F.col("modified_at") >= F.lit(bounds[0]))
        if bounds[1] is not None:
            taken = taken & (F.col("modified_at") < F.lit(bounds[1]))
        return todo.filter((F.col("action") != planning.NEW) | taken)

    def listed(self) -> DataFrame:
        """The manifest of the source, of the day folders looked back at, or of the files modified lately."""
        config = self.config
        roots = [config.source_path]
        if config.lookback_days is not None:
            days = manifests.day_roots(config.source_path, self.started - timedelta(days=config.lookback_days), self.started)
            roots = [r for r in days if path_exists(self.spark, r)]
        if not roots:
            return self.spark.createDataFrame([], MANIFEST_SCHEMA)
        return manifests.discover(
            self.spark, *roots, pattern=config.file_pattern, match=config.match, since=config.since, max_files=config.max_files
        )

    def paths(self, table: DataFrame, k: int, scans: int, column: str = "file_path") -> list[str]:
        mine = table if scans == 1 else table.filter(F.pmod(F.xxhash64(column), F.lit(scans)) == k)
        return [r[0] for r in mine.select(column).collect()]

    def judge(self, todo: DataFrame, scans: int) -> None:
        """One decision for all files of the run: verdicts, and how each of the others is read.

        Stored are a row per file (``judged``) and a row per distinct schema (``groups``). Schemas are parsed, held against
        the table and folded in tasks; the columns of the union alone come to the driver.
        """
        config, spark = self.config, self.spark
        filled = todo.filter("file_size_bytes > 0")
        flagged = todo.filter(F.col("error_type") == SCHEMA_APPROVED).select(F.col("file_path").alias(SOURCE_FILE), F.lit(True).alias("_ok"))
        table = user_columns(spark.table(writer.newest(spark, config.table)).schema) if writer.table_exists(spark, config.table) else None
        given = config.explicit_schema
        if given is None and config.schema_sample_files:
            files = filled.select(F.col("file_path").alias("path"), F.col("file_size_bytes").alias("size_bytes"))
            given = sample_schema(files, config.schema_sample_files)
            # What the table has already is looked for in the files that were not sampled, too.
            given = given if table is None else extended(table, given)
        if given is not None:
            nothing = [F.lit(None).cast("string").alias(c) for c in ("verdict", "error_type", "message")]
            probe = filled.select(F.col("file_path").alias(SOURCE_FILE), F.lit(given.json()).alias("found"), *nothing)
        else:
            for k in range(scans):
                paths = self.paths(filled, k, scans)
                if paths:
                    self.write_probe(paths, k)
                else:
                    spark.createDataFrame([], PROBE_SCHEMA).write.mode("overwrite").parquet(self.probe_path(k))
            probe = spark.read.schema(PROBE_SCHEMA).parquet(*[self.probe_path(k) for k in range(scans)])
        if self.approved:
            probe = probe.join(flagged, SOURCE_FILE, "left").withColumn("approved", F.coalesce("_ok", F.lit(False))).drop("_ok")
        else:
            probe = probe.withColumn("approved", F.lit(False))
        good = probe.filter("error_type IS NULL AND found IS NOT NULL AND found NOT IN ('', 'VOID')")
        groups = good.groupBy("found", "approved").agg(F.min(SOURCE_FILE).alias("first"))
        groups.mapInPandas(describe(config, table), GROUP_SCHEMA).write.mode("overwrite").parquet(self.groups_path())
        groups = spark.read.schema(GROUP_SCHEMA).parquet(self.groups_path())
        some = groups.filter("problem IS NULL").select("nodes").limit(2).collect()
        if len(some) > 1:
            groups = self.without_clashes(groups, table)
            whole = self.union_of(groups.filter("problem IS NULL"))
        else:  # one schema is its own union
            whole = rebuilt([(n.path, n.name, n.kind) for row in some for n in row.nodes])
        if whole.fields:
            self.target_schema(whole)
        if config.on_new_columns == "approve" and table is not None:
            waiting = self.union_of(groups.filter(F.startswith("problem", F.lit(AWAITING))))
            if waiting.fields:
                self.record_version([], extended(table, typed(waiting)), PENDING_APPROVAL, table, pending=True)
        keyed = groups.select("found", "approved", "problem", F.lit(None).cast("string").alias("key"))
        if whole.fields:
            self.whole = whole
            now = user_columns(spark.table(writer.newest(spark, config.table)).schema)
            keyed = groups.select("found", "approved", "problem").mapInPandas(
                reading_keys(config.format, now), "found string, approved boolean, problem string, key string"
            )
        held = F.col("problem").isNotNull()
        judged = probe.join(keyed.withColumn("_known", F.lit(True)), ["found", "approved"], "left").select(
            SOURCE_FILE, F.when(~held, F.col("key")).alias("key"),
            F.coalesce("verdict", F.when(held, SKIPPED)).alias("verdict"),
            F.coalesce("error_type", F.when(held, SCHEMA_ERROR)).alias("error_type"),
            F.coalesce("message", F.concat(F.lit("Schema mismatch: "), F.col("problem"))).alias("message"),
        )
        judged.write.mode("overwrite").parquet(self.judged_path())

    def union_of(self, groups: DataFrame) -> T.StructType:
        rows = groups.select("first", F.explode("nodes").alias("n")).select("first", "n.*")
        return merged_schema(rows, first_wins=self.config.format == "csv")

    def without_clashes(self, groups: DataFrame, table: T.StructType | None) -> DataFrame:
        """Marks groups whose type of a new column has nothing but text in common with that of an earlier group.

        The first accepted group in key order sets a column's type. Only groups that clash with one that clashes
        with none are marked in a round, so each later round sees the types as if the marked ones had never been there.
        """
        if self.config.format == "csv" or self.config.rescue_column:
            # A CSV value that does not fit the column's type is a bad record of its file alone; others are rescued.
            return groups
        known = [f".{f.name.lower()}" for f in table.fields] if table is not None else []
        while True:
            live = groups.filter("problem IS NULL").select(F.struct("first", "found", "approved").alias("g"), F.explode("nodes").alias("n"))
            top = live.filter((F.size("n.path") == 1) & (F.col("n.kind") != "void") & ~F.col("n.path")[0].isin(known))
            top = top.select("g", F.col("n.path")[0].alias("column"), F.col("n.kind").alias("kind"), F.col("n.name").alias("name"))
            setters = top.groupBy("column").agg(F.min("g").alias("by"), F.min_by("kind", "g").alias("set"))
            simple = ~F.col("kind").isin("struct", "array") & ~F.startswith("kind", F.lit("map<"))
            fine = (F.col("kind") == F.col("set")) | (width(F.col("kind")).isNotNull() & width(F.col("set")).isNotNull()) | ((F.col("set") == "string") & simple)
            told = F.format_string("%s: %s does not fit %s", "name", "kind", "set")
            clashing = top.join(setters, "column").filter(~fine & ~F.col("g.approved")).select("g", "by", told.alias("why"))
            clashing = materialize(clashing, "clashes")
            sure = clashing.join(clashing.select(F.col("g").alias("by")).distinct(), "by", "left_anti")
            reasons = sure.groupBy("g.found", "g.approved").agg(F.array_join(F.sort_array(F.collect_set("why")), "; ").alias("why"))
            if clashing.isEmpty():
                return groups
            groups = groups.join(reasons, ["found", "approved"], "left").withColumn("problem", F.coalesce("problem", "why")).drop("why")

    def groups_path(self) -> str:
        return f"{self.store.root}/probes/run_id={self.run_id}/groups"

    def judged_path(self) -> str:
        return f"{self.store.root}/probes/run_id={self.run_id}/judged"

    def probe_path(self, k: int) -> str:
        return f"{self.store.root}/probes/run_id={self.run_id}/part={k}"

    def verdict_path(self, k: int) -> str:
        return f"{self.store.root}/verdicts/run_id={self.run_id}/part={k}"

    def write_probe(self, paths: list[str], k: int) -> None:
        """Stores the probe of one scan; files that break it are found in one job and probed no more."""
        target = self.probe_path(k)
        try:
            self.probe(paths).write.mode("overwrite").parquet(target)
        except Exception:
            bad = self.unreadable(paths)
            if not bad:
                raise
            rows = self.spark.createDataFrame([(p, None, FAILED, CORRUPT_ERROR, m) for p, m in bad.items()], PROBE_SCHEMA)
            left = [p for p in paths if p not in bad]
            if left:
                rows = rows.unionByName(self.probe(left))
            rows.write.mode("overwrite").parquet(target)

    def unreadable(self, paths: list[str]) -> dict[str, str]:
        """Of the files that can't be read to their end, why; all are read once, in tasks."""
        files = self.spark.createDataFrame([(p,) for p in paths], "path string")
        files = files.repartition(min(len(paths), 4 * self.spark.sparkContext.defaultParallelism))
        found = files.mapInPandas(read_through(self.config.format), "path string, message string")
        return {r.path: r.message for r in found.collect()}

    def probe(self, paths: list[str]) -> DataFrame:
        """Per file: its schema, or why it cannot be loaded."""
        config, spark = self.config, self.spark
        if config.format == "json":
            seen = json_file_schemas(read_lines(spark, paths, config.format_options))
            some = F.col("malformed_count") > 0
            if config.on_bad_records != "fail_file":
                some = (F.col("malformed_count") == F.col("record_count")) & (F.col("record_count") > 0)
            return seen.select(
                SOURCE_FILE, F.col("variant_schema").alias("found"), F.when(some, FAILED).alias("verdict"),
                F.when(some, MALFORMED_ERROR).alias("error_type"),
                F.when(some, F.format_string("%d of %d records malformed", "malformed_count", "record_count")).alias("message"),
            )
        if config.format in ("parquet", "orc"):
            files = spark.createDataFrame([(p,) for p in paths], f"{SOURCE_FILE} string")
            files = files.repartition(min(len(paths), 4 * spark.sparkContext.defaultParallelism))
            return files.mapInPandas(footer_schemas(config.format, FAILED, CORRUPT_ERROR), PROBE_SCHEMA)
        if config.format == "csv" and str(config.format_options.get("header", "")).lower() == "true":
            # A header's types are inferred once, from all files that have it; files meet their header by a join.
            heads = materialize(csv_headers(spark, paths, config.format_options), "headers")
            batches = [(r.header, [x[0] for x in heads.filter(F.col("header").eqNullSafe(F.lit(r.header))).select(SOURCE_FILE).collect()]) for r in heads.select("header").distinct().collect()]
        else:
            heads = spark.createDataFrame([(p,) for p in paths], f"{SOURCE_FILE} string").withColumn("header", F.lit(""))
            batches = [("", paths)]
        rows = []
        for header, batch in batches:
            try:
                text = scan(spark, config.format, batch, options=config.format_options, literal_paths=True).schema.json()
                rows.append((header, text, None, None, None))
            except Exception as e:
                if "UNABLE_TO_INFER_SCHEMA" not in str(e):
                    raise
                rows.append((header, None, FAILED, CORRUPT_ERROR, "no readable schema"))
        told = spark.createDataFrame(rows, f"header string, found string, {VERDICT_COLUMNS}")
        return heads.join(told, heads["header"].eqNullSafe(told["header"])).select(SOURCE_FILE, *told.columns[1:])

    def load_part(self, k: int, scans: int) -> None:
        judged = self.spark.read.schema(f"{SOURCE_FILE} string, key string, {VERDICT_COLUMNS}").parquet(self.judged_path())
        mine = judged if scans == 1 else judged.filter(F.pmod(F.xxhash64(SOURCE_FILE), F.lit(scans)) == k)
        verdicts = mine.filter("verdict IS NOT NULL").select(SOURCE_FILE, "verdict", "error_type", "message")
        ready = mine.filter("verdict IS NULL AND key IS NOT NULL")
        # Of each file its path and a number come to the driver; the few ways of reading come once.
        keys = {r.n: r.key for r in ready.select("key", F.xxhash64("key").alias("n")).distinct().collect()}
        by_key: dict[int, list[str]] = {n: [] for n in keys}
        for r in ready.select(SOURCE_FILE, F.xxhash64("key").alias("n")).collect():
            by_key[r.n].append(r[SOURCE_FILE])
        groups = [(by_key[n], keys[n]) for n in sorted(keys, key=keys.get)]
        if groups:
            verdicts = verdicts.unionByName(self.write_groups(groups, k))
        verdicts.write.mode("overwrite").parquet(self.verdict_path(k))

    def target_schema(self, found: T.StructType) -> None:
        """Creates or evolves the table for the found columns."""
        config, spark = self.config, self.spark
        into = found
        if config.transforms:
            into = transforms.apply(spark.createDataFrame([], typed(found)), list(config.transforms)).schema
        if config.rescue_column:
            into = T.StructType([*into.fields, T.StructField(config.rescue_column, T.StringType())])
        if not writer.table_exists(spark, config.table):
            writer.create_table(spark, config.table, typed(into), config.partition_columns, config.location)
            self.record_version([], typed(into), "initial")
            return
        name = writer.newest(spark, config.table)
        before = user_columns(spark.table(name).schema)
        # With steps in between, only whole columns can be told apart.
        # A CSV value that does not fit is a bad record; its column keeps its type.
        closed = config.transforms or config.format == "csv" or not (config.evolution_enabled or self.approved)
        now = before if closed else typed(extended(before, into, promote=True))
        kept = T.StructType([f for f in now.fields if f.name.lower() in {b.name.lower() for b in before.fields}])
        changed = kept.simpleString() != before.simpleString()
        if not config.evolution_enabled and not changed:
            return
        fresh = new_columns(before, typed(into)) if config.evolution_enabled else []
        if changed or (fresh and config.on_new_columns == "version_table"):
            defaults = {f.name.lower(): f.metadata for f in before.fields}
            fields = [T.StructField(f.name, f.dataType, True, defaults.get(f.name.lower())) for f in kept.fields]
            writer.open_generation(spark, config.table, T.StructType([*fields, *fresh]), config.partition_columns, config.location)
            how = "type_promotion" if misfits(before, into) else "nested_merge" if changed else "version_table"
        elif fresh:
            filling = config.on_new_columns == "backfill_default"
            writer.evolve_table(spark, config.table, typed(into), config.column_defaults if filling else None)
            how = "backfill_default" if filling else "auto_merge"
        else:
            return
        self.added += [f.name for f in fresh]
        self.record_version(fresh, user_columns(spark.table(writer.newest(spark, config.table)).schema), how, before)

    def read_schema(self, key: str) -> T.StructType:
        """The columns in the files' own spelling, with the table's types, or the files' where a reader can't turn them."""
        config = self.config
        table = {f.name.lower(): f for f in user_columns(self.spark.table(writer.newest(self.spark, config.table)).schema).fields}
        found = schema_of(key) if config.format == "csv" else self.whole
        odd, own = ({}, {}) if config.format == "csv" else json.loads(key)
        touched = {name.lower() for kind, arg in config.transforms if kind in ("cast", "rename", "parse_dates") for name in transforms.names(arg)}
        fields = []
        for f in found.fields:
            t = table.get(f.name.lower())
            known = t is not None and f.name.lower() not in touched
            if t is None and not config.evolution_enabled and config.format != "csv" and not config.transforms:
                continue
            kind = T._parse_json_datatype(own[f.name.lower()]) if f.name.lower() in own else t.dataType if known else typed(f.dataType)
            fields.append(T.StructField(odd.get(f.name.lower(), t.name if t is not None else f.name), kind, True))
        return T.StructType(fields)

    def read_group(self, paths: list[str], key: str) -> DataFrame:
        config, spark = self.config, self.spark
        schema = self.read_schema(key)
        if config.rescue_column:
            rows = rescue(read_lines(spark, paths, config.format_options), schema, into=config.rescue_column, corrupt=CORRUPT)
        else:
            rows = scan_permissive(spark, config.format, paths, schema, config.format_options)
        target = spark.table(writer.newest(spark, config.table)).schema
        table = {f.name.lower(): f.name for f in target.fields}
        rows = rows.withColumnsRenamed({c: table[c.lower()] for c in rows.columns if table.get(c.lower(), c) != c})
        if config.transforms:
            service = [c for c in (SOURCE_FILE, CORRUPT, config.rescue_column) if c in rows.columns]
            steps = [(k, [*arg, *service]) if k == "select" else (k, arg) for k, arg in config.transforms]
            rows = transforms.apply(rows, steps)
        elif config.format in ("parquet", "orc"):
            have = {c.lower() for c in rows.columns}
            rows = reshaped_rows(rows, T.StructType([f for f in target.fields if f.name.lower() in have]))
        for f in target.fields:
            default = writer.default_of(f)
            if default:
                rows = rows.withColumn(f.name, F.coalesce(F.col(f.name), F.expr(default)) if f.name in rows.columns else F.expr(default))
        return rows

    def latest_version(self) -> int | None:
        decided = self.store.read("schema_versions", self.config.ingestion_id).filter(F.col("resolution_type") != PENDING_APPROVAL)
        return decided.agg(F.max("version")).first()[0]

    def record_version(self, added, schema: T.StructType, resolution: str, before=None, pending: bool = False) -> None:
        config = self.config
        version = (self.store.read("schema_versions", config.ingestion_id).agg(F.max("version")).first()[0] or 0) + 1
        summary = "; ".join(f"{c.change_type} {c.column_name}" for c in diff(before or T.StructType([]), schema))
        now = self.now()
        row = (config.ingestion_id, version, now, schema.json(), resolution, None if pending else now, summary, self.run_id)
        rows = self.spark.createDataFrame([row], SCHEMA_VERSION_SCHEMA)
        self.store.append("schema_versions", config.ingestion_id, self.run_id, f"v{version}", rows)
        if not pending:
            self.new_versions.append(version)

    def write_groups(self, groups, k: int) -> DataFrame:
        """Reads and writes all groups of one scan.

        If that fails, one more job reads the files to their ends and tells all that can't be; the rest is written again.
        Only a file that this job can read and Spark can't is known from Spark's error.
        """
        config, spark = self.config, self.spark
        failed: dict[str, str] = {}
        looked = False
        while True:
            frames = []
            for paths, key in groups:
                left = [p for p in paths if p not in failed]
                if left:
                    frames.append(self.read_group(left, key))
            if not frames:
                break
            rows = frames[0]
            for f in frames[1:]:
                rows = rows.unionByName(f, allowMissingColumns=True)
            table = {f.name for f in spark.table(writer.newest(spark, config.table)).schema.fields}
            rows = rows.select(*[c for c in rows.columns if c in table])
            try:
                writer.write_part(rows, config.table, self.run_id, k, config.partition_columns, config.cluster_columns)
                break
            except Exception as e:
                known = {p for paths, _ in groups for p in paths}
                if not looked:
                    looked = True
                    failed = self.unreadable(sorted(known))
                    if failed:
                        continue
                path = unreadable_path(e)
                if path is None or path not in known or path in failed:
                    raise
                failed[path] = str(e)
        out = [(p, FAILED, CORRUPT_ERROR, m) for p, m in failed.items()]
        verdicts = spark.createDataFrame(out, VERDICT_SCHEMA)
        if config.on_bad_records == "fail_file":
            bad = (
                spark.table(writer.newest(spark, config.table))
                .filter((F.col(writer.RUN_ID) == self.run_id) & (F.col(writer.PART) == -1 - k))
                .groupBy(SOURCE_FILE).agg(F.count("*").alias("n"))
            )
            if not bad.isEmpty():
                writer.retract_files(spark, config.table, self.run_id, k, bad)
                verdicts = verdicts.unionByName(bad.select(
                    SOURCE_FILE, F.lit(FAILED).alias("verdict"), F.lit(MALFORMED_ERROR).alias("error_type"),
                    F.format_string("%d records do not fit the schema", "n").alias("message"),
                ))
        return verdicts

    def finish_files(self, files: DataFrame, scans: int) -> None:
        config, spark, store = self.config, self.spark, self.store
        verdicts = spark.read.schema(VERDICT_SCHEMA).parquet(*[self.verdict_path(k) for k in range(scans)])
        inflight = files.filter(F.col("status") == PROCESSING)
        if writer.table_exists(spark, config.table):
            counts = writer.file_counts(spark, config.table, self.run_id)
        else:
            counts = spark.createDataFrame([], f"{SOURCE_FILE} string, good_count bigint, bad_count bigint")
        judged = (
            inflight.join(verdicts.withColumnsRenamed({SOURCE_FILE: "file_path", "error_type": "found_type"}), "file_path", "left")
            .join(counts.withColumnRenamed(SOURCE_FILE, "file_path"), "file_path", "left")
        )
        version = self.new_versions[-1] if self.new_versions else self.latest_version()
        events = finished_events(
            judged.withColumn("schema_version", F.lit(version).cast("int")),
            F.lit(self.now()),
            F.coalesce("verdict", F.lit(SUCCESS)),
            F.col("good_count"),
            F.col("found_type"),
            F.col("message"),
        )
        store.append("ledger", config.ingestion_id, self.run_id, "done", events)
        for v in self.new_versions:
            touched = events.filter(F.col("status") == SUCCESS).select(
                "ingestion_id", F.lit(v).alias("version"), "file_path", F.lit(self.run_id).alias("run_id")
            )
            store.append("schema_files", config.ingestion_id, self.run_id, f"v{v}", touched)

    def complete(self) -> RunResult:
        config, spark, store = self.config, self.spark, self.store
        mine = store.events(config.ingestion_id, self.run_id)
        done = mine.filter(F.col("status") != PROCESSING)
        m = run_metrics(done).first()
        success, failed, skipped, records, bytes_read = (m[0], m[1], m[2], m[3], m[4]) if m else (0, 0, 0, 0, 0)
        written = 0
        if records and writer.table_exists(spark, config.table):
            written = writer.bytes_written(spark, config.table, self.run_id).first()[0]
        status = run_status(success, failed)
        errors = [
            (r.file_path, r.error_type, r.error_message, r.processed_at)
            for r in (done.filter(F.col("status") == FAILED).orderBy("file_path").limit(ERRORS_IN_RUN_ROW).collect() if failed else [])
        ]
        _write_run(spark, store, config, self.run_id, self.started, self.now(), self.trigger, status,
                   success, failed, skipped, records, bytes_read, written, errors)
        if config.write_mode != "append" and success and (records or config.allow_empty_overwrite):
            self.publish()
        store.fold_if_due()
        low = config.row_count_threshold is not None and records < config.row_count_threshold
        return RunResult(self.run_id, status, success, failed, skipped, records, bytes_read, written, tuple(self.added), low)

    def publish(self) -> None:
        """Modes other than append turn the committed rows into a new snapshot of the published table."""
        publish_snapshot(self.spark, self.config, self.store, self.run_id)


def describe(config: IngestionConfig, table: T.StructType | None):
    """For tasks: the nodes of each schema, and why its files can't be loaded into the table."""
    text, csv, rescuing = table.json() if table is not None else None, config.format == "csv", bool(config.rescue_column)
    holding, auto = config.on_new_columns == "approve" and table is not None, config.type_promotion == "auto"

    def one(found: str, approved: bool, known: T.StructType | None) -> tuple[str | None, list]:
        s = schema_of(found)
        if s is None:
            return f"records are not objects: {found}", []
        problems = doubled_names(s)
        if known is not None and not csv and not approved:
            wrong = misfits(known, s, widen=auto)
            if rescuing and wrong:
                bad = {w.split(":")[0].split(".")[0].split("[")[0].split("{")[0].lower() for w in wrong}
                s = T.StructType([f for f in s.fields if f.name.lower() not in bad])
            else:
                problems += wrong
        if holding and not approved and not problems:
            new = [f.name for f in new_columns(known, s)] + nested_additions(known, s)
            if new:
                problems = [AWAITING + ", ".join(new)]
        return "; ".join(problems) or None, nodes(s)

    def run(batches):
        import pandas as pd

        known = T.StructType.fromJson(json.loads(text)) if text else None
        for batch in batches:
            made = [one(f, a, known) for f, a in zip(batch["found"], batch["approved"])]
            rows = [[dict(zip(("path", "name", "kind", "position"), n)) for n in m[1]] for m in made]
            yield pd.DataFrame({"found": batch["found"], "approved": batch["approved"], "first": batch["first"], "problem": [m[0] for m in made], "nodes": rows})

    return run


def reading_keys(fmt: str, table: T.StructType):
    """For tasks: how the files of a schema are read: columns with another spelling, and types a reader can't turn."""
    text = table.json()

    def key(found: str, known: dict) -> str:
        if fmt == "csv":
            return found
        s = schema_of(found)
        if s is None:
            return None
        odd = {f.name.lower(): f.name for f in s.fields if f.name.lower() in known and known[f.name.lower()].name != f.name}
        own = {}
        if fmt in ("parquet", "orc"):
            own = {f.name.lower(): f.dataType.jsonValue() for f in s.fields if f.name.lower() in known and known[f.name.lower()].dataType != f.dataType}
        return json.dumps([odd, own], sort_keys=True)

    def run(batches):
        known = {f.name.lower(): f for f in T.StructType.fromJson(json.loads(text)).fields}
        for batch in batches:
            yield batch.assign(key=[key(x, known) for x in batch["found"]])

    return run


def run_status(success: int, failed: int) -> str:
    if failed and success:
        return RUN_PARTIAL
    return RUN_FAILED if failed else RUN_SUCCESS


def run_metrics(events: DataFrame, *by: str) -> DataFrame:
    """Per-run counts and sums over terminal file events."""
    ok = F.col("status") == SUCCESS
    return events.groupBy(*by).agg(
        F.count_if(ok).alias("success_count"),
        F.count_if(F.col("status") == FAILED).alias("failed_count"),
        F.count_if(F.col("status") == SKIPPED).alias("skipped_count"),
        F.coalesce(F.sum(F.when(ok, F.col("records_ingested"))), F.lit(0)).cast("bigint").alias("records_ingested"),
        F.coalesce(F.sum(F.when(ok, F.col("bytes_read"))), F.lit(0)).cast("bigint").alias("bytes_read"),
    )


def unreadable_path(e: Exception) -> str | None:
    """Path named by Spark's unreadable-file error."""
    found = re.search(r"while reading file ([^\s]+?)\.? ", str(e)) or re.search(r"(file:/[^\s]+?)\.?[\s,]", str(e))
    return re.sub(r"^file:/+", "file:/", found.group(1)) if found else None


def _write_run(spark, store, config, run_id, started, ended, trigger, status, success=0, failed=0, skipped=0,
               records=0, bytes_read=0, written=0, errors=None) -> None:
    row = (config.ingestion_id, started, ended, status, trigger, success + failed, failed, skipped, records,
           bytes_read, written, int((ended - started).total_seconds()), failed, errors or [], config.table, run_id)
    store.append("runs", config.ingestion_id, run_id, "end", spark.createDataFrame([row], RUN_SCHEMA))


def publish_snapshot(spark, config: IngestionConfig, store: StateStore, run_id: str) -> None:
    """``<table>_current``: the table as overwrite or merge would leave it after this run."""
    name = published_name(config)
    committed = writer.committed(spark, config.table, store, config.ingestion_id, service_columns=True)
    mine = committed.filter(F.col(writer.RUN_ID) == run_id)
    fresh = mine.drop(*writer.SERVICE_COLUMNS)
    there = writer.table_exists(spark, name)
    if config.write_mode == "merge":
        keys, order = list(config.merge_keys), list(config.merge_order)
        if not order:
            # The newest file wins, then the last path; both are looked up per file, not stored per row.
            age = store.planned(config.ingestion_id, run_id).select(F.col("file_path").alias(SOURCE_FILE), F.col("file_modified_at").alias("_modified"))
            fresh = mine.join(age, SOURCE_FILE, "left").withColumn("_file", F.col(SOURCE_FILE)).drop(*writer.SERVICE_COLUMNS)
            order = ["_modified", "_file"]
        Buckets(spark, name, published_location(spark, config), keys).merge(dedupe(fresh, keys, order).drop("_modified", "_file"))
        return
    if config.write_mode == "overwrite_partitions" and there:
        by = list(config.partition_columns)
        kept = spark.table(name).join(fresh.select(*by).distinct(), by, "left_anti")
        rows = kept.unionByName(fresh, allowMissingColumns=True)
    else:
        rows = fresh
    swap_snapshot(rows, name, published_location(spark, config))


def published_name(config: IngestionConfig) -> str:
    return f"{config.table}_current"


def published_location(spark: SparkSession, config: IngestionConfig) -> str:
    """Beside the table's own files."""
    return (config.location or writer.table_location(spark, config.table)).rstrip("/") + "_current"
