"""Ledger, runs and schema history as parquet folders in shared storage.

Deltas
    Each append goes to its own ``<table>/i=<ingestion>/r=<run>/phase=<phase>`` folder and replaces it when repeated: a
    replayed run leaves one set of events and concurrent runs never share an output folder.

Base
    ``fold`` merges the deltas of ended runs into the base, ``base/<table>/g=<generation>/b=<bucket>``: one row per key
    in buckets of the key's hash, sorted by key. Only buckets that a delta touches are rewritten. Of a file the base also
    has its version: the last run that loaded it, and how often it was loaded.

Sums
    A fold of the ledger also writes hourly sums of each bucket that it rewrites, ``sums/g=<generation>``: each task sums up
    what it reads, so an hour may have several rows. ``rolled`` merges them to days and weeks; of the files that deltas tell
    of the old hour is taken out and the new one put in.

Pointer
    ``pointer/<table>/<number>`` names the generation of each bucket. It is written whole under a new number, readers follow
    the largest, and of two folds at once the second finds its number taken and gives up. Folded deltas get a
    mark below ``folded`` after the pointer, so a reader in between sees them twice, which changes nothing: the
    state is a maximum per key. They are deleted by the next fold, with the generations no pointer names, so readers
    that planned before have a whole fold's time. What is appended meanwhile is a delta like any other.
"""

from __future__ import annotations

import functools
import json
import uuid
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark.functions.expressions import as_column, first_per_key, settled
from tidemark.model import (
    CLEARED, FAILED, LEDGER_SCHEMA, PROCESSING, RUN_PARTIAL, RUN_RUNNING, RUN_SCHEMA, RUN_SUCCESS, SCHEMA_FILE_SCHEMA, SCHEMA_VERSION_SCHEMA, SUCCESS,
)
from tidemark.operators.analytics import SUMS, hourly_parts, merged_sums, rollup
from tidemark.operators.ledger import KEY, current_state, stale_reset, transition, with_age
from tidemark.workspace import claim_file, delete_path, folder_bytes, list_folder, make_folder, materialize, path_exists, read_text

FOLDERS = [T.StructField(n, T.StringType()) for n in ("i", "r", "phase")]
# Which event of a file is the latest; the later columns only make ties come out the same in every read.
ORDER = ("event_time", "seq", "run_id", "file_size_bytes", "status")
# What a file row gives to the sums.
COUNTED = ("status", "processed_at", "records_ingested", "bytes_read")
VERSION = T.StructType([
    T.StructField("live_run_id", T.StringType()),
    T.StructField("live_time", T.TimestampType()),
    T.StructField("live_seq", T.IntegerType()),
    T.StructField("loads", T.LongType()),
])
# Rows that a bucket may reach before the base is dealt anew into more of them.
BUCKET_ROWS = 2_000_000
# Share of the base's bytes from which on deltas are ranked with the whole base in place of looking their files up in it.
DELTA_SHARE = 1 / 8
# Bytes of base and deltas from which on their keys' hashes are counted first, and only rows that share one are ranked with
# others; in a pass the others that leave go to the archive at once.
COUNTED_BYTES = 32 << 20
# Hashes that a task may hold for that; with more of them all rows are ranked.
SHARED_HASHES = 2_000_000
# Rows that a task of a fold may get before its rows are dealt to more tasks.
TASK_ROWS = 500_000
# Buckets that one job moves from generation to generation.
MOVED_BUCKETS = 64
# Whole rows are written several times on their way, so the store's files are kept small.
CODEC = "zstd"


class StateStore:
    TABLES = {
        "ledger": LEDGER_SCHEMA,
        "runs": RUN_SCHEMA,
        "schema_versions": SCHEMA_VERSION_SCHEMA,
        "schema_files": SCHEMA_FILE_SCHEMA,
    }
    KEYS = {"ledger": KEY, "runs": ("ingestion_id", "run_id")}

    def __init__(self, spark: SparkSession, root: str, fold_after: int | None = 64):
        """``fold_after``: how many run folders may wait before a run that ends folds them; None leaves it to the caller."""
        self.spark = spark
        self.root = root.rstrip("/")
        self.fold_after = fold_after
        # A table exists as an empty folder from the start, so readers need no special first case.
        for name in self.TABLES:
            make_folder(spark, f"{self.root}/{name}")

    # -- deltas -----------------------------------------------------------------------------------------------

    def folder(self, table: str, ingestion_id: str | None = None, run_id: str | None = None, phase: str | None = None) -> str:
        parts = [self.root, table]
        for name, value in (("i", ingestion_id), ("r", run_id), ("phase", phase)):
            if value is not None:
                parts.append(f"{name}={quote(value, safe='')}")
        return "/".join(parts)

    def append(self, table: str, ingestion_id: str, run_id: str, phase: str, rows: DataFrame) -> None:
        columns = [f.name for f in self.TABLES[table].fields]
        if "run_id" not in rows.columns:
            rows = rows.withColumn("run_id", F.lit(run_id))
        rows.select(*columns).write.mode("overwrite").option("compression", CODEC).parquet(self.folder(table, ingestion_id, run_id, phase))
        mark = self.mark(table, self.folder(table, ingestion_id, run_id))
        if path_exists(self.spark, mark):
            # A run that was folded is written again: all its events count as new once more.
            delete_path(self.spark, mark)

    def read(self, table: str, ingestion_id: str | None = None, run_id: str | None = None, phase: str | None = None) -> DataFrame:
        """Rows as they were appended, of one ingestion, one run or one phase; only that folder is listed and read."""
        path = self.folder(table, ingestion_id, run_id, phase)
        return self._read(table, [path] if path_exists(self.spark, path) else [])

    def _read(self, table: str, folders: list[str]) -> DataFrame:
        schema = self.TABLES[table]
        if not folders:
            return self.spark.createDataFrame([], schema)
        found = self.spark.read.schema(T.StructType([*schema.fields, *FOLDERS])).option("basePath", self.folder(table))
        return found.parquet(*folders).select(*[f.name for f in schema.fields])

    def mark(self, table: str, folder: str) -> str:
        return f"{self.root}/folded/{table}/{folder.removeprefix(f'{self.root}/{table}/')}"

    def delta_folders(self, table: str, ingestion_id: str | None = None) -> list[str]:
        """Run folders that are not in the base yet."""
        top = [self.folder(table, ingestion_id)] if ingestion_id is not None else [f"{self.folder(table)}/{name}" for name in self._names(self.folder(table))]
        out = []
        for folder in top:
            runs = self._names(folder)
            done = set(self._names(self.mark(table, folder))) if runs else set()
            out += [f"{folder}/{r}" for r in runs if r not in done]
        return out

    def _names(self, folder: str) -> list[str]:
        return sorted(p.rstrip("/").rsplit("/", 1)[-1] for p in list_folder(self.spark, folder))

    def has_plan(self, ingestion_id: str, run_id: str) -> bool:
        return path_exists(self.spark, self.folder("ledger", ingestion_id, run_id, "plan") + "/_SUCCESS")

    def planned(self, ingestion_id: str, run_id: str) -> DataFrame:
        """The files a run has fixed for itself; its other phases may be replaced meanwhile."""
        return self.read("ledger", ingestion_id, run_id, "plan")

    def events(self, ingestion_id: str | None = None, run_id: str | None = None) -> DataFrame:
        """Events as appended; of folded runs they are there until the next fold."""
        return self.read("ledger", ingestion_id, run_id)

    # -- base ---------------------------------------------------------------------------------------------------

    def pointer(self, table: str) -> tuple[int, dict]:
        """The number and content of the newest pointer."""
        numbers = self._names(f"{self.root}/pointer/{table}")
        if not numbers:
            return 0, {"buckets": 0, "held": {}, "folded": []}
        return int(numbers[-1]), json.loads(read_text(self.spark, f"{self.root}/pointer/{table}/{numbers[-1]}"))

    def base_schema(self, table: str) -> T.StructType:
        return T.StructType([*self.TABLES[table].fields, *(VERSION.fields if table == "ledger" else [])])

    def base(self, table: str, held: dict | None = None) -> DataFrame | None:
        """The base's rows, one per key, with their bucket ``b``."""
        held = self.pointer(table)[1]["held"] if held is None else held
        if not held:
            return None
        root, schema = f"{self.root}/base/{table}", self.base_schema(table)
        found = self.spark.read.schema(schema.add("g", T.StringType()).add("b", T.IntegerType())).option("basePath", root)
        return found.parquet(*self._held_folders(table, held)).select(*[f.name for f in self.base_schema(table).fields], "b")

    def _held_folders(self, table: str, held: dict) -> list[str]:
        return [f"{self.root}/base/{table}/g={g}/b={b}" for b, g in held.items()]

    def _bucket(self, table: str, buckets: int, *values):
        return F.pmod(F.xxhash64(*(values or self.KEYS[table])), F.lit(buckets)).cast("int")

    def _versions(self, events: DataFrame, done: DataFrame) -> DataFrame:
        """Events with the version columns: loads by runs that readers see."""
        seen = done.select(F.col("run_id").alias("_done")).distinct()
        loaded = F.col("_done").isNotNull() & (F.col("status") == SUCCESS)
        return events.join(seen, events["run_id"] == seen["_done"], "left").withColumns({
            "live_run_id": F.when(loaded, F.col("run_id")), "live_time": F.when(loaded, F.col("event_time")),
            "live_seq": F.when(loaded, F.col("seq")), "loads": F.when(loaded, 1).otherwise(0).cast("bigint"),
        }).drop("_done")

    def _merged(self, table: str, rows: DataFrame, *by: str) -> DataFrame:
        """One row per key, and per ``by``, which the key determines."""
        keys = [*by, *self.KEYS[table]]
        columns = [f.name for f in self.TABLES[table].fields if f.name not in keys]
        if table == "runs":
            latest = F.max_by(F.struct(*columns), F.struct(F.coalesce("ended_at", "started_at"), F.col("ended_at").isNotNull()))
            return rows.groupBy(*keys).agg(latest.alias("_r")).select(*keys, "_r.*").select(*self.TABLES[table].names, *by)
        live = F.struct("live_time", "live_seq", "live_run_id")
        merged = rows.groupBy(*keys).agg(
            F.max_by(F.struct(*columns), F.struct(*ORDER)).alias("_r"),
            F.max(F.when(F.col("live_run_id").isNotNull(), live)).alias("_live"), F.sum("loads").cast("bigint").alias("loads"),
        )
        return merged.select(*keys, "_r.*", "_live.*", "loads").select(*self.base_schema(table).names, *by)

    def ended(self) -> DataFrame:
        """Runs whose rows readers see."""
        return self.runs().filter(F.col("status").isin(RUN_SUCCESS, RUN_PARTIAL))

    def fold(self) -> bool:
        """Merges the deltas of ended runs into the base; False if there were none or another fold came first."""
        # The ledger first: whether a run has ended is looked up in the runs.
        ledger = self._fold("ledger")
        return self._fold("runs") or ledger

    def fold_if_due(self) -> bool:
        if self.fold_after is None or len(self.delta_folders("runs")) < self.fold_after:
            return False
        return self.fold()

    def _foldable(self, table: str) -> list[str]:
        """Folders of runs that will not write any more, and of passes that are no runs."""
        running = {(r[0], r[1]) for r in self.runs().filter(F.col("status") == RUN_RUNNING).select("ingestion_id", "run_id").collect()}
        out = []
        for folder in self.delta_folders(table):
            i, r = (unquote(x.split("=", 1)[1]) for x in folder.rsplit("/", 2)[1:])
            if (i, r) not in running:
                out.append(folder)
        return out

    def _fold(self, table: str, split=None, moved: str | None = None) -> bool:
        """``split`` gives merged rows that leave the base a negative bucket; they go to ``moved``, and all buckets are rewritten.

        It must give the same for the same rows whenever it is asked, and rows that stay must stay when it is asked again.
        """
        number, old = self.pointer(table)
        folders = self._foldable(table)
        if not folders and split is None:
            return False
        delta, base = self._read(table, folders), self.base(table, old["held"])
        size = (base.count() if base is not None else 0) + (delta.count() if folders else 0)
        buckets = max(8, 1 << max(0, -(-size // BUCKET_ROWS) - 1).bit_length())
        token, held = uuid.uuid4().hex, {}
        target = f"{self.root}/base/{table}/g={token}"
        if not folders and base is not None and old["buckets"] / 4 <= buckets <= 2 * old["buckets"]:
            # There is nothing to merge: each bucket's rows are read and written where they are.
            buckets, names = old["buckets"], list(old["held"])
            for k in range(0, len(names), MOVED_BUCKETS):
                # A scan per bucket, so a task has the rows of one bucket only and sorts no more than those.
                mine = [self.base(table, {b: old["held"][b]}) for b in names[k:k + MOVED_BUCKETS]]
                self._write_base(table, split(functools.reduce(DataFrame.unionByName, mine)).filter("b >= 0"), target)
            gone = split(base).filter("b < 0").select(*self.TABLES[table].names)
            gone.write.option("compression", CODEC).parquet(moved)
        else:
            whole = split is not None or base is None or buckets > 2 * old["buckets"]
            buckets = buckets if whole else old["buckets"]
            delta = delta.withColumn("b", self._bucket(table, buckets))
            if whole:
                mine = base.withColumn("b", self._bucket(table, buckets)) if base is not None else None
            else:
                touched = [str(r.b) for r in delta.select("b").distinct().collect()]  # at most the number of buckets
                held = {b: g for b, g in old["held"].items() if b not in touched}
                mine = self.base(table, {b: g for b, g in old["held"].items() if b in touched})
            if table == "ledger":
                # Stored first, so Spark knows how few ended runs are and need not shuffle the events to meet them.
                delta = self._versions(delta, materialize(self.ended().select("run_id").distinct(), "ended"))
            rows = delta if mine is None else mine.unionByName(delta)
            if split is not None and folder_bytes(self.spark, *folders, *self._held_folders(table, old["held"])) >= COUNTED_BYTES:
                rows = self._parted(table, rows, split, moved)
            # The only shuffle: rows are dealt by ranges of bucket and key, merged where they are and written in that order.
            merged = self._merged(table, self._dealt(table, rows, size), "b")
            self._write_base(table, merged if split is None else split(merged), target)
            if moved is not None:
                self._move_out(table, token, moved)
        for name in self._names(target):
            if name.startswith("b=") and not name.startswith("b=-"):
                held[name[2:]] = token
        now = {"buckets": buckets, "held": held, "folded": folders}
        if table == "ledger":
            fresh = {b: g for b, g in held.items() if g == token}
            if fresh:
                hourly_parts(self._counted(self.base(table, fresh), "b")).write.option("compression", CODEC).parquet(f"{self.root}/sums/g={token}")
            now["summed"] = sorted({*old.get("summed", []), token} & set(held.values()))
        if not claim_file(self.spark, f"{self.root}/pointer/{table}/{number + 1:010d}", json.dumps(now)):
            delete_path(self.spark, f"{self.root}/base/{table}/g={token}")
            if table == "ledger":
                delete_path(self.spark, f"{self.root}/sums/g={token}")
            return False
        for folder in folders:
            make_folder(self.spark, self.mark(table, folder))
        self._clean(table, number, old, now)
        return True

    def _shared(self, hashes: DataFrame) -> DataFrame | None:
        """Of a column ``_hash`` the values that come more than once, small enough to be held by each task; None if there are too many."""
        times = hashes.repartition("_hash").groupBy("_hash").count()
        shared = materialize(times.filter("count > 1").select("_hash"), "shared")
        return F.broadcast(shared) if shared.count() <= SHARED_HASHES else None

    def _parted(self, table: str, rows: DataFrame, split, moved: str) -> DataFrame:
        """What is left to be merged once the rows that leave, and that no other could be merged with, are in ``moved``."""
        hashed = rows.withColumn("_hash", F.xxhash64(*self.KEYS[table]))
        shared = self._shared(hashed.select("_hash"))
        if shared is None:
            return rows
        only = split(hashed.join(shared, "_hash", "left_anti").drop("_hash"))
        only.filter("b < 0").select(*self.TABLES[table].names).write.option("compression", CODEC).parquet(moved)
        return only.filter("b >= 0").unionByName(hashed.join(shared, "_hash", "left_semi").drop("_hash"))

    def _dealt(self, table: str, rows: DataFrame, size: int) -> DataFrame:
        """Rows by ranges of bucket and key, in so many tasks that each can sort its rows in memory."""
        by, tasks = ("b", *self.KEYS[table]), -(-size // TASK_ROWS)
        if tasks <= int(self.spark.conf.get("spark.sql.shuffle.partitions")):
            return rows.repartitionByRange(*by)
        return rows.repartitionByRange(tasks, *by)

    def _write_base(self, table: str, rows: DataFrame, target: str) -> None:
        # Sorted by key, so the look-up of one ingestion, file or run skips all row groups but few.
        ordered = rows.sortWithinPartitions("b", *self.KEYS[table])
        ordered.write.mode("append").option("compression", CODEC).partitionBy("b").parquet(target)

    def _move_out(self, table: str, token: str, moved: str) -> None:
        """Rows of a generation's negative buckets go to their own folder."""
        folder = f"{self.root}/base/{table}/g={token}"
        left = [f"{folder}/{name}" for name in self._names(folder) if name.startswith("b=-")]
        out = self.spark.read.schema(self.TABLES[table]).parquet(*left) if left else self.spark.createDataFrame([], self.TABLES[table])
        out.write.mode("append").option("compression", CODEC).parquet(moved)
        for path in left:
            delete_path(self.spark, path)

    def _clean(self, table: str, number: int, old: dict, now: dict) -> None:
        """Deletes what the fold before has folded, and generations that neither it nor this one names."""
        for folder in old["folded"]:
            if path_exists(self.spark, self.mark(table, folder)) and folder not in now["folded"]:
                delete_path(self.spark, folder)
                delete_path(self.spark, self.mark(table, folder))
        named = {*old["held"].values(), *now["held"].values()}
        for kind in (f"base/{table}", *(["sums"] if table == "ledger" else [])):
            for name in self._names(f"{self.root}/{kind}"):
                if name[2:] not in named:
                    delete_path(self.spark, f"{self.root}/{kind}/{name}")
        for name in self._names(f"{self.root}/pointer/{table}"):
            if int(name) < number:
                delete_path(self.spark, f"{self.root}/pointer/{table}/{name}")

    # -- state --------------------------------------------------------------------------------------------------

    def state(self, ingestion_id: str | None = None) -> DataFrame:
        """The latest event of each file: the base, with the files that deltas tell of ranked anew."""
        mine = F.lit(True) if ingestion_id is None else F.col("ingestion_id") == ingestion_id
        return self._state(self.delta_folders("ledger", ingestion_id), mine, whole=ingestion_id is None)

    def file(self, ingestion_id: str, file_path: str) -> DataFrame:
        """The state of one file; of the base one bucket is read."""
        return self._state(
            self.delta_folders("ledger", ingestion_id), (F.col("ingestion_id") == ingestion_id) & (F.col("file_path") == file_path),
            lambda buckets: F.col("b") == self._bucket("ledger", buckets, F.lit(ingestion_id), F.lit(file_path)),
        )

    def _state(self, folders: list[str], mine, in_bucket=None, whole: bool = False) -> DataFrame:
        columns, (_, pointer) = LEDGER_SCHEMA.names, self.pointer("ledger")
        base = self.base("ledger", pointer["held"])
        delta = self._read("ledger", folders).filter(mine)
        if base is None:
            return current_state(delta, order=ORDER)
        if in_bucket is not None:
            base = base.filter(in_bucket(pointer["buckets"]))
        base = base.filter(mine).select(*columns)
        if not folders:
            return base.filter(F.col("status") != CLEARED)
        fresh, held = folder_bytes(self.spark, *folders), folder_bytes(self.spark, *self._held_folders("ledger", pointer["held"]))
        if fresh > DELTA_SHARE * held:
            return self._ranked(base, delta.select(*columns), counted=whole and fresh + held >= COUNTED_BYTES)
        changed = delta.select(*KEY).distinct()
        same = base.join(changed, list(KEY), "left_anti").filter(F.col("status") != CLEARED)
        again = base.join(changed, list(KEY), "left_semi").unionByName(delta)
        return same.select(*columns).unionByName(current_state(again.select(*columns), order=ORDER))

    def _ranked(self, base: DataFrame, delta: DataFrame, counted: bool = False) -> DataFrame:
        """The state from one shuffle of base and deltas each; with ``counted`` from one of the rows that may have a newer one.

        Deltas come to the shuffle as one row per file and task; the base has one per file and isn't sorted before. As in a
        join, files without a name are no file's: those of the base meet none of the deltas.
        """
        nameless, keys = F.col("ingestion_id").isNull() | F.col("file_path").isNull(), (*KEY, "_alone")
        base = base.withColumn("_alone", nameless)
        if counted:
            rows = base.unionByName(delta.withColumn("_alone", F.lit(False))).withColumn("_hash", F.xxhash64(*keys))
            shared = self._shared(rows.select("_hash"))
            if shared is not None:
                # A row whose hash no other has is its file's only one. Those that share one may still be of several files.
                only = rows.join(shared, "_hash", "left_anti").drop("_hash", "_alone").filter(F.col("status") != CLEARED)
                several = rows.join(shared, "_hash", "left_semi").drop("_hash")
                return only.unionByName(current_state(several, keys=keys, order=ORDER).drop("_alone"))
        newest = first_per_key(delta, KEY, ORDER).withColumn("_alone", F.lit(False))
        return current_state(base.repartition(*KEY).unionByName(newest), keys=keys, order=ORDER).drop("_alone")

    def recent(self, since, ingestion_id: str | None = None) -> DataFrame:
        """State for reports on what was processed since a moment; the filter reaches the scans.

        An event is never older than the processing it tells of, so only that window is read and ranked.
        """
        late = F.col("event_time") >= as_column(since).cast("timestamp")
        mine = late if ingestion_id is None else late & (F.col("ingestion_id") == ingestion_id)
        return self._state(self.delta_folders("ledger", ingestion_id), mine)

    @staticmethod
    def _hourly(state: DataFrame, *by: str) -> DataFrame:
        return rollup(state.filter(F.col("status") != CLEARED), "hour", by=("ingestion_id", *by))

    def _sums(self, pointer: dict) -> DataFrame:
        """The hourly sums kept with the base; of buckets folded before there were any, made from their rows."""
        held, columns = pointer["held"], ("ingestion_id", "window_start", *SUMS)
        with_sums = {b: g for b, g in held.items() if g in pointer.get("summed", [])}
        without = {b: g for b, g in held.items() if b not in with_sums}
        schema = f"ingestion_id string, b int, window_start timestamp, {', '.join(f'{c} bigint' for c in SUMS)}"
        out = self.spark.createDataFrame([], schema).select(*columns)
        if with_sums:
            root = f"{self.root}/sums"
            found = self.spark.read.schema(f"{schema}, g string").option("basePath", root).parquet(*[f"{root}/g={g}" for g in sorted(set(with_sums.values()))])
            # A row per bucket; of a generation only the buckets count that no later one has rewritten.
            named = self.spark.createDataFrame([(int(b), g) for b, g in with_sums.items()], "b int, g string")
            out = found.join(named, ["b", "g"], "left_semi").select(*columns)
        if without:
            out = out.unionByName(self._hourly(self.base("ledger", without)))
        return out

    @staticmethod
    def _counted(rows: DataFrame, *by: str) -> DataFrame:
        """File rows as sums of one file each."""
        return rows.filter(F.col("status") != CLEARED).select(
            "ingestion_id", *by, F.col("processed_at").alias("window_start"), F.lit(1).cast("bigint").alias("file_count"),
            F.when(F.col("status") == FAILED, 1).otherwise(0).cast("bigint").alias("failed_count"),
            F.coalesce("records_ingested", F.lit(0)).cast("bigint").alias("records"), F.coalesce("bytes_read", F.lit(0)).cast("bigint").alias("bytes"),
        )

    def rolled(self, grain: str, ingestion_id: str | None = None) -> DataFrame:
        """Hourly, daily or weekly sums over the state, as ``analytics.rollup`` of it gives them.

        Of the base only the buckets of files that deltas tell of are read, else the sums alone.
        """
        mine = F.lit(True) if ingestion_id is None else F.col("ingestion_id") == ingestion_id
        folders, (_, pointer) = self.delta_folders("ledger", ingestion_id), self.pointer("ledger")
        sums = self._sums(pointer).filter(mine)
        if folders:
            delta = self._read("ledger", folders).filter(mine)
            newest = first_per_key(delta, KEY, ORDER)
            sums = sums.unionByName(self._counted(newest))
            if pointer["held"]:
                touched = {str(r.b) for r in delta.select(self._bucket("ledger", pointer["buckets"]).alias("b")).distinct().collect()}
                held = {b: g for b, g in pointer["held"].items() if b in touched}
                if held:
                    # Of a file that the base has too, one of both rows doesn't count: the base's, or that of the deltas if it is older.
                    was = self.base("ledger", held).select(*[F.col(c).alias(f"_{c}") if c not in KEY else F.col(c) for c in LEDGER_SCHEMA.names])
                    later = F.struct(*ORDER) > F.struct(*[F.col(f"_{c}").alias(c) for c in ORDER])
                    both = newest.join(was, list(KEY))
                    lost = both.select("ingestion_id", *[F.when(later, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in COUNTED])
                    sums = sums.unionByName(self._counted(lost).withColumns({c: -F.col(c) for c in SUMS}))
        return merged_sums(sums, grain)

    def versions(self, ingestion_id: str | None = None) -> DataFrame:
        """``ingestion_id, file_path, live_run_id`` of the files that several runs have loaded.

        Their rows of other runs are outdated. Only runs that readers see count, and a load without any row counts.
        """
        mine = F.lit(True) if ingestion_id is None else F.col("ingestion_id") == ingestion_id
        folders = self.delta_folders("ledger", ingestion_id)
        events = self._read("ledger", folders).filter(mine & (F.col("status") == SUCCESS))
        fresh = self._versions(events, self.ended()).filter("loads > 0").select(*KEY, *VERSION.names)
        base = self.base("ledger")
        if base is not None:
            base = base.filter(mine).filter("loads > 0").select(*KEY, *VERSION.names)
            names = fresh.select(*KEY).distinct()
            old = base.filter("loads > 1").join(names, list(KEY), "left_anti")
            fresh = fresh.unionByName(base.join(names, list(KEY), "left_semi"))
        live = F.struct("live_time", "live_seq", "live_run_id")
        found = fresh.groupBy(*KEY).agg(F.max(live).alias("_live"), F.sum("loads").alias("loads")).filter("loads > 1")
        found = found.select(*KEY, F.col("_live.live_run_id").alias("live_run_id"))
        return found if base is None else found.unionByName(old.select(*found.columns))

    def reset_stale(self, ingestion_id: str, run_id: str, as_of, hours: int = 2) -> None:
        """Stores the events that return files of lost runs to PENDING; a replayed run keeps its own."""
        state = self.state(ingestion_id).filter(F.col("run_id") != run_id)
        self.append("ledger", ingestion_id, run_id, "reset", stale_reset(state, F.lit(as_of), hours).drop("run_id"))

    def fail_in_flight(self, ingestion_id: str, run_id: str, at, error_type: str, message: str) -> None:
        """Stores that the files of a broken run have failed, so that a later run may take them.

        Those it had loaded too: readers don't see a run that broke.
        """
        mine = self.state(ingestion_id).filter((F.col("run_id") == run_id) & F.col("status").isin(PROCESSING, SUCCESS))
        events = transition(mine, F.lit(at), FAILED, error_type=error_type, error_message=message, processed_at=F.lit(at))
        self.append("ledger", ingestion_id, run_id, "broken", events)

    def runs(self, ingestion_id: str | None = None) -> DataFrame:
        """Latest row per run."""
        rows, base = self._read("runs", self.delta_folders("runs", ingestion_id)), self.base("runs")
        if base is not None:
            rows = rows.unionByName(base.drop("b") if ingestion_id is None else base.drop("b").filter(F.col("ingestion_id") == ingestion_id))
        return self._merged("runs", rows)

    def retire(self, archive: str, as_of, retention_days: int = 90) -> int:
        """Takes files processed before the horizon out of the state; returns how many went to ``archive``.

        Each pass adds its own folder, ``pass=<token>``, to the archive. Of a file that several runs have loaded the version stays, so its
        outdated rows stay hidden.
        """
        moved, as_of = f"{archive.rstrip('/')}/pass={uuid.uuid4().hex}", settled(self.spark, as_of)

        def split(merged: DataFrame) -> DataFrame:
            # The moment is the same in all jobs, so a row is in the base or in the archive.
            here, gone = F.struct("b", "status"), F.struct((-1 - F.col("b")).alias("b"), "status")
            hidden = F.struct("b", F.lit(CLEARED).alias("status"))
            places = F.when((F.col("status") == CLEARED) | ~F.col("archived"), F.array(here)).when(F.col("loads") > 1, F.array(gone, hidden)).otherwise(F.array(gone))
            aged = with_age(merged.filter(F.col("status").isNotNull()), as_of, retention_days)
            return aged.withColumn("_at", F.explode(places)).withColumns({"b": F.col("_at.b"), "status": F.col("_at.status")}).select(*merged.columns)

        if not self._fold("ledger", split, moved):
            delete_path(self.spark, moved)
            return 0
        return self.spark.read.schema(LEDGER_SCHEMA).parquet(moved).count()
