"""The target table and its commit protocol.

Rows of a run go to partitions ``(_run_id, _part)``; good records to ``_part = k`` and records that do not
fit the schema to ``_part = -1 - k``, where ``k`` numbers the scans of the run. Both come out of one scan
and one write. Writing such a partition again replaces only itself, and readers see a run once its run row
says it ended, so a lost job leaves nothing visible and a replay leaves the same rows.

A change that stored files cannot take, such as a wider type or a field inside a struct, opens a new generation of the
table, ``<table>_g2`` and so on, with the new schema. Runs write to the newest one; readers see all of them in its
columns and types. ``settle_generations`` moves the rows of older ones over.
"""

from __future__ import annotations

import uuid
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemark.functions.schema_types import new_columns, reshaped_rows
from tidemark.model import CORRUPT, PART, RUN_ID, RUN_PARTIAL, RUN_SUCCESS, SERVICE_COLUMNS, SOURCE_FILE
from tidemark.workspace import delete_path, materialize

if TYPE_CHECKING:
    from tidemark.operators.state_store import StateStore


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def table_exists(spark: SparkSession, table: str) -> bool:
    return spark.catalog.tableExists(table)


def generations(spark: SparkSession, table: str) -> list[str]:
    """The table and its later generations, oldest first."""
    out = [table] if table_exists(spark, table) else []
    while out and table_exists(spark, f"{table}_g{len(out) + 1}"):
        out.append(f"{table}_g{len(out) + 1}")
    return out


def newest(spark: SparkSession, table: str) -> str:
    """The generation that runs write to."""
    return (generations(spark, table) or [table])[-1]


def drop_table(spark: SparkSession, table: str) -> dict:
    """Drops the table, with all generations, if it is there and says whether it was."""
    names = generations(spark, table)
    location = table_location(spark, table) if names else None
    for name in reversed(names):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return {"table_name": table, "existed": bool(names), "location": location}


def default_of(field: T.StructField) -> str | None:
    """The SQL text of a column's default."""
    return field.metadata.get("CURRENT_DEFAULT")


def table_location(spark: SparkSession, table: str) -> str:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").filter("col_name = 'Location'").select("data_type")
    return rows.first()[0]


def create_table(
    spark: SparkSession,
    table: str,
    schema: T.StructType,
    partition_columns: tuple[str, ...] = (),
    location: str | None = None,
) -> None:
    """Partitioned by run and part first, then by the user's columns."""
    data = [f for f in schema.fields if f.name not in SERVICE_COLUMNS and f.name not in partition_columns]
    parts = {f.name: f for f in schema.fields}
    columns = [_declared(f, default_of(f)) for f in data]
    columns += [f"{SOURCE_FILE} string", f"{CORRUPT} string", f"{RUN_ID} string", f"{PART} int"]
    columns += [f"{quote(c)} {parts[c].dataType.simpleString()}" for c in partition_columns]
    by = ", ".join([RUN_ID, PART, *[quote(c) for c in partition_columns]])
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE {table} ({', '.join(columns)}) USING parquet PARTITIONED BY ({by}){where}")


def _declared(field: T.StructField, default: str | None = None) -> str:
    return f"{quote(field.name)} {field.dataType.simpleString()}" + (f" DEFAULT {default}" if default else "")


def evolve_table(spark: SparkSession, table: str, incoming: T.StructType, defaults: dict[str, str] | None = None) -> list[T.StructField]:
    """Adds the columns the table lacks, in source order; returns them.

    ``defaults`` has SQL literals by column; rows that are stored already read as them.
    """
    table = newest(spark, table)
    added = [f for f in new_columns(spark.table(table).schema, incoming) if f.name not in SERVICE_COLUMNS]
    if added:
        known = {k.lower(): v for k, v in (defaults or {}).items()}
        ddl = ", ".join(_declared(f, known.get(f.name.lower())) for f in added)
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({ddl})")
    return added


def open_generation(
    spark: SparkSession, table: str, schema: T.StructType, partition_columns: tuple[str, ...] = (), location: str | None = None
) -> str:
    """A new generation with another schema; a draft of it that a lost run left is not used by any reader yet."""
    number = len(generations(spark, table)) + 1
    name = f"{table}_g{number}"
    place = f"{location.rstrip('/')}_g{number}" if location else None
    if place:
        delete_path(spark, place)
    create_table(spark, name, schema, partition_columns, place)
    return name


def stored(spark: SparkSession, table: str) -> DataFrame:
    """The rows of all generations in the columns and types of the newest one."""
    names = generations(spark, table)
    rows = spark.table(names[-1])
    for name in names[:-1]:
        old = spark.table(name)
        have = {c.lower() for c in old.columns}
        for f in rows.schema.fields:
            if f.name.lower() not in have and default_of(f):
                old = old.withColumn(f.name, F.expr(default_of(f)))
        rows = rows.unionByName(reshaped_rows(old, rows.schema))
    return rows


def settle_generations(spark: SparkSession, table: str) -> int:
    """Rewrites the partitions of older generations into the newest one; returns how many runs were moved.

    A run's partitions are written before its old ones go; meant for a time without readers, as in between they would
    see the run twice. Repeating it after a loss writes the same partitions again.
    """
    names, moved = generations(spark, table), 0
    for name in names[:-1]:
        target = spark.table(names[-1]).schema
        for row in spark.sql(f"SHOW PARTITIONS {name}").select(F.regexp_extract("partition", f"{RUN_ID}=([^/]+)", 1).alias("r")).distinct().collect():
            overwrite_partitions(reshaped_rows(spark.table(name).filter(F.col(RUN_ID) == row.r), target), names[-1])
            _drop_partitions(spark, name, row.r)
            moved += 1
    return moved


def overwrite_partitions(df: DataFrame, table: str) -> None:
    """Replaces the partitions present in ``df``; columns go by name, absent ones become NULL.

    The statement runs in a session of its own with the same settings: switching the overwrite mode of the caller's
    session would change what another thread's insert in it replaces.
    """
    spark = df.sparkSession
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if own.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    own.catalog.setCurrentDatabase(spark.catalog.currentDatabase())
    rows = f"tidemark_{uuid.uuid4().hex}"
    df.createGlobalTempView(rows)
    try:
        own.sql(f"INSERT OVERWRITE {table} BY NAME SELECT * FROM global_temp.{rows}")
    finally:
        spark.catalog.dropGlobalTempView(rows)
    spark.catalog.refreshTable(table)


def drop_run(spark: SparkSession, table: str, run_id: str, part: int | None = None) -> None:
    """Drops partitions of a run that must not be seen, in all generations."""
    for name in generations(spark, table):
        _drop_partitions(spark, name, run_id, part)


def _drop_partitions(spark: SparkSession, table: str, run_id: str, part: int | None = None) -> None:
    """With their files: external tables keep those."""
    spec = f"{RUN_ID} = '{run_id}'" + ("" if part is None else f", {PART} = {part}")
    if spark.sql(f"SHOW PARTITIONS {table} PARTITION ({spec})").isEmpty():
        return
    spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({spec})")
    delete_path(spark, f"{table_location(spark, table)}/{RUN_ID}={run_id}" + ("" if part is None else f"/{PART}={part}"))


def write_part(
    rows: DataFrame,
    table: str,
    run_id: str,
    part: int,
    partition_columns: tuple[str, ...] = (),
    cluster_columns: tuple[str, ...] = (),
) -> None:
    """One scan, one write: good and bad records of part ``part``."""
    spark = rows.sparkSession
    out = rows.withColumns({
        RUN_ID: F.lit(run_id),
        PART: F.when(F.col(CORRUPT).isNull(), F.lit(part)).otherwise(F.lit(-1 - part)),
    })
    if cluster_columns:
        # Stored once, so the raw files are not parsed again for quantiles and range bounds.
        out = cluster(materialize(out, "clustering"), cluster_columns)
    elif partition_columns:
        # Rebalancing splits a value that holds most rows over many writers.
        out = out.hint("rebalance", *partition_columns)
    overwrite_partitions(out, newest(spark, table))


def file_counts(spark: SparkSession, table: str, run_id: str) -> DataFrame:
    """Good and bad records per source file of a run, read from two columns of what was written."""
    return (
        spark.table(newest(spark, table))
        .filter(F.col(RUN_ID) == run_id)
        .groupBy(SOURCE_FILE)
        .agg(F.count_if(F.col(PART) >= 0).alias("good_count"), F.count_if(F.col(PART) < 0).alias("bad_count"))
    )


def retract_files(spark: SparkSession, table: str, run_id: str, part: int, failed: DataFrame) -> None:
    """Takes the rows of failed files out of a part that is not committed yet."""
    table = newest(spark, table)
    rows = spark.table(table).filter((F.col(RUN_ID) == run_id) & (F.col(PART) == part))
    kept = rows.join(failed.select(SOURCE_FILE), SOURCE_FILE, "left_anti")
    if kept.isEmpty():
        # Dynamic overwrite leaves a partition alone when no row is written to it.
        drop_run(spark, table, run_id, part)
    else:
        overwrite_partitions(kept, table)


def committed(spark: SparkSession, table: str, store: StateStore, ingestion_id: str | None = None, service_columns: bool = False) -> DataFrame:
    """The rows readers see: good records of ended runs, of each file those of the last run that loaded it.

    Which run that is comes from the ledger: also a load that brought no row hides the rows before it. Files that
    several runs have loaded are few; only their versions meet the rows.
    """
    done = store.ended().filter(F.lit(True) if ingestion_id is None else F.col("ingestion_id") == ingestion_id)
    done = done.select(F.col("run_id").alias(RUN_ID), F.col("ingestion_id").alias("_ingestion")).dropDuplicates([RUN_ID])
    good = stored(spark, table).filter(F.col(PART) >= 0)
    rows = good.join(done, RUN_ID)
    live = store.versions(ingestion_id)
    outdated = (rows[SOURCE_FILE] == live["file_path"]) & (rows["_ingestion"] == live["ingestion_id"]) & (rows[RUN_ID] != live["live_run_id"])
    rows = rows.join(live, outdated, "left_anti").select(*good.columns)
    if service_columns:
        return rows
    return rows.drop(*SERVICE_COLUMNS)


def rejected(spark: SparkSession, table: str, runs: DataFrame) -> DataFrame:
    """Records of ended runs that did not fit the schema, with file and run: the error table."""
    done = runs.filter(F.col("status").isin(RUN_SUCCESS, RUN_PARTIAL)).select(F.col("run_id").alias(RUN_ID))
    return (
        stored(spark, table).filter(F.col(PART) < 0).join(done, RUN_ID, "left_semi").select(SOURCE_FILE, CORRUPT, RUN_ID)
    )


def bytes_written(spark: SparkSession, table: str, run_id: str) -> DataFrame:
    """Size of the run's data files; one row per data file before the sum."""
    files = (
        spark.table(newest(spark, table))
        .filter((F.col(RUN_ID) == run_id) & (F.col(PART) >= 0))
        .select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("s"))
        .groupBy("f")
        .agg(F.max("s").alias("s"))
    )
    return files.agg(F.coalesce(F.sum("s"), F.lit(0)).cast("bigint").alias("bytes_written"))


def append(df: DataFrame, table: str, partition_columns: tuple[str, ...] = ()) -> None:
    """Plain append by column name; creates the table, with its partitioning, when it is not there."""
    spark = df.sparkSession
    if table_exists(spark, table):
        spark.sql(f"INSERT INTO {table} BY NAME SELECT * FROM {{rows}}", rows=df)
    else:
        writer = df.write
        if partition_columns:
            writer = writer.partitionBy(*partition_columns)
        writer.saveAsTable(table)


def z_value(buckets: list[str], bits: int = 8) -> Column:
    """Interleaved bits of bucket numbers as text of 0 and 1, highest bits first, so any number of columns fits."""
    turned = [F.lpad(F.bin(F.col(c).cast("bigint")), bits, "0") for c in buckets]
    return F.concat(*[F.substring(t, b + 1, 1) for b in range(bits) for t in turned])


def _ordinal(df: DataFrame, column: str) -> Column:
    """A number in the order of the column; times as microseconds."""
    kind, c = df.schema[column].dataType, F.col(quote(column))
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    return F.unix_micros(c.cast("timestamp")).cast("double")


def _is_text(df: DataFrame, column: str) -> bool:
    return not isinstance(df.schema[column].dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType))


def _text_edges(df: DataFrame, column: str, ranges: int) -> list[str]:
    """Values that cut a text column into ranges of about equal size, from whole values of a sample of hashes."""
    rows = df.select(F.col(quote(column)).cast("string").alias("v")).filter("v IS NOT NULL")
    kept = rows.groupBy("v").agg(F.count("*").alias("n")).orderBy(F.xxhash64("v")).limit(EDGE_SAMPLE).collect()
    values, total, edges, seen = sorted((r.v, r.n) for r in kept), sum(r.n for r in kept), [], 0
    for v, n in values:
        if seen * ranges >= (len(edges) + 1) * total and v not in edges:
            edges.append(v)
        seen += n
    return edges


def _bucket(at: Column, edges: list[float], steps: int) -> Column:
    """Bucket number: the quantile range by comparisons, then equal steps within it. Stays in generated code."""
    inner = edges[1:-1]
    q = F.lit(0)
    low, high = F.lit(edges[0]), F.lit(edges[1])
    for i, e in enumerate(inner):
        q = q + (at >= e).cast("int")
        low = F.when(at >= e, F.lit(e)).otherwise(low)
        high = F.when(at >= e, F.lit(edges[i + 2])).otherwise(high)
    within = F.floor(F.try_divide(at - low, high - low) * steps)
    step = F.greatest(F.lit(0), F.least(F.lit(steps - 1), F.coalesce(within, F.lit(0))))
    return F.coalesce(q * steps + step, F.lit(0)).cast("int")


# Distinct text values from which the ranges of a clustering column are taken; bounds the layout's quality only.
EDGE_SAMPLE = 10_000


def cluster(df: DataFrame, columns: tuple[str, ...], partitions: int | None = None) -> DataFrame:
    """Rows laid out along a z-order curve, so files cover small ranges of every column.

    Costs a pass for quantiles and one for range bounds over ``df``; hand it stored rows, not a raw scan.
    """
    ranges, steps = 16, 16
    shares = F.array(*[F.lit(i / ranges) for i in range(ranges + 1)])
    numeric = [c for c in columns if not _is_text(df, c)]
    row = df.select(*[F.percentile_approx(_ordinal(df, c), shares, 1000).alias(c) for c in numeric]).first() if numeric else {}
    buckets = {}
    for i, c in enumerate(columns):
        if c in numeric:
            buckets[f"_z{i}"] = _bucket(_ordinal(df, c), row[c], steps) if row[c] else F.lit(0)
        else:
            at, number = F.col(quote(c)).cast("string"), F.lit(0)
            for e in _text_edges(df, c, ranges * steps):
                number = number + (at >= e).cast("int")
            buckets[f"_z{i}"] = F.coalesce(number, F.lit(0))
    placed = df.withColumns(buckets)
    placed = placed.withColumn("_z", z_value(list(buckets)))
    key = [F.col("_z"), *[F.col(quote(c)) for c in columns]]
    # The last range key splits a value that many rows share.
    salted = [*key, F.rand(7)]
    spread = placed.repartitionByRange(partitions, *salted) if partitions else placed.repartitionByRange(*salted)
    return spread.sortWithinPartitions(*key).select(*df.columns)
