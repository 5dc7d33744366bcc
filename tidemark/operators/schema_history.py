"""Schema differences as rows, version history and the ways to resolve a change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemark.functions import schema_types
from tidemark.model import SERVICE_COLUMNS
from tidemark.operators.schema_infer import column_types, inconsistent_columns

DIFF_SCHEMA = (
    "change_type string, column_name string, old_type string, new_type string, "
    "old_nullable boolean, new_nullable boolean, breaking boolean"
)
COLUMN_SCHEMA = "position int, column_name string, data_type string, nullable boolean"


def schema_rows(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """A schema as rows; its size is the number of columns."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(schema.fields)]
    return spark.createDataFrame(rows, COLUMN_SCHEMA)


def schema_diff(spark: SparkSession, old: T.StructType, new: T.StructType, strict: bool = False) -> DataFrame:
    """Changes between two schemas as rows."""
    changes = schema_types.diff(old, new, strict)
    return spark.createDataFrame([tuple(vars(c).values()) for c in changes], DIFF_SCHEMA)


def verdict(changes: DataFrame) -> DataFrame:
    """One row: does anything differ, is it safe."""
    return changes.agg(
        (F.count("*") > 0).alias("has_changes"),
        F.coalesce(F.bool_or("breaking"), F.lit(False)).alias("is_breaking"),
        (~F.coalesce(F.bool_or("breaking"), F.lit(False))).alias("is_compatible"),
    )


def diff_rows(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = (), strict: bool = False) -> DataFrame:
    """Changes between two sets of (keys, column_name, data_type, nullable) rows, for many tables at once."""
    on = [*keys, "column_name"]
    a = old.select(*on, F.col("data_type").alias("old_type"), F.col("nullable").alias("old_nullable"))
    b = new.select(*on, F.col("data_type").alias("new_type"), F.col("nullable").alias("new_nullable"))
    both = a.join(b, on, "full_outer")
    narrowing = F.lit(False)
    for wide, narrow in schema_types.NARROWER.items():
        narrowing = narrowing | ((F.col("old_type") == wide) & F.col("new_type").isin(*narrow))
    if strict:
        narrowing = narrowing | (F.col("old_type") != F.col("new_type"))
    kind = (
        F.when(F.col("old_type").isNull(), "NEW_COLUMN")
        .when(F.col("new_type").isNull(), "REMOVED_COLUMN")
        .when(F.col("old_type") != F.col("new_type"), "TYPE_CHANGE")
        .when(F.col("old_nullable") != F.col("new_nullable"), "NULLABILITY_CHANGE")
    )
    lost_null = F.coalesce(F.col("old_nullable") & ~F.col("new_nullable"), F.lit(False))
    breaking = F.when(F.col("change_type") == "NEW_COLUMN", False).when(
        F.col("change_type") == "REMOVED_COLUMN", True
    ).otherwise(narrowing | lost_null)
    return both.withColumn("change_type", kind).filter(F.col("change_type").isNotNull()).select(
        *keys, "change_type", "column_name", "old_type", "new_type", "old_nullable", "new_nullable",
        breaking.alias("breaking"),
    )


def next_versions(detected: DataFrame, history: DataFrame) -> DataFrame:
    """Numbers newly detected schemas per ingestion, continuing its history.

    ``detected`` has one row per distinct new schema, so the window sees schemas, not files.
    """
    from pyspark.sql import Window

    top = history.groupBy("ingestion_id").agg(F.max("version").alias("_top"))
    w = Window.partitionBy("ingestion_id").orderBy("detected_at", "schema_json")
    return (
        detected.join(top, "ingestion_id", "left")
        .withColumn("version", (F.coalesce(F.col("_top"), F.lit(0)) + F.row_number().over(w)).cast("int"))
        .drop("_top")
    )


def latest_version(history: DataFrame) -> DataFrame:
    return history.groupBy("ingestion_id").agg(
        F.max("version").alias("version"), F.max_by("schema_json", "version").alias("schema_json")
    )


def version_changes(history: DataFrame) -> DataFrame:
    """Changes from each version to the next; a window over the versions of one ingestion."""
    from pyspark.sql import Window

    w = Window.partitionBy("ingestion_id").orderBy("version")
    fields = "struct<fields:array<struct<name:string,type:string,nullable:boolean>>>"
    pairs = history.select(
        "ingestion_id", "version", F.lag("schema_json").over(w).alias("_old"), F.col("schema_json").alias("_new")
    ).filter(F.col("_old").isNotNull())

    def explode(json_col: str) -> DataFrame:
        return pairs.select(
            "ingestion_id", "version", F.explode(F.from_json(json_col, fields)["fields"]).alias("f")
        ).select(
            "ingestion_id", "version", F.col("f.name").alias("column_name"),
            F.expr("case f.type when 'long' then 'bigint' when 'integer' then 'int' else f.type end").alias("data_type"),
            F.col("f.nullable").alias("nullable"),
        )

    return diff_rows(explode("_old"), explode("_new"), ("ingestion_id", "version"))


def affected_files(schema_files: DataFrame) -> DataFrame:
    """Files per version as counts; the paths stay rows because a version may touch any number of files."""
    return schema_files.groupBy("ingestion_id", "version").agg(
        F.count_distinct("file_path").alias("file_count"), F.min("file_path").alias("first_file")
    )


def auto_merge(table_rows: DataFrame, new_rows: DataFrame) -> DataFrame:
    """Old and new rows under the union of their columns, absent ones NULL."""
    return table_rows.unionByName(new_rows, allowMissingColumns=True)


def backfill_default(table_rows: DataFrame, new_rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """As :func:`auto_merge`, with a default for NULLs of the new columns."""
    both = auto_merge(table_rows, new_rows)
    return both.withColumns({c: F.coalesce(F.col(c), d) for c, d in defaults.items()})


def ignore_new(table_schema: T.StructType, new_rows: DataFrame) -> DataFrame:
    """New rows cut to the table's columns; columns they lack become NULL."""
    have = {c.lower(): c for c in new_rows.columns}
    return new_rows.select(*[
        F.col(f"`{have[f.name.lower()]}`").alias(f.name) if f.name.lower() in have
        else F.lit(None).cast(f.dataType).alias(f.name)
        for f in table_schema.fields
    ])


def version_table(spark: SparkSession, table: str, version: int, rows: DataFrame, view: str | None = None) -> str:
    """Writes rows of a new schema to ``<table>_v<version>``, optionally with a view over all versions."""
    name = f"{table}_v{version}"
    rows.write.mode("append").saveAsTable(name)
    if view:
        spark.table(table).unionByName(spark.table(name), allowMissingColumns=True).createOrReplaceTempView(view)
    return name


def inconsistency_report(lines: DataFrame, value: str = "value", file: str = "_source_file") -> DataFrame:
    return inconsistent_columns(column_types(lines, value, file))


def open_decisions(history: DataFrame) -> DataFrame:
    """One row per version: what was decided of it last, or that it waits."""
    rest = [c for c in history.columns if c not in ("ingestion_id", "version")]
    last = F.max_by(F.struct(*rest), F.coalesce("resolved_at", F.lit("0001-01-01").cast("timestamp")))
    return history.groupBy("ingestion_id", "version").agg(last.alias("_r")).select("ingestion_id", "version", "_r.*").select(*history.columns)


def pending_approvals(history: DataFrame) -> DataFrame:
    """Ingestions with schema changes that wait for a decision."""
    return (
        history.filter(F.col("resolution_type") == "pending_approval")
        .groupBy("ingestion_id")
        .agg(F.count("*").alias("pending_count"))
        .withColumn("severity", F.lit("info"))
        .withColumn(
            "message", F.concat(F.col("pending_count").cast("string"), F.lit(" schema changes awaiting approval"))
        )
    )


def user_columns(schema: T.StructType) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name not in SERVICE_COLUMNS])


