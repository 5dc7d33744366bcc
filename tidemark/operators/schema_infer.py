"""Schemas of many landed files in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemark.functions.schema_nodes import described, merged_schema
from tidemark.functions.schema_types import typed
from tidemark.model import SOURCE_FILE
from tidemark.sources.paths import scanned_file, escape_glob
from tidemark.sources.readers import SAMPLE_FILES, reader_options, sample_lines


def read_lines(spark: SparkSession, paths: list[str], options: dict | None = None) -> DataFrame:
    """Text records with their file; whole files when the format is multi-line."""
    opts = reader_options(options)
    whole = str(opts.get("multiLine", "false")).lower() == "true"
    # A text reader takes no header, quote or delimiter; the codec follows from the file name.
    keep = {k: v for k, v in opts.items() if k in ("lineSep", "encoding")}
    lines = spark.read.options(**keep).text([escape_glob(p) for p in paths], wholetext=whole)
    return lines.select("value", scanned_file(F.col("_metadata.file_path")).alias(SOURCE_FILE))


def json_file_schemas(lines: DataFrame, value: str = "value", file: str = SOURCE_FILE) -> DataFrame:
    """Per file: merged JSON schema, records, malformed records. Aggregates before the shuffle."""
    filled = F.trim(F.col(value)) != ""
    # A column of its own, so that a record is parsed once for all three; a broken one costs most.
    parsed = lines.select(F.col(file).alias(SOURCE_FILE), filled.alias("_filled"), F.when(filled, F.try_parse_json(F.col(value))).alias("_v"))
    return parsed.groupBy(SOURCE_FILE).agg(
        F.schema_of_variant_agg("_v").alias("variant_schema"),
        F.count_if("_filled").alias("record_count"),
        F.count_if(F.col("_filled") & F.col("_v").isNull()).alias("malformed_count"),
    )


def schema_groups(per_file: DataFrame) -> DataFrame:
    """Files by schema: one row per distinct schema with its file and record counts."""
    return per_file.groupBy("variant_schema").agg(
        F.count("*").alias("file_count"),
        F.sum("record_count").cast("bigint").alias("record_count"),
        F.min(SOURCE_FILE).alias("first_file"),
    )


def merge_variant_schemas(groups: DataFrame) -> T.StructType:
    """Union of the schemas of ``variant_schema, first_file`` rows, numbers widened, other conflicts to string.

    Schemas are parsed in tasks and folded by an aggregate per path, so only the merged columns reach the driver.
    """
    return typed(merged_schema(described(groups, "variant_schema", "first_file")))


def sample_schema(manifest: DataFrame, files: int = SAMPLE_FILES) -> T.StructType:
    """The schema of JSON records, from the first lines of the first files; the rest is not read."""
    seen = json_file_schemas(sample_lines(manifest, files))
    return merge_variant_schemas(schema_groups(seen))


def csv_headers(spark: SparkSession, paths: list[str], options: dict | None = None) -> DataFrame:
    """Header line of every CSV file, found in one text scan.

    The first split of a file is read by one task in order, so the smallest row id in it is line one.
    """
    lines = spark.read.text([escape_glob(p) for p in paths]).filter(F.col("_metadata.file_block_start") == 0)
    numbered = lines.select(
        "value", scanned_file(F.col("_metadata.file_path")).alias(SOURCE_FILE), F.monotonically_increasing_id().alias("n")
    )
    return numbered.groupBy(SOURCE_FILE).agg(F.min_by("value", "n").alias("header"))


def column_types(lines: DataFrame, value: str = "value", file: str = SOURCE_FILE) -> DataFrame:
    """(file, column, type) of the top-level JSON columns, with the records that carry it."""
    parsed = lines.select(F.col(file).alias(SOURCE_FILE), F.try_parse_json(F.col(value)).alias("_v"))
    # variant_explode only takes objects or arrays; a scalar record has no columns.
    keyed = parsed.filter(F.schema_of_variant("_v").startswith("OBJECT"))
    exploded = keyed.lateralJoin(
        keyed.sparkSession.tvf.variant_explode(F.col("_v").outer())
    )
    return exploded.groupBy(
        SOURCE_FILE, F.col("key").alias("column_name"), type_family(F.schema_of_variant("value")).alias("data_type")
    ).agg(F.count("*").alias("record_count"))


def type_family(variant_type: Column) -> Column:
    """Type name without precision or members, so equal kinds compare equal."""
    return F.regexp_replace(F.regexp_extract(variant_type, r"^([A-Z]+)", 1), "^DECIMAL$", "DOUBLE")


def inconsistent_columns(types: DataFrame) -> DataFrame:
    """Columns by type: files and records of each; a column with two or more real types is inconsistent."""
    per_type = types.groupBy("column_name", "data_type").agg(
        F.count("*").alias("file_count"), F.sum("record_count").cast("bigint").alias("record_count")
    )
    # A column has few types, so the second step works on a handful of rows per column.
    kinds = per_type.groupBy("column_name").agg(
        F.count_if(F.col("data_type") != "VOID").alias("type_count"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("data_type") != "VOID", F.col("data_type")))), ",").alias(
            "types"
        ),
    )
    return per_type.join(kinds, "column_name").select(
        "column_name",
        "data_type",
        "file_count",
        "record_count",
        "types",
        (F.col("type_count") > 1).alias("inconsistent"),
    )
