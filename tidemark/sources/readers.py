"""Format scans: batch readers over landed files."""

from __future__ import annotations

import json
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark.model import CORRUPT, FORMATS, SOURCE_FILE
from tidemark.sources.listing import heads
from tidemark.sources.paths import scanned_file, escape_glob

# Option names of the ingestion config and the reader options they stand for.
OPTION_NAMES = {
    "multiline": "multiLine",
    "compression": "compression",
    "header": "header",
    "delimiter": "sep",
    "quote": "quote",
    "row_tag": "rowTag",
}


LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
UNSET_LISTING = "10000"


@contextmanager
def listing_tasks(spark: SparkSession):
    """Lists files in as many tasks as the cluster has use for.

    Left alone, Spark starts one task per path up to 10000, which takes far longer than the listing itself.
    A value set by the user stays.
    """
    if spark.conf.get(LISTING) != UNSET_LISTING:
        yield
        return
    spark.conf.set(LISTING, str(min(10_000, max(32, spark.sparkContext.defaultParallelism * 4))))
    try:
        yield
    finally:
        spark.conf.set(LISTING, UNSET_LISTING)


def reader_options(options: dict | None) -> dict:
    """Reader options by Spark name; unset ones are dropped."""
    return {OPTION_NAMES.get(k, k): v for k, v in (options or {}).items() if v is not None}


def as_struct(schema: T.StructType | str | dict | None) -> T.StructType | None:
    if schema is None or isinstance(schema, T.StructType):
        return schema
    return T.StructType.fromJson(json.loads(schema) if isinstance(schema, str) else schema)


def scan(
    spark: SparkSession,
    fmt: str,
    paths: list[str] | str,
    schema=None,
    options: dict | None = None,
    literal_paths: bool = False,
) -> DataFrame:
    """One scan over many files; without a schema it is inferred from all of them."""
    fmt = fmt.lower()
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format {fmt!r}; expected one of {FORMATS}")
    reader = spark.read.format(fmt).options(**reader_options(options))
    schema = as_struct(schema)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    if isinstance(paths, str):
        paths = [paths]
    if literal_paths:
        paths = [escape_glob(p) for p in paths]
    try:
        return reader.load(paths)
    except Exception as e:
        if fmt == "avro" and "avro" in str(e).lower():
            raise RuntimeError("format 'avro' needs the spark-avro package on the session's class path") from e
        raise


def with_source_file(df: DataFrame) -> DataFrame:
    """Adds the file each row came from."""
    return df.select("*", scanned_file(F.col("_metadata.file_path")).alias(SOURCE_FILE))


def scan_permissive(
    spark: SparkSession, fmt: str, paths: list[str], schema: T.StructType, options: dict | None = None
) -> DataFrame:
    """Rows with provenance and, for text formats, the raw record wherever it does not fit the schema."""
    opts = dict(options or {})
    full = schema
    if fmt in ("json", "csv", "xml"):
        full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
        opts.update(mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)
    df = with_source_file(scan(spark, fmt, paths, full, opts, literal_paths=True))
    return df if CORRUPT in df.columns else df.withColumn(CORRUPT, F.lit(None).cast("string"))


# Files of a sample, and the bytes of each that are looked at.
SAMPLE_FILES, HEAD_BYTES = 10, 1 << 16


def sample_lines(manifest: DataFrame, files: int = SAMPLE_FILES, head_bytes: int = HEAD_BYTES) -> DataFrame:
    """``value`` and file of the first lines of the first filled files in key order; nothing else is read of them."""
    first = manifest.filter("size_bytes > 0").orderBy("path").limit(files).select("path")
    return first.repartition(files, "path").mapInPandas(heads(SOURCE_FILE, "value", head_bytes), f"{SOURCE_FILE} string, value string")


def union_scans(*scans: DataFrame) -> DataFrame:
    """Scans of different schemas as one frame, absent columns NULL."""
    out = scans[0]
    for s in scans[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out
