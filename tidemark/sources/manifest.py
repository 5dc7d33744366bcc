"""Manifests: one row per landed file, and the filters that narrow them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.expressions import as_column, gigabytes, glob_to_regex, minus
from tidemark.sources import listing
from tidemark.sources.paths import canonical, day_partitions


def fingerprint(size: Column, modified_at: Column) -> Column:
    """Stand-in for an object-store ETag, which Spark does not expose."""
    return F.sha2(F.concat_ws("#", size.cast("string"), F.date_format(modified_at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")), 256)


def content_etag(content: Column) -> Column:
    return F.md5(content)


def strip_etag(etag: Column) -> Column:
    """Stores return the ETag in double quotes."""
    return F.regexp_replace(etag, '"', "")


def list_files(spark: SparkSession, *roots: str) -> DataFrame:
    """Complete recursive listing, empty files included."""
    found = listing.walk(spark, list(roots))
    return found.select(
        canonical(F.col("path")).alias("path"),
        "size_bytes",
        "modified_at",
        fingerprint(F.col("size_bytes"), F.col("modified_at")).alias("etag"),
    )


def list_binary(spark: SparkSession, *roots: str, glob: str | None = None) -> DataFrame:
    """Listing through ``binaryFile`` with the content column pruned; leaves out empty files."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    found = reader.load(list(roots))
    return found.select(
        canonical(F.col("path")).alias("path"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified_at"),
        fingerprint(F.col("length"), F.col("modificationTime")).alias("etag"),
    )


def match_suffix(manifest: DataFrame, pattern: str) -> DataFrame:
    """Pattern with the stars dropped, matched as a path suffix."""
    return manifest.filter(F.col("path").endswith(pattern.replace("*", "")))


def match_glob(manifest: DataFrame, pattern: str) -> DataFrame:
    return manifest.filter(F.col("path").rlike(glob_to_regex(pattern)))


def modified_since(manifest: DataFrame, since) -> DataFrame:
    return manifest.filter(F.col("modified_at") >= as_column(since))


def modified_between(manifest: DataFrame, first=None, last=None) -> DataFrame:
    """Backfill range; both ends are inclusive and optional."""
    out = manifest
    if first is not None:
        out = out.filter(F.col("modified_at") >= as_column(first))
    if last is not None:
        out = out.filter(F.col("modified_at") <= as_column(last))
    return out


def lookback(manifest: DataFrame, as_of, days: int = 7) -> DataFrame:
    return modified_since(manifest, minus(as_column(as_of), days=days))


def first_files(manifest: DataFrame, max_files: int) -> DataFrame:
    """The first files in key order, applied after every filter."""
    return manifest.orderBy("path").limit(max_files)


def in_day_partitions(manifest: DataFrame, first_day, last_day) -> DataFrame:
    """Only files below the ``year=/month=/day=`` prefixes of the range; the days are the small side."""
    spark = manifest.sparkSession
    days = spark.range(1).select(
        F.explode(day_partitions(as_column(first_day), as_column(last_day))).alias("day_prefix")
    )
    own = F.regexp_extract("path", r"(year=\d+/month=\d+/day=\d+)/", 1)
    return manifest.withColumn("day_prefix", own).join(days, "day_prefix", "left_semi").drop("day_prefix")


def day_roots(base: str, first_day, last_day) -> list[str]:
    """The same prefixes as listing roots, so the other days are never listed."""
    from datetime import timedelta

    n = (last_day - first_day).days
    days = (first_day + timedelta(days=i) for i in range(n + 1))
    return [f"{base.rstrip('/')}/year={d.year}/month={d.month:02d}/day={d.day:02d}" for d in days]


def discover(
    spark: SparkSession,
    *roots: str,
    pattern: str | None = None,
    match: str = "suffix",
    since=None,
    max_files: int | None = None,
) -> DataFrame:
    """Listing with pattern, date and count filters."""
    found = list_files(spark, *roots)
    if pattern:
        found = match_glob(found, pattern) if match == "glob" else match_suffix(found, pattern)
    if since is not None:
        found = modified_since(found, since)
    if max_files is not None:
        found = first_files(found, max_files)
    return found


def summarize(manifest: DataFrame, *by: str) -> DataFrame:
    """File count, size and date range, per group or in all."""
    return manifest.groupBy(*by).agg(
        F.count("*").alias("file_count"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("bigint").alias("total_bytes"),
        F.round(gigabytes(F.coalesce(F.sum("size_bytes"), F.lit(0))), 6).alias("total_gb"),
        F.min("modified_at").alias("oldest_file"),
        F.max("modified_at").alias("newest_file"),
    )


def union_manifests(*manifests: DataFrame) -> DataFrame:
    out = manifests[0]
    for m in manifests[1:]:
        out = out.unionByName(m)
    return out


NOTIFICATION = (
    "Records array<struct<eventTime:string,s3:struct<bucket:struct<name:string>,"
    "object:struct<key:string,size:bigint,eTag:string>>>>"
)


def from_notifications(messages: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """Manifest rows of bucket-event messages, and the messages that could not be read.

    Works on a batch or a stream of messages.
    """
    parsed = messages.withColumn("_event", F.from_json(F.col(body), NOTIFICATION))
    usable = F.coalesce(F.size("_event.Records") > 0, F.lit(False))
    records = parsed.filter(usable).select(F.explode("_event.Records").alias("r"))
    good = (
        F.col("r.s3.bucket.name").isNotNull() & F.col("r.s3.object.key").isNotNull()
    )
    manifest = records.filter(good).select(
        F.concat(F.lit("s3a://"), F.col("r.s3.bucket.name"), F.lit("/"), F.col("r.s3.object.key")).alias("path"),
        F.col("r.s3.object.size").alias("size_bytes"),
        F.to_timestamp("r.eventTime").alias("modified_at"),
        strip_etag(F.col("r.s3.object.eTag")).alias("etag"),
    )
    incomplete = F.exists(
        "_event.Records",
        lambda r: r["s3"]["bucket"]["name"].isNull() | r["s3"]["object"]["key"].isNull(),
    )
    rejected = parsed.filter(~usable | F.coalesce(incomplete, F.lit(True))).drop("_event")
    return manifest, rejected
