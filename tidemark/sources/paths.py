"""Storage URIs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# URI schemes of the supported object stores, with the scheme Spark reads them by.
SPARK_SCHEME = {"s3": "s3a", "s3a": "s3a", "gs": "gs", "wasbs": "wasbs", "abfss": "abfss", "hdfs": "hdfs"}
_URI = r"^([a-z0-9]+)://([^/]*)/?(.*)$"


def split_uri(uri: Column, schemes: tuple[str, ...] = ("s3", "s3a")) -> Column:
    """``struct(scheme, bucket, prefix, uri)`` with the Spark scheme; other schemes raise."""
    scheme = F.regexp_extract(uri, _URI, 1)
    spark_scheme = F.element_at(
        F.create_map(*[F.lit(x) for s in schemes for x in (s, SPARK_SCHEME[s])]), scheme
    )
    checked = F.when(
        ~scheme.isin(*schemes),
        F.raise_error(F.concat(F.lit("Invalid path format: "), uri, F.lit(f"; expected one of {', '.join(schemes)}"))),
    ).otherwise(spark_scheme)
    bucket = F.regexp_extract(uri, _URI, 2)
    prefix = F.regexp_extract(uri, _URI, 3)
    return F.struct(
        checked.alias("scheme"),
        bucket.alias("bucket"),
        prefix.alias("prefix"),
        F.concat(checked, F.lit("://"), bucket, F.lit("/"), prefix).alias("uri"),
    )


def canonical(path: Column) -> Column:
    """One spelling per file: local paths are written ``file:/x`` and ``file:///x`` by different APIs."""
    return F.regexp_replace(path, r"^file:/+", "file:/")


def scanned_file(metadata_path: Column) -> Column:
    """The listed path of a row's file: Spark's file metadata escapes spaces, brackets and the like."""
    return canonical(F.url_decode(F.replace(metadata_path, F.lit("+"), F.lit("%2B"))))


def escape_glob(path: str) -> str:
    """Spark reads ``[ ] { } * ?`` in a path as a glob; a listed path is meant literally."""
    return "".join("\\" + c if c in "[]{}*?" else c for c in path)


def day_partitions(first_day: Column, last_day: Column) -> Column:
    """``year=/month=/day=`` prefixes of every day in the closed range."""
    return F.transform(
        F.sequence(F.to_date(first_day), F.to_date(last_day), F.expr("interval 1 day")),
        lambda d: F.format_string("year=%d/month=%02d/day=%02d", F.year(d), F.month(d), F.dayofmonth(d)),
    )
