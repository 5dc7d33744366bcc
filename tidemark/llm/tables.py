"""Input tables and small helpers that the operators of this package share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone; a missing text is an empty one."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def as_bytes(column):
    """The UTF-8 bytes of an Arrow text column, row by row."""
    import pyarrow as pa

    return column.cast(pa.binary()).to_pylist()


def keep_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` is in ``ids``, and those without a ``doc_id``."""
    right = ids.select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(right, docs["doc_id"] == right["_kept_id"], "left_semi").unionByName(docs.filter("doc_id IS NULL"))


def drop_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` is not in ``ids``."""
    right = ids.select(F.col("doc_id").alias("_gone_id")).filter("_gone_id IS NOT NULL").distinct()
    return docs.join(right, docs["doc_id"] == right["_gone_id"], "left_anti")


def id_range(base: DataFrame, ranges: int):
    """The number of a row's range of ``doc_id``, from 0 on in ascending order, and how many ranges there are.

    The ranges are cut at quantiles of that column alone, so nothing else is read for them; their bounds, at most
    ``ranges``, are what comes to the driver. Equal ids are in one range, those missing in the first.
    """
    shares = [k / ranges for k in range(1, ranges)]
    found = base.agg(F.percentile_approx("doc_id", shares, 10_000 + 100 * ranges).alias("cuts")).first().cuts if shares else None
    cuts = sorted(set(found or []))
    if not cuts:
        return F.lit(0), 1
    # A coarse and a fine look-up keep the comparisons of a row few.
    wide = max(1, int(len(cuts) ** 0.5))
    every, marks = (F.array(*(F.lit(c) for c in some)) for some in (cuts, cuts[::wide]))
    coarse = F.greatest(F.size(F.filter(marks, lambda c: c <= F.col("doc_id"))) - 1, F.lit(0)) * wide
    fine = F.size(F.filter(F.slice(every, coarse + 1, F.lit(wide)), lambda c: c <= F.col("doc_id")))
    return F.when(F.col("doc_id").isNull(), 0).otherwise(coarse + fine), len(cuts) + 1
