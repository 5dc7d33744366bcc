"""Merge by key into snapshots, and what a merge would do."""

from __future__ import annotations

import json
from datetime import datetime, timezone
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.expressions import first_per_key
from tidemark.workspace import claim_file, delete_path, list_folder, materialize, read_text


def dedupe(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Latest row per key, ties broken by the whole row; one row per key and task reaches the shuffle."""
    tie = [c for c in df.columns if c not in keys and c not in order]
    if not order and not tie:
        return df.dropDuplicates(keys)
    return first_per_key(df, keys, [*order, *tie])


def merge_rows(target: DataFrame, source: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """New snapshot: source rows replace target rows of the same key, the rest is kept.

    The source is deduplicated first; target rows are never shuffled by more than the key join.
    """
    new = dedupe(source, keys, order)
    return without_keys(target, new, keys).unionByName(new, allowMissingColumns=True)


def without_keys(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Target rows whose key is not among the new ones; a missing key value equals another one."""
    found = new.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    return target.join(found, reduce(and_, [target[k].eqNullSafe(found[f"_k{i}"]) for i, k in enumerate(keys)]), "left_anti")


def merge_preview(target: DataFrame, source: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Row counts of a merge: existing, new, updated, unchanged."""
    flags = _matched(target, source, keys, order)
    in_target, in_source = F.col("_t").isNotNull(), F.col("_s").isNotNull()
    return flags.agg(
        F.count_if(in_target).alias("existing_rows"),
        F.count_if(in_source & ~in_target).alias("new_rows"),
        F.count_if(in_source & in_target & ~F.col("_same")).alias("updated_rows"),
        F.count_if(in_source & in_target & F.col("_same")).alias("identical_rows"),
    )


def merge_changes(target: DataFrame, source: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Updated keys with old and new values, one row per changed column."""
    new = dedupe(source, keys, order)
    columns = [c for c in target.columns if c not in keys and c in new.columns]
    a = target.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in columns])
    b = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in columns])
    changes = F.filter(
        F.array(*[
            F.struct(
                F.lit(c).alias("column_name"),
                F.col(f"_o_{c}").cast("string").alias("old_value"),
                F.col(f"_n_{c}").cast("string").alias("new_value"),
                (~F.col(f"_o_{c}").eqNullSafe(F.col(f"_n_{c}"))).alias("changed"),
            )
            for c in columns
        ]),
        lambda x: x["changed"],
    )
    return (
        a.join(b, keys)
        .select(*keys, F.explode(changes).alias("_c"))
        .select(*keys, "_c.column_name", "_c.old_value", "_c.new_value")
    )


def _matched(target: DataFrame, source: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    new = dedupe(source, keys, order)
    columns = [c for c in target.columns if c not in keys and c in new.columns]
    a = target.select(*keys, F.struct(F.lit(True).alias("_in"), *columns).alias("_t"))
    b = new.select(*keys, F.struct(F.lit(True).alias("_in"), *columns).alias("_s"))
    same = reduce(
        lambda x, c: x & F.col(f"_t.`{c}`").eqNullSafe(F.col(f"_s.`{c}`")), columns, F.lit(True)
    )
    return a.join(b, keys, "full_outer").withColumn("_same", same)


def swap_snapshot(rows: DataFrame, name: str, location: str) -> None:
    """Publishes rows, which may be read from ``name`` itself, under that name.

    They go to a new folder below ``location`` and the name, a view, is replaced in one step: readers see the old rows
    or the new ones. The snapshot before stays for readers that have begun with it; older ones are removed.
    """
    spark = rows.sparkSession
    path = f"{location}/snapshot-{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}-{_token()[:8]}"
    rows.write.parquet(path)
    if spark.catalog.tableExists(name) and spark.catalog.getTable(name).tableType != "VIEW":
        spark.sql(f"DROP TABLE {name}")
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM parquet.`{path}`")
    for old in sorted(list_folder(spark, location))[:-2]:
        delete_path(spark, old)


class Buckets:
    """A published table cut by the hash of its key, of which a merge rewrites only the buckets it touches.

    Below ``location``: ``rows/v=<version>/_bucket=<n>`` with the rows, ``manifest/<number>`` with the version of each bucket.
    A manifest belongs to a table ``<name>_s<number>`` whose partitions lie where it says, and the published name
    is a view of the newest, replaced in one step. The snapshot before stays for readers that have begun with it.
    Two rows with the same missing key value are one key.
    """

    ROWS = 1_000_000

    def __init__(self, spark: SparkSession, name: str, location: str, keys: list[str]):
        self.spark, self.name, self.location, self.keys = spark, name, location.rstrip("/"), keys

    def manifest(self) -> tuple[int, dict]:
        numbers = sorted(p.rsplit("/", 1)[-1] for p in list_folder(self.spark, f"{self.location}/manifest"))
        if not numbers:
            return 0, {"buckets": 0, "held": {}}
        return int(numbers[-1]), json.loads(read_text(self.spark, f"{self.location}/manifest/{numbers[-1]}"))

    def number(self, buckets: int):
        return F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int")

    def merge(self, new: DataFrame) -> list[int]:
        """Puts rows, one per key, in the place of those with their keys; returns the buckets that were written."""
        spark, (at, old) = self.spark, self.manifest()
        there = spark.table(self.name) if spark.catalog.tableExists(self.name) else None
        new = materialize(new, "merged-rows")
        fields = {f.name.lower(): f for f in new.schema.fields}
        have = {f.name.lower(): f for f in there.schema.fields} if there is not None else {}
        # Rows stored with other types, or without buckets, are all written anew.
        same = at > 0 and all(fields[n].dataType == f.dataType for n, f in have.items() if n in fields)
        size = new.count() + (there.count() if there is not None else 0)
        buckets = max(8, 1 << max(0, -(-size // self.ROWS) - 1).bit_length())
        whole = not same or buckets > 2 * old["buckets"]
        buckets = buckets if whole else old["buckets"]
        fresh = new.withColumn("_bucket", self.number(buckets))
        if whole:
            before = there.withColumn("_bucket", self.number(buckets)) if there is not None else None
            held = {}
        else:
            touched = [r[0] for r in fresh.select("_bucket").distinct().collect()]  # at most the number of buckets
            before = spark.table(f"{self.name}_s{at}").filter(F.col("_bucket").isin(touched))
            held = {b: v for b, v in old["held"].items() if int(b) not in touched}
        rows = fresh if before is None else without_keys(before, new, self.keys).unionByName(fresh, allowMissingColumns=True)
        version = _token()
        path = f"{self.location}/rows/v={version}"
        rows.repartition("_bucket").write.partitionBy("_bucket").parquet(path)
        written = [p.rsplit("=", 1)[-1] for p in list_folder(spark, path) if "/_bucket=" in p]
        held |= {b: version for b in written}
        if not claim_file(spark, f"{self.location}/manifest/{at + 1:010d}", json.dumps({"buckets": buckets, "held": held})):
            delete_path(spark, path)
            raise RuntimeError(f"another merge into {self.name} came first")
        self.publish(at + 1, held, rows.schema)
        self.clean(at, {*old["held"].values(), *held.values()})
        return sorted(int(b) for b in written)

    def publish(self, number: int, held: dict, schema) -> None:
        spark, table = self.spark, f"{self.name}_s{number}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet PARTITIONED BY (_bucket) LOCATION '{self.location}/empty'")
        parts = " ".join(f"PARTITION (_bucket = {b}) LOCATION '{self.location}/rows/v={v}/_bucket={b}'" for b, v in held.items())
        if parts:
            spark.sql(f"ALTER TABLE {table} ADD {parts}")
        if spark.catalog.tableExists(self.name) and spark.catalog.getTable(self.name).tableType != "VIEW":
            spark.sql(f"DROP TABLE {self.name}")
        shown = ", ".join(f"`{f.name}`" for f in schema.fields if f.name != "_bucket")
        spark.sql(f"CREATE OR REPLACE VIEW {self.name} AS SELECT {shown} FROM {table}")

    def clean(self, before: int, named: set[str]) -> None:
        """Takes away what neither this snapshot nor the one before needs."""
        spark = self.spark
        for path in list_folder(spark, f"{self.location}/manifest"):
            number = int(path.rsplit("/", 1)[-1])
            if number < before:
                spark.sql(f"DROP TABLE IF EXISTS {self.name}_s{number}")
                delete_path(spark, path)
        for path in list_folder(spark, f"{self.location}/rows"):
            if path.rsplit("=", 1)[-1] not in named:
                delete_path(spark, path)


def drop_published(spark: SparkSession, name: str, location: str) -> None:
    """Takes a published name and its snapshots away."""
    if spark.catalog.tableExists(name):
        kind = "VIEW" if spark.catalog.getTable(name).tableType == "VIEW" else "TABLE"
        spark.sql(f"DROP {kind} {name}")
    for path in list_folder(spark, f"{location.rstrip('/')}/manifest"):
        spark.sql(f"DROP TABLE IF EXISTS {name}_s{int(path.rsplit('/', 1)[-1])}")
    delete_path(spark, location)


def _token() -> str:
    import uuid

    return uuid.uuid4().hex
