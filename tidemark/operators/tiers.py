"""Retention in tiers: file rows of the last weeks, daily sums of the last year, nothing before that."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.expressions import as_column, minus
from tidemark.model import LEDGER_SCHEMA
from tidemark.operators.analytics import rollup
from tidemark.operators.state_store import StateStore
from tidemark.workspace import delete_path, list_folder

DAILY = "ingestion_id string, window_start timestamp, file_count bigint, failed_count bigint, records bigint, bytes bigint"


class Tiers:
    """The tiers of a store, below ``root``.

    ``moved/pass=<token>``: file rows taken out of the state that are not summed yet. ``daily/pass=<token>``: sums of a
    pass; those of several passes add up, as a file row is in one pass only. A pass that was lost on the way is made up
    for by the next one: moved rows are summed under their own token, which replaces itself, and then deleted.
    """

    def __init__(self, store: StateStore, root: str):
        self.store, self.root, self.spark = store, root.rstrip("/"), store.spark

    def _parts(self, tier: str) -> list[str]:
        return sorted(p for p in list_folder(self.spark, f"{self.root}/{tier}") if p.rsplit("/", 1)[-1].startswith("pass="))

    def run(self, as_of, detail_days: int = 30, aggregate_days: int = 365) -> int:
        """One pass; returns how many file rows became sums. Parts without any day that is still kept are deleted."""
        taken = self.store.retire(f"{self.root}/moved", as_of, detail_days)
        for path in self._parts("moved"):
            rows = self.spark.read.schema(LEDGER_SCHEMA).parquet(path)
            self._keep(rollup(rows, "day"), as_of, aggregate_days).write.mode("overwrite").parquet(f"{self.root}/daily/{path.rsplit('/', 1)[-1]}")
            delete_path(self.spark, path)
        for path in self._parts("daily"):
            if self._keep(self._read([path]), as_of, aggregate_days).isEmpty():
                delete_path(self.spark, path)
        return taken

    def _keep(self, sums: DataFrame, as_of, days: int) -> DataFrame:
        horizon = F.date_trunc("day", minus(as_column(as_of), days=days).cast("timestamp"))
        return sums.filter(F.col("window_start") >= horizon)

    def _read(self, parts: list[str]) -> DataFrame:
        return self.spark.read.schema(DAILY).parquet(*parts) if parts else self.spark.createDataFrame([], DAILY)

    @staticmethod
    def _sum(rows: DataFrame) -> DataFrame:
        return rows.groupBy("ingestion_id", "window_start").agg(*[F.sum(c).cast("bigint").alias(c) for c in ("file_count", "failed_count", "records", "bytes")])

    def daily(self, as_of, aggregate_days: int = 365) -> DataFrame:
        """The sums of the days that are kept, a row per ingestion and day."""
        return self._sum(self._keep(self._read(self._parts("daily")), as_of, aggregate_days))

    def detail(self) -> DataFrame:
        """The file rows that are kept."""
        return self.store.state()
