"""Registry of queries with their SQL twins, and the inputs both derive from the given tables."""

from __future__ import annotations

from functools import cached_property
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark.model import LEDGER_SCHEMA
from tidemark.operators.state_store import ORDER as STATE_ORDER, StateStore
from tidemark.workspace import scratch

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

# Moments the time-dependent operators look back from.
MANIFEST_NOW = "2024-02-01 00:00:00"
LEDGER_NOW = "2001-08-15 00:00:00"

DIALECT = {
    "spark": {
        "str": "string",
        "landed": "timestampadd(HOUR, doc_id, TIMESTAMP_NTZ '2024-01-01 00:00:00')",
        "day_before": "modified_at - INTERVAL 1 DAY",
        "finished": "timestampadd(MINUTE, CAST(l_quantity AS int), l_shipdate)",
        "null_ts": "CAST(NULL AS timestamp_ntz)",
    },
    "duckdb": {
        "str": "varchar",
        "landed": "TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id)",
        "day_before": "modified_at - INTERVAL 1 DAY",
        "finished": "l_shipdate + to_minutes(CAST(l_quantity AS bigint))",
        "null_ts": "CAST(NULL AS timestamp)",
    },
}

# One document is one landed file, its source the ingestion; the extension follows the language.
FIXTURES = {
    "manifest": """
SELECT source AS ingestion_id,
       concat('s3a://landing/', source, '/year=', CAST(year(modified_at) AS {str}),
              '/month=', lpad(CAST(month(modified_at) AS {str}), 2, '0'),
              '/day=', lpad(CAST(day(modified_at) AS {str}), 2, '0'),
              '/doc_', CAST(doc_id AS {str}),
              CASE lang WHEN 'en' THEN '.json' WHEN 'de' THEN '.csv' ELSE '.parquet' END) AS path,
       n_chars AS size_bytes, modified_at, md5(text) AS etag, lang, doc_id
FROM (SELECT *, {landed} AS modified_at FROM documents) d
""",
    # Files an earlier run has seen are the labelled ones; the rest is new.
    "ledger": """
SELECT m.ingestion_id, path AS file_path, size_bytes AS file_size_bytes,
       CASE lang WHEN 'fr' THEN NULL WHEN 'de' THEN md5(concat(etag, '#old')) ELSE etag END AS file_etag,
       CASE WHEN size_bytes > 1000 THEN {day_before} ELSE modified_at END AS file_modified_at,
       CASE WHEN quality = 1 AND toxic = 0 THEN 'SUCCESS' WHEN quality = 0 AND toxic = 0 THEN 'FAILED'
            WHEN quality = 1 THEN 'PROCESSING' ELSE 'SKIPPED' END AS status,
       modified_at AS discovered_at, modified_at AS processing_started_at,
       CASE WHEN quality = 1 AND toxic = 1 THEN {null_ts} ELSE modified_at END AS processed_at,
       CASE WHEN quality = 1 AND toxic = 0 THEN size_bytes END AS bytes_read,
       CASE WHEN quality = 0 THEN CASE WHEN lang = 'en' THEN 'JSONDecodeError' ELSE 'TimeoutError' END
            END AS error_type,
       CASE WHEN quality = 0 THEN concat('cannot read ', lang) END AS error_message,
       CASE WHEN quality = 0 THEN CAST(size_bytes % 5 AS int) ELSE 0 END AS retry_count,
       CAST(CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 ELSE 3 END AS int) AS schema_version,
       modified_at AS event_time, 1 AS seq, concat('run_', CAST(m.doc_id AS {str})) AS run_id
FROM manifest m JOIN labels l ON m.doc_id = l.doc_id
""",
    # Every line item is one processing of the file (supplier, part); a file may be processed many times.
    "events_log": """
SELECT concat('ing', CAST(l_suppkey AS {str})) AS ingestion_id,
       concat('s3a://landing/ing', CAST(l_suppkey AS {str}), '/part_', CAST(l_partkey AS {str}), '.json') AS file_path,
       CAST(floor(l_extendedprice * 1000) AS bigint) AS file_size_bytes,
       CASE WHEN l_returnflag = 'A' OR (l_returnflag = 'N' AND l_linestatus = 'F') THEN 'SUCCESS'
            WHEN l_returnflag = 'N' THEN 'PENDING' WHEN l_linestatus = 'F' THEN 'FAILED'
            WHEN l_tax < 0.03 THEN 'PROCESSING' ELSE 'SKIPPED' END AS status,
       l_shipdate AS discovered_at, l_shipdate AS processing_started_at,
       CASE WHEN (l_returnflag = 'N' AND l_linestatus = 'O') OR (l_returnflag = 'R' AND l_linestatus = 'O' AND l_tax < 0.03)
            THEN {null_ts} ELSE {finished} END AS processed_at,
       CASE WHEN l_returnflag = 'A' OR (l_returnflag = 'N' AND l_linestatus = 'F')
            THEN CAST(l_quantity AS bigint) * 100 END AS records_ingested,
       CASE WHEN l_returnflag = 'A' OR (l_returnflag = 'N' AND l_linestatus = 'F')
            THEN CAST(floor(l_extendedprice * 1000) AS bigint) END AS bytes_read,
       CAST(l_quantity AS bigint) * 60000 + l_linenumber * 7 AS processing_duration_ms,
       CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_discount < 0.03 THEN 'JSONDecodeError'
            WHEN l_discount < 0.06 THEN 'TimeoutError' WHEN l_discount < 0.08 THEN 'SchemaEvolutionError'
            ELSE 'OSError' END END AS error_type,
       CASE WHEN l_returnflag = 'R' THEN concat('error at line ', CAST(l_linenumber AS {str}), ' of part ',
            CAST(l_partkey AS {str})) END AS error_message,
       CAST(l_linenumber - 1 AS int) AS retry_count,
       {finished} AS event_time, CAST(l_linenumber AS int) AS seq,
       concat('run_', CAST(l_orderkey AS {str})) AS run_id
FROM lineitem
""",
    "runs": """
SELECT concat('run_', CAST(o_orderkey AS {str})) AS run_id,
       concat('ing', CAST(s_suppkey AS {str})) AS ingestion_id, o_orderdate AS started_at,
       CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'P' THEN 'partial' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
       CAST(floor(o_totalprice) AS bigint) AS records_ingested
FROM orders JOIN customer ON c_custkey = o_custkey
     JOIN (SELECT s_nationkey, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY s_nationkey) s ON s_nationkey = c_nationkey
""",
    "ingestions": """
SELECT concat('ing', CAST(s_suppkey AS {str})) AS ingestion_id, s_name AS name,
       CASE WHEN s_acctbal > 0 THEN 'active' ELSE 'paused' END AS status,
       concat('tenant', CAST(n_regionkey AS {str})) AS tenant_id,
       CASE n_regionkey WHEN 0 THEN 'hourly' WHEN 1 THEN 'daily' WHEN 2 THEN 'weekly' WHEN 3 THEN 'monthly' ELSE 'cron' END AS frequency,
       CASE WHEN n_regionkey < 2 THEN 'json' WHEN n_regionkey = 2 THEN 'csv' ELSE 'parquet' END AS format,
       CAST(floor(s_acctbal * 20) AS bigint) AS row_count_threshold
FROM supplier JOIN nation ON n_nationkey = s_nationkey
""",
    "state": """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY ingestion_id, file_path
         ORDER BY event_time DESC, seq DESC, run_id DESC, file_size_bytes DESC, status DESC) AS rn FROM events_log) t
WHERE rn = 1
""",
    "sources": "SELECT DISTINCT source AS ingestion_id FROM documents",
}
NEEDS = {"ledger": ("manifest",), "state": ("events_log",)}


def duckdb_cte(*names: str) -> str:
    """``WITH`` clause for the named inputs and what they are built on."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in NEEDS.get(n, ()):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + ", ".join(f"{n} AS ({FIXTURES[n].format(**DIALECT['duckdb'])})" for n in order) + " "


class Inputs:
    """The given tables and the frames derived from them, for one data folder."""

    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.sf = spark, sf

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf}/{name}.parquet")

    def derived(self, name: str, **frames: DataFrame) -> DataFrame:
        return self.spark.sql(self.named(FIXTURES[name].format(**DIALECT["spark"]), frames), **frames)

    @staticmethod
    def named(text: str, frames: dict) -> str:
        import re

        for n in frames:
            text = re.sub(rf"(?<=FROM ){n}\b|(?<=JOIN ){n}\b", "{" + n + "}", text)
        return text

    @cached_property
    def manifest(self) -> DataFrame:
        return self.derived("manifest", documents=self.table("documents"))

    @cached_property
    def ledger(self) -> DataFrame:
        return self.derived("ledger", manifest=self.manifest, labels=self.table("labels"))

    @cached_property
    def events_log(self) -> DataFrame:
        return self.derived("events_log", lineitem=self.table("lineitem"))

    @property
    def store(self) -> StateStore:
        """The log in a state store: folded up to the last quarter, then two deltas that are not."""
        def make():
            store = StateStore(self.spark, self.scratch("state"), fold_after=None)
            at = self.events_log.agg(F.percentile_approx(F.unix_micros(F.col("event_time").cast("timestamp")), [0.75, 0.9])).first()[0]
            stamp = F.unix_micros(F.col("event_time").cast("timestamp"))
            parts = [("early", stamp <= at[0]), ("late", (stamp > at[0]) & (stamp <= at[1])), ("latest", stamp > at[1])]
            have = set(self.events_log.columns)
            rows = self.events_log.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in LEDGER_SCHEMA.fields])
            for k, (name, mine) in enumerate(parts):
                store.append("ledger", "all", name, "done", rows.filter(mine))
                if k == 0:
                    store.fold()
            return store

        return self.once("state_store", make)

    def _as_given(self, state: DataFrame) -> DataFrame:
        """Times without a zone, as the given tables have them."""
        return state.withColumns({f.name: F.col(f.name).cast("timestamp_ntz") for f in LEDGER_SCHEMA.fields if f.dataType == T.TimestampType()})

    @cached_property
    def state(self) -> DataFrame:
        return self._as_given(self.store.state())

    def recent(self, now: str, days: int) -> DataFrame:
        """State for a report on the last days before ``now``."""
        return self._as_given(self.store.recent(F.expr(f"TIMESTAMP_NTZ '{now}' - INTERVAL '{days}' DAY")))

    @cached_property
    def runs(self) -> DataFrame:
        return self.derived(
            "runs", orders=self.table("orders"), customer=self.table("customer"), supplier=self.table("supplier")
        )

    @cached_property
    def ingestions(self) -> DataFrame:
        return self.derived("ingestions", supplier=self.table("supplier"), nation=self.table("nation"))

    @cached_property
    def sources(self) -> DataFrame:
        return self.derived("sources", documents=self.table("documents"))

    def scratch(self, name: str) -> str:
        return scratch(self.spark, name)

    def once(self, name: str, make: Callable):
        """Something written once per session and data folder, shared by several queries."""
        key = (self.spark.sparkContext.applicationId, self.sf, name)
        if key not in _WRITTEN:
            _WRITTEN[key] = make()
        return _WRITTEN[key]


_WRITTEN: dict[tuple, object] = {}


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    """Registers ``fn(inputs) -> DataFrame`` and the SQL that must give the same rows."""

    def register(fn):
        QUERIES[name] = lambda spark, sf: fn(Inputs(spark, sf.rstrip("/")))
        if sql is not None:
            SQL[name] = (duckdb_cte(*uses) if uses else "") + sql.strip()
        return fn

    return register
