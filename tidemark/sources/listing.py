"""File listing by Spark tasks, functions that look into listed files, and a stream of moments to list at.

``binaryFile`` leaves out empty files and keeps the whole listing in driver memory; this listing keeps
empty files and spreads over as many tasks as the tree needs.
"""

from __future__ import annotations

import sys
import time
from collections import deque
from datetime import datetime, timezone

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Observation, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tidemark.workspace import scratch

LISTED = "path string, size_bytes bigint, modified_at timestamp, pending boolean"
# What the first task of a listing may spend, and what a folder costs beside its files.
FIRST_BUDGET, FOLDER_COST = 20_000, 200
# Tasks of a round: one per folder up to one per core, then one per so many folders up to some per core.
FOLDERS_PER_TASK, TASKS_PER_CORE = 8, 4
BATCH_ROWS = 10_000


# Workers get this module's code with the task, so they need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def spelling(uri: str) -> tuple[str, str, str]:
    """How pyarrow names a URI, and what to put before its paths in place of what to cut off to get URIs back.

    Bucket stores give paths that begin with the bucket, container stores with the container but without the account,
    others give plain paths without the host.
    """
    scheme, _, rest = uri.partition("://")
    authority = rest.split("/", 1)[0]
    if scheme in ("s3", "s3a", "s3n", "gs"):
        return ("gs://" if scheme == "gs" else "s3://") + rest, f"{scheme}://" if scheme == "gs" else "s3a://", ""
    if scheme in ("abfs", "abfss", "wasb", "wasbs"):
        container, _, account = authority.partition("@")
        own = uri if scheme.startswith("abfs") else f"abfss://{container}@{account.replace('.blob.', '.dfs.')}{rest[len(authority):]}"
        return own, f"{scheme}://{authority}/", f"{container}/"
    return uri, f"{scheme}://{authority}", ""


def _open(uri: str):
    """File system, path on it, and a function that turns its paths back into URIs."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/"), "file:".__add__
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri, "file:".__add__
    own, prefix, cut = spelling(uri)
    opened, path = fs.FileSystem.from_uri(own)
    return opened, path, lambda found: prefix + found.removeprefix(cut)


def _children(uri: str):
    from pyarrow import fs

    system, path, named = _open(uri)
    selector = fs.FileSelector(path, recursive=False, allow_not_found=True)
    for info in system.get_file_info(selector):
        if not info.base_name.startswith(("_", ".")):
            yield info, named(info.path), info.type == fs.FileType.Directory


def explore(budget: int):
    """Function for ``mapInArrow``: what lies below the given folders, breadth first, until the budget is spent.

    A file costs one, the listing of a folder ``FOLDER_COST``. Folders that are left are given back as pending rows; one is
    always listed, so each round gets further.
    """

    def rows(found, pending: bool):
        import pyarrow as pa

        paths, sizes, times = zip(*found)
        return pa.RecordBatch.from_arrays(
            [pa.array(paths, pa.string()), pa.array(sizes, pa.int64()), pa.array(times, pa.timestamp("us", "UTC")), pa.array([pending] * len(found))],
            names=["path", "size_bytes", "modified_at", "pending"],
        )

    def read(batches):
        spent, left = 0, deque()
        for batch in batches:
            left.extend(batch.column(0).to_pylist())
        while left and spent < budget:
            spent += FOLDER_COST
            files = []
            for info, uri, is_dir in _children(left.popleft()):
                if is_dir:
                    left.append(uri)
                    continue
                spent += 1
                files.append((uri, info.size, info.mtime_ns // 1000))
                if len(files) == BATCH_ROWS:
                    yield rows(files, False)
                    files = []
            if files:
                yield rows(files, False)
        while left:
            yield rows([(left.popleft(), None, None) for _ in range(min(len(left), BATCH_ROWS))], True)

    return read


def walk(spark, roots: list[str], budget: int = FIRST_BUDGET) -> DataFrame:
    """All files below the roots: ``path, size_bytes, modified_at``.

    Folders are listed in rounds. What the tasks of one round leave is dealt anew in the next, with twice the budget: a deep
    or lopsided tree spreads as soon as it is known to be large, and a small one takes one task. Only the number of folders
    left comes to the driver. One folder's own entries are listed by one task, as stores page through them in order.
    """
    base, written = scratch(spark, "listing"), []
    cores = max(spark.sparkContext.defaultParallelism, 8)

    def dealt(folders: DataFrame, n: int) -> DataFrame:
        return folders.repartition(max(1, min(n, max(cores, n // FOLDERS_PER_TASK), TASKS_PER_CORE * cores)))

    frontier = dealt(spark.createDataFrame([(r,) for r in roots], "path string"), len(roots))
    while True:
        left = Observation()
        found = frontier.mapInArrow(explore(budget), LISTED).observe(left, F.count_if("pending").alias("folders"))
        written.append(f"{base}/round-{len(written)}")
        found.write.parquet(written[-1])
        folders = left.get["folders"]
        if not folders:
            break
        pending = spark.read.schema(LISTED).parquet(written[-1]).filter("pending")
        frontier, budget = dealt(pending.select("path"), folders), 2 * budget
    return spark.read.schema(LISTED).parquet(*written).filter("NOT pending").drop("pending")


class Moment(InputPartition):
    def __init__(self, at: int):
        self.at = at


class ArrivalReader(DataSourceStreamReader):
    """Offsets are moments of listing; what was listed then is the plan that the batch's run stores."""

    def initialOffset(self):
        return {"listed_at": 0}

    def latestOffset(self):
        return {"listed_at": time.time_ns() // 1000}

    def partitions(self, start, end):
        return [Moment(end["listed_at"])]

    def read(self, partition):
        yield (datetime.fromtimestamp(partition.at / 1e6, tz=timezone.utc),)


class ArrivalSource(DataSource):
    @classmethod
    def name(cls):
        return "tidemark_arrivals"

    def schema(self):
        return "listed_at timestamp"

    def streamReader(self, schema):
        return ArrivalReader()


def register(spark) -> None:
    spark.dataSource.register(ArrivalSource)


def read_through(fmt: str):
    """Function for ``mapInPandas``: the files that can't be read to their end, with the reason.

    Compressed text is unpacked where Spark and Arrow pack alike (gzip, bzip2, zstd); columnar files are decoded.
    """
    codecs = {".gz": "gzip", ".bz2": "bz2", ".zst": "zstd"}

    def through(path: str) -> None:
        system, inner, _ = _open(path)
        if fmt == "parquet":
            from pyarrow import parquet

            with system.open_input_file(inner) as f:
                for _ in parquet.ParquetFile(f).iter_batches():
                    pass
        elif fmt == "orc":
            from pyarrow import orc

            with system.open_input_file(inner) as f:
                whole = orc.ORCFile(f)
                for k in range(whole.nstripes):
                    whole.read_stripe(k)
        else:
            codec = next((c for end, c in codecs.items() if inner.endswith(end)), None)
            with system.open_input_stream(inner, compression=codec) as f:
                while f.read(1 << 20):
                    pass

    def read(batches):
        for batch in batches:
            why = []
            for path in batch["path"]:
                try:
                    through(path)
                    why.append(None)
                except Exception as e:
                    why.append(f"{type(e).__name__}: {e}")
            told = batch.assign(message=why)
            yield told[told["message"].notna()]

    return read


def footer_schemas(fmt: str, failed: str, error_type: str):
    """Function for ``mapInPandas``: per file its Spark schema from the footer, or that it cannot be read."""

    def schema_json(path: str) -> str:
        from pyspark.sql.pandas.types import from_arrow_schema

        system, inner, _ = _open(path)
        with system.open_input_file(inner) as f:
            if fmt == "parquet":
                from pyarrow import parquet

                found = parquet.read_schema(f)
                own = (found.metadata or {}).get(b"org.apache.spark.sql.parquet.row.metadata")
                return own.decode() if own else from_arrow_schema(found).json()
            from pyarrow import orc

            return from_arrow_schema(orc.ORCFile(f).schema).json()

    def read(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for path in batch.iloc[:, 0]:
                try:
                    rows.append((path, schema_json(path), None, None, None))
                except Exception as e:
                    rows.append((path, None, failed, error_type, str(e)))
            yield pd.DataFrame(rows, columns=[batch.columns[0], "found", "verdict", "error_type", "message"], dtype=object)

    return read


def heads(file_column: str, value_column: str, limit: int):
    """Function for ``mapInPandas``: the whole lines within the first bytes of each file, at least one of them.

    No more than that is read: of compressed files so many bytes are unpacked. A first line that is longer is read on.
    """

    def lines(path: str) -> list[str]:
        system, inner, _ = _open(path)
        data, more = b"", True
        with system.open_input_stream(inner) as f:
            while more and (len(data) < limit or b"\n" not in data):
                part = f.read(limit)
                data, more = data + part, bool(part)
            if more and not data.endswith(b"\n") and f.read(1):
                data = data[: data.rindex(b"\n")]
        return data.decode("utf-8", "replace").splitlines() if data else []

    def read(batches):
        import pandas as pd

        for batch in batches:
            rows = [(path, line) for path in batch.iloc[:, 0] for line in lines(path)]
            yield pd.DataFrame(rows, columns=[file_column, value_column], dtype=object)

    return read
