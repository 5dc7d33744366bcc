"""Where jobs keep tables they write on the way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach, from ``spark.checkpoint.dir``.

    Only a local master without that setting falls back to a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    root = "file:" + tempfile.mkdtemp(prefix="tidemark-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared root."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once to shared storage and read back: cuts lineage and survives executor loss."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _hadoop(spark: SparkSession, path: str):
    """The Hadoop file system that owns a path, and the path on it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def delete_path(spark: SparkSession, path: str) -> bool:
    fs, target = _hadoop(spark, path)
    return fs.delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, target = _hadoop(spark, path)
    return fs.exists(target)


def make_folder(spark: SparkSession, path: str) -> None:
    fs, target = _hadoop(spark, path)
    fs.mkdirs(target)


def list_folder(spark: SparkSession, path: str) -> list[str]:
    """Paths of what lies directly in a folder."""
    fs, target = _hadoop(spark, path)
    return [str(s.getPath().toString()) for s in fs.listStatus(target)] if fs.exists(target) else []


def folder_bytes(spark: SparkSession, *paths: str) -> int:
    """Bytes of the files below some folders."""
    total = 0
    for path in paths:
        fs, target = _hadoop(spark, path)
        total += fs.getContentSummary(target).getLength()
    return total


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as text."""
    fs, target = _hadoop(spark, path)
    stream = fs.open(target)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def claim_file(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file that appears whole, unless its name is taken; of two writers one gets it."""
    fs, target = _hadoop(spark, path)
    jvm = spark.sparkContext._jvm
    draft = jvm.org.apache.hadoop.fs.Path(f"{path.rsplit('/', 2)[0]}/.draft-{uuid.uuid4().hex}")
    fs.mkdirs(target.getParent())
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    rename = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(target), jvm.java.lang.reflect.Array.newInstance(rename, 0))
        return True
    except Exception as e:
        if "FileAlreadyExists" not in str(e):
            raise
        fs.delete(draft, False)
        return False
