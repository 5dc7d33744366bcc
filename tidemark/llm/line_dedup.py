"""Line deduplication by overlapping windows of three lines.

Method
    A text is split at ``\\n``. Each run of three consecutive lines is hashed (96 bits); a window of three blank lines
    does not count. A window that occurs more than once keeps its first occurrence, by ``doc_id`` and position, and
    every later one covers its three lines. The positions covered by any window are merged and their lines removed.

Defined cases
    A null text is an empty one; texts of fewer than three lines stay as they are. Rows without ``doc_id`` come first
    in the order. Rows equal in ``doc_id`` and text are one document and are treated alike; rows that share only the
    id are ordered by a hash of their text. Other columns are not looked at. An empty table gives an empty result.

Scale
    Windows are aggregated before the shuffle, so a passage in a third of all documents is a row per task; going back
    to its occurrences is a join, which Spark can split. Texts are shuffled only if lines of them are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.workspace import materialize

WIDTH = 3


def _named(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("name"),
                       F.xxhash64(text).alias("mark"))


def windows(named: DataFrame) -> DataFrame:
    """``name, mark, pos, h1, h2`` per window."""
    lines = f"""transform(array(split(text, '\\n', -1)), l -> CASE WHEN size(l) < {WIDTH} THEN array() ELSE filter(transform(sequence(0, size(l) - {WIDTH}), i ->
                CASE WHEN rlike(concat(l[i], l[i + 1], l[i + 2]), r'[^\\x20\\x09-\\x0D]')
                THEN named_struct('pos', i, 'h1', xxhash64(l[i], l[i + 1], l[i + 2]), 'h2', hash(l[i], l[i + 1], l[i + 2])) END), x -> x IS NOT NULL) END)[0]"""
    return named.select("name", "mark", F.explode(F.expr(lines)).alias("w")).select("name", "mark", "w.pos", "w.h1", "w.h2")


def covered_lines(docs: DataFrame) -> DataFrame:
    """``name, mark, covered``: the merged line positions that later occurrences of repeated windows cover."""
    found = windows(_named(docs)).distinct()
    found = materialize(found, "line-windows")
    first = found.groupBy("h1", "h2").agg(F.min(F.struct("name", "mark", "pos")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = found.join(first, ["h1", "h2"]).filter("struct(name, mark, pos) > first")
    return later.select("name", "mark", F.explode(F.sequence("pos", F.col("pos") + WIDTH - 1)).alias("line")).groupBy("name", "mark").agg(F.collect_set("line").alias("covered"))


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, text, n_lines, n_removed`` per row of ``docs``, the text without the covered lines."""
    named = _named(docs)
    joined = named.join(covered_lines(docs), ["name", "mark"], "left")
    kept = "transform(array(split(text, '\\n', -1)), l -> array_join(transform(array_except(sequence(0, size(l) - 1), covered), i -> l[i]), '\\n'))[0]"
    return joined.select("doc_id", F.when(F.col("covered").isNull(), F.col("text")).otherwise(F.expr(kept)).alias("text"),
                         F.size(F.split("text", "\n", -1)).alias("n_lines"), F.coalesce(F.size("covered"), F.lit(0)).alias("n_removed"))


def line_dedup_sql() -> str:
    """DuckDB's version, with lines compared as text; it takes ``doc_id`` to be unique."""
    return """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
w AS (SELECT doc_id, p, [l[p], l[p + 1], l[p + 2]] AS win FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS p FROM d)),
u AS (SELECT * FROM w WHERE regexp_matches(win[1] || win[2] || win[3], '[^\\x20\\x09-\\x0D]')),
r AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, p) AS k FROM u),
c AS (SELECT doc_id, list(DISTINCT line) AS covered FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS line FROM r WHERE k > 1) GROUP BY doc_id)
SELECT d.doc_id, len(l) AS n_lines, coalesce(len(covered), 0) AS n_removed,
  md5(array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: NOT list_contains(coalesce(covered, []), i)), lambda i: l[i]), chr(10))) AS text_md5
FROM d LEFT JOIN c USING (doc_id)"""
