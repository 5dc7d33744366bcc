"""Fingerprints of whole texts by winnowing, and their likeness to an edited copy and to a neighbour.

Method
    Every run of ``GRAM`` code points has a polynomial rolling hash. Of each ``WINDOW`` neighbouring runs the smallest
    hash is chosen, of equal ones the rightmost, and a fingerprint holds the chosen hashes with their places.
    Guarantee: two texts that share ``GRAM + WINDOW - 1`` code points in a row share a chosen hash there, and no two
    chosen places are more than ``WINDOW`` apart, nor is anything shorter than ``GRAM`` ever matched.
    The hash of all runs is made at once: a run of 2n code points is the run of its first n, moved by a power of the
    base, plus that of its last n. Window minima grow in the same way from 1 to ``WINDOW``.

Written form
    ``RECORD`` bytes for each chosen place: its distance from the one before (the first: from the start), 48 bits
    of its hash; in base64. ``places`` reads it.

Defined cases
    A null text is an empty one; an empty text has an empty fingerprint. A text shorter than ``GRAM`` is one run; one
    with fewer than ``WINDOW`` runs is one window. Likeness is the share of two fingerprints' distinct hashes that they
    have in common; it is 1 for two empty ones and 0 if one is empty. Very long texts are worked on in pieces of
    ``PIECE`` code points that overlap by what a window sees, so the result does not depend on it. Rows without
    ``doc_id`` come last, equal ids by their text; repeated rows are each other's neighbours. A lone document is its
    own next one. Other columns are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import as_bytes, id_range, texts
from tidemark.llm.text import BASE, U, mix

GRAM, WINDOW = 16, 32  # powers of two
PIECE = 1 << 20
RECORD = 7


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def gram_hashes(points: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """The hash of each run of ``gram`` code points; of all of them if there are fewer."""
    h = mix(points.astype(U) + U(BASE))
    width, power = 1, BASE
    while width < gram and 2 * width <= len(points):
        h = h[:-width] * U(power) + h[width:]
        width, power = 2 * width, power * power % (1 << 64)
    if width < gram:  # a text shorter than a run
        return np.frombuffer(hashlib.blake2b(points.tobytes(), digest_size=8).digest(), dtype="<u8").astype(U)
    return mix(h)


def chosen(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The places of window minima, the rightmost of equal ones, in order."""
    at, width = np.arange(len(hashes)), 1
    while width < window and len(at) > 1:
        step = min(width, window - width, len(at) - 1)
        left, right = at[:-step], at[step:]
        at = np.where(hashes[right] <= hashes[left], right, left)
        width += step
    return at[np.concatenate(([True], at[1:] != at[:-1]))]


def winnow(text: str, gram: int = GRAM, window: int = WINDOW, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of a text's fingerprint."""
    points = code_points(text)
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0, U)
    places, found, start = [], [], 0
    while True:
        # A piece begins with the last window of the one before, so each window is seen whole.
        part = points[start : start + piece + gram + window - 2]
        hashes = gram_hashes(part, gram)
        at = chosen(hashes, window)
        places.append(at + start)
        found.append(hashes[at])
        if start + piece + gram + window - 2 >= len(points):
            break
        start += piece
    place, value = np.concatenate(places), np.concatenate(found)
    first = np.concatenate(([True], place[1:] != place[:-1]))
    return place[first], value[first]


def written(place: np.ndarray, value: np.ndarray) -> str:
    out = np.empty((len(place), RECORD), dtype=np.uint8)
    out[:, 0] = np.diff(place, prepend=0)
    out[:, 1:] = value.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : RECORD - 1]
    return base64.b64encode(out.tobytes()).decode()


def places(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and 48-bit hashes of a written fingerprint."""
    raw = np.frombuffer(base64.b64decode(fingerprint), dtype=np.uint8).reshape(-1, RECORD)
    value = np.zeros((len(raw), 8), dtype=np.uint8)
    value[:, : RECORD - 1] = raw[:, 1:]
    return np.cumsum(raw[:, 0], dtype=np.int64), value.reshape(-1).view("<u8").astype(U)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of two sorted sets' union that they have in common."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def _print(text: str) -> tuple[str, np.ndarray]:
    place, value = winnow(text)
    return written(place, value), np.unique(value)


# -- neighbours ---------------------------------------------------------------------------------------------------


def neighbours(docs: DataFrame) -> DataFrame:
    """``bucket, borrowed, doc_id, text`` in partitions where each document is followed by the next one.

    Documents are dealt into ranges of ``doc_id`` by quantiles of that column alone. The first document of a range
    is dealt a second time, as a borrowed row, to the range before it: one row per range. Texts are moved once.
    """
    spark, base = docs.sparkSession, texts(docs)
    number, ranges = id_range(base, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # From the largest ids on; rows without an id come last and have the range after all others.
    own = base.withColumn("bucket", F.when(F.col("doc_id").isNull(), ranges).otherwise(ranges - 1 - number)).withColumn("borrowed", F.lit(False))

    heads = own.groupBy("bucket").agg(F.max("doc_id").alias("head")).orderBy("bucket").collect()  # a row per range
    lent = [(r.head, heads[k - 1].bucket) for k, r in enumerate(heads)]
    lent = F.broadcast(spark.createDataFrame(lent, "head long, to int"))  # as many rows as ranges
    first = base.join(lent, base["doc_id"].eqNullSafe(lent["head"])).groupBy("doc_id", "to").agg(F.min("text").alias("text"))
    borrowed = first.select("doc_id", "text", F.col("to").alias("bucket"), F.lit(True).alias("borrowed"))
    both = own.unionByName(borrowed).select("bucket", "borrowed", "doc_id", "text")
    return both.repartitionById(ranges + 1, "bucket").sortWithinPartitions("bucket", "borrowed", F.col("doc_id").desc_nulls_last(), "text")


PRINTS = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string())]
    + [("near_edited", pa.float64()), ("near_next", pa.float64())]
)


def _compare(batches):
    """Goes through the ordered rows and holds one document at a time beside the one that follows it."""
    before, rows, size = None, [], 0
    for batch in batches:
        columns = batch.column("bucket").to_pylist(), batch.column("borrowed").to_pylist(), batch.column("doc_id").to_pylist()
        for bucket, borrowed, name, data in zip(*columns, as_bytes(batch.column("text"))):
            if before and before[0] != bucket:
                before = None
            text = data.decode("utf-8", "replace")
            now = bucket, name, text, *_print(text)
            if before:
                _, own, held, fingerprint, values = before
                cut = len(held) // 3
                edited = held[: len(held) - cut] + text[:cut]
                edited_print, edited_values = _print(edited)
                digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                rows.append((own, len(held), digest, fingerprint, edited_print, likeness(values, edited_values), likeness(values, now[4])))
                size += len(fingerprint) + len(edited_print)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), PRINTS.types)], schema=PRINTS)
                    rows, size = [], 0
            before = None if borrowed else now
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), PRINTS.types)], schema=PRINTS)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: its fingerprint, that of its text with the last third replaced by the start of the next
    document's, and its likeness to that text and to the next document."""
    kind = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return neighbours(docs).mapInArrow(_compare, kind)
