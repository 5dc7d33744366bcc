"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

Method
    Every distinct shingle set is sketched in rounds. In round ``i`` each shingle is thrown into one of the
    sketch's bins and the bin keeps the smallest ``(round, hash)`` it has seen; rounds go on until every bin is
    filled, and after ``BINS`` rounds round ``BINS + k`` fills bin ``k`` from all shingles, so every coordinate is
    filled for any non-empty set. Bands of ``ROWS`` coordinates are hashed; documents that share a band are
    candidates, and each candidate pair is confirmed on the full shingle sets of its two texts.

Defined cases
    A null text is an empty one. A text without words has no shingle and is linked with nothing. Equal sets are one
    class and are linked without pairs. Rows that share a ``doc_id`` are one document, with the links of all of
    them; a row without ``doc_id`` is linked with nothing. Very long texts have all their shingles. Other columns are
    not looked at. An empty table gives an empty result.

Skew
    Equal sets are merged by a map-side aggregate before bands are made. A band shared by many sets is not paired
    with itself: its members are compared with two pivots, the member with the most company in all its bands and the
    smallest one, which joins nearly all of a group of copies by about n comparisons. Where a band still spans
    several components, the members outside its largest one are held against all by their shingle sets, in blocks of
    bounded size, and only likely links come out and are confirmed. Members of one component are not
    compared again, so links inside components may stay unseen, but none between components is lost.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.tables import as_bytes, texts
from tidemark.llm.text import U, mix, seeds, shingle_hashes, similar
from tidemark.workspace import materialize

BANDS, ROWS = 48, 5
BINS = BANDS * ROWS
PERCENT = 75
# Members of a block; and how many shingles shortened hashes may hide by falling together.
BLOCK, SLACK = 1024, 2
ROUND_SEEDS, BAND_PLACE = seeds(2 * BINS, 21), seeds(ROWS, 22) | U(1)
BAND_SEEDS = seeds(BANDS, 23)
EMPTY = np.iinfo(np.uint64).max


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The sketch of a non-empty set: ``BINS`` numbers, two sets agree in one with the probability of their similarity."""
    bins = np.full(BINS, EMPTY, dtype=U)
    done = 0
    while done < BINS and (bins == EMPTY).any():
        rounds = np.arange(done, min(BINS, done + max(1, math.ceil(1.4 * BINS * math.log(BINS) / len(shingles)))))
        hashed = mix(shingles[None, :] ^ ROUND_SEEDS[rounds][:, None])
        where = ((hashed & U(0xFFFFFFFF)) * U(BINS)) >> U(32)
        value = (rounds.astype(U)[:, None] << U(54)) | (hashed >> U(10))
        np.minimum.at(bins, where.ravel().astype(np.int64), value.ravel())
        done = int(rounds[-1]) + 1
    for k in np.flatnonzero(bins == EMPTY):
        bins[k] = (U(BINS + k) << U(54)) | (mix(shingles ^ ROUND_SEEDS[BINS + k]).min() >> U(10))
    return bins


def bands(shingles: np.ndarray) -> np.ndarray:
    """One number per band; the band's number is part of it."""
    rows = mix(sketch(shingles)).reshape(BANDS, ROWS)
    return mix((rows * BAND_PLACE).sum(axis=1, dtype=U) + BAND_SEEDS).view(np.int64)


SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64()))])


def _sign(batches):
    for batch in batches:
        size, keys, made = [], [], []
        for data in as_bytes(batch.column("text")):
            s = shingle_hashes(data)
            size.append(len(s))
            keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            made.append(bands(s) if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(keys, pa.binary()), pa.array(made, pa.list_(pa.int64()))],
            schema=SIGNED,
        )


def _confirm(batches):
    """Keeps the pairs whose full shingle sets are similar; the sets of the last texts seen are kept at hand."""
    known: dict[bytes, np.ndarray] = {}

    def shingles(data: bytes) -> np.ndarray:
        if data not in known:
            if len(known) >= 64:
                known.pop(next(iter(known)))
            known[data] = shingle_hashes(data)
        return known[data]

    for batch in batches:
        left, right = as_bytes(batch.column("text_a")), as_bytes(batch.column("text_b"))
        good = [similar(shingles(x), shingles(y), PERCENT) for x, y in zip(left, right)]
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def confirmed(pairs: DataFrame, cand: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` that are links, judged on whole texts."""
    with_b = pairs.join(cand.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(cand.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return materialize(both.select("a", "b", "text_a", "text_b").mapInArrow(_confirm, "a long, b long").distinct(), "links")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    own = labels.withColumnRenamed("label", "found")
    return members.join(own, "node", "left").withColumn("label", F.coalesce("found", "node")).drop("found")


def _rest(members: DataFrame, labels: DataFrame, tested: DataFrame | None = None) -> DataFrame:
    """Members whose bucket still spans several components, without those already compared with all of it."""
    if tested is not None:
        members = members.join(tested, ["key", "node"], "left_anti")
    now = _labelled(members, labels)
    open_ = now.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("key")
    return materialize(now.join(open_, "key").select("key", "node", "n"), "open-buckets")


def _short_sets(batches):
    for batch in batches:
        made = [(shingle_hashes(x) >> U(32)).astype(np.uint32).tobytes() for x in as_bytes(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.binary())], ["node", "bytes"])


def _compare(table: pa.Table) -> pa.Table:
    """Pairs of one block that look like links: a left and a right member of different components.

    The common shingles of a left member with all right ones are counted at once, on 32 bits of their hashes.
    """
    node, label, n = (table.column(c).to_numpy() for c in ("node", "label", "n"))
    left = table.column("left").to_numpy(zero_copy_only=False)
    sets = [np.frombuffer(x, np.uint32) for x in table.column("bytes").to_pylist()]
    right = np.flatnonzero(~left)
    found: list[tuple[int, int]] = []
    if len(right) and left.any():
        known, spelled = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum([len(x) for x in sets])
        of = [spelled[e - len(x) : e] for e, x in zip(ends, sets)]
        flat = np.concatenate([of[j] for j in right])
        starts = np.concatenate(([0], np.cumsum([len(of[j]) for j in right])[:-1]))
        here = np.zeros(len(known), dtype=np.int32)
        for i in np.flatnonzero(left):
            here[of[i]] = 1
            common = np.add.reduceat(here[flat], starts) + SLACK
            here[of[i]] = 0
            like = (label[right] != label[i]) & (100 * common >= PERCENT * (n[right] + n[i] - common))
            found += [(int(node[i]), int(node[j])) for j in right[like]]
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def _open_pairs(rest: DataFrame, labels: DataFrame, cand: DataFrame) -> DataFrame:
    """Likely links among the members of open buckets, by shortened sets compared block against block.

    Members outside a bucket's largest component are the left side, all are the right side; both are cut into blocks,
    so a task holds two blocks whatever the bucket's size. Nothing is emitted for other pairs.
    """
    now = _labelled(rest, labels)
    sized = now.groupBy("key", "label").agg(F.count("*").alias("k"))
    sized = sized.groupBy("key").agg(F.sum("k").alias("k"), F.max("k").alias("most"), F.max_by("label", F.struct("k", "label")).alias("main"))
    rights, lefts = F.ceil(F.col("k") / BLOCK), F.ceil((F.col("k") - F.col("most")) / BLOCK)
    sized = sized.select("key", "main", rights.alias("rights"), lefts.alias("lefts"))
    drawn = rest.select(F.col("node").alias("doc_id")).distinct()
    short = materialize(cand.join(drawn, "doc_id", "left_semi").mapInArrow(_short_sets, "node long, bytes binary"), "short-sets")
    all_ = now.join(sized, "key").join(short, "node").withColumn("mark", F.xxhash64("node"))
    each = [F.col(c) for c in ("node", "label", "n", "bytes")]
    right = all_.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lefts") - 1)).alias("i"), F.pmod("mark", "rights").alias("j"), F.lit(False).alias("left"), *each)
    left = all_.filter("label <> main").select("key", F.pmod("mark", "lefts").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("rights") - 1)).alias("j"), F.lit(True).alias("left"), *each)
    return left.unionByName(right).groupBy("key", "i", "j").applyInArrow(_compare, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row of ``docs``; see the module for the rules."""
    base = texts(docs)
    signed = materialize(base.mapInArrow(_sign, "doc_id long, n_shingles long, set_key binary, bands array<long>"), "signed")
    usable = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    sets = materialize(
        usable.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "sets"
    )
    rows = usable.select("doc_id", "set_key").join(sets.select("set_key", "node"), "set_key")
    ids = rows.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a < z").select("doc_id", "a")
    same_id = ids.join(rows.select("doc_id", F.col("node").alias("b")), "doc_id").filter("a <> b").select("a", "b")

    held = sets.select(F.explode("bands").alias("key"), "node", "n")
    shared = held.groupBy("key").agg(F.count("*").alias("k"), F.min("node").alias("lo"), F.max("node").alias("hi"))
    shared = materialize(shared.filter("lo < hi"), "shared-bands")
    large = materialize(held.join(shared.filter("k > 2").drop("hi"), "key"), "large-buckets")
    # The text that others are copies of shares more bands with them than they do with each other, so the first
    # pivots of a bucket are the member with the most company in all its buckets, and the smallest one.
    company = large.groupBy("node").agg(F.sum("k").alias("company"))
    hubs = large.select("key", "node").join(company, "node").groupBy("key").agg(F.max_by("node", F.struct("company", "node")).alias("hub"))
    large = materialize(large.join(hubs, "key"), "large-buckets")
    first = (
        shared.filter("k = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b"))
        .unionByName(large.select(F.col("node").alias("a"), F.col("lo").alias("b")))
        .unionByName(large.select(F.col("node").alias("a"), F.col("hub").alias("b")))
    )
    pairs = materialize(_ordered(first), "pairs")
    nodes = shared.filter("k = 2").select(F.explode(F.array("lo", "hi")).alias("doc_id")).unionByName(large.select(F.col("node").alias("doc_id")))
    cand = materialize(base.join(nodes.distinct(), "doc_id", "left_semi"), "candidates")

    edges = confirmed(pairs, cand)
    labels = components(edges.unionByName(same_id))
    tested = large.select("key", F.explode(F.array("lo", "hub")).alias("node")).distinct()
    rest = _rest(large.select("key", "node", "n"), labels, tested)
    if not rest.isEmpty():
        more = materialize(_ordered(_open_pairs(rest, labels, cand)), "pairs")
        labels = components(edges.unionByName(same_id).unionByName(confirmed(more, cand)))

    named = sets.select("set_key", "node").join(labels, "node", "left").select("set_key", F.coalesce("label", "node").alias("label"))
    out = signed.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.expr("doc_id <=> component_id"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each near-duplicate group, with all columns of ``docs``; rows without ``doc_id`` stay."""
    from pyspark.sql import Window

    kept = near_duplicates(docs).filter("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_kept_id")).distinct()
    one = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last(), *(c for c, t in docs.dtypes if c not in ("doc_id", "text") and "map" not in t))
    stay = docs.join(kept, docs["doc_id"] == kept["_kept_id"], "left_semi").withColumn("_row", F.row_number().over(one))
    return stay.filter("_row = 1").drop("_row").unionByName(docs.filter("doc_id IS NULL"))
