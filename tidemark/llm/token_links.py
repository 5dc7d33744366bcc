"""Alignment of two tokenizers' tokens, with corpus-wide counts of linked id pairs from inverted bitmaps.

Method
    Each text is encoded by tokenizer A (byte-level BPE) and tokenizer B (pieces with byte fallback). Both spell the
    same bytes, so their tokens are two cuts of one byte string. An A and a B token are linked if they overlap; every
    stretch between neighbouring ends of either cut is one link, and ends that both share close a group.
    Per id pair there is an inverted bitmap of the documents that hold the link, compressed (a list of places, or bits
    where that is shorter), and multiplicity planes: plane ``p`` has the documents for which bit ``p`` of the
    number of further links is set. Documents are numbered within blocks; batches of one block are OR-merged when the
    block is closed, and the bitmaps of different blocks never overlap, so a pair's documents are the sum of its
    bitmaps' popcounts, and its links that plus ``2 ** p`` times each plane's.
    To score documents a pair's postings carry its count back: a block adds it to each document in the bitmap,
    as often as the planes say. No link is ever a row.

Files below a folder
    ``kind=0``: a row per document, ``block, place, doc_id, n_a, n_b, n_groups, n_links, groups_sha256``.
    ``kind=1``: a row per block and pair, ``block, pair, n_docs, n_links, docs, planes``; ``pair = a << 20 | b``.

Skew
    A block is closed by the document that brings it to ``BLOCK_LINKS`` links, or at ``BLOCK_DOCS`` documents; a pair in
    every document is one row per block. Counts are added up by Spark's partial aggregates. A document's own links
    are in memory at once, whatever its length.

Defined cases
    Null and empty texts, and texts that a tokenizer doesn't spell byte by byte (with U+2581, invalid UTF-8), have no
    tokens: zeros and an empty ``groups_sha256``. Special tokens' strings are ordinary text. Rows are scored each: rows
    without ``doc_id`` and repeated rows too. Very long texts are encoded whole. Other columns are not looked at. An
    empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.tables import as_bytes

BYTE_TOKENIZER, PIECE_TOKENIZER = "byte_bpe_50k.json", "piece_bpe_32k.model"
BLOCK_LINKS, BLOCK_DOCS, BATCH_BYTES = 4_000_000, 1 << 16, 1 << 20
B_BITS, PLACE_BITS = 20, 16
NO_BLOCK = -1


# -- tokenizers ---------------------------------------------------------------------------------------------------


def byte_level_letters() -> dict[str, int]:
    """The byte each letter of a byte-level vocabulary stands for: printable ones themselves, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = sorted(set(range(256)) - set(plain))
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pair:
    """Two tokenizers, the bytes of their tokens, and how their ids are written."""

    def __init__(self, byte_file: str, pattern: str, piece_file: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        tokenizer, letters = Tokenizer.from_file(byte_file), byte_level_letters()
        special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
        spelled = {bytes(letters[c] for c in entry): k for entry, k in tokenizer.get_vocab().items() if entry not in special}
        # The vocabulary's ids are its merge ranks, which this library reads; tests hold both libraries' ids together.
        self.byte_encoder = tiktoken.Encoding("pair", pat_str=pattern, mergeable_ranks=spelled, special_tokens={})
        self.piece_encoder = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        of_b = [self._piece(k) for k in range(self.piece_encoder.get_piece_size())]
        of_a = [b""] * (max(spelled.values()) + 1)
        for entry, k in spelled.items():
            of_a[k] = entry
        self.a, self.b = of_a, of_b
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in table], dtype=np.int64) for table in (of_a, of_b))
        # Each id followed by a comma, a bar or a semicolon.
        self.shown = [f"{k}{sign}".encode() for k in range(max(len(of_a), len(of_b))) for sign in ",|;"]
        if len(of_b) > 1 << B_BITS or len(of_a) > 1 << (63 - B_BITS - PLACE_BITS):
            raise ValueError("vocabularies are too large for the key of a pair")

    def _piece(self, k: int) -> bytes:
        piece = self.piece_encoder.id_to_piece(k)
        if self.piece_encoder.is_byte(k):
            return bytes([int(piece[1:-1], 16)])
        return piece.replace("▁", " ").encode()

    def encode(self, data: list[bytes]) -> list[tuple[list[int], list[int]]]:
        """The ids of texts by A and by B; of both none for a text whose bytes they don't spell."""
        texts = [x.decode("utf-8", "replace") for x in data]
        of_b = self.piece_encoder.encode(texts, num_threads=1)
        out = []
        for raw, text, b in zip(data, texts, of_b):
            a = self.byte_encoder.encode_ordinary(" " + text) if text else []
            whole = b" " + raw
            same = text and b"".join(map(self.a.__getitem__, a)) == whole and b"".join(map(self.b.__getitem__, b)) == whole
            out.append((a, b) if same else ([], []))
        return out


@lru_cache(maxsize=2)
def _pair(byte_file: str, pattern: str, piece_file: str) -> Pair:
    return Pair(byte_file, pattern, piece_file)


# -- alignment of a batch of texts ----------------------------------------------------------------------------------


def align(pair: Pair, encoded: list[tuple[list[int], list[int]]]):
    """Per text ``n_a, n_b, n_groups, n_links, groups`` (as written), and of all links the text's number and both ids."""
    n_a, n_b = (np.array([len(x[k]) for x in encoded], dtype=np.int64) for k in (0, 1))
    a, b = (np.array([i for x in encoded for i in x[k]], dtype=np.int64) for k in (0, 1))
    ends_a, ends_b = np.cumsum(pair.a_sizes[a]), np.cumsum(pair.b_sizes[b])
    total = int(ends_a[-1]) if len(a) else 0
    is_a, is_b = np.zeros(total + 1, dtype=bool), np.zeros(total + 1, dtype=bool)
    is_a[ends_a] = True
    is_b[ends_b] = True
    both = is_a & is_b
    cuts, shared = np.flatnonzero(is_a | is_b), np.flatnonzero(both)
    upto_a, upto_b, upto_both = (np.cumsum(x, dtype=np.int64) for x in (is_a, is_b, both))
    link_a, link_b = a[upto_a[cuts] - is_a[cuts]], b[upto_b[cuts] - is_b[cuts]]

    # A text ends where its last A token does; both cuts end there.
    last = np.cumsum(n_a) - 1
    text_ends = np.where(np.cumsum(n_a) > 0, ends_a[np.maximum(last, 0)], 0) if len(a) else np.zeros(len(encoded), np.int64)
    n_links = np.diff(np.searchsorted(cuts, text_ends, side="right"), prepend=0)
    n_groups = np.diff(np.searchsorted(shared, text_ends, side="right"), prepend=0)
    of = np.repeat(np.arange(len(encoded)), n_links)

    # In the written form a group's A ids come before its B ids.
    group_a, group_b = (upto_both[e] - both[e] for e in (ends_a, ends_b))
    b_before = np.concatenate(([0], upto_b[shared]))
    order = np.empty(len(a) + len(b), dtype=np.int64)
    order[np.arange(len(a)) + b_before[group_a]] = 3 * a + both[ends_a]
    order[np.arange(len(b)) + (upto_a[shared][group_b] if len(b) else 0)] = 3 * b + 2 * both[ends_b]
    groups, at = [], 0
    for size in (n_a + n_b).tolist():
        groups.append(b"".join(map(pair.shown.__getitem__, order[at : at + size].tolist()))[:-1])
        at += size
    return n_a, n_b, n_groups, n_links, groups, of, link_a, link_b


# -- inverted bitmaps -----------------------------------------------------------------------------------------------


def bitmaps(container: np.ndarray, place: np.ndarray, n: int, room: int) -> pa.Array:
    """``n`` compressed bitmaps of sorted places below ``room``; ``container`` says whose, in order.

    The first byte is 0 before a list of 16-bit places, 1 before bits; the shorter form is taken.
    """
    card = np.bincount(container, minlength=n)
    dense = 2 * card > -(-room // 8)
    sizes = 1 + np.where(dense, -(-room // 8), 2 * card)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    firsts = np.concatenate(([0], np.cumsum(card)))
    out = np.zeros(int(starts[-1]), dtype=np.uint8)
    out[starts[:-1]] = dense
    listed = ~dense[container]
    at = (starts[container] + 1 + 2 * (np.arange(len(place)) - firsts[container]))[listed]
    out[at], out[at + 1] = place[listed] & 255, place[listed] >> 8
    for k in np.flatnonzero(dense):
        bits = np.zeros(room, dtype=np.uint8)
        bits[place[firsts[k] : firsts[k + 1]]] = 1
        packed = np.packbits(bits, bitorder="little")
        out[starts[k] + 1 : starts[k] + 1 + len(packed)] = packed
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(out)])


def unpack(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bitmaps' numbers and places, all of them."""
    if not len(column):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    dense, card = data[offsets[:-1]] == 1, (np.diff(offsets) - 1) // 2
    card = np.where(dense, 0, card)
    container = np.repeat(np.arange(len(column)), card)
    at = offsets[container] + 1 + 2 * (np.arange(len(container)) - np.repeat(np.cumsum(card) - card, card))
    containers, places = [container], [data[at].astype(np.int64) | (data[at + 1].astype(np.int64) << 8)]
    for k in np.flatnonzero(dense):
        found = np.flatnonzero(np.unpackbits(data[offsets[k] + 1 : offsets[k + 1]], bitorder="little"))
        containers.append(np.full(len(found), k))
        places.append(found)
    return np.concatenate(containers), np.concatenate(places)


def postings(keys: np.ndarray, room: int):
    """Of a block's links, ``pair << PLACE_BITS | place`` each: pairs, documents, links, bitmaps and planes."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    held, times = keys[first], np.diff(np.append(first, len(keys)))
    pair, place = held >> PLACE_BITS, held & ((1 << PLACE_BITS) - 1)
    start = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
    n_docs = np.diff(np.append(start, len(pair)))
    row = np.repeat(np.arange(len(start)), n_docs)
    docs = bitmaps(row, place, len(start), room)

    further = times - 1
    most = np.maximum.reduceat(further, start)
    n_planes = np.zeros(len(start), dtype=np.int64)
    while (most >> n_planes).any():
        n_planes += (most >> n_planes) > 0
    offsets = np.concatenate(([0], np.cumsum(n_planes)))
    containers, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for p in range(int(n_planes.max())):
        has = np.flatnonzero((further >> p) & 1)
        containers.append(offsets[row[has]] + p)
        places.append(place[has])
    container, where = np.concatenate(containers), np.concatenate(places)
    order = np.argsort(container, kind="stable")
    planes = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), bitmaps(container[order], where[order], int(offsets[-1]), room))
    return pair[start], n_docs, np.add.reduceat(times, start), docs, planes


ROWS = {
    "kind": pa.int32(), "block": pa.int64(), "place": pa.int32(), "doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(),
    "n_links": pa.int64(), "groups_sha256": pa.string(), "pair": pa.int64(), "n_docs": pa.int64(), "docs": pa.binary(), "planes": pa.list_(pa.binary()),
}
ROW_KIND = (
    "kind int, block long, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "pair long, n_docs long, docs binary, planes array<binary>"
)
DOCUMENT_KIND = "block long, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
POSTING_KIND = "block long, pair long, n_docs long, n_links long, docs binary, planes array<binary>"


def _rows(n: int, **columns) -> pa.RecordBatch:
    made = [columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in ROWS.items()]
    return pa.RecordBatch.from_arrays(made, list(ROWS))


def _index(files: tuple[str, str, str]):
    def run(batches):
        from pyspark import TaskContext

        pair, part = _pair(*files), TaskContext.get().partitionId()
        closed, links, room, held = 0, [], 0, 0

        def close():
            pairs, n_docs, n_links, docs, planes = postings(np.concatenate(links), room)
            block = part << 32 | closed
            for at in range(0, len(pairs), 1 << 15):
                s = slice(at, min(len(pairs), at + (1 << 15)))
                n = s.stop - s.start
                yield _rows(n, kind=np.ones(n, np.int32), block=np.full(n, block), pair=pairs[s], n_docs=n_docs[s], n_links=n_links[s],
                            docs=docs[s], planes=planes[s])

        for batch in batches:
            names, data = batch.column("doc_id").to_pylist(), as_bytes(batch.column("text"))
            ends = np.cumsum([len(x) for x in data])
            at = 0
            while at < len(data):
                reach = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_BYTES)) + 1
                stop = max(at + 1, min(len(data), reach, at + BLOCK_DOCS - room))
                n_a, n_b, n_groups, n_links, groups, of, a, b = align(pair, pair.encode(data[at:stop]))
                n = stop - at
                digests = [hashlib.sha256(g).hexdigest() if g else "" for g in groups]
                yield _rows(n, kind=np.zeros(n, np.int32), block=np.full(n, part << 32 | closed), place=np.arange(room, room + n, dtype=np.int32),
                            doc_id=names[at:stop], n_a=n_a, n_b=n_b, n_groups=n_groups, n_links=n_links, groups_sha256=digests)
                links.append(((a << B_BITS | b) << PLACE_BITS) | (of + room))
                room, held, at = room + n, held + len(a), stop
                if held >= BLOCK_LINKS or room >= BLOCK_DOCS:
                    if held:
                        yield from close()
                    closed, links, room, held = closed + 1, [], 0, 0
        if held:
            yield from close()

    return run


# -- jobs -----------------------------------------------------------------------------------------------------------


def write_index(docs: DataFrame, folder: str, byte_file: str, pattern: str, piece_file: str) -> None:
    """Encodes and aligns whole texts and writes documents and postings below ``folder``."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    base.mapInArrow(_index((byte_file, pattern, piece_file)), ROW_KIND).write.partitionBy("kind").parquet(folder)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(DOCUMENT_KIND + ", kind int").parquet(folder).filter("kind = 0").drop("kind")


def read_postings(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(POSTING_KIND + ", kind int").parquet(folder).filter("kind = 1").drop("kind")


def pair_counts(found: DataFrame) -> DataFrame:
    """``pair, a, b, n_docs, n_links, best`` from postings; best: no pair with this B id has more links."""
    counts = found.groupBy("pair").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links"))
    counts = counts.withColumn("a", F.expr(f"shiftright(pair, {B_BITS})")).withColumn("b", F.expr(f"pair & {(1 << B_BITS) - 1}"))
    most = counts.groupBy("b").agg(F.max("n_links").alias("most"))
    return counts.join(most, "b").select("pair", "a", "b", "n_docs", "n_links", F.expr("n_links = most").alias("best"))


def _score(table: pa.Table) -> pa.Table:
    """Carries the counts of a block's pairs back to its documents."""
    table = table.combine_chunks()
    if not table.num_rows:
        return pa.table({"block": pa.array([], pa.int64()), "place": pa.array([], pa.int32()), "n_best": pa.array([], pa.int64()), "count_sum": pa.array([], pa.int64())})
    count, best = table.column("count").to_numpy(), table.column("best").to_numpy(zero_copy_only=False).astype(np.int64)
    sums, bests = np.zeros(BLOCK_DOCS, np.int64), np.zeros(BLOCK_DOCS, np.int64)

    def add(row: np.ndarray, place: np.ndarray, times) -> None:
        np.add.at(sums, place, count[row] * times)
        np.add.at(bests, place, best[row] * times)

    docs, planes = table.column("docs").chunk(0), table.column("planes").chunk(0)
    row, place = unpack(docs)
    seen = np.zeros(BLOCK_DOCS, dtype=bool)
    seen[place] = True
    add(row, place, 1)
    ends = planes.offsets.to_numpy().astype(np.int64)
    n_planes = np.diff(ends)
    owner = np.repeat(np.arange(len(planes)), n_planes)
    level = np.arange(len(owner)) - np.repeat(np.cumsum(n_planes) - n_planes, n_planes)
    container, place = unpack(planes.flatten())
    add(owner[container], place, np.left_shift(1, level[container]))
    at = np.flatnonzero(seen)
    block = np.full(len(at), table.column("block")[0].as_py())
    return pa.table({"block": block, "place": pa.array(at, pa.int32()), "n_best": bests[at], "count_sum": sums[at]})


def scored(documents: DataFrame, found: DataFrame, counts: DataFrame) -> DataFrame:
    """Documents with ``n_best`` and ``count_sum``, which the postings return to them."""
    carried = found.select("block", "pair", "docs", "planes").join(counts.select("pair", F.col("n_links").alias("count"), "best"), "pair")
    returned = carried.select("block", "docs", "planes", "count", "best").groupBy("block").applyInArrow(_score, "block long, place int, n_best long, count_sum long")
    out = documents.join(returned, ["block", "place"], "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256"
    )


def token_links(docs: DataFrame, folder: str, byte_file: str, pattern: str, piece_file: str) -> DataFrame:
    """Aligns ``docs``, writes the index below ``folder`` and reads each document's row back from it."""
    spark = docs.sparkSession
    write_index(docs, folder, byte_file, pattern, piece_file)
    found = read_postings(spark, folder)
    return scored(read_documents(spark, folder), found, pair_counts(found))
