"""Token ids in compressed binary files: a static range asymmetric numeral system over interleaved lanes.

Files below a folder
    ``model``: the shared frequency table, ``id, freq``; the frequencies sum to ``2 ** SCALE``.
    ``tokens``: what is to be coded; ``kind=0`` has blocks of plain ids, ``kind=1`` how often each task wrote an id.
    ``blocks``: a row per block: ``part, block`` (in this order the blocks are the corpus), the ``doc_ids`` and
    ``lengths`` of its documents, and ``payload``: a header, lane states at the checkpoints, and the coded words.
    ``index``: ``part, block, start, n_tokens``, the place of each block's first id in the corpus.

Payload (little-endian)
    ``HEADER`` with: magic, version, log2 of the lanes, checkpoints, steps between checkpoints, number of ids, number
    of coded words, crc32 of the ids as 32-bit numbers, crc32 of all after the header. Then for each checkpoint its
    word offset (uint32), then each checkpoint's lane states (uint64), then the coded words (uint32). Id ``i`` belongs
    to lane ``i mod lanes`` of step ``i div lanes``. Every lane has a state of its own and all lanes share the words:
    in each step, lanes that fall below ``2 ** 31`` take the next words in lane order. Decoding can start at any
    checkpoint, and blocks are independent of each other.

Defined cases
    A null text is an empty one; an empty text is its end id alone. Documents are in ascending ``doc_id`` order, those
    without one first, equal ids by their token ids; repeated rows are written each. A block holds whole documents: it is
    closed by the document that fills it, so a long text makes a long block. Other columns are not looked at. An empty
    table gives an empty corpus. A payload whose checksums do not hold raises an error.
"""

from __future__ import annotations

import struct
import sys
import zlib
from array import array
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.tables import id_range, texts

TOKENIZER = "word_bpe_49k.json"
END_ID, VOCABULARY = 1, 1 << 16
BLOCK_IDS, LANES_LOG, CHECKPOINT_IDS, SCALE = 1 << 19, 10, 1 << 18, 18
HEADER, MAGIC, VERSION = struct.Struct("<4sBBHIIIII"), b"TMrA", 1
LOW = np.uint64(1 << 31)
CACHED_WORDS, CACHED_LENGTH = 800_000, 48
# Rows that a task turns or packs at once.
SLICE = 512
# Signs that the tokenizer splits from the letters before them; not the apostrophe, which some letters may follow.
SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'<")
U64 = np.uint64


# -- coding of one block ------------------------------------------------------------------------------------------


class Model:
    """Frequencies per id, their running sums, and the id of each slot."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(U64)
        ends = np.cumsum(freq)
        self.start = (ends - freq).astype(U64)
        self.slots = np.repeat(np.arange(len(freq), dtype=np.uint16), freq.astype(np.int64))


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of ``2 ** SCALE``; an id that occurs keeps at least one."""
    total, room = int(counts.sum()), 1 << SCALE
    if not total:
        return np.zeros(len(counts), dtype=np.int64)
    freq = np.where(counts > 0, np.maximum(1, (counts.astype(float) * (room / total)).astype(np.int64)), 0)
    order = np.argsort(-freq, kind="stable")
    extra = int(freq.sum()) - room
    for k in order:
        if not extra:
            break
        change = min(extra, int(freq[k]) - 1) if extra > 0 else extra
        change = min(change, max(1, int(freq[k]) // 2)) if change > 0 else change
        freq[k] -= change
        extra -= change
    if extra:
        raise ValueError("more ids than slots")
    return freq


def encode_block(ids: np.ndarray, model: Model) -> bytes:
    n = len(ids)
    log = max(0, min(LANES_LOG, (n // 32).bit_length() - 1))
    lanes = 1 << log
    steps = -(-n // lanes)
    every = max(1, CHECKPOINT_IDS // lanes)
    padded = np.zeros(steps * lanes, dtype=np.uint16)
    padded[:n] = ids
    freq, start = model.freq[padded].reshape(steps, lanes), model.start[padded].reshape(steps, lanes)
    x = np.full(lanes, LOW, dtype=U64)
    words: list[np.ndarray] = [np.zeros(0, np.uint32)] * steps
    saved = {}
    for s in range(steps - 1, -1, -1):
        live = n - s * lanes if s == steps - 1 else lanes
        f, state = freq[s, :live], x[:live]
        full = state >= f << U64(63 - SCALE)
        words[s] = state[full].astype(np.uint32)
        state = np.where(full, state >> U64(32), state)
        whole = state // f
        x[:live] = (whole << U64(SCALE)) + (state - whole * f) + start[s, :live]
        if s % every == 0:
            saved[s] = x.copy()
    offsets = np.concatenate(([0], np.cumsum([len(w) for w in words], dtype=np.int64)))
    points = sorted(saved)
    coded = np.concatenate(words) if words else np.zeros(0, np.uint32)
    body = offsets[points].astype("<u4").tobytes() + b"".join(saved[s].astype("<u8").tobytes() for s in points) + coded.astype("<u4").tobytes()
    head = HEADER.pack(MAGIC, VERSION, log, len(points), every, n, len(coded), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body))
    return head + body


def decode_block(payload: bytes, model: Model, checkpoint: int = 0, stop: int | None = None) -> np.ndarray:
    """The ids from a checkpoint on, up to before checkpoint ``stop`` or the end."""
    magic, version, log, points, every, n, n_words, ids_crc, body_crc = HEADER.unpack_from(payload)
    body = memoryview(payload)[HEADER.size :]
    if (magic, version) != (MAGIC, VERSION) or zlib.crc32(body) != body_crc:
        raise ValueError("damaged block of token ids")
    lanes, steps = 1 << log, -(-n // (1 << log))
    if not n:
        return np.zeros(0, np.uint16)
    offset = int(np.frombuffer(body, "<u4", points)[checkpoint])
    x = np.frombuffer(body, "<u8", lanes, 4 * points + 8 * lanes * checkpoint).astype(U64)
    words = np.frombuffer(body, "<u4", n_words, 4 * points + 8 * lanes * points).astype(U64)
    first, last = checkpoint * every, steps if stop is None else min(steps, stop * every)
    out = np.empty((last - first, lanes), dtype=np.uint16)
    mask, scale = U64((1 << SCALE) - 1), U64(SCALE)
    for s in range(first, last):
        live = n - s * lanes if s == steps - 1 else lanes
        slot = x[:live] & mask
        found = model.slots[slot]
        out[s - first, :live] = found
        state = model.freq[found] * (x[:live] >> scale) + slot - model.start[found]
        low = np.flatnonzero(state < LOW)
        state[low] = (state[low] << U64(32)) | words[offset : offset + len(low)]
        offset += len(low)
        x[:live] = state
    ids = out.reshape(-1)[: min(n, last * lanes) - first * lanes]
    if checkpoint == 0 and last == steps and zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("decoded token ids differ from those written")
    return ids


# -- tokens -------------------------------------------------------------------------------------------------------


class Words(dict):
    """Token ids of texts, as bytes of 16-bit numbers; a dictionary of those of the pieces between spaces.

    The tokenizer drops white space, lower-cases, and splits letters from what follows them, so a piece by itself
    has the same ids as within its text, and so have its lower-cased letters and the signs behind them
    (of Latin letters that stay letters in lower case).
    The store of pieces is bounded and started anew when it is full.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size(with_added_tokens=True) > VOCABULARY:
            raise ValueError("the file format holds ids below 65536")
        if sys.byteorder != "little":
            raise ValueError("ids are kept as they are in the memory of little-endian machines")
        self.model = self.tokenizer.model
        # How the tokenizer writes letters for its model; only words of these letters go to the model directly.
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.letters = {n: spell(chr(n))[0][0] for n in range(0x250) if chr(n).isalpha() and chr(n).lower() == chr(n)}
        tried = ("word", "qzx", "été", "straße", "ñandú")
        self.direct = all(self.of_model(w) == self.of_tokenizer(w) for w in tried)

    def of_tokenizer(self, piece: str) -> bytes:
        return array("H", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()

    def of_model(self, word: str) -> bytes:
        """The ids of lower-case letters that need no normalising: the model's part of the tokenizer alone."""
        return array("H", [t.id for t in self.model.tokenize(word if word.isascii() else word.translate(self.letters))]).tobytes()

    def __missing__(self, piece: str) -> bytes:
        letters = piece.rstrip(SIGNS)
        if piece.isascii() and "<" not in piece and piece.lower() != piece:
            found = self[piece.lower()]
        elif len(letters) < len(piece) and letters.isalpha() and max(letters) < "\u0250" and letters.lower().isalpha():
            found = self[letters] + self[piece[len(letters) :]]
        elif self.direct and piece.isalpha() and max(piece) < "\u0250" and piece.lower() == piece and is_normalized("NFC", piece):
            found = self.of_model(piece)
        else:
            found = self.of_tokenizer(piece)
        if len(piece) <= CACHED_LENGTH:
            self[piece] = found
        return found

    def ids(self, text: str) -> bytes:
        if len(self) > CACHED_WORDS:
            self.clear()
        if text.isascii() and "<" not in text:  # no special token's string can come of it
            text = text.lower()
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=2)
def _words(path: str) -> Words:
    return Words(path)


def _slices(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _tokenize(path: str):
    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words = _words(path)
        for batch in _slices(batches):
            made = [words.ids(text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("part", "doc_id")), pa.array(made, pa.binary())], ["part", "doc_id", "ids"])

    return run


PACKED = {
    "kind": pa.int32(), "part": pa.int32(), "block": pa.int64(), "doc_ids": pa.list_(pa.int64()), "lengths": pa.list_(pa.int64()), "ids": pa.binary(),
    "id": pa.int32(), "n": pa.int64(),
}
PACKED_KIND = "kind int, part int, block long, doc_ids array<long>, lengths array<long>, ids binary, id int, n long"


def _pack(end_id: int, block_ids: int):
    """Blocks of documents in order, each followed by the end id; at last the counts of all ids."""
    end = np.array([end_id], dtype="<u2").tobytes()

    def rows(size, /, **columns):
        return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(size, k) for c, k in PACKED.items()], list(PACKED))

    def run(batches):
        counts = np.zeros(VOCABULARY, dtype=np.int64)
        part, block, names, sizes, held, size = None, 0, [], [], [], 0

        def full():
            ids = b"".join(held)
            counts[:] += np.bincount(np.frombuffer(ids, "<u2"), minlength=VOCABULARY)
            return rows(1, kind=[0], part=[part], block=[block], doc_ids=[names], lengths=[sizes], ids=[ids])

        for batch in _slices(batches):
            for own, name, ids in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "ids"))):
                if names and own != part or size >= block_ids:
                    yield full()
                    block, names, sizes, held, size = block + 1, [], [], [], 0
                if own != part:
                    part, block = own, 0
                names.append(name)
                sizes.append(len(ids) // 2 + 1)
                held += (ids, end)
                size += sizes[-1]
        if names:
            yield full()
        seen = np.flatnonzero(counts)
        if len(seen):
            yield rows(len(seen), kind=np.ones(len(seen), np.int32), id=seen, n=counts[seen])

    return run


def _encode(freq: np.ndarray):
    def run(batches):
        model = Model(freq)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                ids = np.frombuffer(row.column("ids")[0].as_buffer(), "<u2")
                columns = [*(row.column(c) for c in ("part", "block", "doc_ids", "lengths")), pa.array([encode_block(ids, model)], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["part", "block", "doc_ids", "lengths", "payload"])

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Tokenizes whole texts and writes the corpus, in ``doc_id`` order, below ``folder``."""
    spark = docs.sparkSession
    number, ranges = id_range(texts(docs), int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Texts become ids where they are read, and ids are what is moved into order.
    tokens = texts(docs).withColumn("part", number).mapInArrow(_tokenize(tokenizer), "part int, doc_id long, ids binary")
    ordered = tokens.repartitionById(ranges, "part").sortWithinPartitions("part", "doc_id", "ids")
    packed = ordered.mapInArrow(_pack(end_id, block_ids), PACKED_KIND)
    packed.write.partitionBy("kind").option("compression", "lz4_raw").option("parquet.block.size", 16 << 20).parquet(f"{folder}/tokens")
    packed = spark.read.schema(PACKED_KIND).parquet(f"{folder}/tokens")

    counted = packed.filter("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(VOCABULARY, dtype=np.int64)
    for row in counted:  # at most one row per id of the vocabulary
        counts[row.id] = row.n
    freq = frequencies(counts)
    seen = [(int(k), int(freq[k])) for k in np.flatnonzero(freq)]
    spark.createDataFrame(seen, "id int, freq long").coalesce(1).write.parquet(f"{folder}/model")

    tokens = packed.filter("kind = 0").select("part", "block", "doc_ids", "lengths", "ids")
    blocks = tokens.mapInArrow(_encode(freq), "part int, block long, doc_ids array<long>, lengths array<long>, payload binary")
    blocks.write.option("compression", "uncompressed").option("parquet.block.size", 16 << 20).parquet(f"{folder}/blocks")

    sizes = spark.read.parquet(f"{folder}/blocks").select("part", "block", F.expr("aggregate(lengths, 0L, (a, x) -> a + x)").alias("n_tokens"))
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("held"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    parts = parts.select("part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    index = sizes.join(parts, "part").withColumn("start", F.col("first") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    index.select("part", "block", "start", "n_tokens").write.parquet(f"{folder}/index")


def read_model(spark: SparkSession, folder: str) -> np.ndarray:
    freq = np.zeros(VOCABULARY, dtype=np.int64)
    for row in spark.read.schema("id int, freq long").parquet(f"{folder}/model").collect():
        freq[row.id] = row.freq
    return freq


def _documents(freq: np.ndarray):
    names = ["part", "block", "doc_id", "offset", "n_tokens", "ids_crc32", "ids"]

    def run(batches):
        model = Model(freq)
        for batch in batches:
            for k in range(batch.num_rows):
                ids = decode_block(batch.column("payload")[k].as_py(), model).astype("<u4")
                docs, sizes = batch.column("doc_ids")[k].as_py(), batch.column("lengths")[k].as_py()
                ends = np.cumsum(sizes)
                own = [ids[e - s : e].tobytes() for e, s in zip(ends.tolist(), sizes)]
                columns = [
                    pa.array([batch.column("part")[k].as_py()] * len(docs), pa.int32()), pa.array([batch.column("block")[k].as_py()] * len(docs), pa.int64()),
                    pa.array(docs, pa.int64()), pa.array(ends - np.array(sizes)), pa.array(sizes, pa.int64()),
                    pa.array([zlib.crc32(x) for x in own], pa.int64()), pa.array(own, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _digests(freq: np.ndarray):
    def run(batches):
        for made in _documents(freq)(batches):
            yield made.select(made.schema.names[:-1])

    return run


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """Decodes the corpus: ``doc_id, start, n_tokens, ids_crc32`` per document, and ``ids`` as 32-bit numbers."""
    kind = "part int, block long, doc_id long, offset long, n_tokens long, ids_crc32 long"
    run = _documents if with_ids else _digests
    schema = "part int, block long, doc_ids array<long>, lengths array<long>, payload binary"
    blocks = spark.read.schema(schema).parquet(f"{folder}/blocks")
    made = blocks.mapInArrow(run(read_model(spark, folder)), kind + (", ids binary" if with_ids else ""))
    index = spark.read.schema("part int, block long, start long, n_tokens long").parquet(f"{folder}/index")
    placed = made.join(index.select("part", "block", F.col("start").alias("first")), ["part", "block"])
    columns = ["doc_id", (F.col("first") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"]
    return placed.select(*columns, *(["ids"] if with_ids else []))
