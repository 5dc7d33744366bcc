"""Chat formatting as prefix trees: conversations with the same initial turns share them, written once, depth first.

Template
    A turn is ``<turn ROLE>TEXT</turn>`` and a newline. In role and text a backslash, ``<`` and ``>`` get a backslash
    before them, so no text can hold a mark and taking the backslashes away gives the text back. The loss mask covers
    the escaped texts of assistant turns.

Packs
    A path is the list of a conversation's turn hashes. Distinct conversations are sorted by path, which is the
    depth-first order of the forest of all turns, and cut into packs of a conversation and about ``PACK_CHARS`` code
    points that the next ones add. Within a pack a turn is a node; what a conversation shares with the one before it is not written again. A node has its
    place in the pack's sequence, a position id (its distance from the root along its path, so siblings continue at
    the same position), its parent, and the intervals of the sequence that it may attend to: its ancestors, merged
    where they touch. Within itself it attends causally. Tokens are code points.

Defined cases
    A null role or text is an empty one. Turns are ordered by ``turn``, then role and text; rows with the same
    ``turn`` are turns one after the other, repeated rows too. A row without ``conv_id`` is a conversation of
    one turn without id, so any number of them can be there. Very long turns are written whole. Other columns are not looked at. An empty table gives an empty result.

Scale
    Equal conversations are merged by a map-side aggregate before anything is sorted; a first turn in a third of all
    conversations is spread over many packs (and written once in each), because it is paths that are dealt out by
    range. A pack is closed when later conversations have added ``PACK_CHARS`` to its first, so that turns shared by all
    of them are written once for that much, however long they are; a pack of that size takes no conversation that
    shares no turn with it. So a task holds two conversations and ``PACK_CHARS`` at a time.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACK_CHARS = 1 << 16
SPECIAL = re.compile(r"([\\<>])")
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
TURN = re.compile(r"<turn ((?:[^\\<>]|\\.)*)>((?:[^\\<>]|\\.)*)</turn>\n", re.DOTALL)


def escape(text: str) -> str:
    return SPECIAL.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and where the text stands in it."""
    head, body = f"<turn {escape(role)}>", escape(text)
    return f"{head}{body}</turn>\n", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    turns, at = [], 0
    for m in TURN.finditer(formatted):
        if m.start() != at:
            break
        turns.append((unescape(m.group(1)), unescape(m.group(2))))
        at = m.end()
    if at != len(formatted):
        raise ValueError("not a formatted conversation")
    return turns


NODE = "start:long,length:long,position:long,parent:int,loss_from:long,loss_to:long,attends:array<struct<from:long,to:long>>"
PACK = f"pack_id string, sequence string, nodes array<struct<{NODE}>>, ends array<struct<path_key:string,node:int>>"
_SPAN = pa.struct([("from", pa.int64()), ("to", pa.int64())])
_NODE = pa.struct([*((k, pa.int64()) for k in ("start", "length", "position")), ("parent", pa.int32()), ("loss_from", pa.int64()), ("loss_to", pa.int64()), ("attends", pa.list_(_SPAN))])
_PACK = pa.schema([("pack_id", pa.string()), ("sequence", pa.string()), ("nodes", pa.list_(_NODE)), ("ends", pa.list_(pa.struct([("path_key", pa.string()), ("node", pa.int32())])))])


class Pack:
    """The part of the forest that is being written."""

    def __init__(self):
        self.text: list[str] = []
        self.size = 0
        self.nodes: list[dict] = []
        self.ends: list[dict] = []
        self.branch: list[tuple[str, int]] = []

    def add(self, path_key: str, keys: list[str], turns: list) -> None:
        shared = 0
        while shared < min(len(keys), len(self.branch)) and self.branch[shared][0] == keys[shared]:
            shared += 1
        del self.branch[shared:]
        for key, turn in zip(keys[shared:], turns[shared:]):
            written, text_from, text_to = format_turn(turn["role"], turn["text"])
            parent = self.branch[-1][1] if self.branch else -1
            attends, position = [], 0
            if parent >= 0:
                above = self.nodes[parent]
                attends = [dict(s) for s in above["attends"]]
                own = {"from": above["start"], "to": above["start"] + above["length"]}
                if attends and attends[-1]["to"] == own["from"]:
                    attends[-1]["to"] = own["to"]
                else:
                    attends.append(own)
                position = above["position"] + above["length"]
            loss = (self.size + text_from, self.size + text_to) if turn["role"] == "assistant" else (0, 0)
            self.nodes.append({"start": self.size, "length": len(written), "position": position, "parent": parent, "loss_from": loss[0], "loss_to": loss[1], "attends": attends})
            self.text.append(written)
            self.size += len(written)
            self.branch.append((key, len(self.nodes) - 1))
        self.ends.append({"path_key": path_key, "node": self.branch[-1][1]})

    def record(self, name: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"pack_id": name, "sequence": "".join(self.text), "nodes": self.nodes, "ends": self.ends}], schema=_PACK)


def _pack(pack_chars: int):
    def run(batches):
        pack, first = Pack(), 0
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in ("path_key", "keys", "turns")}
                if pack.size >= pack_chars and pack.branch[0][0] != row["keys"][0]:
                    yield pack.record(pack.ends[0]["path_key"])
                    pack = Pack()
                pack.add(row["path_key"], row["keys"], row["turns"])
                if len(pack.ends) == 1:
                    first = pack.size
                if pack.size - first >= pack_chars:
                    yield pack.record(pack.ends[0]["path_key"])
                    pack = Pack()
        if pack.ends:
            yield pack.record(pack.ends[0]["path_key"])

    return run


def conversations(rows: DataFrame) -> DataFrame:
    """``conv_id, turns, keys, path, path_key`` per conversation."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = rows.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    convs = convs.unionByName(rows.filter("conv_id IS NULL").select("conv_id", F.array(turn).alias("turns")))
    convs = convs.select("conv_id", F.expr("transform(turns, t -> struct(t.role AS role, t.text AS text))").alias("turns"))
    convs = convs.withColumn("keys", F.expr("transform(turns, t -> md5(concat(char_length(t.role), ':', t.role, t.text)))"))
    return convs.withColumn("path", F.array_join("keys", "")).withColumn("path_key", F.md5(F.col("path").cast("binary")))


def write_trees(rows: DataFrame, folder: str, pack_chars: int = PACK_CHARS) -> None:
    """Writes ``packs``, and ``members`` with the path of every conversation, below ``folder``."""
    convs = conversations(rows)
    convs.write.parquet(f"{folder}/formatted-input")
    convs = rows.sparkSession.read.parquet(f"{folder}/formatted-input")
    convs.select("conv_id", "path_key").write.parquet(f"{folder}/members")
    distinct = convs.groupBy("path_key").agg(F.min("path").alias("path"), F.first("keys").alias("keys"), F.first("turns").alias("turns"))
    ordered = distinct.repartitionByRange("path").sortWithinPartitions("path").select("path_key", "keys", "turns")
    ordered.mapInArrow(_pack(pack_chars), PACK).write.parquet(f"{folder}/packs")


def read_paths(sequence: str, nodes: list[dict], ends: list[dict]):
    """For each conversation that ends in a pack: its path key, formatted text, and the spans of it under the loss mask."""
    for end in ends:
        node = nodes[end["node"]]
        branch, at = [], end["node"]
        while at >= 0:
            branch.append(nodes[at])
            at = nodes[at]["parent"]
        spans = [*node["attends"], {"from": node["start"], "to": node["start"] + node["length"]}]
        text = "".join(sequence[s["from"] : s["to"]] for s in spans)
        masked = [sequence[b["loss_from"] : b["loss_to"]] for b in reversed(branch)]
        if len(text) != node["position"] + node["length"]:
            raise ValueError("attention intervals and positions differ")
        yield end["path_key"], text, masked


DIGEST = "path_key string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(batches):
    names = [x.split()[0] for x in DIGEST.split(", ")]
    for batch in batches:
        for k in range(batch.num_rows):
            out = []
            for key, text, masked in read_paths(*(batch.column(c)[k].as_py() for c in ("sequence", "nodes", "ends"))):
                turns = parse(text)
                whole = "".join(f"{role}\n{said}\n" for role, said in turns)
                loss = "".join(map(unescape, masked))
                out.append((key, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Per conversation what its text, read back from the packs by attention intervals, holds."""
    made = spark.read.parquet(f"{folder}/packs").mapInArrow(_digest, DIGEST)
    return spark.read.parquet(f"{folder}/members").join(made, "path_key").drop("path_key")
