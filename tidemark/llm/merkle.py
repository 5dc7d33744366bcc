"""Merkle manifest of a dataset: a tree of SHA-256 digests whose parents keep the hash state before each child.

Method
    A row's leaf is the digest of its named fields. The leaves of a group (here: a language) are put in order; every
    ``WIDTH`` consecutive nodes become the digest of their digests, written as hex text, until one is left, the
    group's subroot. The subroots become the leaves of a last tree in the same way, and its top is the root.
    The hex text of a digest is 64 bytes, one block of SHA-256, so the hash state between two children is eight
    numbers. A parent keeps a copy of it for each child slot. To see what root follows if a leaf is replaced, the
    state before its slot is resumed and takes the replacement and the siblings to its right; those to its left are
    never read. ``compress`` does this for all rows of a chunk at once.

Jobs
    Nodes are dealt into chunks of ``CHUNK = WIDTH ** LEVELS`` neighbours, each built in one task; the chunks' tops are
    the nodes of the next round, so there are ``log(rows) / log(CHUNK)`` rounds. A node's place is the number of rows
    before its range partition plus its row number there; no group passes through one task. Folding goes down: a
    chunk gets the steps from its top to the root, a few kilobytes, and folds its own leaves along them.

Files below a folder
    ``rows-K/leaves``: rows of round 0 with their places; ``rows-K/round=R`` and ``top-K/round=R``: a row per chunk,
    ``tree, chunk, n, levels, digests, states, top``; digests and states are 32 bytes a node, level by level.

Defined cases
    A null field is ``-``, an empty text ``0:``. Rows without a group come first, as a group of their own; an empty name
    is another one. Rows without ``doc_id`` come first in their group; equal ids are ordered by leaf; repeated rows are
    leaves each. Very long texts are hashed whole and go no further than their digest. A lone leaf is its
    group's subroot and a lone subroot the root; a proof without siblings is the digest of nothing. Other columns are not
    looked at. An empty table has no root and gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WIDTH, LEVELS = 8, 4
CHUNK = WIDTH**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
U = np.uint32


# -- SHA-256 on arrays --------------------------------------------------------------------------------------------


def _fraction(p: int, root: int) -> int:
    """The first 32 bits behind the point of a number's square or cube root."""
    low, high = 0, p << 40
    target = p << (32 * root)
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if middle**root <= target else (low, middle)
    return low & 0xFFFFFFFF


_PRIMES = [p for p in range(2, 312) if all(p % d for d in range(2, p))]
FIRST = np.array([_fraction(p, 2) for p in _PRIMES[:8]], dtype=U)
ROUND = np.array([_fraction(p, 3) for p in _PRIMES[:64]], dtype=U)
HEX = np.frombuffer(b"0123456789abcdef", dtype=np.uint8)


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> U(by)) | (x << U(32 - by))


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Hash states ``(n, 8)`` after they took a block ``(n, 16)`` each."""
    words = list(np.ascontiguousarray(block.T))
    a, b, c, d, e, f, g, h = now = list(np.ascontiguousarray(state.T))
    for t in range(64):
        if t >= 16:
            x, y = words[t - 15], words[t - 2]
            small = _turn(x, 7) ^ _turn(x, 18) ^ (x >> U(3))
            words.append(words[t - 16] + small + words[t - 7] + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> U(10))))
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + ROUND[t] + words[t]
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return np.stack([x + y for x, y in zip(now, (a, b, c, d, e, f, g, h))], axis=1)


def as_text(digests: np.ndarray) -> np.ndarray:
    """The hex text of digests ``(n, 8)`` as bytes ``(n, 64)``."""
    raw = np.ascontiguousarray(digests, dtype=">u4").view(np.uint8).reshape(len(digests), 32)
    return HEX[np.stack([raw >> 4, raw & 15], axis=2).reshape(len(digests), 64)]


def _blocks(digests: np.ndarray) -> np.ndarray:
    return as_text(digests).view(">u4").astype(U)


def _closed(state: np.ndarray, children: np.ndarray) -> np.ndarray:
    """The digests of messages of so many children, all taken."""
    last = np.zeros((len(state), 16), dtype=U)
    last[:, 0], last[:, 15] = U(1 << 31), (children * 512).astype(U)
    return compress(state, last)


def parents(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The digests of runs of ``WIDTH`` nodes, and the state before each node in its parent."""
    n = len(nodes)
    runs = -(-n // WIDTH)
    blocks, before = _blocks(nodes), np.empty((n, 8), dtype=U)
    state = np.tile(FIRST, (runs, 1))
    for slot in range(WIDTH):
        held = (n - slot + WIDTH - 1) // WIDTH  # runs that have this slot; only the last run can be short
        if held > 0:
            before[slot::WIDTH] = state[:held]
            state[:held] = compress(state[:held], blocks[slot::WIDTH])
    return _closed(state, np.minimum(WIDTH, n - WIDTH * np.arange(runs))), before


def resume(before: np.ndarray, replacement: np.ndarray, slot: np.ndarray, children: np.ndarray, right) -> np.ndarray:
    """Parents' digests with another child: ``right(k, rows)`` gives the digests of their ``k``-th right siblings."""
    state = compress(before, _blocks(replacement))
    for k in range(1, WIDTH):
        rows = np.flatnonzero(slot + k < children)
        if len(rows):
            state[rows] = compress(state[rows], _blocks(right(k, rows)))
    return _closed(state, children)


# -- one chunk ----------------------------------------------------------------------------------------------------


def _numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=">u4").astype(U).reshape(-1, 8)


class Chunk:
    """The levels above up to ``CHUNK`` neighbouring nodes; the states of a level belong to its nodes' parents."""

    def __init__(self, digests: list[np.ndarray], states: list[np.ndarray]):
        self.digests, self.states = digests, states

    @classmethod
    def build(cls, nodes: np.ndarray, alone: bool) -> Chunk:
        """A tree's only chunk ends with one node; one of many always has ``LEVELS`` levels."""
        digests, states = [nodes], []
        while len(digests[-1]) > 1 if alone else len(states) < LEVELS:
            above, before = parents(digests[-1])
            digests.append(above)
            states.append(before)
        return cls(digests, states)

    @classmethod
    def read(cls, n: int, levels: int, digests: bytes, states: bytes) -> Chunk:
        all_digests, all_states, sizes = _numbers(digests), _numbers(states), [n]
        for _ in range(levels):
            sizes.append(-(-sizes[-1] // WIDTH))
        ends = np.cumsum(sizes)
        parts = [slice(e - s, e) for e, s in zip(ends.tolist(), sizes)]
        return cls([all_digests[p] for p in parts], [all_states[p] for p in parts[:-1]])

    def fold(self, replaced: np.ndarray) -> np.ndarray:
        """The chunk's top for each node, if that node alone is replaced."""
        at, now = np.arange(len(replaced)), replaced
        for level, before in zip(self.digests, self.states):
            slot = at % WIDTH
            children = np.minimum(WIDTH, len(level) - (at - slot))
            now = resume(before[at], now, slot, children, lambda k, rows, level=level, at=at: level[at[rows] + k])
            at = at // WIDTH
        return now

    def steps(self) -> list[list[tuple[bytes, bytes, bytes]]]:
        """For each node, level by level: the state before it, the digests left of it, those right of it."""
        out: list[list[tuple[bytes, bytes, bytes]]] = [[] for _ in range(len(self.digests[0]))]
        for depth, (level, before) in enumerate(zip(self.digests, self.states)):
            raw, state = level.astype(">u4").tobytes(), before.astype(">u4").tobytes()
            span = WIDTH**depth
            for k in range(len(level)):
                first, end = k - k % WIDTH, min(len(level), k - k % WIDTH + WIDTH)
                step = (state[32 * k : 32 * k + 32], raw[32 * first : 32 * k], raw[32 * k + 32 : 32 * end])
                for node in range(k * span, min(len(out), (k + 1) * span)):
                    out[node].append(step)
        return out

    def siblings(self) -> list[bytes]:
        """For each node the hex text of all its siblings, level by level."""
        texts = [as_text(level).tobytes() for level in self.digests[:-1]]
        out = []
        for node in range(len(self.digests[0])):
            parts, k = [], node
            for text in texts:
                first = k - k % WIDTH
                parts += (text[64 * first : 64 * k], text[64 * k + 64 : 64 * (first + WIDTH)])
                k //= WIDTH
            out.append(b"".join(parts))
        return out


def fold_steps(now: np.ndarray, steps: list[dict]) -> np.ndarray:
    """The roots above digests that share their way up."""
    for step in steps:
        left, right = len(step["left"]) // 32, _numbers(step["right"])
        n = len(now)
        slot, children = np.full(n, left), np.full(n, left + 1 + len(right))
        before = np.broadcast_to(_numbers(step["state"]), (n, 8))
        now = resume(before, now, slot, children, lambda k, rows, right=right: np.broadcast_to(right[k - 1], (len(rows), 8)))
    return now


# -- jobs ---------------------------------------------------------------------------------------------------------

STEPS = "array<struct<state: binary, left: binary, right: binary>>"
BUILT = "tree string, chunk long, n long, levels int, digests binary, states binary, top binary"


def _build(batches):
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            nodes = _numbers(b"".join(row["nodes"]))
            made = Chunk.build(nodes, row["alone"])
            digests = np.concatenate(made.digests).astype(">u4").tobytes()
            states = np.concatenate([*made.states, np.zeros((0, 8), U)]).astype(">u4").tobytes()
            top = made.digests[-1].astype(">u4").tobytes()
            rows.append([row["tree"], row["chunk"], len(nodes), len(made.states), digests, states, top])
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        names = ["tree", "chunk", "n", "levels", "digests", "states", "top"]
        for at in range(0, len(rows), 16):
            part = list(zip(*rows[at : at + 16]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(part, kinds)], names)


def placed(nodes: DataFrame, order: list[str], folder: str) -> DataFrame:
    """``nodes`` with ``pos``, their place within their ``tree`` in the given order, written below ``folder``."""
    spark = nodes.sparkSession
    ordered = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    # Within a partition these ids count its rows in order; they are fixed by writing them.
    ordered.withColumn("_part", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id()).write.parquet(f"{folder}/ordered")
    rows = spark.read.parquet(f"{folder}/ordered")
    runs = rows.groupBy("tree", "_part").agg(F.min("_seq").alias("_lo"), F.count("*").alias("_n"))
    before = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    runs = runs.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return rows.join(runs, ["tree", "_part"]).withColumn("pos", F.expr("_first + _seq - _lo")).drop("_part", "_seq", "_first", "_lo")


def build_trees(nodes: DataFrame, folder: str) -> tuple[DataFrame, list[DataFrame]]:
    """Trees over ``nodes(tree, pos, digest)``: their tops ``(tree, top)``, and the chunks of each round."""
    spark = nodes.sparkSession
    rounds, tops = [], None
    while True:
        sizes = nodes.groupBy("tree").agg((F.count("*") <= CHUNK).alias("alone"))
        packed = nodes.groupBy("tree", F.expr(f"pos div {CHUNK}").alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("pos", "digest"))).alias("nodes"))
        packed = packed.join(sizes, "tree").select("tree", "chunk", "alone", F.col("nodes.digest").alias("nodes"))
        path = f"{folder}/round={len(rounds)}"
        packed.mapInArrow(_build, BUILT).write.parquet(path)
        chunks = spark.read.schema(BUILT).parquet(path)
        rounds.append(chunks)
        many = chunks.filter("chunk > 0").select("tree").distinct()
        done = chunks.join(many, "tree", "left_anti").select("tree", "top")
        tops = done if tops is None else tops.unionByName(done)
        if many.isEmpty():
            return tops, rounds
        nodes = chunks.join(many, "tree", "left_semi").select("tree", F.col("chunk").alias("pos"), F.col("top").alias("digest"))


def _ways(batches):
    """The way to the root of each node of a chunk: the steps inside the chunk, then those of the chunk."""
    for batch in batches:
        for row in batch.to_pylist():
            made = Chunk.read(row["n"], row["levels"], row["digests"], row["states"]).steps()
            first = row["chunk"] * CHUNK
            for at in range(0, len(made), 512):
                ways = [[dict(zip(("state", "left", "right"), s)) for s in own] + row["way"] for own in made[at : at + 512]]
                kind = pa.list_(pa.struct([("state", pa.binary()), ("left", pa.binary()), ("right", pa.binary())]))
                place = pa.array(range(first + at, first + at + len(ways)), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([row["tree"]] * len(ways)), place, pa.array(ways, kind)], ["tree", "pos", "way"])


def ways_to_chunks(tops: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """``tree, chunk, way`` for the chunks of round 0, from the ways ``tops(tree, way)`` of the trees' tops."""
    found = None
    for chunks in reversed(rounds):
        own = chunks.join(tops, "tree")
        if found is not None:  # trees that go on have their ways from the round above
            many = found.select("tree").distinct()
            below = chunks.join(found, ["tree", "chunk"])
            own = own.join(many, "tree", "left_anti").unionByName(below.select(*own.columns))
        if chunks is rounds[0]:
            return own.select("tree", "chunk", "way")
        found = own.mapInArrow(_ways, f"tree string, pos long, way {STEPS}").withColumnRenamed("pos", "chunk")


def _hex(digests: np.ndarray) -> list[str]:
    whole = as_text(digests).tobytes().decode()
    return [whole[k : k + 64] for k in range(0, len(whole), 64)]


PROVEN = "tree string, doc_id long, leaf string, proof_sha256 string, folded_root string"


def _prove(batches):
    for batch in batches:
        for row in batch.to_pylist():
            chunk = Chunk.read(row["n"], row["levels"], row["digests"], row["states"])
            replaced = _numbers(b"".join(x["replaced"] for x in row["rows"]))
            folded = fold_steps(chunk.fold(replaced), row["way"])
            above = b"".join(as_text(_numbers(s["left"] + s["right"])).tobytes() for s in row["way"])
            proofs = [hashlib.sha256(own + above).hexdigest() for own in chunk.siblings()]
            columns = [[row["tree"]] * len(proofs), [x["doc_id"] for x in row["rows"]], _hex(chunk.digests[0]), proofs, _hex(folded)]
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            names = ["tree", "doc_id", "leaf", "proof_sha256", "folded_root"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def digest(fields) -> F.Column:
    """The binary SHA-256 of columns: their byte count, a colon and their text each; ``-`` where there is none."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def write_manifest(rows: DataFrame, folder: str) -> tuple[DataFrame, DataFrame, list[DataFrame], list[DataFrame]]:
    """Writes the trees of ``rows(tree, doc_id, leaf, ...)``, leaves as 32 bytes.

    Returns the placed rows, ``(tree, subroot, root)``, and the chunks of the groups' trees and of the last tree.
    """
    leaves = placed(rows, ["doc_id", "leaf"], f"{folder}/rows")
    subroots, rounds = build_trees(leaves.select("tree", "pos", F.col("leaf").alias("digest")), f"{folder}/rows")
    groups = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("group"), F.col("top").alias("subroot"))
    groups = placed(groups, ["group"], f"{folder}/top")
    root, upper = build_trees(groups.select("tree", "pos", F.col("subroot").alias("digest")), f"{folder}/top")
    # The last tree is the only one of its kind, so its top is one row.
    tops = groups.join(F.broadcast(root.select(F.col("tree").alias("last"), F.col("top").alias("root"))), F.col("tree") == F.col("last"))
    tops = tops.select("group", "pos", "subroot", "root")
    return leaves, tops, rounds, upper


def folded(leaves: DataFrame, tops: DataFrame, rounds: list[DataFrame], upper: list[DataFrame]) -> DataFrame:
    """``tree, doc_id, leaf, proof_sha256, folded_root`` per row of ``leaves(tree, pos, doc_id, replaced)``."""
    none = upper[-1].select("tree", F.expr(f"CAST(array() AS {STEPS})").alias("way"))
    last = upper[0].join(ways_to_chunks(none, upper), ["tree", "chunk"]).mapInArrow(_ways, f"tree string, pos long, way {STEPS}")
    of_group = tops.join(last.select("pos", "way"), "pos").select(F.col("group").alias("tree"), "way")
    packed = leaves.groupBy("tree", F.expr(f"pos div {CHUNK}").alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("pos", "doc_id", "replaced"))).alias("rows"))
    whole = packed.join(rounds[0].drop("top"), ["tree", "chunk"]).join(ways_to_chunks(of_group, rounds), ["tree", "chunk"])
    return whole.mapInArrow(_prove, PROVEN)


def tampered_proofs(docs: DataFrame, folder: str) -> DataFrame:
    """The manifest of ``docs`` by language, and what a check says of rows whose text was tampered with.

    Where 3 divides the crc32 of the decimal ``doc_id``, A to Z of the text are lower-cased; without an id nothing is.
    """
    base = docs.select(*(F.col(c) for c in FIELDS))
    lower = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    fields = [F.col(c) for c in FIELDS]
    rows = base.select(
        F.coalesce(F.concat(F.lit("1"), "lang"), F.lit("0")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"),
        digest(fields).alias("leaf"), digest([*fields[:-1], F.coalesce(lower, "text")]).alias("replaced"),
    )
    leaves, tops, rounds, upper = write_manifest(rows, folder)
    proven = folded(leaves, tops, rounds, upper)
    roots = tops.select(F.col("group").alias("tree"), F.lower(F.hex("subroot")).alias("subroot"), F.lower(F.hex("root")).alias("root"))
    out = proven.join(roots, "tree").withColumn("verified", F.expr("folded_root = root"))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def tampered_proofs_sql(documents: str = "documents") -> str:
    """DuckDB's version: the trees by recursion, every parent hashed anew."""
    step = "c"
    for _ in range(8):
        step = f"list_transform([{step}], lambda y: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END)[1]"
    crc = f"""xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
  lambda s, b: list_transform([xor(s, b)], lambda c: {step})[1]), 4294967295)"""

    def leaf(text: str) -> str:
        fields = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
        return "sha256(" + " || ".join(f"coalesce(strlen({f})::VARCHAR || ':' || {f}, '-')" for f in fields) + ")"

    def tree(name: str, leaves: str) -> str:
        return f"""{name} AS (
  SELECT tree, 0 AS level, pos, d, n FROM ({leaves})
  UNION ALL
  SELECT tree, level + 1, pos // {WIDTH}, sha256(string_agg(d, '' ORDER BY pos)), (n + {WIDTH - 1}) // {WIDTH}
  FROM {name} WHERE n > 1 GROUP BY tree, level, pos // {WIDTH}, n)"""

    def beside(way: str) -> str:
        frame = f"OVER (PARTITION BY tree, level, pos // {WIDTH} ORDER BY pos ROWS BETWEEN"
        return f"coalesce(string_agg(d, '') {frame} {way}), '')"

    return f"""
WITH RECURSIVE rows_ AS (SELECT row_number() OVER () AS r, doc_id, coalesce('1' || lang, '0') AS tree, {leaf("text")} AS leaf,
  CASE WHEN {crc} % 3 = 0 THEN {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {leaf("text")} END AS changed FROM {documents}),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM rows_),
{tree("low", "SELECT tree, pos, leaf AS d, n FROM placed")},
subroots AS (SELECT tree AS grp, d, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
{tree("high", "SELECT '' AS tree, pos, d, n FROM subroots")},
depth AS (SELECT tree, max(level) AS top FROM low GROUP BY tree),
nodes AS (SELECT tree, level, pos, d, n, {beside(f"{WIDTH} PRECEDING AND 1 PRECEDING")} AS l, {beside(f"1 FOLLOWING AND {WIDTH} FOLLOWING")} AS r FROM low WHERE n > 1),
tops AS (SELECT level, pos, d, n, {beside(f"{WIDTH} PRECEDING AND 1 PRECEDING")} AS l, {beside(f"1 FOLLOWING AND {WIDTH} FOLLOWING")} AS r FROM high WHERE n > 1),
way AS (
  SELECT p.r, 0 AS step, p.tree, p.pos, n.level, n.l, n.r AS rt FROM placed p JOIN nodes n ON n.tree = p.tree AND n.pos = p.pos // ({WIDTH} ** n.level)::BIGINT
  UNION ALL
  SELECT p.r, 1, p.tree, p.pos, t.level, t.l, t.r FROM placed p JOIN subroots s ON s.grp = p.tree JOIN tops t ON t.pos = s.pos // ({WIDTH} ** t.level)::BIGINT),
numbered AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY step, level) AS k, count(*) OVER (PARTITION BY r) AS ks FROM way),
proofs AS (SELECT r, sha256(string_agg(l || rt, '' ORDER BY k)) AS proof FROM numbered GROUP BY r),
up AS (SELECT r, 0 AS k, changed AS d FROM placed UNION ALL SELECT u.r, u.k + 1, sha256(w.l || u.d || w.rt) FROM up u JOIN numbered w ON w.r = u.r AND w.k = u.k + 1),
ends AS (SELECT r, arg_max(d, k) AS d FROM up GROUP BY r)
SELECT p.doc_id, p.leaf, s.d AS subroot, h.d AS root, coalesce(f.proof, sha256('')) AS proof_sha256, e.d AS folded_root, e.d = h.d AS verified
FROM placed p JOIN subroots s ON s.grp = p.tree JOIN high h ON h.n = 1 JOIN ends e ON e.r = p.r LEFT JOIN proofs f ON f.r = p.r"""
