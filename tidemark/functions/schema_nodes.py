"""Schemas as rows, one per column or nested field, so that any number of them folds by an aggregate.

A node's path has ``.name`` (lower case) for a field, ``[]`` for the elements of an array and ``{}`` for the values of a
map. Its kind is ``struct``, ``array``, ``map<key>``, ``void`` or a type's name.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.functions.schema_types import WIDTH

NODE = "path array<string>, name string, kind string, position int"
KNOWN = {k.typeName(): k for k in (T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType, T.StringType, T.DoubleType, T.FloatType)}
# Spark's short names of integers.
KNOWN |= {"tinyint": T.ByteType, "smallint": T.ShortType, "int": T.IntegerType, "bigint": T.LongType}

_TOKEN = re.compile(r"`((?:[^`]|``)*)`|([A-Z_]+)(\([0-9, ]+\))?|([<>,:])|\s+|([^`<>,:\s]+)")


def parse_variant_schema(text: str) -> T.DataType | None:
    """The type that ``schema_of_variant`` names; decimals are doubles, mixed values text, VOID stays without a type."""
    tokens = []
    for m in _TOKEN.finditer(text or ""):
        if m.group(0).strip():
            tokens.append((m.group(0), m.group(1).replace("``", "`") if m.group(1) is not None else m.group(0)))
    at = 0

    def peek() -> str:
        return tokens[at][0] if at < len(tokens) else ""

    def take(expected: str | None = None) -> tuple[str, str]:
        nonlocal at
        if at >= len(tokens) or expected is not None and tokens[at][0] != expected:
            raise ValueError(f"not a variant schema: {text!r}")
        at += 1
        return tokens[at - 1]

    def name() -> str:
        parts = [take()[1]]
        while peek() not in (":", ""):
            parts.append(take()[1])
        return "".join(parts)

    def kind() -> T.DataType:
        word = take()[0].split("(")[0]
        if word == "OBJECT":
            take("<")
            fields = []
            while peek() != ">":
                if fields:
                    take(",")
                label = name()
                take(":")
                fields.append(T.StructField(label, kind(), True))
            take(">")
            return T.StructType(fields)
        if word == "ARRAY":
            take("<")
            inner = kind()
            take(">")
            return T.ArrayType(inner)
        if word == "VOID":
            return T.NullType()
        if word == "DECIMAL":
            return T.DoubleType()
        return KNOWN.get(word.lower(), T.StringType)()

    return kind() if tokens else None


def schema_of(text: str | None) -> T.StructType | None:
    """A record's schema from its JSON, or from Spark's text for variants; of arrays that of the elements."""
    if not text:
        return None
    found = T.StructType.fromJson(json.loads(text)) if text.startswith("{") else parse_variant_schema(text)
    while isinstance(found, T.ArrayType):
        found = found.elementType
    return found if isinstance(found, T.StructType) else None


def nodes(found: T.DataType, path: tuple[str, ...] = (), name: str = "", position: int = 0) -> list[tuple]:
    if isinstance(found, T.StructType):
        # An object that never has a field tells nothing of its type.
        own, below = "struct" if found.fields else "void", [n for k, f in enumerate(found.fields) for n in nodes(f.dataType, (*path, "." + f.name.lower()), f.name, k)]
    elif isinstance(found, T.ArrayType):
        own, below = "array", nodes(found.elementType, (*path, "[]"))
    elif isinstance(found, T.MapType):
        own, below = f"map<{found.keyType.simpleString()}>", nodes(found.valueType, (*path, "{}"))
    else:
        own, below = found.simpleString(), []
    return ([(list(path), name, own, position)] if path else []) + below


def rebuilt(rows, empty: T.DataType = T.NullType()) -> T.StructType:
    """The schema of ``(path, name, kind)`` rows in their order; a column without any type gets ``empty``."""
    kinds = {tuple(r[0]): (r[1], r[2]) for r in rows}
    below: dict[tuple, list[tuple]] = {}
    for path in kinds:
        below.setdefault(path[:-1], []).append(path)

    def build(path: tuple) -> T.DataType:
        kind = kinds[path][1] if path else "struct"
        if kind == "struct":
            return T.StructType([T.StructField(kinds[p][0], build(p), True) for p in below.get(path, []) if p[-1].startswith(".")])
        if kind == "array":
            return T.ArrayType(build((*path, "[]")) if (*path, "[]") in kinds else empty)
        if kind.startswith("map<"):
            return T.MapType(_atomic(kind[4:-1]), build((*path, "{}")) if (*path, "{}") in kinds else empty)
        return empty if kind == "void" else _atomic(kind)

    return build(())


def _atomic(kind: str) -> T.DataType:
    if kind in KNOWN:
        return KNOWN[kind]()
    m = re.fullmatch(r"decimal\((\d+),(\d+)\)", kind)
    return T.DecimalType(int(m[1]), int(m[2])) if m else T._parse_datatype_string(kind)


def width(kind) -> F.Column:
    """The place of a numeric type among them, NULL for others."""
    out = F.lit(None).cast("int")
    for k, name in enumerate(WIDTH):
        out = F.when(kind == name, k).otherwise(out)
    return out


def folded(rows: DataFrame, first_wins: bool = False) -> DataFrame:
    """``path, name, kind`` of the union of schemas given as ``first, path, name, kind, position``.

    ``first`` orders the schemas: it names a field and places it. Numbers widen, other differences become text;
    with ``first_wins`` the first type stays. Each step is a commutative aggregate per path.
    """
    typed = F.col("kind") != "void"
    of_width = F.col("_width")
    each = rows.withColumn("_width", width(F.col("kind"))).groupBy("path").agg(
        F.min(F.struct("first", "position", "name")).alias("_at"),
        F.min_by(F.when(typed, F.col("kind")), F.when(typed, F.col("first"))).alias("_first"),
        F.min(F.when(typed, F.col("kind"))).alias("_low"), F.max(F.when(typed, F.col("kind"))).alias("_high"),
        F.max(of_width).alias("_widest"), F.bool_and(F.when(typed, of_width.isNotNull())).alias("_numbers"),
    )
    wide = F.element_at(F.array(*[F.lit(w) for w in WIDTH]), F.col("_widest") + 1)
    kind = F.when(F.col("_low") == F.col("_high"), F.col("_low")).when(F.col("_numbers"), wide).otherwise(F.lit("string"))
    if first_wins:
        kind = F.col("_first")
    out = each.select("path", "_at.name", F.coalesce(kind, F.lit("void")).alias("kind"), F.col("_at.first").alias("first"), F.col("_at.position").alias("position"))
    return out.orderBy(F.size("path"), "first", "position", "path")


def merged_schema(rows: DataFrame, first_wins: bool = False) -> T.StructType:
    """The folded schema; only its columns come to the driver."""
    return rebuilt(folded(rows, first_wins).select("path", "name", "kind").collect())


def described(groups: DataFrame, text: str = "found", first: str = "first") -> DataFrame:
    """Nodes of schemas given as texts, parsed in the tasks."""
    import pandas as pd

    def run(batches):
        for batch in batches:
            out = []
            for found, at in zip(batch[text], batch[first]):
                s = schema_of(found)
                out += [(at, *n) for n in nodes(s)] if s is not None else []
            yield pd.DataFrame(out, columns=["first", "path", "name", "kind", "position"])

    return groups.select(text, first).mapInPandas(run, f"first string, {NODE}")
