"""Decisions on two schemas: what changed, is it safe, what is the union."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# For each type the types that lose information when it is turned into them.
NARROWER = {
    "string": ("double", "bigint", "int", "boolean", "timestamp"),
    "double": ("bigint", "int"),
    "bigint": ("int",),
}
# Numeric types from narrow to wide; a value of one fits every later one.
WIDTH = ("tinyint", "smallint", "int", "bigint", "float", "double")


def is_narrowing(old: str, new: str, strict: bool = False) -> bool:
    """Whether ``old`` to ``new`` loses information; ``strict`` counts any other change too."""
    return new in NARROWER.get(old, ()) or (strict and old != new)


def fits(found: T.DataType, target: T.DataType) -> bool:
    """Whether every value of ``found`` can be stored as ``target`` unchanged."""
    if isinstance(found, T.NullType) or found == target:
        return True
    if isinstance(target, T.StringType) and not isinstance(found, (T.StructType, T.ArrayType, T.MapType)):
        return True
    if isinstance(found, T.StructType) and isinstance(target, T.StructType):
        have = {f.name.lower(): f.dataType for f in target.fields}
        return all(f.name.lower() in have and fits(f.dataType, have[f.name.lower()]) for f in found.fields)
    if isinstance(found, T.ArrayType) and isinstance(target, T.ArrayType):
        return fits(found.elementType, target.elementType)
    if isinstance(found, T.MapType) and isinstance(target, T.MapType):
        return fits(found.keyType, target.keyType) and fits(found.valueType, target.valueType)
    a, b = found.simpleString(), target.simpleString()
    if a in WIDTH and b in WIDTH:
        return WIDTH.index(a) <= WIDTH.index(b)
    return isinstance(target, T.TimestampType) and isinstance(found, (T.DateType, T.StringType))


def extended(target: T.DataType, found: T.DataType, promote: bool = False) -> T.DataType:
    """``target`` with the nested fields that only ``found`` has, names compared without case.

    Other types stay as they are; with ``promote`` a type that does not hold the found values becomes one that does.
    """
    if isinstance(target, T.StructType) and isinstance(found, T.StructType):
        incoming = {f.name.lower(): f for f in found.fields}
        out = []
        for f in target.fields:
            g = incoming.pop(f.name.lower(), None)
            out.append(f if g is None else T.StructField(f.name, extended(f.dataType, g.dataType, promote), True))
        return T.StructType(out + [T.StructField(g.name, g.dataType, True) for g in incoming.values()])
    if isinstance(target, T.ArrayType) and isinstance(found, T.ArrayType):
        return T.ArrayType(extended(target.elementType, found.elementType, promote))
    if isinstance(target, T.MapType) and isinstance(found, T.MapType):
        return T.MapType(target.keyType, extended(target.valueType, found.valueType, promote))
    return common_type(target, found, "widen") if promote and not fits(found, target) else target


def misfits(target: T.DataType, found: T.DataType, path: str = "", widen: bool = False) -> list[str]:
    """Where ``found`` has values that ``target`` cannot hold; fields that ``target`` lacks are none of them.

    With ``widen`` a wider number is none either.
    """
    if isinstance(target, T.StructType) and isinstance(found, T.StructType):
        have = {f.name.lower(): f for f in target.fields}
        out = []
        for f in found.fields:
            t = have.get(f.name.lower())
            if t is not None:
                out += misfits(t.dataType, f.dataType, f"{path}.{f.name}" if path else f.name, widen)
        return out
    if isinstance(target, T.ArrayType) and isinstance(found, T.ArrayType):
        return misfits(target.elementType, found.elementType, f"{path}[]", widen)
    if isinstance(target, T.MapType) and isinstance(found, T.MapType) and fits(found.keyType, target.keyType):
        return misfits(target.valueType, found.valueType, f"{path}{{}}", widen)
    if widen and found.simpleString() in WIDTH and target.simpleString() in WIDTH:
        return []
    return [] if fits(found, target) else [f"{path}: {found.simpleString()} does not fit {target.simpleString()}"]


def nested_additions(target: T.DataType, found: T.DataType, path: str = "") -> list[str]:
    """Fields inside columns of ``target`` that only ``found`` has."""
    if isinstance(target, T.StructType) and isinstance(found, T.StructType):
        have = {f.name.lower(): f for f in target.fields}
        out = []
        for f in found.fields:
            t = have.get(f.name.lower())
            name = f"{path}.{f.name}" if path else f.name
            if t is not None:
                out += nested_additions(t.dataType, f.dataType, name)
            elif path:
                out.append(name)
        return out
    if isinstance(target, T.ArrayType) and isinstance(found, T.ArrayType):
        return nested_additions(target.elementType, found.elementType, f"{path}[]")
    if isinstance(target, T.MapType) and isinstance(found, T.MapType):
        return nested_additions(target.valueType, found.valueType, f"{path}{{}}")
    return []


def reshaped(value, found: T.DataType, target: T.DataType):
    """A column of one type as another: structs by field name, what is missing NULL, other values cast."""
    from pyspark.sql import functions as F

    if found == target:
        return value
    if isinstance(target, T.StructType) and isinstance(found, T.StructType):
        have = {f.name.lower(): f for f in found.fields}
        fields = []
        for f in target.fields:
            g = have.get(f.name.lower())
            part = F.lit(None).cast(f.dataType) if g is None else reshaped(value[g.name], g.dataType, f.dataType)
            fields.append(part.alias(f.name))
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(target, T.ArrayType) and isinstance(found, T.ArrayType):
        return F.transform(value, lambda x: reshaped(x, found.elementType, target.elementType))
    if isinstance(target, T.MapType) and isinstance(found, T.MapType) and found.keyType == target.keyType:
        return F.transform_values(value, lambda _, x: reshaped(x, found.valueType, target.valueType))
    return value.cast(target)


def reshaped_rows(rows, target: T.StructType):
    """Rows with the columns and types of ``target``; columns they lack are NULL."""
    from pyspark.sql import functions as F

    have = {f.name.lower(): f for f in rows.schema.fields}
    out = []
    for f in target.fields:
        g = have.get(f.name.lower())
        quoted = None if g is None else F.col("`" + g.name.replace("`", "``") + "`")
        out.append((F.lit(None).cast(f.dataType) if g is None else reshaped(quoted, g.dataType, f.dataType)).alias(f.name))
    return rows.select(*out)


def common_type(a: T.DataType, b: T.DataType, promote: str) -> T.DataType:
    """Type for a column seen as both; ``promote="string"`` never widens numbers."""
    if isinstance(a, T.NullType):
        return b
    if isinstance(b, T.NullType) or a == b:
        return a
    if promote == "widen":
        if isinstance(a, T.StructType) and isinstance(b, T.StructType):
            return merge(a, b, promote)
        if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
            return T.ArrayType(common_type(a.elementType, b.elementType, promote))
        x, y = a.simpleString(), b.simpleString()
        if x in WIDTH and y in WIDTH:
            return a if WIDTH.index(x) >= WIDTH.index(y) else b
    return T.StringType()


def merge(old: T.StructType, new: T.StructType, promote: str = "string") -> T.StructType:
    """Union of fields in order, names compared without case; a column seen with two types or in one schema only becomes nullable."""
    incoming = {f.name.lower(): f for f in new.fields}
    out = []
    for f in old.fields:
        g = incoming.pop(f.name.lower(), None)
        if g is None:
            out.append(f)
        elif g.dataType == f.dataType:
            out.append(T.StructField(f.name, f.dataType, f.nullable or g.nullable))
        else:
            out.append(T.StructField(f.name, common_type(f.dataType, g.dataType, promote), True))
    out.extend(T.StructField(g.name, g.dataType, True) for g in incoming.values())
    return T.StructType(out)


def new_columns(table: T.StructType, incoming: T.StructType) -> list[T.StructField]:
    """Top-level fields the table lacks, names compared without case."""
    have = {f.name.lower() for f in table.fields}
    return [f for f in incoming.fields if f.name.lower() not in have]


@dataclass(frozen=True)
class SchemaChange:
    change_type: str
    column_name: str
    old_type: str | None
    new_type: str | None
    old_nullable: bool | None
    new_nullable: bool | None
    breaking: bool


def diff(old: T.StructType, new: T.StructType, strict: bool = False) -> list[SchemaChange]:
    """Field-by-field changes; removals, narrowing and lost nullability are breaking."""
    a = {f.name.lower(): f for f in old.fields}
    b = {f.name.lower(): f for f in new.fields}
    out = []
    for key in [*a, *(n for n in b if n not in a)]:
        x, y = a.get(key), b.get(key)
        name = (x or y).name
        ot, nt = x and x.dataType.simpleString(), y and y.dataType.simpleString()
        on, nn = x and x.nullable, y and y.nullable
        if x is None:
            out.append(SchemaChange("NEW_COLUMN", name, None, nt, None, nn, False))
            continue
        if y is None:
            out.append(SchemaChange("REMOVED_COLUMN", name, ot, None, on, None, True))
            continue
        if ot != nt:
            out.append(SchemaChange("TYPE_CHANGE", name, ot, nt, on, nn, is_narrowing(ot, nt, strict)))
        if on != nn:
            out.append(SchemaChange("NULLABILITY_CHANGE", name, ot, nt, on, nn, bool(on and not nn)))
    return out


def doubled_names(found: T.StructType) -> list[str]:
    """Columns that one schema spells in two ways; they cannot be told apart in a table."""
    seen: dict[str, str] = {}
    out = []
    for f in found.fields:
        first = seen.setdefault(f.name.lower(), f.name)
        if first != f.name:
            out.append(f"{f.name}: is also spelled {first}")
    return out


def typed(found: T.DataType) -> T.DataType:
    """Text for what no record had a value of."""
    if isinstance(found, T.StructType):
        fields = [(f, T.StringType() if f.dataType == T.StructType([]) else typed(f.dataType)) for f in found.fields]
        return T.StructType([T.StructField(f.name, kind, f.nullable) for f, kind in fields])
    if isinstance(found, T.ArrayType):
        return T.ArrayType(typed(found.elementType))
    return T.StringType() if isinstance(found, T.NullType) else found


def from_variant_schema(text: str) -> T.StructType | None:
    """Spark type of a ``schema_of_variant_agg`` result; None when the records are not objects."""
    from tidemark.functions.schema_nodes import schema_of

    found = schema_of(text)
    return None if found is None else typed(found)
