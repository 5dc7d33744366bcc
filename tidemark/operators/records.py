"""Record-level splits of text sources: what fits the schema, what does not, and what is left over."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.model import CORRUPT, SOURCE_FILE


def parse(lines: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """Typed columns plus the raw record where it does not fit."""
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    keep = [c for c in lines.columns if c != value]
    filled = lines.filter(F.trim(F.col(value)) != "")
    return filled.select(*keep, F.from_json(F.col(value), full, options).alias("_r")).select(*keep, "_r.*")


def split_corrupt(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected raw records); both are filters over one scan."""
    data = [c for c in parsed.columns if c != CORRUPT]
    rejected = [c for c in (SOURCE_FILE,) if c in data]
    return (
        parsed.filter(F.col(CORRUPT).isNull()).select(*data),
        parsed.filter(F.col(CORRUPT).isNotNull()).select(*rejected, CORRUPT),
    )


def corrupt_counts(parsed: DataFrame, *by: str) -> DataFrame:
    return parsed.groupBy(*by).agg(
        F.count_if(F.col(CORRUPT).isNull()).alias("valid_records"),
        F.count_if(F.col(CORRUPT).isNotNull()).alias("invalid_records"),
    )


def rescue(lines: DataFrame, schema: T.StructType, value: str = "value", into: str = "_rescued_data", corrupt: str | None = None) -> DataFrame:
    """Typed columns plus, as JSON, every field the schema lacks or whose value does not fit its type.

    Of a nested field that has more than its type, what is left of it. A record that is no object is what is left as a
    whole, or the column ``corrupt`` where that is named; empty lines are none then.
    """
    record = F.try_parse_json(F.col(value))
    keep = [c for c in lines.columns if c != value]
    parsed = lines.withColumns({"_v": record, "_m": record.try_cast("map<string,variant>")})
    if corrupt:
        parsed = parsed.filter(F.trim(F.col(value)) != "")
    rest = _rest("_m", F.col("_v"), schema)
    left = F.when(F.size(rest) > 0, F.to_json(rest))
    whole = F.col("_m").isNull()
    bad = [F.when(whole, F.col(value)).alias(corrupt)] if corrupt else []
    left = left if corrupt else F.when(whole, F.col(value)).otherwise(left)
    return parsed.select(*keep, *[_typed(F.col("_v"), f).alias(f.name) for f in schema.fields], left.alias(into), *bad)


def _member(name: str) -> str:
    return "$['" + name.replace("'", "\\'") + "']"


def _typed(v, f: T.StructField):
    return F.try_variant_get(v, _member(f.name), f.dataType.simpleString())


def _rest(fields, v, schema: T.StructType):
    """A map of what the schema does not hold of an object, given as a map and as a variant."""

    def lost(k, x):
        held = F.lit(False)
        for f in schema.fields:
            held = held | ((k == f.name) & (F.try_variant_get(x, "$", f.dataType.simpleString()).isNotNull() | F.is_variant_null(x)))
        return ~held

    rest = F.map_filter(fields, lost)
    for f in schema.fields:
        if isinstance(f.dataType, T.StructType):
            inner = F.try_variant_get(v, _member(f.name), "variant")
            below = _rest(inner.try_cast("map<string,variant>"), inner, f.dataType)
            more = F.map_from_arrays(F.array(F.lit(f.name)), F.array(F.to_variant_object(below)))
            rest = F.when(F.size(below) > 0, F.map_concat(rest, more)).otherwise(rest)
    return rest
