"""Column expressions shared by the operators."""

from __future__ import annotations

import re
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

BYTES_PER_GB = 1024**3


def as_column(value) -> Column:
    """Literal for an as-of moment; strings become zone-less timestamps."""
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        return F.lit(value).cast("timestamp_ntz")
    if isinstance(value, (date, datetime)):
        return F.lit(value)
    raise TypeError(f"not a moment: {value!r}")


def settled(spark, value) -> Column:
    """A moment's value now as a literal, so that jobs which run at different times get the same."""
    if not isinstance(value, Column):
        return as_column(value)
    now = spark.range(1).select(value.alias("m"))
    kind = now.schema["m"].dataType
    if kind == T.TimestampType():
        return F.timestamp_micros(F.lit(now.select(F.unix_micros("m")).first()[0]).cast("bigint"))
    return F.lit(now.select(F.col("m").cast("string")).first()[0]).cast(kind)


def minus(moment: Column, **units: int) -> Column:
    """``moment`` minus hours/days given as keyword arguments."""
    out = moment
    for unit, n in units.items():
        out = F.timestamp_add(unit.rstrip("s").upper(), F.lit(-int(n)), out)
    return out


def plus(moment: Column, unit: str, n: Column) -> Column:
    return F.timestamp_add(unit.upper(), n.cast("int"), moment)


def gigabytes(size: Column) -> Column:
    return size / F.lit(float(BYTES_PER_GB))


def first_per_key(rows: DataFrame, keys, order) -> DataFrame:
    """The row of each key that is greatest in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") == 1).drop("_rank")


def round_half_even(value: Column, digits: int) -> Column:
    """Rounds amounts as Python's ``round`` does: exact halves go to the even digit."""
    scale = float(10**digits)
    return F.rint(value.cast("double") * scale) / scale


def glob_to_regex(pattern: str) -> str:
    """Anchored regular expression of a path glob: ``*`` and ``?`` stop at ``/``, ``**`` does not."""
    token = re.compile(r"\*\*/|\*\*|\*|\?|\[!?[^\]]*\]|\{[^}]*\}|.", re.S)
    fixed = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}

    def one(m: re.Match) -> str:
        t = m.group(0)
        if t in fixed:
            return fixed[t]
        if t.startswith("[") and len(t) > 1:
            body = t[1:-1]
            return "[^" + body[1:] + "]" if body.startswith("!") else "[" + body + "]"
        if t.startswith("{") and len(t) > 1:
            return "(?:" + "|".join(re.escape(x) for x in t[1:-1].split(",")) + ")"
        return re.escape(t)

    body = token.sub(one, pattern.lstrip("/"))
    return f"^(?:.*/)?{body}$"


def parse_timestamps(text: Column, formats: list[str]) -> Column:
    """First format that parses wins; NULL when none does."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


# Error classes, the error types they hold, whether to retry, whether a user must act.
ERROR_CLASSES = {
    "corrupt": (("CorruptFileException", "CorruptFileError", "MalformedRecordError", "JSONDecodeError"), False, False),
    "schema_mismatch": (("SchemaException", "SchemaEvolutionError", "AnalysisException"), False, True),
    "transient": (("TransientException", "TimeoutError", "ConnectionError", "ThrottlingException"), True, False),
}


def error_class(error_type: Column) -> Column:
    """``struct(error_class, retryable, action_required)``; anything unknown is retryable."""
    name = F.lit("unknown")
    retryable = F.lit(True)
    action = F.lit(False)
    for cls, (types, retry, act) in ERROR_CLASSES.items():
        hit = error_type.isin(*types)
        name = F.when(hit, F.lit(cls)).otherwise(name)
        retryable = F.when(hit, F.lit(retry)).otherwise(retryable)
        action = F.when(hit, F.lit(act)).otherwise(action)
    return F.struct(name.alias("error_class"), retryable.alias("retryable"), action.alias("action_required"))


# Minutes to wait before retry 1, 2 and 3.
BACKOFF_MINUTES = (1, 5, 15)


def next_retry_at(failed_at: Column, retry_count: Column) -> Column:
    """When a failed file may be tried again; NULL once the retries are used up."""
    wait = F.lit(None).cast("int")
    for n, minutes in enumerate(BACKOFF_MINUTES):
        wait = F.when(retry_count == n, F.lit(minutes)).otherwise(wait)
    return plus(failed_at, "MINUTE", wait)


# Runs per month by schedule frequency.
RUNS_PER_MONTH = {"hourly": 720, "daily": 30, "weekly": 4, "monthly": 1}


def runs_per_month(frequency: Column) -> Column:
    out = F.lit(30)
    for name, n in RUNS_PER_MONTH.items():
        out = F.when(frequency == name, F.lit(n)).otherwise(out)
    return out
