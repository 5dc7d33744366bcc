"""Light transforms on the way into the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.expressions import parse_timestamps


def select_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns)


def filter_rows(df: DataFrame, condition: str | Column) -> DataFrame:
    return df.filter(condition)


def rename_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def cast_columns(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Casts that give NULL instead of failing; count the losses with :func:`failed_casts`."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


def failed_casts(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Per column: non-null values that the cast would lose. One pass, one small row per column."""
    counts = df.agg(*[
        F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull()).alias(c) for c, t in types.items()
    ])
    return counts.unpivot([], list(types), "column_name", "failed_count")


def parse_dates(df: DataFrame, column: str, formats: list[str], into: str) -> DataFrame:
    return df.withColumn(into, parse_timestamps(F.col(column), formats))


def fill_derived(df: DataFrame, column: str, parts: list[str], sep: str = "-") -> DataFrame:
    """Adds the column where absent and fills its NULLs from other columns."""
    value = F.concat_ws(sep, *[F.col(p).cast("string") for p in parts])
    have = F.col(column) if column in df.columns else F.lit(None).cast("string")
    return df.withColumn(column, F.coalesce(have, value))


TRANSFORMS = {
    "select": lambda df, arg: select_columns(df, arg),
    "filter": lambda df, arg: filter_rows(df, arg),
    "rename": lambda df, arg: rename_columns(df, arg),
    "cast": lambda df, arg: cast_columns(df, arg),
    # (column, formats, into) and (column, parts) or (column, parts, separator)
    "parse_dates": lambda df, arg: parse_dates(df, *arg),
    "derive": lambda df, arg: fill_derived(df, *arg),
}


def names(arg) -> list[str]:
    """The columns that a step's argument names first: those it turns."""
    return [arg[0]] if isinstance(arg, tuple) else list(arg)


def apply(df: DataFrame, steps: list[tuple[str, object]]) -> DataFrame:
    """Configured steps in order."""
    for name, arg in steps:
        df = TRANSFORMS[name](df, arg)
    return df
