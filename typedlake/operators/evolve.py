"""Schema changes as rewrites of a table's rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .read import named


def add_column(df: DataFrame, name: str, dtype: str, default: str | None = None, generated: str | None = None, nullable: bool = True) -> DataFrame:
    """The rows with a new last column: its generated expression, its default, or null."""
    value = F.expr(generated or default) if generated or default else F.lit(None)
    if not nullable and value is not None and not (generated or default):
        value = F.raise_error(F.lit(f"column {name} is not null and has no default"))
    return df.withColumn(name, value.cast(dtype))


def drop_column(df: DataFrame, name: str) -> DataFrame:
    return df.drop(name)


def rename_column(df: DataFrame, name: str, to: str) -> DataFrame:
    return df.withColumnRenamed(name, to)


def alter_type(df: DataFrame, name: str, dtype: str) -> DataFrame:
    """The column cast to another type; a value that doesn't fit fails the query."""
    return df.withColumn(name, named(name).cast(dtype))


def generated_columns(df: DataFrame, expressions: Mapping[str, str]) -> DataFrame:
    """Stored generated columns, computed anew from the other columns."""
    return df.withColumns({name: F.expr(text) for name, text in expressions.items()})
