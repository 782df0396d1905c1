"""Conditions and SELECT as DataFrame plans."""

from __future__ import annotations

import operator
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.predicate import Both, Compare, CompareColumn, In, Not, NullTest, Predicate, Trusted
from ..plans.select import Order, Select
from ..plans.table import BuildError, Column

_OPS = {"=": operator.eq, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
#: Spark's limits are 32-bit.
MOST_ROWS = (1 << 31) - 1


def named(name: str) -> SparkColumn:
    return F.col("`" + name.replace("`", "``") + "`")


def literal(column: Column, value: Any) -> SparkColumn:
    return F.lit(list(value) if isinstance(value, tuple) else value).cast(column.dtype)


def _balanced(parts: list[SparkColumn], join) -> SparkColumn:
    """Joined as a balanced tree: a long chain would run out of stack."""
    while len(parts) > 1:
        parts = [join(*parts[k : k + 2]) if len(parts[k : k + 2]) == 2 else parts[k] for k in range(0, len(parts), 2)]
    return parts[0]


def condition(p: Predicate) -> SparkColumn:
    """The condition as a column of true, false or null."""
    match p:
        case Compare(_, op, column, value):
            return _OPS[op](named(column.name), literal(column, value))
        case CompareColumn(_, op, left, right):
            return _OPS[op](named(left.name), named(right.name))
        case In(_, column, values):
            return named(column.name).isin(*[literal(column, v) for v in values])
        case NullTest(_, column, null):
            return named(column.name).isNull() if null else named(column.name).isNotNull()
        case Trusted(_, text):
            return F.expr(str(text))
        case Both(_, op, parts):
            return _balanced([condition(q) for q in parts], operator.and_ if op == "AND" else operator.or_)
        case Not(_, part):
            return ~condition(part)
    raise BuildError(f"no condition: {type(p).__name__}")


def ordering(order: Order) -> SparkColumn:
    """Nulls count as the largest value: last when ascending, first when descending."""
    column = named(order.column.name)
    return column.desc_nulls_first() if order.descending else column.asc_nulls_last()


def select(df: DataFrame, s: Select) -> DataFrame:
    """The SELECT over the table's rows: filter, all columns, distinct, order, offset, limit.

    Locks are checked when built and have no effect: a DataFrame reads one
    snapshot. Spark's limits have 32 bits: a larger LIMIT returns every row of
    a table that has no more, a larger OFFSET none of a table that has no more;
    on a table that has more either fails the query, and never cuts in silence.
    """
    s.checked()
    if s.condition:
        df = df.where(condition(s.condition))
    df = df.select(*[named(n) for n in s.table.names])
    if s.is_distinct:
        df = df.distinct()
    skip, count = s.skip or 0, s.count
    if skip > MOST_ROWS:
        return _where_or_fail(df, _total(df) <= skip, False, "an OFFSET beyond 32 bits on a table with more rows")
    if count is not None and count > MOST_ROWS:
        df, count = _where_or_fail(df, _total(df) - skip <= count, True, "a LIMIT beyond 32 bits on a table with more rows"), None
    if s.orders:
        df = df.orderBy(*[ordering(o) for o in s.orders])
    if skip:
        df = df.offset(skip)
    return df if count is None else df.limit(count)


def _total(df: DataFrame) -> SparkColumn:
    return df.agg(F.count(F.lit(1))).scalar()


def _where_or_fail(df: DataFrame, holds: SparkColumn, keep: bool, message: str) -> DataFrame:
    """All rows or none where the condition holds, and a failing query where it does not."""
    return df.where(F.when(holds, F.lit(keep)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


class NoRows(LookupError):
    """A row was asked for and there is none."""


class MultipleRows(LookupError):
    """One row was asked for and there are more."""


def fetch_all(df: DataFrame, s: Select) -> list[Any]:
    """All rows as objects; for results that fit the driver. fetch_iter streams larger ones."""
    return [s.table.scan(r) for r in select(df, s).collect()]


def fetch_iter(df: DataFrame, s: Select) -> Iterator[Any]:
    """The rows as objects, a partition at a time."""
    return (s.table.scan(r) for r in select(df, s).toLocalIterator())


def fetch_optional(df: DataFrame, s: Select) -> Any | None:
    """The first row, or None. The statement's limit is replaced by 1, its offset is kept."""
    rows = fetch_all(df, s.limit(1))
    return rows[0] if rows else None


def fetch_one(df: DataFrame, s: Select) -> Any:
    rows = fetch_all(df, s.limit(1))
    if not rows:
        raise NoRows("the statement found no row")
    return rows[0]
