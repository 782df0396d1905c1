"""Tables and their typed columns."""

from __future__ import annotations

import datetime as dt
import decimal
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

#: Bytes of the longest identifier.
IDENTIFIER_BYTES = 63


class BuildError(ValueError):
    """A statement that can't be built. The message never holds a value."""


class TrustedSQL(str):
    """SQL text that the program vouches for; a plain str is not taken for it."""


def checked_identifier(kind: str, name: str) -> str:
    if not isinstance(name, str) or not name.strip():
        raise BuildError(f"{kind} is blank")
    if "\0" in name:
        raise BuildError(f"{kind} holds a NUL")
    if len(name.encode()) > IDENTIFIER_BYTES:
        raise BuildError(f"{kind} is longer than {IDENTIFIER_BYTES} bytes")
    return name


def checked_sql(text: TrustedSQL) -> TrustedSQL:
    if not isinstance(text, TrustedSQL):
        raise BuildError("trusted SQL must be given as TrustedSQL")
    if not text.strip() or "\0" in text:
        raise BuildError("trusted SQL is blank or holds a NUL")
    return text


@dataclass(frozen=True)
class Capability:
    """Whether statements may insert into, or update, a column."""

    insertable: bool
    updatable: bool


MUTABLE, READ_ONLY = Capability(True, True), Capability(False, False)
INSERT_ONLY, UPDATE_ONLY = Capability(True, False), Capability(False, True)

#: Python types whose values a column of a Spark type takes.
_TAKES: dict[str, tuple[type, ...]] = {
    "string": (str,),
    "boolean": (bool,),
    "tinyint": (int,),
    "smallint": (int,),
    "int": (int,),
    "bigint": (int,),
    "float": (int, float),
    "double": (int, float),
    "date": (dt.date,),
    "timestamp": (dt.datetime,),
    "timestamp_ntz": (dt.datetime,),
    "binary": (bytes, bytearray),
}
_RANGE = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}


@dataclass(frozen=True, eq=False)
class Column:
    """A column of one table; compares and assigns values of its type only."""

    table: Table
    name: str
    dtype: str
    capability: Capability = MUTABLE

    def checked(self, value: Any) -> Any:
        """The value, if the column takes it; None always."""
        if value is None:
            return None
        base = self.dtype.split("(")[0]
        takes = (decimal.Decimal, int) if base == "decimal" else (list, tuple) if base.startswith("array") else _TAKES.get(base, (str,))
        wrong = not isinstance(value, takes) or (isinstance(value, bool) and bool not in takes) or (base == "date" and isinstance(value, dt.datetime))
        if wrong or (base in _RANGE and not -(1 << _RANGE[base] - 1) <= value < 1 << _RANGE[base] - 1):
            raise BuildError(f"column {self.name} takes no value of type {type(value).__name__} outside {self.dtype}")
        return value

    def _compare(self, op: str, value: Any):
        from .predicate import Compare

        return Compare(self.table, op, self, self.checked(value))

    def eq(self, value: Any):
        return self._compare("=", value)

    def ne(self, value: Any):
        return self._compare("<>", value)

    def lt(self, value: Any):
        return self._compare("<", value)

    def lte(self, value: Any):
        return self._compare("<=", value)

    def gt(self, value: Any):
        return self._compare(">", value)

    def gte(self, value: Any):
        return self._compare(">=", value)

    def _compare_column(self, op: str, other: Column):
        from .predicate import CompareColumn

        if other.table is not self.table:
            raise BuildError("columns of different tables don't compare")
        if other.dtype != self.dtype:
            raise BuildError("columns of different types don't compare")
        return CompareColumn(self.table, op, self, other)

    def eq_column(self, other: Column):
        return self._compare_column("=", other)

    def ne_column(self, other: Column):
        return self._compare_column("<>", other)

    def in_(self, *values: Any):
        from .predicate import In

        if not values:
            raise BuildError(f"IN on column {self.name} has no values")
        return In(self.table, self, tuple(self.checked(v) for v in values))

    def is_null(self):
        from .predicate import NullTest

        return NullTest(self.table, self, True)

    def is_not_null(self):
        from .predicate import NullTest

        return NullTest(self.table, self, False)

    def asc(self):
        from .select import Order

        return Order(self, False)

    def desc(self):
        from .select import Order

        return Order(self, True)

    def set(self, value: Any):
        from .statements import Assignment

        return Assignment(self, "value", self.checked(value))

    def set_sql(self, text: TrustedSQL):
        from .statements import Assignment

        return Assignment(self, "sql", checked_sql(text))

    def excluded(self):
        """The value of the row that an insert proposed; for DO UPDATE only."""
        from .statements import Assignment

        return Assignment(self, "excluded", None)


@dataclass(frozen=True, eq=False)
class Table:
    """A table's name and columns, in the order in which they are selected.

    columns: (name, Spark type) or (name, Spark type, capability). row makes a
    fetched row's object from its values, in that order. Two tables of one name
    are different tables.
    """

    name: str
    columns: Sequence[tuple]
    row: Callable[..., Any] | None = None
    _by_name: dict[str, Column] = field(init=False, repr=False, default_factory=dict)

    def __post_init__(self) -> None:
        checked_identifier("table name", self.name)
        if not self.columns:
            raise BuildError("a table has at least one column")
        for spec in self.columns:
            name = checked_identifier("column name", spec[0])
            if name.lower() in {n.lower() for n in self._by_name}:
                raise BuildError("two columns of a table have one name (case aside)")
            self._by_name[name] = Column(self, *spec)

    def __getitem__(self, name: str) -> Column:
        if name not in self._by_name:
            raise BuildError("the table has no such column")
        return self._by_name[name]

    def __getattr__(self, name: str) -> Column:
        if name.startswith("_") or name not in self._by_name:
            raise AttributeError(name)
        return self._by_name[name]

    @property
    def names(self) -> list[str]:
        return list(self._by_name)

    def scan(self, values: Sequence[Any]) -> Any:
        """A row's object."""
        return self.row(*values) if self.row else tuple(values)
