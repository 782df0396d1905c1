"""INSERT, UPDATE and DELETE over one table."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from .predicate import Predicate, and_, owned
from .table import BuildError, Column, Table


@dataclass(frozen=True)
class Assignment:
    """A column gets a value, a trusted expression or the proposed row's value."""

    column: Column
    kind: str
    value: Any


def _checked(table: Table, assignments: tuple[Assignment, ...], need: str, excluded: bool = False) -> tuple[Assignment, ...]:
    """The assignments by column name, if this statement may make them."""
    if not assignments:
        raise BuildError("there is nothing to assign")
    for a in assignments:
        if a.column.table is not table:
            raise BuildError("an assignment belongs to another table")
        if not getattr(a.column.capability, need):
            raise BuildError(f"column {a.column.name} is not {need}")
        if a.kind == "excluded" and not excluded:
            raise BuildError("EXCLUDED stands in DO UPDATE only")
    names = [a.column.name for a in assignments]
    if len(set(names)) < len(names):
        raise BuildError("a column is assigned twice")
    return tuple(sorted(assignments, key=lambda a: a.column.name))


@dataclass(frozen=True)
class Insert:
    """An immutable INSERT of literal rows, with an optional conflict clause."""

    table: Table
    rows: tuple[tuple[Assignment, ...], ...] = ()
    target: tuple[Column, ...] | None = None
    action: str | None = None
    updates: tuple[Assignment, ...] = ()
    returns: bool = False

    def row(self, *assignments: Assignment) -> Insert:
        own = _checked(self.table, assignments, "insertable")
        if self.rows and [a.column.name for a in self.rows[0]] != [a.column.name for a in own]:
            raise BuildError("rows assign different columns")
        return replace(self, rows=(*self.rows, own))

    def on_conflict(self, *columns: Column) -> Insert:
        if self.target is not None:
            raise BuildError("ON CONFLICT is given twice")
        if not columns or any(c.table is not self.table for c in columns) or len(set(columns)) < len(columns):
            raise BuildError("ON CONFLICT needs different columns of the table")
        return replace(self, target=columns)

    def on_any_conflict(self) -> Insert:
        if self.target is not None:
            raise BuildError("ON CONFLICT is given twice")
        return replace(self, target=())

    def do_nothing(self) -> Insert:
        if self.target is None:
            raise BuildError("DO NOTHING needs ON CONFLICT")
        return replace(self, action="nothing", updates=())

    def do_update(self, *assignments: Assignment) -> Insert:
        if not self.target:
            raise BuildError("DO UPDATE needs ON CONFLICT with columns")
        return replace(self, action="update", updates=_checked(self.table, assignments, "updatable", excluded=True))

    def returning(self) -> Insert:
        return replace(self, returns=True)

    def checked(self) -> Insert:
        if not self.rows:
            raise BuildError("INSERT has no rows")
        if self.target is not None and self.action is None:
            raise BuildError("ON CONFLICT has no action")
        return self


@dataclass(frozen=True)
class _Changing:
    table: Table
    condition: Predicate | None = None
    everywhere: bool = False
    returns: bool = False

    def where(self, condition: Predicate):
        owned(self.table, condition)
        return replace(self, condition=and_(self.condition, condition) if self.condition else condition)

    def all_rows(self):
        return replace(self, everywhere=True)

    def returning(self):
        return replace(self, returns=True)

    def _safe(self):
        if self.everywhere and self.condition:
            raise BuildError("all rows and a condition exclude each other")
        if not self.everywhere and not self.condition:
            raise BuildError("a condition is missing; say all_rows() to mean every row")
        return self


@dataclass(frozen=True)
class Update(_Changing):
    """An immutable UPDATE; without a condition it must say all_rows()."""

    assignments: tuple[Assignment, ...] = ()

    def set(self, *assignments: Assignment) -> Update:
        return replace(self, assignments=_checked(self.table, self.assignments + assignments, "updatable"))

    def checked(self) -> Update:
        _checked(self.table, self.assignments, "updatable")
        return self._safe()


@dataclass(frozen=True)
class Delete(_Changing):
    """An immutable DELETE; without a condition it must say all_rows()."""

    def checked(self) -> Delete:
        return self._safe()
