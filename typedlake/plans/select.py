"""SELECT over one table."""

from __future__ import annotations

from dataclasses import dataclass, replace

from .predicate import Predicate, and_, owned
from .table import BuildError, Column, Table


@dataclass(frozen=True)
class Order:
    column: Column
    descending: bool


@dataclass(frozen=True)
class Select:
    """An immutable SELECT of all columns of a table; every method returns another."""

    table: Table
    is_distinct: bool = False
    condition: Predicate | None = None
    orders: tuple[Order, ...] = ()
    count: int | None = None
    skip: int | None = None
    lock: str | None = None
    wait: str | None = None

    def distinct(self) -> Select:
        return replace(self, is_distinct=True)

    def where(self, condition: Predicate) -> Select:
        """Narrow by a condition; repeated calls all hold."""
        owned(self.table, condition)
        return replace(self, condition=and_(self.condition, condition) if self.condition else condition)

    def order_by(self, *orders: Order) -> Select:
        if any(o.column.table is not self.table for o in orders):
            raise BuildError("ORDER BY a column of another table")
        return replace(self, orders=self.orders + orders)

    def limit(self, count: int) -> Select:
        if count < 0:
            raise BuildError("LIMIT is negative")
        return replace(self, count=count)

    def offset(self, skip: int) -> Select:
        if skip < 0:
            raise BuildError("OFFSET is negative")
        return replace(self, skip=skip)

    def _locked(self, lock: str) -> Select:
        if self.lock not in (None, lock):
            raise BuildError("FOR UPDATE and FOR SHARE exclude each other")
        return replace(self, lock=lock)

    def for_update(self) -> Select:
        return self._locked("UPDATE")

    def for_share(self) -> Select:
        return self._locked("SHARE")

    def _waiting(self, wait: str) -> Select:
        if self.wait not in (None, wait):
            raise BuildError("SKIP LOCKED and NOWAIT exclude each other")
        return replace(self, wait=wait)

    def skip_locked(self) -> Select:
        return self._waiting("SKIP LOCKED")

    def no_wait(self) -> Select:
        return self._waiting("NOWAIT")

    def checked(self) -> Select:
        if self.wait and not self.lock:
            raise BuildError("SKIP LOCKED and NOWAIT need a lock")
        return self
