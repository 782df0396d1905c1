"""Conditions over one table, in three-valued logic."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from .table import BuildError, Column, Table, TrustedSQL, checked_sql


@dataclass(frozen=True)
class Predicate:
    table: Table


@dataclass(frozen=True)
class Compare(Predicate):
    """A column against a value; a null value makes it unknown and no row passes."""

    op: str
    column: Column
    value: Any


@dataclass(frozen=True)
class CompareColumn(Predicate):
    op: str
    left: Column
    right: Column


@dataclass(frozen=True)
class In(Predicate):
    column: Column
    values: tuple


@dataclass(frozen=True)
class NullTest(Predicate):
    column: Column
    null: bool


@dataclass(frozen=True)
class Trusted(Predicate):
    text: TrustedSQL


@dataclass(frozen=True)
class Both(Predicate):
    """All (AND) or any (OR) of the parts."""

    op: str
    parts: tuple[Predicate, ...]


@dataclass(frozen=True)
class Not(Predicate):
    part: Predicate


def _joined(op: str, parts: tuple[Predicate, ...]) -> Both:
    if not parts:
        raise BuildError(f"{op} has no operands")
    if any(p.table is not parts[0].table for p in parts):
        raise BuildError(f"{op} joins conditions of different tables")
    return Both(parts[0].table, op, parts)


def and_(*parts: Predicate) -> Both:
    return _joined("AND", parts)


def or_(*parts: Predicate) -> Both:
    return _joined("OR", parts)


def not_(part: Predicate) -> Not:
    return Not(part.table, part)


def trusted(table: Table, text: TrustedSQL) -> Trusted:
    return Trusted(table, checked_sql(text))


def owned(table: Table, part: Predicate) -> Predicate:
    """The condition, if it is one of this table."""
    if part.table is not table:
        raise BuildError("the condition belongs to another table")
    return part
