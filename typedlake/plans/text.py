"""Statements as parameterised SQL text: values only ever become numbered parameters."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from .predicate import Both, Compare, CompareColumn, In, Not, NullTest, Predicate, Trusted
from .select import Select
from .statements import Assignment, Delete, Insert, Update
from .table import Column, Table


@dataclass(frozen=True)
class Statement:
    sql: str
    args: tuple[Any, ...]


@dataclass
class _Params:
    args: list[Any] = field(default_factory=list)

    def bind(self, value: Any) -> str:
        self.args.append(value)
        return f"${len(self.args)}"


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _names(columns: list[str]) -> str:
    return ", ".join(map(quoted, columns))


def _condition(p: Predicate, params: _Params) -> str:
    match p:
        case Compare(_, op, column, value):
            return f"{quoted(column.name)} {op} {params.bind(value)}"
        case CompareColumn(_, op, left, right):
            return f"{quoted(left.name)} {op} {quoted(right.name)}"
        case In(_, column, values):
            return f"{quoted(column.name)} IN ({', '.join(params.bind(v) for v in values)})"
        case NullTest(_, column, null):
            return f"{quoted(column.name)} IS {'' if null else 'NOT '}NULL"
        case Trusted(_, text):
            return str(text)
        case Both(_, op, parts):
            return f" {op} ".join(f"({_condition(q, params)})" for q in parts)
        case Not(_, part):
            return f"NOT ({_condition(part, params)})"
    raise TypeError(type(p).__name__)


def _assigned(a: Assignment, params: _Params) -> str:
    if a.kind == "value":
        return params.bind(a.value)
    return str(a.value) if a.kind == "sql" else f"EXCLUDED.{quoted(a.column.name)}"


def _where(p: Predicate | None, params: _Params) -> str:
    return f" WHERE {_condition(p, params)}" if p else ""


def _returning(table: Table, wanted: bool) -> str:
    return f" RETURNING {_names(table.names)}" if wanted else ""


def _targets(columns: tuple[Column, ...]) -> str:
    return f" ({_names([c.name for c in columns])})" if columns else ""


def render(statement: Select | Insert | Update | Delete) -> Statement:
    """The statement's text and its parameters in the order of their numbers."""
    s, params = statement.checked(), _Params()
    match s:
        case Select():
            sql = f"SELECT {'DISTINCT ' if s.is_distinct else ''}{_names(s.table.names)} FROM {quoted(s.table.name)}{_where(s.condition, params)}"
            if s.orders:
                sql += " ORDER BY " + ", ".join(f"{quoted(o.column.name)} {'DESC' if o.descending else 'ASC'}" for o in s.orders)
            sql += f" LIMIT {params.bind(s.count)}" if s.count is not None else ""
            sql += f" OFFSET {params.bind(s.skip)}" if s.skip is not None else ""
            sql += f" FOR {s.lock}" if s.lock else ""
            sql += f" {s.wait}" if s.wait else ""
        case Insert():
            rows = ", ".join(f"({', '.join(_assigned(a, params) for a in row)})" for row in s.rows)
            sql = f"INSERT INTO {quoted(s.table.name)} ({_names([a.column.name for a in s.rows[0]])}) VALUES {rows}"
            if s.target is not None:
                sql += f" ON CONFLICT{_targets(s.target)} DO "
                sql += "NOTHING" if s.action == "nothing" else "UPDATE SET " + ", ".join(f"{quoted(a.column.name)} = {_assigned(a, params)}" for a in s.updates)
            sql += _returning(s.table, s.returns)
        case Update():
            sets = ", ".join(f"{quoted(a.column.name)} = {_assigned(a, params)}" for a in s.assignments)
            sql = f"UPDATE {quoted(s.table.name)} SET {sets}{_where(s.condition, params)}{_returning(s.table, s.returns)}"
        case Delete():
            sql = f"DELETE FROM {quoted(s.table.name)}{_where(s.condition, params)}{_returning(s.table, s.returns)}"
    return Statement(sql, tuple(params.args))
