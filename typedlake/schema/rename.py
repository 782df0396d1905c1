"""Renames, which a comparison alone would see as a drop and an addition."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass
from typing import Any

from ..plans.table import BuildError, checked_identifier
from .diff import REVIEW, Operation, Plan, diff
from .model import Schema, SchemaError, TableDef

#: What can be renamed; all but tables and enums are parts of a table. Fixed values.
KINDS = ("table", "column", "index", "constraint", "enum")


@dataclass(frozen=True)
class Rename:
    kind: str
    name: str
    to: str
    table: str | None = None

    def validate(self) -> Rename:
        if self.kind not in KINDS:
            raise SchemaError("a rename of an unknown kind")
        if (self.table is None) != (self.kind in ("table", "enum")):
            raise SchemaError(f"a rename of a {self.kind} {'needs' if self.table is None else 'takes no'} table")
        try:
            for n in (self.name, self.to, *([self.table] if self.table else [])):
                checked_identifier("name", n)
        except BuildError as e:
            raise SchemaError(str(e)) from None
        if self.name == self.to:
            raise SchemaError("a rename to the same name")
        return self


def _swap(names: tuple[str, ...], r: Rename) -> tuple[str, ...]:
    return tuple(r.to if n == r.name else n for n in names)


def _one_of(things: tuple[Any, ...], r: Rename) -> tuple[Any, ...]:
    return tuple(dataclasses.replace(x, name=r.to) if x.name == r.name else x for x in things)


def _part(t: TableDef, r: Rename) -> TableDef:
    """The table with one of its parts renamed, and the part's uses with it; SQL text is left alone."""
    if r.kind == "column":
        if t.column(r.name) is None or t.column(r.to) is not None:
            raise SchemaError(f"column {r.name} can't be renamed")
        return dataclasses.replace(
            t,
            columns=_one_of(t.columns, r),
            primary_key=dataclasses.replace(t.primary_key, columns=_swap(t.primary_key.columns, r)) if t.primary_key else None,
            uniques=tuple(dataclasses.replace(u, columns=_swap(u.columns, r)) for u in t.uniques),
            indexes=tuple(dataclasses.replace(i, columns=_swap(i.columns, r), include=_swap(i.include, r)) for i in t.indexes),
            foreign_keys=tuple(dataclasses.replace(f, columns=_swap(f.columns, r)) for f in t.foreign_keys),
        )
    held = {"index": ("indexes",), "constraint": ("uniques", "checks", "foreign_keys")}[r.kind]
    found = sum(x.name == r.name for p in held for x in getattr(t, p)) + (r.kind == "constraint" and bool(t.primary_key) and t.primary_key.name == r.name)
    if found != 1:
        raise SchemaError(f"{r.kind} {r.name} is unknown or ambiguous")
    out = dataclasses.replace(t, **{p: _one_of(getattr(t, p), r) for p in held})
    if r.kind == "constraint" and out.primary_key and out.primary_key.name == r.name:
        out = dataclasses.replace(out, primary_key=dataclasses.replace(out.primary_key, name=r.to))
    return out


def renamed(schema: Schema, r: Rename) -> Schema:
    """The schema after one rename."""
    r.validate()
    if r.kind == "enum":
        if r.name not in {e.name for e in schema.enums}:
            raise SchemaError(f"enum {r.name} is unknown")
        types = {r.name: r.to, f"{r.name}[]": f"{r.to}[]", f'"{r.name}"': f'"{r.to}"', f'"{r.name}"[]': f'"{r.to}"[]'}
        tables = tuple(dataclasses.replace(t, columns=tuple(dataclasses.replace(c, type=types.get(c.type, c.type)) for c in t.columns)) for t in schema.tables)
        return dataclasses.replace(schema, tables=tables, enums=_one_of(schema.enums, r)).validate()
    at = r.table or r.name
    if schema.table(at) is None:
        raise SchemaError(f"table {at} is unknown")
    tables = []
    for t in schema.tables:
        if t.name == at:
            t = dataclasses.replace(t, name=r.to) if r.kind == "table" else _part(t, r)
        keys = []
        for f in t.foreign_keys:
            if f.table == at:
                f = dataclasses.replace(f, table=r.to) if r.kind == "table" else dataclasses.replace(f, references=_swap(f.references, r)) if r.kind == "column" else f
            keys.append(f)
        tables.append(dataclasses.replace(t, foreign_keys=tuple(keys)))
    return dataclasses.replace(schema, tables=tuple(tables)).validate()


def diff_with_renames(before: Schema, after: Schema, renames: list[Rename]) -> Plan:
    """The renames, then what is still different."""
    operations = []
    for r in renames:
        before = renamed(before, r)
        operations.append(Operation("rename_object", r.table, r.name, r, dataclasses.replace(r, name=r.to, to=r.name), REVIEW, f"users of the {r.kind} must know its new name"))
    return Plan((*operations, *diff(before, after).operations)).ordered()
