"""What turns one schema into another: ordered operations with their risk."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from typing import Any

from .model import ColumnDef, Schema, SchemaError, TableDef
from .snapshot import canonical

#: Risks in rising order. Fixed values.
SAFE, REVIEW, DESTRUCTIVE = RISKS = ("safe", "review", "destructive")
#: Operation kinds in the order in which they are carried out; the reverse undoes them. Fixed values.
ORDER = ("create_extension", "rename_object", "create_enum", "drop_foreign_key", "drop_index drop_unique drop_check", "drop_table", "create_table", "add_column", "alter_column", "drop_column", "create_index add_unique add_check", "add_foreign_key", "drop_enum")
BUCKETS = {kind: n for n, kinds in enumerate(ORDER) for kind in kinds.split()}

_THINGS = {"extension": "str", "enum": "EnumType", "table": "TableDef", "column": "ColumnDef", "foreign_key": "ForeignKey", "index": "Index", "unique": "Unique", "check": "Check"}
#: What stands before and after an operation of each kind, and the kinds that are of no table.
FORMS = {k: (None, _THINGS[k.split("_", 1)[1]]) if k.split("_")[0] in ("create", "add") else (_THINGS[k.split("_", 1)[1]], None) for k in BUCKETS if k not in ("rename_object", "alter_column")}
FORMS |= {"rename_object": ("Rename", "Rename"), "alter_column": ("ColumnDef", "ColumnDef")}
TABLELESS = ("create_extension", "rename_object", "create_enum", "drop_enum")


@dataclass(frozen=True)
class Operation:
    """One change: what it is done to, what was there before and what is after."""

    kind: str
    table: str | None
    name: str
    before: Any = None
    after: Any = None
    risk: str = SAFE
    reason: str = ""


@dataclass(frozen=True)
class Plan:
    operations: tuple[Operation, ...] = ()

    @property
    def max_risk(self) -> str:
        return max((o.risk for o in self.operations), key=RISKS.index, default=SAFE)

    @property
    def warnings(self) -> list[str]:
        return [f"{o.risk} {o.kind}: {o.reason}" for o in self.operations if o.risk != SAFE]

    def validate(self) -> Plan:
        """This plan, or a SchemaError for the first operation that nobody could carry out."""
        for n, o in enumerate(self.operations):
            if o.kind not in FORMS:
                raise SchemaError(f"operation {n} is of an unknown kind")
            if o.risk not in RISKS:
                raise SchemaError(f"operation {n} ({o.kind}) has an unknown risk")
            if o.kind not in TABLELESS and not (o.table or "").strip():
                raise SchemaError(f"operation {n} ({o.kind}) needs a table")
            if tuple(None if x is None else type(x).__name__ for x in (o.before, o.after)) != FORMS[o.kind]:
                raise SchemaError(f"operation {n} ({o.kind}) lacks what it changes")
            if o.kind == "alter_column" and o.before.name != o.after.name:
                raise SchemaError(f"operation {n} ({o.kind}) changes another column")
            if o.kind == "rename_object":
                o.before.validate()
                o.after.validate()
        return self

    def ordered(self) -> Plan:
        return Plan(tuple(sorted(self.operations, key=lambda o: BUCKETS[o.kind])))


def _by_name(things: Iterable[Any]) -> dict[str, Any]:
    return {x.name: x for x in things}


def _risk(reasons: dict[str, bool]) -> tuple[str, str]:
    """A review for all the reasons that hold, or none."""
    why = "; ".join(text for text, holds in reasons.items() if holds)
    return (REVIEW, why) if why else (SAFE, "")


def _added_column_risk(c: ColumnDef) -> tuple[str, str]:
    return _risk(
        {
            "a generated column is computed for every row": bool(c.generated),
            "the rows must be unique by it": c.primary_key or c.unique,
            "rows that are there have no value for it": not c.nullable and not c.default and not c.generated,
        }
    )


def _altered_column_risk(a: ColumnDef, b: ColumnDef) -> tuple[str, str]:
    return _risk({"values are cast to another type": a.type != b.type, "rows may hold nulls": a.nullable and not b.nullable})


def _column_operations(a: TableDef, b: TableDef) -> Iterable[Operation]:
    old, new = _by_name(a.columns), _by_name(b.columns)
    for c in b.columns:
        before = old.get(c.name)
        if before is None:
            yield Operation("add_column", b.name, c.name, None, c, *_added_column_risk(c))
        elif before != c:
            if (before.primary_key, before.unique) != (c.primary_key, c.unique):
                raise SchemaError(f"column {c.name}: a key can't change in place")
            if before.generated != c.generated:
                raise SchemaError(f"column {c.name}: a generated expression can't change in place")
            yield Operation("alter_column", b.name, c.name, before, c, *_altered_column_risk(before, c))
    for c in a.columns:
        if c.name not in new:
            yield Operation("drop_column", b.name, c.name, c, None, DESTRUCTIVE, "its values are lost")


def _parts(table: str, before: Iterable[Any], after: Iterable[Any], drop: str, add: str, why: str, changed: Callable[[Any, Any], bool] = lambda a, b: a != b) -> Iterable[Operation]:
    """Constraints and indexes: one that changes is dropped and made anew."""
    old, new = _by_name(before), _by_name(after)
    for name in sorted(old.keys() | new.keys()):
        a, b = old.get(name), new.get(name)
        if a is not None and b is not None and not changed(a, b):
            continue
        if a is not None:
            yield Operation(drop, table, name, a, None, REVIEW, "the rule no longer holds")
        if b is not None:
            yield Operation(add, table, name, None, b, REVIEW, why)


def _native_operations(before: Schema, after: Schema) -> Iterable[Operation]:
    if gone := set(before.extensions) - set(after.extensions):
        raise SchemaError(f"extension {min(gone)} can't be removed by comparison")
    for name in sorted(set(after.extensions) - set(before.extensions)):
        yield Operation("create_extension", None, name, None, name, REVIEW, "the platform must offer it")
    old, new = _by_name(before.enums), _by_name(after.enums)
    for name in sorted(old.keys() | new.keys()):
        a, b = old.get(name), new.get(name)
        if a and b and a != b:
            raise SchemaError(f"enum {name}: labels can't change by comparison")
        if b and not a:
            yield Operation("create_enum", None, name, None, b)
        if a and not b:
            used = {name, f"{name}[]", f'"{name}"', f'"{name}"[]'}
            if any(c.type in used for t in after.tables for c in t.columns):
                raise SchemaError(f"enum {name} is still used")
            yield Operation("drop_enum", None, name, a, None, DESTRUCTIVE, "its labels are lost")


def _unique_keys(t: TableDef | None) -> set[tuple[str, ...]]:
    return set(t.unique_keys) if t else set()


def diff(before: Schema, after: Schema) -> Plan:
    """The operations that turn before into after, in the order in which they are carried out."""
    a, b = canonical(before.validate()), canonical(after.validate())
    old, new = _by_name(a.tables), _by_name(b.tables)
    out = list(_native_operations(a, b))

    def moved(table: str, columns: tuple[str, ...]) -> bool:
        """Whether a column that a foreign key uses changes its type."""
        x, y = old.get(table), new.get(table)
        return x is None or y is None or any((p := x.column(c)) is None or (q := y.column(c)) is None or p.type != q.type for c in columns)

    for name in sorted(old.keys() | new.keys()):
        x, y = old.get(name), new.get(name)

        def rekeyed(p, q, name=name):
            return p != q or moved(name, p.columns) or moved(p.table, p.references) or _unique_keys(old.get(p.table)) != _unique_keys(new.get(p.table))

        out += _parts(name, x.foreign_keys if x else (), y.foreign_keys if y else (), "drop_foreign_key", "add_foreign_key", "every row must have its target", rekeyed)
        if x is None:
            out.append(Operation("create_table", name, name, None, replace(y, foreign_keys=())))
        elif y is None:
            out.append(Operation("drop_table", name, name, replace(x, foreign_keys=()), None, DESTRUCTIVE, "its rows are lost"))
        else:
            if (x.primary_key, x.key) != (y.primary_key, y.key):
                raise SchemaError(f"table {name}: the primary key can't change by comparison")
            out += _parts(name, x.indexes, y.indexes, "drop_index", "create_index", "every row is indexed")
            out += _parts(name, x.uniques, y.uniques, "drop_unique", "add_unique", "the rows must be unique by it")
            out += _parts(name, x.checks, y.checks, "drop_check", "add_check", "every row must pass it")
            out += _column_operations(x, y)
    return Plan(tuple(out)).ordered()
