"""Tables, columns and constraints, and the rules that a schema keeps."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from ..plans.table import BuildError, checked_identifier

#: What a foreign key may do when its target goes or moves. Fixed values.
ACTIONS = ("no action", "restrict", "cascade", "set null", "set default")


class SchemaError(BuildError):
    """A schema that breaks a rule."""


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str
    nullable: bool = False
    primary_key: bool = False
    unique: bool = False
    default: str | None = None
    generated: str | None = None


@dataclass(frozen=True)
class PrimaryKey:
    name: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Unique:
    name: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Check:
    name: str
    expression: str


@dataclass(frozen=True)
class Index:
    """On columns or on one expression; where makes it partial, include covers more columns."""

    name: str
    columns: tuple[str, ...] = ()
    expression: str | None = None
    unique: bool = False
    method: str | None = None
    where: str | None = None
    include: tuple[str, ...] = ()


@dataclass(frozen=True)
class ForeignKey:
    name: str
    columns: tuple[str, ...]
    table: str
    references: tuple[str, ...]
    on_delete: str = "no action"
    on_update: str = "no action"
    deferrable: bool = False
    initially_deferred: bool = False


@dataclass(frozen=True)
class TableDef:
    name: str
    columns: tuple[ColumnDef, ...]
    primary_key: PrimaryKey | None = None
    uniques: tuple[Unique, ...] = ()
    checks: tuple[Check, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    indexes: tuple[Index, ...] = ()

    def column(self, name: str) -> ColumnDef | None:
        return next((c for c in self.columns if c.name == name), None)

    @property
    def key(self) -> tuple[str, ...]:
        """Columns of the primary key, however it is declared."""
        return self.primary_key.columns if self.primary_key else tuple(c.name for c in self.columns if c.primary_key)

    @property
    def unique_keys(self) -> list[tuple[str, ...]]:
        """Every list of columns that whole rows are unique by."""
        keys = [self.key] if self.key else []
        keys += [(c.name,) for c in self.columns if c.unique]
        keys += [u.columns for u in self.uniques]
        return keys + [i.columns for i in self.indexes if i.unique and i.columns and not i.where]


@dataclass(frozen=True)
class EnumType:
    name: str
    labels: tuple[str, ...]


@dataclass(frozen=True)
class Schema:
    tables: tuple[TableDef, ...] = ()
    enums: tuple[EnumType, ...] = ()
    extensions: tuple[str, ...] = ()

    def table(self, name: str) -> TableDef | None:
        return next((t for t in self.tables if t.name == name), None)

    def validate(self) -> Schema:
        """This schema, or a SchemaError that names the first rule it breaks."""
        _distinct("extension", self.extensions)
        taken: list[str] = []
        for e in self.enums:
            _named("enum", e.name)
            if not e.labels or any(not x.strip() or "\0" in x for x in e.labels):
                raise SchemaError(f"enum {e.name} needs labels that aren't blank")
            _distinct(f"label of enum {e.name}", e.labels)
            taken.append(e.name)
        for t in self.tables:
            _validate_table(t)
            taken += [t.name, *([t.primary_key.name] if t.primary_key else []), *(u.name for u in t.uniques), *(i.name for i in t.indexes)]
        _distinct("relation name", taken)
        for t in self.tables:
            for f in t.foreign_keys:
                self._validate_reference(t, f)
        return self

    def _validate_reference(self, t: TableDef, f: ForeignKey) -> None:
        target = self.table(f.table)
        if target is None:
            raise SchemaError(f"foreign key {f.name} references an unknown table")
        own, other = [t.column(c) for c in f.columns], [target.column(c) for c in f.references]
        if None in other:
            raise SchemaError(f"foreign key {f.name} references an unknown column")
        if f.references not in target.unique_keys:
            raise SchemaError(f"foreign key {f.name} references columns that are no key, in that order")
        if any(a.type != b.type for a, b in zip(own, other, strict=True)):
            raise SchemaError(f"foreign key {f.name} joins columns of different types")
        for action in (f.on_delete, f.on_update):
            if action == "set null" and not all(c.nullable for c in own):
                raise SchemaError(f"foreign key {f.name} sets null what can't be null")
            if action == "set default" and not all(c.nullable or c.default for c in own):
                raise SchemaError(f"foreign key {f.name} sets a default that isn't there")


def _named(kind: str, name: str) -> None:
    try:
        checked_identifier(kind, name)
    except SchemaError:
        raise
    except BuildError as e:
        raise SchemaError(str(e)) from None


def _distinct(kind: str, names: Iterable[str]) -> None:
    seen: set[str] = set()
    for name in names:
        if name in seen:
            raise SchemaError(f"{kind} {name} comes twice")
        seen.add(name)


def _members(what: str, t: TableDef, columns: tuple[str, ...]) -> None:
    if not columns:
        raise SchemaError(f"{what} has no columns")
    _distinct(f"{what}: column", columns)
    for c in columns:
        if t.column(c) is None:
            raise SchemaError(f"{what} has an unknown column")


def _validate_table(t: TableDef) -> None:
    _named("table", t.name)
    if not t.columns:
        raise SchemaError(f"table {t.name} has no columns")
    _distinct(f"column of {t.name}", (c.name for c in t.columns))
    for c in t.columns:
        _named("column", c.name)
        if not c.type.strip() or "\0" in c.type:
            raise SchemaError(f"column {c.name} has no type")
        if c.generated and c.default:
            raise SchemaError(f"column {c.name} is generated and has a default")
        if c.primary_key and c.nullable:
            raise SchemaError(f"column {c.name} is a primary key and nullable")
    if t.primary_key:
        if any(c.primary_key for c in t.columns):
            raise SchemaError(f"table {t.name} declares its primary key twice")
        _named("primary key", t.primary_key.name)
        _members(f"primary key {t.primary_key.name}", t, t.primary_key.columns)
        if any(t.column(c).nullable for c in t.primary_key.columns):
            raise SchemaError(f"primary key {t.primary_key.name} has a nullable column")
    for u in t.uniques:
        _named("unique", u.name)
        _members(f"unique {u.name}", t, u.columns)
    for c in t.checks:
        _named("check", c.name)
        if not c.expression.strip():
            raise SchemaError(f"check {c.name} is blank")
    for i in t.indexes:
        _named("index", i.name)
        if bool(i.columns) == bool(i.expression):
            raise SchemaError(f"index {i.name} is on columns or on one expression")
        if i.method is not None:
            _named("index method", i.method)
        if i.columns or i.include:
            _members(f"index {i.name}", t, i.columns + i.include)
    for f in t.foreign_keys:
        _named("foreign key", f.name)
        _members(f"foreign key {f.name}", t, f.columns)
        if len(f.columns) != len(f.references):
            raise SchemaError(f"foreign key {f.name} references another number of columns")
        if f.on_delete not in ACTIONS or f.on_update not in ACTIONS:
            raise SchemaError(f"foreign key {f.name} has an unknown action")
        if f.initially_deferred and not f.deferrable:
            raise SchemaError(f"foreign key {f.name} is deferred but not deferrable")
    _distinct(f"check or foreign key of {t.name}", [*(c.name for c in t.checks), *(f.name for f in t.foreign_keys)])
