"""Schemas from dataclasses: field types and tags become columns."""

from __future__ import annotations

import dataclasses
import datetime as dt
import re
import types
import typing
from collections.abc import Callable
from typing import Any

from .model import ColumnDef, Schema, SchemaError, TableDef

#: SQL types of Python types. Fixed values.
SQL_TYPES = {str: "text", bool: "boolean", int: "bigint", float: "double precision", bytes: "bytea", dt.datetime: "timestamptz", dt.date: "date", dict: "jsonb"}
#: Options of a tag. Fixed values.
OPTIONS = frozenset("column type default generated primaryKey unique notNull nullable readOnly insertOnly updateOnly".split())


def snake_case(name: str) -> str:
    """UserID becomes user_id and HTTPServer http_server."""
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()


def parse_tag(tag: str) -> dict[str, str]:
    """Options of a tag, as in 'type:varchar(20);unique'; flags are 'true'."""
    out: dict[str, str] = {}
    for part in filter(None, (p.strip() for p in tag.split(";"))):
        name, colon, value = part.partition(":")
        if name not in OPTIONS:
            raise SchemaError(f"tag option {name} is unknown")
        if name in out:
            raise SchemaError(f"tag option {name} comes twice")
        if colon and not value:
            raise SchemaError(f"tag option {name} is empty")
        out[name] = value if colon else "true"
    for a, b in (("notNull", "nullable"), ("default", "generated")):
        if a in out and b in out:
            raise SchemaError(f"tag options {a} and {b} exclude each other")
    return out


def sql_type(hint: Any) -> tuple[str, bool]:
    """The SQL type of a type hint, and whether it is nullable (T | None)."""
    if typing.get_origin(hint) in (typing.Union, types.UnionType):
        inner = [a for a in typing.get_args(hint) if a is not type(None)]
        if len(inner) == 1 and len(typing.get_args(hint)) == 2:
            return sql_type(inner[0])[0], True
    if typing.get_origin(hint) is list:
        (item,) = typing.get_args(hint)
        if item in SQL_TYPES:
            return SQL_TYPES[item] + "[]", False
    if typing.get_origin(hint) is dict and typing.get_args(hint)[0] is str:
        return "jsonb", False
    if hint in SQL_TYPES:
        return SQL_TYPES[hint], False
    raise SchemaError("a field's type has no SQL type; give one in its tag")


def _column(field: dataclasses.Field, hint: Any) -> ColumnDef | None:
    tag = field.metadata.get("sql", "")
    if tag == "-":
        return None
    options = parse_tag(tag)
    on = lambda name: options.get(name) == "true"
    try:
        inferred, optional = sql_type(hint)
    except SchemaError:
        if "type" not in options:
            raise
        inferred, optional = "", type(None) in typing.get_args(hint)
    return ColumnDef(
        options.get("column", snake_case(field.name)),
        options.get("type", inferred),
        (optional or on("nullable")) and not on("notNull") and not on("primaryKey"),
        on("primaryKey"),
        on("unique"),
        options.get("default"),
        options.get("generated"),
    )


def table_of(entity: type) -> TableDef:
    """The table of a dataclass: __table__ or the class name in snake case; a configure(table) method may add to it."""
    if not dataclasses.is_dataclass(entity):
        raise SchemaError(f"{entity.__name__} is no dataclass")
    hints = typing.get_type_hints(entity)
    columns = tuple(c for f in dataclasses.fields(entity) if (c := _column(f, hints[f.name])))
    table = TableDef(getattr(entity, "__table__", snake_case(entity.__name__)), columns)
    configure: Callable[[TableDef], TableDef] | None = getattr(entity, "configure", None)
    if not configure:
        return table
    try:
        configured = configure(table)
    except Exception as e:
        raise SchemaError(f"configure of {entity.__name__} failed: {e}") from e
    fields = {f.name: c.name for f in dataclasses.fields(entity) if (c := _column(f, hints[f.name]))}
    return resolved(configured, fields)


def resolved(table: TableDef, fields: dict[str, str]) -> TableDef:
    """The table with the entity's field names in its keys, constraints and indexes turned into column names."""

    def columns(names: tuple[str, ...]) -> tuple[str, ...]:
        out = tuple(n if table.column(n) else fields.get(n, n) for n in (x.strip() for x in names))
        for n in out:
            if not table.column(n):
                raise SchemaError(f"table {table.name} has no field or column {n}")
        return out

    own = lambda things: tuple(dataclasses.replace(x, columns=columns(x.columns)) for x in things)
    return dataclasses.replace(
        table,
        primary_key=dataclasses.replace(table.primary_key, columns=columns(table.primary_key.columns)) if table.primary_key else None,
        uniques=own(table.uniques),
        foreign_keys=own(table.foreign_keys),
        indexes=tuple(dataclasses.replace(i, columns=columns(i.columns), include=columns(i.include)) for i in table.indexes),
    )


def parse(*entities: type, schema: Schema = Schema()) -> Schema:
    """A validated schema of the entities' tables, beside the enums and extensions of schema."""
    if not entities:
        raise SchemaError("there are no entities")
    return dataclasses.replace(schema, tables=schema.tables + tuple(table_of(e) for e in entities)).validate()
