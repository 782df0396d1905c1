"""Schemas and plans as DDL text for review."""

from __future__ import annotations

from ..plans.text import quoted
from .diff import BUCKETS, Operation, Plan
from .model import Check, ColumnDef, EnumType, ForeignKey, Index, Schema, TableDef, Unique
from .rename import Rename


def _list(names: tuple[str, ...]) -> str:
    return ", ".join(map(quoted, names))


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def column_text(c: ColumnDef, inline_key: bool = True) -> str:
    parts = [quoted(c.name), c.type]
    parts += ["NOT NULL"] if not c.nullable else []
    parts += [f"GENERATED ALWAYS AS ({c.generated}) STORED"] if c.generated else [f"DEFAULT {c.default}"] if c.default else []
    parts += ["UNIQUE"] if c.unique else []
    parts += ["PRIMARY KEY"] if c.primary_key and inline_key else []
    return " ".join(parts)


def index_text(table: str, i: Index) -> str:
    method = f" USING {quoted(i.method)}" if i.method else ""
    on = _list(i.columns) if i.columns else f"({i.expression})"
    include = f" INCLUDE ({_list(i.include)})" if i.include else ""
    where = f" WHERE {i.where}" if i.where else ""
    return f"CREATE {'UNIQUE ' if i.unique else ''}INDEX {quoted(i.name)} ON {quoted(table)}{method} ({on}){include}{where};"


def table_text(t: TableDef) -> str:
    inline = sum(c.primary_key for c in t.columns) == 1
    lines = [column_text(c, inline) for c in t.columns]
    if t.primary_key:
        lines.append(f"CONSTRAINT {quoted(t.primary_key.name)} PRIMARY KEY ({_list(t.primary_key.columns)})")
    elif t.key and not inline:
        lines.append(f"PRIMARY KEY ({_list(t.key)})")
    lines += [f"CONSTRAINT {quoted(u.name)} UNIQUE ({_list(u.columns)})" for u in t.uniques]
    lines += [f"CONSTRAINT {quoted(c.name)} CHECK ({c.expression})" for c in t.checks]
    body = ",\n".join(f"    {line}" for line in lines)
    return "\n".join([f"CREATE TABLE {quoted(t.name)} (\n{body}\n);", *(index_text(t.name, i) for i in t.indexes)])


def enum_text(e: EnumType) -> str:
    return f"CREATE TYPE {quoted(e.name)} AS ENUM ({', '.join(map(_text, e.labels))});"


def foreign_key_text(table: str, f: ForeignKey) -> str:
    out = f"ALTER TABLE {quoted(table)} ADD CONSTRAINT {quoted(f.name)} FOREIGN KEY ({_list(f.columns)}) REFERENCES {quoted(f.table)} ({_list(f.references)})"
    out += "".join(f" ON {when} {action.upper()}" for when, action in (("DELETE", f.on_delete), ("UPDATE", f.on_update)) if action != "no action")
    out += " DEFERRABLE" + " INITIALLY DEFERRED" * f.initially_deferred if f.deferrable else ""
    return out + ";"


def create_text(schema: Schema) -> str:
    """Everything of a schema: extensions, enums, tables, and foreign keys once all tables are there."""
    s = schema.validate()
    blocks = [f"CREATE EXTENSION IF NOT EXISTS {quoted(e)};" for e in s.extensions]
    blocks += [enum_text(e) for e in s.enums] + [table_text(t) for t in s.tables]
    blocks += [foreign_key_text(t.name, f) for t in s.tables for f in t.foreign_keys]
    return "\n\n".join(blocks) + "\n"


def _altered(table: str, a: ColumnDef, b: ColumnDef) -> str:
    at = f"ALTER TABLE {quoted(table)} ALTER COLUMN {quoted(b.name)}"
    out = []
    if a.type != b.type:
        out.append(f"{at} TYPE {b.type};")
    if a.nullable != b.nullable:
        out.append(f"{at} {'DROP' if b.nullable else 'SET'} NOT NULL;")
    if a.default != b.default:
        out.append(f"{at} SET DEFAULT {b.default};" if b.default else f"{at} DROP DEFAULT;")
    return "\n".join(out)


def _renamed(r: Rename) -> str:
    if r.kind in ("table", "index", "enum"):
        return f"ALTER {'TYPE' if r.kind == 'enum' else r.kind.upper()} {quoted(r.name)} RENAME TO {quoted(r.to)};"
    return f"ALTER TABLE {quoted(r.table)} RENAME {r.kind.upper()} {quoted(r.name)} TO {quoted(r.to)};"


def _made(table: str | None, thing: object) -> str:
    match thing:
        case TableDef():
            return table_text(thing)
        case EnumType():
            return enum_text(thing)
        case Index():
            return index_text(table, thing)
        case ForeignKey():
            return foreign_key_text(table, thing)
        case ColumnDef():
            return f"ALTER TABLE {quoted(table)} ADD COLUMN {column_text(thing)};"
        case Unique():
            return f"ALTER TABLE {quoted(table)} ADD CONSTRAINT {quoted(thing.name)} UNIQUE ({_list(thing.columns)});"
        case Check():
            return f"ALTER TABLE {quoted(table)} ADD CONSTRAINT {quoted(thing.name)} CHECK ({thing.expression});"
    return f"CREATE EXTENSION IF NOT EXISTS {quoted(thing)};"


def _dropped(table: str | None, thing: object) -> str:
    match thing:
        case TableDef():
            return f"DROP TABLE {quoted(thing.name)};"
        case EnumType():
            return f"DROP TYPE {quoted(thing.name)};"
        case Index():
            return f"DROP INDEX {quoted(thing.name)};"
        case ColumnDef():
            return f"ALTER TABLE {quoted(table)} DROP COLUMN {quoted(thing.name)};"
        case ForeignKey() | Unique() | Check():
            return f"ALTER TABLE {quoted(table)} DROP CONSTRAINT {quoted(thing.name)};"
    return f"-- extension {quoted(thing)} is kept"


def operation_text(o: Operation, reverse: bool = False) -> str:
    before, after = (o.after, o.before) if reverse else (o.before, o.after)
    if o.kind == "rename_object":
        return _renamed(before)
    if o.kind == "alter_column":
        return _altered(o.table, before, after)
    return _dropped(o.table, before) if after is None else _made(o.table, after)


def migration_text(plan: Plan) -> tuple[str, str]:
    """The plan forwards, and backwards in exactly the reverse order."""
    ops = sorted(plan.operations, key=lambda o: BUCKETS[o.kind])
    return tuple("\n\n".join(filter(None, (operation_text(o, back) for o in (reversed(ops) if back else ops)))) + "\n" for back in (False, True))
