"""Schemas as values: declared, validated, compared, rendered, and applied to frames."""

from .ddl import create_text, migration_text
from .diff import Operation, Plan, diff
from .entity import parse
from .model import Check, ColumnDef, EnumType, ForeignKey, Index, PrimaryKey, Schema, SchemaError, TableDef, Unique
from .rename import Rename, diff_with_renames
from .snapshot import Snapshot

__all__ = ["Check", "ColumnDef", "EnumType", "ForeignKey", "Index", "Operation", "Plan", "PrimaryKey", "Rename", "Schema", "SchemaError", "Snapshot", "TableDef", "Unique", "diff", "diff_with_renames", "migration_of", "schema_text", "snapshot_of"]


def schema_text(*entities: type, schema: Schema = Schema()) -> str:
    """The DDL text of these dataclasses' schema."""
    return create_text(parse(*entities, schema=schema))


def snapshot_of(*entities: type, schema: Schema = Schema()) -> Snapshot:
    """The snapshot of these dataclasses' schema."""
    return Snapshot(parse(*entities, schema=schema))


def migration_of(before: Snapshot, *entities: type, schema: Schema = Schema(), renames: list[Rename] | None = None) -> tuple[Plan, str, str]:
    """The plan from a snapshot to these dataclasses' schema, with its text both ways."""
    plan = diff_with_renames(before.schema, parse(*entities, schema=schema), renames or [])
    return (plan, *migration_text(plan))
