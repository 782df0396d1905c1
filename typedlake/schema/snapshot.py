"""Canonical JSON of a schema."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass
from typing import Any

from .model import Check, ColumnDef, EnumType, ForeignKey, Index, PrimaryKey, Schema, SchemaError, TableDef, Unique

VERSION = 1
_PARTS = {"uniques": Unique, "checks": Check, "foreign_keys": ForeignKey, "indexes": Index}


def canonical(schema: Schema) -> Schema:
    """The schema with everything but columns in order of name."""
    by_name = lambda xs: tuple(sorted(xs, key=lambda x: x.name))
    tables = tuple(dataclasses.replace(t, **{p: by_name(getattr(t, p)) for p in _PARTS}) for t in by_name(schema.tables))
    return Schema(tables, by_name(schema.enums), tuple(sorted(schema.extensions)))


def _made(kind: type, data: Any) -> Any:
    names = {f.name for f in dataclasses.fields(kind)}
    if not isinstance(data, dict) or set(data) - names:
        raise SchemaError("the snapshot has an unknown field")
    try:
        return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in data.items()})
    except TypeError:
        raise SchemaError("the snapshot lacks a field") from None


@dataclass(frozen=True)
class Snapshot:
    """A validated schema in canonical order."""

    schema: Schema = Schema()

    def __post_init__(self) -> None:
        object.__setattr__(self, "schema", canonical(self.schema.validate()))

    def marshal(self) -> str:
        return json.dumps({"version": VERSION, "schema": dataclasses.asdict(self.schema)}, indent=2, ensure_ascii=False) + "\n"

    @classmethod
    def parse(cls, text: str) -> Snapshot:
        """Read back what marshal wrote; unknown fields, more values and other versions are errors."""
        try:
            data = json.loads(text)
        except ValueError:
            raise SchemaError("the snapshot is not one JSON value") from None
        if not isinstance(data, dict) or set(data) != {"version", "schema"} or data["version"] != VERSION or not isinstance(data["schema"], dict):
            raise SchemaError(f"the snapshot is not of version {VERSION}")
        body = data["schema"]
        if set(body) - {"tables", "enums", "extensions"}:
            raise SchemaError("the snapshot has an unknown field")
        tables = []
        for t in body.get("tables", []):
            t = dict(t)
            t["columns"] = [_made(ColumnDef, c) for c in t.get("columns", [])]
            t["primary_key"] = _made(PrimaryKey, t["primary_key"]) if t.get("primary_key") else None
            for part, kind in _PARTS.items():
                t[part] = [_made(kind, x) for x in t.get(part, [])]
            tables.append(_made(TableDef, t))
        return cls(Schema(tuple(tables), tuple(_made(EnumType, e) for e in body.get("enums", [])), tuple(body.get("extensions", []))))
