"""A plan carried out on frames: each table's new rows, checked before they are handed over."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import constraints, evolve
from .diff import BUCKETS, Plan
from .model import ColumnDef, EnumType, SchemaError, TableDef

#: Spark types of SQL types. Fixed values.
SPARK_TYPES = {"text": "string", "uuid": "string", "jsonb": "string", "json": "string", "boolean": "boolean", "smallint": "smallint", "integer": "int", "int": "int", "bigint": "bigint", "real": "float", "double precision": "double", "bytea": "binary", "timestamptz": "timestamp", "timestamp": "timestamp_ntz", "date": "date"}


def spark_type(sql: str) -> str:
    """The Spark type of a SQL type; enums and other names are strings."""
    sql = sql.strip().lower()
    if sql.endswith("[]"):
        return f"array<{spark_type(sql[:-2])}>"
    if m := re.fullmatch(r"(?:numeric|decimal)\((\d+)(?:, *(\d+))?\)", sql):
        return f"decimal({m[1]},{m[2] or 0})"
    if m := re.fullmatch(r"(varchar|char)\((\d+)\)", sql):
        return "string"
    return SPARK_TYPES.get(sql, "string")


def _narrowed(df: DataFrame, c: ColumnDef, enums: Mapping[str, EnumType]) -> None:
    """Check what a Spark type alone doesn't: the length of varchar(n) and char(n), and the labels of an enum."""
    name = c.type.strip().strip('"')
    if m := re.fullmatch(r"(?:varchar|char)\((\d+)\)", name.lower()):
        _fails(df.where(F.length(F.col(f"`{c.name}`").cast("string")) > int(m[1])), f"the length of column {c.name}")
    elif name in enums:
        _fails(df.where(~F.col(f"`{c.name}`").cast("string").isin(*enums[name].labels)), f"enum {name} in column {c.name}")


def empty_table(spark: SparkSession, t: TableDef) -> DataFrame:
    return spark.createDataFrame([], ", ".join(f"`{c.name}` {spark_type(c.type)}" for c in t.columns))


def _fails(rows: DataFrame, what: str) -> None:
    if not rows.isEmpty():
        raise SchemaError(f"{what} is broken by rows of the table")


def _with_column(df: DataFrame, c: ColumnDef) -> DataFrame:
    out = evolve.add_column(df, c.name, spark_type(c.type), c.default, c.generated)
    if not c.nullable and not c.default and not c.generated and not df.isEmpty():
        raise SchemaError(f"column {c.name} is not null and has no default")
    return out


def apply_plan(spark: SparkSession, frames: Mapping[str, DataFrame], plan: Plan, reverse: bool = False, enums: tuple[EnumType, ...] = ()) -> dict[str, DataFrame]:
    """The tables after the plan, or after undoing it in exactly the reverse order.

    Constraints are checked as they are added, and so are lengths and labels
    where a column's type changes; frames stay as they were. enums: those that
    are there already. Undoing the drop of a column or a table brings it back without its values.
    """
    out = dict(frames)
    operations = sorted(plan.validate().operations, key=lambda o: BUCKETS[o.kind])
    known = {e.name: e for e in (*enums, *(x for o in operations for x in (o.before, o.after) if isinstance(x, EnumType)))}
    for o in reversed(operations) if reverse else operations:
        before, after = (o.after, o.before) if reverse else (o.before, o.after)
        if o.kind == "rename_object":
            r = before
            if r.kind == "table":
                out[r.to] = out.pop(r.name)
            elif r.kind == "column":
                out[r.table] = evolve.rename_column(out[r.table], r.name, r.to)
        elif isinstance(after or before, TableDef):
            if after is None:
                out.pop(before.name)
            else:
                out[after.name] = empty_table(spark, after)
        elif o.kind == "alter_column":
            if before.type != after.type:
                _narrowed(out[o.table], after, known)
                out[o.table] = evolve.alter_type(out[o.table], after.name, spark_type(after.type))
            if before.nullable and not after.nullable:
                _fails(out[o.table].where(f"`{after.name}` IS NULL"), f"NOT NULL of column {after.name}")
        elif isinstance(after or before, ColumnDef):
            out[o.table] = evolve.drop_column(out[o.table], before.name) if after is None else _with_column(out[o.table], after)
        elif after is not None and o.table and not isinstance(after, EnumType):
            df = out[o.table]
            if o.kind.endswith("check"):
                _fails(constraints.check_violations(df, after.expression), f"check {o.name}")
            elif o.kind.endswith("unique") or (o.kind.endswith("index") and after.unique):
                keyed = df.selectExpr("*", f"({after.expression}) AS _key") if getattr(after, "expression", None) else df
                _fails(constraints.unique_violations(keyed, list(after.columns) or ["_key"], getattr(after, "where", None)), f"unique {o.name}")
            elif o.kind.endswith("foreign_key"):
                _fails(constraints.orphans(df, out[after.table], after.columns, after.references), f"foreign key {o.name}")
    return out
