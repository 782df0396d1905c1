"""INSERT, UPSERT, UPDATE and DELETE as rewrites: from a table's rows to its new rows and the rows returned."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..plans.statements import Assignment, Delete, Insert, Update
from ..plans.table import BuildError, Table
from . import constraints
from .read import MultipleRows, NoRows, condition, literal, named
from .scratch import settled

PROPOSED = "excluded"


@dataclass(frozen=True)
class Rewrite:
    """New rows of the table, and the rows that the statement touched (RETURNING, in _place order for inserts)."""

    state: DataFrame
    returning: DataFrame


@dataclass(frozen=True)
class Reference:
    """A foreign key; a deferred one is checked at the end of a batch."""

    columns: tuple[str, ...]
    table: str
    references: tuple[str, ...]
    on_delete: str = "no action"
    on_update: str = "no action"
    deferred: bool = False


@dataclass(frozen=True)
class Keys:
    """What a write must know of a table.

    Its unique keys, defaults as trusted SQL by column, columns that take no
    null, checks as trusted SQL by name, and foreign keys.
    """

    unique: tuple[tuple[str, ...], ...] = ()
    defaults: dict[str, str] = field(default_factory=dict)
    not_null: tuple[str, ...] = ()
    checks: dict[str, str] = field(default_factory=dict)
    foreign: tuple[Reference, ...] = ()


def _holds(df_condition) -> SparkColumn:
    """True where the condition is true; unknown counts as false."""
    return F.coalesce(condition(df_condition), F.lit(False)) if df_condition else F.lit(True)


def _value(a: Assignment) -> SparkColumn:
    return literal(a.column, a.value) if a.kind == "value" else F.expr(str(a.value)).cast(a.column.dtype)


def proposed(spark: SparkSession, schema: StructType, statement: Insert, defaults: dict[str, str]) -> DataFrame:
    """The rows that an INSERT proposes, numbered by _place; columns not assigned take their default or null."""
    statement.checked()
    one = spark.range(1)
    frames = []
    for place, row in enumerate(statement.rows):
        given = {a.column.name: _value(a) for a in row}
        values = [given.get(f.name, F.expr(defaults[f.name]) if f.name in defaults else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
        frames.append(one.select(*values, F.lit(place).cast("long").alias("_place")))
    while len(frames) > 1:  # a balanced union
        frames = [frames[k].unionByName(frames[k + 1]) if k + 1 < len(frames) else frames[k] for k in range(0, len(frames), 2)]
    return frames[0]


def _whole(key: tuple[str, ...]) -> SparkColumn:
    return reduce(lambda a, b: a & b, [named(k).isNotNull() for k in key])


def _turn(key: tuple[str, ...]) -> SparkColumn:
    """A row's turn among those of its key, in _place order; rows with a null in the key never conflict."""
    return F.when(_whole(key), F.row_number().over(Window.partitionBy(*[named(k) for k in key]).orderBy("_place"))).otherwise(1)


def _absent(rows: DataFrame, others: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """The rows whose key others don't have."""
    return rows.join(constraints.taken(rows, others, key), list(key), "left_anti").select(*rows.columns)


def free_rows(rows: DataFrame, old: DataFrame, unique: tuple[tuple[str, ...], ...]) -> DataFrame:
    """The rows that go in when they come one after the other and each that conflicts on any key is passed over.

    With one key that is the first row of each. With several, rows that are
    first by all their keys go in, rows that conflict with those go out, and
    so on with what is left; the rounds run as the statement is planned.
    _place tells all rows apart.
    """
    for key in unique:
        rows = _absent(rows, old, key)
    if len(unique) == 1:
        return rows.withColumn("_turn", _turn(unique[0])).where("_turn = 1").drop("_turn")
    kept, left = None, settled(rows)
    while kept is None or not left.isEmpty():
        turns = left.withColumns({f"_turn{i}": _turn(key) for i, key in enumerate(unique)})
        first = settled(turns.where(" AND ".join(f"_turn{i} = 1" for i in range(len(unique)))).select(*rows.columns))
        if first.isEmpty() and not left.isEmpty():
            raise BuildError("rows of an INSERT have the same place")
        kept = first if kept is None else kept.unionByName(first)
        left = left.join(first.select("_place"), "_place", "left_anti").select(*rows.columns)
        for key in unique:
            left = _absent(left, first, key)
        left = settled(left)
    return kept


def _only_once(rows: DataFrame, key: tuple[str, ...], message: str) -> DataFrame:
    return constraints.refused(rows, constraints.unique_violations(rows, key), message)


def upsert(old: DataFrame, incoming: DataFrame, key: tuple[str, ...], updates: tuple[Assignment, ...], small: bool = False) -> Rewrite:
    """INSERT ... ON CONFLICT (key) DO UPDATE: rows of a known key are changed, the others added.

    Two incoming rows of one key fail the query, as one statement may not
    touch a row twice. EXCLUDED names the incoming row in trusted text. One
    full join of both tables makes the new state; small rows are sent to the
    table instead, which then isn't shuffled.
    """
    once = _only_once(incoming, key, "ON CONFLICT DO UPDATE touches a row twice")
    left, right = old.withColumn("_old", F.lit(True)).alias("t"), once.withColumn("_in", F.lit(True)).alias(PROPOSED)
    on = reduce(lambda a, b: a & b, [F.col(f"t.`{k}`") == F.col(f"{PROPOSED}.`{k}`") for k in key])
    sets = {a.column.name: F.col(f"{PROPOSED}.`{a.column.name}`") if a.kind == "excluded" else _value(a) for a in updates}
    joined = left.join(right, on, "left" if small else "full_outer")
    known, given = F.col("t._old").isNotNull(), F.col(f"{PROPOSED}._in").isNotNull()
    new = lambda c: F.when(known & given, sets.get(c, F.col(f"t.`{c}`"))).when(given, F.col(f"{PROPOSED}.`{c}`")).otherwise(F.col(f"t.`{c}`")).alias(c)
    state = joined.select(*[new(c) for c in old.columns])
    touched = joined.where(given).select(*[new(c) for c in old.columns], F.col(f"{PROPOSED}._place").alias("_place"))
    if small:
        fresh = _absent(once, old, key)
        state, touched = state.unionByName(fresh.drop("_place")), touched.unionByName(fresh)
    return Rewrite(state, touched)


def guarded(done: Rewrite, others: DataFrame | None, keys: Keys, parents: Mapping[str, DataFrame], table: str, changed: set[str] | None = None) -> Rewrite:
    """The rewrite, in a query that fails where a row that was touched breaks a rule of the table.

    others: the rows beside the touched ones, for unique keys. changed: the
    columns that got new values, None for all; rules over others are not checked again.
    """
    rows, state = done.returning, done.state
    fresh = lambda columns: changed is None or changed & set(columns)
    bad: list[tuple[DataFrame, str]] = []
    if nulls := [c for c in keys.not_null if fresh([c])]:
        bad.append((rows.where(~_whole(tuple(nulls))), "a column of the table takes no null"))
    bad += [(constraints.check_violations(rows, text), f"check {name} is broken") for name, text in keys.checks.items()]
    for key in keys.unique if others is not None else ():
        if fresh(key):
            bad += [(constraints.unique_violations(rows, key), "a unique key comes twice"), (constraints.taken(rows, others, key), "a unique key is taken")]
    for r in keys.foreign:
        if fresh(r.columns) and not r.deferred:
            parent = state if r.table == table else parents.get(r.table)
            if parent is not None:
                bad.append((constraints.orphans(rows, parent, r.columns, r.references), "a foreign key has no target"))
    for frame, message in bad:
        state, rows = constraints.refused(state, frame, message), constraints.refused(rows, frame, message)
    return Rewrite(state, rows)


def insert(old: DataFrame, statement: Insert, keys: Keys = Keys(), incoming: DataFrame | None = None, parents: Mapping[str, DataFrame] = {}) -> Rewrite:
    """Add the statement's rows, or those of incoming (with _place) under its conflict clause."""
    rows = proposed(old.sparkSession, old.schema, statement, keys.defaults) if incoming is None else incoming
    rows = rows.select(*old.columns, "_place")
    name = statement.table.name
    if statement.target is None:
        return guarded(Rewrite(old.unionByName(rows.drop("_place")), rows), old, keys, parents, name)
    key = tuple(c.name for c in statement.target)
    if key and keys.unique and key not in keys.unique:
        raise BuildError("ON CONFLICT names no unique key")
    if statement.action == "update":
        done = upsert(old, rows, key, statement.updates, small=incoming is None)
        others = [k for k in keys.unique if k != key]
        rest = _absent(old, rows, key) if others else None
        return guarded(done, rest, Keys(tuple(others), {}, keys.not_null, keys.checks, keys.foreign), parents, name)
    if not key and not keys.unique:
        raise BuildError("the table has no unique key to conflict with")
    rows = free_rows(rows, old, (key,) if key else keys.unique)
    return guarded(Rewrite(old.unionByName(rows.drop("_place")), rows), old if key and len(keys.unique) > 1 else None, keys, parents, name)


def update(old: DataFrame, statement: Update, keys: Keys = Keys(), parents: Mapping[str, DataFrame] = {}) -> Rewrite:
    """Change the rows for which the condition is true; all right-hand sides see the old values."""
    s = statement.checked()
    hit = _holds(s.condition)
    new = {a.column.name: _value(a) for a in s.assignments}
    state = old.select(*[F.when(hit, new[c]).otherwise(named(c)).alias(c) if c in new else named(c) for c in old.columns])
    done = Rewrite(state, old.where(hit).select(*[new.get(c, named(c)).alias(c) for c in old.columns]))
    return guarded(done, old.where(~hit), keys, parents, statement.table.name, set(new))


def delete(old: DataFrame, statement: Delete) -> Rewrite:
    """Remove the rows for which the condition is true; unknown keeps a row."""
    hit = _holds(statement.checked().condition)
    return Rewrite(old.where(~hit), old.where(hit))


def apply(old: DataFrame, statement: Insert | Update | Delete, keys: Keys = Keys(), incoming: DataFrame | None = None, parents: Mapping[str, DataFrame] = {}) -> Rewrite:
    match statement:
        case Insert():
            return insert(old, statement, keys, incoming, parents)
        case Update():
            return update(old, statement, keys, parents)
    return delete(old, statement)


def affected(done: Rewrite) -> int:
    """How many rows the statement inserted, changed or removed."""
    return done.returning.count()


def returned_all(done: Rewrite, table: Table) -> list[Any]:
    """The rows touched as objects, an insert's in the order of its rows."""
    rows = done.returning.orderBy("_place") if "_place" in done.returning.columns else done.returning
    return [table.scan(r) for r in rows.select(*[named(n) for n in table.names]).collect()]


def returned_one(done: Rewrite, table: Table) -> Any:
    """The one row touched; none or more are errors. The old workspace is there to go back to."""
    rows = done.returning.select(*[named(n) for n in table.names]).limit(2).collect()
    if not rows:
        raise NoRows("the statement touched no row")
    if len(rows) > 1:
        raise MultipleRows("the statement touched more than one row")
    return table.scan(rows[0])
