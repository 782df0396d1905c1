"""Tables read from parquet, changed together as frames, and published as new parquet folders."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import constraints, mutation, read
from ..operators.mutation import Keys, Reference, Rewrite
from ..plans.select import Select
from ..plans.statements import Delete, Insert, Update
from ..plans.table import BuildError, Table, TrustedSQL


def load(spark: SparkSession, path: str, table: Table) -> DataFrame:
    """The table's declared columns from a parquet folder; other columns are not read."""
    return spark.read.parquet(path).select(*[f"`{n}`" for n in table.names])


def publish(df: DataFrame, folder: str) -> str:
    """Write the rows as a new parquet folder below this one and return its path; nothing is overwritten."""
    path = f"{folder.rstrip('/')}/{uuid4().hex}"
    df.write.parquet(path)
    return path


@dataclass(frozen=True)
class Raw:
    """A table's new rows as trusted SELECT text; {name} stands for a table of the workspace, :name for a value."""

    table: str
    text: TrustedSQL
    args: Mapping[str, object] = field(default_factory=dict)


@dataclass(frozen=True)
class Batch:
    """Statements to be run together, in order. An immutable list; len() counts them."""

    statements: tuple[Insert | Update | Delete | Raw, ...] = ()

    def queue(self, *statements: Insert | Update | Delete) -> Batch:
        for s in statements:
            if s.returns:
                raise BuildError("a batch takes no statement with RETURNING")
            s.checked()
        return Batch((*self.statements, *statements))

    def queue_raw(self, table: str, text: TrustedSQL, **args: object) -> Batch:
        if not isinstance(text, TrustedSQL):
            raise BuildError("a raw statement must be trusted")
        return Batch((*self.statements, Raw(table, text, args)))

    def __len__(self) -> int:
        return len(self.statements)


@dataclass(frozen=True)
class Workspace:
    """Frames of several tables at one moment. Statements give a new workspace; the old one stays as it was.

    A transaction is a chain of statements whose last workspace is kept, or
    not. Writes keep the rules in keys: a frame whose rules are broken fails
    the query that asks for it or publishes it. Nothing else runs until rows
    are asked for or published, but for an INSERT under ON CONFLICT of several keys.
    """

    frames: Mapping[str, DataFrame]
    keys: Mapping[str, Keys] = field(default_factory=dict)

    def _known(self, name: str) -> DataFrame:
        if name not in self.frames:
            raise BuildError("the workspace has no such table")
        return self.frames[name]

    def run(self, statement: Insert | Update | Delete | Raw, incoming: DataFrame | None = None) -> tuple[Workspace, Rewrite]:
        """The workspace after the statement, and what it rewrote.

        incoming, for an INSERT, takes the place of its rows: a frame of the table's columns and _place.
        """
        if isinstance(statement, Raw):
            rows = self.query(statement.text, **statement.args).select(*self._known(statement.table).columns)
            return replace(self, frames={**self.frames, statement.table: rows}), Rewrite(rows, rows.limit(0))
        name = statement.table.name
        old = self._known(name)
        done = mutation.apply(old, statement, self.keys.get(name, Keys()), incoming, self.frames)
        frames = {**self.frames, name: done.state}
        if isinstance(statement, Delete):
            frames = self._after_delete(frames, name, old.where(mutation._holds(statement.condition)))
        elif isinstance(statement, Update):
            frames = self._after_update(frames, name, old, statement)
        return replace(self, frames=frames), done

    def _children(self, name: str) -> list[tuple[str, Reference]]:
        return [(child, r) for child, keys in self.keys.items() for r in keys.foreign if r.table == name and child in self.frames]

    def _after_delete(self, frames: Mapping[str, DataFrame], name: str, gone: DataFrame, depth: int = 0) -> dict[str, DataFrame]:
        """What the foreign keys of other tables do when these rows go."""
        frames = dict(frames)
        if depth > len(self.frames):
            raise BuildError("cascades run in a circle")
        for child, r in self._children(name):
            rows = frames[child]
            hit = constraints.restricted(rows, gone, r.columns, r.references)
            if r.on_delete == "cascade":
                frames[child] = constraints.cascade(rows, gone, r.columns, r.references)
                frames = self._after_delete(frames, child, hit, depth + 1)
            elif r.on_delete in ("set null", "set default"):
                defaults = self.keys[child].defaults if r.on_delete == "set default" else None
                frames[child] = constraints.set_on_delete(rows, gone, r.columns, r.references, defaults)
            elif not r.deferred or r.on_delete == "restrict":
                frames[name] = constraints.refused(frames[name], hit, "rows of another table refer to a deleted row")
        return frames

    def _after_update(self, frames: Mapping[str, DataFrame], name: str, old: DataFrame, statement: Update) -> dict[str, DataFrame]:
        """What the foreign keys of other tables do when the keys they refer to change."""
        frames = dict(frames)
        new = {a.column.name: mutation._value(a) for a in statement.assignments}
        for child, r in self._children(name):
            if not set(r.references) & set(new):
                continue
            pairs = old.where(mutation._holds(statement.condition)).select(*[read.named(c).alias(f"old_{k}") for c, k in zip(r.references, r.columns)], *[new.get(c, read.named(c)).alias(f"new_{k}") for c, k in zip(r.references, r.columns)])
            moved = pairs.where(" OR ".join(f"NOT (`old_{k}` <=> `new_{k}`)" for k in r.columns))
            gone = moved.select(*[F.col(f"`old_{k}`").alias(c) for c, k in zip(r.references, r.columns)])
            if r.on_update == "cascade":
                frames[child] = constraints.cascade_update(frames[child], moved, r.columns)
            elif r.on_update in ("set null", "set default"):
                defaults = self.keys[child].defaults if r.on_update == "set default" else None
                frames[child] = constraints.set_on_delete(frames[child], gone, r.columns, r.references, defaults)
            elif not r.deferred or r.on_update == "restrict":
                frames[name] = constraints.refused(frames[name], constraints.restricted(frames[child], gone, r.columns, r.references), "rows of another table refer to a changed key")
        return frames

    def query(self, text: TrustedSQL, **args: object) -> DataFrame:
        """Trusted SELECT text over the workspace's frames: {name} stands for a table, :name for a value."""
        if not isinstance(text, TrustedSQL):
            raise BuildError("raw text must be trusted")
        if not self.frames:
            raise BuildError("the workspace has no tables")
        spark = next(iter(self.frames.values())).sparkSession
        used = {name: df for name, df in self.frames.items() if f"{{{name}}}" in str(text)}
        return spark.sql(str(text), args=args or None, **used)

    def batch(self, *statements: Insert | Update | Delete | Raw | Batch) -> Workspace:
        """All statements in order, each seeing the ones before; any error leaves this workspace as it was.

        Deferred foreign keys are checked on the tables as they are at the end.
        """
        every = [s for x in statements for s in (x.statements if isinstance(x, Batch) else (x,))]
        if any(not isinstance(s, Raw) and s.returns for s in every):
            raise BuildError("a batch takes no statement with RETURNING")
        out = self
        for s in every:
            out, _ = out.run(s)
        frames = dict(out.frames)
        for child, keys in self.keys.items():
            for r in keys.foreign:
                touched = child in frames and r.table in frames and (frames[child] is not self.frames[child] or frames[r.table] is not self.frames[r.table])
                if r.deferred and touched:
                    frames[child] = constraints.refused(frames[child], constraints.orphans(out.frames[child], out.frames[r.table], r.columns, r.references), "a foreign key has no target at the end of the batch")
        return replace(out, frames=frames)

    def fetch_batch(self, *statements: Select) -> list[list]:
        """The rows of several SELECTs, all of this moment; all are checked before any runs."""
        if not statements:
            raise BuildError("a batch has no statements")
        for s in statements:
            s.checked()
            self._known(s.table.name)
        return [read.fetch_all(self.frames[s.table.name], s) for s in statements]

    def transaction(self, work: Callable[[Workspace], Workspace], read_only: bool = False) -> Workspace:
        """What work makes of this workspace; an error leaves this one as it was. A read-only one must come back with the same frames."""
        after = work(self)
        if read_only and (after.frames.keys() != self.frames.keys() or any(after.frames[n] is not df for n, df in self.frames.items())):
            raise BuildError("a read-only transaction changes nothing")
        return after

    def publish(self, folder: str) -> dict[str, str]:
        """Write every table to a new folder; the paths by name."""
        return {name: publish(df, f"{folder.rstrip('/')}/{name}") for name, df in self.frames.items()}
