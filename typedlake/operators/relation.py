"""Relations: related rows of another table for every source row, by one join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.select import Select
from ..plans.table import BuildError
from .read import named, ordering, select


class RelationError(ValueError):
    """A relation that can't be loaded. Names the relation, never a key."""


def _checked(name: str, source: Sequence[str], target: Sequence[str], base: Select) -> None:
    if not name.strip() or "\0" in name:
        raise RelationError("a relation has a name")
    if not source or len(source) != len(target):
        raise RelationError(f"relation {name}: the keys have different lengths")
    if base.count is not None or base.skip is not None:
        raise RelationError(f"relation {name}: a limit or offset would cut targets of other sources")


def _present(keys: Sequence[str]):
    """Whether no part of the key is null."""
    out = F.lit(True)
    for k in keys:
        out = out & named(k).isNotNull()
    return out


def _wanted(sources: DataFrame, targets: DataFrame, base: Select, source: Sequence[str], target: Sequence[str]) -> DataFrame:
    """Target rows, filtered, whose key some source has."""
    keys = sources.where(_present(source)).select(*[named(s).alias(f"_k{i}") for i, s in enumerate(source)]).distinct()
    rows = select(targets, Select(base.table, base.is_distinct, base.condition))
    match = [named(t) == F.col(f"_k{i}") for i, t in enumerate(target)]
    return rows.join(keys, match, "left_semi")


def related(targets: DataFrame, keys: DataFrame, base: Select, column: str) -> DataFrame:
    """The base SELECT over target rows whose column is among the keys: a semi join, not a list of literals."""
    if base.count is not None or base.skip is not None:
        raise BuildError("a limit or offset would cut targets of other sources")
    own = keys.select(named(keys.columns[0]).alias("_k0")).where("_k0 IS NOT NULL").distinct()
    kept = targets.join(own, named(column) == F.col("_k0"), "left_semi")
    return select(kept, base)


def load_many(name: str, sources: DataFrame, targets: DataFrame, base: Select, source: Sequence[str], target: Sequence[str], into: str = "related") -> DataFrame:
    """Every source row with key_present and an array of its targets, in the order of base.

    The array is null where a part of the source's key is null, and empty
    where no target has the key. All sources of one key share one array, built
    by one aggregation of the targets. The array of one key is one value: a
    key with more targets than fit a row should be joined by joined_many.
    """
    _checked(name, source, target, base)
    rows = _wanted(sources, targets, base, source, target)
    names = base.table.names
    place = F.lit(0)
    if base.orders:
        place = F.row_number().over(Window.partitionBy(*[named(t) for t in target]).orderBy(*[ordering(o) for o in base.orders]))
    packed = rows.select(*[named(t).alias(f"_k{i}") for i, t in enumerate(target)], F.struct(place.alias("_place"), *[named(n) for n in names]).alias("_row"))
    arrays = packed.groupBy(*[f"_k{i}" for i in range(len(target))]).agg(F.sort_array(F.collect_list("_row")).alias("_rows"))
    out = sources.withColumn("key_present", _present(source)).join(arrays, [named(s) == F.col(f"_k{i}") for i, s in enumerate(source)], "left")
    empty = F.array().cast(f"array<struct<{','.join(f'`{c.name}`:{c.dtype}' for c in base.table._by_name.values())}>>")
    values = F.transform("_rows", lambda r: F.struct(*[r[n].alias(n) for n in names]))
    return out.withColumn(into, F.when(F.col("key_present"), F.coalesce(values, empty))).drop("_rows", *[f"_k{i}" for i in range(len(target))])


def joined_many(name: str, sources: DataFrame, targets: DataFrame, base: Select, source: Sequence[str], target: Sequence[str], ordinal: str | None = None) -> DataFrame:
    """A row for each source and target, one with nulls where a source has none; ordinal numbers a key's targets from 1."""
    _checked(name, source, target, base)
    rows = select(targets, Select(base.table, base.is_distinct, base.condition))
    if ordinal:
        if not base.orders:
            raise RelationError(f"relation {name}: an ordinal needs an order")
        rows = _wanted(sources, targets, base, source, target)  # only keys that are asked for are numbered
        rows = rows.withColumn(ordinal, F.row_number().over(Window.partitionBy(*[named(t) for t in target]).orderBy(*[ordering(o) for o in base.orders])))
    return sources.join(rows, [sources[s] == rows[t] for s, t in zip(source, target, strict=True)], "left")


def repeated_targets(sources: DataFrame, targets: DataFrame, base: Select, source: Sequence[str], target: Sequence[str]) -> DataFrame:
    """Keys that break a one relation: requested by a source and held by two targets or more."""
    rows = _wanted(sources, targets, base, source, target)
    return rows.groupBy(*[named(t) for t in target]).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def load_one(name: str, sources: DataFrame, targets: DataFrame, base: Select, source: Sequence[str], target: Sequence[str]) -> DataFrame:
    """Every source row with key_present, found and its one target's columns; a repeated target fails the query.

    The check is a count per key inside the same job, so nothing runs before
    the result is asked for.
    """
    _checked(name, source, target, base)
    rows = _wanted(sources, targets, base, source, target)
    keys = [named(t).alias(f"_k{i}") for i, t in enumerate(target)]
    one = rows.select(*keys, F.struct(*[named(n) for n in base.table.names]).alias("_row")).groupBy(*[f"_k{i}" for i in range(len(target))]).agg(F.count(F.lit(1)).alias("_n"), F.first("_row").alias("_row"))
    single = F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(F.lit(f"relation {name}: a key has more than one target")).cast("boolean"))
    match = [named(s) == F.col(f"_k{i}") for i, s in enumerate(source)]
    out = sources.withColumn("key_present", _present(source)).join(one.where(single), match, "left").withColumn("found", F.col("_n").isNotNull())
    taken = {n.lower() for n in sources.columns}
    added = [F.col(f"_row.`{n}`").alias(n if n.lower() not in taken else f"{base.table.name}_{n}") for n in base.table.names]
    return out.select(*[sources[c] for c in sources.columns], "key_present", "found", *added)
