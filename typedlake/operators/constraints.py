"""Constraint checks and referential actions as DataFrame plans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .read import named


def _whole(columns: Sequence[str]):
    return reduce(lambda a, b: a & b, [named(c).isNotNull() for c in columns])


def refused(state: DataFrame, bad: DataFrame, message: str) -> DataFrame:
    """The rows of state, in a query that fails where bad has a row. Nothing runs before the result is asked for.

    Bad rows are counted first: a condition on the rows themselves would be moved below the join that finds them.
    """
    count = bad.agg(F.count(F.lit(1)).alias("_bad"))
    stop = count.where(F.when(F.col("_bad") > 0, F.raise_error(F.lit(message)).cast("boolean")))
    none = stop.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in state.schema.fields])
    return none.unionByName(state)


def taken(rows: DataFrame, others: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keys of rows that others have too, each once; small rows are sent to the others, which stay where they are."""
    wanted = rows.where(_whole(columns)).select(*[named(c).alias(f"_t{i}") for i, c in enumerate(columns)])
    return others.join(wanted, [named(c) == F.col(f"_t{i}") for i, c in enumerate(columns)], "left_semi").select(*[named(c) for c in columns]).distinct()


def check_violations(df: DataFrame, check: str) -> DataFrame:
    """Rows for which the check is false; unknown passes."""
    return df.where(~F.coalesce(F.expr(check), F.lit(True)))


def row_violations(df: DataFrame, not_null: Sequence[str] = (), checks: Mapping[str, str] | None = None, labels: Mapping[str, Sequence[str]] | None = None, lengths: Mapping[str, int] | None = None) -> DataFrame:
    """How many rows break each row-level constraint, all in one pass: constraint, violations."""
    rules = {f"not_null_{c}": named(c).isNull() for c in not_null}
    rules |= {name: ~F.coalesce(F.expr(text), F.lit(True)) for name, text in (checks or {}).items()}
    rules |= {f"enum_{c}": ~F.coalesce(named(c).isin(*allowed), F.lit(True)) for c, allowed in (labels or {}).items()}
    rules |= {f"length_{c}": F.coalesce(F.length(named(c)) > n, F.lit(False)) for c, n in (lengths or {}).items()}
    counts = df.agg(*[F.coalesce(F.sum(rule.cast("long")), F.lit(0)).alias(name) for name, rule in rules.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("constraint"), F.col(f"`{n}`").alias("violations")) for n in rules])).alias("r")).select("r.*")


def unique_violations(df: DataFrame, columns: Sequence[str], where: str | None = None) -> DataFrame:
    """Keys held by more than one row, with n; keys with a null are all different. where: a partial index's condition."""
    rows = df.where(where) if where else df
    return rows.where(_whole(columns)).groupBy(*[named(c) for c in columns]).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, columns: Sequence[str], references: Sequence[str]) -> DataFrame:
    """Child rows whose whole key no parent has; a null in the key passes."""
    keys = parent.select(*[named(r).alias(f"_r{i}") for i, r in enumerate(references)])
    return child.where(_whole(columns)).join(keys, [named(c) == F.col(f"_r{i}") for i, c in enumerate(columns)], "left_anti")


def cascade(child: DataFrame, deleted: DataFrame, columns: Sequence[str], references: Sequence[str]) -> DataFrame:
    """ON DELETE CASCADE: the child rows that remain."""
    keys = deleted.select(*[named(r).alias(f"_r{i}") for i, r in enumerate(references)]).distinct()
    return child.join(keys, [named(c) == F.col(f"_r{i}") for i, c in enumerate(columns)], "left_anti")


def set_on_delete(child: DataFrame, deleted: DataFrame, columns: Sequence[str], references: Sequence[str], defaults: Mapping[str, str] | None = None) -> DataFrame:
    """ON DELETE SET NULL, or SET DEFAULT where defaults are given: the child with those keys replaced."""
    keys = deleted.select(*[named(r).alias(f"_r{i}") for i, r in enumerate(references)]).distinct().withColumn("_gone", F.lit(True))
    joined = child.join(keys, [named(c) == F.col(f"_r{i}") for i, c in enumerate(columns)], "left")
    new = {c: F.expr((defaults or {}).get(c, "null")).cast(child.schema[c].dataType) for c in columns}
    return joined.select(*[F.when(F.col("_gone"), new[c]).otherwise(named(c)).alias(c) if c in new else named(c) for c in child.columns])


def cascade_update(child: DataFrame, moved: DataFrame, columns: Sequence[str]) -> DataFrame:
    """ON UPDATE CASCADE: moved maps old to new keys, columns old_<column> and new_<column>."""
    joined = child.join(moved.select(*[f"old_{c}" for c in columns], *[f"new_{c}" for c in columns]), [named(c) == F.col(f"old_{c}") for c in columns], "left")
    hit = F.col(f"old_{columns[0]}").isNotNull()
    return joined.select(*[F.when(hit, F.col(f"new_{c}")).otherwise(named(c)).alias(c) if c in columns else named(c) for c in child.columns])


def restricted(child: DataFrame, deleted: DataFrame, columns: Sequence[str], references: Sequence[str]) -> DataFrame:
    """ON DELETE RESTRICT: the child rows that forbid the deletion."""
    keys = deleted.select(*[named(r).alias(f"_r{i}") for i, r in enumerate(references)]).distinct()
    return child.join(keys, [named(c) == F.col(f"_r{i}") for i, c in enumerate(columns)], "left_semi")
