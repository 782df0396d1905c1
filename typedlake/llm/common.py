"""What several operators share: tables in the shared folder, hot groups, running totals."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Characters that separate words: space and tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
#: Most hot groups that are joined by broadcast; a group is hot with over 1/HOT_GROUPS of all rows.
HOT_GROUPS = 1000

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where the setting is missing, local mode gets a temporary folder, removed
    at the end, and a cluster gets an error, for its machines share no temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        own = tempfile.mkdtemp(prefix="typedlake-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _own_dir.append(f"file://{own}")
    return _own_dir[0]


#: Folders made in the shared folder and not yet removed, in the order in which they were made.
made: list[str] = []


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends, later passes read columns. The folder goes with the application."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/typedlake-{name}-{uuid4().hex}"
    df.write.parquet(path)
    goes_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def goes_at_end(spark: SparkSession, path: str) -> None:
    """Have a folder removed when the application ends, on whatever file system it lies."""
    fs, at = _file_system(spark, path)
    fs.deleteOnExit(at)
    made.append(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Remove folders that no frame reads any more."""
    for path in paths:
        fs, at = _file_system(spark, path)
        fs.delete(at, True)
        made.remove(path)


def carried(columns: tuple[str, ...], own: tuple[str, ...]) -> list[Column]:
    """Carried columns under their names, one that an operator has itself, or another carried one, as doc_<name>."""
    taken, out = {c.lower() for c in own}, []
    for c in columns:
        name = c
        while name.lower() in taken:
            name = f"doc_{name}"
        taken.add(name.lower())
        out.append(F.col(f"`_c_{c}`").alias(name))
    return out


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to be none of df's columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name = f"_{name}"
        out.append(name)
    return out


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """For applications that own their session: send Python workers at most so many rows at once.

    Texts are long, and workers share an executor's memory. The operators leave the session's settings alone.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bits in one row of a filter, as bitmap_construct_agg makes them.
FILTER_ROW = 32_768


def filter_bits(rows: int, bits_per_row: int = 16, max_bits: int = 1 << 30) -> int:
    return min(max_bits, max(FILTER_ROW, 1 << (bits_per_row * max(rows, 1) - 1).bit_length()))


def filter_positions(key: str, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(k)), F.lit(bits)) for k in (1, 2)]


def packed(positions: DataFrame, column: str) -> DataFrame:
    """A Bloom filter of these positions, in rows of FILTER_ROW bits."""
    bits = F.bitmap_construct_agg(F.bitmap_bit_position(column)).alias("_bits")
    return positions.groupBy(F.bitmap_bucket_number(column).alias("_bucket")).agg(bits)


def _bit(bits: Column, position: Column) -> Column:
    """Whether a row of the filter has this bit; a missing row has none."""
    place = F.bitmap_bit_position(position)
    byte = F.conv(F.hex(F.substring(bits, (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) != 0, F.lit(False))


def probe(df: DataFrame, key: str, bloom: DataFrame, bits: int, out: str) -> DataFrame:
    """Add out: whether the filter may hold the key. The filter has at most bits / 8 bytes and is broadcast."""
    found = F.lit(True)
    for k, position in enumerate(filter_positions(key, bits)):
        part = F.broadcast(bloom.select(F.col("_bucket").alias(f"_bucket{k}"), F.col("_bits").alias(f"_bits{k}")))
        df = df.join(part, F.bitmap_bucket_number(position) == F.col(f"_bucket{k}"), "left")
        found = found & _bit(F.col(f"_bits{k}"), position)
    return df.withColumn(out, found).drop("_bucket0", "_bits0", "_bucket1", "_bits1")


def bloom_of(keys: DataFrame, key: str, rows: int) -> tuple[DataFrame, int]:
    bits = filter_bits(rows)
    return stash(packed(keys.select(F.explode(F.array(*filter_positions(key, bits))).alias("_p")), "_p"), "bloom"), bits


def may_hold(df: DataFrame, key: str, bloom: tuple[DataFrame, int]) -> DataFrame:
    """The rows whose key the filter may hold, before anything of theirs is shuffled."""
    return probe(df, key, *bloom, "_may").where("_may").drop("_may")


def join_groups(rows: DataFrame, groups: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Join every row to its group's single row.

    Groups of more than total/HOT_GROUPS rows number fewer than HOT_GROUPS, so
    they are broadcast and their rows stay where they are. The others shuffle.
    """
    hot_from = max(1, total // HOT_GROUPS)
    hot = F.broadcast(groups.where(F.col(count) > hot_from))
    light = groups.where(F.col(count) <= hot_from)
    cold = rows.join(hot.select(key), key, "left_anti")
    return rows.join(hot, key).unionByName(cold.join(light, key))


def running_total(df: DataFrame, group: list[str], order: list[str], value: str, out: str, rows: int, cell_rows: int = 4096, tie: str | None = None) -> DataFrame:
    """Add out: the sum of value over the rows before this one in its group.

    The order is by hash cell, then by the order columns, then by tie, which
    has no part in the cell. A cell holds about
    cell_rows rows however large the group is, so no task gets a whole group.
    """
    cells = max(1, -(-rows // cell_rows))
    tagged = df.withColumn("_cell", F.pmod(F.xxhash64(*order), F.lit(cells)))
    keys = [*group, "_cell"]
    before = Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    base = tagged.groupBy(*keys).agg(F.sum(value).alias("_sum")).withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*keys).orderBy(*order, *([tie] if tie else [])).rowsBetween(Window.unboundedPreceding, -1)
    placed = tagged.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return placed.join(base, keys).withColumn(out, F.col("_base") + F.col("_inside")).drop("_cell", "_base", "_inside")
