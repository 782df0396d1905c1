"""Shards of near-equal bytes by minimax contiguous partition, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import carried, stash

#: Parts of the hash order. Equal texts share a part, so a part is the atom that is never cut.
PARTS = 1 << 16
#: Hot parts are numbered in pieces of about 1/PIECES of all rows.
PIECES = 1024


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """The smallest capacity under which the atoms, in order, fill at most so many shards.

    An atom above the capacity takes a shard of its own.
    """
    low, high = 0, sum(sizes)
    while low < high:
        middle = (low + high) // 2
        if len(cut(sizes, middle, shards)) <= shards:
            high = middle
        else:
            low = middle + 1
    return high


def cut(sizes: list[int], capacity: int, shards: int) -> list[int]:
    """Where shards start when filled greedily up to the capacity; stops once over the allowed count."""
    starts, filled = [], None
    for at, size in enumerate(sizes):
        if filled is None or filled + size > capacity:
            starts.append(at)
            if len(starts) > shards:
                break
            filled = size
        else:
            filled += size
    return starts


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, carry: tuple[str, ...] = ()) -> DataFrame:
    """Put every row into one of so many shards whose bytes are as equal as whole groups of texts allow.

    A row's size is the UTF-8 bytes of its text, none for null, plus overhead.
    Rows with equal texts stay in one shard; a null text goes with the empty
    ones. The groups are ordered by the hash of their text, in 65,536 parts;
    the driver sees only the parts' sums. The smallest feasible capacity is
    found by binary search, each capacity checked greedily. A part above it (a
    hot text) takes a shard of its own. With fewer groups than shards, the
    last shards stay empty, and an empty table gives an empty result. Slots
    run from 0 without gaps in each shard; ties of part and id are broken by
    row, so repeated rows get slots of their own.

    Returns id_col, size, text_crc32, law ('bytes'), shard, slot, grown_shard
    (null) and the carried columns (one of these names as doc_<name>).
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    digest = stash(
        docs.select(
            docs[id_col].alias("_id"),
            (F.octet_length(text) + F.lit(overhead)).cast("long").alias("_size"),
            F.crc32(text.cast("binary")).alias("_crc"),
            F.shiftrightunsigned(F.xxhash64(text), 48).cast("int").alias("_part"),
            F.monotonically_increasing_id().alias("_row"),
            *[docs[c].alias(f"_c_{c}") for c in carry],
        ),
        "shard-digests",
    )
    parts = digest.groupBy("_part").agg(F.sum("_size").alias("size"), F.count(F.lit(1)).alias("rows")).collect()  # at most PARTS rows
    parts.sort(key=lambda r: r["_part"])
    sizes, rows = [r["size"] for r in parts], sum(r["rows"] for r in parts)
    starts = cut(sizes, smallest_capacity(sizes, shards), shards)
    firsts = F.array(*[F.lit(parts[s]["_part"]) for s in starts[1:]]) if len(starts) > 1 else F.array().cast("array<int>")
    hot = {r["_part"]: -(-r["rows"] * PIECES // rows) for r in parts if r["rows"] * PIECES > rows}  # fewer than PIECES
    pieces = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in hot.items() for x in pair]), F.col("_part")), F.lit(1)) if hot else F.lit(1)
    placed = digest.withColumns({
        "_shard": F.size(F.filter(firsts, lambda first: first <= F.col("_part"))),
        "_piece": F.pmod(F.xxhash64("_row"), pieces).cast("int"),
    })
    cell = ["_shard", "_part", "_piece"]
    before = Window.partitionBy("_shard").orderBy("_part", "_piece").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(*cell).agg(F.count(F.lit(1)).alias("_rows"))
    bases = counts.select(*cell, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"))  # at most PARTS + 2 * PIECES rows
    inside = Window.partitionBy(*cell).orderBy("_id", "_row")
    numbered = placed.withColumn("_inside", F.row_number().over(inside) - 1).join(F.broadcast(bases), cell)
    return numbered.select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("_shard").alias("shard"),
        (F.col("_base") + F.col("_inside")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *carried(carry, (id_col, "size", "text_crc32", "law", "shard", "slot", "grown_shard")),
    )
