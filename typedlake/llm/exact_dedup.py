"""Exact dedup by two passes over a Bloom filter, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, carried, filter_bits, filter_positions, join_groups, packed, probe, stash

def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), bits_per_row: int = 16, max_bits: int = 1 << 30) -> DataFrame:
    """Label every row with the row that stays of its group of equal texts.

    Texts are equal when they match after every space, tab and line-break
    character is deleted. Of a group, the row with the most code points in the
    original text stays, then the smallest id (a null id comes last), then any
    one of rows that are the same in both. A null text counts as empty, and all
    empty texts are one group. An empty table gives an empty result.

    Pass one counts hash positions and packs those met twice or more into a
    Bloom filter. Its size follows the row count up to max_bits (128 MB), which
    bounds the broadcast; past that more rows shuffle and the result is the
    same. Pass two sends only rows that the filter may have met twice to the
    shuffle; the others keep themselves where they are.

    Returns id_col, keep_id, group_size, kept, text_sha256 and the carried
    columns (one of these names as doc_<name>); other columns of docs are not
    looked at.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    digest = stash(
        docs.select(
            docs[id_col].alias("_id"),
            F.length(text).alias("_n"),
            F.unhex(F.sha2(F.translate(text, SPACES, ""), 256)).alias("_sha"),
            F.monotonically_increasing_id().alias("_row"),
            *[docs[c].alias(f"_c_{c}") for c in carry],
        ),
        "digests",
    )
    rows = digest.count()
    bits = filter_bits(rows, bits_per_row, max_bits)
    met = digest.select(F.explode(F.array(*filter_positions("_sha", bits))).alias("_p")).groupBy("_p").count().where("count > 1")
    probed = probe(digest, "_sha", stash(packed(met, "_p"), "bloom"), bits, "_again")

    again = probed.where("_again").drop("_again")
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row")))
    groups = again.groupBy("_sha").agg(F.count(F.lit(1)).alias("_size"), best.alias("_best"))
    shared = join_groups(again, groups, "_sha", "_size", rows)
    once = probed.where("not _again").drop("_again")
    out = shared.select(*digest.columns, F.col("_best.id").alias("keep_id"), F.col("_size").alias("group_size"), (F.col("_row") == F.col("_best.row")).alias("kept")).unionByName(
        once.select("*", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    )
    return out.select(F.col("_id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("_sha")).alias("text_sha256"), *carried(carry, (id_col, "keep_id", "group_size", "kept", "text_sha256")))
