"""Row numbers and ordered lists without a task that sorts, or walks, a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.store import Scratch, dealt

_ROWS = 33  # bits of a row's place in its partition, as monotonically_increasing_id gives it

#: Blocks of a text that one part of it holds.
PART_BLOCKS = 1024


def numbered(rows: DataFrame, by: list[str], order: list[str], scratch: Scratch, name: str = "n") -> DataFrame:
    """Add ``name``, a row's number from 1 in ``order`` within its ``by``, and ``total``, the rows of that group.

    Rows are dealt by sampled ranges of (by, order), so a large group lies in as many tasks as it needs; each range
    counts its rows of a group, and the counts before a range shift its rows' places. ``order`` should leave no ties.
    """
    tasks = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [*by, *order]
    placed = scratch.save(rows.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    placed = placed.withColumn("_range", F.shiftright("_at", _ROWS))
    counts = placed.groupBy(*by, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_count"))
    group = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_count").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select(*by, "_range", (before - F.col("_first") + 1).alias("_shift"), F.sum("_count").over(group).alias("total"))
    return placed.join(shifts, [*by, "_range"]).withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift")


def suffix_sums(items: DataFrame, scratch: Scratch) -> DataFrame:
    """List ranking: ``items`` (id, next, and numbers) form lists, each item naming the next one's id or null; the result
    has for every id the sums of the numbers from the item to its list's end.

    Each round joins what an item spans with what the item behind it spans, so lists of n items take log2(n) rounds.
    """
    names = [c for c in items.columns if c not in ("id", "next")]
    now = scratch.save(items, "list")
    while not now.where("next is not null").isEmpty():
        ahead = now.select(F.col("id").alias("next"), F.col("next").alias("_next"), *[F.col(c).alias(f"_{c}") for c in names])
        summed = [(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in names]
        now = scratch.save(now.join(dealt(ahead), "next", "left").select("id", F.col("_next").alias("next"), *summed), "list")
    return now.select("id", *names)


def text_parts(blocks: DataFrame, order: list[str], scratch: Scratch, between: str = "") -> DataFrame:
    """(web_id, part, text): each web's blocks (web_id, ``order``, block) in order, as texts of up to ``PART_BLOCKS``
    blocks that follow one another from part 0, with ``between`` before all blocks but a web's first."""
    placed = numbered(blocks, ["web_id"], order, scratch, "n")
    shown = F.concat(F.when(F.col("n") > 1, between).otherwise(""), "block")
    rows = placed.select("web_id", F.floor((F.col("n") - 1) / PART_BLOCKS).cast("bigint").alias("part"), "n", shown.alias("block"))
    ordered = F.sort_array(F.collect_list(F.struct("n", "block")))
    return rows.groupBy("web_id", "part").agg(F.array_join(F.transform(ordered, lambda b: b["block"]), "").alias("text"))
