"""Sharding by a k-d tree over the rows' metadata. DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.scratch import Scratch

SHARDS = 16
_DIGIT = 10  # bits of the order key that one pass over the table settles
_BITS = (30, 40, 40)  # of a dimension's value, of the text's hash, of the key's hash
_ROWS_A_BUCKET = 20_000


def _unit(column: Column, low: float, high: float) -> Column:
    span = float(high - low)
    return F.coalesce((column - F.lit(float(low))) / F.lit(span), F.lit(0.0)) if span > 0 else F.lit(0.0)


def _pick(of_node: dict[int, Column], node: Column, default: Column) -> Column:
    out = default
    for k, value in of_node.items():
        out = F.when(node == k, value).otherwise(out)
    return out


def _boundaries(table: DataFrame, jobs: dict[int, tuple[str, float]], slack: float) -> dict[int, tuple[int, int, int]]:
    """For each node the smallest order key of its right half.

    ``jobs``: node -> (dimension, weight that goes left). An order key is (dimension's value, text's
    hash, key's hash). Each pass fixes ten more bits of it: bytes are summed by node and digit, which
    Spark combines before the shuffle, and at most 1024 sums a node come to the driver. A node is done
    when the digit's bin in which its weighted median lies holds no more than ``slack`` bytes.
    """
    state = {n: {"prefix": [0, 0, 0], "left": want, "done": False} for n, (_, want) in jobs.items()}
    for part, bits in enumerate(_BITS):
        for at in range(bits - _DIGIT, -1, -_DIGIT):
            live = {n: s for n, s in state.items() if not s["done"]}
            if not live:
                break
            node, cases, inside = F.col("node"), {}, {}
            for n, s in live.items():
                keys = [F.col(jobs[n][0]), F.col("text_key"), F.col("row_key")]
                cases[n] = F.shiftrightunsigned(keys[part], at).bitwiseAND((1 << _DIGIT) - 1)
                same = [keys[i] == s["prefix"][i] for i in range(part)] + [F.shiftrightunsigned(keys[part], at + _DIGIT) == s["prefix"][part] >> (at + _DIGIT)]
                inside[n] = reduce(lambda a, b: a & b, same)
            sums = (
                table.where(_pick(inside, node, F.lit(False)))
                .groupBy("node", _pick(cases, node, F.lit(None).cast("bigint")).alias("digit"))
                .agg(F.sum("weight").alias("w"))
                .collect()
            )
            for n, s in live.items():
                bins = sorted((r["digit"], r["w"]) for r in sums if r["node"] == n)
                for k, (digit, w) in enumerate(bins):
                    if s["left"] < w or k == len(bins) - 1:
                        break
                    s["left"] -= w
                s["prefix"][part] |= digit << at
                if w <= slack:
                    s["done"] = True
                    if s["left"] * 2 > w:  # the whole bin goes left
                        s["prefix"][part] += 1 << at
    return {n: tuple(s["prefix"]) for n, s in state.items()}


def kd_shards(rows: DataFrame, dims: list[str], shards: int, scratch: Scratch, slack: float = 0.0002) -> DataFrame:
    """Add ``shard`` (0 to shards - 1) so that every shard has nearly the same weight.

    ``rows``: ``weight`` (bigint > 0), ``text_key`` and ``row_key`` (non-negative 40-bit hashes that
    order ties: among rows of one value of the split dimension equal texts stay side by side, and their
    group is cut only where it alone is heavier than the slack; copies that differ in a dimension may part) and the numeric columns ``dims``. A node of the tree is split at its
    weighted median along the dimension in which it is widest, relative to the whole table; a node
    that stands for s shards gives floor(s/2)/s of its weight to the left. ``slack`` is the share of
    one shard by which a split may miss. Null values of a dimension count as its smallest value.
    An empty table gives an empty result.
    """
    spans = rows.agg(F.sum("weight").alias("w"), *[f(d).cast("double").alias(f"{d}_{n}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]).first()
    total = spans["w"] or 0
    keys = [f"q{i}" for i in range(len(dims))]
    steps = (1 << _BITS[0]) - 1
    lows = [spans[f"{d}_lo"] or 0.0 for d in dims]
    highs = [spans[f"{d}_hi"] or 0.0 for d in dims]
    table = rows.select(
        "*",
        *[F.floor(_unit(F.col(d).cast("double"), a, b) * steps).cast("bigint").alias(q) for q, d, a, b in zip(keys, dims, lows, highs)],
    )
    node, stands_for, first = F.lit(0), {0: shards}, {0: 0}
    while total and max(stands_for.values()) > 1:
        at = table.withColumn("node", node)
        seen = at.groupBy("node").agg(F.sum("weight").alias("w"), *[(F.max(q) - F.min(q)).alias(q) for q in keys]).collect()
        jobs, widest = {}, {}
        for r in seen:
            if (s := stands_for[r["node"]]) > 1:
                widest[r["node"]] = max(keys, key=lambda q: (r[q], -keys.index(q)))
                jobs[r["node"]] = (widest[r["node"]], r["w"] * (s // 2) / s)
        cut = _boundaries(at, jobs, slack * total / shards)
        moves, after, begin = {}, {}, {}
        for n, s in stands_for.items():
            after[2 * n + 1], begin[2 * n + 1] = max(1, s // 2), first[n]
            if s == 1:
                moves[n] = F.lit(2 * n + 1)
                continue
            after[2 * n + 2], begin[2 * n + 2] = s - s // 2, first[n] + s // 2
            if n not in cut:
                moves[n] = F.lit(2 * n + 1)
                continue
            q, (a, b, c) = F.col(widest[n]), cut[n]
            left = (q < a) | ((q == a) & ((F.col("text_key") < b) | ((F.col("text_key") == b) & (F.col("row_key") < c))))
            moves[n] = F.when(left, 2 * n + 1).otherwise(2 * n + 2)
        table = scratch.save(at.withColumn("node", _pick(moves, F.col("node"), F.col("node"))), "level")
        node, stands_for, first = F.col("node"), after, begin
    shard = _pick({n: F.lit(k) for n, k in first.items()}, node, F.lit(0))
    return table.withColumn("shard", shard.cast("int")).drop("node", *keys)


def number_slots(rows: DataFrame, count: int, order: list[str]) -> DataFrame:
    """Add ``slot``: gapless from 0 within each shard.

    A shard is numbered in buckets of about 20,000 rows: counts by bucket are summed up to offsets, and
    rows are numbered within their bucket only, so no task holds a whole shard.
    """
    buckets = max(1, count // _ROWS_A_BUCKET)
    dealt = rows.withColumn("bucket", F.pmod(F.col("row_key"), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy(*order))
    return dealt.withColumn("place", place).join(offsets, ["shard", "bucket"]).withColumn("slot", F.col("offset") + F.col("place") - 1).drop("bucket", "place", "offset")


def shard_documents(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Put every document into one of ``shards`` shards of nearly equal bytes.

    Reads ``doc_id``, ``text``, ``lang`` and ``source``; further columns are ignored. A null or empty
    text weighs 1 byte and its text_crc32 is 0; repeated rows and null ids are rows like any other.
    Returns doc_id, size, text_crc32, law ("bytes"), shard, slot, grown_shard (null under this law).
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "shard")
    text = F.coalesce("text", F.lit(""))
    mask = (1 << 40) - 1
    rows = scratch.save(
        documents.select(
            "doc_id",
            (F.octet_length(text) + F.lit(1)).cast("bigint").alias("weight"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.log2(F.octet_length(text) + F.lit(1.0)).alias("log_size"),
            F.crc32(F.coalesce("source", F.lit("")).cast("binary")).alias("source_code"),
            F.crc32(F.coalesce("lang", F.lit("")).cast("binary")).alias("lang_code"),
            F.xxhash64(text).bitwiseAND(mask).alias("text_key"),
            F.xxhash64("doc_id", F.lit(7)).bitwiseAND(mask).alias("row_key"),
        ),
        "rows",
    )
    placed = kd_shards(rows, ["log_size", "source_code", "lang_code"], shards, scratch)
    numbered = number_slots(placed, rows.count(), ["doc_id", "text_crc32"])
    return numbered.select(
        "doc_id",
        F.col("weight").alias("size"),
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
