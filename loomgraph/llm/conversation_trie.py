"""A prefix trie of conversations, by rolling fingerprints.

The turns are sorted once over the whole table; numpy scans give each turn the fingerprint of all turns up to it,
a running sum modulo 2^64 that is carried on where a conversation spans partitions. Conversations with one
fingerprint at one depth are candidates for a node; their turns are compared with those of the node's
representative, the smallest conv_id, and a node whose members differ is split. What parents sum up over their
subtrees is summed over their members' turns, so depth costs no rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from loomgraph.llm.rolling import power, powers
from loomgraph.llm.scratch import Scratch

_NODE = ["depth", "fp", "split"]
_IDS = 4096  # conv_ids of an end that are put together before they are hashed


@dataclass(frozen=True)
class Trie:
    """``family``: conversations that may begin as the first of them does; ``heads``: how many turns, less one, such
    a beginning has at most; ``bits`` of a fingerprint that are used (fewer make nodes that must be split)."""

    family: int = 5
    heads: int = 9
    bits: int = 64


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to sorted turns i (place in the conversation's part of this partition), s0 and s1 (fingerprint before and
    after the turn) and b0 (bytes of text before it)."""
    last, n, s, b = None, 0, np.uint64(0), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv, symbol, size = (batch.column(x).to_numpy() for x in ("conv_id", "symbol", "n_bytes"))
        at = np.arange(len(conv))
        head = np.concatenate([[True], conv[1:] != conv[:-1]])
        first = np.maximum.accumulate(np.where(head, at, 0))
        goes_on = (first == 0) & (conv[0] == last)
        i = at - first + np.where(goes_on, n, 0)
        with np.errstate(over="ignore"):
            weight = powers(len(at))[0][at - first] * np.where(goes_on, power(np.array([n]))[0], np.uint64(1))
            sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(symbol.view(np.uint64) * weight)])
            begun = np.where(goes_on, s, np.uint64(0)) - sums[first]
            s0, s1 = sums[:-1] + begun, sums[1:] + begun
        bytes_ = np.concatenate([[0], np.cumsum(size)])
        b0 = bytes_[:-1] - bytes_[first] + np.where(goes_on, b, 0)
        last, n, s, b = conv[-1], int(i[-1]) + 1, s1[-1], int(b0[-1] + size[-1])
        numbers = [pa.array(x.astype(np.uint64).view(np.int64) if x.dtype == np.uint64 else x) for x in (i, s0, s1, b0)]
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("conv_id", "part", "role", "text", "n_bytes")), *numbers], ["conv_id", "part", "role", "text", "n_bytes", "i", "s0", "s1", "b0"])


def _carries(runs: DataFrame) -> DataFrame:
    """What the parts of a conversation before this one add up to, for conversations of several parts: at most two
    rows of each part, its first and its last conversation's."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        n, b = rows["n"].to_numpy(), rows["b"].to_numpy()
        before = np.cumsum(n) - n
        with np.errstate(over="ignore"):
            each = rows["s"].to_numpy().astype(np.int64).view(np.uint64) * power(before)
            sums = np.add.accumulate(each) - each
        return pd.DataFrame({"conv_id": rows["conv_id"], "part": rows["part"], "before": before, "s_before": sums.view(np.int64), "b_before": np.cumsum(b) - b})

    several = runs.groupBy("conv_id").agg(F.count("*").alias("parts")).where("parts > 1").select("conv_id")
    return runs.join(several, "conv_id").groupBy("conv_id").applyInPandas(add, "conv_id long, part int, before long, s_before long, b_before long")


@F.pandas_udf(LongType())
def _moved(offset: pd.Series, by: pd.Series, s: pd.Series) -> pd.Series:
    """offset + P^by * s, modulo 2^64."""
    offset, s = (x.to_numpy().astype(np.int64).view(np.uint64) for x in (offset, s))
    with np.errstate(over="ignore"):
        return pd.Series((offset + power(by.to_numpy().astype(np.int64)) * s).view(np.int64))


@F.pandas_udf(LongType())
def _less(a: pd.Series, b: pd.Series) -> pd.Series:
    """a - b, modulo 2^64."""
    with np.errstate(over="ignore"):
        return pd.Series((a.to_numpy().astype(np.int64).view(np.uint64) - b.to_numpy().astype(np.int64).view(np.uint64)).view(np.int64))


def _placed(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """Turns in order: conv_id, p (place from 0), s0, s1, b0, n_bytes, role, text."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", text("role"), text("text"))
    tasks = max(1, int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["conv_id", "turn", "role", "text"]
    ordered = turns.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    given = ordered.select("conv_id", F.spark_partition_id().alias("part"), "role", "text", F.xxhash64("role", "text").alias("symbol"), F.octet_length("text").cast("bigint").alias("n_bytes"))
    scanned = scratch.save(given.mapInArrow(_scan, "conv_id long, part int, role string, text string, n_bytes long, i long, s0 long, s1 long, b0 long"), "scanned")
    runs = scanned.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.max_by("s1", "i").alias("s"), F.sum("n_bytes").alias("b"))
    carries = scratch.save(_carries(runs), "carries")
    joined = scanned.join(F.broadcast(carries), ["conv_id", "part"], "left").na.fill(0, ["before", "s_before", "b_before"])
    moved = lambda s: _moved("s_before", "before", s)
    return joined.select("conv_id", (F.col("before") + F.col("i")).alias("p"), moved("s0").alias("s0"), moved("s1").alias("s1"), (F.col("b_before") + F.col("b0")).alias("b0"), "n_bytes", "role", "text")


def rebuilt_turns(conversations: DataFrame, how: Trie, scratch: Scratch) -> DataFrame:
    """Turns of the rebuilt conversations: conv_id, depth (from 1; 0 for the root, of every conversation), fp and prev
    (fingerprints with and without the turn), b0 (bytes before it), n_bytes, role, text, length and bytes (of the
    whole conversation)."""
    placed = _placed(conversations, scratch)
    head = F.when(F.col("p") < how.heads - 1, F.struct("p", "s1", (F.col("b0") + F.col("n_bytes")).alias("b1")))
    each = placed.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("b"), F.sort_array(F.collect_list(head)).alias("heads"))
    each = scratch.save(each.withColumns({"h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % how.heads, "base": F.col("conv_id") - F.col("conv_id") % how.family}), "each")
    base = each.select(F.col("conv_id").alias("base"), F.col("heads").alias("base_heads"))
    both = each.join(base, "base", "left").withColumn("m", F.least("h", F.coalesce(F.size("base_heads"), F.lit(0)).cast("bigint")))

    def at(heads: str, n: Column, value: str) -> Column:
        return F.coalesce(F.get(heads, n.cast("int") - 1)[value], F.lit(0).cast("bigint"))

    cut = both.select(
        "conv_id", "base", "h", "m", at("base_heads", F.col("m"), "s1").alias("base_s"), at("base_heads", F.col("m"), "b1").alias("base_b"), at("heads", F.col("h"), "s1").alias("own_s"), at("heads", F.col("h"), "b1").alias("own_b"),
        (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"), F.when(F.col("n") > F.col("h"), F.col("b")).alias("b"),
    )
    cut = scratch.save(cut.withColumn("bytes", F.col("base_b") + F.coalesce(F.col("b") - F.col("own_b"), F.lit(0))), "cut")
    of = ["conv_id", "length", "bytes"]
    begin = cut.select(*of, "base", "m").join(placed.where(F.col("p") < how.heads - 1).withColumnRenamed("conv_id", "base"), "base").where("p < m")
    begin = begin.select(*of, (F.col("p") + 1).alias("depth"), F.col("s0").alias("prev"), F.col("s1").alias("fp"), "b0", "n_bytes", "role", "text")
    own = placed.join(cut, "conv_id").where("p >= h")
    shifted = lambda s: _moved("base_s", F.col("m") - F.col("h"), _less(s, "own_s"))
    own = own.select(*of, (F.col("m") + F.col("p") - F.col("h") + 1).alias("depth"), shifted("s0").alias("prev"), shifted("s1").alias("fp"), (F.col("base_b") + F.col("b0") - F.col("own_b")).alias("b0"), "n_bytes", "role", "text")
    zero = F.lit(0).cast("bigint")
    root = cut.select(*of, *[zero.alias(x) for x in ("depth", "prev", "fp", "b0", "n_bytes")], F.lit("").alias("role"), F.lit("").alias("text"))
    mask = F.lit((1 << how.bits) - 1 if how.bits < 64 else -1)
    return begin.unionByName(own).unionByName(root).withColumns({x: F.when(F.col("depth") < (1 if x == "fp" else 2), zero).otherwise(F.col(x).bitwiseAND(mask)) for x in ("fp", "prev")})


def _collisions(turns: DataFrame) -> DataFrame:
    """(depth, fp) of candidate nodes with a member whose turn, or what comes before it, is not its representative's.

    Equal turns are counted together before they are shuffled. Once no node of smaller depth differs, members of one
    ``prev`` begin alike, so the last turn decides."""
    variants = turns.groupBy("depth", "fp", "prev", "role", "text").agg(F.min("conv_id").alias("conv_id"))
    return variants.groupBy("depth", "fp").agg(F.count("*").alias("variants")).where("variants > 1").select("depth", "fp")


def _splits(turns: DataFrame, colliding: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, depth, split) of the turns from a conversation's first colliding node on; split is the smallest
    conversation that has the same turns up to there. One round for each depth, of those conversations alone."""
    since = turns.join(colliding, ["depth", "fp"]).groupBy("conv_id").agg(F.min("depth").alias("since"))
    mine = scratch.save(turns.join(since, "conv_id").where("depth >= since").select("conv_id", "depth", "fp", "prev", "role", "text"), "colliding")
    low, high = mine.agg(F.min("depth"), F.max("depth")).first()
    none = mine.select("conv_id", "depth", F.lit(0).cast("bigint").alias("split")).limit(0)
    done, last = [], none
    for depth in range(low, high + 1):
        here = mine.where(F.col("depth") == depth).join(last.select("conv_id", F.col("split").alias("above")), "conv_id", "left").withColumn("above", F.coalesce("above", F.lit(0)))
        least = F.min("conv_id").over(Window.partitionBy("fp", "prev", "above", "role", "text"))
        last = scratch.save(here.select("conv_id", "depth", least.alias("split")), "split")
        done.append(last)
    out = none
    for table in done:
        out = out.unionByName(table)
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, fp, split, conv_id): the ids of a node in pieces, each with its first."""
    for batch in batches:
        columns = [batch.column(x).to_numpy() for x in _NODE]
        fresh = np.zeros(batch.num_rows, bool)
        fresh[::_IDS] = True
        for x in columns:
            fresh[1:] |= x[1:] != x[:-1]
        first = np.flatnonzero(fresh)
        ids = batch.column("conv_id").cast(pa.string()).to_pylist()
        edges = [*first.tolist(), batch.num_rows]
        pieces = [",".join(ids[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*(pa.array(x[first]) for x in columns), pa.array(batch.column("conv_id").to_numpy()[first]), pa.array(pieces, pa.string())], [*_NODE, "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each node's pieces, in order and comma-joined; only the hash's state is held."""
    now, sha = None, None

    def out(found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([k[i] for k, _ in found], pa.int64()) for i in range(3)), pa.array([d for _, d in found], pa.string())], [*_NODE, "ends_sha256"])

    for batch in batches:
        found = []
        for key, ids in zip(zip(*(batch.column(x).to_pylist() for x in _NODE), strict=True), batch.column("ids").to_pylist(), strict=True):
            if key != now:
                if sha:
                    found.append((now, sha.hexdigest()))
                now, sha = key, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        yield out(found)
    yield out([(now, sha.hexdigest())] if sha else [])


def _ends(turns: DataFrame) -> DataFrame:
    """(depth, fp, split, ends_sha256) of the nodes at which conversations end. A node's ids are dealt over tasks by
    range and go to its last task in pieces."""
    tasks = max(1, int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [*_NODE, "conv_id"]
    ends = turns.where(F.col("depth") == F.col("length")).select(*order)
    pieces = ends.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(_chunks, "depth long, fp long, split long, first long, ids string")
    return pieces.repartition(tasks, *_NODE).sortWithinPartitions(*_NODE, "first").mapInArrow(_digests, "depth long, fp long, split long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, how: Trie = Trie()) -> DataFrame:
    """The nodes of the trie of ``conversations`` (conv_id, turn, role, text; others are ignored), each a distinct
    beginning of rebuilt conversations: conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    Conversation c is rebuilt from the first h turns of conversation c - c % family (all it has, none where it is
    absent) and its own turns behind the first h; h is crc32(c) % heads. Turns are ordered by turn, null first; ties
    by role and text. A null role or text is empty. Rows without conv_id are left out; repeated rows are turns of
    their own. A conversation that is left without turns is a member of the root alone. An empty table gives an
    empty result.
    """
    scratch = Scratch(conversations.sparkSession, "trie")
    turns = scratch.save(rebuilt_turns(conversations, how, scratch), "turns")
    colliding = scratch.save(_collisions(turns), "collisions")
    plain = turns.select("conv_id", "depth", "fp", "prev", "b0", "n_bytes", "length", "bytes")
    zero = F.lit(0).cast("bigint")
    if colliding.isEmpty():
        named = plain.withColumns({"split": zero, "above": zero})
    else:
        splits = scratch.save(_splits(turns, colliding, scratch), "splits")
        above = splits.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("split").alias("above"))
        named = plain.join(splits, ["conv_id", "depth"], "left").join(above, ["conv_id", "depth"], "left").na.fill(0, ["split", "above"])
        named = scratch.save(named, "named")
    nodes = named.groupBy(*_NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *[F.min(x).alias(x) for x in ("prev", "above", "b0")])
    nodes = scratch.save(nodes, "nodes")
    up = [(F.col("depth") - 1).alias("depth"), F.col("prev").alias("fp"), F.col("above").alias("split")]
    children = nodes.where("depth > 0").select(*up).groupBy(*_NODE).agg(F.count("*").alias("n_children"))
    counted = scratch.save(nodes.join(children, _NODE, "left").withColumn("n_children", F.coalesce("n_children", zero)), "counted")
    # a conversation represents its nodes from some depth on; the turns before that are others' copies
    own = counted.groupBy("conv_id").agg(F.min_by("b0", "depth").alias("copied"), F.max((F.col("n_children") == 0).cast("bigint")).alias("leaf"))
    ends = named.where("depth = 0").select("conv_id", "bytes").join(own, "conv_id", "left")
    ends = ends.select("conv_id", F.coalesce("copied", "bytes").alias("copied"), F.coalesce("leaf", zero).alias("leaf"))
    rolled = named.select("conv_id", *_NODE, "b0").join(ends, "conv_id").groupBy(*_NODE).agg(F.sum("leaf").alias("n_leaves"), F.sum(F.greatest(F.col("copied") - F.col("b0"), zero)).alias("saved_tokens"))
    parents = counted.select(*_NODE, F.col("conv_id").alias("parent_conv_id"))
    out = counted.join(rolled, _NODE).join(_ends(named), _NODE, "left")
    below = out.where("depth > 0").select(F.col("depth").alias("own_depth"), "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", *up).join(parents, _NODE).drop(*_NODE).withColumnRenamed("own_depth", "depth")
    out = out.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("bigint")).select(*below.columns).unionByName(below)
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: Nodes are told apart by their whole lists of turns; a subtree is found through its nodes' smallest members. The
#: first lines are crc32, bit by bit.
ORACLE = """
with ids as (
    select distinct conv_id as c from conversations where conv_id is not null
), bits as (
    select c, flatten(list_transform(string_split(cast(c as varchar), ''), lambda x: [cast(ord(x) as bigint), -1, -1, -1, -1, -1, -1, -1, -1])) as b from ids
), heads as (
    select c, c - c % 5 as base, xor(list_reduce(list_concat([cast(4294967295 as bigint)], b), lambda a, x: case when x >= 0 then xor(a, x) when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end), 4294967295) % 9 as h from bits
), turns as (
    select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as p, coalesce(role, '') as role, coalesce(text, '') as text
    from conversations where conv_id is not null
), own as (
    select heads.c, 0 as kind, p, role, text from heads join turns on turns.c = heads.base and p < h
    union all select heads.c, 1, p, role, text from heads join turns on turns.c = heads.c and p >= h
), rebuilt as (
    select c, row_number() over (partition by c order by kind, p) as depth, role, text from own
), paths as (
    select c, depth, text, list({'role': role, 'text': text}) over (partition by c order by depth rows between unbounded preceding and current row) as path from rebuilt
    union all select c, 0, '', [] from ids
), lengths as (
    select c, max(depth) as len from paths group by c
), nodes as (
    select path, depth, min(c) as conv_id, count(*) as n_convs, octet_length(encode(any_value(text))) as bytes,
        sha256(coalesce(string_agg(cast(c as varchar), ',' order by c) filter (depth = len), '')) as ends_sha256
    from paths join lengths using (c) group by path, depth
), named as (
    select paths.c, nodes.depth, nodes.conv_id from paths join nodes on nodes.path = paths.path
), linked as (
    select nodes.*, up.conv_id as parent_conv_id from nodes left join named as up on up.c = nodes.conv_id and up.depth = nodes.depth - 1
), children as (
    select depth - 1 as depth, parent_conv_id as conv_id, count(*) as n from linked where depth > 0 group by all
), counted as (
    select linked.*, coalesce(n, 0) as n_children from linked left join children on children.depth = linked.depth and children.conv_id = linked.conv_id
), rolled as (
    select up.depth, up.conv_id, count(*) filter (n_children = 0) as n_leaves, cast(sum((n_convs - 1) * bytes) as bigint) as saved
    from counted join named as up on up.c = counted.conv_id and up.depth <= counted.depth group by all
)
select counted.conv_id, counted.depth, parent_conv_id, n_convs, n_children, n_leaves, saved as saved_tokens, ends_sha256
from counted join rolled on rolled.depth = counted.depth and rolled.conv_id = counted.conv_id
"""
