"""Near-duplicate documents by bottom-k sketches of word shingles.

One hash function orders all shingles; a document's sketch is its k smallest shingle hashes. Inverted
lists of the sketches' values gather the documents that may be alike, the union of two sketches estimates
their similarity, and the full shingle sets decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.components import connected_components
from loomgraph.llm.scratch import Scratch
from loomgraph.llm.worker import hold, parts

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = 0xD6E8FEB86659FD93
_SHORT = 32  # documents of an inverted list whose pairs are looked at one by one
_BATCH_BYTES = 1 << 19
_BLOCK = 256  # documents of a group that meet in one task at a time
_LIST_BLOCK = 1024  # documents of a long inverted list that meet at a time, by their sketches
_WORDS = 8  # words of 64 bits of a sketch's mark


@dataclass(frozen=True)
class NearDups:
    """``words`` in a shingle, ``percent`` of similarity that links, and the sketches' size.

    Of the k smallest values of two documents' union, those at the threshold share 80 % on average. ``least``
    is how many are required, by the lists and by the estimate alike: of 64 values 32 or more are shared but
    for one pair in about 5 * 10^7 at exactly the threshold (binomial tail), and fewer above it.
    """

    words: int = 2
    percent: int = 80
    k: int = 64
    least: int = 32


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_SYMBOL = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _powers(n: int) -> list[np.ndarray]:
    """At least ``n`` powers of the odd multiplier and of its inverse, modulo 2^64."""
    table = hold("powers", lambda: [np.ones(1, np.uint64), np.ones(1, np.uint64)])
    if len(table[0]) < n:
        for k, base in enumerate((_ODD, pow(_ODD, -1, 1 << 64))):
            steps = np.full(n + n // 4, np.uint64(base))
            steps[0] = 1
            with np.errstate(over="ignore"):
                table[k] = np.multiply.accumulate(steps)
    return table


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes.

    A-Z are lower-cased; words are what stands between spaces and the characters 9 to 13. A text of fewer
    words than a shingle has is one shingle, one without words has none. All texts are hashed in one pass
    over their bytes: a word's hash is a difference of running sums.
    """
    data = [(t or "").encode("utf-8", "surrogatepass").translate(_LOWER) + b" " for t in texts]
    buffer = np.frombuffer(b" " + b"".join(data), np.uint8)
    space = _SPACE[buffer]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    limits = np.cumsum([0] + [len(d) for d in data]) + 1
    first = np.searchsorted(starts, limits)
    powers, inverse = _powers(len(buffer))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(_SYMBOL[buffer] * powers[: len(buffer)])])
        word = _mixed((sums[ends] - sums[starts]) * inverse[starts])
        shingle = word.copy() if words == 1 else word[: max(0, len(word) - words + 1)].copy()
        for j in range(1, words):
            shingle = _mixed(shingle) + word[j : len(word) - words + 1 + j]
        shingle = _mixed(shingle)
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= words:
                out.append(np.unique(shingle[a : b - words + 1]))
            else:
                whole = np.uint64(b - a)
                for w in word[a:b]:
                    whole = _mixed(np.array([whole], np.uint64) + w)[0]
                out.append(np.array([whole] if b > a else [], np.uint64))
    return out


def sketched(documents: DataFrame, how: NearDups) -> DataFrame:
    """doc_id, n_shingles, set_key (a 128-bit digest of the set; null for an empty one), sketch (sorted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = batch.column("text"), batch.column("doc_id")
            for part in parts(texts, _BATCH_BYTES):
                sets = shingle_sets(texts[part.start : part.stop].to_pylist(), how.words)
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None for s in sets]
                heads = [s[: how.k].view(np.int64) for s in sets]
                lists = pa.ListArray.from_arrays(np.cumsum([0] + [len(h) for h in heads]).astype(np.int32), pa.array(np.concatenate(heads) if heads else [], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids[part.start : part.stop], pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.string()), lists], ["doc_id", "n_shingles", "set_key", "sketch"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, set_key string, sketch array<long>")


def candidate_edges(sketches: DataFrame, how: NearDups, scratch: Scratch) -> DataFrame:
    """Edges (u, v) that join all documents that may be linked: the pairs whose sketches' union lets it be, of an
    inverted list of up to 32 documents all, of a longer one as many as join the same documents.

    Two linked sketches share ``least`` values (for sets smaller than a sketch, the overlap that the
    threshold asks for, which is two or more: smaller sets are equal or not linked). So, of a document's
    values in order of rarity, all but its last ``least - 2`` suffice: linked documents share two of these, so
    a pair that meets in one short list and no other is none, unless it meets in a long one, too. Values that one
    document alone holds come first and make no list, so most documents drop out. A very common value is among
    a document's rarest only where most of its sketch is as common; the longer lists become with the corpus, the
    fewer of their documents are alike, so meeting in one joins nobody by itself.
    """
    least = F.least(F.lit(how.least), F.ceil(F.col("n_shingles") * how.percent / 100.0)).cast("short").alias("least")
    posts = sketches.select("doc_id", least, F.explode("sketch").alias("value"))
    shared = posts.join(posts.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"), "value")
    ranked = shared.groupBy("doc_id", "least").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("values"))
    room = F.when(F.size("values") >= F.col("least"), F.least(F.size("values") - F.col("least") + 2, F.size("values"))).otherwise(0)
    heads = ranked.where(room > 0).select("doc_id", F.explode(F.slice("values", F.lit(1), room)).alias("head"))
    lists = scratch.save(heads.select("doc_id", "head.value"), "lists")
    sizes = lists.groupBy("value").agg(F.count("*").alias("size")).where("size > 1")
    sized = scratch.save(lists.join(sizes, "value"), "sized")
    scratch.drop(lists)
    all_of = sized.where(F.col("size") <= _SHORT).groupBy("value").agg(F.sort_array(F.collect_list("doc_id")).alias("all")).select(F.posexplode("all").alias("i", "u"), "all")
    pairs = all_of.select("u", F.explode(F.slice("all", F.col("i") + 2, F.size("all"))).alias("v"))
    pairs = pairs.groupBy("u", "v").agg(F.count("*").alias("n")).where("n > 1").select("u", "v")

    @F.pandas_udf("double")
    def estimate(a: pd.Series, b: pd.Series) -> pd.Series:
        a, b = ([np.asarray(x, np.int64).view(np.uint64) for x in side] for side in (a, b))
        return pd.Series(_estimates(a, b, np.stack([np.arange(len(a))] * 2, 1), how.k))

    left = sketches.select(F.col("doc_id").alias("u"), F.col("sketch").alias("a"))
    right = sketches.select(F.col("doc_id").alias("v"), F.col("sketch").alias("b"))
    alike = pairs.join(left, "u").join(right, "v").where(estimate("a", "b") * how.k >= how.least - 0.5).select("u", "v")
    long = sized.where(F.col("size") > _SHORT).select(F.col("doc_id").alias("node"), F.col("value").alias("component"))
    return alike.union(_alike_in(long, sketches, how))


def sketch_marks(sketches: list[np.ndarray]) -> np.ndarray:
    """512 bits for each sketch that say of how many of its values, dealt by their low bits, the number is odd. The bits
    in which two marks differ are no more than the values that one of the sketches has and the other hasn't."""
    out = np.zeros((len(sketches), _WORDS), np.uint64)
    values, row = np.concatenate(sketches), np.repeat(np.arange(len(sketches)), [len(x) for x in sketches])
    np.bitwise_xor.at(out, (row, (values >> np.uint64(6) & np.uint64(_WORDS - 1)).astype(np.int64)), np.uint64(1) << (values & np.uint64(63)))
    return out


def sketch_forest(n: np.ndarray, sketches: list[np.ndarray], side: np.ndarray, near: np.ndarray, how: NearDups) -> list[tuple[int, int]]:
    """As many of the pairs (i, j) of sets that may be linked as join the same sets: each set reached is compared with
    those that none has reached yet. Of two sides, only sets of different ones meet, and of two sets one is ``near``."""
    marks, k = sketch_marks(sketches), np.array([len(x) for x in sketches], np.int64)
    least, both, out = np.minimum(how.least, -(-how.percent * n // 100)), side.min() != side.max(), []
    left = np.arange(len(n))
    while len(left):
        reached, left = [int(left[0])], left[1:]
        while reached and len(left):
            i = reached.pop()
            ok = (100 * np.minimum(n[left], n[i]) >= how.percent * np.maximum(n[left], n[i])) & (near[left] | near[i])
            if both:
                ok &= side[left] != side[i]
            at = np.flatnonzero(ok)
            j = left[at]
            # sketches that hold whole sets share what the threshold asks for
            shared = np.where(np.maximum(n[j], n[i]) <= how.k, -(-how.percent * (n[j] + n[i]) // (100 + how.percent)), np.maximum(least[j], least[i]))
            may = np.bitwise_count(marks[j] ^ marks[i]).sum(1, dtype=np.int64) <= k[j] + k[i] - 2 * shared
            may[may] = [len(np.intersect1d(sketches[i], sketches[x], assume_unique=True)) >= y for x, y in zip(j[may].tolist(), shared[may].tolist(), strict=True)]
            if len(at := at[may]):
                found = _estimates([sketches[i]], [sketches[x] for x in left[at].tolist()], np.stack([np.zeros(len(at), np.int64), np.arange(len(at))], 1), how.k)
                at = at[found * how.k >= how.least - 0.5]
                reached += left[at].tolist()
                out += [(i, x) for x in left[at].tolist()]
                left = np.delete(left, at)
    return out


def _alike_in(groups: DataFrame, sketches: DataFrame, how: NearDups) -> DataFrame:
    """Edges (u, v) that join the documents of the same group (node, component) whose sketches' union lets them be linked."""
    keys = ["group", "level", "x", "y"]

    def settle(rows: list) -> list[tuple[int, int]]:
        if len(rows) < 2:
            return []
        side, near, ids, n, sets = zip(*rows, strict=True)
        forest = sketch_forest(np.array(n, np.int64), list(sets), np.array(side), np.array(near), how)
        return [(ids[i], ids[j]) for i, j in forest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def out(edges):
            return pa.RecordBatch.from_arrays([pa.array([u for u, _ in edges], pa.int64()), pa.array([v for _, v in edges], pa.int64())], ["u", "v"])

        for batch in batches:
            column, edges = batch.column("sketch"), []
            values, ends = column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_pylist()
            heads = zip(*(batch.column(c).to_pylist() for c in keys), strict=True)
            own = zip(*(batch.column(c).to_pylist() for c in ("side", "near", "doc_id", "n_shingles")), strict=True)
            for k, (key, row) in enumerate(zip(heads, own, strict=True)):
                if key != now:
                    edges += settle(rows)
                    now, rows = key, []
                rows.append((*row, values[ends[k] : ends[k + 1]].copy()))
            yield out(edges)
        yield out(settle(rows))

    met = _meetings(groups, sketches, how, _LIST_BLOCK).join(sketches.select("doc_id", "n_shingles", "sketch"), "doc_id")
    tasks = max(1, int(sketches.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return met.repartition(tasks, *keys).sortWithinPartitions(*keys).mapInArrow(run, "u long, v long")


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sorted sets, all against all."""
    if len(a) * len(b) <= 64:
        return np.array([[len(x) + len(y) - len(np.union1d(x, y)) for y in b] for x in a], np.int64)
    values = np.concatenate([*a, *b])
    names, number, count = np.unique(values, return_inverse=True, return_counts=True)
    order = np.full(len(names), -1)
    order[count > 1] = np.arange((count > 1).sum())
    column = order[number]
    row = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    row, column = row[column >= 0], column[column >= 0]
    out = np.zeros((len(a), len(b)), np.int64)
    for k in range(0, int((count > 1).sum()), 16_384):
        here = (column >= k) & (column < k + 16_384)
        ones = np.zeros((len(a) + len(b), min(16_384, int((count > 1).sum()) - k)), np.float32)
        ones[row[here], column[here] - k] = 1
        out += np.rint(ones[: len(a)] @ ones[len(a) :].T).astype(np.int64)
    return out


def _estimates(a: list[np.ndarray], b: list[np.ndarray], pairs: np.ndarray, k: int) -> np.ndarray:
    """Similarity of each pair, from the k smallest values of the union of the two sketches."""
    out = np.ones(len(pairs))
    whole = [min(len(a[i]), len(b[j])) >= k for i, j in pairs.tolist()]
    at = np.flatnonzero(whole)  # smaller sets are compared as they are
    for part in np.array_split(at, len(at) // 4096 + 1):
        if len(part):
            both = np.sort(np.stack([np.concatenate([a[i][:k], b[j][:k]]) for i, j in pairs[part].tolist()]), axis=1)
            again = both[:, 1:] == both[:, :-1]
            rank = 1 + np.cumsum(np.concatenate([np.zeros((len(part), 1), int), ~again], 1), 1)
            out[part] = (again & (rank[:, 1:] <= k)).sum(1) / k
    return out


def linked(a: list[np.ndarray], b: list[np.ndarray], how: NearDups) -> np.ndarray:
    """The pairs (i, j) of two lists of sets whose similarity reaches the threshold: sizes and sketches sift,
    full sets decide."""
    n, m = (np.array([len(x) for x in side], np.int64) for side in (a, b))
    small, large = np.minimum.outer(n, m), np.maximum.outer(n, m)
    pairs = np.argwhere((small > 0) & (100 * small >= how.percent * large))
    if len(pairs):
        pairs = pairs[_estimates(a, b, pairs, how.k) * how.k >= how.least - 0.5]
    if not len(pairs):
        return pairs
    if len(pairs) > 64:
        shared = _overlaps(a, b)[pairs[:, 0], pairs[:, 1]]
    else:
        shared = np.array([len(a[i]) + len(b[j]) - len(np.union1d(a[i], b[j])) for i, j in pairs.tolist()])
    union = n[pairs[:, 0]] + m[pairs[:, 1]] - shared
    return pairs[100 * shared >= how.percent * union]


def _forest(pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of the pairs that join two trees of the pairs before."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x

    out = []
    for x, y in pairs:
        if (p := top(x)) != (q := top(y)):
            parent[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _meetings(groups: DataFrame, sketches: DataFrame, how: NearDups, block: int = _BLOCK) -> DataFrame:
    """Which documents meet in which task: doc_id, meeting (group, level, x, y), side, near.

    A group of up to ``block`` meets whole. A larger one is split by size into levels of a factor percent/100,
    of which only equal and neighbouring ones can be linked; the documents of two neighbouring levels are
    dealt into blocks of about as many, and any two blocks meet. ``near``: the lower level's documents; two
    others meet one level up.
    """
    members = groups.select(F.col("node").alias("doc_id"), F.col("component").alias("group")).join(sketches.select("doc_id", "n_shingles"), "doc_id")
    sizes = members.groupBy("group").agg(F.count("*").alias("size"))
    members = members.join(sizes, "group")
    level = F.floor(F.log(F.col("n_shingles").cast("double")) / F.lit(float(-np.log(how.percent / 100)))).cast("int")
    whole = members.where(F.col("size") <= block).select("doc_id", "group", F.lit(-9).alias("level"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("side"), F.lit(True).alias("near"))
    large = members.where(F.col("size") > block).withColumn("own", level).select("doc_id", "group", "own", F.explode(F.array(F.col("own"), F.col("own") - 1)).alias("level"))
    counts = large.groupBy("group", "level").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = large.join(counts, ["group", "level"]).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    each = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    split = each.select("doc_id", "group", "level", F.least("block", "with").alias("x"), F.greatest("block", "with").alias("y"), (F.col("block") > F.col("with")).cast("int").alias("side"), (F.col("own") == F.col("level")).alias("near"))
    return whole.unionByName(split)


def link_edges(groups: DataFrame, sketches: DataFrame, documents: DataFrame, how: NearDups) -> DataFrame:
    """Links (u, v) between documents of the same group, confirmed on full sets: of those that a task finds,
    as many as join the same documents."""

    def settle(rows: list) -> list[tuple[int, int]]:
        one = [r for r in rows if r[1] == 0]
        two = [r for r in rows if r[1] == 1] or one
        found = linked([r[4] for r in one], [r[4] for r in two], how)
        pairs = ((one[i][3], two[j][3]) for i, j in found.tolist() if one[i][3] != two[j][3] and (one[i][2] or two[j][2]))
        return _forest(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def out(edges):
            return pa.RecordBatch.from_arrays([pa.array([u for u, _ in edges], pa.int64()), pa.array([v for _, v in edges], pa.int64())], ["u", "v"])

        for batch in batches:
            texts = batch.column("text")
            heads = list(zip(zip(*(batch.column(c).to_pylist() for c in ("group", "level", "x", "y")), strict=True), *(batch.column(c).to_pylist() for c in ("side", "near", "doc_id")), strict=True))
            edges = []
            for part in parts(texts, _BATCH_BYTES):
                for head, own in zip(heads[part], shingle_sets(texts[part.start : part.stop].to_pylist(), how.words), strict=True):
                    if head[0] != now:
                        edges += settle(rows)
                        now, rows = head[0], []
                    rows.append((*head, own))
            yield out(edges)
        yield out(settle(rows))

    keys = ["group", "level", "x", "y"]
    texts = documents.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    met = _meetings(groups, sketches, how).join(texts, "doc_id")
    tasks = max(1, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return met.repartition(tasks, *keys).sortWithinPartitions(*keys).mapInArrow(run, "u long, v long")


def near_duplicates(documents: DataFrame, how: NearDups = NearDups()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``documents`` (doc_id, text; others are ignored).

    Documents are linked where their shingle sets' Jaccard similarity reaches the threshold; component_id is
    the smallest doc_id that links lead to, kept tells whether it is the row's own. Documents without words
    (null, empty or blank text) have no shingles and no links. Equal sets are treated as one until the end, so
    copies cost nothing. Rows that share a doc_id are one document; a row without doc_id is linked with
    nothing, has a null component_id and is kept. An empty table gives an empty result. Sets are of 64-bit
    hashes: two shingles of a pair of documents are confused about once in 10^13 pairs of a thousand words.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "near")
    rows = scratch.save(sketched(documents, how), "sketches")
    first = F.min(F.struct("doc_id", "n_shingles", "sketch")).alias("first")
    sets = rows.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(first).select("set_key", "first.*")
    sets = scratch.save(sets, "sets")
    keys = scratch.save(rows.select("doc_id", "n_shingles", "set_key"), "keys")
    scratch.drop(rows)  # the sketches of different sets are in ``sets``
    groups = connected_components(candidate_edges(sets, how, scratch), scratch)
    edges = scratch.save(link_edges(groups, sets, documents, how), "links")
    found = connected_components(edges, scratch).select(F.col("node").alias("first"), "component")
    firsts = sets.select("set_key", F.col("doc_id").alias("first")).join(found, "first", "left").select("set_key", F.coalesce("component", "first").alias("component"))
    out = keys.join(firsts, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op3_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
