"""Webs stored as immutable parts and snapshots that name them.

A part is a folder of the four tables, sorted by web_id, with an index of the web_ids that each file spans. A snapshot
is one small file that lists the parts that count, in their order; a write makes a part and then the next snapshot,
so all four tables change at once, and what a reader has opened stays. Parts of kind ``webs`` replace webs whole; parts
of kind ``posts`` are deltas that readers merge: counts of known posts, new posts, threads and edges. Every part also holds a
tally: what it adds to, or takes from, the posts and engagement of each handle, so rankings of authors are sums over
the parts' tallies and read no posts.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.text import author_name, engagement
from loomgraph.operators.recrawl import merge_posts
from loomgraph.schema import POSTS, QUOTE_EDGES, THREADS, WEBS, Webs
from loomgraph.store import create_file, delete, names_in, read_file

_TABLES = {"webs": WEBS, "threads": THREADS, "posts": POSTS, "edges": QUOTE_EDGES}
_ORDER = {"webs": ["web_id"], "threads": ["web_id", "thread_ord"], "posts": ["web_id", "thread_ord", "post_ord"], "edges": ["web_id", "edge_ord"]}
_INDEX = "table string, file string, low string, high string"
_TALLY = "web_id string, handle string, posts bigint, engagement bigint, first struct<thread_ord:int,post_ord:int>, name string"
FAN = 8  # deltas of a level that become one of the next


class Conflict(RuntimeError):
    """Another write made the next snapshot first; nothing was changed."""


@dataclass(frozen=True)
class Part:
    name: str
    kind: str
    level: int = 0


@dataclass(frozen=True)
class Snapshot:
    """``streams``: for each stream that writes here the last batch that is part of the snapshot."""

    version: int = 0
    parts: tuple[Part, ...] = ()
    streams: dict[str, int] = field(default_factory=dict)


def current(spark: SparkSession, path: str) -> Snapshot:
    """The last snapshot; one without parts where nothing is stored yet."""
    last = max((int(n.removesuffix(".json")) for n in names_in(spark, f"{path}/snapshots") if n.endswith(".json") and not n.startswith("_")), default=0)
    if not last:
        return Snapshot()
    held = json.loads(read_file(spark, f"{path}/snapshots/{last}.json"))
    return Snapshot(last, tuple(Part(*p) for p in held["parts"]), held["streams"])


def commit(spark: SparkSession, path: str, before: Snapshot, parts: tuple[Part, ...], streams: dict[str, int] | None = None) -> Snapshot:
    """Make the snapshot that follows ``before``; :class:`Conflict` where there is one already."""
    after = Snapshot(before.version + 1, parts, before.streams if streams is None else streams)
    body = json.dumps({"parts": [[p.name, p.kind, p.level] for p in after.parts], "streams": after.streams})
    if not create_file(spark, f"{path}/snapshots/{after.version}.json", body):
        raise Conflict(f"{path} has a snapshot {after.version}")
    return after


def _summed(tallies: DataFrame) -> DataFrame:
    return tallies.groupBy("web_id", "handle").agg(F.sum("posts").alias("posts"), F.sum("engagement").alias("engagement"), F.min("first").alias("first"), F.min_by("name", "first").alias("name"))


def tally(posts: DataFrame) -> DataFrame:
    """(web_id, handle, posts, engagement, first, name): each handle's posts, what they drew, the place of the first and
    the author's name there."""
    place = F.struct("thread_ord", "post_ord")
    return _summed(posts.select("web_id", F.col("author.handle").alias("handle"), F.lit(1).cast("bigint").alias("posts"), engagement().alias("engagement"), place.alias("first"), author_name(F.col("author")).alias("name")))


def tally_changes(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """What posts that arrive change in the tally of the ``stored`` ones: new posts count as in :func:`tally`, known ones
    by how much their engagement rose or fell, under the handle they are stored with."""
    key = ["web_id", "uri"]
    was = stored.select(*key, F.col("author.handle").alias("handle"), engagement().alias("was"))
    none = F.lit(None)
    known = fresh.select(*key, engagement().alias("now")).join(was, key).select("web_id", "handle", F.lit(0).cast("bigint").alias("posts"), (F.col("now") - F.col("was")).alias("engagement"), none.cast("struct<thread_ord:int,post_ord:int>").alias("first"), none.cast("string").alias("name"))
    return _summed(known.unionByName(tally(fresh.join(was.select(*key), key, "left_anti"))))


def write_part(webs: Webs, path: str, kind: str, level: int = 0, changes: DataFrame | None = None) -> Part:
    """Write the tables as a part that no snapshot names yet. Files are ranges of web_id and order, as many as the
    data fills; a large web lies in several. ``changes``: a delta's tally."""
    if (kind == "posts") != (changes is not None):
        raise ValueError("deltas, and only they, come with changes of the tally")
    spark, part = webs.webs.sparkSession, Part(uuid.uuid4().hex, kind, level)
    home = f"{path}/data/{part.name}"
    spans = []
    for name, schema in _TABLES.items():
        order = _ORDER[name]
        getattr(webs, name).repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(f"{home}/{name}")
        written = spark.read.schema(schema).parquet(f"{home}/{name}")
        file = F.substring_index("_metadata.file_path", "/", -1)
        spans.append(written.groupBy(file.alias("file")).agg(F.min("web_id").alias("low"), F.max("web_id").alias("high")).select(F.lit(name).alias("table"), "file", "low", "high"))
    (tally(webs.posts) if changes is None else changes).repartitionByRange("web_id", "handle").write.parquet(f"{home}/tally")
    spans[0].union(spans[1]).union(spans[2]).union(spans[3]).coalesce(1).write.parquet(f"{home}/index")
    return part


def _opened(spark: SparkSession, path: str, part: Part, prefix: str) -> Webs:
    """A part's tables; with a prefix only from the files whose web_ids can start with it."""
    home = f"{path}/data/{part.name}"
    if not prefix:
        return Webs(**{n: spark.read.schema(s).parquet(f"{home}/{n}") for n, s in _TABLES.items()})
    index = spark.read.schema(_INDEX).parquet(f"{home}/index")
    here = index.where((F.substring("low", 1, len(prefix)) <= prefix) & (F.col("high") >= prefix)).select("table", "file").collect()
    files = {n: [f"{home}/{n}/{r.file}" for r in here if r.table == n] for n in _TABLES}
    return Webs(**{n: spark.read.schema(s).parquet(*files[n]) if files[n] else spark.createDataFrame([], s) for n, s in _TABLES.items()})


def _over(below: Webs, part: Part, webs: Webs) -> Webs:
    if part.kind == "posts":
        more = lambda n: getattr(below, n).unionByName(getattr(webs, n))
        return Webs(more("webs"), more("threads"), merge_posts(below.posts, webs.posts), more("edges"))
    kept = lambda n: getattr(below, n).join(webs.webs.select("web_id").distinct(), "web_id", "left_anti").select(*getattr(below, n).columns)
    return Webs(**{n: kept(n).unionByName(getattr(webs, n)) for n in _TABLES})


def read_parts(spark: SparkSession, path: str, parts: tuple[Part, ...], prefix: str = "") -> Webs:
    """The webs that the parts give one after another; of a store of one part they are its files as they lie."""
    if not parts:
        return Webs(**{n: spark.createDataFrame([], s) for n, s in _TABLES.items()})
    webs = _opened(spark, path, parts[0], prefix)
    for part in parts[1:]:
        webs = _over(webs, part, _opened(spark, path, part, prefix))
    return webs if not prefix else webs.where(F.col("web_id").startswith(prefix))


def tallies(spark: SparkSession, path: str, parts: tuple[Part, ...]) -> DataFrame:
    """The tally of the webs that the parts give, summed up from theirs."""
    rows = spark.createDataFrame([], _TALLY)
    for part in parts:
        home = f"{path}/data/{part.name}"
        if part.kind == "webs":
            rows = rows.join(spark.read.schema(WEBS).parquet(f"{home}/webs").select("web_id").distinct(), "web_id", "left_anti")
        rows = rows.unionByName(spark.read.schema(_TALLY).parquet(f"{home}/tally"))
    return _summed(rows)


def add_posts(spark: SparkSession, path: str, delta: Webs, streams: dict[str, int] | None = None, stored: Webs | None = None) -> Snapshot:
    """Commit a delta: posts (one row for each URI), and threads and edges that are new. ``stored``: what the last
    snapshot has of the delta's webs, where the caller has read it."""
    before = current(spark, path)
    posts = (stored or read_parts(spark, path, before.parts)).posts
    return append(spark, path, before, write_part(delta, path, "posts", 0, tally_changes(delta.posts, posts)), streams)


def append(spark: SparkSession, path: str, before: Snapshot, part: Part, streams: dict[str, int] | None = None) -> Snapshot:
    """Commit a new part on top of ``before``. Where it makes ``FAN`` deltas of one level in a row, they become one delta
    of the next level, so n deltas are read as about log(n) parts and each is written again as often."""
    parts = (*before.parts, part)
    while len(parts) >= FAN and all(p.kind == "posts" and p.level == parts[-1].level for p in parts[-FAN:]):
        several = parts[-FAN:]
        parts = (*parts[:-FAN], write_part(read_parts(spark, path, several), path, "posts", several[0].level + 1, tallies(spark, path, several)))
    return commit(spark, path, before, parts, streams)


def compact(spark: SparkSession, path: str) -> Snapshot:
    """One part in place of all."""
    before = current(spark, path)
    return commit(spark, path, before, (write_part(read_parts(spark, path, before.parts), path, "webs"),)) if len(before.parts) > 1 else before


def vacuum(spark: SparkSession, path: str, keep: int = 1, in_use: Callable[[str], bool] = lambda name: False) -> None:
    """Delete all but the last ``keep`` snapshots and the parts that none of those names, but what ``in_use`` says is
    being written. Readers of older snapshots lose their files."""
    versions = sorted(int(n.removesuffix(".json")) for n in names_in(spark, f"{path}/snapshots") if n.endswith(".json") and not n.startswith("_"))
    held = {p[0] for v in versions[-keep:] for p in json.loads(read_file(spark, f"{path}/snapshots/{v}.json"))["parts"]}
    for version in versions[:-keep]:
        delete(spark, f"{path}/snapshots/{version}.json")
    for name in names_in(spark, f"{path}/data"):
        if name not in held and not in_use(name):
            delete(spark, f"{path}/data/{name}")
