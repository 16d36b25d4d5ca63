"""A store of webs as Parquet tables: what it holds, and looking webs up by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.ids import rkey_of
from loomgraph.schema import Webs
from loomgraph.sources.snapshots import append, current, read_parts, write_part

_NAMED = 20  # names that an error shows


class NotFound(LookupError):
    """No stored web has this name or prefix."""


class Ambiguous(LookupError):
    """Several stored webs have this prefix; ``count`` of them, the first of which ``args`` name in order.
    ``matching`` gives all."""

    def __init__(self, count: int, *names: str):
        super().__init__(*names)
        self.count = count


def save_webs(webs: Webs, path: str) -> None:
    """Write the webs; those stored under the same web_id are replaced whole, others stay. The files are new ones, and
    readers see all of the change or nothing."""
    spark = webs.webs.sparkSession
    before = current(spark, path)
    append(spark, path, before, write_part(webs, path, "webs"))


def stored_webs(spark: SparkSession, path: str, prefix: str = "") -> Webs:
    """The webs of the store's last snapshot, or those whose web_id starts with ``prefix``, for which only files that
    can hold such are read; none where nothing is stored yet."""
    return read_parts(spark, path, current(spark, path).parts, prefix)


def catalog(webs: Webs) -> DataFrame:
    """web_id, root_uri, crawled_at, posts, threads: what is stored, from the tables' own columns only."""
    posts = webs.posts.groupBy("web_id").agg(F.count_distinct("uri").alias("posts"))
    threads = webs.threads.groupBy("web_id").agg(F.count("*").alias("threads"))
    listed = webs.webs.select("web_id", F.coalesce("root_uri", F.lit("?")).alias("root_uri"), F.coalesce("crawled_at", F.lit("?")).alias("crawled_at"))
    return listed.join(posts, "web_id", "left").join(threads, "web_id", "left").na.fill(0)


def matching(webs: Webs, name: str) -> DataFrame:
    """(web_id) of the web of this name, else of all webs whose names start with it."""
    named = webs.webs.select("web_id").distinct().where(F.col("web_id").startswith(name))
    exact = named.where(F.col("web_id") == name)
    return named if exact.isEmpty() else exact


def load_web(webs: Webs, name: str) -> Webs:
    """The web of this web_id, else the only one whose web_id starts with it."""
    found = matching(webs, name)
    first = [r[0] for r in found.orderBy("web_id").limit(_NAMED).collect()]
    if not first:
        raise NotFound(name)
    if len(first) > 1:
        raise Ambiguous(len(first) if len(first) < _NAMED else found.count(), *first)
    return webs.where(F.col("web_id") == first[0])


def load_stored(spark: SparkSession, path: str, name: str) -> Webs:
    """As :func:`load_web`, from the store's files that can hold webs of that name or prefix."""
    return load_web(stored_webs(spark, path, name), name)


def fresh(cache: DataFrame, now_ms: float, window_s: int = 300, kept_s: int = 30 * 86_400) -> DataFrame:
    """Cache entries (key, stored_ms, web_id) younger than ``kept_s``: adds age_s and fresh (within ``window_s``)."""
    age = F.floor(F.greatest(F.lit(0.0), (F.lit(float(now_ms)) - F.col("stored_ms")) / 1000)).cast("bigint")
    return cache.withColumn("age_s", age).where(F.col("age_s") < kept_s).withColumn("fresh", F.col("age_s") < window_s)


def cache_key(rkey: Column) -> Column:
    """A web is cached by its root post's rkey, since an author goes by handle or DID."""
    return F.concat(F.lit("web:"), rkey)


def cached(cache: DataFrame, webs: Webs, asked: DataFrame) -> DataFrame:
    """Cache entries for the posts asked for (repo, rkey): the columns of ``asked`` and those of ``cache`` (key,
    stored_ms, web_id), where the entry's web is about that post: its root post is there, has the rkey, and its
    author has the repo as handle or DID."""
    roots = webs.webs.select("web_id", F.col("root_uri").alias("uri")).join(webs.nodes().select("web_id", "uri", "author"), ["web_id", "uri"])
    found = asked.join(cache, cache_key(F.col("rkey")) == cache["key"]).join(roots, "web_id")
    about = (rkey_of(F.col("uri")) == F.col("rkey")) & ((F.col("author.did") == F.col("repo")) | (F.col("author.handle") == F.col("repo")))
    return found.where(about).drop("uri", "author")


def put_cached(cache: DataFrame, stored: DataFrame) -> DataFrame:
    """The cache with the entries ``stored`` (key, stored_ms, web_id): of one key the one stored last stays."""
    both = cache.unionByName(stored.select(*cache.columns))
    return both.groupBy("key").agg(F.max_by(F.struct(*cache.columns), "stored_ms").alias("of")).select("of.*")
