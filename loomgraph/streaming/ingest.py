"""Continuous ingest: posts that arrive are merged into stored webs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.functions.ids import is_post_uri
from loomgraph.schema import Webs
from loomgraph.sources.snapshots import append, current, read_parts, tally_changes, write_part
from loomgraph.store import Scratch


def latest(posts: DataFrame) -> DataFrame:
    """Of the rows of one (web_id, uri) the last by web order."""
    last = F.row_number().over(Window.partitionBy("web_id", "uri").orderBy(F.desc("thread_ord"), F.desc("post_ord")))
    return posts.withColumn("_last", last).where("_last = 1").drop("_last")


def quoted_by_embed(fresh: DataFrame, stored: Webs) -> DataFrame:
    """(web_id, source, target): what new posts quote by embed among all posts, and what stored posts quote among the
    new ones, but for edges that are stored."""
    key = ["web_id", "uri"]
    quotes = lambda posts: posts.where(is_post_uri(F.col("embed_uri"))).select("web_id", F.col("embed_uri").alias("source"), F.col("uri").alias("target"))
    there = lambda posts: posts.select("web_id", F.col("uri").alias("source")).distinct()
    new = fresh.join(stored.posts.select(*key), key, "left_anti")
    ahead = quotes(new).join(there(new.select(*key).union(stored.posts.select(*key))), ["web_id", "source"], "left_semi")
    behind = quotes(stored.posts).join(there(new), ["web_id", "source"], "left_semi")
    return ahead.union(behind).distinct().join(stored.edges, ["web_id", "source", "target"], "left_anti")


def ingest(posts: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Merge a stream of posts into the store at ``path`` (as ``catalog.save_webs`` writes it): known posts get new counts,
    others are added; threads that are new to their web follow its others, as do edges to what new posts embed.

    A batch is written as a delta of its own rows and read with what is stored; nothing that is stored is written
    again but deltas, when several become one. The snapshot names the last batch of each stream (by its
    ``checkpoint``), so a batch that is run again changes nothing.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = current(spark, path)
        if before.streams.get(checkpoint, -1) >= number:
            return
        fresh = Scratch(spark, f"ingest-{number}").save(latest(batch), "batch")
        given = fresh.select("web_id").distinct()
        stored = read_parts(spark, path, before.parts)
        stored = Webs(*(t.join(given, "web_id", "left_semi") for t in (stored.webs, stored.threads, stored.posts, stored.edges)))
        top = stored.threads.groupBy("web_id").agg(F.max("thread_ord").alias("top"))
        begun = fresh.groupBy("web_id", "thread_root").agg(F.min(F.struct("thread_ord", "post_ord")).alias("at")).join(stored.threads, ["web_id", "thread_root"], "left_anti")
        place = F.row_number().over(Window.partitionBy("web_id").orderBy("at", "thread_root"))
        threads = begun.join(top, "web_id", "left").withColumn("thread_ord", (F.coalesce("top", F.lit(-1)) + place).cast("int"))
        last = stored.edges.groupBy("web_id").agg(F.max("edge_ord").alias("last"))
        behind = F.row_number().over(Window.partitionBy("web_id").orderBy("source", "target"))
        edges = quoted_by_embed(fresh, stored).withColumn("k", behind).join(last, "web_id", "left").withColumn("edge_ord", (F.coalesce("last", F.lit(-1)) + F.col("k")).cast("int"))
        roots = stored.posts.select("web_id", "uri", "thread_root").unionByName(fresh.select("web_id", "uri", "thread_root").join(stored.posts, ["web_id", "uri"], "left_anti"))
        for end in ("source", "target"):
            edges = edges.join(roots.select("web_id", F.col("uri").alias(end), F.col("thread_root").alias(f"{end}_thread")), ["web_id", end])
        delta = Webs(stored.webs.limit(0), threads.select(*stored.threads.columns), fresh.select(*stored.posts.columns), edges.select(*stored.edges.columns))
        changes = tally_changes(fresh, stored.posts)
        append(spark, path, before, write_part(delta, path, "posts", 0, changes), {**before.streams, checkpoint: number})

    writer = posts.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def events_per_window(posts: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Posts and engagement by web and window of created_at, for a stream with rows up to ``late`` behind."""
    timed = posts.withColumn("created_ts", F.try_to_timestamp("created_at")).withWatermark("created_ts", late)
    counted = timed.groupBy("web_id", F.window("created_ts", window)).agg(F.count("*").alias("posts"), F.sum(F.col("like_count") + F.col("repost_count") + F.col("quote_count")).alias("engagement"))
    return counted.select("web_id", F.col("window.start").alias("since"), "posts", "engagement")
