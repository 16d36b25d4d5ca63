"""Growth of webs: what to fetch next, and how fetched posts are merged into what is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.schema import Webs
from loomgraph.store import Scratch

COUNTS = ("like_count", "reply_count", "repost_count", "quote_count")


def known_quotes(edges: DataFrame) -> DataFrame:
    """(web_id, uri, known): quote edges stored for a post."""
    return edges.groupBy("web_id", F.col("source").alias("uri")).agg(F.count("*").alias("known"))


def pending_quotes(posts: DataFrame, before: DataFrame, scanned: DataFrame | None = None) -> DataFrame:
    """Posts whose quotes are worth fetching: not scanned yet, quoted at all, and more often than the edges of
    the crawl ``before`` account for. Adds ``known``."""
    rows = posts.where(F.col("quote_count") > 0).join(known_quotes(before), ["web_id", "uri"], "left").withColumn("known", F.coalesce("known", F.lit(0)))
    if scanned is not None:
        rows = rows.join(scanned.select("web_id", "uri"), ["web_id", "uri"], "left_anti")
    return rows.where(F.col("quote_count") > F.col("known"))


def merge_posts(stored: DataFrame, fetched: DataFrame) -> DataFrame:
    """Stored posts with the counts of the fetched ones of the same URI, all else as stored, and the posts that
    are new. ``fetched`` has one row for each (web_id, uri)."""
    fresh = fetched.select("web_id", "uri", *[F.col(c).alias(f"_{c}") for c in COUNTS])
    kept = stored.join(fresh, ["web_id", "uri"], "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in COUNTS else F.col(c) for c in stored.columns])
    return kept.unionByName(fetched.join(stored.select("web_id", "uri"), ["web_id", "uri"], "left_anti").select(*stored.columns))


def reach(webs: Webs, scratch: Scratch, max_depth: int | None = None, max_posts: int | None = None) -> DataFrame:
    """(web_id, uri, depth): posts that a crawl from the root post reaches, with the depth of the job that finds them.

    ``webs`` stands for the network. A round fetches the frontier's whole threads, then the quotes of the posts
    found; a quoting post is found at its job's depth and its thread is fetched one deeper. Threads deeper than
    ``max_depth`` are not fetched, though the posts that quote into them are found. A web that has ``max_posts``
    starts no further round; a round that has begun is finished.
    """
    posts = webs.posts.select("web_id", "uri", "thread_root")
    quotes = webs.edges.select("web_id", F.col("source").alias("uri"), F.col("target").alias("by")).distinct()
    jobs = webs.webs.select("web_id", F.col("root_uri").alias("uri")).join(posts, ["web_id", "uri"]).select("web_id", "thread_root")
    found = visited = None
    depth = 0
    while True:
        fetched = jobs.join(posts, ["web_id", "thread_root"]).select("web_id", "uri", F.lit(depth).alias("depth"))
        round_ = fetched if found is None else fetched.join(found, ["web_id", "uri"], "left_anti")
        # a quoting post that was found before its thread was fetched has its own quotes fetched now
        quoting = scratch.save(fetched.join(quotes, ["web_id", "uri"]).select("web_id", F.col("by").alias("uri"), "depth").distinct(), "quoting")
        known = round_ if found is None else found.unionByName(round_)
        found = scratch.save(known.unionByName(quoting.join(known, ["web_id", "uri"], "left_anti")), "found")
        visited = jobs if visited is None else visited.union(jobs)
        depth += 1
        if max_depth is not None and depth > max_depth:
            return found
        after = quoting.join(posts, ["web_id", "uri"]).select("web_id", "thread_root").distinct().join(visited, ["web_id", "thread_root"], "left_anti")
        if max_posts is not None:
            after = after.join(found.groupBy("web_id").agg(F.count("*").alias("n")).where(F.col("n") < max_posts), "web_id", "left_semi")
        jobs = scratch.save(after, "jobs")
        visited = scratch.save(visited, "visited")
        if jobs.isEmpty():
            return found


def link_facets(posts: DataFrame) -> DataFrame:
    """(web_id, uri, quoted): posts that a post's text links to, each once; not the post it embeds nor itself."""
    from loomgraph.functions.ids import post_uri_from_link

    links = posts.select("web_id", "uri", "embed_uri", F.explode(F.flatten(F.transform("facets", lambda f: f["features"]))).alias("f")).where("f.type = 'link'")
    quoted = links.select("web_id", "uri", "embed_uri", post_uri_from_link(F.col("f.uri")).alias("quoted")).where("quoted is not null")
    return quoted.where((F.col("quoted") != F.col("uri")) & ~F.col("quoted").eqNullSafe(F.col("embed_uri"))).select("web_id", "uri", "quoted").distinct()
