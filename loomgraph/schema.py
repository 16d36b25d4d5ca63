"""The tables of a set of conversation webs.

A web is one conversation: threads (reply trees) and the quote edges between them. All tables are keyed by
web_id, so that any number of webs is processed at once. Row order is data: thread_ord and post_ord give a
post's place in its web ("web order"), edge_ord that of a quote edge.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.store import Scratch

AUTHOR = "struct<did:string,handle:string,display_name:string>"
FACETS = "array<struct<index:struct<byteStart:bigint,byteEnd:bigint>,features:array<struct<type:string,did:string,uri:string,tag:string>>>>"
WEBS = "web_id string, root_uri string, crawled_at string, format_version int"
THREADS = "web_id string, thread_ord int, thread_root string"
POSTS = (
    f"web_id string, thread_ord int, post_ord int, thread_root string, uri string, cid string, author {AUTHOR}, text string, "
    "created_at string, reply_parent string, reply_root string, embed_type string, embed_uri string, "
    f"facets {FACETS}, labels array<string>, langs array<string>, "
    "like_count bigint, reply_count bigint, repost_count bigint, quote_count bigint"
)
QUOTE_EDGES = "web_id string, edge_ord int, source string, target string, source_thread string, target_thread string"


@dataclass(frozen=True)
class Webs:
    """The four tables of a set of webs. ``threads`` also holds threads without posts."""

    webs: DataFrame
    threads: DataFrame
    posts: DataFrame
    edges: DataFrame

    def nodes(self, *columns: str) -> DataFrame:
        """Posts, one for each (web_id, uri): the first one's place with the last one's values. ``columns`` names
        the values that are wanted, all where none is named; others are not read."""
        place = F.struct("thread_ord", "post_ord")
        other = [c for c in self.posts.columns if c not in ("web_id", "uri", "thread_ord", "post_ord") and (not columns or c in columns)]
        last = F.max_by(F.struct(*other), place).alias("last")
        one = self.posts.groupBy("web_id", "uri").agg(F.min(place).alias("first"), last)
        return one.select("web_id", "uri", "first.thread_ord", "first.post_ord", "last.*")

    def saved(self, scratch: Scratch) -> Webs:
        """The webs written once, so that what reads them again doesn't compute them again."""
        return Webs(*(scratch.save(getattr(self, n), n) for n in ("webs", "threads", "posts", "edges")))

    def at(self, uris: DataFrame) -> Webs:
        """The webs with only the posts of ``uris`` (web_id, uri)."""
        return Webs(self.webs, self.threads, self.posts.join(uris.select("web_id", "uri"), ["web_id", "uri"], "left_semi"), self.edges)

    def where(self, condition) -> Webs:
        """The webs that meet a condition on web_id."""
        return Webs(*(t.where(condition) for t in (self.webs, self.threads, self.posts, self.edges)))
