"""The parameterised questions about webs, each as a DataFrame of typed columns keyed by web_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import author_name, engagement, truncate
from loomgraph.operators.graph import child_edges, ordered_walk, post_index, thread_hops, tree_roots
from loomgraph.plans.numbering import chronological, top
from loomgraph.schema import Webs
from loomgraph.store import Scratch

def _place() -> Column:
    return F.struct("thread_ord", "post_ord")


def counts(webs: Webs) -> DataFrame:
    """posts (distinct URIs), threads (empty ones too), reply_edges, quote_edges (as stored), total_edges."""
    posts = webs.posts.groupBy("web_id").agg(F.count_distinct("uri").alias("posts"), F.count_if(F.col("reply_parent").isNotNull()).alias("reply_edges"))
    threads = webs.threads.groupBy("web_id").agg(F.count("*").alias("threads"))
    quotes = webs.edges.groupBy("web_id").agg(F.count("*").alias("quote_edges"))
    out = webs.webs.select("web_id").join(posts, "web_id", "left").join(threads, "web_id", "left").join(quotes, "web_id", "left").na.fill(0)
    return out.withColumn("total_edges", F.col("reply_edges") + F.col("quote_edges"))


def time_span(webs: Webs) -> DataFrame:
    """earliest and latest created_at as text, empty ones aside; null where there are none."""
    told = webs.posts.where("created_at <> ''")
    return told.groupBy("web_id").agg(F.min("created_at").alias("earliest"), F.max("created_at").alias("latest"))


def thread_sizes(webs: Webs) -> DataFrame:
    """Posts of each thread; an empty thread has 0."""
    sizes = webs.posts.groupBy("web_id", "thread_ord").agg(F.count("*").alias("size"))
    return webs.threads.join(sizes, ["web_id", "thread_ord"], "left").na.fill(0, ["size"])


def thread_size_histogram(webs: Webs) -> DataFrame:
    """bucket, threads in it, total_threads: four fixed buckets, those without threads too."""
    size = F.col("size")
    bounds = {"1 post": size == 1, "2-10 posts": size.between(2, 10), "11-100 posts": size.between(11, 100), "100+ posts": size > 100}
    sums = thread_sizes(webs).groupBy("web_id").agg(F.count("*").alias("total_threads"), F.max("size").alias("largest"), *[F.count_if(c).alias(f"b{k}") for k, c in enumerate(bounds.values())])
    rows = F.array(*[F.struct(F.lit(k).alias("pos"), F.lit(b).alias("bucket"), F.col(f"b{k}").alias("threads")) for k, b in enumerate(bounds)])
    return sums.select("web_id", "total_threads", "largest", F.inline(rows))


def _by_handle(webs: Webs, name: str, total: Column) -> DataFrame:
    """(web_id, handle, ``name``, first, name): ``total`` of each handle's posts, the place of the first and the
    author's name there. Posts are summed by handle and name in hash tables, without a sort: a place is one number."""
    rows = webs.posts.select("web_id", F.col("author.handle").alias("handle"), author_name(F.col("author")).alias("name"), total.alias("total"), (F.shiftleft(F.col("thread_ord").cast("bigint"), 32) + F.col("post_ord")).alias("first"))
    each = rows.groupBy("web_id", "handle", "name").agg(F.sum("total").alias("total"), F.min("first").alias("first"))
    return each.groupBy("web_id", "handle").agg(F.sum("total").alias(name), F.min("first").alias("first"), F.min_by("name", "first").alias("name"))


def top_authors(webs: Webs, k: int = 10) -> DataFrame:
    """rnk, handle, name (as on the handle's first post), posts: most posts first, then first appearance."""
    return top(_by_handle(webs, "posts", F.lit(1)), k, F.desc("posts"), "first").select("web_id", "rnk", "handle", "name", "posts")


def main_characters(webs: Webs, k: int = 10) -> DataFrame:
    """rnk, handle, name, engagement: the handles whose posts drew most likes, reposts and quotes."""
    return top(_by_handle(webs, "engagement", engagement()), k, F.desc("engagement"), "first").select("web_id", "rnk", "handle", "name", "engagement")


def leading_authors(tallies: DataFrame, by: str, k: int = 10) -> DataFrame:
    """As :func:`top_authors` (``by`` posts) or :func:`main_characters` (``by`` engagement), from a store's tallies."""
    return top(tallies.where("posts > 0"), k, F.desc(by), "first").select("web_id", "rnk", "handle", "name", by)


def top_posts(webs: Webs, k: int = 10) -> DataFrame:
    """The posts with the highest engagement, in web order where equal."""
    return top(webs.posts.withColumn("engagement", engagement()), k, F.desc("engagement"), "thread_ord", "post_ord")


def most_quoted(webs: Webs, k: int = 10) -> DataFrame:
    """rnk, uri, n: posts of the web by the quote edges that start at them, then first edge; missing posts don't count."""
    sources = webs.edges.groupBy("web_id", F.col("source").alias("uri")).agg(F.count("*").alias("n"), F.min("edge_ord").alias("first"))
    return _ranked(webs, sources, k)


def most_replied(webs: Webs, k: int = 10) -> DataFrame:
    """rnk, uri, n: posts of the web by the replies that it holds, then first reply."""
    replied = webs.posts.where("reply_parent is not null").groupBy("web_id", F.col("reply_parent").alias("uri")).agg(F.count("*").alias("n"), F.min(_place()).alias("first"))
    return _ranked(webs, replied, k)


def _ranked(webs: Webs, counted: DataFrame, k: int) -> DataFrame:
    """Of the counts (web_id, uri, n, first) of posts of the web the ``k`` largest, with the posts' columns: these
    are looked up last."""
    best = top(counted.join(webs.posts.select("web_id", "uri"), ["web_id", "uri"], "left_semi"), k, F.desc("n"), "first")
    return best.join(webs.at(best).nodes(), ["web_id", "uri"])


def threads_by_size(webs: Webs, k: int = 20) -> DataFrame:
    """rnk, thread_root, rep_uri (the root post, else the first), posts, engagement, total (threads with posts)."""
    root = F.when(F.col("uri") == F.col("thread_root"), _place())
    best = F.coalesce(F.min_by(F.struct("uri", "author", "text"), root), F.min_by(F.struct("uri", "author", "text"), _place()))
    by = webs.posts.groupBy("web_id", "thread_ord").agg(F.min("thread_root").alias("thread_root"), F.count("*").alias("posts"), F.sum(engagement()).alias("engagement"), best.alias("rep"))
    total = by.groupBy("web_id").agg(F.count("*").alias("total"))
    return top(by, k, F.desc("posts"), "thread_ord").join(total, "web_id").select("web_id", "rnk", "thread_root", F.col("rep.uri").alias("rep_uri"), "rep", "posts", "engagement", "total")


def _referred(posts: DataFrame, nodes: DataFrame, numbers: DataFrame | None = None) -> DataFrame:
    """Add the handle of the post replied to and of the post quoted, where the web has them, and their numbers."""
    for what, uri in (("reply", "reply_parent"), ("quote", "embed_uri")):
        known = nodes.select("web_id", F.col("uri").alias(uri), F.col("author.handle").alias(f"{what}_handle"))
        posts = posts.join(known, ["web_id", uri], "left")
        if numbers is not None:
            posts = posts.join(numbers.select("web_id", F.col("uri").alias(uri), F.col("n").alias(f"{what}_n")), ["web_id", uri], "left")
    return posts


def linear(webs: Webs) -> DataFrame:
    """All posts by time: n of total, and handle and number of the posts they reply to and quote."""
    numbered = chronological(webs.nodes())
    return _referred(numbered, webs.nodes("author"), numbered)


def timeline(webs: Webs, after: str | None = None, before: str | None = None) -> DataFrame:
    """As :func:`linear` within after <= created_at < before, numbered there; what is referred to outside has a
    handle and no number. An empty bound is none."""
    inside = F.lit(True)
    if after:
        inside = inside & (F.col("created_at") >= after)
    if before:
        inside = inside & (F.col("created_at") < before)
    # the scan drops what lies outside; of a post that the web has twice, the last decides
    numbered = chronological(webs.at(webs.posts.where(inside)).nodes().where(inside))
    return _referred(numbered, webs.nodes("author"), numbered)


def author_posts(webs: Webs) -> DataFrame:
    """Every post with its author's did, k (its number among the author's posts) and global_n."""
    nodes = webs.nodes().withColumn("did", F.col("author.did"))
    numbered = chronological(nodes, name="global_n").drop("total")
    return _referred(chronological(numbered, ["web_id", "did"], "k").drop("total"), webs.nodes("author"))


def author_roster(webs: Webs, scratch: Scratch) -> DataFrame:
    """pos, did, name (as on the author's earliest post), posts, thread_starter, joined_via_quote: by first post."""
    nodes = webs.nodes("author", "created_at").withColumn("did", F.col("author.did"))
    when = F.struct("created_at", "thread_ord", "post_ord")
    by = nodes.groupBy("web_id", "did").agg(F.count("*").alias("posts"), F.min(_place()).alias("seen"), F.min("created_at").alias("since"), F.min_by(F.struct(author_name(F.col("author")).alias("name"), "uri"), when).alias("first"))
    starters = tree_roots(webs, scratch).join(nodes.select("web_id", F.col("uri").alias("root_uri"), "did"), ["web_id", "root_uri"]).select("web_id", "did", F.lit(True).alias("starter"))
    targets = webs.edges.select("web_id", F.col("target").alias("first_uri"), F.lit(True).alias("quoting")).distinct()
    named = by.select("web_id", "did", "posts", "seen", "since", "first.name", F.col("first.uri").alias("first_uri")).join(starters, ["web_id", "did"], "left").join(targets, ["web_id", "first_uri"], "left")
    # authors are numbered by the hour of their first post, as posts are
    placed = chronological(named.select("*", F.col("since").alias("created_at"), F.col("seen.thread_ord").alias("thread_ord"), F.col("seen.post_ord").alias("post_ord")), name="pos")
    return placed.select("web_id", "pos", "did", "name", "posts", F.coalesce("starter", F.lit(False)).alias("thread_starter"), F.coalesce("quoting", F.lit(False)).alias("joined_via_quote"))


def _contains(column: Column, part: str) -> Column:
    return F.contains(F.lower(column), F.lower(F.lit(part)))


def search(webs: Webs, query: str | None = None, author: str | None = None, among: DataFrame | None = None) -> DataFrame:
    """n, post, thread_size, snippet: posts whose text and whose handle contain what is asked, in either case, by
    time. Without criteria no rows. ``among`` (web_id, uri), as ``postings.candidates`` gives it, says which posts alone
    can match the query."""
    found = webs.posts if among is None else webs.at(among).posts
    if query:
        found = found.where(_contains(F.col("text"), query))
    if author:
        found = found.where(_contains(F.col("author.handle"), author))
    if not query and not author:
        found = found.where("false")
    sizes = webs.posts.groupBy("web_id", F.col("thread_root").alias("in_thread")).agg(F.count("*").alias("thread_size"))
    index = post_index(webs).withColumnRenamed("thread_root", "in_thread")
    rows = chronological(found).join(index, ["web_id", "uri"]).join(sizes, ["web_id", "in_thread"])
    return _referred(rows, webs.nodes("author")).withColumn("snippet", truncate(F.col("text"), 120))


def root_threads(webs: Webs) -> DataFrame:
    """(web_id, thread_root) of the web's root post, where the web has it."""
    return webs.webs.select("web_id", F.col("root_uri").alias("uri")).join(post_index(webs), ["web_id", "uri"]).select("web_id", "thread_root")


def hop_histogram(webs: Webs, scratch: Scratch) -> DataFrame:
    """dist, posts: posts by their threads' quote hops from the root's thread; -1 for those out of reach."""
    sizes = webs.posts.groupBy("web_id", "thread_root").agg(F.count("*").alias("size"))
    near = thread_hops(webs.edges, root_threads(webs), scratch).join(sizes, ["web_id", "thread_root"])
    reached = near.groupBy("web_id", "dist").agg(F.sum("size").alias("posts"))
    total = webs.posts.groupBy("web_id").agg(F.count_distinct("uri").alias("all"))
    far = reached.groupBy("web_id").agg(F.sum("posts").alias("near")).join(total, "web_id").select("web_id", F.lit(-1).alias("dist"), (F.col("all") - F.col("near")).alias("posts"))
    return reached.unionByName(far.where("posts > 0"))


def neighborhood(webs: Webs, scratch: Scratch, hops: int = 2, uri: str | None = None) -> DataFrame:
    """The nodes of threads within ``hops`` quote hops of the target's thread, with dist. The target is ``uri`` or
    each web's root."""
    starts = root_threads(webs) if not uri else post_index(webs).where(F.col("uri") == uri).select("web_id", "thread_root")
    near = thread_hops(webs.edges, starts, scratch, hops)
    return webs.nodes().join(near, ["web_id", "thread_root"])


def neighborhood_walk(webs: Webs, scratch: Scratch, hops: int = 2, uri: str | None = None) -> DataFrame:
    """The neighbourhood in the order of a walk from the tree's root if it is inside, else from the target."""
    nodes = scratch.save(neighborhood(webs, scratch, hops, uri), "near")
    roots = tree_roots(webs, scratch).join(nodes.select("web_id", F.col("uri").alias("root_uri")), ["web_id", "root_uri"]).select("web_id", "root_uri")
    target = webs.webs.select("web_id", (F.lit(uri) if uri else F.col("root_uri")).alias("target"))
    starts = target.join(roots, "web_id", "left").select("web_id", F.coalesce("root_uri", "target").alias("root_uri"))
    return ordered_walk(nodes, child_edges(nodes, webs.edges), starts, scratch)


def tree(webs: Webs, scratch: Scratch) -> DataFrame:
    """All posts as a depth-first walk: seq, section, depth, tag, uri; replies before quotes."""
    nodes = webs.nodes("created_at", "reply_parent")
    return ordered_walk(nodes, child_edges(nodes, webs.edges), tree_roots(webs, scratch), scratch)
