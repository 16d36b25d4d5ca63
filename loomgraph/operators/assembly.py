"""From network responses to webs: threads placed and merged, handles resolved, quotes linked.

Responses are numbered by ``job``, the order in which they were fetched. All of a batch is placed by joins on
(web_id, uri); what is ordered by a window is one thread's posts, or the threads and edges new in the batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.ids import is_post_uri, post_uri_from_link, split_at_uri
from loomgraph.operators.graph import normalized_edges
from loomgraph.operators.recrawl import COUNTS
from loomgraph.schema import Webs
from loomgraph.store import Scratch

_KEY = ["web_id", "uri"]


def handle_dids(posts: DataFrame) -> DataFrame:
    """(web_id, handle, did): for each author's handle the DID seen last (``job``, ``ord``)."""
    return posts.groupBy("web_id", F.col("author.handle").alias("handle")).agg(F.max_by("author.did", F.struct("job", "ord")).alias("did"))


def resolved(table: DataFrame, column: str, dids: DataFrame, posts: DataFrame) -> DataFrame:
    """``table`` (with web_id) with the URIs in ``column`` by DID where they name a known author by handle and
    the URI so made is a post's; all others as they are."""
    at = split_at_uri(F.col(column))
    known = dids.select(F.col("web_id").alias("_web"), F.col("handle").alias("_handle"), F.col("did").alias("_did"))
    named = table.join(known, (F.col("web_id") == F.col("_web")) & (at["authority"] == F.col("_handle")) & ~at["authority"].startswith("did:"), "left").drop("_web", "_handle")
    named = named.withColumn("_canonical", F.concat(F.lit("at://"), "_did", F.lit("/"), at["collection"], F.lit("/"), at["rkey"]))
    uris = posts.select(*_KEY).distinct()
    for alias, by in (("_as_is", column), ("_there", "_canonical")):
        mark = uris.select(F.col("web_id").alias("_web"), F.col("uri").alias("_uri"), F.lit(True).alias(alias))
        named = named.join(mark, (F.col("web_id") == F.col("_web")) & (F.col(by) == F.col("_uri")), "left").drop("_web", "_uri")
    use = F.col("_as_is").isNull() & F.col("_there").isNotNull()
    return named.withColumn(column, F.when(use, F.col("_canonical")).otherwise(F.col(column))).select(*table.columns)


def _final_roots(arrived: DataFrame, responses: DataFrame, scratch: Scratch) -> DataFrame:
    """(web_id, root, now, moved): the root under which a thread stands in the end, and the job that moved it.

    A response that holds a post of another thread takes that thread over, the one of the first such post; so
    do later responses. Threads so joined end under the root of the latest response.
    """
    roots = arrived.select("web_id", F.col("base").alias("root")).union(responses.select("web_id", "response_root")).distinct()
    fetched = responses.groupBy("web_id", F.col("response_root").alias("root")).agg(F.max("job").alias("job"))
    state = roots.join(fetched, ["web_id", "root"], "left").select("web_id", "root", F.struct(F.coalesce("job", F.lit(-1)).alias("job"), F.col("root").alias("now")).alias("best"))
    state = scratch.save(state, "roots")
    earlier = responses.join(arrived.select(*_KEY, "base", F.col("first.job").alias("since")), _KEY).where("since < job")
    taken = earlier.groupBy("web_id", "job", "response_root").agg(F.min_by("base", "ord").alias("base")).where("base <> response_root")
    ways = taken.select("web_id", F.col("base").alias("root"), F.col("response_root").alias("other"))
    ways = scratch.save(ways.union(ways.select("web_id", "other", "root")).distinct(), "ways")
    while True:
        offers = ways.join(state, ["web_id", "root"]).groupBy("web_id", F.col("other").alias("root")).agg(F.max("best").alias("offer"))
        after = state.join(offers, ["web_id", "root"], "left").withColumn("better", F.coalesce(F.col("offer") > F.col("best"), F.lit(False)))
        after = scratch.save(after.select("web_id", "root", F.when(F.col("better"), F.col("offer")).otherwise(F.col("best")).alias("best"), "better"), "roots")
        state = after.drop("better")
        if after.where("better").isEmpty():
            return state.select("web_id", "root", "best.now", F.col("best.job").alias("moved"))


def _linked(responses: DataFrame, dids: DataFrame, posts: DataFrame) -> DataFrame:
    """(web_id, source, target, job, ord, pos): what fetched posts quote, by their embed and by links in their
    text; not a post itself, nor by a link what it embeds."""
    embeds = responses.where(is_post_uri(F.col("embed_uri"))).select("web_id", F.col("embed_uri").alias("source"), F.col("uri").alias("target"), "job", "ord", F.lit(-1).alias("pos"))
    embeds = resolved(embeds, "source", dids, posts)
    features = F.flatten(F.transform("facets", lambda f: f["features"]))
    links = responses.select("web_id", "uri", "job", "ord", F.posexplode(features).alias("pos", "f")).where("f.type = 'link'")
    links = links.select("web_id", post_uri_from_link(F.col("f.uri")).alias("source"), F.col("uri").alias("target"), "job", "ord", "pos").where("source is not null")
    links = resolved(links, "source", dids, posts).where("source <> target")
    return embeds.unionByName(links.join(embeds.select("web_id", "target", "source", "job"), ["web_id", "target", "source", "job"], "left_anti"))


def assemble(stored: Webs, threads: DataFrame, quotes: DataFrame, scratch: Scratch) -> Webs:
    """The webs after a batch of responses.

    ``stored``: what is known; ``webs`` holds every web, also one without posts yet, and its root_uri may name
    an author by handle. ``threads``: rows of ``wire.thread_posts``; ``quotes``: rows of ``wire.quoting_posts``;
    rows with an error are left out. A post is placed by its first arrival and keeps that text; counts are
    those of the last thread response that shows it. A quoting post not known before opens or joins the thread
    of its reply_root, else its own, and is linked to the post it was asked for. New threads, posts and edges
    follow the stored ones; edges end up normalised, with both ends in the web.
    """
    responses = scratch.save(threads.where("error is null"), "responses")
    pages = scratch.save(quotes.where("error is null"), "pages")
    other = [c for c in stored.posts.columns if c not in (*_KEY, "thread_ord", "post_ord", "thread_root")]
    old = stored.posts.select(*_KEY, F.col("thread_root").alias("base"), F.struct(F.lit(-1).cast("bigint").alias("job"), F.col("thread_ord").alias("a"), F.col("post_ord").alias("b")).alias("first"), F.struct(*other).alias("of"))
    came = lambda rows, base, kind: rows.select(*_KEY, base.alias("base"), F.struct("job", F.lit(kind).alias("a"), F.col("ord").alias("b")).alias("first"), F.struct(*other).alias("of"))
    all_ = old.unionByName(came(responses, F.col("response_root"), 0)).unionByName(came(pages, F.coalesce("reply_root", "uri"), 1))
    arrived = all_.groupBy(*_KEY).agg(F.min(F.struct("first", "base")).alias("at"), F.min_by("of", "first").alias("of")).select(*_KEY, "at.first", "at.base", "of")
    arrived = scratch.save(arrived, "arrived")
    roots = _final_roots(arrived, responses, scratch)

    fresh = responses.groupBy(*_KEY).agg(F.max_by(F.struct(*COUNTS), F.struct("job", "ord")).alias("fresh"))
    placed = arrived.join(roots, [arrived["web_id"] == roots["web_id"], arrived["base"] == roots["root"]]).drop(roots["web_id"]).join(fresh, _KEY, "left")
    moved = (F.col("first.job") < 0) & (F.col("base") != F.col("now"))
    place = F.struct(F.when(moved, F.col("moved")).otherwise(F.col("first.job")).alias("job"), F.when(moved, 0).otherwise(1).alias("late"), F.col("first.a").alias("a"), F.col("first.b").alias("b"))
    placed = placed.withColumn("place", place)

    top = stored.threads.groupBy("web_id").agg(F.max("thread_ord").alias("top"))
    named = stored.threads.select("web_id", F.col("thread_root").alias("root"), "thread_ord").join(roots, ["web_id", "root"], "left")
    kept = named.where("now is null or now = root").select("web_id", F.col("root").alias("thread_root"), "thread_ord")
    begun = placed.groupBy("web_id", F.col("now").alias("thread_root")).agg(F.min("place").alias("begun")).join(kept, ["web_id", "thread_root"], "left_anti")
    ahead = F.row_number().over(Window.partitionBy("web_id").orderBy("begun"))
    new = begun.join(top, "web_id", "left").select("web_id", "thread_root", (F.coalesce("top", F.lit(-1)) + ahead).cast("int").alias("thread_ord"))
    after = scratch.save(kept.unionByName(new).select(*stored.threads.columns), "threads")

    at = (F.row_number().over(Window.partitionBy("web_id", "now").orderBy("place", "uri")) - 1).cast("int")
    values = [F.coalesce(f"fresh.{c}", f"of.{c}").alias(c) if c in COUNTS else F.col(f"of.{c}").alias(c) for c in other]
    posts = placed.select(*_KEY, F.col("now").alias("thread_root"), at.alias("post_ord"), *values).join(after, ["web_id", "thread_root"])
    posts = scratch.save(posts.select(*stored.posts.columns), "posts")

    # of the stored posts of a handle the last in web order counts
    place = F.col("first.a").cast("bigint") * (1 << 31) + F.col("first.b")
    seen = old.select("web_id", F.col("of.author").alias("author"), F.col("first.job").alias("job"), place.alias("ord"))
    dids = handle_dids(seen.unionByName(responses.select("web_id", "author", "job", "ord")).unionByName(pages.select("web_id", "author", "job", "ord")))
    quoting = pages.join(arrived.select(*_KEY, "first"), _KEY).where((F.col("first.job") == F.col("job")) & (F.col("first.a") == 1)).select("web_id", F.col("asked").alias("source"), F.col("uri").alias("target"), "job", "ord", F.lit(0).alias("pos"))
    linked = _linked(responses, dids, posts).unionByName(quoting)
    last = stored.edges.groupBy("web_id").agg(F.max("edge_ord").alias("last"))
    number = F.row_number().over(Window.partitionBy("web_id").orderBy("job", "ord", "pos", "source", "target"))
    null = F.lit(None).cast("string")
    fresh_edges = linked.withColumn("k", number).join(last, "web_id", "left").select("web_id", (F.coalesce("last", F.lit(-1)) + F.col("k")).cast("int").alias("edge_ord"), "source", "target", null.alias("source_thread"), null.alias("target_thread"))
    edges = stored.edges.unionByName(fresh_edges)
    for end in ("source", "target"):
        edges = resolved(edges, end, dids, posts)
    webs = resolved(stored.webs, "root_uri", dids, posts)
    edges = normalized_edges(Webs(webs, after, posts, edges)).select(*stored.edges.columns)
    return Webs(webs, after, posts, scratch.save(edges, "edges"))


def stop_reason(elapsed_s: Column, deadline_s: float, posts: Column, max_posts: int) -> Column:
    """Why a crawl ended, and whether it may start another job: only a complete one found all there is."""
    return F.when(elapsed_s > deadline_s, "timeout").when(posts >= max_posts, "max_nodes").otherwise("complete")


def put_threads(webs: Webs, posts: DataFrame) -> Webs:
    """The webs with the threads of ``posts`` (columns of posts) in place of those of the same root; a thread of
    a new root follows the others."""
    given = posts.select("web_id", "thread_root").distinct()
    rest = webs.posts.join(given, ["web_id", "thread_root"], "left_anti")
    threads = _threads_with(webs, given)
    placed = posts.drop("thread_ord").join(threads, ["web_id", "thread_root"]).select(*webs.posts.columns)
    return Webs(webs.webs, threads, rest.unionByName(placed), webs.edges)


def drop_threads(webs: Webs, roots: DataFrame) -> Webs:
    """The webs without the threads of ``roots`` (web_id, thread_root); the others keep their order."""
    gone = roots.select("web_id", "thread_root").distinct()
    left = lambda t: t.join(gone, ["web_id", "thread_root"], "left_anti").select(*t.columns)
    return Webs(webs.webs, left(webs.threads), left(webs.posts), webs.edges)


def put_posts(webs: Webs, posts: DataFrame) -> Webs:
    """The webs with ``posts`` put into their threads, which are made where missing: a post that its thread holds
    has new values in its old place, another follows, in the order of its post_ord. One row for each
    (web_id, thread_root, uri)."""
    key = ["web_id", "thread_root", "uri"]
    threads = _threads_with(webs, posts.select("web_id", "thread_root").distinct())
    places = webs.posts.select(*key, F.col("post_ord").alias("old"))
    last = webs.posts.groupBy("web_id", "thread_root").agg(F.max("post_ord").alias("last"))
    behind = F.row_number().over(Window.partitionBy("web_id", "thread_root").orderBy(F.col("old").isNotNull(), "post_ord", "uri"))
    given = posts.drop("thread_ord").join(places, key, "left").join(last, ["web_id", "thread_root"], "left").withColumn("k", behind)
    given = given.withColumn("post_ord", F.coalesce("old", F.coalesce("last", F.lit(-1)) + F.col("k")).cast("int"))
    kept = webs.posts.join(posts.select(*key), key, "left_anti").select(*webs.posts.columns)
    return Webs(webs.webs, threads, kept.unionByName(given.join(threads, ["web_id", "thread_root"]).select(*webs.posts.columns)), webs.edges)


def _threads_with(webs: Webs, roots: DataFrame) -> DataFrame:
    """The threads, and those of the roots (web_id, thread_root) that are new, behind them by name."""
    top = webs.threads.groupBy("web_id").agg(F.max("thread_ord").alias("top"))
    new = roots.join(webs.threads, ["web_id", "thread_root"], "left_anti").join(top, "web_id", "left")
    k = F.row_number().over(Window.partitionBy("web_id").orderBy("thread_root"))
    return webs.threads.unionByName(new.select("web_id", (F.coalesce("top", F.lit(-1)) + k).cast("int").alias("thread_ord"), "thread_root"))
