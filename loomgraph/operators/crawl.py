"""Crawls as rounds of jobs: what the responses so far ask for next is fetched, until nothing is left or a limit is met.

A round fetches the threads that are due, then the quotes of the posts found. Each of its tables is written once and
only new rows are compared with what is known; :meth:`Crawl.webs` puts all responses together at the end.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.ids import is_post_uri, post_uri_from_link
from loomgraph.operators.assembly import assemble, handle_dids, resolved, stop_reason
from loomgraph.operators.recrawl import known_quotes
from loomgraph.schema import Webs
from loomgraph.sources import wire
from loomgraph.store import Scratch

_KEY = ["web_id", "uri"]
#: Jobs (web_id, uri, job) to their responses (web_id, uri, job, body; of quotes also page; and error where one failed).
Fetch = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Crawl:
    """How a crawl ended: what it was told (``stored``, ``responses``, ``pages``); ``found`` (web_id, uri, depth), the posts that weren't stored with the quote
    hops of the job that met them; ``jobs`` (web_id, kind, uri, depth, state), kind being threads or quotes, state done,
    failed, partial or pending; ``stops`` (web_id, reason, posts, pending)."""

    stored: Webs
    responses: DataFrame
    pages: DataFrame
    found: DataFrame
    jobs: DataFrame
    stops: DataFrame
    now: str | None = None

    def webs(self, scratch: Scratch) -> Webs:
        """The webs as all responses leave them."""
        webs = assemble(self.stored, self.responses, self.pages, scratch)
        return webs if self.now is None else replace(webs, webs=webs.webs.withColumn("crawled_at", F.lit(self.now)))


def answers(table: DataFrame) -> Fetch:
    """Fetches from a table of responses by (web_id, uri), as kept from a network or made beforehand."""
    return lambda jobs: jobs.join(table, _KEY)


def _number(round_: int, kind: str) -> Column:
    """A job's number: by round, threads before quotes, then any order that doesn't depend on partitions."""
    return F.lit((2 * round_ + (kind == "quotes")) << 40) + F.shiftrightunsigned(F.xxhash64("uri"), 24)


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def links_to(posts: DataFrame) -> DataFrame:
    """(web_id, wanted): posts that the embeds and links of ``posts`` name, as they name them; not a post itself."""
    embeds = posts.where(is_post_uri(F.col("embed_uri"))).select("web_id", F.col("embed_uri").alias("wanted"))
    features = F.flatten(F.transform("facets", lambda f: f["features"]))
    links = posts.select("web_id", "uri", F.explode(features).alias("f")).where("f.type = 'link'")
    links = links.select("web_id", "uri", post_uri_from_link(F.col("f.uri")).alias("wanted")).where("wanted <> uri")
    return embeds.union(links.select("web_id", "wanted")).distinct()


def next_threads(posts: DataFrame, quoting: DataFrame, known: DataFrame, dids: DataFrame) -> DataFrame:
    """(web_id, uri): threads that a round's responses ask for: of what fetched ``posts`` name and ``known`` (web_id,
    uri) lacks, also when a handle is read as a DID; and of the ``quoting`` posts that are new."""
    named = links_to(posts).withColumn("uri", F.col("wanted"))
    missing = resolved(named, "uri", dids, known).join(known.select(*_KEY), _KEY, "left_anti").select("web_id", F.col("wanted").alias("uri"))
    return missing.union(quoting.select("web_id", F.coalesce("reply_root", "uri"))).distinct()


def crawl(stored: Webs, threads: Fetch, quotes: Fetch, scratch: Scratch, max_depth: int | None = None, max_posts: int | None = None, deadline_s: float | None = None, now: str | None = None, clock: Callable[[], float] = time.monotonic) -> Crawl:
    """Crawl every web of ``stored.webs`` from its root_uri, through replies and quotes.

    A thread is fetched once, unless its post came with another thread. After a round's threads every post not
    scanned yet, of the stored ones too, has its quotes fetched if it is quoted more often than the stored edges
    account for. Posts that fetched ones embed or link to, and threads of quoting posts, are due in the next round,
    whose depth is one more; none is beyond ``max_depth``. A web of ``max_posts`` posts starts no further half of a
    round; after ``deadline_s`` none does, and what is due stays pending. ``now`` becomes the webs' crawled_at.
    A job without a response, or with an error, has failed and isn't tried again. All of this is driven by counts:
    the driver sees no row.
    """
    began, late = clock(), lambda: deadline_s is not None and clock() - began > deadline_s
    web_ids = stored.webs.select("web_id")
    known_before = known_quotes(stored.edges)
    places = stored.posts.select(*_KEY, "quote_count", F.struct(F.lit(-1).cast("bigint").alias("job"), "thread_ord", "post_ord").alias("at"), "author")
    authors = [scratch.save(places.select("web_id", "author", F.lit(-1).cast("bigint").alias("job"), (F.col("at.thread_ord").cast("bigint") * (1 << 31) + F.col("at.post_ord")).alias("ord")), "authors")]
    found = [scratch.save(places.groupBy(*_KEY).agg(F.max_by("quote_count", "at").alias("quote_count")).withColumn("depth", F.lit(None).cast("int")), "known")]
    unscanned = found[0].select(*_KEY, "quote_count")
    due = scratch.save(stored.webs.select("web_id", F.col("root_uri").alias("uri")).distinct(), "due")
    asked, covered, responses, pages, log = [due], [], [], [], []
    depth = 0

    def running(jobs: DataFrame) -> DataFrame:
        if late():
            return jobs.limit(0)
        if max_posts is None:
            return jobs
        full = _all([f.select("web_id") for f in found]).groupBy("web_id").agg(F.count("*").alias("n")).where(F.col("n") >= max_posts)
        return jobs.join(full, "web_id", "left_anti")

    def fetched(kind: str, jobs: DataFrame, run: DataFrame) -> DataFrame:
        """The posts that the running jobs bring; a response is kept before it is read, so it is asked for once."""
        fetch, read = (threads, wire.thread_posts) if kind == "threads" else (quotes, wire.quoting_posts)
        bodies = scratch.save(fetch(run.withColumn("job", _number(depth, kind))), "bodies")
        got = scratch.save(read(bodies), "responses")
        rows = got.groupBy("web_id", F.col("asked").alias("uri")).agg(F.max(F.col("error").isNotNull()).alias("bad"), F.max(F.col("error").isNull()).alias("good"))
        ran = jobs.join(run.select(*_KEY, F.lit(True).alias("ran")), _KEY, "left").join(bodies.select(*_KEY, F.lit(True).alias("answered")).distinct(), _KEY, "left").join(rows, _KEY, "left")
        state = F.when(F.col("ran").isNull(), "pending").when(F.col("answered").isNull() | (F.col("bad") & ~F.col("good")), "failed").when(F.col("bad"), "partial").otherwise("done")
        log.append(scratch.save(ran.select("web_id", F.lit(kind).alias("kind"), "uri", F.lit(depth).alias("depth"), state.alias("state")), "jobs"))
        return got.where("error is null")

    def new_posts(rows: DataFrame) -> DataFrame:
        one = rows.groupBy(*_KEY).agg(F.max_by("quote_count", F.struct("job", "ord")).alias("quote_count"))
        fresh = one.join(_all([f.select(*_KEY) for f in found]), _KEY, "left_anti")
        found.append(scratch.save(fresh.withColumn("depth", F.lit(depth)), "found"))
        authors.append(scratch.save(rows.select("web_id", "author", "job", F.col("ord").cast("bigint").alias("ord")), "authors"))
        return found[-1]

    while not due.isEmpty():
        here = scratch.save(running(due), "threads")
        posts = fetched("threads", due, here)
        responses.append(posts)
        covered.append(scratch.save(posts.select(*_KEY).distinct(), "covered"))
        fresh = new_posts(posts)
        # what a thread response shows is counted anew
        latest = posts.groupBy(*_KEY).agg(F.max_by("quote_count", F.struct("job", "ord")).alias("latest"))
        waiting = unscanned.unionByName(fresh.select(*_KEY, "quote_count"))
        scan = waiting.join(here.select("web_id").distinct(), "web_id", "left_semi").join(latest, _KEY, "left").withColumn("quote_count", F.coalesce("latest", "quote_count"))
        left = waiting.join(here.select("web_id").distinct(), "web_id", "left_anti")
        ask = scan.where("quote_count > 0").join(known_before, _KEY, "left").where("known is null or quote_count > known").select(*_KEY)
        ask = scratch.save(ask, "ask")
        scanning = scratch.save(running(ask), "quotes")
        shown = fetched("quotes", ask, scanning)
        pages.append(shown)
        quoted = new_posts(shown)
        unscanned = scratch.save(left.unionByName(quoted.select(*_KEY, "quote_count")), "unscanned")
        depth += 1
        if max_depth is not None and depth > max_depth:
            break
        after = next_threads(posts, shown.join(quoted.select(*_KEY), _KEY, "left_semi"), _all([f.select(*_KEY) for f in found]), handle_dids(_all(authors)))
        due = scratch.save(after.join(_all([*asked, *covered]), _KEY, "left_anti"), "due")
        asked.append(due)

    jobs = _all(log)
    posts_of = _all([f.select("web_id") for f in found]).groupBy("web_id").agg(F.count("*").alias("posts"))
    pending = jobs.where("state = 'pending'").groupBy("web_id").agg(F.count("*").alias("pending"))
    ends = web_ids.join(posts_of, "web_id", "left").join(pending, "web_id", "left").na.fill(0)
    spent, most = clock() - began, float("inf") if deadline_s is None else deadline_s
    reason = stop_reason(F.lit(float(spent)), most, F.col("posts"), max_posts if max_posts is not None else 1 << 62)
    return Crawl(stored, _all(responses), _all(pages), _all(found).where("depth is not null").select(*_KEY, "depth"), jobs, ends.select("web_id", reason.alias("reason"), "posts", "pending"), now)
