"""Crawls in rounds over tables of responses."""

import json
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators.crawl import answers, crawl
from loomgraph.operators.recrawl import reach
from loomgraph.schema import Webs
from loomgraph.sources import wire
from loomgraph.sources.network import quote_responses, thread_responses
from loomgraph.store import Scratch
from tests.test_assembly import shown, tree
from tests.webs import HIVES, MILL, SLOPE, SOUTH, STING, YAY, bees, make, post, uri


def start(web, posts=False):
    return web if posts else Webs(web.webs, web.threads.limit(0), web.posts.limit(0), web.edges.limit(0))


def run(spark, web, stored=None, threads=None, quotes=None, **limits):
    threads, quotes = threads or answers(thread_responses(web)), quotes or answers(quote_responses(web, 2))
    done = crawl(stored or start(web), threads, quotes, Scratch(spark, "crawl"), **limits)
    return done, {(r.uri, r.depth) for r in done.found.collect()}, {(r.kind, r.uri, r.depth, r.state) for r in done.jobs.collect()}, [(r.reason, r.posts, r.pending) for r in done.stops.collect()]


def test_bees_are_crawled_whole(spark):
    web = make(spark, bees())
    done, found, jobs, stops = run(spark, web, now="2026-01-02T00:00:00Z")
    assert found == {(HIVES, 0), (SLOPE, 0), (MILL, 0), (YAY, 0), (SOUTH, 0), (STING, 1)}
    assert jobs == {("threads", HIVES, 0, "done"), ("quotes", HIVES, 0, "done"), ("quotes", SLOPE, 0, "done"), ("threads", YAY, 1, "done"), ("threads", SOUTH, 1, "done")}
    webs = done.webs(Scratch(spark, "webs"))
    assert stops == [("complete", 6, 0)] and webs.webs.first().crawled_at == "2026-01-02T00:00:00Z"
    assert {(r.source, r.target, r.source_thread, r.target_thread) for r in webs.edges.collect()} == {(HIVES, YAY, HIVES, YAY), (SLOPE, SOUTH, HIVES, SOUTH)}


def random_web(spark, seed):
    rng = random.Random(seed)
    posts, edges, count = [], [], {}
    for t in range(14):
        root = uri("r", f"t{t}")
        own = [root]
        for k in range(rng.randrange(4)):
            own.append(uri("r", f"t{t}p{k}"))
        for u in own:
            above = rng.choice(posts)["uri"] if u == root and t and rng.random() < 0.8 else None
            if above:
                edges.append((above, u, "", ""))
                count[above] = count.get(above, 0) + 1
            posts.append(post(root, "r", u.split("/")[-1], "", "2025-01-01", None if u == root else root, above))
    for p in posts:
        p["quotes"] = count.get(p["uri"], 0)
    return make(spark, posts, edges, root=posts[0]["uri"])


@pytest.mark.parametrize(("seed", "depth"), [(1, None), (3, 1)])
def test_rounds_reach_what_a_walk_over_the_network_reaches(spark, seed, depth):
    web = random_web(spark, seed)
    _, found, _, stops = run(spark, web, max_depth=depth)
    assert found == {(r.uri, r.depth) for r in reach(web, Scratch(spark, "reach"), depth).collect()}
    assert stops[0][0] == "complete"


def test_what_fetched_posts_name_is_due_next_also_by_handle(spark):
    a, b, c, far = uri("ann", "a"), uri("ben", "b"), uri("cat", "c"), "at://eve.example/app.bsky.feed.post/e"
    shows = shown("ann", "a", embed="at://ben.example/app.bsky.feed.post/b", link=["https://bsky.app/profile/cat.example/post/c", f"https://bsky.app/profile/{uri('ann', 'a').split('/')[2]}/post/a"])
    bodies = [("w", a, tree(shows, tree(shown("dan", "d", link=[far, "https://bsky.app/profile/ann.example/post/a"])))), ("w", "at://ben.example/app.bsky.feed.post/b", tree(shown("ben", "b"))), ("w", "at://cat.example/app.bsky.feed.post/c", tree(shown("cat", "c", embed=b)))]
    table = spark.createDataFrame([(w, u, json.dumps({"thread": t})) for w, u, t in bodies], "web_id string, uri string, body string")
    done, found, jobs, stops = run(spark, make(spark, [], [], root=a), threads=answers(table), quotes=answers(table.limit(0)))
    assert found == {(a, 0), (uri("dan", "d"), 0), (b, 1), (c, 1)}
    assert ("threads", far, 1, "failed") in jobs and len(jobs) == 4 and stops == [("complete", 4, 0)]
    # links found before their ends were fetched are edges in the end
    assert {(r.source, r.target) for r in done.webs(Scratch(spark, "webs")).edges.collect()} == {(b, a), (c, a), (b, c), (a, uri("dan", "d"))}


def test_limits_leave_jobs_pending(spark):
    web = make(spark, bees())
    _, found, jobs, stops = run(spark, web, max_posts=5)
    assert stops == [("max_nodes", 5, 2)] and len(found) == 5 and ("threads", YAY, 1, "pending") in jobs
    ticks = iter(range(0, 1000, 10))
    _, found, jobs, stops = run(spark, web, deadline_s=15, clock=lambda: next(ticks))
    assert stops == [("timeout", 3, 2)] and ("quotes", HIVES, 0, "pending") in jobs


def test_a_second_crawl_scans_only_what_is_quoted_more_often(spark):
    web = make(spark, bees())
    more = make(spark, [dict(bees()[0], quotes=3), *bees()[1:], post(uri("new", "n"), "new", "n", "", "", None, HIVES)], [(HIVES, YAY, "", ""), (SLOPE, SOUTH, "", ""), (HIVES, uri("new", "n"), "", "")])
    _, found, jobs, _ = run(spark, more, stored=start(web, True))
    assert found == {(uri("new", "n"), 0)}
    assert {j for j in jobs if j[0] == "quotes"} == {("quotes", HIVES, 0, "done")}


def test_pages_up_to_the_first_that_fails(spark):
    page = lambda *names: json.dumps({"posts": [shown("x", n) for n in names]})
    rows = [("w", "a", 0, page("1", "2"), None), ("w", "a", 1, "{", None), ("w", "a", 2, page("3"), None), ("w", "b", 0, None, "429"), ("w", "b", 1, page("4"), None), ("w", "c", 1, page("6"), None), ("w", "c", 0, page("5"), None), ("v", "a", 1, page("7"), None)]
    got = wire.quoting_posts(spark.createDataFrame(rows, "web_id string, uri string, page int, body string, error string")).orderBy("web_id", "asked", "ord").collect()
    assert [(r.web_id, r.asked, r.uri and r.uri[-1], (r.error or "")[:6]) for r in got] == [("v", "a", "7", ""), ("w", "a", "1", ""), ("w", "a", "2", ""), ("w", "a", None, "Decode"), ("w", "b", None, "Fetch:"), ("w", "c", "5", ""), ("w", "c", "6", "")]
    web = make(spark, bees())
    failing = quote_responses(web, 1).withColumn("error", F.when((F.col("uri") == HIVES) & (F.col("page") == 0), "500"))
    _, found, jobs, _ = run(spark, web, quotes=answers(failing))
    assert ("quotes", HIVES, 0, "failed") in jobs and (SOUTH, 0) in found and (YAY, 0) not in found


def test_webs_without_a_response(spark):
    done, found, jobs, stops = run(spark, make(spark, [], [], root="at://x/app.bsky.feed.post/1"))
    assert (found, jobs, stops) == (set(), {("threads", "at://x/app.bsky.feed.post/1", 0, "failed")}, [("complete", 0, 0)])
    assert done.webs(Scratch(spark, "webs")).posts.count() == 0
