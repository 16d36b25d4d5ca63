"""Graph operators over webs: edges, hops between threads, roots, ordered walks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.positions import numbered, suffix_sums
from loomgraph.schema import Webs
from loomgraph.store import Scratch, dealt

#: Posts of a web up to which one task walks it.
WALK_IN_TASK = 200_000


def post_index(webs: Webs) -> DataFrame:
    """(web_id, uri, thread_root): the thread that holds a post; of several, the last."""
    return webs.posts.groupBy("web_id", "uri").agg(F.max_by("thread_root", F.struct("thread_ord", "post_ord")).alias("thread_root"))


def normalized_edges(webs: Webs) -> DataFrame:
    """Quote edges with both ends in the web, each (source, target) once, their threads looked up anew."""
    index = post_index(webs)
    first = webs.edges.groupBy("web_id", "source", "target").agg(F.min("edge_ord").alias("edge_ord"))
    ends = [index.select("web_id", F.col("uri").alias(end), F.col("thread_root").alias(f"{end}_thread")) for end in ("source", "target")]
    return first.join(ends[0], ["web_id", "source"]).join(ends[1], ["web_id", "target"]).select("web_id", "edge_ord", "source", "target", "source_thread", "target_thread")


def thread_hops(edges: DataFrame, starts: DataFrame, scratch: Scratch, most: int | None = None) -> DataFrame:
    """(web_id, thread_root, dist): quote hops of threads from their web's start, either way along an edge.

    ``starts``: web_id, thread_root. Threads that were never crawled are walked through. A hop leads to threads of
    the hop before, of the same or of the next one, so the new ones are those that neither of the last two hops
    holds; each hop is written once, beside the others, and nothing is written again. ``most`` stops early.
    """
    ways = edges.select("web_id", F.col("source_thread").alias("a"), F.col("target_thread").alias("b"))
    both = scratch.save(ways.union(ways.select("web_id", "b", "a")).where("a <> b").distinct(), "ways")
    path, key = scratch.path("hops"), ["web_id", "thread_root"]

    def hop(rows: DataFrame, dist: int) -> DataFrame:
        rows.write.parquet(f"{path}/dist={dist}")
        return edges.sparkSession.read.schema("web_id string, thread_root string").parquet(f"{path}/dist={dist}")

    last, frontier, dist = None, hop(starts.select(*key).distinct(), 0), 0
    while (most is None or dist < most) and not frontier.isEmpty():
        dist += 1
        step = frontier.join(both, (frontier["web_id"] == both["web_id"]) & (frontier["thread_root"] == both["a"])).select(both["web_id"], F.col("b").alias("thread_root")).distinct()
        held = frontier if last is None else frontier.union(last)
        last, frontier = frontier, hop(step.join(held, key, "left_anti"), dist)
    return edges.sparkSession.read.schema("web_id string, thread_root string, dist int").parquet(path)


def _climbed(up: DataFrame, scratch: Scratch, bits: int) -> DataFrame:
    """(web_id, at, top, more): where 2^bits steps along ``up`` (web_id, at, above) lead from a post, or fewer where they
    end before; ``more``: they don't end there. Each round doubles the steps."""
    now = scratch.save(up.select("web_id", "at", F.col("above").alias("top")), "climb")
    for _ in range(bits):
        further = now.select("web_id", F.col("at").alias("top"), F.col("top").alias("further"))
        now = scratch.save(now.join(dealt(further), ["web_id", "top"], "left").select("web_id", "at", F.coalesce("further", "top").alias("top"), F.col("further").isNotNull().alias("more")), "climb")
        if now.where("more").isEmpty():
            return now
        now = now.drop("more")
    return now.join(dealt(up.select("web_id", F.col("at").alias("top"), F.lit(True).alias("more"))), ["web_id", "top"], "left").na.fill(False, ["more"])


def tree_roots(webs: Webs, scratch: Scratch) -> DataFrame:
    """(web_id, start_uri, root_uri): from the web's root post up the reply chain as far as posts are there; where the
    chain runs in a circle, to the last post before one comes again.

    By pointer doubling: a chain of n posts takes log2(n) rounds. Posts that climb on when all could have arrived
    lead into circles; what 2^rounds steps lead to is on one, and a second climb ends where a circle is entered.
    """
    parents = webs.nodes("reply_parent").select("web_id", F.col("uri").alias("at"), F.col("reply_parent").alias("above"))
    up = scratch.save(parents.join(dealt(parents.select("web_id", F.col("at").alias("above"))), ["web_id", "above"]).where("at <> above").select("web_id", "at", "above"), "up")
    most = up.groupBy("web_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    tops = _climbed(up, scratch, int(most).bit_length())
    starts = webs.webs.select("web_id", F.col("root_uri").alias("start_uri"))
    at = F.col("start_uri") == F.col("at")
    found = starts.join(tops.withColumnRenamed("web_id", "_web"), (F.col("web_id") == F.col("_web")) & at, "left").select("web_id", "start_uri", F.coalesce("top", "start_uri").alias("root_uri"), F.coalesce("more", F.lit(False)).alias("more"))
    found = scratch.save(found, "roots")
    straight = found.where(~F.col("more")).select("web_id", "start_uri", "root_uri")
    if found.where("more").isEmpty():
        return straight
    circle = scratch.save(tops.where("more").select("web_id", F.col("top").alias("at")).distinct(), "circle")
    entries = _climbed(scratch.save(up.join(circle, ["web_id", "at"], "left_anti"), "tails"), scratch, int(most).bit_length())
    entered = found.where("more").select("web_id", "start_uri").join(entries.select("web_id", F.col("at").alias("start_uri"), "top"), ["web_id", "start_uri"], "left").withColumn("above", F.coalesce("top", "start_uri"))
    before = up.join(circle, ["web_id", "at"]).select("web_id", "above", F.col("at").alias("root_uri"))
    return straight.union(entered.join(before, ["web_id", "above"]).select("web_id", "start_uri", "root_uri"))


def child_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(web_id, parent, child, kind, rank): replies, then quotes, as a walk takes a post's children.

    Both ends are in ``nodes``. Children of a post are ranked by kind, time, and web or edge order; of
    several edges to one child the first counts.
    """
    replies = nodes.where("reply_parent is not null").select("web_id", F.col("reply_parent").alias("parent"), F.col("uri").alias("child"), F.lit(0).alias("kind"), F.col("thread_ord").cast("long").alias("o1"), F.col("post_ord").cast("long").alias("o2"))
    quotes = edges.select("web_id", F.col("source").alias("parent"), F.col("target").alias("child"), F.lit(1).alias("kind"), F.col("edge_ord").cast("long").alias("o1"), F.lit(0).cast("long").alias("o2"))
    times = nodes.select("web_id", F.col("uri").alias("child"), "created_at")
    heads = nodes.select("web_id", F.col("uri").alias("parent"))
    key = F.struct("kind", "created_at", "o1", "o2")
    once = replies.unionByName(quotes).join(dealt(times), ["web_id", "child"]).join(dealt(heads), ["web_id", "parent"]).groupBy("web_id", "parent", "child").agg(F.min(key).alias("key"))
    rank = F.row_number().over(Window.partitionBy("web_id", "parent").orderBy("key"))
    return once.select("web_id", "parent", "child", F.col("key.kind").alias("kind"), rank.alias("rank"))


def _walk(rows: pd.DataFrame) -> Iterator[tuple[str, int, int, str]]:
    """(uri, section, depth, tag) in the order of an ordered depth-first walk of one web."""
    posts = rows[rows["child"].isna()].sort_values("ord")
    children: dict[str, list[tuple[str, str]]] = {}
    for parent, child, kind in rows[rows["child"].notna()].sort_values(["uri", "ord"])[["uri", "child", "kind"]].itertuples(index=False):
        children.setdefault(parent, []).append((child, "[quote]" if kind else "[reply]"))
    first = posts.loc[posts["is_start"], "uri"].tolist()[:1]
    here, seen, section = set(posts["uri"]), set(), 0 if first else 1
    for start in [*first, *posts["uri"]]:
        if start in seen:
            continue
        stack = [(start, 0, "[root]")]
        while stack:
            uri, depth, tag = stack.pop()
            if uri in seen or uri not in here:
                continue
            seen.add(uri)
            yield uri, section, depth, tag
            stack.extend((c, depth + 1, t) for c, t in reversed(children.get(uri, ())))
        section += 1


def ordered_walk(nodes: DataFrame, children: DataFrame, starts: DataFrame, scratch: Scratch, in_task: int = WALK_IN_TASK) -> DataFrame:
    """(web_id, seq, section, depth, tag, uri): the posts in the order of a depth-first walk from the web's
    start, continued from each post not yet seen in web order. A post is visited once, at its first arrival.
    Section 0 is the start's; without a start in the web sections begin at 1.

    ``starts``: web_id, root_uri. Webs of up to ``in_task`` posts are walked by one task each; larger ones by
    :func:`ranked_walk`.
    """
    sizes = nodes.groupBy("web_id").agg(F.count("*").alias("size"))
    small, large = sizes.where(F.col("size") <= in_task).select("web_id"), sizes.where(F.col("size") > in_task).select("web_id")
    begun = starts.select("web_id", F.col("root_uri").alias("uri"), F.lit(True).alias("is_start"))
    order = F.row_number().over(Window.partitionBy("web_id").orderBy("thread_ord", "post_ord"))

    def in_one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(list(_walk(rows)), columns=["uri", "section", "depth", "tag"])
        return out.assign(web_id=key[0], seq=range(1, len(out) + 1))[["web_id", "seq", "section", "depth", "tag", "uri"]]

    posts = nodes.join(small, "web_id").join(begun, ["web_id", "uri"], "left").select("web_id", "uri", F.lit(None).cast("string").alias("child"), F.lit(0).alias("kind"), order.alias("ord"), F.coalesce("is_start", F.lit(False)).alias("is_start"))
    steps = children.join(small, "web_id").select("web_id", F.col("parent").alias("uri"), "child", "kind", F.col("rank").alias("ord"), F.lit(False).alias("is_start"))
    walked = posts.unionByName(steps).groupBy("web_id").applyInPandas(in_one, "web_id string, seq long, section long, depth long, tag string, uri string")
    if large.isEmpty():
        return walked
    return walked.unionByName(ranked_walk(nodes.join(large, "web_id"), children.join(large, "web_id"), starts, scratch))


def _sections(nodes: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``nodes`` (web_id, id, own) with ``section``: the smallest ``own`` of a post and all posts that lead to it, which
    is that of the restart whose walk arrives there first.

    Posts that one edge leads to find the smallest above them by pointer doubling, up to a post that none or
    several edges lead to; these are settled by rounds over the edges between such stretches.
    """
    single = edges.groupBy("child").agg(F.count("*").alias("ways"), F.min("parent").alias("above")).select("child", "ways", F.when(F.col("ways") == 1, F.col("above")).alias("above"))
    now = nodes.join(dealt(single), F.col("id") == F.col("child"), "left")
    now = scratch.save(now.select("web_id", "id", "own", F.col("own").alias("low"), F.col("above").alias("top"), F.coalesce("ways", F.lit(0)).alias("ways")), "low")
    most = nodes.groupBy("web_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    head = F.lit(None).cast("bigint")
    now = now.withColumn("head", F.when(F.col("top").isNull(), F.col("id")).otherwise(head))
    for _ in range(int(most).bit_length() + 1):
        above = now.select(F.col("id").alias("top"), F.col("low").alias("_low"), F.col("top").alias("_top"), F.col("head").alias("_head"))
        now = scratch.save(now.join(dealt(above), "top", "left").select("web_id", "id", "own", F.least("low", F.coalesce("_low", "low")).alias("low"), F.col("_top").alias("top"), "ways", F.coalesce("head", "_head").alias("head")), "low")
        if now.where("top is not null").isEmpty():
            break
    shared = now.where("ways > 1")
    if shared.isEmpty():
        return now.select("web_id", "id", "own", F.col("low").alias("section"))
    from_ = now.select(F.col("id").alias("parent"), F.col("low").alias("via"), F.col("head").alias("from"))
    ways = scratch.save(edges.join(shared.select(F.col("id").alias("child")), "child").join(from_, "parent").groupBy("child", "from").agg(F.min("via").alias("via")), "ways")
    heads = scratch.save(now.where("id = head").select("id", F.col("own").alias("least")), "heads")
    while True:
        offers = ways.join(heads.select(F.col("id").alias("from"), "least"), "from", "left").groupBy(F.col("child").alias("id")).agg(F.min(F.least("via", F.coalesce("least", "via"))).alias("offer"))
        after = heads.join(offers, "id", "left").withColumn("better", F.coalesce(F.col("offer") < F.col("least"), F.lit(False)))
        after = scratch.save(after.select("id", F.least("least", F.coalesce("offer", "least")).alias("least"), "better"), "heads")
        heads = after.drop("better")
        if after.where("better").isEmpty():
            break
    least = heads.select(F.col("id").alias("head"), "least")
    return now.join(least, "head", "left").select("web_id", "id", "own", F.least("low", F.coalesce("least", "low")).alias("section"))


def _listed(trees: DataFrame, scratch: Scratch) -> DataFrame:
    """The sums that give each post its place: ``trees`` (list, id, parent, key) are ordered trees of which those of one
    ``list`` follow each other; a parent's children, and a list's roots (parent null), come by ``key``.

    A post is entered, its children are gone through, and it is left. Those steps make one list for each ``list``;
    of what follows a post's entry, itself included, posts are counted in ``posts``, roots in ``roots``, and entries
    less exits in ``open``.
    """
    placed = scratch.save(numbered(trees.withColumn("_parent", F.coalesce("parent", F.lit(-1))), ["list", "_parent"], ["key"], scratch, "k"), "siblings")
    first = placed.where("k = 1 and parent is not null").select(F.col("parent").alias("id"), (2 * F.col("id")).alias("inner"))
    following = placed.select("list", "_parent", (F.col("k") - 1).alias("k"), (2 * F.col("id")).alias("beside"))
    steps = placed.join(dealt(first), "id", "left").join(dealt(following), ["list", "_parent", "k"], "left")
    root = F.col("parent").isNull().cast("bigint")
    enter = F.struct((2 * F.col("id")).alias("id"), F.coalesce("inner", 2 * F.col("id") + 1).alias("next"), F.lit(1).alias("posts"), root.alias("roots"), F.lit(1).alias("open"))
    leave = F.struct((2 * F.col("id") + 1).alias("id"), F.coalesce("beside", 2 * F.col("parent") + 1).alias("next"), F.lit(0).alias("posts"), F.lit(0).alias("roots"), F.lit(-1).alias("open"))
    kinds = "struct<id:bigint,next:bigint,posts:bigint,roots:bigint,open:bigint>"
    items = steps.select(F.inline(F.array(enter.cast(kinds), leave.cast(kinds))))
    return suffix_sums(items, scratch).where("id % 2 = 0").withColumn("id", F.shiftright("id", 1))


def _chosen(candidates: DataFrame, sections: DataFrame, scratch: Scratch) -> DataFrame:
    """Of the ``candidates`` (parent, child, kind, rank) that lead to a post within its section the one that the walk
    takes. Where one leads there it is that; posts that several lead to are settled among themselves: what hangs
    on such a post by single edges is one stretch, in which each edge to another has a place, and the smallest list
    of places wins."""
    ways = candidates.groupBy("child").agg(F.count("*").alias("ways"))
    several = scratch.save(ways.where("ways > 1").select("child"), "several")
    if several.isEmpty():
        return candidates
    sure = scratch.save(candidates.join(several, "child", "left_anti"), "sure")
    open_ = scratch.save(candidates.join(several, "child").withColumn("way", F.monotonically_increasing_id()), "open")
    tops = scratch.save(sections.select("id").join(dealt(sure.select(F.col("child").alias("id"), F.col("parent").alias("up"))), "id", "left").select("id", F.coalesce("up", "id").alias("top")), "tops")
    while True:
        after = tops.join(dealt(tops.select(F.col("id").alias("top"), F.col("top").alias("further"))), "top").select("id", F.col("further").alias("top"), (F.col("further") != F.col("top")).alias("moved"))
        after = scratch.save(after, "tops")
        tops = after.drop("moved")
        if after.where("moved").isEmpty():
            break
    # an edge to a post of several is a leaf of its stretch; ids of leaves follow those of posts
    leaf = sections.agg(F.max("id")).first()[0] + 1
    rows = tops.join(dealt(sure.select(F.col("child").alias("id"), "parent", F.col("rank").cast("bigint").alias("key"))), "id", "left").select(F.col("top").alias("list"), "id", "parent", F.coalesce("key", F.lit(0)).alias("key"))
    leaves = open_.join(tops.select(F.col("id").alias("parent"), F.col("top").alias("list")), "parent").select("list", (F.col("way") + leaf).alias("id"), "parent", F.col("rank").cast("bigint").alias("key"))
    sums = _listed(rows.unionByName(leaves), scratch)
    sizes = rows.select("list").union(leaves.select("list")).groupBy("list").agg(F.count("*").alias("size"))
    spots = leaves.join(sums, "id").join(sizes, "list").select((F.col("id") - leaf).alias("way"), "list", (F.col("size") - F.col("posts")).alias("spot"))
    edges = scratch.save(open_.join(spots, "way").select("child", "way", F.col("list").alias("from"), "spot"), "between")
    empty = F.array().cast("array<bigint>")
    paths = scratch.save(tops.where("id = top").join(several.select(F.col("child").alias("id"), F.lit(True).alias("waits")), "id", "left").select("id", F.when(F.col("waits").isNull(), empty).alias("path"), F.lit(None).cast("bigint").alias("way")), "paths")
    changed = paths.where("path is not null")
    while not changed.isEmpty():
        offers = edges.join(changed.select(F.col("id").alias("from"), "path"), "from").groupBy(F.col("child").alias("id")).agg(F.min(F.struct(F.concat("path", F.array("spot")).alias("path"), "way")).alias("offer"))
        better = F.col("offer").isNotNull() & (F.col("path").isNull() | (F.col("offer.path") < F.col("path")))
        after = paths.join(offers, "id", "left").select("id", F.when(better, F.col("offer.path")).otherwise(F.col("path")).alias("path"), F.when(better, F.col("offer.way")).otherwise(F.col("way")).alias("way"), better.alias("better"))
        after = scratch.save(after, "paths")
        changed, paths = after.where("better"), after.drop("better")
    return sure.unionByName(open_.join(paths.select("way"), "way", "left_semi").drop("way"))


def ranked_walk(nodes: DataFrame, children: DataFrame, starts: DataFrame, scratch: Scratch) -> DataFrame:
    """The same walk by list ranking, in a number of rounds that grows with the logarithm of a web's posts.

    Where posts come after what they reply to and none has two ways to it, the edges are the walk's trees. Else the
    restart that each post belongs to and the edge that the walk takes to it are found first; only posts that several
    edges lead to take rounds of their own, as many as such posts lie behind each other.
    """
    begun = starts.select("web_id", F.col("root_uri").alias("uri"), F.lit(0).alias("later"))
    own = F.struct(F.coalesce("later", F.lit(1)).alias("later"), "thread_ord", "post_ord")
    posts = nodes.select("web_id", "uri", "thread_ord", "post_ord").join(begun, ["web_id", "uri"], "left")
    posts = scratch.save(posts.select("web_id", "uri", own.alias("own")).withColumn("id", F.monotonically_increasing_id()), "posts")
    ends = {x: posts.select("web_id", F.col("uri").alias(x), F.col("id").alias(f"{x}_id"), F.col("own").alias(f"{x}_own")) for x in ("parent", "child")}
    edges = children.where("parent <> child").join(dealt(ends["parent"]), ["web_id", "parent"]).join(dealt(ends["child"]), ["web_id", "child"])
    edges = scratch.save(edges.select(F.col("parent_id").alias("parent"), F.col("child_id").alias("child"), "kind", "rank", (F.col("parent_own") >= F.col("child_own")).alias("backward")), "edges")
    if edges.where("backward").isEmpty() and edges.groupBy("child").count().where("count > 1").isEmpty():
        taken = edges
    else:
        sections = scratch.save(_sections(posts.select("web_id", "id", "own"), edges, scratch), "sections")
        of = {x: sections.select(F.col("id").alias(x), F.col("section").alias(f"{x}_section"), F.col("own").alias(f"{x}_own")) for x in ("parent", "child")}
        inside = edges.join(dealt(of["parent"]), "parent").join(dealt(of["child"]), "child").where("parent_section = child_section and child_own <> child_section")
        taken = scratch.save(_chosen(scratch.save(inside.select("parent", "child", "kind", "rank"), "inside"), sections, scratch), "taken")
    trees = posts.join(dealt(taken.select(F.col("child").alias("id"), "parent", "kind", "rank")), "id", "left")
    trees = scratch.save(trees.select(F.col("web_id").alias("list"), "uri", "id", "parent", "kind", F.struct(F.coalesce(F.col("rank").cast("bigint"), F.lit(0)).alias("rank"), F.when(F.col("parent").isNull(), F.col("own")).alias("own")).alias("key")), "trees")
    sums = _listed(trees.select("list", "id", "parent", "key"), scratch)
    first = posts.groupBy(F.col("web_id").alias("list")).agg(F.count("*").alias("n"), F.min("own.later").alias("first"))
    roots = trees.where("parent is null").groupBy("list").agg(F.count("*").alias("r"))
    tag = F.when(F.col("parent").isNull(), "[root]").when(F.col("kind") == 1, "[quote]").otherwise("[reply]")
    section = F.col("first") + F.col("r") - F.col("roots") + F.col("parent").isNull().cast("bigint") - 1
    return trees.join(dealt(sums), "id").join(first, "list").join(roots, "list").select(F.col("list").alias("web_id"), (F.col("n") - F.col("posts") + 1).cast("bigint").alias("seq"), section.cast("bigint").alias("section"), (-F.col("open")).cast("bigint").alias("depth"), tag.alias("tag"), "uri")
