"""The lenses as text: one row (web_id, text) for each web.

A lens is a set of blocks, each built by column functions with a key that gives its place; a web's blocks are
sorted and joined. A block ends with a line end where an empty line follows it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import author_name, counted, engagement, indented, percent, short_time, thousands, trim_end, truncate
from loomgraph.operators.graph import post_index
from loomgraph.plans import lenses
from loomgraph.schema import Webs
from loomgraph.store import Scratch

#: The lenses' names here, and below the headings, tags and layout that their text format has.
NAMES = ("tree", "linear", "by-author", "stats", "threads", "highlights", "neighborhood", "timeline", "search")


def _cat(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _text(n: Column) -> Column:
    return n.cast("string")


def _when(condition: Column, value: Column) -> Column:
    return F.when(condition, value).otherwise("")


def _block(rows: DataFrame, part: int, seq: Column | int, block: Column | str, *sub: Column) -> DataFrame:
    seq = F.lit(seq) if isinstance(seq, int) else seq
    return rows.select("web_id", F.lit(part).alias("part"), seq.cast("long").alias("seq"), (sub[0] if sub else F.lit(0)).cast("long").alias("sub"), (F.lit(block) if isinstance(block, str) else block).alias("block"))


def _joined(*blocks: DataFrame) -> DataFrame:
    """A web's blocks in order. One web's text is one row, as large as the web."""
    rows = reduce(DataFrame.unionByName, blocks)
    ordered = F.sort_array(F.collect_list(F.struct("part", "seq", "sub", "block")))
    return rows.groupBy("web_id").agg(trim_end(F.array_join(F.transform(ordered, lambda b: b["block"]), "\n")).alias("text"))


def _name(row: str = "author") -> Column:
    return author_name(F.col(row))


def _time() -> Column:
    return short_time(F.col("created_at"))


def _context(reply: Column, quote: Column) -> Column:
    """What a post replies to and quotes, in brackets; nulls are left out, nothing where both are."""
    both = F.array_join(F.array_compact(F.array(reply, quote)), ", ")
    return _when(both != "", _cat("  [", both, "]"))


def _handles(numbers: bool) -> tuple[Column, Column]:
    def one(what: str, verb: str) -> Column:
        at = _cat(f"{verb} @", F.col(f"{what}_handle"))
        return F.concat(at, F.coalesce(_cat(" #", _text(F.col(f"{what}_n"))), F.lit(""))) if numbers else at

    return one("reply", "replying to"), one("quote", "quoting")


def _marks() -> Column:
    """Likes, reposts and quotes, those that are not 0."""
    kinds = (("like_count", "like", "likes"), ("repost_count", "repost", "reposts"), ("quote_count", "quote", "quotes"))
    return F.array_join(F.array_compact(F.array(*[F.when(F.col(c) > 0, counted(F.col(c), a, b)) for c, a, b in kinds])), ", ")


def _walked(walk: DataFrame, nodes: DataFrame, part: int) -> DataFrame:
    rows = walk.join(nodes.select("web_id", "uri", "author", "text", "created_at", "like_count", "repost_count", "quote_count"), ["web_id", "uri"])
    indent = F.repeat(F.lit("  "), F.col("depth").cast("int"))
    opens = _when((F.col("depth") == 0) & (F.col("section") > 0), F.lit("---\n"))
    stats = _when(_marks() != "", _cat("\n", indent, "  (", _marks(), ")"))
    block = _cat(opens, indent, F.col("tag"), " ", _name(), "  ", _time(), indented(F.col("text"), F.concat(indent, F.lit("  "))), stats, "\n")
    return _block(rows, part, F.col("seq"), block)


def tree(webs: Webs, scratch: Scratch) -> DataFrame:
    return _joined(_walked(lenses.tree(webs, scratch), webs.nodes(), 0))


def linear(webs: Webs, scratch: Scratch) -> DataFrame:
    rows = lenses.linear(webs)
    head = _cat("[", _text(F.col("n")), "/", _text(F.col("total")), "] ", _name(), "  ", _time(), _context(*_handles(True)))
    return _joined(_block(rows, 0, F.col("n"), _cat(head, indented(F.col("text"), "  "), "\n")))


def by_author(webs: Webs, scratch: Scratch) -> DataFrame:
    roster = scratch.save(lenses.author_roster(webs, scratch), "roster")
    total = roster.groupBy("web_id").agg(F.count("*").alias("n"))
    tags = F.array_join(F.array_compact(F.array(F.when(F.col("thread_starter"), "thread starter"), F.when(F.col("joined_via_quote"), "joined via quote"))), ", ")
    line = _cat("  ", F.col("name"), " - ", _text(F.col("posts")), F.when(F.col("posts") == 1, " post").otherwise(" posts"), _when(tags != "", _cat("  [", tags, "]")))
    posts = lenses.author_posts(webs).join(roster.select("web_id", "did", "pos"), ["web_id", "did"])
    own = _cat("  [", _text(F.col("k")), "] (#", _text(F.col("global_n")), ") ", _time(), _context(*_handles(False)), indented(F.col("text"), "    "), "\n")
    return _joined(
        _block(total, 0, 0, _cat("=== PARTICIPANTS (", _text(F.col("n")), ") ===")),
        _block(roster, 1, F.col("pos"), line),
        _block(total, 2, 0, ""),
        _block(roster, 3, F.col("pos"), _cat("=== ", F.col("name"), " ===")),
        _block(posts, 3, F.col("pos"), own, F.col("k")),
    )


def stats(webs: Webs, scratch: Scratch) -> DataFrame:
    of = lenses.counts(webs).join(lenses.time_span(webs), "web_id", "left")
    spans = _when(F.col("earliest").isNotNull(), _cat("\nTime span: ", short_time(F.col("earliest")), " to ", short_time(F.col("latest"))))
    head = _cat(
        "=== CONTEXT WEB STATISTICS ===\n\nPosts: ", thousands(F.col("posts")), " across ", thousands(F.col("threads")), " threads\nEdges: ", thousands(F.col("reply_edges")), " reply + ", thousands(F.col("quote_edges")), " quote = ", thousands(F.col("total_edges")), " total",
        spans, "\n\nThread sizes:",
    )
    buckets = lenses.thread_size_histogram(webs)
    share = F.format_number(percent(F.col("threads"), F.col("total_threads")), 1)
    line = _cat("  ", F.rpad("bucket", 15, " "), " ", counted(F.col("threads"), "thread", "threads"), " (", share, "%)")
    largest = buckets.where("pos = 0 and total_threads > 0")
    rank = F.lpad(_text(F.col("rnk")), 2, " ")
    authors, best, hops = lenses.top_authors(webs), lenses.top_posts(webs), lenses.hop_histogram(webs, scratch)
    rooted = lenses.root_threads(webs)
    hop = F.when(F.col("dist") < 0, F.lit("  Unreachable: ")).otherwise(_cat("  Hop ", _text(F.col("dist")), ": "))
    return _joined(
        _block(of, 0, 0, head),
        _block(buckets, 1, F.col("pos"), line),
        _block(largest, 2, 0, _cat("  Largest: ", counted(F.col("largest"), "post", "posts"))),
        _block(of, 3, 0, "\nTop authors by post count:"),
        _block(authors, 4, F.col("rnk"), _cat("  ", rank, ". ", F.col("name"), " - ", counted(F.col("posts"), "post", "posts"))),
        _block(of, 5, 0, "\nTop posts by engagement:"),
        _block(best, 6, F.col("rnk"), _cat("  ", rank, ". [", thousands(F.col("engagement")), " engagement] ", _name(), "\n      ", truncate(F.col("text"), 80))),
        _block(rooted, 7, 0, "\nQuote-hop depth from root thread:"),
        _block(hops, 8, F.when(F.col("dist") < 0, 1 << 40).otherwise(F.col("dist")), _cat(hop, counted(F.col("posts"), "post", "posts"))),
    )


def threads(webs: Webs, scratch: Scratch, top: int = 20) -> DataFrame:
    rows = lenses.threads_by_size(webs, top)
    total = webs.webs.select("web_id").join(webs.posts.groupBy("web_id").agg(F.count_distinct("thread_ord").alias("total")), "web_id", "left").na.fill(0)
    head = _cat("=== THREADS (", thousands(F.col("total")), " total, showing top ", _text(F.least(F.col("total"), F.lit(top))), ") ===\n")
    rank = F.when(F.length(_text(F.col("rnk"))) < 3, F.rpad(_text(F.col("rnk")), 3, " ")).otherwise(_text(F.col("rnk")))
    block = _cat("#", rank, " ", counted(F.col("posts"), "post", "posts"), " | ", thousands(F.col("engagement")), " engagement | ", _name("rep.author"), "\n     ", truncate(F.col("rep.text"), 80), "\n     ", F.col("rep_uri"), "\n")
    return _joined(_block(total, 0, 0, head), _block(rows, 1, F.col("rnk"), block))


def highlights(webs: Webs, scratch: Scratch, top: int = 10) -> DataFrame:
    rank, text = _text(F.col("rnk")), _cat("\n     ", truncate(F.col("text"), 80))
    count = lambda c, a, b: counted(F.col(c), a, b)
    likes = (count("like_count", "like", "likes"), count("repost_count", "repost", "reposts"))
    each, quoted = webs.webs.select("web_id"), webs.edges.select("web_id").distinct()
    replied = webs.posts.where("reply_parent is not null").select("web_id").distinct()
    return _joined(
        _block(each, 0, 0, "=== HIGHLIGHTS ===\n"),
        _block(quoted, 1, 0, "--- Most Quoted ---"),
        _block(lenses.most_quoted(webs, top), 2, F.col("rnk"), _cat("  ", rank, ". [quoted ", count("n", "time", "times"), "] ", _name(), "  ", _time(), text, "\n     (", likes[0], ", ", likes[1], ")\n")),
        _block(replied, 3, 0, "--- Most Replied ---"),
        _block(lenses.most_replied(webs, top), 4, F.col("rnk"), _cat("  ", rank, ". [", count("n", "reply", "replies"), " in web] ", _name(), "  ", _time(), text, "\n")),
        _block(each, 5, 0, "--- Highest Engagement ---"),
        _block(lenses.top_posts(webs, top), 6, F.col("rnk"), _cat("  ", rank, ". [", likes[0], ", ", likes[1], ", ", count("quote_count", "quote", "quotes"), "] ", _name(), text, "\n")),
        _block(each, 7, 0, "--- Main Characters (by total engagement) ---"),
        _block(lenses.main_characters(webs, top), 8, F.col("rnk"), _cat("  ", rank, ". ", F.col("name"), " - ", thousands(F.col("engagement")), " total engagement")),
    )


def neighborhood(webs: Webs, scratch: Scratch, hops: int = 2, uri: str | None = None) -> DataFrame:
    near = scratch.save(lenses.neighborhood(webs, scratch, hops, uri or None), "near")
    walk = lenses.neighborhood_walk(webs, scratch, hops, uri or None)
    target = webs.webs.select("web_id", (F.lit(uri) if uri else F.col("root_uri")).alias("uri"))
    found = target.join(post_index(webs).withColumnRenamed("thread_root", "target_thread"), ["web_id", "uri"], "left")
    starts = found.where("target_thread is not null").select("web_id", F.col("target_thread").alias("thread_root"))
    inside = lenses.thread_hops(webs.edges, starts, scratch, hops).join(webs.threads, ["web_id", "thread_root"]).groupBy("web_id").agg(F.count_distinct("thread_root").alias("in_threads"))
    sizes = near.groupBy("web_id").agg(F.count("*").alias("in_posts"))
    head = found.join(sizes, "web_id", "left").join(inside, "web_id", "left").na.fill(0).join(lenses.counts(webs), "web_id")
    text = _cat(f"=== NEIGHBORHOOD ({hops} hops from target) ===\nPosts: ", thousands(F.col("in_posts")), " of ", thousands(F.col("posts")), " | Threads: ", thousands(F.col("in_threads")), " of ", thousands(F.col("threads")), "\n")
    missing = _cat("Post not found in web: ", F.col("uri"))
    return _joined(_block(head, 0, 0, F.when(F.col("target_thread").isNull(), missing).otherwise(text)), _walked(walk.join(starts.select("web_id"), "web_id"), near, 1))


def timeline(webs: Webs, scratch: Scratch, after: str | None = None, before: str | None = None) -> DataFrame:
    rows = scratch.save(lenses.timeline(webs, after, before), "inside")
    shown = lambda x: x.replace("T", " ")[:16]
    bounds = {(True, True): lambda: f"{shown(after)} to {shown(before)}", (True, False): lambda: f"after {shown(after)}", (False, True): lambda: f"before {shown(before)}", (False, False): lambda: "all time"}
    window = bounds[bool(after), bool(before)]()
    head = lenses.counts(webs).join(rows.groupBy("web_id").agg(F.count("*").alias("inside")), "web_id", "left").na.fill(0)
    block = _cat("[", _text(F.col("n")), "/", _text(F.col("total")), "] ", _name(), "  ", _time(), _context(*_handles(True)), indented(F.col("text"), "  "), "\n")
    return _joined(_block(head, 0, 0, _cat(f"=== TIMELINE ({window}) ===\nPosts: ", thousands(F.col("inside")), " of ", thousands(F.col("posts")), "\n")), _block(rows, 1, F.col("n"), block))


def search(webs: Webs, scratch: Scratch, query: str | None = None, author: str | None = None) -> DataFrame:
    if not query and not author:
        return webs.webs.select("web_id", F.lit("No search criteria provided. Use --query and/or --author.").alias("text"))
    rows = scratch.save(lenses.search(webs, query, author), "found")
    asked = " | ".join([f'query: "{query}"'] * bool(query) + [f"author: {author}"] * bool(author))
    head = lenses.counts(webs).join(rows.groupBy("web_id").agg(F.count("*").alias("n")), "web_id", "left").na.fill(0)
    refers = F.array_join(F.array_compact(F.array(*_handles(False))), ", ")
    marks = F.array_join(F.array(counted(F.col("like_count"), "like", "likes"), counted(F.col("repost_count"), "repost", "reposts"), counted(F.col("quote_count"), "quote", "quotes")), ", ")
    block = _cat(
        "[", _text(F.col("n")), "] ", _name(), "  ", _time(), "\n    Thread: ", F.col("in_thread"), " (", counted(F.col("thread_size"), "post", "posts"), ")",
        _when(refers != "", _cat("\n    [", refers, "]")), "\n    ", F.col("snippet"), _when(engagement() > 0, _cat("\n    (", marks, ")")), "\n",
    )
    title = _cat(f"=== SEARCH RESULTS ===\n{asked} | ", counted(F.col("n"), "match", "matches"), " in ", counted(F.col("posts"), "post", "posts"), "\n")
    return _joined(_block(head, 0, 0, title), _block(rows, 1, F.col("n"), block))


def render(webs: Webs, lens: str, scratch: Scratch | None = None, **asked) -> DataFrame:
    """(web_id, text) for a lens by its name; parameters that it doesn't have are errors."""
    known = {n: globals()[n.replace("-", "_")] for n in NAMES}
    if lens not in known:
        raise ValueError(f"unknown lens {lens!r}; there are {', '.join(NAMES)}")
    return known[lens](webs, scratch or Scratch(webs.posts.sparkSession, lens), **asked)
