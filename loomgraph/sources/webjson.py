"""Webs as JSON documents: one object for each web, format version 2."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.ids import web_id
from loomgraph.operators.graph import normalized_edges
from loomgraph.operators.positions import text_parts
from loomgraph.schema import AUTHOR, FACETS, Webs
from loomgraph.store import Scratch, exists

_POST = (
    f"uri:string,cid:string,author:{AUTHOR},text:string,created_at:string,reply_parent:string,reply_root:string,embed_type:string,embed_uri:string,"
    f"facets:{FACETS},labels:array<string>,langs:array<string>,like_count:bigint,reply_count:bigint,repost_count:bigint,quote_count:bigint"
)
_EDGE = "struct<source:string,target:string,source_thread:string,target_thread:string>"
_META = "struct<format_version:int,root_uri:string,crawled_at:string,node_count:bigint,edge_count:bigint,thread_count:bigint>"
DOCUMENT = f"meta {_META}, threads map<string,struct<root_uri:string,posts:map<string,struct<{_POST}>>>>, quote_edges array<{_EDGE}>"
_FIELDS = [f.split(":")[0] for f in ("uri", "cid", "author", "text", "created_at", "reply_parent", "reply_root", "embed_type", "embed_uri", "facets", "labels", "langs", "like_count", "reply_count", "repost_count", "quote_count")]

#: What orders the pieces of a document: its sections, in them threads, in those their head, posts and end.
_PLACE = ("section", "late", "thread_ord", "post_ord", "step", "at_thread", "at_post")


def read_webs(spark: SparkSession, path: str) -> Webs:
    """The webs of the ``*.json`` files under ``path``; none where there is no such folder. A malformed document
    is an error; fields that may be missing get their defaults, unknown ones are ignored, order in a document
    is web order."""
    return parse_webs(_files(spark, path).select("value"))


def _files(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], "value string").withColumn("file", F.lit(""))
    return spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True).withColumn("file", F.input_file_name())


def list_webs(spark: SparkSession, path: str) -> DataFrame:
    """(web_id, root_uri, crawled_at, nodes, edges, threads) of the ``*.json`` files under ``path``, named by their
    files, from what their ``meta`` says: ``?`` and 0 where it doesn't, or where a document can't be read."""
    whole = F.from_json("value", f"meta {_META}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    read = _files(spark, path).select(F.regexp_extract("file", r"([^/]*)\.json$", 1).alias("web_id"), whole.alias("d"))
    meta = read.select("web_id", F.when(F.col("d._corrupt_record").isNull(), F.col("d.meta")).alias("m"))
    counts = [F.coalesce(f"m.{n}_count", F.lit(0)).alias(f"{n}s") for n in ("node", "edge", "thread")]
    return meta.select("web_id", *[F.coalesce(f"m.{n}", F.lit("?")).alias(n) for n in ("root_uri", "crawled_at")], *counts)


def parse_webs(documents: DataFrame) -> Webs:
    """Webs of a column ``value`` of JSON texts."""
    each = documents.select(F.from_json("value", DOCUMENT, {"mode": "FAILFAST"}).alias("d")).select("d.*").withColumn("web_id", web_id(F.col("meta.root_uri")))
    webs = each.select("web_id", "meta.root_uri", "meta.crawled_at", F.coalesce("meta.format_version", F.lit(2)).alias("format_version"))
    threads = each.select("web_id", F.posexplode("threads").alias("thread_ord", "key", "thread"))
    posts = threads.select("web_id", "thread_ord", F.col("thread.root_uri").alias("thread_root"), F.posexplode("thread.posts").alias("post_ord", "uri_key", "p"))
    null = {"facets": F.array().cast(FACETS), "labels": F.array().cast("array<string>"), "langs": F.array().cast("array<string>")}
    author = F.struct("p.author.did", "p.author.handle", F.coalesce("p.author.display_name", F.lit("")).alias("display_name"))

    def field(name: str):
        if name == "author":
            return author.alias(name)
        default = null.get(name, F.lit(0).cast("bigint") if name.endswith("_count") else None)
        return (F.col(f"p.{name}") if default is None else F.coalesce(f"p.{name}", default)).alias(name)

    edges = each.select("web_id", F.posexplode("quote_edges").alias("edge_ord", "e"))
    return Webs(
        webs,
        threads.select("web_id", "thread_ord", F.col("thread.root_uri").alias("thread_root")),
        posts.select("web_id", "thread_ord", "post_ord", "thread_root", *[field(n) for n in _FIELDS]),
        edges.select("web_id", "edge_ord", "e.source", "e.target", "e.source_thread", "e.target_thread"),
    )


def _cleaned(post: dict) -> dict:
    """A post's fields; facets lose the payload keys that they don't have, which column JSON can't tell from nulls."""
    facets = [{"index": f["index"], "features": [{k: v for k, v in x.items() if v is not None} for x in f["features"]]} for f in post.get("facets") or []]
    return {n: facets if n == "facets" else post.get(n) for n in _FIELDS}


def _indented(value, depth: int) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False).replace("\n", "\n" + "  " * depth)


def _block(kind: int, first: bool, filled: bool, key: str | None, body: str) -> str:
    """A piece of a document; those of a web, in order, are the document. ``first``: nothing of the piece's kind stands
    before it in what holds it; ``filled``: what it ends holds something."""
    comma, name = "" if first else ",", json.dumps("null" if key is None else key, ensure_ascii=False)
    if kind == 0:
        return '{\n  "meta": ' + _indented(json.loads(body), 1) + ',\n  "threads": {'
    if kind == 1:
        return f'{comma}\n    {name}: {{\n      "root_uri": {"null" if key is None else name},\n      "posts": {{'
    if kind == 2:
        return f"{comma}\n        {name}: " + _indented(_cleaned(json.loads(body)), 4)
    if kind == 3:
        return ("\n      " if filled else "") + "}\n    }"
    if kind == 4:
        return ("\n  " if filled else "") + '},\n  "quote_edges": ['
    if kind == 5:
        return f"{comma}\n    " + _indented(json.loads(body), 2)
    return ("\n  " if filled else "") + "]\n}"


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        made = [_block(*row) for row in batch[["kind", "first", "filled", "key", "body"]].itertuples(index=False)]
        yield batch[["web_id", *_PLACE]].assign(block=made)


def document_parts(webs: Webs, scratch: Scratch | None = None) -> DataFrame:
    """(web_id, part, json): each web as one indented document, its edges cleaned and its counts in ``meta``, in parts
    from 0 that follow one another. No task holds more of a web than a part."""
    scratch = scratch or Scratch(webs.posts.sparkSession, "documents")
    root, place = F.coalesce("thread_root", F.lit("null")).alias("root"), F.struct("thread_ord", "post_ord")
    last = F.max_by(F.struct(*[c for c in _FIELDS if c != "uri"]), place)
    posts = webs.posts.groupBy("web_id", root, "uri").agg(F.min(place).alias("at"), last.alias("post"), F.count("*").alias("n"), F.count("reply_parent").alias("replies"))
    posts = scratch.save(posts, "posts")
    edges = scratch.save(normalized_edges(webs), "edges")
    # threads stand in their order, those that posts alone name behind them
    begun = posts.groupBy("web_id", "root").agg(F.min("at").alias("at"))
    named = webs.threads.select("web_id", root, "thread_root", F.struct(F.lit(0).alias("late"), "thread_ord", F.lit(-1).alias("post_ord")).alias("rank"))
    late = begun.select("web_id", "root", F.nullif("root", F.lit("null")).alias("thread_root"), F.struct(F.lit(1).alias("late"), "at.thread_ord", "at.post_ord").alias("rank"))
    threads = named.unionByName(late).groupBy("web_id", "root").agg(F.min("rank").alias("rank"), F.min("thread_root").alias("thread_root"))
    threads = scratch.save(threads.join(begun, ["web_id", "root"], "left"), "threads")
    heads = webs.webs.select("web_id", "root_uri", "crawled_at")
    for counts in (
        posts.groupBy("web_id").agg(F.count_distinct(F.coalesce("uri", F.lit("null"))).alias("node_count"), F.sum("replies").alias("replies")),
        threads.groupBy("web_id").agg(F.count("*").alias("thread_count"), F.min("rank").alias("first_thread")),
        edges.groupBy("web_id").agg(F.count("*").alias("edges"), F.min("edge_ord").alias("first_edge")),
    ):
        heads = heads.join(counts, "web_id", "left")
    heads = heads.na.fill(0, ["node_count", "replies", "thread_count", "edges"]).withColumn("edge_count", F.col("replies") + F.col("edges"))
    heads = scratch.save(heads, "heads")
    no, none = F.lit(False), F.lit(None).cast("string")

    def rows(table: DataFrame, section: int, kind: int, rank=None, at=None, first=no, filled=no, key=none, body=none) -> DataFrame:
        zeros = F.lit(0)
        of_rank = [rank[c] if rank is not None else zeros for c in ("late", "thread_ord", "post_ord")]
        of_at = [at[c] if at is not None else zeros for c in ("thread_ord", "post_ord")]
        whole = [F.lit(section), *of_rank, F.lit(kind), *of_at]
        return table.select("web_id", *[x.cast("int").alias(n) for x, n in zip(whole, _PLACE, strict=True)], F.lit(kind).alias("kind"), first.alias("first"), filled.alias("filled"), key.alias("key"), body.alias("body"))

    def column_json(*fields: str):
        return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})

    firsts = heads.select("web_id", "first_thread", "first_edge")
    opened, rank = threads.join(firsts, "web_id"), F.col("rank")
    held = posts.join(threads.select("web_id", "root", "rank", F.col("at").alias("first_at")), ["web_id", "root"])
    quoted, spot = edges.join(firsts, "web_id"), {"thread_ord": F.col("edge_ord"), "post_ord": F.lit(0)}
    meta = column_json(F.lit(2).alias("format_version"), "root_uri", "crawled_at", "node_count", "edge_count", "thread_count")
    pieces = (
        rows(heads, 0, 0, body=meta)
        .unionByName(rows(opened, 1, 1, rank, first=rank == F.col("first_thread"), key=F.col("thread_root")))
        .unionByName(rows(held, 1, 2, rank, F.col("at"), first=F.col("at") == F.col("first_at"), key=F.col("uri"), body=column_json("uri", "post.*")))
        .unionByName(rows(opened, 1, 3, rank, filled=F.col("at").isNotNull()))
        .unionByName(rows(heads, 2, 4, filled=F.col("thread_count") > 0))
        .unionByName(rows(quoted, 2, 5, at=spot, first=F.col("edge_ord") == F.col("first_edge"), body=column_json("source", "target", "source_thread", "target_thread")))
        .unionByName(rows(heads, 3, 6, filled=F.col("edges") > 0))
    )
    blocks = pieces.mapInPandas(_blocks, "web_id string, " + ", ".join(f"{n} int" for n in _PLACE) + ", block string")
    return text_parts(blocks, list(_PLACE), scratch).withColumnRenamed("text", "json")


def web_documents(webs: Webs) -> DataFrame:
    """(web_id, json): each web's document as one row, for webs that a row can hold; see :func:`document_parts`."""
    ordered = F.sort_array(F.collect_list(F.struct("part", "json")))
    return document_parts(webs).groupBy("web_id").agg(F.array_join(F.transform(ordered, lambda p: p["json"]), "").alias("json"))
