"""The responses that a network holding given webs would send, as tables to fetch from."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.schema import Webs

#: Names of a thread's nodes and of a quoting embed.
_VIEW, _RECORD = "app.bsky.feed.defs#threadViewPost", "app.bsky.embed.record"
_SHOWN = ("thread_root", "uri", "cid", "author", "text", "created_at", "reply_parent", "reply_root", "embed_uri", "like_count", "reply_count", "repost_count", "quote_count")


def _view(post: dict) -> dict:
    record = {"text": post["text"], "createdAt": post["created_at"]}
    if post["reply_parent"]:
        record["reply"] = {"root": {"uri": post["reply_root"]}, "parent": {"uri": post["reply_parent"]}}
    if post["embed_uri"]:
        record["embed"] = {"$type": _RECORD, "record": {"uri": post["embed_uri"]}}
    author = post["author"]
    counts = {f"{k}Count": int(post[f"{k}_count"]) for k in ("like", "reply", "repost", "quote")}
    return {"uri": post["uri"], "cid": post["cid"], "author": {"did": author["did"], "handle": author["handle"], "displayName": author["display_name"]}, "record": record, **counts}


def _thread(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    posts = rows.sort_values("post_ord").to_dict("records")
    nodes = {p["uri"]: {"$type": _VIEW, "post": _view(p), "replies": []} for p in posts}
    for p in posts:
        if p["reply_parent"] in nodes and p["uri"] != key[1]:
            nodes[p["reply_parent"]]["replies"].append(nodes[p["uri"]])
    return pd.DataFrame({"web_id": [key[0]], "uri": [key[1]], "body": [json.dumps({"thread": nodes[key[1]]})]})


def thread_responses(webs: Webs) -> DataFrame:
    """(web_id, uri, body): each thread under its root's uri; threads without their root post have no response."""
    rooted = webs.posts.where("uri = thread_root").select("web_id", "thread_root").distinct()
    posts = webs.posts.select("web_id", "post_ord", *_SHOWN).join(rooted, ["web_id", "thread_root"])
    return posts.groupBy("web_id", "thread_root").applyInPandas(_thread, "web_id string, uri string, body string")


def _page(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    posts = [_view(p) for p in rows.sort_values("k").to_dict("records")]
    return pd.DataFrame({"web_id": [key[0]], "uri": [key[1]], "page": [key[2]], "body": [json.dumps({"posts": posts})]})


def quote_responses(webs: Webs, page: int = 100) -> DataFrame:
    """(web_id, uri, page, body): the posts that quote each post, ``page`` at a time, in the order of their edges."""
    place = F.row_number().over(Window.partitionBy("web_id", "source").orderBy("edge_ord")) - 1
    quotes = webs.edges.select("web_id", "source", F.col("target").alias("uri"), place.alias("k"))
    posts = quotes.join(webs.posts.select("web_id", *_SHOWN), ["web_id", "uri"]).withColumn("page", F.floor(F.col("k") / page).cast("int"))
    return posts.groupBy("web_id", "source", "page").applyInPandas(_page, "web_id string, uri string, page int, body string")
