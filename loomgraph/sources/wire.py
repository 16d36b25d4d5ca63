"""Responses of the network's two endpoints, flattened to posts."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.schema import AUTHOR, FACETS

_OUT = (
    f"web_id string, asked string, ord int, response_root string, uri string, cid string, author {AUTHOR}, text string, created_at string, reply_parent string, reply_root string, "
    f"embed_type string, embed_uri string, facets {FACETS}, labels array<string>, langs array<string>, like_count bigint, reply_count bigint, repost_count bigint, quote_count bigint, job bigint, error string"
)
#: Places that a page of quotes has in the order of a uri's pages; the network's pages hold 100.
PAGE_ROWS = 1000
#: Names of node kinds, embeds and text features.
_VIEW, _HIDDEN = "app.bsky.feed.defs#threadViewPost", ("app.bsky.feed.defs#notFoundPost", "app.bsky.feed.defs#blockedPost")
_RECORD, _WITH_MEDIA = "app.bsky.embed.record", "app.bsky.embed.recordWithMedia"
_FEATURES = {f"app.bsky.richtext.facet#{k}": k for k in ("mention", "link", "tag")}
_PAYLOAD = {"mention": "did", "link": "uri", "tag": "tag"}


def _feature(x: dict) -> dict:
    kind = _FEATURES.get(x["$type"], x["$type"])
    payload = _PAYLOAD.get(kind)
    return {"type": kind} | {k: x.get(k) if k == payload else None for k in ("did", "uri", "tag")}


def post_row(view: dict) -> dict:
    """A post as the network shows it, as a row of posts."""
    record, author = view["record"], view["author"]
    reply, embed = record.get("reply") or {}, record.get("embed") or {}
    quoted = {_RECORD: lambda: embed["record"]["uri"], _WITH_MEDIA: lambda: embed["record"]["record"]["uri"]}.get(embed.get("$type"))
    return {
        "uri": view["uri"],
        "cid": view["cid"],
        "author": {"did": author["did"], "handle": author["handle"], "display_name": author.get("displayName") or ""},
        "text": record.get("text") or "",
        "created_at": record.get("createdAt") or "",
        "reply_parent": reply["parent"]["uri"] if reply else None,
        "reply_root": reply["root"]["uri"] if reply else None,
        "embed_type": embed["$type"] if quoted else None,
        "embed_uri": quoted() if quoted else None,
        "facets": [{"index": {k: f["index"][k] for k in ("byteStart", "byteEnd")}, "features": [_feature(x) for x in f["features"]]} for f in record.get("facets") or []],
        "labels": [x["val"] for x in view.get("labels") or []],
        "langs": record.get("langs") or [],
        **{f"{k}_count": view.get(f"{k}Count") or 0 for k in ("like", "reply", "repost", "quote")},
    }


def _shown(node: dict | None) -> bool:
    if node is None:
        return False
    if node["$type"] != _VIEW and node["$type"] not in _HIDDEN:
        raise ValueError(f"unknown node {node['$type']}")
    return node["$type"] == _VIEW


def thread_rows(body: str, asked: str) -> list[dict]:
    """The posts of a thread response: a node, its parents upwards, then its replies; each once, hidden nodes with
    all below them left out. ``response_root`` is the topmost visible ancestor; without a visible one the first
    post whose parent isn't among the posts, else what was asked for."""
    node, stack, rows = json.loads(body)["thread"], [], {}
    stack.append(node)
    while stack:
        x = stack.pop()
        if not _shown(x):
            continue
        rows.setdefault(x["post"]["uri"], post_row(x["post"]))
        stack.extend(reversed(x.get("replies") or []))
        if x.get("parent"):
            stack.append(x["parent"])
    root = None
    while _shown(node):
        root, node = node["post"]["uri"], node.get("parent")
    if root is None:
        root = next((u for u, p in rows.items() if p["reply_parent"] not in rows), asked)
    return [{**p, "ord": k, "response_root": root} for k, p in enumerate(rows.values())]


def quote_rows(body: str, asked: str) -> list[dict]:
    """The posts of a page of quotes, in its order."""
    return [{**post_row(p), "ord": k, "response_root": None} for k, p in enumerate(json.loads(body).get("posts") or [])]


def _flatten(responses: DataFrame, rows_of) -> DataFrame:
    names = [f.split()[0] for f in _OUT.replace(AUTHOR, "x").replace(FACETS, "x").split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for web, asked, body, job, page, error in batch[["web_id", "uri", "body", "job", "page", "error"]].itertuples(index=False):
                known, first = {"web_id": web, "asked": asked, "job": job}, int(page) * PAGE_ROWS
                try:
                    if error is not None:
                        raise ConnectionError(error)
                    out += [{**known, "error": None, **r, "ord": first + r["ord"]} for r in rows_of(body, asked)]
                except (ValueError, KeyError, TypeError, RecursionError, ConnectionError) as e:
                    said = f"Fetch: {error}" if error is not None else f"Decode: {e!r}"
                    out.append({**known, "ord": first, "error": said[:200]})
            yield pd.DataFrame({n: pd.Series([r.get(n) for r in out], dtype=object) for n in names})

    given = {"job": F.lit(0).cast("bigint"), "page": F.lit(0), "error": F.lit(None).cast("string")}
    given = [(F.col(n).cast(c) if n in responses.columns else x).alias(n) for (n, x), c in zip(given.items(), ("bigint", "int", "string"), strict=True)]
    return responses.select("web_id", "uri", "body", *given).mapInPandas(run, _OUT)


def thread_posts(responses: DataFrame) -> DataFrame:
    """Posts of thread responses (web_id, uri asked for, body, and job, their order, and error where given). A body
    that can't be read, or an error given, is one row with its error.

    Python reads the JSON: replies nest far deeper than Spark's JSON functions go.
    """
    return _flatten(responses, thread_rows)


def quoting_posts(pages: DataFrame) -> DataFrame:
    """Posts of pages of quotes (web_id, uri asked for, body, and job, page from 0 and error where given).

    Pages follow one another until one fails or can't be read: what the pages before it bring is kept, it leaves a
    row with its error, and pages behind it count as never asked for. ``ord`` goes on over a uri's pages.
    """
    posts = _flatten(pages, quote_rows)
    if "page" not in pages.columns:
        return posts
    key = ["web_id", "asked", "job"]
    ends = posts.where("error is not null").groupBy(*key).agg(F.min("ord").alias("_end"))
    within = (F.col("_end").isNull() | (F.col("ord") < F.col("_end"))) & F.col("error").isNull()
    return posts.join(ends, key, "left").where(within | ((F.col("ord") == F.col("_end")) & F.col("error").isNotNull())).select(*posts.columns)
