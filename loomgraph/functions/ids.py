"""Identifiers of posts and webs, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The collection of posts, and the two ways a post is referred to.
POST_COLLECTION = "app.bsky.feed.post"
_AT_POST = r"\Aat://([^/]+)/app\.bsky\.feed\.post/([A-Za-z0-9]+)\z"
_WEB_POST = r"\Ahttps?://bsky\.app/profile/([^/]+)/post/([A-Za-z0-9]+)\z"
_AT_PARTS = r"\Aat://([^/]+)/([^/]+)/([^/]+)\z"


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def post_ref(text: Column) -> Column:
    """struct(repo, rkey) of an at:// or web reference to a post, blanks around it ignored; null for anything else."""
    trimmed = F.regexp_replace(text, r"\A\p{IsWhite_Space}+|\p{IsWhite_Space}+\z", "")
    repo, rkey = (F.coalesce(_part(trimmed, _AT_POST, k), _part(trimmed, _WEB_POST, k)) for k in (1, 2))
    return F.when(repo.isNotNull(), F.struct(repo.alias("repo"), rkey.alias("rkey")))


def at_uri(repo: Column, rkey: Column) -> Column:
    return F.concat(F.lit("at://"), repo, F.lit(f"/{POST_COLLECTION}/"), rkey)


def split_at_uri(uri: Column) -> Column:
    """struct(authority, collection, rkey); null unless there are exactly three parts, none empty."""
    names = ("authority", "collection", "rkey")
    return F.when(uri.rlike(_AT_PARTS), F.struct(*[_part(uri, _AT_PARTS, k + 1).alias(n) for k, n in enumerate(names)]))


def is_post_uri(uri: Column) -> Column:
    return F.coalesce(split_at_uri(uri)["collection"] == POST_COLLECTION, F.lit(False))


def rkey_of(uri: Column) -> Column:
    """What stands behind the last slash, or the whole where there is none."""
    return F.substring_index(uri, "/", -1)


def post_uri_from_link(url: Column) -> Column:
    """The post a link points at: an at:// post URI as it stands, a web link resolved; else null."""
    verbatim = url.startswith("at://") & url.contains(f"/{POST_COLLECTION}/")
    ref = post_ref(url)
    return F.when(verbatim, url).when(ref.isNotNull(), at_uri(ref["repo"], ref["rkey"]))


def web_id(root_uri: Column) -> Column:
    """A web's name: the root's rkey and six hex digits of the root URI's SHA-256."""
    return F.concat(rkey_of(root_uri), F.lit("-"), F.substring(F.sha2(root_uri.cast("binary"), 256), 1, 6))
