"""Text shown to readers, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE_BLANKS = r"\A\p{IsWhite_Space}+|\p{IsWhite_Space}+\z"
_LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def short_time(iso: Column) -> Column:
    """The first 16 characters, every T a blank; ? for an empty time."""
    return F.when(iso == "", "?").otherwise(F.substring(F.replace(iso, F.lit("T"), F.lit(" ")), 1, 16))


def author_name(author: Column) -> Column:
    at = F.concat(F.lit("@"), author["handle"])
    return F.when(author["display_name"] == "", at).otherwise(F.concat(author["display_name"], F.lit(" ("), at, F.lit(")")))


def truncate(text: Column, most: int) -> Column:
    """One line of at most ``most`` characters, with dots where it was cut."""
    flat = F.regexp_replace(F.replace(text, F.lit("\n"), F.lit(" ")), _EDGE_BLANKS, "")
    return F.when(F.char_length(flat) <= most, flat).otherwise(F.concat(F.substring(flat, 1, max(0, most - 3)), F.lit("...")))


def split_lines(text: Column) -> Column:
    """The text's lines by all Unicode line ends; no empty line behind the last end, none for an empty text."""
    parts = F.split(text, _LINE_ENDS, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def thousands(n: Column) -> Column:
    return F.format_number(n.cast("bigint"), 0)


def counted(n: Column, one: str, many: str) -> Column:
    return F.concat(thousands(n), F.lit(" "), F.when(n == 1, one).otherwise(many))


def percent(n: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(0.0)).otherwise(n / total * 100)


def engagement(row: str | None = None) -> Column:
    """Likes, reposts and quotes; replies don't count."""
    col = (lambda c: F.col(f"{row}.{c}")) if row else F.col
    return col("like_count") + col("repost_count") + col("quote_count")


def trim_end(text: Column) -> Column:
    return F.regexp_replace(text, r"\p{IsWhite_Space}+\z", "")


def indented(text: Column, indent: Column | str) -> Column:
    """The text's lines, each behind ``indent`` and behind a line end."""
    pad = F.lit(indent) if isinstance(indent, str) else indent
    return F.array_join(F.transform(split_lines(text), lambda x: F.concat(F.lit("\n"), pad, x)), "")
