"""Row numbers by time, and the first rows of each web."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.positions import numbered
from loomgraph.store import Scratch


def chronological(posts: DataFrame, by: list[str] | None = None, name: str = "n") -> DataFrame:
    """Add ``name``, the row's number within its ``by`` (web_id) in order of created_at (as text) and web order, and
    ``total``. The rows are written once, in that order, so what reads them again doesn't compute them again."""
    return numbered(posts, by or ["web_id"], ["created_at", "thread_ord", "post_ord"], Scratch(posts.sparkSession, "times"), name)


def top(rows: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """The first ``k`` rows of each web with their rank from 1; ``order`` must leave no ties."""
    rank = F.row_number().over(Window.partitionBy("web_id").orderBy(*order))
    return rows.withColumn("rnk", rank).where(F.col("rnk") <= k)
