"""An index of texts by their trigrams, for searches that read what could match and not all posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64  # folders of an index, by a hash of the trigram
_SCHEMA = "web_id string, uri string, gram string, bucket int"


def grams(text: Column) -> Column:
    """The distinct trigrams of a text in lower case, by code points; none of a shorter text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(...))"), F.lit(1)))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def index_texts(posts: DataFrame, path: str) -> None:
    """Write, or add, the postings of ``posts`` (web_id, uri, text): trigram to post, sorted within the folder of the
    trigram's bucket; a frequent trigram fills as many files as it needs. Posts whose text changes are added anew:
    a search checks what it finds."""
    each = posts.select("web_id", "uri", F.explode(grams(F.col("text"))).alias("gram")).withColumn("bucket", _bucket(F.col("gram")))
    order = ["bucket", "gram", "web_id", "uri"]
    each.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("append").partitionBy("bucket").parquet(path)


def candidates(spark: SparkSession, path: str, query: str) -> DataFrame | None:
    """(web_id, uri) of the indexed posts that hold every trigram of ``query``; None for a query without trigrams, for
    which the index says nothing. The scan is limited to the trigrams' folders and rows."""
    wanted = [r.gram for r in spark.range(1).select(F.explode(grams(F.lit(query))).alias("gram")).collect()]
    if not wanted:
        return None
    buckets = [r.b for r in spark.createDataFrame([(g,) for g in wanted], "gram string").select(_bucket(F.col("gram")).alias("b")).distinct().collect()]
    found = spark.read.schema(_SCHEMA).parquet(path).where(F.col("bucket").isin(buckets) & F.col("gram").isin(wanted))
    return found.groupBy("web_id", "uri").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(wanted)).select("web_id", "uri")
