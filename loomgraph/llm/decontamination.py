"""Benchmark items found in documents, as they are or nearly so. DataFrame operations only.

Every place of a document that shares a shingle with an item opens a window of the item's length. A window
is known by its SimHash; an index over blocks of the fingerprints finds every item of that length within
the Hamming radius, and the exact similarity of the weighted shingles decides.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.columns import let
from loomgraph.llm.scratch import Scratch


@dataclass(frozen=True)
class Decontamination:
    """``words`` of a shingle, ``percent`` of similarity that tells a copy, and the Hamming ``radius``.

    Fingerprints have 64 bits, cut into ``radius`` + 1 blocks: two within the radius agree in a block at
    least. Sets alike by 0.8 differ in about 9.7 bits with a deviation of 2.9, so 19 bits leave out one in
    a thousand at the threshold, fewer above it, and equal windows never. ``broadcast_rows``: item shingles
    up to which they are sent to all tasks; beyond it both sides are shuffled. ``inside``: whether an item of
    fewer words than a shingle is looked for at every place; else only where it is the whole document.
    """

    words: int = 5
    percent: int = 80
    radius: int = 19
    broadcast_rows: int = 500_000
    inside: bool = True


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _shingles(text: Column, n: int) -> Column:
    """(words, hashes): the number of words, and hashes of the n words from each place on; one of all words
    where there are fewer."""

    def hashed(words: Column) -> Column:
        following = F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, n)]))
        return F.struct(F.size(words).alias("words"), F.slice(following, F.lit(1), F.greatest(F.size(words) - (n - 1), F.least(F.size(words), F.lit(1)))).alias("hashes"))

    return let(_words(text), hashed)


def simhash(hashes: Column) -> Column:
    """64 bits: each is the majority of that bit over the hashes, repeated ones as often as they occur."""
    ones = lambda b: F.aggregate(hashes, F.lit(0), lambda n, x: n + F.shiftrightunsigned(x, b).bitwiseAND(1).cast("int"))
    bits = [F.when(2 * ones(b) > F.size(hashes), F.lit(1 << b if b < 63 else -(1 << 63)).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for b in range(64)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def _blocks(fingerprint: Column, radius: int) -> Column:
    """(block, its bits) for radius + 1 blocks of nearly equal width."""
    cuts = [64 * k // (radius + 1) for k in range(radius + 2)]
    return F.array(*[F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(fingerprint, a).bitwiseAND((1 << (b - a)) - 1).alias("bits")) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))])


def _counted(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, F.explode("hashes").alias("h")).groupBy(key, "h").agg(F.count("*").alias("c"))


def _phrases(documents: DataFrame, items: DataFrame, how: Decontamination) -> list[DataFrame]:
    """Matches of items (item_id, n_words, hashes) shorter than a shingle: their words in a row, at the first
    place. One table for each number of words that they have."""
    out = []
    for n, size in items.where(F.col("n_words") < how.words).groupBy("n_words").count().collect():
        own = items.where(F.col("n_words") == n).select("item_id", F.col("hashes")[0].alias("h"))
        known = own.select("h").distinct()
        if size <= how.broadcast_rows:
            known = F.broadcast(known)
        each = documents.where("text is not null").select("doc_id", F.xxhash64("doc_id", "text").alias("row"), F.posexplode(_shingles(F.col("text"), n)["hashes"]).alias("start", "h"))
        firsts = each.join(known, "h").groupBy("doc_id", "row", "h").agg(F.min("start").alias("start"))
        out.append(firsts.join(own, "h").select("doc_id", "row", "item_id", F.lit(1.0).alias("similarity"), F.lit(0).alias("distance"), "start", F.lit(n).alias("n_words")))
    return out


def find_items(documents: DataFrame, benchmark: DataFrame, how: Decontamination = Decontamination()) -> DataFrame:
    """Every (doc_id, item_id) where the document has the item, with its best window: similarity (weighted
    Jaccard of word shingles, 0.8 or more), distance (of the fingerprints), start (word), n_words.

    ``documents``: doc_id, text; ``benchmark``: item_id, text; other columns are ignored. Words are runs of
    letters and digits, lower-cased; a shingle's weight is how often it occurs. A window has its item's
    number of words, fewer where the document is shorter. Items and documents without words match nothing;
    rows equal in doc_id and text give one match; null ids are kept. Either table may be empty. An item of
    fewer words than a shingle matches where its words stand in a row.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "items")
    items = benchmark.where("text is not null").select("item_id", _shingles(F.col("text"), how.words).alias("s"))
    items = items.select("item_id", F.col("s.words").alias("n_words"), "s.hashes").where("n_words > 0")
    items = scratch.save(items.withColumn("item", F.xxhash64("item_id", "hashes")).dropDuplicates(["item"]), "items")
    phrases = _phrases(documents, items, how) if how.inside else []
    if how.inside:
        items = items.where(F.col("n_words") >= how.words)
    places = items.select("item", "n_words", F.posexplode("hashes").alias("at", "h"))
    known = places.select("h").distinct()
    if (items.agg(F.sum(F.size("hashes"))).first()[0] or 0) <= how.broadcast_rows:
        known = F.broadcast(known)

    row = F.xxhash64("doc_id", "text")
    shingled = documents.where("text is not null").select(row.alias("row"), _shingles(F.col("text"), how.words).alias("s"))
    hits = shingled.select("row", F.col("s.words").alias("doc_words"), F.posexplode("s.hashes").alias("pos", "h")).join(known, "h")
    hits = scratch.save(hits, "hits")
    start = F.greatest(F.least(F.col("pos") - F.col("at"), F.col("doc_words") - F.col("n_words")), F.lit(0))
    opened = hits.join(places, "h").select("row", start.alias("start"), "n_words").distinct()
    wanted = opened.groupBy("row").agg(F.collect_list(F.struct("start", "n_words")).alias("wanted"))

    held = documents.where("text is not null").select("doc_id", row.alias("row"), "text").join(wanted, "row").dropDuplicates(["row"])
    held = held.select("doc_id", "row", "wanted", _shingles(F.col("text"), how.words).alias("s"))
    cut = held.select("doc_id", "row", "s.hashes", F.explode("wanted").alias("w")).select("doc_id", "row", "w.start", "w.n_words", F.slice("hashes", F.col("w.start") + 1, F.greatest(F.col("w.n_words") - (how.words - 1), F.lit(1))).alias("hashes"))
    windows = scratch.save(cut.withColumn("window", F.xxhash64("row", "start", "n_words")).withColumn("fingerprint", simhash(F.col("hashes"))), "windows")
    items = scratch.save(items.withColumn("item_fingerprint", simhash(F.col("hashes"))), "marked")

    index = items.select("item", "n_words", "item_fingerprint", F.inline(_blocks(F.col("item_fingerprint"), how.radius)))
    probes = windows.select("window", "n_words", "fingerprint", F.inline(_blocks(F.col("fingerprint"), how.radius)))
    distance = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_fingerprint")))
    near = probes.join(index, ["n_words", "block", "bits"]).select("window", "item", distance.alias("distance")).where(F.col("distance") <= how.radius).distinct()

    sizes = near.join(windows.select("window", F.size("hashes").alias("a")), "window").join(items.select("item", F.size("hashes").alias("b")), "item")
    both = near.select("window", "item").join(_counted(windows, "window"), "window").join(_counted(items, "item").withColumnRenamed("c", "d"), ["item", "h"])
    shared = both.groupBy("window", "item").agg(F.sum(F.least("c", "d")).alias("shared"))
    matched = sizes.join(shared, ["window", "item"]).withColumn("union", F.col("a") + F.col("b") - F.col("shared")).where(100 * F.col("shared") >= how.percent * F.col("union"))
    matched = matched.select("window", "item", "distance", (F.col("shared") / F.col("union")).alias("similarity"))
    named = matched.join(windows.select("window", "doc_id", "row", "start", "n_words"), "window").join(items.select("item", "item_id"), "item")
    named = reduce(DataFrame.unionByName, phrases, named.select("doc_id", "row", "item_id", "similarity", "distance", "start", "n_words"))
    best = F.min(F.struct((-F.col("similarity")).alias("worse"), "start", "n_words", "distance")).alias("best")
    return named.groupBy("doc_id", "row", "item_id").agg(best).select("doc_id", "row", "item_id", (-F.col("best.worse")).alias("similarity"), "best.distance", "best.start", "best.n_words")


def decontaminated(documents: DataFrame, benchmark: DataFrame, how: Decontamination = Decontamination()) -> DataFrame:
    """The documents that hold no item, however short; their columns pass through, whatever their names."""
    marked = find_items(documents, benchmark, how).select("row").distinct()
    keyed = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("of"), F.xxhash64("doc_id", "text").alias("row"))
    return keyed.join(marked, "row", "left_anti").select("of.*")


def op9_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("row")
