"""Token ids in raw shard files, with a minimal perfect hash index from document keys to their place.

Format. ``ids-<shard>.bin``: the ids of the shard's documents end to end, little-endian, two bytes each
where the vocabulary allows, else four. ``index-<bucket>.bin``: a perfect hash, then for each of its
numbers a record (fingerprint, shard, ids before the document in its shard, ids of the document).
``manifest``: a Parquet table of shards (shard, first id, ids, documents).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm import files
from loomgraph.llm.perfect_hash import PerfectHash, mix
from loomgraph.llm.scratch import Scratch
from loomgraph.llm.tokens import encoder

_SHARD_BYTES = 16 << 20  # of text
_KEYS_A_BUCKET = 65_536
_ROWS_AT_ONCE = 256
_RECORD = np.dtype([("fingerprint", "<u4"), ("shard", "<u4"), ("start", "<u8"), ("n", "<u4")])
_NO_KEY = np.uint64(0x6E756C6C6B657921)  # stands for a null doc_id


def _keys(doc_id: pd.Series, copy: pd.Series) -> np.ndarray:
    """64-bit keys of (doc_id, number of earlier rows with that doc_id)."""
    ids = np.where(doc_id.isna(), 0, doc_id.fillna(0)).astype(np.int64).view(np.uint64)
    ids = np.where(doc_id.isna(), _NO_KEY, ids)
    copies = copy.to_numpy(np.uint64)
    return np.where(copies == 0, ids, ids ^ mix(copies, 77))


def _fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 1234567) >> np.uint64(32)).astype(np.uint32)


def write_token_files(documents: DataFrame, tokenizer: str, end_id: int, folder: str, scratch: Scratch) -> DataFrame:
    """Encode every whole text, append ``end_id``, and write shard files, index and manifest to ``folder``.

    Documents stand in ascending doc_id order across shards, null ids first, repeated ids in the order of
    their texts. A null or empty text is the end id alone. Needs columns doc_id and text; others are
    ignored. Returns the table of keys written (doc_id, copy). ``folder`` is a URI that every executor
    reaches. A task writes its shard under another name and renames it, so a task run again is harmless.
    """
    spark = documents.sparkSession
    files.make_folder(folder)
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // _SHARD_BYTES))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        enc, out, start, last, copy = encoder(tokenizer), None, 0, object(), 0
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for k in range(0, len(ids), _ROWS_AT_ONCE):
                rows = []
                for doc_id, data in zip(ids[k : k + _ROWS_AT_ONCE], enc.encode(texts[k : k + _ROWS_AT_ONCE].to_pylist()), strict=True):
                    if out is None:
                        out = files.Replacing(f"{folder}/ids-{shard:08d}.bin")
                    out.write(data)
                    out.write(end)
                    n = len(data) // enc.dtype.itemsize + 1
                    last, copy = doc_id, (copy + 1 if doc_id == last else 0)
                    rows.append((doc_id, copy, shard, start, n))
                    start += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)],
                    ["doc_id", "copy", "shard", "start", "n"],
                )
        if out is not None:
            out.close()

    ordered = (
        documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        .repartitionByRange(shards, "doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    entries = scratch.save(ordered.mapInArrow(write, "doc_id long, copy long, shard int, start long, n long"), "entries")

    totals = entries.groupBy("shard").agg(F.sum("n").alias("ids"), F.count("*").alias("documents"))
    ahead = F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    totals.select("shard", F.coalesce(ahead, F.lit(0)).alias("first_id"), "ids", "documents").write.parquet(f"{folder}/manifest")

    def index(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        keys = _keys(rows["doc_id"], rows["copy"])
        hash_ = PerfectHash.build(keys)
        at = hash_.lookup(keys)
        table = np.zeros(len(keys), _RECORD)
        table["fingerprint"][at] = _fingerprints(keys)
        for name in ("shard", "start", "n"):
            table[name][at] = rows[name].to_numpy()
        files.put(f"{folder}/index-{key[0]:08d}.bin", hash_.to_bytes() + table.tobytes())
        return pd.DataFrame({"bucket": [key[0]], "keys": [len(keys)]})

    buckets = index_buckets(entries.count())
    keyed = entries.withColumn("bucket", _bucket(buckets))
    scratch.save(keyed.groupBy("bucket").applyInPandas(index, "bucket int, keys long"), "index")
    return entries.select("doc_id", "copy")


def index_buckets(keys: int) -> int:
    return max(1, -(-keys // _KEYS_A_BUCKET))


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("doc_id", "copy"), F.lit(buckets)).cast("int")


def read_token_files(keys: DataFrame, folder: str, buckets: int, itemsize: int) -> DataFrame:
    """Look up keys (doc_id, copy) in the index and read their ids: doc_id, start (ids of all documents
    before it), n_tokens and ids (bytes as in the file). Keys that were never written are left out."""
    spark = keys.sparkSession

    def find(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        data = files.get(f"{folder}/index-{key[0]:08d}.bin")
        hash_, at = PerfectHash.from_bytes(data)
        table = np.frombuffer(data, _RECORD, offset=at)
        wanted = _keys(rows["doc_id"], rows["copy"])
        number = hash_.lookup(wanted)
        found = number >= 0
        found[found] = table["fingerprint"][number[found]] == _fingerprints(wanted[found])
        got = table[number[found]]
        return pd.DataFrame({"doc_id": rows["doc_id"][found].astype("Int64"), "shard": got["shard"].astype("int32"), "start": got["start"].astype("int64"), "n": got["n"].astype("int64")})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, f = None, None
        for batch in batches:
            ids = []
            for shard, start, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "start", "n")), strict=True):
                if shard != now:
                    now, f = shard, files.opened(f"{folder}/ids-{shard:08d}.bin")
                f.seek(start * itemsize)
                ids.append(f.read(n * itemsize))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("shard"), batch.column("start"), batch.column("n"), pa.array(ids, pa.binary())], ["doc_id", "shard", "start", "n", "ids"])

    places = keys.withColumn("bucket", _bucket(buckets)).groupBy("bucket").applyInPandas(find, "doc_id long, shard int, start long, n long")
    first = spark.read.parquet(f"{folder}/manifest").select("shard", "first_id")
    return (
        places.repartition("shard")
        .sortWithinPartitions("shard", "start")
        .mapInArrow(read, "doc_id long, shard int, start long, n long, ids binary")
        .join(first, "shard")
        .select("doc_id", (F.col("first_id") + F.col("start")).alias("start"), F.col("n").alias("n_tokens"), "ids")
    )


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    scratch = Scratch(spark, "tokens")
    folder = f"{scratch.root}/files"
    keys = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, 2, folder, scratch)
    itemsize = encoder(path).dtype.itemsize

    @F.pandas_udf("long")
    def crc(ids: pd.Series) -> pd.Series:
        return ids.map(lambda b: zlib.crc32(np.frombuffer(b, f"<u{itemsize}").astype("<u4").tobytes()))

    read = read_token_files(keys, folder, index_buckets(keys.count()), itemsize)
    return read.select("doc_id", "start", "n_tokens", crc("ids").alias("ids_crc32"))
