"""Packing of documents into token sequences by bounded-space best fit.

The packer is online: it places one piece after another and keeps a bounded number of bins open. ``pack``
feeds it a group's longest pieces first, which leaves fewer sequences than the order of arrival.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.tokens import encoder

CAPACITY = 2048
OPEN_BINS = 8192
_DOCUMENTS_A_GROUP = 40_000
_ROWS_AT_ONCE = 256


class BestFit:
    """Bins of ``capacity`` of which at most ``open_bins`` are open.

    Open bins are kept by their free space, in a bitset with a bit for each free space that some open bin
    has: the lowest bit at or above a length names the bin it fits best. When a bin is opened beyond the
    limit, the fullest open one closes.
    """

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.limit = capacity, open_bins
        self.bits, self.open, self.bins = 0, 0, 0
        self.by_free: dict[int, list[int]] = defaultdict(list)

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        number = bins.pop()
        if not bins:
            self.bits ^= 1 << free
        self.open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """The bin for a piece of 1 to ``capacity`` tokens, and the piece's offset in it."""
        if fits := self.bits >> length:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.capacity, self.bins
            self.bins += 1
        left = free - length
        if left:
            if self.open >= self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
            self.by_free[left].append(number)
            self.bits |= 1 << left
            self.open += 1
        return number, self.capacity - free


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first piece of a cut document may be short."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def tokenised_pieces(documents: DataFrame, tokenizer: str, end_id: int, capacity: int, groups: int, with_ids: bool = False) -> DataFrame:
    """Every document's ids, ``end_id`` appended, as pieces: doc_id, piece, start, length, ids_crc32, group
    (rows dealt evenly, the same way each time a task runs) and, if asked for, ids (little-endian, unsigned
    32 bits). A null or empty text is the end id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, turn = encoder(tokenizer), TaskContext.get().partitionId() * 7919
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for k in range(0, len(doc_ids), _ROWS_AT_ONCE):
                rows = []
                for doc_id, data in zip(doc_ids[k : k + _ROWS_AT_ONCE], enc.encode(texts[k : k + _ROWS_AT_ONCE].to_pylist()), strict=True):
                    ids = np.frombuffer(data + end, enc.dtype).astype("<u4")
                    for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                        own = ids[start : start + length].tobytes()
                        turn += 1
                        rows.append((doc_id, piece, start, length, zlib.crc32(own), turn % groups, *[own] * with_ids))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * with_ids]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "group", *["ids"] * with_ids])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, group int" + ", ids binary" * with_ids
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """Add sequence_id and offset to pieces (``length`` from 1 to ``capacity``, ``group``).

    Each group is packed by itself, its longest pieces first, so a task holds about 40,000 documents'
    pieces; a group leaves a few unfilled sequences behind, however large the input.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins = BestFit(capacity, open_bins)
        placed = np.array([bins.place(n) for n in rows["length"].tolist()], np.int64).reshape(-1, 2)
        return rows.assign(doc_id=rows["doc_id"].astype("Int64"), sequence_id=(int(key[0]) << 32) + placed[:, 0], offset=placed[:, 1]).drop(columns="group")

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name != "group")
    return pieces.groupBy("group").applyInPandas(run, f"{fields}, sequence_id long, offset long")


def pack_documents(documents: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, with_ids: bool = False) -> DataFrame:
    """Pack all documents into as few sequences of at most ``capacity`` tokens as best fit finds.

    Needs doc_id and text; other columns are ignored. Repeated rows and null ids are documents like any
    other. An empty table gives an empty result.
    """
    groups = max(1, -(-documents.count() // _DOCUMENTS_A_GROUP))
    return pack(tokenised_pieces(documents, tokenizer, end_id, capacity, groups, with_ids), capacity, open_bins)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pieces with ids: sequence_id, length, ids (little-endian, 32 bits)."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["length"]).alias("length"),
        F.aggregate("parts", F.lit(b""), lambda ids, p: F.concat(ids, p["ids"])).alias("ids"),
    )


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
