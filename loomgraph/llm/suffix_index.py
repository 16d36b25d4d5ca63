"""Removal of long strings that repeat, by a logarithmic family of suffix arrays.

A suffix array is a table of suffixes in the order of the fingerprint of their first ``key`` bytes. It holds the
suffixes that start at *anchors*: of the 201 starts within a string of 400 bytes whose next 200 bytes lie inside
it, the one of the smallest fingerprint. Equal strings have their anchors at the same place, so arrays of a
hundredth of all suffixes find every repeat. Consecutive strings of one anchor make a *run*; its text from the
first string's start to the last one's end is the anchor's context.

New batches become arrays of their own, are scanned against the arrays there are for anchors that both hold, and
two arrays of equally many batches merge into one. Where the contexts of an anchor's copies are equal all their
strings repeat; where they differ, the contexts' bytes are fetched and their strings compared place by place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.rolling import BYTE, Sums, mixed
from loomgraph.llm.scratch import Scratch

_PIECE = 1 << 20  # bytes that numpy looks at together; a longer text is seen in pieces that overlap
_DOC = ["_id", "_hash"]  # a text: its document's id and its own hash
_LOW = np.uint64(0xFFFFFFFF)
_RUN = "k long, c long, lo int, q int, hi int"


@dataclass(frozen=True)
class LongRepeats:
    """``length`` of a string that counts, ``key``: bytes that order suffixes, ``batches`` that the documents are
    dealt into, ``together``: contexts of an anchor up to which one task compares them."""

    length: int = 400
    key: int = 200
    batches: int = 4
    together: int = 1024


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` consecutive values, from minima that run through blocks both ways."""
    n = len(values) - width + 1
    blocks = np.full(-(-len(values) // width) * width, np.uint64(2**64 - 1))
    blocks[: len(values)] = values
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def _starts(limits: np.ndarray, length: int) -> np.ndarray:
    """The starts of all strings of ``length`` that lie inside one of the stretches between ``limits``."""
    counts = np.maximum(np.diff(limits) - length + 1, 0)
    before = np.cumsum(counts) - counts
    return np.repeat(limits[:-1] - before, counts) + np.arange(counts.sum())


def find_runs(data: np.ndarray, limits: np.ndarray, how: LongRepeats) -> dict[str, np.ndarray]:
    """Runs of the texts that stand in ``data`` between ``limits``: k (fingerprint of the anchor's next bytes), c (of
    the context and the anchor's place in it), lo and hi (first and last start), q (anchor)."""
    starts = _starts(limits, how.length)
    if not len(starts):
        return {x: np.zeros(0, np.uint64) for x in "kc"} | {x: np.zeros(0, np.int64) for x in ("lo", "q", "hi")}
    sums = Sums(BYTE[data])
    keys = sums.all_of(how.key)
    # the place in the low half: of equal fingerprints the first, and the anchor can be read off the minimum
    anchor = (_least((keys & ~_LOW) | np.arange(len(keys), dtype=np.uint64), how.length - how.key + 1)[starts] & _LOW).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    last = np.concatenate([first[1:], [len(starts)]]) - 1
    lo, q, hi = starts[first], anchor[first], starts[last]
    with np.errstate(over="ignore"):
        place = mixed((q - lo).astype(np.uint64) * np.uint64(1 << 32) + (hi - lo).astype(np.uint64))
        return {"k": keys[q], "c": mixed(sums.of(lo, hi + how.length) + place), "lo": lo, "q": q, "hi": hi}


def _pieces(offsets: np.ndarray, how: LongRepeats) -> Iterator[tuple[int, int, int, int]]:
    """(row, rows, start, end): rows that together have about a piece's bytes, and the pieces of longer ones."""
    row = 0
    while row < len(offsets) - 1:
        start, end = int(offsets[row]), int(offsets[row + 1])
        if end - start > _PIECE:
            for at in range(start, end - how.length + 1, _PIECE):
                yield row, 1, at, min(end, at + _PIECE + how.length - 1)
            row += 1
            continue
        rows = max(1, int(np.searchsorted(offsets, start + _PIECE, "right")) - 1 - row)
        yield row, rows, start, int(offsets[row + rows])
        row += rows


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A binary column's bytes and its rows' offsets in them."""
    column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buffer = column.buffers()[2]
    return np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8), offsets


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _runs(batches: Iterator[pa.RecordBatch], how: LongRepeats) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = _bytes(batch.column("data"))
        for row, rows, start, end in _pieces(offsets, how):
            limits = np.array([0, end - start]) if rows == 1 else offsets[row : row + rows + 1] - start
            found = find_runs(data[start:end], limits, how)
            of = row + np.searchsorted(limits, found["lo"], "right") - 1
            shift = start - offsets[of]
            names = [batch.column(x).take(pa.array(of)) for x in _DOC]
            places = [pa.array((found[x] + shift).astype(np.int32)) for x in ("lo", "q", "hi")]
            yield pa.RecordBatch.from_arrays([*names, _signed(found["k"]), _signed(found["c"]), *places], [*_DOC, "k", "c", "lo", "q", "hi"])


def _named(documents: DataFrame) -> DataFrame:
    """doc_id as ``_id``, the text's bytes as ``data`` and their hash."""
    data = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return documents.select(F.col("doc_id").cast("bigint").alias("_id"), F.xxhash64(data).alias("_hash"), data.alias("data"))


class SuffixFamily:
    """The arrays of all batches so far: ``levels`` of (batches, table of k, c, n, at), of which no two have equally
    many batches once a batch is added, and ``shared``: for each batch the keys it shares with itself or others.

    A table has a row for each key and context: n counts its runs, ``at`` is one of them.
    """

    def __init__(self, scratch: Scratch):
        self.scratch, self.levels, self.shared = scratch, [], []

    def add(self, runs: DataFrame) -> None:
        """Take in a batch's runs (``_id``, ``_hash``, k, c, lo, q, hi)."""
        at = F.min(F.struct(*_DOC, "lo", "q", "hi")).alias("at")
        array = self.scratch.save(runs.groupBy("k", "c").agg(F.count("*").alias("n"), at), "array")
        own = array.groupBy("k").agg(F.sum("n").alias("n")).where("n > 1").select("k")
        scans = [array.join(level.select("k").distinct(), "k", "left_semi").select("k") for _, level in self.levels]
        self.shared.append(self.scratch.save(reduce(DataFrame.union, scans, own).distinct(), "shared"))
        self.levels.append((1, array))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, one), (_, two) = self.levels.pop(), self.levels.pop()
            self.levels.append((2 * size, self.scratch.save(_merged([one, two]), "merged")))
            for table in (one, two):
                self.scratch.drop(table)

    def repeated(self) -> DataFrame:
        """The rows of all arrays whose key more than one run has."""
        keys = reduce(DataFrame.union, self.shared).distinct()
        return _merged([level.join(keys, "k", "left_semi") for _, level in self.levels])


def _merged(arrays: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, arrays).groupBy("k", "c").agg(F.sum("n").alias("n"), F.min("at").alias("at"))


def _contexts(batches: Iterator[pa.RecordBatch], how: LongRepeats) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data, wanted in zip(batch.column("data"), batch.column("wanted").to_pylist(), strict=True):
            view = memoryview(data.as_buffer())
            for i in range(0, len(wanted), 2000):
                part = wanted[i : i + 2000]
                column = lambda f, kind: pa.array([f(w) for w in part], kind)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [column(lambda w: w["k"], pa.int64()), column(lambda w: w["c"], pa.int64()), column(lambda w: w["q"] - w["lo"], pa.int32()), column(lambda w: view[w["lo"] : w["hi"] + how.length].tobytes(), pa.binary())],  # noqa: B023
                    ["k", "c", "ahead", "context"],
                )


def _strings(batch: pa.RecordBatch, how: LongRepeats) -> dict[str, np.ndarray]:
    """All strings of a batch's contexts: row, place (in the context), shift (place from the anchor), print."""
    data, offsets = _bytes(batch.column("context"))
    data, limits = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    starts = _starts(limits, how.length)
    row = np.searchsorted(limits, starts, "right") - 1
    place = starts - limits[row]
    return {"row": row, "place": place, "shift": place - batch.column("ahead").to_numpy()[row], "print": Sums(BYTE[data]).all_of(how.length)[starts] if len(starts) else np.zeros(0, np.uint64)}


def _repeats(batch: pa.RecordBatch, how: LongRepeats) -> pa.RecordBatch:
    """k, c, a, b: the strings [a, b] of each context that another context of the same key has at the same place.
    ``batch`` holds all contexts of its keys; copies of one don't count."""
    k, c = (batch.column(x).to_numpy() for x in "kc")
    order = np.lexsort((c, k))
    fresh = np.concatenate([[True], (np.diff(k[order]) != 0) | (np.diff(c[order]) != 0)]) if len(k) else np.zeros(0, bool)
    batch = batch.take(pa.array(np.sort(order[fresh])))
    k, c = (batch.column(x).to_numpy() for x in "kc")
    s = _strings(batch, how)
    with np.errstate(over="ignore"):
        mark = mixed(s["print"] + mixed(k[s["row"]].view(np.uint64) + mixed(s["shift"].astype(np.int64).view(np.uint64))))
    order = np.argsort(mark, kind="stable")
    same = np.ones(max(0, len(order) - 1), bool)
    for x in (mark, s["print"], k[s["row"]], s["shift"]):
        same &= x[order][1:] == x[order][:-1]
    twice = np.zeros(len(order), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    row, place = s["row"][twice], s["place"][twice]
    head = np.concatenate([[True], (np.diff(row) != 0) | (np.diff(place) != 1)]) if len(row) else np.zeros(0, bool)
    first = np.flatnonzero(head)
    last = np.concatenate([first[1:], [len(row)]]) - 1 if len(first) else first
    return pa.RecordBatch.from_arrays([pa.array(k[row[first]]), pa.array(c[row[first]]), pa.array(place[first].astype(np.int32)), pa.array(place[last].astype(np.int32))], ["k", "c", "a", "b"])


def _compared(batches: Iterator[pa.RecordBatch], how: LongRepeats) -> Iterator[pa.RecordBatch]:
    """Whole keys at a time, of rows that are sorted by key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        k = batch.column("k").to_numpy()
        cut = int(np.searchsorted(k, k[-1])) if len(k) else 0
        if cut:
            yield _repeats(pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks().to_batches()[0], how)
            held = []
        elif held and len(k) and held[-1].column("k")[-1].as_py() != k[0]:
            yield _repeats(pa.Table.from_batches(held).combine_chunks().to_batches()[0], how)
            held = []
        if len(k):
            held.append(batch.slice(cut))
    if held:
        yield _repeats(pa.Table.from_batches(held).combine_chunks().to_batches()[0], how)


def _apart(batches: Iterator[pa.RecordBatch], how: LongRepeats) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 2000):
            part = batch.slice(i, 2000)
            s = _strings(part, how)
            of = pa.array(s["row"])
            yield pa.RecordBatch.from_arrays([part.column("k").take(of), part.column("c").take(of), pa.array(s["place"].astype(np.int32)), pa.array(s["shift"].astype(np.int32)), _signed(s["print"])], ["k", "c", "place", "shift", "print"])


def _differing(entries: DataFrame, texts: DataFrame, how: LongRepeats, scratch: Scratch) -> DataFrame:
    """k, c, a, b: repeats among the contexts of keys that have several, of which one at least stands alone."""
    sizes = entries.groupBy("k").agg(F.count("*").alias("size"), F.min("n").alias("least")).where("size > 1 and least = 1").select("k", "size")
    wanted = entries.join(sizes, "k").select("at.*", "k", "c", "size").groupBy(*_DOC).agg(F.collect_list(F.struct("k", "c", "lo", "q", "hi")).alias("wanted"))
    held = texts.join(wanted.withColumnRenamed("_id", "_of").withColumnRenamed("_hash", "_with"), F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_hash") == F.col("_with")))
    contexts = scratch.save(held.select("data", "wanted").mapInArrow(partial(_contexts, how=how), "k long, c long, ahead int, context binary"), "contexts")
    sized = contexts.join(sizes, "k")
    tasks = max(1, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    few = sized.where(F.col("size") <= how.together).drop("size").repartition(tasks, "k").sortWithinPartitions("k")
    found = few.mapInArrow(partial(_compared, how=how), "k long, c long, a int, b int")
    # an anchor of many contexts: its strings are counted by key, place and fingerprint, wherever they come together
    many = sized.where(F.col("size") > how.together).drop("size").mapInArrow(partial(_apart, how=how), "k long, c long, place int, shift int, print long")
    many = scratch.save(many, "strings")
    twice = many.groupBy("k", "shift", "print").agg(F.min("c").alias("one"), F.max("c").alias("last")).where("one <> last")
    return found.unionByName(many.join(twice, ["k", "shift", "print"], "left_semi").select("k", "c", F.col("place").alias("a"), F.col("place").alias("b")))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        sizes, removed, kept = [], [], []
        for data, found in zip(batch.column("data"), batch.column("found"), strict=True):
            spans: list[list[int]] = []
            if found.is_valid:
                ends = found.values
                start, end = ends.field(0).to_numpy(), ends.field(1).to_numpy()
                order = np.argsort(start, kind="stable")
                start, reach = start[order], np.maximum.accumulate(end[order])
                head = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
                spans = list(zip(start[head].tolist(), reach[np.concatenate([head[1:], [len(start)]]) - 1].tolist(), strict=True))
            view = memoryview(data.as_buffer())
            sizes.append(len(view))
            edges = [0, *(x for s in spans for x in s), len(view)]
            kept.append(b"".join(view[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if spans else view.tobytes())
            removed.append([{"start": a, "end": b} for a, b in spans])
        yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(sizes, pa.int64()), pa.array(removed, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "removed", "kept"])


def remove_long_repeats(documents: DataFrame, how: LongRepeats = LongRepeats()) -> DataFrame:
    """doc_id, n_bytes, removed (array of start, end) and kept (binary) for every row of ``documents`` (doc_id, text;
    others are ignored).

    Texts are UTF-8 bytes; a byte goes if it lies in a string of ``length`` bytes that starts anywhere else, too, in
    this text or another; strings that overlap count, and all are judged on the texts as given. What stays needn't
    be whole characters. A null text is empty. Equal rows are copies of each other and lose what copies lose; rows
    without doc_id take part like others. An empty table gives an empty result. Strings are compared by anchors
    of two 64-bit fingerprints, and by place and a third where contexts differ.
    """
    scratch = Scratch(documents.sparkSession, "suffixes")
    texts = _named(documents)
    dealt = F.pmod(F.xxhash64(*_DOC), F.lit(how.batches)).cast("int").alias("batch")
    path, kinds = scratch.path("runs"), f"_id long, _hash long, {_RUN}"
    texts.mapInArrow(partial(_runs, how=how), kinds).select("*", dealt).write.option("compression", "zstd").partitionBy("batch").parquet(path)
    runs = documents.sparkSession.read.schema(f"{kinds}, batch int").parquet(path)
    family = SuffixFamily(scratch)
    for k in range(how.batches):
        family.add(runs.where(F.col("batch") == k).drop("batch"))
    entries = scratch.save(family.repeated(), "repeated")
    whole = entries.where("n > 1").select("k", "c", F.lit(0).alias("a"), F.lit(None).cast("int").alias("b"))
    spans = scratch.save(whole.unionByName(_differing(entries, texts, how, scratch)), "spans")
    end = F.when(F.col("b").isNull(), F.col("hi")).otherwise(F.col("lo") + F.col("b")) + how.length
    found = runs.join(spans, ["k", "c"]).select(*_DOC, F.struct((F.col("lo") + F.col("a")).alias("start"), end.alias("end")).alias("span"))
    found = scratch.save(found.groupBy(*_DOC).agg(F.collect_list("span").alias("found")).select(F.col("_id").alias("_of"), F.col("_hash").alias("_with"), "found"), "found")
    held = texts.join(found, F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_hash") == F.col("_with")), "left").select("_id", "data", "found")
    return held.mapInArrow(_cut, "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")


def op11_suffix_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all documents lose to strings of 400 bytes that repeat."""
    found = remove_long_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    total = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", total.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: All strings one by one, by their hash; islands of starts make the removed stretches.
ORACLE = """
with b as (
    select doc_id, hex(encode(coalesce(text, ''))) as x, octet_length(encode(coalesce(text, ''))) as n from documents
), w as (
    select doc_id, i, hash(substr(x, 2 * i + 1, 800)) as h from (select doc_id, x, unnest(range(0, n - 399)) as i from b where n >= 400)
), r as (
    select doc_id, i from (select doc_id, i, count(*) over (partition by h) as c from w) where c > 1
), s as (
    select doc_id, i, sum(fresh) over (partition by doc_id order by i) as island
    from (select doc_id, i, case when i > lag(i) over (partition by doc_id order by i) + 400 then 1 else 0 end as fresh from r)
), e as (
    select doc_id, min(i) as a, max(i) + 400 as z from s group by doc_id, island
), p as (
    select doc_id, a, z, coalesce(lag(z) over (partition by doc_id order by a), 0) as before from e
), k as (
    select doc_id, sum(z - a) as removed, count(*) as spans, max(z) as last, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' order by a) as head
    from p join b using (doc_id) group by doc_id
)
select doc_id, n as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed, coalesce(spans, 0) as n_spans,
    sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) as kept_sha256
from b left join k using (doc_id)
"""
