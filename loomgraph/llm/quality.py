"""Document quality by a small byte-level convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.samples import held_out, labelled_sample, placed
from loomgraph.llm.worker import parts, release

DOCUMENTS_A_LABEL = 1000  # the sample's bound; samples.SAMPLE_BYTES bounds it, too
THRESHOLD = 0.3
FILTERS, WIDTH, STRIDE = 32, 6, 2
HOP = 128  # bytes; a chunk is two hops, so chunks overlap by half
_WINDOWS = HOP // STRIDE
_BATCH, _RATE, _STEPS, _EPOCHS = 40, 0.01, 400, (8, 40)  # about so many steps; least and most passes
_BATCH_BYTES = 1 << 18
_SLAB = 512  # hops that are filtered at a time


def _layout(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The documents in one buffer, each padded by zeros to whole hops; hops of each."""
    hops = np.array([max(1, -(-(len(d) + WIDTH) // HOP)) for d in data])
    joined = b"".join(d + bytes(n * HOP - len(d)) for d, n in zip(data, hops.tolist(), strict=True))
    return np.frombuffer(joined + bytes(WIDTH), np.uint8), hops


@dataclass
class ByteCnn:
    """``tables`` (WIDTH, 256, FILTERS): what each filter adds for each byte at each place of its window.

    Every window of the whole document is filtered; a chunk keeps each filter's largest value; a document
    the mean, the smallest and the largest over its chunks; ``head`` combines these into one logit.
    """

    tables: np.ndarray
    bias: np.ndarray
    head: np.ndarray
    shift: float

    def windows(self, buffer: np.ndarray, first: int) -> np.ndarray:
        """What the filters say to the windows of up to ``_SLAB`` hops from a first one on: (hops, windows, filters)."""
        buffer = buffer[first * HOP : (first + _SLAB) * HOP + WIDTH]
        n = (len(buffer) - WIDTH) // STRIDE
        z = np.take(self.tables[0], buffer[0 : n * STRIDE : STRIDE], axis=0)
        for j in range(1, WIDTH):
            z += np.take(self.tables[j], buffer[j : j + n * STRIDE : STRIDE], axis=0)
        return z.reshape(-1, _WINDOWS, FILTERS)

    def pooled(self, data: list[bytes]):
        """Document features, and what the gradient needs. Windows exist for a slab of hops at a time."""
        buffer, hops = _layout(data)
        tops = np.concatenate([self.windows(buffer, a).max(1) for a in range(0, int(hops.sum()), _SLAB)])
        ends = np.cumsum(hops)
        starts = ends - hops
        first, follows = np.arange(len(tops)), np.arange(len(tops)) + 1
        follows[ends - 1] -= 1
        first[(ends - 1)[hops > 1]] -= 1  # the last hop of a longer document repeats the chunk before it
        chunk = np.maximum(np.maximum(tops[first], tops[follows]) + self.bias, 0)
        mean = np.add.reduceat(chunk, starts, axis=0) / hops[:, None]
        low, high = np.minimum.reduceat(chunk, starts, axis=0), np.maximum.reduceat(chunk, starts, axis=0)
        size = np.log1p(np.array([len(d) for d in data], np.float32)) / 10
        short = np.minimum(1, np.array([len(d) for d in data], np.float32) / HOP)
        return np.concatenate([mean, low, high, size[:, None], short[:, None]], 1), (buffer, tops, first, follows, chunk, starts, hops, low, high)

    def logits(self, features: np.ndarray) -> np.ndarray:
        return features @ self.head + self.shift

    def score(self, data: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(self.pooled(data)[0]), -30, 30)))

    def gradient(self, data: list[bytes], y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Of the weighted loss, summed over whole documents taken a few at a time, by their bytes."""
        cuts, held = [0], 0
        for i, d in enumerate(data):
            if held and held + len(d) > _BATCH_BYTES:
                cuts, held = [*cuts, i], 0
            held += len(d)
        sums = [self._gradient(data[a:b], y[a:b], weight[a:b]) for a, b in zip(cuts, [*cuts[1:], len(data)], strict=True)]
        return [sum(x) / weight.sum() for x in zip(*sums, strict=True)]

    def _gradient(self, data: list[bytes], y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        x, (buffer, tops, first, follows, chunk, starts, hops, low, high) = self.pooled(data)
        g = (1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30))) - y) * weight
        back = g[:, None] * self.head[: 3 * FILTERS]
        of = np.repeat(np.arange(len(data)), hops)
        down = back[of, :FILTERS] / hops[of, None]
        for part, end in ((slice(FILTERS, 2 * FILTERS), low), (slice(2 * FILTERS, None), high)):
            at_end = (chunk == end[of]).astype(np.float64)  # chunks that tie share the gradient
            down += back[of, part] * at_end / np.add.reduceat(at_end, starts, axis=0)[of]
        down *= chunk > 0
        hop = np.where(tops[first] >= tops[follows], first[:, None], follows[:, None])
        at, f = np.nonzero(down)
        where, amount, tables = hop[at, f], down[at, f], np.zeros((WIDTH, 256 * FILTERS))
        order = np.argsort(where, kind="stable")
        for a in range(0, len(tops), _SLAB):
            rows = order[np.searchsorted(where, a, sorter=order) : np.searchsorted(where, a + _SLAB, sorter=order)]
            window = self.windows(buffer, a).argmax(1)[where[rows] - a, f[rows]]
            place = (where[rows] * _WINDOWS + window) * STRIDE
            for j in range(WIDTH):
                tables[j] += np.bincount(buffer[place + j].astype(np.int64) * FILTERS + f[rows], amount[rows], 256 * FILTERS)
        tables = tables.reshape(WIDTH, 256, FILTERS)
        return [tables, down.sum(0), x.T @ g, np.array(g.sum())]

    @classmethod
    def fit(cls, data: list[bytes], y: np.ndarray) -> ByteCnn:
        """Adam over balanced classes; the same data give the same network."""
        rng = np.random.default_rng(17)
        net = cls(rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), np.zeros(3 * FILTERS + 2, np.float32), 0.0)
        y = y.astype(np.float64)
        if not len(y) or y.min() == y.max():
            net.shift = 0.0 if not len(y) else (4.0 if y.min() else -4.0)
            return net
        weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        state = [[np.zeros_like(p, np.float64)] * 2 for p in (net.tables, net.bias, net.head, np.zeros(()))]
        step, lengths = 0, np.array([len(d) for d in data])
        epochs = min(_EPOCHS[1], max(_EPOCHS[0], _STEPS * _BATCH // len(data)))
        for epoch in range(epochs):
            rate = _RATE * (1 - epoch / epochs)
            order = rng.permutation(len(data))
            order = order[np.argsort(lengths[order] // 4000, kind="stable")]
            batches = [order[k : k + _BATCH] for k in range(0, len(order), _BATCH)]
            for rows in (batches[k] for k in rng.permutation(len(batches))):
                step += 1
                grads = net.gradient([data[i] for i in rows], y[rows], weight[rows])
                values = [net.tables, net.bias, net.head, np.array(net.shift)]
                for k, g in enumerate(grads):
                    m, v = state[k] = [0.9 * state[k][0] + 0.1 * g, 0.99 * state[k][1] + 0.01 * g * g]
                    values[k] = values[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
                net = cls(values[0].astype(np.float32), values[1].astype(np.float32), values[2].astype(np.float32), float(values[3]))
        return net


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def fit_quality(documents: DataFrame, labels: DataFrame, bound: int = DOCUMENTS_A_LABEL) -> ByteCnn:
    """Fit on at most ``bound`` documents of each quality label, and 16 MB of text of each (``labelled_sample``);
    a document labelled twice differently counts as each."""
    marked = labels.where("quality is not null and doc_id is not null").select("doc_id", "quality").distinct()
    rows = labelled_sample(placed(documents.where("text is not null").select("doc_id", "text")).join(marked, "doc_id"), "quality", bound)
    return ByteCnn.fit([_bytes(r["text"]) for r in rows], np.array([r["quality"] for r in rows]))


def score_quality(documents: DataFrame, net: ByteCnn, column: str = "score") -> DataFrame:
    """Add the score as ``column`` to the rows, reading nothing but ``text``, all of it; a null text scores as
    an empty one. Other columns pass through; one that has the name ``column`` is replaced."""
    documents = documents.drop(column)
    fields = documents.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for part in parts(batch.column("text"), _BATCH_BYTES):
                rows = batch.slice(part.start, part.stop - part.start)
                scores = net.score([d or b"" for d in rows.column("text").cast(pa.binary()).to_pylist()])
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(scores, pa.float64())], [*fields.names, column])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return documents.mapInArrow(run, f"{schema}, `{column}` double")


def op7_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", held_out(5, 0).alias("held_out"))
    net = fit_quality(documents.where(~F.col("held_out")), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(documents, net).select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
