"""Maximum inner product search: score-aware quantisation, four-bit table scans, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.scratch import Scratch

TRAINING_ROWS = 8_000  # the sample's bound
NEIGHBOURS = 20
_CODES = 16  # of a subspace: four bits
_SUBSPACE = 2  # dimensions
_RERANKED = 200  # candidates of a block that are scored exactly, for each query
_CANDIDATES_A_BLOCK, _QUERIES_A_BLOCK = 8192, 2048
_SLAB = 256  # queries scanned at a time


@dataclass
class AnisotropicQuantizer:
    """Product quantisation whose loss weighs the residual along the vector ``eta`` times the rest.

    An error along a vector changes its inner products with the queries that matter most to it, those
    pointing its way, so it costs more than one across it. ``books``: (subspaces, 16, dimensions of one).
    """

    books: np.ndarray
    eta: float

    @property
    def padded(self) -> int:
        return self.books.shape[0] * self.books.shape[2]

    def _split(self, x: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(x), self.padded))
        wide[:, : x.shape[1]] = x
        return wide.reshape(len(x), *self.books.shape[::2])

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes by coordinate descent on |r|^2 + (eta - 1) (r.u)^2, r the residual and u the direction."""
        parts, norms = self._split(x), np.linalg.norm(x, axis=1)
        unit = parts / np.maximum(norms, 1e-300)[:, None, None]
        code = np.stack([((parts[:, m, None] - book) ** 2).sum(2).argmin(1) for m, book in enumerate(self.books)], 1)
        along = np.stack([((parts[:, m] - self.books[m][code[:, m]]) * unit[:, m]).sum(1) for m in range(len(self.books))], 1)
        total = along.sum(1)
        for _ in range(sweeps):
            for m, book in enumerate(self.books):
                residual = parts[:, m, None] - book
                here = np.einsum("nkd,nd->nk", residual, unit[:, m])
                cost = (residual**2).sum(2) + (self.eta - 1) * (here + (total - along[:, m])[:, None]) ** 2
                code[:, m] = cost.argmin(1)
                fresh = here[np.arange(len(x)), code[:, m]]
                total += fresh - along[:, m]
                along[:, m] = fresh
        return code.astype(np.uint8)

    @classmethod
    def fit(cls, x: np.ndarray, threshold: float = 0.2, rounds: int = 6) -> AnisotropicQuantizer:
        """Alternate codes and the books that are best for them. ``threshold``: share of a vector's norm that
        an inner product must reach to matter, which sets eta."""
        dims = x.shape[1]
        subspaces = max(1, -(-dims // _SUBSPACE))
        eta = max(1.0, (dims - 1) * threshold**2 / (1 - threshold**2))
        rng = np.random.default_rng(23)
        net = cls(np.zeros((subspaces, _CODES, _SUBSPACE)), eta)
        parts = net._split(x)
        for m in range(subspaces):
            net.books[m] = parts[rng.choice(len(x), _CODES, replace=len(x) < _CODES), m]
        unit = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None, None]
        for _ in range(rounds):
            code = net.encode(x, 1)
            total = sum(((parts[:, m] - net.books[m][code[:, m]]) * unit[:, m]).sum(1) for m in range(subspaces))
            for m in range(subspaces):
                own = ((parts[:, m] - net.books[m][code[:, m]]) * unit[:, m]).sum(1)
                rest = total - own
                for k in range(_CODES):
                    rows = np.flatnonzero(code[:, m] == k)
                    if not len(rows):
                        continue
                    # normal equations of the loss in this codeword
                    u, p = unit[rows, m], parts[rows, m]
                    weight = len(rows) * np.eye(_SUBSPACE) + (eta - 1) * u.T @ u
                    aim = p.sum(0) + (eta - 1) * ((u * p).sum(1) + rest[rows]) @ u
                    net.books[m, k] = np.linalg.solve(weight, aim)
                fresh = ((parts[:, m] - net.books[m][code[:, m]]) * unit[:, m]).sum(1)
                total = rest + fresh
        return net

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(queries, subspaces, 16): each codeword's part of the inner product."""
        return np.einsum("qmd,mkd->qmk", self._split(queries), self.books).astype(np.float32)

    def scan(self, tables: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """Approximate inner products of queries and the candidates of :meth:`paired` codes, by table look-ups.

        Two four-bit codes are looked up at once, in a table of the 256 sums of their entries."""
        joint = (tables[:, 0::2, :, None] + tables[:, 1::2, None, :]).reshape(len(tables), -1, 256)
        out = np.take(joint[:, 0], pairs[0], axis=1)
        for m in range(1, len(pairs)):
            out += np.take(joint[:, m], pairs[m], axis=1)
        return out


def paired(code: np.ndarray) -> np.ndarray:
    """Four-bit codes packed two to a byte: (pairs of subspaces, rows)."""
    return np.ascontiguousarray((code[:, 0::2] << 4 | code[:, 1::2]).T)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vectors]) if len(vectors) else np.zeros((0, 0))


def usable(rows: DataFrame) -> DataFrame:
    """Rows (vec_id, vec array<double>) whose vector is not null, empty or zero and has finite components only."""
    vec = F.col("vec")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(vec.isNotNull() & (F.size(vec) > 0) & F.coalesce(finite, F.lit(False))).where(F.exists(vec, lambda x: x != 0))


def search(rows: DataFrame, is_query, k: int = NEIGHBOURS, bound: int = TRAINING_ROWS) -> DataFrame:
    """The ``k`` nearest rows of every query row by inner product: query_id, rank, vec_id, score.

    ``rows``: vec_id, vec (arrays of one length; a row of another length takes no part, the commonest length
    counts); ``is_query``: a condition on them. The quantiser is fitted on at most ``bound`` rows; all rows
    are coded, once each, and scanned. Queries meet the candidates in blocks of fixed size, each block pair in one task:
    it scans codes, scores its 200 best exactly in double precision and keeps k. A query's own row is no
    candidate; other rows of its vec_id are, and rows that share a vec_id are each a query. Nearest first, ties to the smaller vec_id. Rows without
    vec_id, and vectors that are null, zero or not finite, take no part. An empty table gives an empty result.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "vectors")
    vectors = usable(rows.where("vec_id is not null").select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("vec").cast("array<double>").alias("vec")))
    dims = vectors.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    vectors = vectors.where(F.size("vec") == dims["d"])
    share = min(1 << 30, int((1 << 30) * 1.1 * bound / dims["n"]) + 1)
    taken = sorted(tuple(r) for r in vectors.where(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 30)) < share).collect())[:bound]
    net = AnisotropicQuantizer.fit(np.array([v for _, v in taken], np.float64)) if taken else AnisotropicQuantizer(np.zeros((-(-dims["d"] // _SUBSPACE), _CODES, _SUBSPACE)), 1.0)
    if len(net.books) % 2:
        net = AnisotropicQuantizer(np.concatenate([net.books, np.zeros((1, _CODES, _SUBSPACE))]), net.eta)

    def meet(key: tuple, candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(candidates) or not len(queries):
            return pd.DataFrame({"query_row": [], "query_id": [], "vec_id": [], "score": []}).astype({"query_row": "int64", "query_id": "int64", "vec_id": "int64", "score": "float64"})
        candidates = candidates.sort_values(["vec_id", "row"])
        ids, own, x = candidates["vec_id"].to_numpy(), candidates["row"].to_numpy(), _matrix(candidates["vec"])
        query_ids, asking, q = queries["query_id"].to_numpy(), queries["query_row"].to_numpy(), _matrix(queries["query_vec"])
        codes = np.frombuffer(b"".join(candidates["code"]), np.uint8).reshape(len(ids), -1).T
        codes, keep, out = np.ascontiguousarray(codes), min(len(ids), max(_RERANKED, 2 * k)), []
        for a in range(0, len(q), _SLAB):
            near = net.scan(net.tables(q[a : a + _SLAB]), codes)
            for i, row in enumerate(near, a):
                cut = np.partition(row, len(row) - keep)[len(row) - keep]
                above, ties = np.flatnonzero(row > cut), np.flatnonzero(row == cut)
                best = np.sort(np.concatenate([above, ties[: keep - len(above)]]))  # of equal codes the smaller vec_ids
                best = best[own[best] != asking[i]]
                exact = np.array([float(np.dot(x[j], q[i])) for j in best])
                first = np.lexsort([ids[best], -exact])[:k]
                out.append((i, ids[best][first], exact[first]))
        at = np.repeat([o[0] for o in out], [len(o[1]) for o in out])
        return pd.DataFrame({"query_row": asking[at], "query_id": query_ids[at], "vec_id": np.concatenate([o[1] for o in out]), "score": np.concatenate([o[2] for o in out])})

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(code=[c.tobytes() for c in paired(net.encode(_matrix(batch["vec"]))).T] if len(batch) else [])

    # numbered once written, so that the numbers stay
    vectors = scratch.save(vectors.withColumn("is_query", is_query), "vectors").withColumn("row", F.monotonically_increasing_id())
    vectors = scratch.save(vectors.mapInPandas(coded, "vec_id long, vec array<double>, is_query boolean, row long, code binary"), "coded")
    n_queries = vectors.where("is_query").count()
    block = lambda n, size, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(max(1, -(-n // size)))).cast("int")
    across, down = max(1, -(-n_queries // _QUERIES_A_BLOCK)), max(1, -(-dims["n"] // _CANDIDATES_A_BLOCK))
    candidates = vectors.select("vec_id", "row", "vec", "code", block(dims["n"], _CANDIDATES_A_BLOCK, 1).alias("c"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("q"))
    # under names of their own: Spark mixes up the columns of two sides that come from one table
    asked = [F.col(a).alias(b) for a, b in (("vec_id", "query_id"), ("row", "query_row"), ("vec", "query_vec"))]
    queries = vectors.where("is_query").select("row", *asked, F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("c"), block(n_queries, _QUERIES_A_BLOCK, 2).alias("q")).drop("row")
    found = candidates.groupBy("c", "q").cogroup(queries.groupBy("c", "q")).applyInPandas(meet, "query_row long, query_id long, vec_id long, score double")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_anisotropic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vec"))
    return search(rows, F.col("vec_id") % 20 == 0)
