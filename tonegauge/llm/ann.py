"""Nearest neighbours by inner product: anisotropic product quantisation, table scans, exact reranking.

Quantisation is score-aware: of a vector's residual, the part parallel to the
vector costs ``eta`` times what the orthogonal part costs, for it is the one that
moves large inner products. Codes are four bits for every two components; their
assignment goes component pair by component pair under this loss (coordinate
descent), and so do the centres (weighted least squares). The codebook is fitted
on at most ``FIT_ROWS`` rows picked by a hash of their id; every row is indexed.

Search: rows are dealt into blocks of about ``BLOCK`` rows; the stated queries go
to every block. A block is encoded once, each query builds its table of partial
products (16 per component pair, joined to 256 per byte), the scan adds one entry
per byte, and the best ``KEEP`` rows of the block are scored again with the
original vectors in double precision. The best of all blocks are merged per query.
A block holds a bounded number of rows whatever the data, and no group of equal
vectors is brought together.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components take no part; vectors of different dimensions have no inner product, so
each dimension is searched on its own; ties go to the smaller vec_id; rows with a
null vec_id take no part; of rows that repeat a vec_id one counts (the same one
whatever the partitions); an empty table gives an empty table; further columns are
ignored. With fewer candidates than asked for, all are returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import record_batch

#: Rows the codebook is fitted on at most; rows of a block; rows of a block that are scored exactly; queries scanned at a time.
FIT_ROWS, BLOCK, KEEP, AT_ONCE = 8192, 8192, 160, 64
#: The share of the norm above which inner products matter; gives the weight of parallel error.
THRESHOLD = 0.2


def usable(vec: Column) -> Column:
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vec) > 0) & fine & F.exists(vec, lambda x: x != 0), F.lit(False))


class AnisotropicCodebook:
    """16 centres for every two components (a last odd component is padded with zero)."""

    def __init__(self, centres: np.ndarray, eta: float):
        self.centres, self.eta = centres, eta

    @staticmethod
    def pairs(x: np.ndarray) -> np.ndarray:
        x = np.pad(x, ((0, 0), (0, -x.shape[1] % 4)))
        return x.reshape(len(x), -1, 2)

    @classmethod
    def fit(cls, x: np.ndarray, rounds: int = 6, seed: int = 7) -> AnisotropicCodebook:
        d = x.shape[1]
        eta = max(1.0, (d - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
        p = cls.pairs(x.astype(np.float64))
        rng = np.random.default_rng(seed)
        centres = p[rng.choice(len(p), 16, replace=len(p) < 16)].transpose(1, 0, 2).copy()
        book = cls(centres, eta)
        unit = p / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None, None]
        for _ in range(rounds):
            codes = book.encode(x)
            rest = p - centres[np.arange(p.shape[1]), codes]
            along = np.einsum("nmk,nmk->n", rest, unit)
            for m in range(p.shape[1]):
                others = along - np.einsum("nk,nk->n", rest[:, m], unit[:, m])
                for c in range(16):
                    mine = codes[:, m] == c
                    if not mine.any():
                        continue
                    u, v = unit[mine, m], p[mine, m]
                    left = mine.sum() * np.eye(2) + (eta - 1) * u.T @ u
                    right = v.sum(0) + (eta - 1) * u.T @ (others[mine] + (u * v).sum(1))
                    centres[m, c] = np.linalg.solve(left, right)
                rest[:, m] = p[:, m] - centres[m, codes[:, m]]
                along = others + np.einsum("nk,nk->n", rest[:, m], unit[:, m])
        return book

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes (rows, pairs), each pair in turn the least loss given the others."""
        p = self.pairs(x.astype(np.float64))
        unit = p / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None, None]
        n, pairs, _ = p.shape
        codes = np.empty((n, pairs), np.int64)
        for m in range(pairs):
            codes[:, m] = ((p[:, m, None, :] - self.centres[m][None]) ** 2).sum(2).argmin(1)
        rest = p - self.centres[np.arange(pairs), codes]
        along = np.einsum("nmk,nmk->n", rest, unit)
        for _ in range(sweeps):
            for m in range(pairs):
                others = along - np.einsum("nk,nk->n", rest[:, m], unit[:, m])
                r = p[:, m, None, :] - self.centres[m][None]
                side = others[:, None] + np.einsum("nck,nk->nc", r, unit[:, m])
                codes[:, m] = ((r**2).sum(2) + (self.eta - 1) * side**2).argmin(1)
                rest[:, m] = p[:, m] - self.centres[m, codes[:, m]]
                along = others + np.einsum("nk,nk->n", rest[:, m], unit[:, m])
        return codes

    def pack(self, codes: np.ndarray) -> np.ndarray:
        """Two codes a byte, byte-major: (pairs / 2, rows)."""
        return np.ascontiguousarray((codes[:, ::2] * 16 + codes[:, 1::2]).astype(np.uint8).T)

    def scan(self, queries: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """Approximate inner products (queries, rows): a table look-up for each byte."""
        q = self.pairs(queries.astype(np.float64))
        tables = np.einsum("qmk,mck->qmc", q, self.centres).astype(np.float32)
        total = np.zeros((len(queries), packed.shape[1]), np.float32)
        for byte, rows in enumerate(packed):
            joined = (tables[:, 2 * byte, :, None] + tables[:, 2 * byte + 1, None, :]).reshape(len(queries), 256)
            total += np.take(joined, rows, axis=1)
        return total


def best(scores: np.ndarray, most: int) -> np.ndarray:
    """Indices of the largest scores; of equal ones, the first."""
    if len(scores) <= most:
        return np.arange(len(scores))
    bar = np.partition(scores, len(scores) - most)[len(scores) - most]
    above = np.flatnonzero(scores > bar)
    return np.concatenate([above, np.flatnonzero(scores == bar)[: most - len(above)]])


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _search_blocks(book: AnisotropicCodebook, dim: int, top: int, keep: int):
    """Rows by block: first the block's vectors, then the queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, vecs, packed, asked = None, [], [], None, None
        for batch in batches:
            blocks, kinds, keys = (batch.column(i).to_numpy() for i in range(3))
            data = batch.column(3).flatten().to_numpy().astype(np.float64).reshape(-1, dim)
            cuts = np.flatnonzero((blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(blocks)], strict=True):
                if a == b:
                    continue
                if blocks[a] != block:
                    block, ids, vecs, packed, asked = blocks[a], [], [], None, None
                if kinds[a] == 0:
                    ids.append(keys[a:b])
                    vecs.append(data[a:b])
                    continue
                if not ids:
                    continue
                if packed is None:
                    own, first = np.unique(np.concatenate(ids), return_index=True)
                    x = np.concatenate(vecs)[first]
                    packed = book.pack(book.encode(x))
                out_q, out_v, out_s = [], [], []
                new = a + np.flatnonzero(np.concatenate([[keys[a] != asked], keys[a + 1 : b] != keys[a : b - 1]]))
                asked = keys[b - 1]
                for at in range(0, len(new), AT_ONCE):
                    qs = new[at : at + AT_ONCE]
                    rough = book.scan(data[qs], packed)
                    for q, vec, scores in zip(keys[qs].tolist(), data[qs], rough, strict=True):
                        scores[own == q] = -np.inf
                        near = best(scores, keep)
                        near = near[own[near] != q]
                        exact = (x[near] * vec).sum(axis=1)
                        order = np.lexsort((own[near], -exact))[:top]
                        out_q.append(np.full(len(order), q))
                        out_v.append(own[near][order])
                        out_s.append(exact[order])
                if out_q:
                    yield record_batch(_FOUND, [np.concatenate(c) for c in (out_q, out_v, out_s)])

    return run


def nearest(vectors: DataFrame, queries: Column, top: int = 20, keep: int = KEEP, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the top largest inner products of each row that ``queries`` holds for."""
    spark = vectors.sparkSession
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    parts = [_nearest(v.where(F.size("embedding") == dim), dim, n, queries, top, keep, block) for dim, n in sorted(map(tuple, v.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).collect()))]
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, parts)


def _nearest(v: DataFrame, dim: int, n: int, queries: Column, top: int, keep: int, block: int) -> DataFrame:
    share = min(1.0, FIT_ROWS / n)
    chosen = v.where(F.pmod(F.xxhash64("vec_id", F.lit("fit")), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1))
    sample = np.array([r[0] for r in chosen.select("embedding").limit(FIT_ROWS).collect()] or [r[0] for r in v.select("embedding").limit(FIT_ROWS).collect()])
    book = AnisotropicCodebook.fit(sample)
    blocks = -(-n // block)
    rows = v.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"), F.lit(0).alias("kind"), "vec_id", "embedding")
    asked = v.where(queries).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(1).alias("kind"), "vec_id", "embedding")
    met = rows.unionByName(asked).repartition("block").sortWithinPartitions("block", "kind", "vec_id", F.xxhash64("embedding"))
    found = met.mapInArrow(_search_blocks(book, dim, top, keep), "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
