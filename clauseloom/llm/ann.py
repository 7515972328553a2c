"""Operator 7: nearest neighbours by randomly rotated one-bit codes.

Vectors are centred, normed, and turned by random orthonormal rows into more dimensions (`oversample`
times as many), of which only the signs are kept as packed bits, with two correction scalars: the
vector's norm, and its inner product with its own code. From a query's rotated vector and the bits
an unbiased estimate of the inner product follows, and an error bound that holds for all but a tiny
share of vectors (`confidence` deviations). Vectors whose lower bound of the distance does not
exceed the k-th smallest upper bound are reranked with original vectors in double precision.

Each row is in one block, by a hash of its number, so hot vectors or labels spread evenly. Queries are
a stated set; they too come in blocks, and each pair of blocks is one group, of bounded size whatever
the data, that reranks inside and returns the best k of its rows for each query. These partial lists merge by
window. No index is fitted on a sample: the rotation is drawn from a seed, the centre is the block's.

Every row but the query's own is a candidate, also those that repeat an id or a vector; a query row that repeats
an id gets its own result. Vectors that are null, zero, or hold null or non-finite components, and null ids,
take no part. Vectors of different lengths do not meet. Ties go to the smaller id, then to the row stored first.
An empty table gives an empty result, and columns other than the id and the vector are not read.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.llm.common import stored


@functools.lru_cache(8)
def rotation(dim: int, code_dim: int, seed: int = 7) -> np.ndarray:
    """code_dim x dim, with orthonormal columns."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((code_dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float64)


class Codes:
    """One-bit codes of a block of vectors."""

    def __init__(self, vectors: np.ndarray, oversample: int) -> None:
        n, dim = vectors.shape
        self.code_dim = 8 * math.ceil(dim * oversample / 8)
        self.turn = rotation(dim, self.code_dim)
        self.centre = vectors.mean(axis=0)
        apart = vectors - self.centre
        self.norm = np.linalg.norm(apart, axis=1)
        turned = (apart / np.maximum(self.norm, 1e-30)[:, None]) @ self.turn.T
        self.bits = np.packbits(turned > 0, axis=1)
        #: The inner product of each normed vector with its own code (signs over the root of code_dim).
        self.own = np.where(self.norm > 0, np.abs(turned).sum(axis=1) / math.sqrt(self.code_dim), 1.0)

    def bounds(self, queries: np.ndarray, confidence: float) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distances, queries x vectors."""
        apart = queries - self.centre
        size = np.linalg.norm(apart, axis=1)
        turned = ((apart / np.maximum(size, 1e-30)[:, None]) @ self.turn.T).astype(np.float32)
        signs = np.unpackbits(self.bits, axis=1)[:, : self.code_dim].astype(np.float32)
        # <query, code> = 2 <query, bits> - sum of the query, over the root of the number of dimensions
        product = (2 * (turned @ signs.T) - turned.sum(axis=1, keepdims=True)) / np.float32(math.sqrt(self.code_dim))
        estimate = product / self.own.astype(np.float32)
        error = confidence * np.sqrt((1 - np.minimum(self.own, 1) ** 2) / self.own**2 / (self.code_dim - 1)) + 1e-5
        base = (size**2)[:, None] + (self.norm**2)[None, :]
        scale = 2 * size[:, None] * self.norm[None, :]
        return base - scale * (estimate + error), base - scale * (estimate - error)


def search_block(rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, query_rows: np.ndarray, queries: np.ndarray, k: int, oversample: int, confidence: float):
    """For each query its k nearest of the block: (query row, row, id, distance), and how many were reranked."""
    codes = Codes(vectors, oversample)
    out, reranked, step = [], 0, max(1, (1 << 21) // len(ids))
    for start in range(0, len(query_rows), step):
        low, high = codes.bounds(queries[start : start + step], confidence)
        for q, query, lo, hi in zip(query_rows[start : start + step].tolist(), queries[start : start + step], low, high, strict=True):
            most = np.partition(hi, k)[k] if len(hi) > k + 1 else np.inf  # k + 1, as the query itself may be among them
            at = np.flatnonzero(lo <= most)
            at = at[rows[at] != q]
            reranked += len(at)
            exact = np.sqrt(((vectors[at] - query) ** 2).sum(axis=1))
            best = np.lexsort((rows[at], ids[at], exact))[:k]
            out.append((np.full(len(best), q), rows[at][best], ids[at][best], exact[best]))
    return [np.concatenate(x) for x in zip(*out, strict=True)], reranked


def nearest(df: DataFrame, is_query: Column, k: int = 10, oversample: int = 4, confidence: float = 3.5, block_rows: int = 8192, query_rows: int = 4096, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score (Euclidean distance) of each query's k nearest other rows."""
    v = F.col(vector_column)
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    kept = df.filter(F.col(id_column).isNotNull() & fine).select(F.col(id_column).cast("bigint").alias("id"), v.alias("v"), F.size(v).alias("dim"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    # Numbers of rows as they are stored, so that rows which repeat an id stay apart.
    rows = stored(kept.withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, n_queries = rows.agg(F.count("*"), F.count_if("asks")).first()
    blocks, query_blocks = max(1, math.ceil(n / block_rows)), max(1, math.ceil(n_queries / query_rows))
    block = F.pmod(F.xxhash64(F.col("row"), F.lit(1)), F.lit(blocks)).cast("int")
    query_block = F.pmod(F.xxhash64(F.col("row"), F.lit(2)), F.lit(query_blocks)).cast("int")
    candidates = rows.select("row", "id", "v", "dim", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("query_block"))
    queries = rows.filter("asks").select("row", "id", "v", "dim", query_block.alias("query_block"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def vectors(t: pa.Table) -> np.ndarray:
        return np.asarray(t.column("v").combine_chunks().flatten(), dtype=np.float64).reshape(t.num_rows, -1)

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if a.num_rows and b.num_rows:
            numbers = (t.column(c).to_numpy() for t, c in ((a, "row"), (a, "id"), (b, "row")))
            own, ids, asked = numbers
            found, _ = search_block(own, ids, vectors(a), asked, vectors(b), k, oversample, confidence)
        return pa.table(dict(zip(("query", "row", "vec_id", "score"), found, strict=True)))

    keys = ("dim", "block", "query_block")
    found = candidates.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(search, "query bigint, row bigint, vec_id bigint, score double")
    order = Window.partitionBy("query").orderBy("score", "vec_id", "row")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    asked = rows.filter("asks").select(F.col("row").alias("query"), F.col("id").alias("query_id"))
    return best.join(asked, "query").select("query_id", "rank", "vec_id", "score")
