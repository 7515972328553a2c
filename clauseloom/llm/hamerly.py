"""Operator 12: clustering around centroids in exact integers, with Hamerly's bounds.

Each vector carries its centroid's number, an upper bound of its distance to that centroid and a lower bound of
its distance to every other one. When centroids move, the bounds are loosened by how far they moved. A vector whose
upper bound stays below the lower one, or below half the way to the nearest other centroid, keeps its centroid
without a look at any; else its own distance is made exact, and only if that does not settle it are all centroids
scanned, in integers. Bounds are floating-point numbers rounded outwards and decide only strict cases, so ties and
results are those of a full scan.

Vectors with their bounds are written to the shared folder after each round, so a lost executor costs one round's
tasks. Sums of components follow the vectors that changed their centroid: only those are aggregated, and k rows of
sums reach the driver, whatever the number of vectors. The k centroids travel with the tasks.

Vectors take part that have exactly `dim` components, none null or not finite, and each scaled one below 2**27 in
size, so that squared distances fit into a long. Null ids take part but start no centroid; rows that repeat an id are
vectors of their own. Fewer than k vectors start fewer centroids; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import discard, stored

#: Scaled components stay below this, so that 64 squared differences fit into a long.
LARGEST = 1 << 27
#: Floating-point bounds are widened by this share.
SLACK = 1e-12
#: Components up to here make products and sums that doubles hold exactly.
EXACT = 1 << 22


def squared(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, vectors x centroids, as int64."""
    small = max(np.abs(v).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT
    product = (v.astype(np.float64) @ centroids.T.astype(np.float64)).astype(np.int64) if small else v @ centroids.T
    return (v * v).sum(axis=1)[:, None] - 2 * product + (centroids * centroids).sum(axis=1)[None, :]


def squared_own(v: np.ndarray, own: np.ndarray) -> np.ndarray:
    apart = v - own
    return (apart * apart).sum(axis=1)


class Bounds:
    """What one round needs of the centroids: where they are, how far each came, and half the way to its nearest other."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray) -> None:
        self.centroids = centroids
        self.moved = np.sqrt(squared_own(centroids, before).astype(np.float64)) * (1 + SLACK)
        # The largest move of the others, for each centroid.
        order = np.argsort(self.moved)
        self.others = np.full(len(centroids), self.moved[order[-1]])
        self.others[order[-1]] = self.moved[order[-2]] if len(order) > 1 else 0.0
        apart = squared(centroids, centroids).astype(np.float64)
        np.fill_diagonal(apart, np.inf)
        self.half = np.sqrt(apart.min(axis=1)) / 2 * (1 - SLACK)

    def assign(self, v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The new cluster, upper and lower, and how many vectors were scanned against all centroids. A cluster of -1 has no bounds yet."""
        cluster, known = cluster.copy(), cluster >= 0
        at = np.maximum(cluster, 0)
        upper = np.where(known, (upper + self.moved[at]) * (1 + SLACK), np.inf)
        lower = np.where(known, np.maximum(lower - self.others[at], 0) * (1 - SLACK), 0.0)
        least = np.maximum(lower, np.where(known, self.half[at], -1.0))
        near = np.flatnonzero(known & ~(upper < least))
        upper[near] = np.sqrt(squared_own(v[near], self.centroids[cluster[near]]).astype(np.float64)) * (1 + SLACK)
        scan = np.flatnonzero(~(upper < least))
        far = squared(v[scan], self.centroids)
        cluster[scan] = best = far.argmin(axis=1)  # the first of equals: the smaller number
        rows = np.arange(len(scan))
        upper[scan] = np.sqrt(far[rows, best].astype(np.float64)) * (1 + SLACK)
        if far.shape[1] > 1:
            far[rows, best] = np.iinfo(np.int64).max
            lower[scan] = np.sqrt(far.min(axis=1).astype(np.float64)) * (1 - SLACK)
        else:
            lower[scan] = np.inf
        return cluster, upper, lower, len(scan)


def assigned(state: DataFrame, bounds: Bounds, dim: int, final: bool) -> DataFrame:
    """state with new clusters and bounds, and the cluster before in `was`; at last id, cluster and exact squared distance only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = dict(zip(batch.schema.names, batch.columns, strict=True))
            v = cols["v"].flatten().to_numpy().astype(np.int64).reshape(-1, dim)
            was = cols["cluster"].to_numpy()
            cluster, upper, lower, _ = bounds.assign(v, was, cols["upper"].to_numpy(), cols["lower"].to_numpy())
            new = pa.array(cluster.astype(np.int32))
            if final:
                yield pa.RecordBatch.from_pydict({"id": cols["id"], "cluster": new, "distance": squared_own(v, bounds.centroids[cluster])})
            else:
                yield pa.RecordBatch.from_pydict({"id": cols["id"], "v": cols["v"], "cluster": new, "upper": upper, "lower": lower, "was": was})

    return state.select("id", "v", "cluster", "upper", "lower").mapInArrow(run, "id bigint, cluster int, distance bigint" if final else "id bigint, v array<int>, cluster int, upper double, lower double, was int")


def change_of_sums(state: DataFrame, k: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """What the vectors that changed their cluster add to, and take from, each cluster's count and sums (Python integers)."""
    to = F.array(F.struct(F.col("cluster").alias("c"), F.lit(1).alias("sign")), F.struct(F.col("was").alias("c"), F.lit(-1).alias("sign")))
    moved = state.filter("cluster <> was").select("v", F.explode(to).alias("to")).filter("to.c >= 0")
    sign = F.col("to.sign").cast("bigint")
    rows = moved.groupBy("to.c").agg(F.sum(sign).alias("n"), *(F.sum(sign * F.col("v")[i]).alias(f"s{i}") for i in range(dim))).collect()
    counts, sums = np.zeros(k, dtype=object), np.zeros((k, dim), dtype=object)
    for r in rows:  # k at most
        counts[r.c], sums[r.c] = r.n, [r[f"s{i}"] for i in range(dim)]
    return counts, sums


def clusters(df: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: int = 2, id_column: str = "vec_id", vector_column: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(vectors, centroids): id, cluster and squared distance of each kept vector; cluster, centroid (array of long) and inertia of each centroid."""
    spark = df.sparkSession
    v = F.col(vector_column)
    fine = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < LARGEST))
    kept = df.filter(F.coalesce(fine, F.lit(False))).select(F.col(id_column).cast("bigint").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("v"))
    state = stored(kept.withColumns({"cluster": F.lit(-1), "upper": F.lit(float("inf")), "lower": F.lit(0.0)}), "vectors")
    first = state.filter("id is not null").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()
    centroids = np.array([r.v for r in first], dtype=np.int64).reshape(-1, dim)
    k, before = len(centroids), centroids
    if not k:
        discard(state)
        return spark.createDataFrame([], "id bigint, cluster int, distance bigint"), spark.createDataFrame([], "cluster int, centroid array<bigint>, inertia bigint")
    counts, sums = np.zeros(k, dtype=object), np.zeros((k, dim), dtype=object)
    for _ in range(rounds):
        new = stored(assigned(state, Bounds(centroids, before), dim, final=False), "vectors")
        discard(state)
        state = new
        more, change = change_of_sums(state, k, dim)
        counts, sums, before = counts + more, sums + change, centroids
        centroids = np.array([sums[c] // counts[c] if counts[c] else before[c] for c in range(k)], dtype=np.int64)
    out = stored(assigned(state, Bounds(centroids, before), dim, final=True), "clustered")
    discard(state)
    inertia = {r.cluster: r.inertia for r in out.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    table = spark.createDataFrame([(c, [int(x) for x in centroids[c]], inertia.get(c, 0)) for c in range(k)], "cluster int, centroid array<bigint>, inertia bigint")
    return out, table


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()
