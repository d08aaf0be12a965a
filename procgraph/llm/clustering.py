"""Exact integer k-means with block-norm screening of centroids."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procgraph.llm.common import cut

#: Integers beyond it are held at it, so that squared distances fit into 64 bits: components of 524,288 and more at a scale of 256.
MOST = 2**27
MOST_LONG = 2**63 - 1


def block_norms(x: np.ndarray, blocks: int) -> np.ndarray:
    """[vector, block]: the norms of a vector's segments."""
    x = x.astype(np.float64)
    return np.sqrt(np.add.reduceat(x * x, np.arange(0, x.shape[1], -(-x.shape[1] // blocks)), axis=1))


def coarse(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(8-bit codes, step) of integer vectors: code * step is within half a step of each component, a step the least power of two that 8 bits allow."""
    step = 2.0 ** np.ceil(np.log2(np.maximum(np.abs(x).max(1, initial=0), 1) / 127))
    step = np.maximum(step, 1)
    return np.rint(x / step[:, None]).astype(np.int8), step.astype(np.int32)


def compressed(vectors: DataFrame, column: str = "embedding", id_column: str = "vec_id", dims: int = 64, scale: int = 256, blocks: int = 8) -> DataFrame:
    """(vec_id, x, code, step, norms) of every whole finite vector of `dims` components.

    x are the integers floor(scale * component), 32 bits each, code * step its compressed
    form with a byte a component, and norms the norms of the segments of what that leaves out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch["v"]), dims), False))
            values = np.asarray(batch["v"].flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)  # null: not a number
            whole = np.isfinite(values).all(1)
            with np.errstate(over="ignore"):
                x = np.clip(np.floor(scale * values[whole]), -MOST, MOST).astype("<i4")
            code, step = coarse(x)
            norms = block_norms(x - code * step[:, None].astype(np.float64), blocks).astype("<f4")
            binary = lambda rows: pa.array([r.tobytes() for r in rows], pa.binary())
            rows = [batch["vec_id"].filter(pa.array(whole)), binary(x), binary(code), pa.array(step), binary(norms)]
            yield pa.RecordBatch.from_arrays(rows, names=["vec_id", "x", "code", "step", "norms"])

    return vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).alias("v")).mapInArrow(run, "vec_id long, x binary, code binary, step int, norms binary")


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows, in 64-bit integers."""
    apart = x - y
    return np.einsum("ij,ij->i", apart, apart)


def nearest(x: np.ndarray, near: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number, squared distance) of each vector's nearest centroid, the smaller number at ties, and how many exact distances that took.

    near is the compressed form of x, and norms are the segment norms of x - near. By Cauchy and Schwarz in each
    segment, x.c is at most near.c + sum norms_b |c_b|, so |x|^2 + |c|^2 less twice that is a lower bound of the distance. A
    centroid whose bound lies beyond the best distance so far is not looked at; the margin covers the rounding of bounds.
    """
    x, own = np.ascontiguousarray(x, np.int64), centroids.astype(np.float64)
    squares = np.einsum("ij,ij->i", x, x, dtype=np.float64)[:, None] + (own**2).sum(1)
    least = squares * (1 - 1e-6) - 2 * (near @ own.T + norms @ block_norms(own, norms.shape[1]).T) - 1
    which = least.argmin(1)
    best, taken = distances(x, centroids[which]), len(x)
    for j, centroid in enumerate(centroids):
        rows = np.flatnonzero((least[:, j] <= best) & (which != j))
        taken += len(rows)
        d = distances(x[rows], centroid)
        better = (d < best[rows]) | ((d == best[rows]) & (j < which[rows]))
        rows, d = rows[better], d[better]
        best[rows], which[rows] = d, j
    return which, best, taken


def assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[tuple]:
    """(batch, x, number, distance, exact distances) of every batch of compressed vectors."""
    for batch in batches:
        of = lambda column, kind: np.frombuffer(b"".join(batch[column].to_pylist()), kind).reshape(len(batch), -1)
        x, near = of("x", "<i4").astype(np.int64), of("code", np.int8) * batch["step"].to_numpy()[:, None].astype(np.float64)
        yield batch, x, *nearest(x, near, of("norms", "<f4").astype(np.float64), centroids)


def totals(rows: DataFrame, centroids: np.ndarray, of: Callable) -> dict[int, list[int]]:
    """The sums, by cluster, of the numbers that of(x, distance) has for each vector; exact at any size. One row a cluster and number comes to the driver."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = 0
        for _, x, which, best, _ in assigned(batches, centroids):
            numbers = of(x, best)
            part = np.zeros((k, numbers.shape[1]), np.int64)
            np.add.at(part, which, numbers)
            held = held + part
        if not isinstance(held, int):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k), pa.int32()), pa.array(list(held), pa.list_(pa.int64()))], names=["cluster", "sums"])

    parts = rows.mapInArrow(run, "cluster int, sums array<long>").select("cluster", F.posexplode("sums").alias("at", "n"))
    out: dict[int, list[int]] = {}
    for r in parts.groupBy("cluster", "at").agg(F.sum(F.col("n").cast("decimal(19,0)")).alias("n")).orderBy("cluster", "at").collect():
        out.setdefault(r["cluster"], []).append(int(r["n"]))
    return out


def centroids_of(rows: DataFrame, k: int, rounds: int, seed: int) -> np.ndarray:
    """The integer centroids after so many rounds over compressed vectors; the first are the k vectors of the smallest hashes of their ids."""
    first = rows.select("x", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("hash"))
    first = first.orderBy(F.col("hash").asc_nulls_last(), "x").limit(k).collect()
    centroids = np.array([np.frombuffer(r["x"], "<i4") for r in first], np.int64)
    for _ in range(rounds if len(first) else 0):
        found = totals(rows, centroids, lambda x, best: np.concatenate([np.ones((len(x), 1), np.int64), x], axis=1))
        for j, (n, *sums) in found.items():
            if n:
                centroids[j] = [s // n for s in sums]
    return centroids


def cluster(vectors: DataFrame, column: str = "embedding", id_column: str = "vec_id", k: int = 40, rounds: int = 5, seed: int = 2, dims: int = 64, scale: int = 256, blocks: int = 8) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector with `dims` finite components.

    Vectors of another length, null ones and those with a null or non-finite component
    give no row. Repeated rows count each; of equal hashes the smaller vector comes first. A null id
    starts no centroid before all others, and its row stays. With fewer than k vectors there are so many centroids;
    an empty table gives no rows. Other columns aren't read. Components of 524,288 and more (at a scale of 256) are held there, and inertias at the largest long.

    A round moves k rows of dims + 1 numbers a task; vectors are written once, compressed, and never shuffled.
    """
    rows = cut(compressed(vectors, column, id_column, dims, scale, blocks))
    centroids = centroids_of(rows, k, rounds, seed)
    if not len(centroids):
        centroids = np.zeros((0, dims), np.int64)
    # halves, as a task's distances may not fit into 64 bits together
    parts = totals(rows, centroids, lambda x, best: np.stack([best >> 32, best & 0xFFFFFFFF], axis=1)) if len(centroids) else {}
    inertia = np.array([min((parts[j][0] << 32) + parts[j][1], MOST_LONG) for j in range(len(centroids))], np.int64)
    whole = min(sum(map(int, inertia)), MOST_LONG)
    digests = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, which, best, _ in assigned(batches, centroids):
            columns = [batch["vec_id"], pa.array(which, pa.int32()), pa.array(best), pa.array(inertia[which]), pa.array(np.full(len(best), whole)), pa.array(digests).take(pa.array(which))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return rows.mapInArrow(run, "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
