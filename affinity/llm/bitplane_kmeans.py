"""Lloyd's centroid clustering on bit planes, in exact integers.

A vector of 64 integers is stored as one 64-bit word per bit plane: bit j of
plane b is bit b of component j in two's complement, so the top plane weighs
-2^(planes-1).  With centroids packed the same way a dot product is the sum of
``weight_a * weight_b * popcount(plane_a & plane_b)`` over pairs of planes, and
``|x - c|^2 = |x|^2 - 2 x.c + |c|^2`` is exact.  Component sums come from the
planes as well.  Spark holds the packed rows in a written table, each task adds
up its part and only ``k`` sums of a round reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.llm.common import cut

DIM = 64
# Components lie in [-2^27, 2^27): 64 squared differences then fit a BIGINT.
MAX_PLANES = 28
# Rows whose distances a task holds at once.
SLICE = 2_048


def plane_weights(planes: int) -> np.ndarray:
    """The value of each plane's bit; the top one is the sign."""
    w = np.left_shift(np.int64(1), np.arange(planes, dtype=np.int64))
    w[-1] = -w[-1]
    return w


def pack(values: np.ndarray, planes: int) -> np.ndarray:
    """(n, 64) integers as (n, planes) words."""
    out = np.empty((len(values), planes), np.uint64)
    for b in range(planes):
        bits = ((values >> b) & 1).astype(np.uint8)
        out[:, b] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def unpack_sums(words: np.ndarray, group: np.ndarray, k: int) -> np.ndarray:
    """(k, 64) component sums of the packed rows of each group."""
    out = np.zeros((k, DIM), np.int64)
    member = np.zeros((k, len(words)), np.float64)
    member[group, np.arange(len(words))] = 1
    for b, w in enumerate(plane_weights(words.shape[1])):
        plane = np.ascontiguousarray(words[:, b]).view(np.uint8).reshape(-1, 8)
        out += w * (member @ np.unpackbits(plane, axis=1, bitorder="little").astype(np.float64)).astype(np.int64)
    return out


def dots(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """(n, k) exact dot products of packed rows and packed centroids."""
    out = np.zeros((len(x), len(c)), np.int64)
    weights = plane_weights(x.shape[1])
    for a, wa in enumerate(weights):
        for b, wb in enumerate(weights):
            out += wa * wb * np.bitwise_count(x[:, a, None] & c[None, :, b]).astype(np.int64)
    return out


def norms(x: np.ndarray) -> np.ndarray:
    """Squared lengths of packed rows."""
    weights, out = plane_weights(x.shape[1]), np.zeros(len(x), np.int64)
    for a, wa in enumerate(weights):
        for b, wb in enumerate(weights):
            out += wa * wb * np.bitwise_count(x[:, a] & x[:, b]).astype(np.int64)
    return out


def nearest(x: np.ndarray, norm: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of packed rows; ties go to the smaller number."""
    got = norm[:, None] - 2 * dots(x, c) + norms(c)[None, :]
    at = got.argmin(axis=1)
    return at, got[np.arange(len(x)), at]


def _kept(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, v): integer vectors of exactly 64 finite components."""
    x = F.col("x")
    good = (F.size(x) == DIM) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
            .where(F.coalesce(good, F.lit(False)))
            .select("id", F.transform("x", lambda c: F.floor(F.lit(scale) * c).cast("long")).alias("v")))


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    """The fixed-length binary cells of a column as rows."""
    blob = b"".join(column.to_pylist())
    return np.frombuffer(blob, dtype).reshape(len(column), -1)


def _packed(kept: DataFrame, planes: int) -> DataFrame:
    """(id, planes BINARY, norm)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM)
            words = pack(values, planes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([w.tobytes() for w in words], pa.binary()), pa.array(norms(words))],
                ["id", "planes", "norm"])
    return kept.mapInArrow(run, "id long, planes binary, norm long")


def _assigned(batch: pa.RecordBatch, c: np.ndarray):
    """(rows, packed rows, cluster, distance) for slices of a batch."""
    for at in range(0, len(batch), SLICE):
        part = batch.slice(at, SLICE)
        x = _matrix(part.column("planes"), np.uint64)
        yield part, x, *nearest(x, part.column("norm").to_numpy(), c)


def _round(packed: DataFrame, centroids: np.ndarray, planes: int) -> np.ndarray:
    """The centroids after one round of assignment and exact floored means."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, total, count = pack(centroids, planes), np.zeros((k, DIM), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for _, x, at, _ in _assigned(batch, c):
                total += unpack_sums(x, at, k)
                count += np.bincount(at, minlength=k)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(count[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))],
            ["cluster", "n", "total"])

    sums = packed.mapInArrow(run, "cluster int, n long, total array<long>")
    # k rows of 64 sums, whatever the input
    rows = sums.groupBy("cluster").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.get("total", j).cast("decimal(38,0)")) for j in range(DIM)]).alias("total")).collect()
    out = centroids.copy()
    for row in rows:
        out[row["cluster"]] = [int(t) // row["n"] for t in row["total"]]
    return out


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, scale: float = 256.0,
            id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` per vector.

    Components become ``floor(scale * x)``.  The first centroids are the ``k``
    vectors with the smallest sha256 of ``<seed>:<id>`` (all, if fewer; rows
    without an id last, repeated ids by their vector), numbered in that order.
    A round gives each vector its nearest centroid (ties: smaller number) and
    each non-empty centroid the floored mean of its vectors; then all vectors
    are assigned once more.

    Null vectors, vectors of another length than 64 and vectors with null or
    non-finite components give no row.  Repeated rows count, and are returned,
    as often as they occur.  An empty table gives an empty result, other
    columns are ignored.  Components outside [-2^27, 2^27) raise ValueError, as
    their distances do not fit a BIGINT.
    """
    kept = _kept(vectors, id_col, vector_col, scale)
    edge = kept.agg(F.max(F.array_max("v")).alias("hi"), F.min(F.array_min("v")).alias("lo")).first()
    spark = kept.sparkSession
    shape = f"{id_col} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if edge["hi"] is None:
        return spark.createDataFrame([], shape)
    planes = max(int(edge["hi"]).bit_length(), (-1 - int(edge["lo"])).bit_length(), 1) + 1
    if planes > MAX_PLANES:
        raise ValueError(f"components from {edge['lo']} to {edge['hi']} need {planes} bit planes, at most {MAX_PLANES} are exact")
    first = (kept.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h"), "v")
             .orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect())
    centroids = np.array([row["v"] for row in first], np.int64)
    packed = cut(_packed(kept, planes), "kmeans-planes")
    for _ in range(rounds):
        centroids = _round(packed, centroids, planes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = pack(centroids, planes)
        for batch in batches:
            for part, _, at, distance in _assigned(batch, c):
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(at.astype(np.int32)), pa.array(distance)],
                                                 ["id", "cluster", "distance"])

    assigned = cut(packed.mapInArrow(run, "id long, cluster int, distance long"), "kmeans-assigned")
    # at most k rows
    inertia = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = sum(inertia.values())
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    about = spark.createDataFrame([(i, s, total, digest[i]) for i, s in sorted(inertia.items())],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return (assigned.join(F.broadcast(about), "cluster")
            .select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"))
