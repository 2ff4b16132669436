"""Exact k-means on integer vectors by Delta Lloyd.

Every vector's centroid and distance are kept from round to round, and so are each cluster's sum and count. A round
compares a vector whose centroid stood still with the centroids that moved only, and a vector whose centroid moved with
all of them. Vectors that change sides are the only ones to be summed: their components are added to the cluster they
join and taken from the one they leave, in integers, so that the sums stay exact.

A round is one pass without a shuffle. Its table holds the vectors with their new state and, from each task, one row of
signed sums for every cluster that the task's vectors joined or left; no more than that is aggregated, and
k * (SIZE + 1) numbers reach the driver. The next round starts from the written table, so a lost executor costs its
tasks. Numbers below 2 ** 53 in all sums are multiplied as doubles, larger ones as 64-bit integers; both are exact.

Defined cases: a vector that is null, has another length than SIZE or holds a null, NaN or infinite component isn't
kept and has no row; equal rows have a row each, and of equal start hashes the smaller components come first; a null
vec_id is a vector like others that comes last as a starting centroid; with fewer vectors than k each is a centroid; an
empty table gives no rows; columns besides vec_id and embedding are ignored. A component beyond MOST is an error, as
squared distances would leave 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SIZE = 64
CLUSTERS = 40
ROUNDS = 5
SCALE = 256
#: Largest component as an integer: SIZE squares of twice as much stay below 2 ** 63.
MOST = 1 << 27
#: Number that goes before the ids whose hashes choose the first centroids.
SEED = 2


def whole(x: Column, size: int = SIZE) -> Column:
    return x.isNotNull() & (F.size(x) == size) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))


def vectors(embeddings: DataFrame, size: int = SIZE) -> DataFrame:
    """(vec_id, v) of the kept vectors, v as integers."""
    kept = embeddings.where(whole(F.col("embedding"), size)).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE)).alias("v"))
    fits = F.forall("v", lambda x: x.between(-MOST, MOST))
    return kept.withColumn("v", F.when(fits, F.col("v").cast("array<int>")).otherwise(F.raise_error(F.lit(f"a component is beyond {MOST}"))))


def first_centroids(rows: DataFrame, k: int, seed: int = SEED) -> np.ndarray:
    """The k vectors whose ids have the smallest hashes, in their order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    top = rows.select("v", key.alias("key")).orderBy(F.col("key").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in top], np.int64)


def distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of v from those of centroids, exact."""
    most = max(int(np.abs(v).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * v.shape[1] * most * most < 1 << 52:
        a, b = v.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    out = np.empty((len(v), len(centroids)), np.int64)
    for c, centroid in enumerate(centroids):
        d = v - centroid
        out[:, c] = (d * d).sum(1)
    return out


def reassigned(v: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New owners and distances; moved: the numbers of the centroids that changed, ascending. An owner of -1 is none. Ties go to the smaller number."""
    owner, distance = owner.copy(), distance.copy()
    lost = np.isin(owner, moved) | (owner < 0)
    if lost.any():
        d = distances(v[lost], centroids)
        owner[lost] = d.argmin(1)
        distance[lost] = d.min(1)
    stood = np.flatnonzero(~lost)
    if len(stood) and len(moved):
        d = distances(v[stood], centroids[moved])
        best, number = d.min(1), moved[d.argmin(1)]
        nearer = (best < distance[stood]) | ((best == distance[stood]) & (number < owner[stood]))
        owner[stood[nearer]], distance[stood[nearer]] = number[nearer], best[nearer]
    return owner, distance


def a_round(centroids: np.ndarray, moved: np.ndarray) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The pass of a round over (vec_id, v, owner, distance): the same rows anew, then rows with `cluster` and `change` (sums, count)."""
    k, size = centroids.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = np.zeros((k, size + 1), np.int64)
        touched = np.zeros(k, bool)
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            if not batch.num_rows:
                continue
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.int64)
            was = batch.column(2).to_numpy(zero_copy_only=False)
            owner, distance = reassigned(v, was, batch.column(3).to_numpy(zero_copy_only=False), centroids, moved)
            for sign, side in ((1, owner), (-1, was)):
                crossed = np.flatnonzero((owner != was) & (side >= 0))
                for c in np.unique(side[crossed]):
                    at = crossed[side[crossed] == c]
                    change[c, :size] += sign * v[at].sum(0)
                    change[c, size] += sign * len(at)
                    touched[c] = True
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(owner.astype(np.int32)), pa.array(distance), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int64()))], names=COLUMNS
            )
        numbers = np.flatnonzero(touched)
        if len(numbers):
            n = len(numbers)
            nothing = [pa.nulls(n, t) for t in (kind, pa.list_(pa.int32()), pa.int32(), pa.int64())]
            sums = pa.array(change[numbers].tolist(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*nothing, pa.array(numbers.astype(np.int32)), sums], names=COLUMNS)

    return run


COLUMNS = ["vec_id", "v", "owner", "distance", "cluster", "change"]


def transfers(done: DataFrame, k: int, size: int) -> np.ndarray:
    """What a round's rows add to each cluster's components and, last, to its count."""
    parts = done.where(F.col("cluster").isNotNull()).select("cluster", F.posexplode("change").alias("place", "x"))
    out = np.zeros((k, size + 1), object)
    for r in parts.groupBy("cluster", "place").agg(F.sum("x").alias("x")).collect():
        out[r["cluster"], r["place"]] = r["x"]
    return out


def averages(sums: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Floors of the clusters' means, exact; centroids of empty clusters stay."""
    return np.array([[int(x) // int(row[-1]) for x in row[:-1]] if row[-1] else list(old) for row, old in zip(sums, centroids, strict=True)], np.int64)


def cluster(embeddings: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector after the rounds and a last assignment."""
    spark = embeddings.sparkSession
    rows = vectors(embeddings, size)
    centroids = first_centroids(rows, k, seed)
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    if not len(centroids):
        nothing = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], f"vec_id {kind}, {nothing}")
    k = len(centroids)
    folder = common.work_folder(spark)
    schema = f"vec_id {kind}, v array<int>, owner int, distance long, cluster int, change array<long>"
    state = rows.select("vec_id", "v", F.lit(-1).alias("owner"), F.lit(0).cast("long").alias("distance"))
    sums, moved = np.zeros((k, size + 1), object), np.arange(k)
    for number in range(rounds + 1):
        done = common.stored(state.mapInArrow(a_round(centroids, moved), schema), folder, f"round-{number}")
        state = done.where(F.col("cluster").isNull()).select("vec_id", "v", "owner", "distance")
        if number == rounds:
            break
        sums = sums + transfers(done, k, size)
        new = averages(sums, centroids)
        moved = np.flatnonzero((new != centroids).any(1))
        centroids = new
        if not len(moved):
            break
    spread = {r["owner"]: r["s"] for r in state.groupBy("owner").agg(F.sum("distance").alias("s")).collect()}
    total = sum(spread.values())
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    facts = spark.createDataFrame([(c, s, total, digest(c)) for c, s in sorted(spread.items())], "owner int, cluster_inertia long, inertia long, centroid_sha256 string")
    # One row for each of k clusters.
    return state.join(F.broadcast(facts), "owner").select("vec_id", F.col("owner").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256")
