"""Centroid clustering of vectors in whole numbers, with scalar lookup tables.

1. Vectors with exactly ``dims`` components, none NULL or non-finite, are coded once: every component x
   becomes floor(``scale`` * x), computed on doubles. The codes are one narrow table in the shared folder,
   which every round rereads.
2. The first centroids are the ``k`` coded vectors with the smallest sha256 of ``seed:id``.
3. *Rounds.* The driver holds the k x dims centroids and nothing else. A task tabulates the squared
   difference for each dimension, integer value that occurs in its batch and centroid; the distances of
   the batch are gathers from these tables, summed over the dimensions. A task returns one row per
   (centroid, dimension) with the sum and the count of its vectors, so a round moves k x dims small rows
   per task whatever the table holds. Means are floors of exact quotients; an empty centroid stays.
4. Vectors are assigned once more; inertia is summed from that.

All arithmetic is on whole numbers, so the result does not depend on the order or partitioning of rows. A
cluster with a third of all vectors is no hot key: nothing is shuffled by cluster but partial sums.

Defined results: ties of the distance go to the smaller centroid number; vectors that are NULL, of another
length or with a NULL, NaN or infinite component have no row; a NULL id counts as the empty text in the hash
and keeps its row; repeated rows are vectors like any other (equal hashes are ordered by the codes; of equal
centroids the first gets the vectors); fewer vectors than ``k`` give as many centroids as there are; an
empty table gives an empty result. Codes of 2**28 or more have no squared distance in 64 bits: they
raise an error instead of a wrong number. Only the id and the vector are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.bounds import settle
from tallyforge.llm.common import rows_of

DIMS = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
# Vectors whose distances a task works out at a time.
ROWS = 2048
LARGEST = 1 << 28


def coded(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, codes: array<bigint>) of the vectors that count."""
    v = F.col(vector_col)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = vectors.select(F.col(id_col).alias("vec_id"), F.when(F.size(v) == dims, v).alias("v")).where(F.col("v").isNotNull() & F.forall("v", finite))
    return good.select("vec_id", F.transform("v", lambda x: F.floor(x.cast("double") * scale)).alias("codes"))


def _matrix(codes: pa.ListArray) -> np.ndarray:
    """Rows of a batch as an integer matrix."""
    x = codes.flatten().to_numpy().reshape(len(codes), -1)
    if len(x) and max(int(x.max()), -int(x.min())) >= LARGEST:
        raise ValueError(f"a coded component is {LARGEST} or more: its squared distances exceed 64 bits")
    return x


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances (vectors x centroids) from one table of squared differences per dimension."""
    out = np.zeros((len(x), len(centroids)), np.int64)
    for d in range(x.shape[1]):
        values, place = np.unique(x[:, d], return_inverse=True)
        table = (values[:, None] - centroids[None, :, d]) ** 2
        out += table[place]
    return out


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, the smaller one of ties; its squared distance) of each vector."""
    far = distances(x, centroids)
    best = far.argmin(axis=1)
    return best, far[np.arange(len(x)), best]


def _sums(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = centroids.shape
        count, total = [0] * k, np.zeros((k, dims), object)
        for b in rows_of(batches, ROWS):
            x = _matrix(b.column(0))
            if not len(x):
                continue
            own = nearest(x, centroids)[0]
            for c in np.unique(own).tolist():
                mine = x[own == c]
                count[c] += len(mine)
                total[c] += mine.sum(axis=0)
        rows = [(c, d, count[c], str(total[c, d])) for c in range(k) if count[c] for d in range(dims)]
        cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.string()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["cluster", "dim", "n", "total"])

    return run


def _assign(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches, ROWS):
            x = _matrix(b.column(1))
            own, far = nearest(x, centroids) if len(x) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            yield pa.record_batch([b.column(0), pa.array(own, pa.int32()), pa.array(far, pa.int64())], names=["vec_id", "cluster", "distance"])

    return run


def first_centroids(vectors: DataFrame, k: int = CLUSTERS, seed: int = 1) -> np.ndarray:
    """The ``k`` coded vectors with the smallest hash of ``seed:id``: k rows come to the driver."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = vectors.select(name.alias("hash"), "codes").orderBy("hash", "codes").limit(k).collect()
    return np.array([r["codes"] for r in rows], np.int64) if rows else np.zeros((0, 0), np.int64)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of the exact means, empty ones as they were."""
    part = vectors.select("codes").mapInArrow(_sums(centroids), "cluster int, dim int, n bigint, total string")
    sums = part.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    out = centroids.copy()
    for r in sums.collect():  # k x dims rows
        out[r["cluster"], r["dim"]] = int(r["total"]) // r["n"]
    return out


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 1, dims: int = DIMS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) per vector that counts, final centroids: one row each)."""
    own = settle(coded(vectors, id_col, vector_col, dims, scale), "vector-codes")
    centroids = first_centroids(own, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(own, centroids)
    kind = own.schema["vec_id"].dataType.simpleString()
    if not len(centroids):
        return own.selectExpr("vec_id", "0 AS cluster", "0L AS distance"), centroids
    return own.mapInArrow(_assign(centroids), f"vec_id {kind}, cluster int, distance bigint"), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``assigned`` with the inertia of its cluster and of all, and the sha256 of its centroid's components."""
    assigned = settle(assigned, "assigned")
    per = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = [(c, per.get(c, 0), sum(per.values()), s) for c, s in enumerate(sha)]
    side = assigned.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(side), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round_sql(i: int) -> str:
    """One assignment (a<i>) and the centroids after it (c<i+1>)."""
    return f"""
a{i} AS (
  SELECT vec_id, rid, codes, arg_min(c, far * {CLUSTERS} + c) AS cluster, min(far) AS distance FROM (
    SELECT vec_id, rid, v.codes, c, CAST(list_sum(list_transform(list_zip(v.codes, k.codes), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS far
    FROM coded v, c{i} k) GROUP BY ALL
), m{i} AS (
  SELECT cluster, d, CAST(sum(codes[d]) AS BIGINT) AS s, count(*) AS n FROM a{i}, range(1, {DIMS + 1}) t(d) GROUP BY cluster, d
), c{i + 1} AS (
  SELECT c, coalesce((SELECT list((s - ((s % n) + n) % n) // n ORDER BY d) FROM m{i} WHERE cluster = c), codes) AS codes FROM c{i}
)"""


CLUSTER_SQL = f"""
WITH coded AS (
  SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS codes FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}
), c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), codes) - 1 AS c, codes FROM coded
  QUALIFY c < {CLUSTERS}
),{",".join(_round_sql(i) for i in range(ROUNDS + 1))}
SELECT vec_id, CAST(a.cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(k.codes, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} k ON a.cluster = k.c
"""
