"""Plain Lloyd clustering over integer vectors.

Vectors are floored to integers, so every distance, sum and quotient is exact and no order
of rows or partitions changes a result. A round broadcasts the k centroids with the task,
takes integer squared differences in NumPy a centroid at a time, and leaves one row of sums
per partition and cluster; a groupBy merges those. Only the k x dims centroids of a round
come to the driver, whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise

#: Components per vector, integer steps per unit, clusters and rounds of the contract.
DIMS, SCALE, CLUSTERS, ROUNDS = 64, 64, 16, 3
#: Integer components stay below this in magnitude, so that squared distances fit a long.
LARGEST = 1 << 27
#: Vectors whose differences are held at once inside a task.
ROWS = 8_192


def usable(vector: Column, dims: int) -> Column:
    """Whether a vector has exactly ``dims`` components, none of them null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(F.when(F.size(vector) == dims, finite), F.lit(False))


def integers(vectors: pd.Series, scale: int, dims: int) -> np.ndarray:
    """The vectors as one matrix of floor(scale * x)."""
    out = np.floor(np.stack(vectors.to_numpy()).astype(np.float64) * scale) if len(vectors) else np.zeros((0, dims))
    if out.size and np.abs(out).max() >= LARGEST:
        raise ValueError(f"a component is {LARGEST // scale} or more in magnitude: squared distances might not fit a long")
    return out.astype(np.int64)


def nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance to it); ties go to the smaller number."""
    apart = np.empty((len(points), len(centroids)), dtype=np.int64)
    for c, centroid in enumerate(centroids):
        difference = points - centroid
        np.einsum("ij,ij->i", difference, difference, out=apart[:, c])
    best = apart.argmin(axis=1)
    return best, apart[np.arange(len(points)), best]


def starting_centroids(vectors: DataFrame, id_col: str, vector_col: str, clusters: int, scale: int, dims: int) -> np.ndarray:
    """The first vectors by the SHA-256 of ``1:<id>``; equal ids follow in the order of their components."""
    seed = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    first = vectors.select(seed.alias("seed"), F.col(vector_col).alias("vector")).orderBy("seed", "vector").limit(clusters).collect()
    return integers(pd.Series([np.array(r["vector"], dtype=np.float64) for r in sorted(first, key=lambda r: (r["seed"], r["vector"]))], dtype=object), scale, dims)


def one_round(vectors: DataFrame, vector_col: str, centroids: np.ndarray, scale: int, dims: int) -> np.ndarray:
    """The centroids after one round: exact floors of the means, unchanged where nothing is nearest."""
    sums = [f"s{i}" for i in range(dims)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, total = np.zeros(len(centroids), dtype=np.int64), np.zeros((len(centroids), dims), dtype=np.int64)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                points = integers(batch["vector"].iloc[at:at + ROWS], scale, dims)
                best, _ = nearest(points, centroids)
                count += np.bincount(best, minlength=len(centroids))
                order = np.argsort(best, kind="stable")
                present, heads = np.unique(best[order], return_index=True)
                if len(present):
                    total[present] += np.add.reduceat(points[order], heads, axis=0)
        some = np.flatnonzero(count)
        yield pd.DataFrame({"cluster": some.astype(np.int32), "n": count[some]} | {name: total[some, i] for i, name in enumerate(sums)})

    schema = "cluster int, n long, " + ", ".join(f"{name} long" for name in sums)
    merged = vectors.select(F.col(vector_col).alias("vector")).mapInPandas(run, schema).groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(name).alias(name) for name in sums))
    out = centroids.copy()
    for row in merged.collect():  # at most a row a cluster
        out[row["cluster"]] = [row[name] // row["n"] for name in sums]
    return out


def assign(vectors: DataFrame, id_col: str, vector_col: str, centroids: np.ndarray, scale: int, dims: int) -> DataFrame:
    """(id, cluster, distance) of every vector."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.iloc[at:at + ROWS]
                best, distance = nearest(integers(part["vector"], scale, dims), centroids)
                yield pd.DataFrame({"id": part["id"], "cluster": best.astype(np.int32), "distance": distance})

    schema = T.StructType([T.StructField("id", vectors.schema[id_col].dataType), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    return vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).mapInPandas(run, schema).withColumnRenamed("id", id_col)


def cluster(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
    clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, dims: int = DIMS,
) -> tuple[DataFrame, np.ndarray]:
    """Every usable vector with its cluster and squared distance, and the final centroids.

    Null vectors, vectors of another length and vectors with a null, NaN or infinite
    component are left out; rows with a repeated or null id each count as a vector of their
    own (a null id hashes as an empty one); other columns are ignored. With fewer usable
    vectors than clusters each of them starts a cluster; an empty table has no clusters and
    no rows. Components of 2**27 / scale or more in magnitude raise an error, for their
    distances might not fit a long.
    """
    kept = vectors.where(usable(F.col(vector_col), dims)).select(id_col, vector_col)
    centroids = starting_centroids(kept, id_col, vector_col, clusters, scale, dims)
    if len(centroids):
        for _ in range(rounds):
            centroids = one_round(kept, vector_col, centroids, scale, dims)
        return assign(kept, id_col, vector_col, centroids, scale, dims), centroids
    return kept.select(id_col, F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).where(F.lit(False)), centroids


def op11_centroids(spark, sf_dir: str) -> DataFrame:
    """Contract query: all vectors of ``embeddings`` with their clusters, and what the clusters sum up to."""
    assigned, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    assigned = materialise(assigned, "clusters")
    inertia = {r["cluster"]: r["inertia"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    total = sum(inertia.values())
    rows = [(c, inertia.get(c, 0), total, ",".join(map(str, centroid.tolist()))) for c, centroid in enumerate(centroids)]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, components string")
    return assigned.join(F.broadcast(facts), "cluster").select(  # a row a cluster
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2("components", 256).alias("centroid_sha256"),
    )


_ROUND = """
a{i} AS (SELECT rn, q, arg_min(c, (d, c)) AS c FROM (
  SELECT v.rn, v.q, m.c, list_sum(list_transform(range(1, 65), lambda i: (v.q[i] - m.q[i]) * (v.q[i] - m.q[i]))) AS d FROM v, c{i} AS m) GROUP BY rn, q),
m{i} AS (SELECT c, list(f ORDER BY p) AS q FROM (
  SELECT c, p, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS f
  FROM (SELECT c, unnest(q) AS x, unnest(range(1, 65)) AS p FROM a{i}) GROUP BY c, p) GROUP BY c),
c{next} AS (SELECT c{i}.c, coalesce(m{i}.q, c{i}.q) AS q FROM c{i} LEFT JOIN m{i} ON m{i}.c = c{i}.c),
"""

#: The same with lists, every distance spelled out, for DuckDB.
ORACLE_SQL = """
WITH v AS (SELECT row_number() OVER () AS rn, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY h, q) - 1 AS c, q FROM (SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, q FROM v ORDER BY h, q LIMIT 16)),
""" + "".join(_ROUND.format(i=i, next=i + 1) for i in range(ROUNDS)) + """
f AS (SELECT rn, min(d) AS distance, arg_min(c, (d, c)) AS cluster FROM (
  SELECT v.rn, m.c, list_sum(list_transform(range(1, 65), lambda i: (v.q[i] - m.q[i]) * (v.q[i] - m.q[i]))) AS d FROM v, c3 AS m) GROUP BY rn)
SELECT v.vec_id, CAST(f.cluster AS INTEGER) AS cluster, CAST(f.distance AS BIGINT) AS distance,
  CAST(sum(f.distance) OVER (PARTITION BY f.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(f.distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c3.q, ',')) AS centroid_sha256
FROM f JOIN v ON v.rn = f.rn JOIN c3 ON c3.c = f.cluster
"""
