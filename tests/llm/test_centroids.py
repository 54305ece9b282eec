import hashlib
import random

import pytest

from tallywright.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, cluster string, distance int, id int"


def brute(rows, clusters, rounds, scale, dims):
    """(id, cluster, distance) in plain Python integers, and the final centroids."""
    import math

    kept = [(i, tuple(math.floor(scale * x) for x in v)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [list(q) for _, q in order[:clusters]]

    def near(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, q in kept:
            groups.setdefault(near(q)[1], []).append(q)
        for n, own in groups.items():
            centres[n] = [sum(x) // len(own) for x in zip(*own)]
    return [(i, near(q)[1], near(q)[0]) for i, q in kept], centres


def key(row):
    return (row[0] is not None, row)


def test_equals_plain_python(spark):
    rng = random.Random(5)
    draw = lambda: [rng.choice([-2.25, -1.0, 0.0, 0.3, 1.0, 1.5]) for _ in range(4)]
    rows = [(i, draw()) for i in range(300)] + [(7, draw()), (7, [0.0] * 4), (7, [0.0] * 4), (None, draw()), (None, None)]
    rows += [(900, [1.0, None, 0.0, 0.0]), (901, [float("nan")] * 4), (902, [float("inf"), 0.0, 0.0, 0.0]), (903, [1.0] * 3), (904, [1.0] * 5), (905, []), (906, None)]
    frame = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], SCHEMA).repartition(5)
    got, centres = centroids.cluster(frame, clusters=5, rounds=3, scale=8, dims=4)
    want, plain = brute(rows, 5, 3, 8, 4)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert centres.tolist() == plain


def test_an_empty_cluster_keeps_its_centroid_and_ties_take_the_smaller(spark):
    frame = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(6)], "vec_id long, embedding array<double>")
    got, centres = centroids.cluster(frame, clusters=3, rounds=2, scale=1, dims=2)
    assert {r["cluster"] for r in got.collect()} == {0}
    assert centres.tolist() == [[1, 1]] * 3


def test_fewer_vectors_than_clusters_and_none_at_all(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, -4.5])], "vec_id int, embedding array<double>")
    got, centres = centroids.cluster(frame, clusters=16, rounds=3, scale=1, dims=2)
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute([(1, [1.0, 2.0]), (2, [3.0, -4.5])], 16, 3, 1, 2)[0]) and len(centres) == 2
    none, centres = centroids.cluster(frame.limit(0), dims=2)
    assert none.collect() == [] and none.columns == ["vec_id", "cluster", "distance"] and len(centres) == 0


def test_components_that_might_overflow_are_refused(spark):
    frame = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="in magnitude"):
        centroids.cluster(frame, dims=2)


def test_query_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert centroids.op11_centroids(spark, str(tmp_path)).collect() == []
