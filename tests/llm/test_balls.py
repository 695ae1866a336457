"""Ball k-means against plain Lloyd rounds in Python's whole numbers."""

import hashlib
from math import floor, inf, isfinite, nan

import numpy as np
import pytest

from gradeloom.llm import balls
from tests.conftest import SF, assert_same


def lloyd(rows, k=8, rounds=10, dims=64, scale=1024, seed=3):
    """rows: (vec_id, embedding). Returns the sorted (vec_id, cluster, distance), and the centroids."""
    kept = [(i, [floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    means = [v for _, v in sorted(kept, key=key)[:k]]

    def dealt():
        return [min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), c) for c, m in enumerate(means)) for _, v in kept]

    for _ in range(rounds):
        places = dealt()
        for c in range(len(means)):
            own = [v for (_, v), (_, p) in zip(kept, places, strict=True) if p == c]
            means[c] = [sum(x) // len(own) for x in zip(*own, strict=True)] if own else means[c]
    return sorted(((str(i), c, d) for (i, _), (d, c) in zip(kept, dealt(), strict=True))), means


def got(df, **how):
    rows, means = balls.ball_kmeans(df, **how)
    return sorted((str(r.vec_id), r.cluster, r.distance) for r in rows.collect()), means.tolist()


@pytest.mark.parametrize("k, rounds, spread", [(8, 10, 3), (5, 3, 1), (20, 10, 40), (3, 0, 2), (1, 2, 5)])
def test_against_plain_rounds(spark, k, rounds, spread):
    rng = np.random.default_rng(k)
    points = rng.integers(-spread, spread + 1, (300, 4)) / 2
    rows = [(i % 250 if i % 17 else None, p.tolist(), 1, "x") for i, p in enumerate(points)]
    rows += [(900, [0.5] * 4, 1, "x")] * 150  # one common vector
    rows += [(1, None, 0, ""), (2, [], 0, ""), (3, [1.0, None, 1.0, 1.0], 0, ""), (4, [nan, 1.0, 1.0, 1.0], 0, ""), (5, [inf, 1.0, 1.0, 1.0], 0, ""), (6, [1.0] * 5, 0, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster int, v string").repartition(5)
    assert got(df, k=k, rounds=rounds, dims=4, scale=2) == lloyd([r[:2] for r in rows], k, rounds, 4, 2)


def test_ties_few_rows_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    rows = [(i, [float(x)]) for i, x in enumerate([0, 2, 1, 1, 4, 3, 1])]
    assert got(spark.createDataFrame(rows, schema), k=4, dims=1, scale=1) == lloyd(rows, 4, 10, 1, 1)
    assert got(spark.createDataFrame(rows[:2], schema), dims=1) == lloyd(rows[:2], 8, 10, 1)
    assert got(spark.createDataFrame([(7, [1.0])] * 9, schema), dims=1) == lloyd([(7, [1.0])] * 9, 8, 10, 1)
    assert got(spark.createDataFrame([], schema)) == ([], [])
    with pytest.raises(Exception, match="not within"):
        got(spark.createDataFrame([(1, [1e9])], schema), dims=1)


def test_balls_compare_only_neighbours():
    centroids = np.array([[0], [10], [1000]])
    near = balls.Balls(centroids, [6, 6, 3], None)
    assert near.near == [[1], [0], []] and near.still == [False] * 3
    assert balls.Balls(centroids, [6, 6, 3], centroids).still == [True] * 3
    assert balls.Balls(centroids, [6, 6, 3], np.array([[0], [9], [1000]])).still == [False, False, True]
    v = np.array([[4], [5], [6], [1001]])
    cluster, distance = near.assign(v, np.array([0, 1, 0, 2]), np.zeros(4, dtype=np.int64))
    assert cluster.tolist() == [0, 0, 1, 2] and distance.tolist() == [16, 25, 16, 1]


def test_query(spark, duck):
    df = balls.op11_centroid_clustering(spark, SF)
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    plain, means = lloyd([tuple(r) for r in rows])
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in df.collect()) == plain
    assert {r.centroid_sha256 for r in df.select("centroid_sha256").collect()} <= {hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in means}
    assert df.head().inertia == sum(r[2] for r in plain)
    assert_same(df, duck, balls.OP11_SQL)
