"""Centroid clustering by ball k-means, in whole numbers.

A cluster is a ball: its centroid and a radius within which its members lie. Another centroid can only
win a member over if it is nearer than twice the radius: those are the ball's neighbours. A member at
distance d from its own centroid is in the stable core if no neighbour's centroid is nearer than 2d; else
it lies in an annulus, which says how many neighbours, the nearest first, it is compared with. The members
of a ball of which neither the centroid nor a neighbour has moved keep their places without any distance.

Distances are squared and exact: D <= 4d decides, so ties are seen and nothing is lost to rounding.
"""

from __future__ import annotations

import hashlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import drop_folder, new_folder

#: Scaled components must lie within this, so that a squared distance of so many of them fits a long.
WITHIN, MOST_DIMS = 1 << 27, 64
ROWS = "vec_id long, v array<int>, cluster int, distance long"


def whole_vectors(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """(vec_id, v): vectors of exactly ``dims`` components, none null or non-finite, as floor(scale * x)."""
    number = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    kept = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") == dims)).where(finite)
    scaled = kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(number, lambda x: F.floor(scale * x)).alias("v"))
    fits = F.forall("v", lambda x: F.abs(x) < WITHIN)
    checked = F.when(fits, F.col("v")).otherwise(F.raise_error(F.lit(f"a scaled component is not within {WITHIN}")).cast("array<bigint>"))
    return scaled.select("vec_id", checked.cast("array<int>").alias("v"))


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors of the k least sha256 of ``seed:vec_id``, in that order; of one id the lesser vector, a null id counts as empty."""
    key = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    found = rows.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()
    return np.array([r.v for r in found], dtype=np.int64)


class Balls:
    """Centroids, which of them are near enough to matter to each, and which balls nothing can leave."""

    def __init__(self, centroids: np.ndarray, radius: list[int | None], before: np.ndarray | None):
        """``radius``: by ball, a bound of its members' distance to their centroid (not squared); None: any. ``before``: the centroids that the members were dealt by."""
        self.centroids = centroids
        moved = np.ones(len(centroids), dtype=bool) if before is None else (centroids != before).any(axis=1)
        self.near, self.apart, self.still = [], [], []
        for c, own in enumerate(centroids):
            apart = ((centroids - own) ** 2).sum(axis=1)
            within = [j for j in np.argsort(apart, kind="stable").tolist() if j != c and (radius[c] is None or int(apart[j]) <= 4 * radius[c] ** 2)]
            self.near.append(within)
            self.apart.append(apart[within])
            self.still.append(not moved[c] and not moved[within].any())

    def assign(self, v: np.ndarray, cluster: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid (of equals the smaller number) and the squared distance; ``cluster`` and ``distance`` are those of the round before."""
        cluster, distance = cluster.copy(), distance.copy()
        for c in np.unique(cluster).tolist():
            if self.still[c]:
                continue
            members = np.flatnonzero(cluster == c)
            own = v[members].astype(np.int64)
            best = ((own - self.centroids[c]) ** 2).sum(axis=1)
            # How many neighbours are near enough: none in the core, more with each annulus.
            asked = np.searchsorted(self.apart[c], 4 * best, side="right")
            to = np.full(len(members), c)
            for i, j in enumerate(self.near[c][: int(asked.max(initial=0))]):
                rows = np.flatnonzero(asked > i)
                other = ((own[rows] - self.centroids[j]) ** 2).sum(axis=1)
                won = (other < best[rows]) | ((other == best[rows]) & (j < to[rows]))
                best[rows[won]], to[rows[won]] = other[won], j
            distance[members] = best
            cluster[members] = -1 - to  # not to be looked at again as a member of another ball
        return np.where(cluster < 0, -1 - cluster, cluster), distance


def _written(rows: DataFrame, replaced: str | None = None) -> tuple[DataFrame, str]:
    """``rows`` in a folder of their own; the folder of the round before goes once this one is whole."""
    spark, folder = rows.sparkSession, new_folder(rows.sparkSession, "balls")
    rows.write.option("compression", "zstd").parquet(folder)
    if replaced:
        drop_folder(spark, replaced)
    return spark.read.schema(ROWS).parquet(folder), folder


def _dealt(rows: DataFrame, balls: Balls) -> DataFrame:
    def run(batches):
        for b in batches:
            v = b.column("v").flatten().to_numpy().reshape(b.num_rows, -1)
            cluster, distance = balls.assign(v, b.column("cluster").to_numpy(), b.column("distance").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "v", "cluster", "distance"])

    return rows.mapInArrow(run, ROWS)


def ball_kmeans(vectors: DataFrame, *, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> tuple[DataFrame, np.ndarray]:
    """(rows, centroids): vec_id, v (the vector in whole numbers), cluster and distance of every vector kept; the final centroids by cluster.

    Kept are the vectors (column embedding) of exactly ``dims`` components, none null or non-finite, each
    component x as floor(scale * x). The first centroids are those of the least hashes of seed:vec_id. A
    round deals every vector to the nearest centroid (squared distance; of equals the smaller number), then
    moves each centroid that has members to floor(sum / count) of them; vectors are dealt once more at the end.
    Fewer than k vectors make as many clusters; none, none. Ids may be null or repeat; other columns are
    left out. A component of 2**27 or more after scaling raises, as distances would not fit a long.

    The driver holds k centroids and a row of sums for each; vectors stay with their tasks, and nothing but
    those sums shuffles. A round reads the table of the round before and writes its own to the shared folder.
    Once no centroid moves, later rounds would change nothing and are not run.
    """
    if not 0 < dims <= MOST_DIMS:
        raise ValueError(f"dims is 1 to {MOST_DIMS}")
    start = whole_vectors(vectors, dims, scale).select("*", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    rows, folder = _written(start)
    centroids, before = first_centroids(rows, k, seed), None
    radius: list[int | None] = [None] * len(centroids)
    for _ in range(rounds if len(centroids) else 0):
        rows, folder = _written(_dealt(rows, Balls(centroids, radius, before)), folder)
        sums = [F.sum(F.get("v", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)]
        found = rows.groupBy("cluster").agg(F.count("*").alias("n"), F.max("distance").alias("far"), *sums).collect()
        before, centroids = centroids, centroids.copy()
        radius = [0] * len(centroids)
        for r in found:
            centroids[r.cluster] = [int(r[f"s{i}"]) // r.n for i in range(dims)]
            shift = int(((centroids[r.cluster] - before[r.cluster]) ** 2).sum())
            radius[r.cluster] = isqrt(r.far) + isqrt(shift) + 2
        if (centroids == before).all():
            return rows, centroids
    if len(centroids):
        rows, _ = _written(_dealt(rows, Balls(centroids, radius, before)), folder)
    return rows, centroids


def op11_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    rows, centroids = ball_kmeans(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    # As many rows as there are clusters, which the caller asked for.
    sums = {r.cluster: r.n for r in rows.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}
    digest = lambda v: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()
    of = [(c, sums.get(c, 0), sum(sums.values()), digest(v)) for c, v in enumerate(centroids.tolist())]
    of = spark.createDataFrame(of, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """The same in SQL, without balls: every distance of every round."""

    def dealt(i: int) -> str:
        return f"""a{i} as materialized (
  select row, vec_id, v, c.cluster, list_sum(list_transform(list_zip(v, c.m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as distance from x, c{i} c
  qualify row_number() over (partition by row order by distance, c.cluster) = 1)"""

    def moved(i: int) -> str:
        return f"""c{i + 1} as materialized (
  select c.cluster, coalesce(n.m, c.m) as m from c{i} c left join (
    select cluster, list(s order by i) as m from (
      select cluster, i, (sum(v[i])::hugeint // count(*) - case when sum(v[i])::hugeint % count(*) < 0 then 1 else 0 end)::bigint as s from a{i}, range(1, {dims + 1}) t(i) group by cluster, i) group by cluster) n
  on c.cluster = n.cluster)"""

    steps = [step(i) for i in range(rounds) for step in (dealt, moved)] + [dealt(rounds)]
    return f"""with x as materialized (
  select row_number() over () as row, vec_id, list_transform(embedding, lambda e: floor({scale} * e::double)::bigint) as v from embeddings
  where embedding is not null and len(embedding) = {dims} and len(list_filter(embedding, lambda e: e is not null and isfinite(e::double))) = {dims}),
c0 as materialized (
  select (row_number() over (order by key, v) - 1)::int as cluster, v as m from (select sha256('{seed}:' || coalesce(vec_id::varchar, '')) as key, v from x order by key, v limit {k})),
{", ".join(steps)}
select vec_id, a.cluster, distance, (sum(distance) over (partition by a.cluster))::bigint as cluster_inertia, (sum(distance) over ())::bigint as inertia,
  sha256(array_to_string(c.m, ',')) as centroid_sha256 from a{rounds} a join c{rounds} c on a.cluster = c.cluster"""


OP11_SQL = _sql()
