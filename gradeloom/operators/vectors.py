"""Passages made findable: texts to vectors by a model the caller gives, and an index of cells to look them up in.

An index is a folder: ``centroids`` (cell, vector), fitted on a bounded sample, ``vectors``, all passages by
the cell of their nearest centroid, and ``settings``. A search probes the cells nearest to a query, scores all their
passages exactly and keeps the best; it reads no other cell. How many cells it takes is measured when the index is
built: some passages are looked up exactly, and as many cells are probed as held the wanted share of their neighbours.
Vectors that lie in clusters need few; vectors without any need a large part of the cells. ``recall`` measures a search.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.operators import library
from gradeloom.session import small

#: Vectors that centroids are fitted on, and cells, at most; passages of a cell that are written by one task, about.
SAMPLE, MOST_CELLS, CELL_ROWS = 20_000, 1024, 1_000_000
#: Passages that are looked up exactly, how many neighbours of each, and the share of these that a search shall find.
LOOKED_UP, NEIGHBOURS, WANTED = 256, 2, 0.95
#: Rows of queries and cells that a task of a search holds at once, or one query's.
PROBED_ROWS = 16_384
#: What the model wants before a passage, and how many texts it is given at once.
PASSAGE_PREFIX, EMBEDDED = "passage: ", 128


def embed(texts: DataFrame, model: Callable[[list[str]], np.ndarray], column: str = "text", prefix: str = PASSAGE_PREFIX) -> DataFrame:
    """All rows plus vector (array<float>), of length one: ``model`` of batches of prefixed texts; null without a text.

    ``model`` goes to the tasks, so it should load what it needs when it is first called there.
    """
    texts = texts.drop("vector")
    schema = T.StructType([*texts.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            known = part[column].notna().to_numpy()
            given = [prefix + t for t in part.loc[known, column]]
            made = [_unit(np.asarray(model(given[i : i + EMBEDDED]), dtype=np.float64)) for i in range(0, len(given), EMBEDDED)]
            rows = iter(v.astype(np.float32) for block in made for v in block)
            yield part.assign(vector=pd.Series([next(rows) if k else None for k in known], index=part.index, dtype=object))

    return texts.mapInPandas(run, schema)


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size > 0, size, 1)


def _matrix(vectors) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.float32) for v in vectors])


def fit_cells(passages: DataFrame, cells: int | None = None, sample: int = SAMPLE, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Centroids of directions, by k-means over the ``sample`` passages (passage_id, vector) of the least hashes.

    ``cells``: the root of the number of passages unless given, at most MOST_CELLS and the distinct vectors sampled.
    Null vectors do not count. The sample and the centroids are all that reaches the driver.
    """
    known = passages.where("vector is not null")
    n = known.count()
    rows = _least(known.select("passage_id", "vector"), sample, seed, n).toPandas()
    if not len(rows):
        return np.zeros((0, 0), dtype=np.float32)
    points = _unit(_matrix(rows["vector"]))
    distinct = np.unique(points, axis=0)
    count = max(1, min(cells or isqrt(n), MOST_CELLS, len(distinct)))
    centroids = distinct[np.random.default_rng(seed).choice(len(distinct), count, replace=False)]
    for _ in range(rounds):
        own = (points @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, points)
        full = np.bincount(own, minlength=count) > 0
        centroids[full] = _unit(sums[full])
    return centroids


def _least(rows: DataFrame, most: int, seed: int, n: int) -> DataFrame:
    """The ``most`` of n rows with the least hashes of their passage_id, which are even: a slightly larger share is sorted."""
    hashed = rows.withColumn("_h", F.xxhash64("passage_id", F.lit(seed)))
    if n > most:
        hashed = hashed.where(F.shiftrightunsigned("_h", 11) < int((1 << 53) * min(1.0, 1.5 * most / n)))
    return hashed.orderBy("_h").limit(most).drop("_h")


def _probes(vectors: DataFrame, centroids: np.ndarray, wanted: float, seed: int, n: int) -> int:
    """How many cells held ``wanted`` of the neighbours, other than itself, of LOOKED_UP passages."""
    asked = _least(vectors.select("passage_id", "vector"), LOOKED_UP, seed, n).withColumnRenamed("passage_id", "query_id")
    found = library.nearest(asked, vectors, NEIGHBOURS + 1).where("query_id <> passage_id")
    cells = found.join(vectors.select("passage_id", "cell"), "passage_id").select("query_id", "cell").toPandas()
    own = asked.toPandas().drop_duplicates("query_id").set_index("query_id")["vector"]
    if not len(cells):
        return len(centroids)
    score = _matrix(own.loc[cells["query_id"]]) @ centroids.T
    before = (score > score[np.arange(len(cells)), cells["cell"]][:, None]).sum(axis=1)
    return int(np.quantile(before, wanted, method="higher")) + 1


def build(passages: DataFrame, folder: str, cells: int | None = None, wanted: float = WANTED, seed: int = 7, **fit) -> None:
    """Write an index of all passages (passage_id, vector; other columns go along) that have a vector.

    A large cell is written in several files. ``wanted``: the share of neighbours that a search shall find.
    """
    spark, passages = passages.sparkSession, passages.drop("cell")
    centroids = fit_cells(passages, cells, seed=seed, **fit)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(centroids)]
    spark.createDataFrame(rows, "cell int, vector array<float>").coalesce(1).write.parquet(f"{folder}/centroids")
    schema = T.StructType([*passages.schema.fields, T.StructField("cell", T.IntegerType())])
    at = passages.columns.index("vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell = (_matrix(b.column(at).to_pylist()) @ centroids.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32))], names=schema.names)

    known = passages.where("vector is not null")
    placed = known.mapInArrow(run, schema)
    n = known.count()
    spread = 1 + n // max(1, CELL_ROWS * max(1, len(centroids)))
    split = placed.repartition("cell", F.pmod(F.xxhash64("passage_id"), F.lit(4 * spread)))
    split.write.partitionBy("cell").parquet(f"{folder}/vectors")
    probes = _probes(spark.read.schema(schema).parquet(f"{folder}/vectors"), centroids, wanted, seed + 1, n) if n else 0
    spark.createDataFrame([(len(centroids), probes, n)], "cells int, probes int, passages long").coalesce(1).write.parquet(f"{folder}/settings")


def search(spark: SparkSession, folder: str, queries: DataFrame, k: int = NEIGHBOURS, probes: int | None = None) -> DataFrame:
    """(query_id, passage_id, similarity, rank): the k best passages of each query (query_id, vector) among the ``probes`` cells nearest to it.

    Unless given, ``probes`` is what the index was measured to need. Queries without a vector find nothing.
    """
    rows = spark.read.parquet(f"{folder}/centroids").orderBy("cell").toPandas()
    centroids, probes = _matrix(rows["vector"]), probes or spark.read.parquet(f"{folder}/settings").first().probes

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A query has a row for each cell that it probes, with its vector.
        most = max(1, PROBED_ROWS // max(1, min(probes, len(centroids))))
        for whole in parts:
            for at in range(0, len(whole), most):
                part = whole.iloc[at : at + most].reset_index(drop=True)
                score = _matrix(part["_q"]) @ centroids.T
                near = np.argsort(-score, axis=1, kind="stable")[:, :probes]
                each = part.loc[part.index.repeat(near.shape[1])].reset_index(drop=True)
                yield each.assign(cell=near.ravel().astype(np.int32))

    own = queries.where("vector is not null").select("query_id", F.col("vector").alias("_q"))
    probed = own.mapInPandas(run, T.StructType([*own.schema.fields, T.StructField("cell", T.IntegerType())]))
    if not len(centroids):  # an index of nothing has no files to read
        return library.best(own.where("false").select("query_id", F.lit(0).cast("long").alias("passage_id"), F.lit(0.0).alias("similarity")), k)
    vectors = spark.read.parquet(f"{folder}/vectors").select("passage_id", "vector", "cell")
    scored = vectors.join(small(probed), "cell").select("query_id", "passage_id", library.cosine(F.col("_q"), F.col("vector")).alias("similarity"))
    return library.best(scored, k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact answer's (query_id, passage_id) that was found; 1 if there are none."""
    n = exact.count()
    return exact.join(found.select("query_id", "passage_id"), ["query_id", "passage_id"], "left_semi").count() / n if n else 1.0
