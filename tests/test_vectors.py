"""The passage index: its recall against exact answers, and vectors from a model double."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.operators import library, vectors
from gradeloom.plans import catalog
from tests.conftest import SF


def frame(spark, points, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in p], "b") for i, p in enumerate(points)], "passage_id long, vector array<float>, cell string")


def unit(points):
    return points / np.linalg.norm(points, axis=1, keepdims=True)


@pytest.mark.parametrize("spread", [0.2, 10.0])
def test_recall_of_clustered_and_of_even_vectors(spark, tmp_path, spread):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(30, 16))
    made = lambda n: unit(middles[rng.integers(0, 30, n)] + spread * rng.normal(size=(n, 16)))
    passages = frame(spark, np.concatenate([made(1500), np.repeat(made(1), 700, axis=0)]))  # a third of all are one vector
    passages = passages.unionByName(spark.createDataFrame([(-1, None, "b")], passages.schema))
    queries = frame(spark, made(120), 10_000).select(F.col("passage_id").alias("query_id"), "vector")
    vectors.build(passages, f"{tmp_path}/index", cells=40)
    settings = spark.read.parquet(f"{tmp_path}/index/settings").first()
    assert settings.passages == spark.read.parquet(f"{tmp_path}/index/vectors").count() == 2200 and settings.cells == 40
    exact = library.nearest(queries, passages.where("vector is not null"))
    assert vectors.recall(vectors.search(spark, f"{tmp_path}/index", queries), exact) >= 0.9
    assert settings.probes <= 8 if spread < 1 else settings.probes < 40
    every = vectors.search(spark, f"{tmp_path}/index", queries, probes=40)
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, exact.collect()))


def test_few_passages_and_none(spark, tmp_path):
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id long, vector array<float>")
    vectors.build(frame(spark, np.array([[0.6, 0.8], [1.0, 0.0], [1.0, 0.0]])), f"{tmp_path}/few")
    assert [(r.query_id, r.passage_id, r.rank) for r in vectors.search(spark, f"{tmp_path}/few", queries, probes=9).orderBy("rank").collect()] == [(1, 1, 1), (1, 2, 2)]
    vectors.build(frame(spark, np.zeros((0, 2))), f"{tmp_path}/none")
    assert vectors.search(spark, f"{tmp_path}/none", queries).count() == 0


def test_query_finds_nine_in_ten(spark):
    found, exact = (catalog.queries()[n](spark, SF) for n in ("passages_probed", "passages_topk"))
    assert vectors.recall(found, exact) >= 0.9
    assert found.join(exact, ["query_id", "passage_id"]).where(found.similarity != exact.similarity).count() == 0


def test_embedding_prefixes_batches_and_scales(spark, tmp_path):
    def model(texts):
        assert len(texts) <= vectors.EMBEDDED and all(t.startswith("passage: ") for t in texts)
        return np.array([[t.count("a"), len(t), 0.0] for t in texts])

    texts = spark.createDataFrame([(i, "a" * (i % 7) + "b" if i % 50 else None, "old") for i in range(300)], "id int, text string, vector string")
    rows = vectors.embed(texts, model).collect()
    for r in rows:
        if r.text is None:
            assert r.vector is None
        else:
            given = "passage: " + r.text
            assert r.vector == pytest.approx(unit(np.array([[given.count("a"), len(given), 0.0]]))[0].tolist(), abs=1e-6)
    assert len(rows) == 300 and vectors.embed(texts.limit(0), model).count() == 0


def test_nearest_by_blocks_is_nearest_by_rows(spark):
    """Ties, copies, odd vectors and several blocks; the rows of a pair of blocks are k a query."""
    draw = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.float32(draw.normal(size=8))]) for i in range(1500)]
    rows += [(2000 + i, rows[i % 3 * 100][1]) for i in range(60)] + [(3000, None), (3001, [1.0]), (3002, [float("nan")] * 8), (3003, [None] * 8), (-5, [0.0] * 8)]
    e = spark.createDataFrame(rows, "passage_id long, vector array<float>")
    q = e.where("passage_id % 100 = 0").withColumnRenamed("passage_id", "query_id")
    show = lambda df: sorted(map(str, df.collect()))
    assert show(library.nearest(q, e, 3)) == show(library.best(library._nearest_by_rows(q, e), 3))
    own, others = np.zeros((1, 2)), np.ones((5, 2))
    assert library._block_best(own, others, np.arange(5)[::-1], 2)[1].tolist() == [4, 3]


def test_a_search_holds_few_rows_at_once(spark, tmp_path, monkeypatch):
    """Queries meet their cells some at a time, with the same result."""
    draw = np.random.default_rng(6)
    rows = [(i, [float(x) for x in np.float32(draw.normal(size=8))]) for i in range(300)]
    e = spark.createDataFrame(rows, "passage_id long, vector array<float>")
    folder, q = str(tmp_path / "index"), e.withColumnRenamed("passage_id", "query_id")
    vectors.build(e, folder, cells=12)
    want = sorted(map(str, vectors.search(spark, folder, q, probes=5).collect()))
    monkeypatch.setattr(vectors, "PROBED_ROWS", 16)
    assert sorted(map(str, vectors.search(spark, folder, q, probes=5).collect())) == want and len(want) == 600
