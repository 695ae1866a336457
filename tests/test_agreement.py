"""Kappa on the labels that occur, and resampled intervals, against plain numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.operators import agreement as ag
from gradeloom.operators import validation
from gradeloom.plans import catalog
from tests.conftest import SF


def kappa(a, b, labels=None):
    """Cohen's, from the matrix of the two raters' labels and squared distances of their places."""
    labels = sorted({*a, *b}) if labels is None else labels
    if len(labels) < 2:
        return 1.0
    seen = np.zeros((len(labels),) * 2)
    for x, y in zip(a, b, strict=True):
        seen[labels.index(x), labels.index(y)] += 1
    far = np.subtract.outer(np.arange(len(labels)), np.arange(len(labels))) ** 2
    by_chance = np.outer(seen.sum(axis=1), seen.sum(axis=0)) / seen.sum()
    return 1 - (far * seen).sum() / (far * by_chance).sum() if (far * by_chance).sum() else float("nan")


def test_labels_count_by_their_place_among_those_that_occur(spark):
    rng = random.Random(2)
    groups = {"gaps": ([0, 1, 3, 3, 1, 0, 3, 0], [0, 1, 3, 1, 1, 3, 3, 0]), "one": ([2, 2], [2, 2]), "far": ([0, 90, 5, 0], [5, 90, 0, 0])}
    groups |= {f"r{i}": tuple([rng.choice([0, 1, 3, 7, 8]) for _ in range(30)] for _ in "ab") for i in range(20)}
    rows = [(g, i, x, y) for g, (a, b) in groups.items() for i, (x, y) in enumerate(zip(a, b, strict=True))]
    got = {r.g: (r.n, r.qwk) for r in ag.observed_qwk(spark.createDataFrame(rows, "g string, i int, a int, b int"), ["g"]).collect()}
    assert got == {g: (len(a), pytest.approx(kappa(a, b), abs=1e-12)) for g, (a, b) in groups.items()}
    assert round(kappa(*groups["gaps"]), 3) != round(kappa(*groups["gaps"], labels=[0, 1, 2, 3]), 3)


def test_study_and_retest_use_them(spark):
    a, b = [0, 1, 3, 3, 1, 0, 3, 0], [0, 1, 3, 1, 1, 3, 3, 0]
    votes = spark.createDataFrame([("p", i, j, str(v)) for j, own in (("1", a), ("2", b)) for i, v in enumerate(own)], "project string, item_id int, judge string, level string")
    assert validation.panel_agreement(votes).first().qwk == pytest.approx(kappa(a, b))
    runs = votes.select(F.col("judge").alias("run"), "project", "item_id", F.col("level").cast("int").alias("score"))
    row = ag.retest(runs).first()
    assert (row.qwk, row.identical_pct, row.n) == (pytest.approx(kappa(a, b)), 75.0, 8)


def plain_weights(names, replicates, seed):
    for rep in range(replicates):
        draw = np.random.Generator(np.random.Philox(key=np.array([seed, rep], dtype=np.uint64)))
        yield dict(enumerate(np.bincount(draw.integers(0, len(names), len(names)), minlength=len(names))))


def test_resampled_weights_do_not_depend_on_partitions(spark):
    names = sorted({f"p{i * 37 % 101}" for i in range(90)})
    df = spark.createDataFrame([(n,) for n in names * 2] + [(None,)], "project string")
    want = {(rep, names[k]): int(w) for rep, own in enumerate(plain_weights(names, 25, 7)) for k, w in own.items() if w}
    for rows in (df.repartition(1), df.repartition(7)):
        assert {(r.rep, r.project): r.w for r in ag.resampled(rows, 25, 7).collect()} == want
    assert ag.resampled(df.limit(0), 5).count() == 0
    places, n = ag.numbered(df, "project")
    assert n == len(names) and {r.project: r.k for r in places.collect()} == {p: k for k, p in enumerate(names)}


def test_seeded_interval_against_numpy(spark):
    pairs = catalog._pairs(spark, SF).join(catalog.table(spark, SF, "documents").select("doc_id", F.coalesce("source", F.lit("<null>")).alias("source")), "doc_id")
    rows = pairs.where("rater_a = 1 and rater_b = 2").select("source", "a", "b").collect()
    names = sorted({r.source for r in rows})
    sums = np.array([[sum(f(r.a, r.b) for r in rows if r.source == n) for f in (lambda a, b: 1, lambda a, b: a, lambda a, b: b, lambda a, b: a * a, lambda a, b: b * b, lambda a, b: a * b)] for n in names], dtype=float)
    values = []
    for own in plain_weights(names, 2000, 42):
        n, a, b, aa, bb, ab = np.array(list(own.values())) @ sums
        values.append(1 - (aa + bb - 2 * ab) / (aa + bb - 2 * a * b / n))
    row = catalog.queries()["bootstrap_seeded"](spark, SF).where("rater_a = 1 and rater_b = 2").first()
    assert (row.low, row.high, row.replicates) == (pytest.approx(np.percentile(values, 2.5)), pytest.approx(np.percentile(values, 97.5)), 2000)


def test_sums_by_blocks_are_those_of_the_weights(spark, monkeypatch):
    """Over several blocks, with and without groups, and without a row for each replicate and project."""
    monkeypatch.setattr(ag, "BLOCK", 16)
    rows = [(g, f"p{i:03}", float(i % 7), float(i * i % 5)) for g in (1, 2) for i in range(90) if (i + g) % 4]
    values = spark.createDataFrame(rows, "g int, project string, x double, y double")
    drawn = ag.Resamples(values, 20, 7)
    weights = drawn.weights()
    for rows, by in ((values, ["g"]), (values.where("g = 1"), [])):
        got, want = ({tuple(r) for r in ag.weighted_sums(rows, w, by, ["x", "y"]).select(*by, "rep", "x", "y").collect()} for w in (drawn, weights))
        assert got == want and len(got) == 20 * (2 if by else 1)
    assert drawn.drawn.count() == 20 * 6
