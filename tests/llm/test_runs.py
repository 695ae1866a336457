"""Periodic runs against the definition, read word by word."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.llm import runs
from tests.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words, least_length=6, least_exponent=4):
    found = {}
    n = len(words)
    for p in range(1, n // least_exponent + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(least_length, least_exponent * p):
                found.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted((s, n, p) for (s, n), p in found.items())


def collapse(words, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n or doc_id is None:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def texts_of(rng):
    out = ["", None, " \n\t ", "a", "a a a a a", "a a a a a a", "A a A a A a A a", "é é é é é é", "a b " * 4, "x " + "a b c " * 5 + "a y", "ab " * 40_000]
    for _ in range(300):
        letters = "ab" if rng.random() < 0.5 else "abcdefgh"
        words = [rng.choice(letters) for _ in range(rng.randrange(60))]
        if rng.random() < 0.6:
            words += [rng.choice(letters) for _ in range(rng.randrange(1, 9))] * rng.randrange(2, 7) + words[: rng.randrange(9)]
        out.append("".join(w + rng.choice([" ", "\n", " \t"]) for w in words))
    return out


def test_suffix_array_and_common_lengths():
    rng = np.random.default_rng(3)
    for n, letters in ((1, 2), (2, 1), (40, 1), (200, 2), (500, 3)):
        ids = np.append(rng.integers(0, letters, n), letters)
        order, common = runs.suffix_array(ids)
        suffixes = sorted((list(ids[i:]), i) for i in range(len(ids)))
        assert list(order) == [i for _, i in suffixes]
        for (a, _), (b, _), c in zip(suffixes, suffixes[1:], common[1:], strict=False):
            assert c == next(k for k in range(len(a)) if a[k] != b[k])


def test_least_of_stretches():
    rng = np.random.default_rng(5)
    values = rng.integers(0, 1000, 777).astype(np.int32)
    lo = rng.integers(0, 777, 4000)
    hi = np.minimum(lo + rng.integers(0, 400, 4000) * (rng.random(4000) < 0.7), 776)
    assert (runs.RangeMin(values)(lo, hi) == [values[a : b + 1].min() for a, b in zip(lo, hi, strict=True)]).all()


@pytest.mark.parametrize("least", [(6, 4), (2, 2), (4, 3)])
def test_runs_and_collapsed_texts(spark, least):
    texts = texts_of(random.Random(11))
    rows = [(i % 50 if i % 9 else None, t, "old", "old", "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, collapsed string, _h string").repartition(3)
    got = runs.periodic_runs(docs, least_length=least[0], least_exponent=least[1])
    assert got.columns == ["doc_id", "text", "_h", "runs", "collapsed"] and got.count() == len(texts)
    for r in got.collect():
        words = WORD.findall(r.text or "") if len(r.text or "") < 10_000 else None
        if words is None:
            assert [tuple(x) for x in r.runs] == [(0, 40_000, 1)] and r.collapsed == "ab"
        else:
            expected = brute_runs(words, *least)
            assert [tuple(x) for x in r.runs] == expected and r.collapsed == collapse(words, expected)


def test_no_rows_and_small_windows(spark, monkeypatch):
    assert runs.periodic_runs(spark.createDataFrame([], "text string")).count() == 0
    ids = np.array([0, 1] * 9 + [2, 3] * 5 + [1])
    whole = runs.find_runs(ids, np.array([18, 11]))
    monkeypatch.setattr(runs, "ANCHORS", 3)
    assert [list(a) for a in whole] == [list(a) for a in runs.find_runs(ids, np.array([18, 11]))] == [[0, 1], [0, 0], [18, 10], [2, 2]]


def test_planted_texts(spark):
    texts = texts_of(random.Random(5))[:120]
    docs = spark.createDataFrame([(i if i != 7 else None, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, lang string, size string")
    got = runs.plant_periods(docs)
    assert got.columns == docs.columns
    for r in got.collect():
        words = WORD.findall(texts[7 if r.doc_id is None else r.doc_id] or "")
        assert WORD.findall(r.text or "") == (planted(r.doc_id, words) if r.doc_id is not None else words)


def test_query_against_brute_force(spark):
    got = {r.doc_id: r for r in runs.op12_periodic_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert len(got) == len(docs)
    for d in docs:
        words = planted(d.doc_id, WORD.findall(d.text or ""))
        ids = {}
        found = brute_runs([ids.setdefault(w, len(ids)) for w in words])
        top = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        r = got[d.doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *(top or (None,) * 3))
        assert r.exponent_milli == (1000 * top[1] // top[2] if top else None)
        assert r.runs_sha256 == sha("".join(f"{s},{n},{p}\n" for s, n, p in found)) and r.collapsed_sha256 == sha(collapse(words, found))
    assert sum(r.n_runs > 0 for r in got.values()) > 5


def test_strongest_of_equals_is_the_first(spark):
    df = spark.sql("select array(named_struct('start', 1L, 'length', 8L, 'period', 2L), named_struct('start', 3L, 'length', 12L, 'period', 3L), named_struct('start', 9L, 'length', 9L, 'period', 2L)) as runs")
    assert df.select(runs.strongest(F.col("runs")).alias("r")).head().r.start == 9
    assert df.select(runs.strongest(F.slice("runs", 1, 2)).alias("r")).head().r.start == 1
