"""Near components where ids repeat; mixing beside columns of its own working names."""

import random

from gradeloom.llm import minhash, mixing
from tests.llm.test_operators import WORD, low

A = " ".join(f"a{i}" for i in range(60))
B = " ".join(f"b{i}" for i in range(60))
KIND = "doc_id long, text string, component_id string, set_key string, rep string, label string"


def plain(rows, least=85):
    """(doc_id, size, component) of each row, by merging ids whose rows are linked."""
    sets = []
    for _, t in rows:
        w = WORD.findall(low(t))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = {d: d for d, _ in rows if d is not None}
    for x in range(len(rows)):
        for y in range(x):
            a, b = rows[x][0], rows[y][0]
            n = len(sets[x] & sets[y])
            if a is not None and b is not None and n and 100 * n >= least * len(sets[x] | sets[y]) and root[a] != root[b]:
                small, large = sorted((root[a], root[b]))
                root = {d: small if r == large else r for d, r in root.items()}
    return sorted(((d, len(s), root.get(d)) for (d, _), s in zip(rows, sets, strict=True)), key=str)


def got(spark, rows):
    df = spark.createDataFrame([(d, t, "x", "x", "x", "x") for d, t in rows], KIND).repartition(3)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_components(df).collect()), key=str)


def test_an_id_with_two_texts_joins_their_components(spark):
    rows = [(1, A), (2, B), (5, A + " tail"), (5, B), (9, "alone in the world of texts")]
    assert got(spark, rows) == plain(rows) == [(1, 56, 1), (2, 56, 1), (5, 56, 1), (5, 57, 1), (9, 2, 9)]


def test_repeated_and_missing_ids_against_plain_merging(spark):
    rng = random.Random(9)
    kinds = [[f"k{k}w{i}" for i in range(50)] for k in range(14)]
    rows = []
    for _ in range(90):
        words = list(rng.choice(kinds))
        if rng.random() < 0.5:
            words[rng.randrange(50)] = f"x{rng.randrange(3)}"
        rows.append((rng.choice([None, *range(40)]), rng.choice([" ".join(words), " ".join(words), None, "two words"])))
    assert got(spark, rows) == plain(rows)


def test_columns_named_as_working_ones_stay(spark):
    rows = [(i, f"w{i} " * (i % 7), f"s{i % 3}" if i % 5 else None) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    named = docs
    for c in mixing.WORKING:
        named = named.selectExpr("*", f"doc_id as {c}")
    got = {r.doc_id: r for r in mixing.mix_counts(named).collect()}
    assert {i: (r.copies, r.shards) for i, r in got.items()} == {r.doc_id: (r.copies, r.shards) for r in mixing.mix_counts(docs).collect()}
    assert all(r[c] == i for i, r in got.items() for c in mixing.WORKING)
    assert mixing.mix(named).columns == [*named.columns, "copy", "shard"]
