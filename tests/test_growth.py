"""What steps move and how they are dealt, which grows with the input."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from gradeloom.llm import fingerprints, pieces
from gradeloom.operators import redact, segment


def moved(df):
    """Bytes that the exchanges of a query that has run put out."""

    def walk(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(plan.plan())
        own = plan.metrics().get("dataSize").get().value() if kind == "ShuffleExchangeExec" else 0
        children = plan.children()
        return own + sum(walk(children.apply(i)) for i in range(children.size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_only_pages_that_tell_of_people_are_moved_to_find_names(spark):
    draw = random.Random(3)
    plain = [(d, 1, "\n".join(f"línea {draw.random()}" for _ in range(400))) for d in range(100)]
    told = [(1000, 1, "portada\x1c  \tAUTOR:\nLuis Soto Vega\nfin"), (1001, 1, "x\r\nco-asesora: Dra. Eva Díaz León")]
    found = redact.names(spark.createDataFrame(plain + told, "doc_id int, page_no int, text string"))
    assert {tuple(r) for r in found.collect()} == {(1000, "author", "Luis Soto Vega", 1), (1001, "adviser", "Eva Díaz León", 1)}
    assert 0 < moved(found) < sum(len(t) for *_, t in plain) / 10


def test_segmenting_writes_lines_only_of_documents_with_a_candidate(spark, monkeypatch):
    draw = random.Random(4)
    plain = [(d, 1, "\n".join(f"una línea larga de relleno {draw.random()} " * 3 for _ in range(30))) for d in range(20)]
    thesis = [(100, 2, "II. PROBLEMA\n" + "palabra " * 40), (100, 1, "portada\nTítulo\nUn título")]
    written = {}
    keep = segment.materialise
    monkeypatch.setattr(segment, "materialise", lambda df, name: written.setdefault(name, keep(df, name)))
    aliases = spark.createDataFrame([("S01", 1, "titulo"), ("S02", 2, "problema")], "section_id string, pos int, alias string")
    sections = spark.createDataFrame([("S01", "Título", 1), ("S02", "Problema", 2)], "section_id string, name string, pos int")
    out = segment.segment(spark.createDataFrame(plain + thesis, "doc_id int, page_no int, text string"), aliases, sections)
    assert {(r.section_id, r.line_idx, r.words) for r in out.where("present").collect()} == {("S01", 1, 2), ("S02", 3, 40)}
    assert out.count() == 42
    assert [r.line_idx for r in written["lines"].orderBy("line_idx").collect()] == [0, 1, 2, 3, 4]


def test_likeness_looks_samples_up_in_bytes(spark):
    """In a text every sample was found by walking through those before it, the square of their number."""
    own = "".join(f"{i * 7919 % (1 << 24):06x}" for i in range(fingerprints.SAMPLES))
    moved = own[1:] + own[0]
    cases = [(own, own, 1.0), (own, "ffffff" + own[6:-6] + "eeeeee", 126 / 128), (own, moved, 1 / 128), ("", "", 1.0), (own, "", 0.0)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string").select("i", F.unhex("a").alias("a"), F.unhex("b").alias("b"))
    assert [r.x for r in rows.select("i", fingerprints.likeness(F.col("a"), F.col("b")).alias("x")).orderBy("i").collect()] == [x for *_, x in cases]


def test_fingerprints_move_texts_once_and_nothing_after_them(spark):
    """Fingerprints were moved twice, to the rows of their texts and to those of the next ones."""
    docs = spark.createDataFrame([(i, f"text {i} of some words") for i in range(40)], "doc_id long, text string")
    found = fingerprints.compare_with_next(docs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    moved = {x for x in re.findall(r"Exchange (\w+\(.*?\)), \w+", plan) if x.startswith("hashpartitioning")}
    assert len(found.collect()) == 40 and {re.sub(r"#\w+", "", x) for x in moved} == {"hashpartitioning(bucket, 4)"}


def test_samples_without_a_near_key_are_worked_out_from_all_terms(spark, monkeypatch):
    """With a reach that most least keys are beyond, the same fingerprints; texts were left without one."""
    texts = ["a b c d e f g h " * 3, "one", "", None, "é 漢 é 漢 é x", "z " * 300 + "to be or not to be"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(fingerprints.compare_with_next(docs).collect())
    monkeypatch.setattr(fingerprints, "NEAR", 0.5)
    assert sorted(fingerprints.compare_with_next(docs).collect()) == want
    exact = docs.select("doc_id", fingerprints.exact_print(F.col("text")).alias("p")).collect()
    assert {r.doc_id: r.p for r in exact} == {r.doc_id: r.fingerprint for r in want}


@pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no tokenizer files here")
def test_texts_move_compressed_to_the_ids_of_their_parts(spark, tmp_path):
    """Whole texts were moved as they are; now as compressed batches, also where one holds rows of two chunks."""
    draw = random.Random(5)
    words = [f"{draw.choice(['the', 'and', 'of', 'under'])}{draw.choice(['', 'er', 'ing', 's'])}" for _ in range(200)]
    texts = [" ".join(draw.choices(words, k=100)) if i % 50 else None for i in range(5000)]
    rows = spark.createDataFrame([(i, t, t and t[:3]) for i, t in enumerate(texts)], "doc_id long, text string, _chunk string").coalesce(1)
    rows.write.parquet(f"{tmp_path}/rows")
    found = pieces.encode(spark.read.parquet(f"{tmp_path}/rows"), pieces.load(), and_decode=True)
    got = {r.doc_id: (r.text, r["_chunk"], r.decoded) for r in found.collect()}
    assert got == {i: (t, t and t[:3], t or "") for i, t in enumerate(texts)}
    assert moved(found) < sum(len(t or "") for t in texts) / 2
