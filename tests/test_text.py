"""Folding of accents against full decomposition."""

import unicodedata

from pyspark.sql import functions as F

from gradeloom.functions import text as tx


def test_folding_is_decomposition_without_marks_on_all_latin_letters(spark):
    letters = [chr(c) for c in [*range(0x41, 0x250), *range(0x1E00, 0x1F00)] if chr(c).isalpha()]
    given = [*letters, *(f"x{a}{m}y" for a in "aeñU" for m in "̧́̃̈"), " Título DEL Año ", "", None]
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFD", t.lower()) if not unicodedata.combining(c)).strip()
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string").select("i", "t", tx.fold_accents(F.col("t")).alias("f")).collect()
    assert [(r.t, r.f) for r in rows if r.t is not None and r.f != plain(r.t)] == []
    assert [r.f for r in rows if r.t is None] == [None]
