"""Exact deduplication by two passes over Bloom bitmaps.

Pass one sets a bit for every hash slot that two or more rows hit. Pass two looks
each row up: a row whose slots are not all set is surely single and passes straight
through; only the others are written once, with a number of their own, and shuffle; they
are compared by their full digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm import bloom
from gradeloom.llm.common import lower_ascii, materialise


def exact_dedup(docs: DataFrame, *, bits_per_row: int = 16, functions: int = 2, max_bits: int = 1 << 31) -> DataFrame:
    """Mark exact copies: equal after lower-casing A-Z, null counting as empty.

    Returns all rows and columns of ``docs`` plus text_sha256 (of the normalised text),
    keep_id, group_size and kept. Of equal texts the row with the largest doc_id stays
    (null ids rank lowest); of rows with that same id, exactly one. Empty and null texts
    form one group like any other. Columns of ``docs`` with these names are replaced.

    Broadcast: the bitmaps, at most ``max_bits`` bits in all whatever the input. Beyond
    max_bits / bits_per_row rows more single rows shuffle; the result is the same.
    """
    added = ("text_sha256", "keep_id", "group_size", "kept")
    docs = docs.drop(*added)
    hashed = docs.withColumn("text_sha256", F.sha2(lower_ascii(F.col("text")), 256))
    slots = bloom.slots_for(docs.count(), bits_per_row=bits_per_row, functions=functions, max_bits=max_bits)
    filters = bloom.bitmaps(hashed, "text_sha256", slots, functions, repeated=True)
    marked = bloom.flag(hashed, F.col("text_sha256"), filters, slots, functions, "_maybe")
    single = marked.where("not _maybe").select(
        *hashed.columns, F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")
    )
    several = materialise(marked.where("_maybe").drop("_maybe").withColumn("_row", F.monotonically_increasing_id()), "several")
    groups = several.groupBy("text_sha256").agg(F.max(F.struct("doc_id", "_row")).alias("_top"), F.count("*").alias("group_size"))
    groups = materialise(groups, "groups").withColumnRenamed("text_sha256", "_sha")
    joined = several.join(groups, F.col("text_sha256") == F.col("_sha")).select(
        *hashed.columns, F.col("_top.doc_id").alias("keep_id"), "group_size", (F.col("_row") == F.col("_top._row")).alias("kept")
    )
    return single.unionByName(joined)


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP8_SQL = """
with n as (
  select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256
  from documents)
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
       doc_id = max(doc_id) over g as kept, text_sha256
from n window g as (partition by text_sha256)
"""
