"""Input tables of the catalogue: the driver's tables and a vote table drawn from them by arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three judges on eight items in two sections of every document; some votes are missing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source")
    rows = docs.select("*", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("item")).select("*", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("judge"))
    score = F.expr("greatest(0, (doc_id * 31 + item * 17 + n_chars) % 4 - case when (doc_id + item + judge) % 5 = 0 then 1 else 0 end)")
    gap = F.expr("(doc_id + 3 * judge + item) % 29 = 0")
    return rows.select(
        "doc_id", F.col("doc_id").alias("eval_id"), "source", "judge", "item", F.concat(F.lit("S0"), F.expr("cast(1 + (item - 1) div 4 as string)")).alias("section_id"),
        F.concat(F.lit("i"), F.col("item").cast("string")).alias("item_id"), F.when(~gap, score).cast("int").alias("score"),
    )


VOTES_SQL = """votes as (
  select doc_id, source, judge, item, 'S0' || cast(1 + (item - 1) // 4 as varchar) as section_id, 'i' || cast(item as varchar) as item_id,
    case when (doc_id + 3 * judge + item) % 29 = 0 then null
      else cast(greatest(0, (doc_id * 31 + item * 17 + n_chars) % 4 - case when (doc_id + item + judge) % 5 = 0 then 1 else 0 end) as int) end as score
  from documents, range(1, 9) i(item), range(1, 4) j(judge))"""

PAIRS_SQL = VOTES_SQL + """,
pairs as (select a.doc_id, a.item, a.judge as ja, b.judge as jb, a.score as a, b.score as b
  from votes a join votes b on a.doc_id = b.doc_id and a.item = b.item and a.judge < b.judge where a.score is not null and b.score is not null)"""

WEIGHTS = {1: (2.0, 1.0), 2: (1.5, None), 3: (1.0, 0.5), 4: (0.5, None), 5: (2.0, 0.75), 6: (1.0, None), 7: (1.0, 0.25), 8: (1.0, None)}
"""Weight and partial value of the eight items."""

BANDS = ((75.0, "Excelente"), (50.0, "Bueno"), (25.0, "Regular"), (0.0, "Insuficiente"))


def items(spark: SparkSession) -> DataFrame:
    rows = [("r", f"S0{1 + (i - 1) // 4}", f"i{i}", i, w, p) for i, (w, p) in WEIGHTS.items()]
    return spark.createDataFrame(rows, "rubric_id string, section_id string, item_id string, pos int, weight double, partial double")


ITEMS_SQL = "items(item, weight, partial) as (values " + ", ".join(f"({i}, {w}, {'null' if p is None else p})" for i, (w, p) in WEIGHTS.items()) + ")"


def bands(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("r", i, m, n) for i, (m, n) in enumerate(BANDS)], "rubric_id string, pos int, min double, label string")


BANDS_SQL = "bands(min, label) as (values " + ", ".join(f"({m}, '{n}')" for m, n in BANDS) + ")"
