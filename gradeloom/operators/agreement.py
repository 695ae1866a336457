"""Agreement between raters, from sums that Spark can add up in parts."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.session import materialise


def qwk_from_sums(n: Column, a: Column, b: Column, aa: Column, bb: Column, ab: Column, fixed_labels: bool = False) -> Column:
    """Quadratic weighted kappa from n, sums, sums of squares and of products.

    Where all labels are one it is 1, or null if the labels are a fixed scale.
    """
    kappa = 1 - F.try_divide(aa + bb - 2 * ab, aa + bb - F.try_divide(2 * a * b, n))
    return kappa if fixed_labels else F.coalesce(kappa, F.lit(1.0))


def qwk(a: Column, b: Column, fixed_labels: bool = False) -> Column:
    """Aggregate: quadratic weighted kappa of two columns of contiguous labels."""
    a, b = a.cast("double"), b.cast("double")
    return qwk_from_sums(F.count("*").cast("double"), F.sum(a), F.sum(b), F.sum(a * a), F.sum(b * b), F.sum(a * b), fixed_labels)


def exact(a: Column, b: Column) -> Column:
    return F.coalesce(F.avg((a == b).cast("double")), F.lit(0.0))


def adjacent(a: Column, b: Column, within: int = 1) -> Column:
    return F.coalesce(F.avg((F.abs(a - b) <= within).cast("double")), F.lit(0.0))


def mean_error(a: Column, b: Column) -> Column:
    return F.coalesce(F.avg(F.abs(a - b).cast("double")), F.lit(0.0))


def pearson(a: Column, b: Column) -> Column:
    """Aggregate: correlation; null below three pairs or without variance."""
    a, b, n = a.cast("double"), b.cast("double"), F.count("*").cast("double")
    top = n * F.sum(a * b) - F.sum(a) * F.sum(b)
    va, vb = n * F.sum(a * a) - F.sum(a) * F.sum(a), n * F.sum(b * b) - F.sum(b) * F.sum(b)
    return F.when((n >= 3) & (va > 0) & (vb > 0), F.try_divide(top, F.sqrt(F.greatest(va * vb, F.lit(0.0)))))


def average_rank(value: str, keys: list[str]) -> Column:
    """Rank with ties averaged, within keys."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2.0


def rater_pairs(scores: DataFrame, on: list[str], rater: str = "rater", value: str = "score") -> DataFrame:
    """All pairs rater_a < rater_b on what both rated: an equi-join, as many rows as raters allow."""
    a = scores.select(*on, F.col(rater).alias("rater_a"), F.col(value).alias("a"))
    b = scores.select(*on, F.col(rater).alias("rater_b"), F.col(value).alias("b"))
    return a.join(b, on).where("rater_a < rater_b and a is not null and b is not null")


def agreement_table(pairs: DataFrame, by: list[str]) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return pairs.groupBy(*by).agg(
        F.count("*").alias("n"), qwk(a, b).alias("qwk"), exact(a, b).alias("exact"), adjacent(a, b).alias("adjacent"), mean_error(a, b).alias("mae"), pearson(a, b).alias("pearson")
    )


def dense_labels(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Replace a and b by the places of their values among all values of both raters of a pair."""
    values = pairs.select(*by, F.explode(F.array("a", "b")).alias("v")).distinct()
    placed = values.withColumn("_p", F.dense_rank().over(Window.partitionBy(*by).orderBy("v")))
    for side in ("a", "b"):
        pairs = pairs.join(placed.select(*by, F.col("v").alias(side), F.col("_p").alias(f"_{side}")), [*by, side])
    return pairs.drop("a", "b").withColumnsRenamed({"_a": "a", "_b": "b"})


def observed_qwk(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, qwk): kappa of each group of pairs on the labels that occur in it, each counting as its place among them.

    Pairs are counted by their two labels first, so as many rows as there are combinations move.
    """
    cells = pairs.groupBy(*by, "a", "b").agg(F.count("*").cast("double").alias("w"))
    labels = cells.select(*by, F.explode(F.array("a", "b")).alias("v")).distinct()
    labels = labels.withColumn("p", F.dense_rank().over(Window.partitionBy(*by).orderBy("v")).cast("double"))
    for side in ("a", "b"):
        cells = cells.join(labels.select(*by, F.col("v").alias(side), F.col("p").alias(f"_{side}")), [*by, side])
    w, a, b = F.col("w"), F.col("_a"), F.col("_b")
    kappa = qwk_from_sums(F.sum(w), F.sum(w * a), F.sum(w * b), F.sum(w * a * a), F.sum(w * b * b), F.sum(w * a * b))
    return cells.groupBy(*by).agg(F.sum(w).cast("long").alias("n"), kappa.alias("qwk"))


def spearman(pairs: DataFrame, by: list[str]) -> DataFrame:
    ranked = pairs.withColumns({"_ra": average_rank("a", by), "_rb": average_rank("b", by)})
    return ranked.groupBy(*by).agg(pearson(F.col("_ra"), F.col("_rb")).alias("spearman"))


def interpret_kappa(value: Column) -> Column:
    """Landis and Koch's words."""
    return (
        F.when(value.isNull() | F.isnan(value), "no calculable").when(value < 0, "pobre (peor que el azar)").when(value <= 0.20, "leve").when(value <= 0.40, "aceptable")
        .when(value <= 0.60, "moderado").when(value <= 0.80, "sustancial").otherwise("casi perfecto")
    )


def complete_targets(scores: DataFrame, target: str, rater: str = "rater", keys: list[str] | None = None) -> DataFrame:
    """Rows of the targets that all raters of their key have rated."""
    keys = keys or []
    raters = scores.groupBy(*keys).agg(F.count_distinct(rater).alias("_k"))
    per = scores.groupBy(*keys, target).agg(F.count_distinct(rater).alias("_r"))
    full = per.join(raters, keys) if keys else per.crossJoin(raters)
    return scores.join(full.where("_r = _k").select(*keys, target), [*keys, target])


def icc21(scores: DataFrame, target: str, keys: list[str] | None = None, rater: str = "rater", value: str = "score") -> DataFrame:
    """ICC(2,1): two-way random, absolute agreement, single rater, over complete targets.

    Null below three targets or two raters. Sums by target and by rater are all it needs.
    """
    keys = keys or []
    x = F.col(value).cast("double")
    rows = complete_targets(scores, target, rater, keys)
    whole = rows.groupBy(*keys).agg(F.count_distinct(target).cast("double").alias("n"), F.count_distinct(rater).cast("double").alias("k"), F.sum(x).alias("s"), F.sum(x * x).alias("ss"))
    by_target = rows.groupBy(*keys, target).agg(F.sum(x).alias("t")).groupBy(*keys).agg(F.sum(F.col("t") * F.col("t")).alias("tt"))
    by_rater = rows.groupBy(*keys, rater).agg(F.sum(x).alias("r")).groupBy(*keys).agg(F.sum(F.col("r") * F.col("r")).alias("rr"))
    j = whole.join(by_target, keys).join(by_rater, keys) if keys else whole.crossJoin(by_target).crossJoin(by_rater)
    n, k, base = F.col("n"), F.col("k"), F.try_divide(F.col("s") * F.col("s"), F.col("n") * F.col("k"))
    ssr, ssc = F.try_divide(F.col("tt"), k) - base, F.try_divide(F.col("rr"), n) - base
    msr, msc = F.try_divide(ssr, n - 1), F.try_divide(ssc, k - 1)
    mse = F.try_divide(F.col("ss") - base - ssr - ssc, (n - 1) * (k - 1))
    value_ = F.try_divide(msr - mse, msr + (k - 1) * mse + F.try_divide(k * (msc - mse), n))
    return j.select(*keys, n.cast("long").alias("n"), k.cast("long").alias("k"), F.when((n >= 3) & (k >= 2), value_).alias("icc"))


def bootstrap_weights(projects: DataFrame, replicates: int = 2000, seed: int = 42) -> DataFrame:
    """(rep, project, w): how often each project is drawn in each resample of all projects.

    ``projects`` has project, the rated ones of one validation study; they are drawn from in
    their order. The draws follow one seed, one after another, so one task makes them.
    """

    def run(batches):
        names = [p for b in batches for p in b["project"]]
        draw = random.Random(seed)
        for rep in range(replicates if names else 0):
            times = Counter(draw.randrange(len(names)) for _ in names)
            yield pd.DataFrame({"rep": rep, "project": [names[i] for i in times], "w": [float(n) for n in times.values()]})

    ordered = projects.select(F.col("project").cast("string")).distinct().coalesce(1).sortWithinPartitions("project")
    return ordered.mapInPandas(run, "rep int, project string, w double")


def numbered(values: DataFrame, name: str) -> tuple[DataFrame, int]:
    """(distinct values of column ``name`` with k, their place from 0 in its order; how many there are).

    A sort over ranges gives each value its place in its task, the tasks' sizes the rest; those alone reach the driver.
    """
    rows = materialise(values.select(name).where(F.col(name).isNotNull()).distinct().sort(name).withColumn("_i", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_i", 33).cast("int")
    sizes = sorted((r.part, r.n) for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before, starts = 0, []
    for p, n in sizes:
        starts.append((p, before))
        before += n
    starts = values.sparkSession.createDataFrame(starts, "_part int, _before long")
    placed = rows.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return placed.select(name, (F.col("_i").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before")).alias("k")), before


#: Projects of a block whose weights for one replicate travel as one row.
BLOCK = 8192


def _drawn(n: int, replicates: int, seed: int, spark: SparkSession) -> DataFrame:
    """(rep, block, w): how often each of n projects is drawn in each resample, BLOCK places a row, as an array.

    Every replicate has a generator of its own, counted by (seed, rep). A task holds one replicate's numbers at a time.
    """

    def run(batches):
        for b in batches:
            for rep in b["rep"] if n else ():
                draw = np.random.Generator(np.random.Philox(key=np.array([seed, rep], dtype=np.uint64)))
                times = np.bincount(draw.integers(0, n, n), minlength=n).astype(np.int8)  # a project is drawn more than 127 times of n with a chance below 1e-200
                for block in range(-(-n // BLOCK)):
                    yield pd.DataFrame({"rep": np.array([rep], dtype=np.int32), "block": [block], "w": [times[block * BLOCK : (block + 1) * BLOCK]]})

    reps = spark.range(replicates, numPartitions=min(replicates, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))).select(F.col("id").cast("int").alias("rep"))
    return reps.mapInPandas(run, "rep int, block long, w array<tinyint>")


class Resamples:
    """The resamples of ``projects`` (project): 2000 of them unless asked otherwise, the same however rows are split.

    ``sums`` adds them up by blocks of projects, so no row of a replicate and a project is ever made; ``weights`` makes them.
    """

    def __init__(self, projects: DataFrame, replicates: int = 2000, seed: int = 42):
        self.places, self.n = numbered(projects.select(F.col("project").cast("string").alias("project")), "project")
        self.drawn = materialise(_drawn(self.n, replicates, seed, projects.sparkSession), "drawn")

    def weights(self) -> DataFrame:
        """(rep, project, w), without zeros."""
        each = self.drawn.select("rep", "block", F.posexplode("w").alias("_p", "w")).where("w > 0")
        return each.select("rep", (F.col("block") * BLOCK + F.col("_p")).alias("k"), F.col("w").cast("double").alias("w")).join(self.places, "k").select("rep", "project", "w")

    def sums(self, values: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
        """(by, rep, columns): each column of values (by, project, columns; one row a group and project) times its weight, added up.

        A block of projects meets the weights of all replicates in one task: BLOCK rows of a group of ``by``, BLOCK bytes a replicate.
        """
        placed = values.join(self.places, "project").select(F.expr(f"k div {BLOCK}").alias("block"), (F.col("k") % BLOCK).cast("int").alias("_p"), *by, *[F.col(c).cast("double").alias(c) for c in columns])
        kinds = [f for f in placed.schema if f.name in by]
        schema = T.StructType([*kinds, T.StructField("rep", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in columns]])

        def added(drawn: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            parts = []
            for key, own in rows.groupby(by, dropna=False) if by and len(drawn) else [((), rows)] * min(1, len(drawn)):
                at, numbers = own["_p"].to_numpy(), own[columns].to_numpy(dtype=float)
                total = np.array([np.asarray(w)[at].astype(float) @ numbers for w in drawn["w"]])
                part = pd.DataFrame(total, columns=columns).assign(rep=drawn["rep"].to_numpy(), **dict(zip(by, key, strict=True)))
                parts.append(part[[*by, "rep", *columns]])
            return pd.concat(parts) if parts else pd.DataFrame(columns=[*by, "rep", *columns])

        part = self.drawn.groupBy("block").cogroup(placed.groupBy("block")).applyInPandas(added, schema)
        return part.groupBy(*by, "rep").agg(*[F.sum(c).alias(c) for c in columns])


def weighted_sums(values: DataFrame, weights: DataFrame | Resamples, by: list[str], columns: list[str]) -> DataFrame:
    """As ``Resamples.sums``, also for weights that are a table (rep, project, w)."""
    if isinstance(weights, Resamples):
        return weights.sums(values, by, columns)
    return values.join(weights, "project").groupBy(*by, "rep").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in columns])


def resampled(projects: DataFrame, replicates: int = 2000, seed: int = 42) -> DataFrame:
    """(rep, project, w): as ``bootstrap_weights``, but drawn side by side: the weights of ``Resamples`` as a table."""
    return Resamples(projects, replicates, seed).weights()


def project_sums(pairs: DataFrame, by: list[str], project: str) -> DataFrame:
    """What a kappa needs of each project, added over its items."""
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    return pairs.groupBy(*by, F.col(project).cast("string").alias("project")).agg(F.count("*").cast("double").alias("n"), F.sum(a).alias("sa"), F.sum(b).alias("sb"), F.sum(a * a).alias("saa"), F.sum(b * b).alias("sbb"), F.sum(a * b).alias("sab"))


def bootstrap_qwk(sums: DataFrame, weights: DataFrame | Resamples, by: list[str], confidence: float = 0.95) -> DataFrame:
    """Percentile interval of the kappa on a fixed scale over resampled projects; undefined replicates are left out."""
    each = weighted_sums(sums, weights, by, ["n", "sa", "sb", "saa", "sbb", "sab"])
    each = each.withColumn("q", qwk_from_sums(*[F.col(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")], fixed_labels=True)).where("q is not null")
    tail = (1 - confidence) / 2
    return each.groupBy(*by).agg(F.percentile("q", tail).alias("low"), F.percentile("q", 1 - tail).alias("high"), F.count("*").alias("replicates"))


def mean_pairwise(table: DataFrame, by: list[str] | None = None, value: str = "qwk") -> DataFrame:
    return table.groupBy(*(by or [])).agg(F.avg(value).alias("mean"), F.count(value).alias("pairs"))


def retest(runs: DataFrame) -> DataFrame:
    """By pair of runs: kappa and share of identical items. runs: run, project, item_id, score."""
    pairs = rater_pairs(runs, ["project", "item_id"], "run")
    by = ["run_a", "run_b"]
    pairs = pairs.withColumnsRenamed({"rater_a": "run_a", "rater_b": "run_b"})
    same = pairs.groupBy(*by).agg(F.round(100 * exact(F.col("a"), F.col("b")), 2).alias("identical_pct"))
    return observed_qwk(pairs, by).join(same, by)


def run_spread(runs: DataFrame) -> DataFrame:
    """Population deviation of the totals of each project over its runs, 3 places."""
    totals = runs.groupBy("run", "project").agg(F.sum("score").alias("total"))
    return totals.groupBy("project").agg(F.round(F.stddev_pop("total"), 3).alias("sd"), F.count("*").alias("runs"))


def juror_medians(scores: DataFrame, on: list[str], value: str = "score") -> DataFrame:
    """Item-level lower median and the interpolated one, side by side."""
    return scores.groupBy(*on).agg(F.expr(f"percentile_disc(0.5) within group (order by {value})").cast("int").alias("lower_median"), F.median(value).alias("median"))
