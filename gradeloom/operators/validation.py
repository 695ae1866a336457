"""Validation of a system of judges against human jurors, and of its runs against each other.

Every table comes from joins on (project, item) and sums; only projects that both sides have
count. Scores are levels 0 to 3, so a kappa whose labels are all alike has no value here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.operators import agreement as ag

#: Levels of three by name.
LEVELS = {"no_cumple": 0, "parcial": 1, "cumple": 2}


def shared(system: DataFrame, jurors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the projects that both have. system: project, item_id, score; jurors: also rater."""
    both = system.select("project").distinct().join(jurors.select("project").distinct(), "project")
    return system.join(both, "project", "left_semi"), jurors.join(both, "project", "left_semi")


def against_jurors(system: DataFrame, jurors: DataFrame) -> DataFrame:
    """(rater, n_items, qwk, exact, adjacent) over the items that the system and the juror rated."""
    ours, theirs = shared(system, jurors)
    pairs = ours.select("project", "item_id", F.col("score").alias("a")).join(theirs.select("project", "item_id", "rater", F.col("score").alias("b")), ["project", "item_id"])
    return pairs.groupBy("rater").agg(F.count("*").alias("n_items"), ag.qwk(F.col("a"), F.col("b"), fixed_labels=True).alias("qwk"), ag.exact(F.col("a"), F.col("b")).alias("exact"), ag.adjacent(F.col("a"), F.col("b")).alias("adjacent"))


def item_pairs(system: DataFrame, jurors: DataFrame) -> DataFrame:
    """(project, item_id, a, b): the system and the lower median of the jurors."""
    ours, theirs = shared(system, jurors)
    medians = ag.juror_medians(theirs, ["project", "item_id"]).select("project", "item_id", F.col("lower_median").alias("b"))
    return ours.select("project", "item_id", F.col("score").alias("a")).join(medians, ["project", "item_id"])


def total_pairs(system: DataFrame, jurors: DataFrame) -> DataFrame:
    """(project, a, b): the system's total and the median of the jurors' totals."""
    ours, theirs = shared(system, jurors)
    sums = theirs.groupBy("project", "rater").agg(F.sum("score").alias("total")).groupBy("project").agg(F.median("total").alias("b"))
    return ours.groupBy("project").agg(F.sum("score").cast("double").alias("a")).join(sums, "project")


def against_median(system: DataFrame, jurors: DataFrame) -> DataFrame:
    """One row: agreement on items, and on totals by kappa of ranks, error, correlations and ICC(2,1).

    Raises when it is read if no project is on both sides.
    """
    totals = total_pairs(system, jurors).withColumn("_k", F.lit(1))
    items = item_pairs(system, jurors).agg(F.count("*").alias("n_items"), ag.qwk(F.col("a"), F.col("b"), fixed_labels=True).alias("qwk_items"), ag.exact(F.col("a"), F.col("b")).alias("exact"), ag.adjacent(F.col("a"), F.col("b")).alias("adjacent"))
    rounded = totals.select("_k", F.bround("a").alias("a"), F.bround("b").alias("b"))
    ranked = ag.dense_labels(rounded, ["_k"]).agg(ag.qwk(F.col("a"), F.col("b")).alias("qwk_totals"))
    some = F.when(F.count("*") > 0, F.count("*")).otherwise(F.raise_error(F.lit("no project has both a result and a juror")).cast("long"))
    error = totals.agg(some.alias("n_projects"), ag.mean_error(F.col("a"), F.col("b")).alias("mae_totals"), ag.pearson(F.col("a"), F.col("b")).alias("pearson"))
    long = totals.select("project", F.explode(F.array(F.struct(F.lit("system").alias("rater"), F.col("a").alias("score")), F.struct(F.lit("median").alias("rater"), F.col("b").alias("score")))).alias("_r")).select("project", "_r.*")
    parts = [items, error, ranked, ag.spearman(totals, ["_k"]).select("spearman"), ag.icc21(long, "project").select("icc")]
    # Each part is one row.
    one = reduce(lambda x, y: x.join(y, "_one", "full"), [p.withColumn("_one", F.lit(1)) for p in parts])
    return one.drop("_one")


def median_intervals(system: DataFrame, jurors: DataFrame, weights: DataFrame | ag.Resamples, confidence: float = 0.95) -> DataFrame:
    """(measure, low, high): percentile intervals of the items' kappa and the totals' error over resampled projects."""
    tail = (1 - confidence) / 2
    kappa = ag.bootstrap_qwk(ag.project_sums(item_pairs(system, jurors).withColumn("measure", F.lit("qwk_items")), ["measure"], "project"), weights, ["measure"], confidence)
    errors = total_pairs(system, jurors).select(F.col("project").cast("string").alias("project"), F.abs(F.col("a") - F.col("b")).cast("double").alias("e"), F.lit(1.0).alias("one"))
    each = ag.weighted_sums(errors, weights, [], ["e", "one"]).select("rep", (F.col("e") / F.col("one")).alias("m"))
    error = each.agg(F.lit("mae_totals").alias("measure"), F.percentile("m", tail).alias("low"), F.percentile("m", 1 - tail).alias("high"))
    return kappa.select("measure", "low", "high").unionByName(error)


def panel_agreement(votes: DataFrame) -> DataFrame:
    """(judge_a, judge_b, n, qwk) of the system's own judges over items that both rated.

    votes: project, item_id, judge, level (a name of three levels, or a number).
    """
    number = F.coalesce(*[F.when(F.col("level") == name, n) for name, n in LEVELS.items()], F.col("level").try_cast("int"))
    pairs = ag.rater_pairs(votes.withColumn("_n", number), ["project", "item_id"], "judge", "_n")
    return ag.observed_qwk(pairs.withColumnsRenamed({"rater_a": "judge_a", "rater_b": "judge_b"}), ["judge_a", "judge_b"])


def human_baseline(jurors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kappa of each pair of jurors over all items and by project (one table), and of their totals.

    Totals need two projects that both jurors rated.
    """
    pairs = ag.rater_pairs(jurors, ["project", "item_id"])
    items = pairs.groupingSets([["rater_a", "rater_b"], ["rater_a", "rater_b", "project"]], "rater_a", "rater_b", "project").agg(F.count("*").alias("n"), ag.qwk(F.col("a"), F.col("b"), fixed_labels=True).alias("qwk"))
    totals = ag.rater_pairs(jurors.groupBy("project", "rater").agg(F.sum("score").alias("score")), ["project"])
    by = ["rater_a", "rater_b"]
    enough = totals.groupBy(*by).agg(F.count("*").alias("n_projects")).where("n_projects >= 2")
    ranked = ag.dense_labels(totals, by).groupBy(*by).agg(ag.qwk(F.col("a"), F.col("b")).alias("qwk"))
    return items.select(*by, "project", "n", "qwk"), enough.join(ranked, by)


def report(system: DataFrame, jurors: DataFrame, votes: DataFrame, weights: DataFrame | ag.Resamples) -> DataFrame:
    """The whole study as (part, subject, measure, value), in one table to write out."""

    def long(df: DataFrame, part: str, subject) -> DataFrame:
        names = [f.name for f in df.schema if f.dataType.simpleString() in ("double", "bigint", "int")]
        rows = F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).cast("double").alias("value")) for n in names]))
        return df.select(F.lit(part).alias("part"), subject.alias("subject"), rows.alias("_r")).select("part", "subject", "_r.*")

    items, totals = human_baseline(jurors)
    pair = F.concat_ws("|", "rater_a", "rater_b")
    panel = panel_agreement(votes)
    parts = [
        long(against_jurors(system, jurors), "against juror", F.col("rater")), long(against_median(system, jurors), "against median", F.lit("median")),
        long(median_intervals(system, jurors, weights), "interval", F.col("measure")), long(items.where("project is null").drop("project"), "jurors, items", pair),
        long(totals, "jurors, totals", pair), long(panel, "panel", F.concat_ws("|", "judge_a", "judge_b")), long(panel.agg(F.avg("qwk").alias("mean")), "panel", F.lit("mean")),
    ]
    return reduce(DataFrame.unionByName, parts)


def retest_report(runs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Kappa by pair of runs, spread of each project's totals, and ICC(2,1) of the totals with runs as raters."""
    totals = runs.groupBy(F.col("run").alias("rater"), "project").agg(F.sum("score").alias("score"))
    return ag.retest(runs), ag.run_spread(runs), ag.icc21(totals, "project")
