"""Analyses beside the rubric: each may fail for a document without touching its score or the other analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.session import small


def outcomes(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """(eval_id, analysis, value, error, tokens_in, tokens_out, usd), one row for each analysis of a document.

    calls: eval_id, analysis, pos, model, value, error, tokens_in, tokens_out, a row for each call that an
    analysis made, as ``invoke`` answers them; prices: model, usd_in, usd_out for a million tokens. One failed
    call fails its analysis: the value is null, error is that of the first failed call by pos, and
    nothing it used counts. Otherwise value lists the calls' values by pos. Each call's dollars are rounded to
    six places before they are added; calls of a model without a price have none, and usd is null
    if no call has a price. Calls without eval_id or analysis belong to nothing and are left out.
    """
    usd = F.round((F.coalesce("tokens_in", F.lit(0)) * F.col("usd_in") + F.coalesce("tokens_out", F.lit(0)) * F.col("usd_out")) / 1e6, 6)
    priced = calls.where("eval_id is not null and analysis is not null").join(small(prices.dropDuplicates(["model"])), "model", "left").withColumn("_usd", usd)
    good, bad = F.col("error").isNull(), F.col("error").isNotNull()
    listed = F.transform(F.array_sort(F.collect_list(F.when(good, F.struct("pos", "value")))), lambda x: x["value"])
    found = priced.groupBy("eval_id", "analysis").agg(
        F.min(F.when(bad, F.struct("pos", "error"))).alias("_bad"), listed.alias("value"),
        F.sum(F.coalesce("tokens_in", F.lit(0))).alias("tokens_in"), F.sum(F.coalesce("tokens_out", F.lit(0))).alias("tokens_out"), F.round(F.sum("_usd"), 6).alias("usd"),
    )
    whole = F.col("_bad").isNull()
    counted = [F.when(whole, F.col(c)).otherwise(F.lit(0)).alias(c) for c in ("tokens_in", "tokens_out")]
    return found.select("eval_id", "analysis", F.when(whole, F.col("value")).alias("value"), F.col("_bad.error").alias("error"), *counted, F.when(whole, F.col("usd")).alias("usd"))


def attach(results: DataFrame, found: DataFrame, analyses: list[str]) -> DataFrame:
    """Every result as it is, plus value and <name>_error of each analysis, with what they used added to its cost.

    results: eval_id, tokens_in, tokens_out, usd and any others. An analysis that failed or was not asked
    for is null. usd stays null only where neither the result nor an analysis has any. ``analyses``
    names the columns, so that the plan does not depend on the rows.
    """
    per = [c for a in analyses for c in (F.first(F.when(F.col("analysis") == a, F.col("value")), True).alias(a), F.first(F.when(F.col("analysis") == a, F.col("error")), True).alias(f"{a}_error"))]
    sums = found.where(F.col("analysis").isin(analyses)).groupBy("eval_id").agg(*per, *[F.sum(c).alias(f"_{c}") for c in ("tokens_in", "tokens_out", "usd")])
    joined = results.join(sums, "eval_id", "left")
    cost = {c: F.coalesce(c, F.lit(0)) + F.coalesce(f"_{c}", F.lit(0)) for c in ("tokens_in", "tokens_out")}
    dollars = F.when(F.col("_usd").isNull(), F.col("usd")).otherwise(F.round(F.coalesce("usd", F.lit(0.0)) + F.col("_usd"), 6))
    return joined.withColumns({**cost, "usd": dollars}).drop("_tokens_in", "_tokens_out", "_usd")


def failures(found: DataFrame) -> DataFrame:
    """One note for each analysis that is missing: eval_id, analysis, error; scores are not affected."""
    return found.where("error is not null").select("eval_id", "analysis", "error")
