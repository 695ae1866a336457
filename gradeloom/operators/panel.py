"""From the votes of a judge panel to item, section and document scores.

Tables: items (rubric_id, section_id, item_id, pos, weight, partial), sections
(rubric_id, section_id, pos, name, max), votes (eval_id, judge, section_id, item_id,
level or score, evidence, observation), segments (eval_id, section_id, present, words,
own_words), active (eval_id, section_id). A rubric's kind is weighted, scale or dichotomous.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.session import small

KINDS = ("weighted", "scale", "dichotomous")
#: Texts that stand for missing work.
MISSING_SECTION = "Sección no encontrada en el proyecto."
EMPTY_SECTION = "Sección presente pero sin contenido evaluable (vacía o solo texto de la plantilla)."
NO_PANEL = "Sin calificación del panel para este ítem (falla de API registrada)."
NO_EVIDENCE = "no se encontró evidencia"
FLAG = "[Discrepancia entre jueces] "
LEAST_WORDS = 5


def lower_median(values: Column) -> Column:
    """Ordinal median of an array: of an even number the lower one; null of none."""
    n = F.size(values)
    return F.when(n > 0, F.element_at(F.array_sort(values), F.floor((n + 1) / 2).cast("int")))


def ordinal(kind: str, level: Column, score: Column) -> Column:
    """The vote as a number: the score itself, or the place of its level."""
    if kind == "scale":
        return score.cast("int")
    top = 2 if kind == "weighted" else 1
    return F.when(level == "no_cumple", 0).when(level == "cumple", top).when((level == "parcial") & F.lit(kind == "weighted"), 1)


def level_of(kind: str, median: Column) -> Column:
    if kind == "scale":
        return median.cast("string")
    names = ("no_cumple", "parcial", "cumple") if kind == "weighted" else ("no_cumple", "cumple")
    level = F.lit(None).cast("string")
    for place, name in enumerate(names):
        level = F.when(median == place, name).otherwise(level)
    return level


def points(kind: str, median: Column, weight: Column, partial: Column) -> Column:
    """Points of an item; half the weight, 2 places, where no partial value is given."""
    if kind == "scale":
        return median.cast("double")
    if kind == "dichotomous":
        return F.when(median == 1, weight).otherwise(0.0).cast("double")
    return F.when(median >= 2, weight).when(median == 1, F.coalesce(partial, F.round(weight / 2, 2))).otherwise(0.0).cast("double")


def first_votes(votes: DataFrame, order: str) -> DataFrame:
    """The first vote of each judge for each item, by ``order``."""
    keys = ["eval_id", "judge", "section_id", "item_id"]
    rest = [c for c in votes.columns if c not in (*keys, order)]
    return votes.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_v")).select(*keys, "_v.*")


def consolidate(votes: DataFrame, kind: str, order: str | None = None) -> DataFrame:
    """One row for each voted (eval_id, section_id, item_id): median, spread, flag, texts and votes.

    A judge has one vote for an item: the first by the column ``order``. Without such a
    column repeated votes have no order, and the least of them by content counts.

    The texts are those of the lowest-numbered judge whose vote is the median. Judges of an
    item are few, so a group is small; the votes of different items shuffle once.
    """
    votes = votes if order is None else first_votes(votes, order)
    vote = F.struct(F.col("judge").cast("int").alias("judge"), ordinal(kind, F.col("level"), F.col("score")).alias("o"), "level", "score", "evidence", "observation")
    grouped = votes.groupBy("eval_id", "section_id", "item_id").agg(F.array_sort(F.collect_list(vote)).alias("_all"))
    grouped = grouped.withColumn("_all", F.filter("_all", lambda v, i: (i == 0) | (v["judge"] != F.get(F.col("_all"), i - 1)["judge"])))
    valid = F.filter("_all", lambda v: v["o"].isNotNull())
    out = grouped.withColumn("_v", valid).withColumn("median", lower_median(F.transform("_v", lambda v: v["o"])))
    spread = F.array_max(F.transform("_v", lambda v: v["o"])) - F.array_min(F.transform("_v", lambda v: v["o"]))
    voice = F.try_element_at(F.filter("_v", lambda v: v["o"] == F.col("median")), F.lit(1))
    shown = F.map_from_entries(F.transform("_all", lambda v: F.struct(F.concat(F.lit("juez"), v["judge"].cast("string")), F.coalesce(v["level"], v["score"].cast("string")))))
    return out.select(
        "eval_id", "section_id", "item_id", F.size("_v").alias("n_votes"), "median", spread.alias("spread"),
        F.coalesce(spread >= (1 if kind == "dichotomous" else 2), F.lit(False)).alias("flagged"),
        voice["evidence"].alias("evidence"), voice["observation"].alias("observation"), shown.alias("votes"),
    )


def evaluable_words(words: Column, own: Column) -> Column:
    return F.least(words, F.coalesce(own, words))


def active_sections(evals: DataFrame, sections: DataFrame, week_map: DataFrame) -> DataFrame:
    """(eval_id, section_id) that count. evals: eval_id, rubric_id, mode, weeks array, with_admin; sections: admin flag.

    The weekly mode activates the union of its weeks' sections; without weeks, or with none
    that the map knows, all of them. Administrative sections leave if the evaluation says so.
    """
    weeks = evals.where("mode = 'weekly'").select("eval_id", "rubric_id", F.explode("weeks").alias("week"))
    chosen = weeks.join(week_map, ["rubric_id", "week"]).select("eval_id", "section_id").distinct()
    some = chosen.select("eval_id").distinct().withColumn("_some", F.lit(True))
    every = evals.join(sections.select("rubric_id", "section_id", "admin"), "rubric_id").join(some, "eval_id", "left")
    picked = every.join(chosen.withColumn("_in", F.lit(True)), ["eval_id", "section_id"], "left")
    return picked.where("(_some is null or _in) and (with_admin or not admin)").select("eval_id", "section_id")


def item_scores(items: DataFrame, consolidated: DataFrame, status: DataFrame, kind: str) -> DataFrame:
    """All items of all active sections. status: eval_id, section_id, state (missing, empty, open)."""
    by = ["rubric_id", "section_id"] if "rubric_id" in status.columns and "rubric_id" in items.columns else ["section_id"]
    base = status.where("state <> 'inactive'").join(items, by)
    joined = base.join(consolidated, ["eval_id", "section_id", "item_id"], "left")
    open_, voted = F.col("state") == "open", F.col("median").isNotNull()
    floor = F.lit("0" if kind == "scale" else "no_cumple")
    top = F.lit(3.0) if kind == "scale" else F.col("weight").cast("double")
    return joined.select(
        "eval_id", "section_id", "item_id", "pos", "state",
        F.when(~open_, floor).when(voted, level_of(kind, F.col("median"))).alias("level"),
        F.when(open_ & voted, F.round(points(kind, F.col("median"), F.col("weight"), F.col("partial")), 2)).otherwise(0.0).alias("points"),
        top.alias("max_points"), (open_ & F.coalesce("flagged", F.lit(False))).alias("flagged"), (open_ & voted).alias("judged"),
        F.when(~open_, F.lit(NO_EVIDENCE)).otherwise(F.coalesce("evidence", F.lit(""))).alias("evidence"),
        F.when(F.col("state") == "missing", MISSING_SECTION).when(F.col("state") == "empty", EMPTY_SECTION).when(~voted, NO_PANEL)
        .otherwise(F.concat(F.when(F.col("flagged"), FLAG).otherwise(""), F.coalesce("observation", F.lit("")))).alias("observation"),
        F.when(open_, F.col("votes")).alias("votes"),
    )


def section_status(segments: DataFrame, sections: DataFrame, evals: DataFrame, active: DataFrame) -> DataFrame:
    """State of every section of every evaluation: inactive, missing, empty or open."""
    every = evals.select("eval_id", "rubric_id").join(sections.select("rubric_id", "section_id", "max", F.col("pos").alias("section_pos")), "rubric_id")
    joined = every.join(segments, ["eval_id", "section_id"], "left").join(active.withColumn("_on", F.lit(True)), ["eval_id", "section_id"], "left")
    words = F.coalesce(evaluable_words(F.col("words"), F.col("own_words")), F.lit(0))
    state = F.when(F.col("_on").isNull(), "inactive").when(~F.coalesce("present", F.lit(False)), "missing").when(words < LEAST_WORDS, "empty").otherwise("open")
    return joined.select("eval_id", "rubric_id", "section_id", "section_pos", "max", F.coalesce("present", F.lit(False)).alias("present"), state.alias("state"))


def section_scores(status: DataFrame, scored: DataFrame) -> DataFrame:
    sums = scored.groupBy("eval_id", "section_id").agg(F.round(F.sum("points"), 2).alias("subtotal"))
    return status.join(sums, ["eval_id", "section_id"], "left").withColumn("subtotal", F.when(F.col("state") == "inactive", None).otherwise(F.coalesce("subtotal", F.lit(0.0))))


def totals(scored_sections: DataFrame, evals: DataFrame) -> DataFrame:
    """Total, active and full maximum and, where they differ or the mode is weekly, the total of 100."""
    on = F.col("state") != "inactive"
    sums = scored_sections.groupBy("eval_id").agg(
        F.round(F.coalesce(F.sum("subtotal"), F.lit(0.0)), 2).alias("total"),
        F.round(F.coalesce(F.sum(F.when(on, F.col("max"))), F.lit(0.0)), 2).cast("double").alias("active_max"), F.round(F.sum("max"), 2).cast("double").alias("full_max"),
    )
    joined = sums.join(evals.select("eval_id", "rubric_id", "mode"), "eval_id")
    norm = F.when((F.col("active_max") > 0) & ((F.col("mode") == "weekly") | (F.col("active_max") != F.col("full_max"))), F.round(F.try_divide(F.col("total"), F.col("active_max")) * 100, 2))
    return joined.withColumn("normalised", norm).withColumn("basis", F.when(F.col("active_max") > 0, F.coalesce(norm, F.col("total"))))


def with_band(scores: DataFrame, bands: DataFrame, basis: str = "basis") -> DataFrame:
    """Add band: of the bands (rubric_id, min, label, pos) the highest min not above the basis, else the last listed.

    Null without bands or basis. A rubric's bands are a handful, so they travel as one array.
    """
    packed = bands.groupBy("rubric_id").agg(F.collect_list(F.struct(F.col("min").cast("double").alias("min"), "pos", "label")).alias("_bands"))
    fits = F.array_max(F.filter("_bands", lambda b: b["min"] <= F.col(basis)))
    last = F.array_max(F.transform("_bands", lambda b: F.struct(b["pos"].alias("pos"), b["label"].alias("label"))))
    band = F.when(F.col(basis).isNotNull(), F.coalesce(fits["label"], last["label"]))
    return scores.join(packed, "rubric_id", "left").withColumn("band", band).drop("_bands")


def with_grade(scores: DataFrame, conversion: DataFrame) -> DataFrame:
    """Add grade from (rubric_id, min, max, grade) by the total rounded half to even; only complete and full."""
    packed = conversion.groupBy("rubric_id").agg(F.collect_list(F.struct("min", "max", "grade")).alias("_conv"))
    whole = F.bround(F.col("total"), 0)
    hit = F.try_element_at(F.filter("_conv", lambda c: whole.between(c["min"], c["max"])), F.lit(1))["grade"]
    return scores.join(packed, "rubric_id", "left").withColumn("grade", F.when((F.col("mode") == "complete") & (F.col("active_max") == F.col("full_max")), hit)).drop("_conv")


def panel_stats(scored: DataFrame, gaps: DataFrame) -> DataFrame:
    """Share of flagged items, the flagged ones in rubric order, and whether a judge left a gap.

    gaps: eval_id, judge, section_id of calls that failed. Sections are in the order of
    section_pos, or of their ids where ``scored`` has no such column.
    """
    place = "section_pos" if "section_pos" in scored.columns else "section_id"
    marked = F.transform(F.array_sort(F.collect_list(F.when(F.col("flagged"), F.struct(F.col(place).alias("at"), "section_id", "pos", "item_id")))), lambda x: F.concat_ws(".", x["section_id"], x["item_id"]))
    stats = scored.groupBy("eval_id").agg(
        F.round(F.coalesce(F.try_divide(100.0 * F.count_if("flagged"), F.count_if("judged")), F.lit(0.0)), 2).alias("disagreement_pct"), marked.alias("flagged_items")
    )
    named = gaps.groupBy("eval_id").agg(F.array_sort(F.collect_list(F.concat(F.lit("juez"), F.col("judge").cast("string"), F.lit(" "), F.col("section_id")))).alias("gaps"))
    return stats.join(named, "eval_id", "left").withColumn("gaps", F.coalesce("gaps", F.array().cast("array<string>"))).withColumn("incomplete", F.size("gaps") > 0)


def dimension_scores(votes: DataFrame) -> DataFrame:
    """Median of each cross-cutting dimension with the words of the first judge who gave it.

    votes: eval_id, judge, dimension, score, reason.
    """
    grouped = votes.groupBy("eval_id", "dimension").agg(F.array_sort(F.collect_list(F.struct("judge", "score", "reason"))).alias("_v"))
    grouped = grouped.withColumn("median", lower_median(F.transform(F.filter("_v", lambda v: v["score"].isNotNull()), lambda v: v["score"])))
    voice = F.try_element_at(F.filter("_v", lambda v: v["score"] == F.col("median")), F.lit(1))
    return grouped.select("eval_id", "dimension", "median", F.coalesce(voice["reason"], F.lit("")).alias("reason"))


def score_documents(votes: DataFrame, items: DataFrame, sections: DataFrame, segments: DataFrame, evals: DataFrame, active: DataFrame, bands: DataFrame, conversion: DataFrame, kind: str) -> dict[str, DataFrame]:
    """The whole chain; the tables of each level by name."""
    status = section_status(segments, sections, evals, active)
    scored = item_scores(items.select(*[c for c in ("rubric_id", "section_id", "item_id", "pos", "weight", "partial") if c in items.columns]), consolidate(votes, kind), status, kind)
    by_section = section_scores(status, scored)
    return {"items": scored, "sections": by_section, "totals": with_grade(with_band(totals(by_section, evals), bands), conversion)}


def cost_rollup(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Tokens and dollars by evaluation; a model without a price adds nothing, and none at all is null.

    calls: eval_id, model, role (judge or other), tokens_in, tokens_out. prices: model, usd_in, usd_out per million.
    """
    exact = "decimal(12,4)"
    usd = F.col("tokens_in") * F.col("usd_in").cast(exact) + F.col("tokens_out") * F.col("usd_out").cast(exact)
    priced = calls.join(prices, "model", "left").withColumn("_usd", usd)
    known = F.bool_or((F.col("role") == "judge") & F.col("_usd").isNotNull())
    return priced.groupBy("eval_id").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.when(known, F.round(F.sum("_usd"), 0).cast("double") / 1e6).alias("usd"))


def call_plan(status: DataFrame, judges: DataFrame) -> DataFrame:
    """(eval_id, judge, section_id) to ask: open sections only. judges is the panel, a few rows."""
    return status.where("state = 'open'").select("eval_id", "section_id").crossJoin(small(judges.select("judge", "model", "role")))


def prefix_within_budget(requests: DataFrame, limit: int, keys: list[str], order: list[str], size: str = "tokens") -> DataFrame:
    """The first requests of each key whose running size stays within the limit, one at least."""
    run = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = requests.withColumn("_sum", F.sum(size).over(run)).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.where((F.col("_sum") <= limit) | (F.col("_n") == 1)).drop("_sum", "_n")
