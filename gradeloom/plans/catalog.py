"""Named queries over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeloom.functions import text as tx
from gradeloom.operators import agreement as ag
from gradeloom.operators import analyses, argue, invoke, library, panel, redact, reports, requests, segment, store, template, textstats, validation, vectors
from gradeloom.plans.inputs import BANDS_SQL, ITEMS_SQL, PAIRS_SQL, VOTES_SQL, bands, items, table, votes
from gradeloom.session import new_folder
from gradeloom.streaming import progress

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def _scale_votes(spark, sf_dir):
    return votes(spark, sf_dir).withColumns({"level": F.lit(None).cast("string"), "evidence": F.concat(F.lit("e"), F.col("judge").cast("string")), "observation": F.concat(F.lit("o"), F.col("judge").cast("string"))})


def _level_votes(spark, sf_dir, kind):
    level = panel.level_of(kind, F.col("score") % (3 if kind == "weighted" else 2))
    return _scale_votes(spark, sf_dir).withColumn("level", level).withColumn("score", F.lit(None).cast("int"))


_MEDIANS = "m as (select doc_id, section_id, item, quantile_disc(score, 0.5) as median, max(score) - min(score) as spread, count(score) as n_votes from votes group by 1, 2, 3)"


@query(f"""with {VOTES_SQL}, {_MEDIANS}, {BANDS_SQL},
t as (select doc_id, cast(sum(coalesce(median, 0)) as double) as total, cast(count(*) filter (n_votes > 0 and spread >= 2) as bigint) as flagged from m group by 1)
select doc_id, total, round(total / 24 * 100, 2) as pct, flagged, (select label from bands where min <= round(total / 24 * 100, 2) order by min desc limit 1) as band from t""")
def score_flagship(spark, sf_dir):
    """Votes to item medians, totals, flags and a quality band."""
    c = panel.consolidate(_scale_votes(spark, sf_dir), "scale")
    t = c.groupBy(F.col("eval_id").alias("doc_id")).agg(F.sum(F.coalesce("median", F.lit(0))).cast("double").alias("total"), F.count_if("flagged").alias("flagged"))
    t = t.withColumns({"pct": F.round(F.col("total") / 24 * 100, 2), "rubric_id": F.lit("r")})
    return panel.with_band(t, bands(spark), "pct").select("doc_id", "total", "pct", "flagged", "band")


@query(f"with {VOTES_SQL}, {_MEDIANS} select doc_id, section_id, 'i' || cast(item as varchar) as item_id, cast(n_votes as int) as n_votes, median, spread, coalesce(spread >= 2, false) as flagged from m")
def item_consolidation(spark, sf_dir):
    return panel.consolidate(_scale_votes(spark, sf_dir), "scale").select(F.col("eval_id").alias("doc_id"), "section_id", "item_id", "n_votes", "median", "spread", "flagged")


@query(f"with {VOTES_SQL}, {_MEDIANS} select doc_id, section_id, cast(sum(coalesce(median, 0)) as double) as subtotal, cast(count(*) filter (n_votes > 0) as bigint) as judged from m group by 1, 2")
def section_subtotals(spark, sf_dir):
    c = panel.consolidate(_scale_votes(spark, sf_dir), "scale")
    return c.groupBy(F.col("eval_id").alias("doc_id"), "section_id").agg(F.sum(F.coalesce("median", F.lit(0))).cast("double").alias("subtotal"), F.count_if(F.col("n_votes") > 0).alias("judged"))


@query(f"""with {VOTES_SQL}, l as (select doc_id, item, score % 2 as o from votes), m as (select doc_id, item, quantile_disc(o, 0.5) as med, max(o) - min(o) as spread from l group by 1, 2)
select doc_id, 'i' || cast(item as varchar) as item_id, case med when 1 then 'cumple' when 0 then 'no_cumple' end as level, coalesce(spread >= 1, false) as flagged from m""")
def dichotomous_majority(spark, sf_dir):
    c = panel.consolidate(_level_votes(spark, sf_dir, "dichotomous"), "dichotomous")
    return c.select(F.col("eval_id").alias("doc_id"), "item_id", panel.level_of("dichotomous", F.col("median")).alias("level"), "flagged")


@query(f"""with {VOTES_SQL}, {ITEMS_SQL}, m as (select doc_id, item, quantile_disc(score % 3, 0.5) as med from votes group by 1, 2)
select doc_id, 'i' || cast(item as varchar) as item_id, case med when 2 then 'cumple' when 1 then 'parcial' when 0 then 'no_cumple' end as level,
  cast(case when med >= 2 then weight when med = 1 then coalesce(partial, round(weight / 2, 2)) else 0 end as double) as points from m join items using (item)""")
def weighted_three_level(spark, sf_dir):
    c = panel.consolidate(_level_votes(spark, sf_dir, "weighted"), "weighted").join(F.broadcast(items(spark).select("item_id", "weight", "partial")), "item_id")
    return c.select(F.col("eval_id").alias("doc_id"), "item_id", panel.level_of("weighted", F.col("median")).alias("level"), panel.points("weighted", F.col("median"), F.col("weight"), F.col("partial")).alias("points"))


@query(f"""with {VOTES_SQL}, {_MEDIANS} select doc_id, round(100.0 * count(*) filter (n_votes > 0 and spread >= 2) / count(*) filter (n_votes > 0), 2) as disagreement_pct,
  coalesce(string_agg(section_id || '.i' || cast(item as varchar), ',' order by section_id, item) filter (n_votes > 0 and spread >= 2), '') as flagged_items from m group by 1""")
def disagreement_rate(spark, sf_dir):
    c = panel.consolidate(_scale_votes(spark, sf_dir), "scale").join(F.broadcast(items(spark).select("item_id", "pos")), "item_id").withColumn("judged", F.col("n_votes") > 0)
    stats = panel.panel_stats(c, spark.createDataFrame([], "eval_id long, judge int, section_id string"))
    return stats.select(F.col("eval_id").alias("doc_id"), "disagreement_pct", F.array_join("flagged_items", ",").alias("flagged_items"))


@query(f"""with {VOTES_SQL} select doc_id, count(*) filter (score is null) as gaps, count(*) filter (score is null) > 0 as incomplete,
  coalesce(string_agg('juez' || cast(judge as varchar) || ' ' || item_id, ',' order by judge, item) filter (score is null), '') as gap_list from votes group by 1""")
def panel_gaps(spark, sf_dir):
    v = votes(spark, sf_dir)
    gap = F.when(F.col("score").isNull(), F.struct("judge", "item", F.concat(F.lit("juez"), F.col("judge").cast("string"), F.lit(" "), "item_id").alias("t")))
    g = v.groupBy("doc_id").agg(F.count_if(F.col("score").isNull()).alias("gaps"), F.array_sort(F.collect_list(gap)).alias("_g"))
    return g.select("doc_id", "gaps", (F.col("gaps") > 0).alias("incomplete"), F.array_join(F.transform("_g", lambda x: x["t"]), ",").alias("gap_list"))


@query(f"""with {VOTES_SQL}, {_MEDIANS} select v.doc_id, v.item_id, min(v.judge) as judge, min_by('o' || cast(v.judge as varchar), v.judge) as observation
  from votes v join m on v.doc_id = m.doc_id and v.item = m.item and v.score = m.median group by 1, 2""")
def representative_vote(spark, sf_dir):
    c = panel.consolidate(_scale_votes(spark, sf_dir), "scale").where("median is not null")
    return c.select(F.col("eval_id").alias("doc_id"), "item_id", F.substring("observation", 2, 9).cast("int").alias("judge"), "observation")


def _weekly(spark, sf_dir):
    """Evaluations of every document: a third complete, a third weekly, the rest weekly without weeks."""
    v = _scale_votes(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("eval_id"))
    mode = F.when(F.col("eval_id") % 3 == 0, "complete").otherwise("weekly")
    weeks = F.when(F.col("eval_id") % 3 == 1, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    evals = docs.select("eval_id", F.lit("r").alias("rubric_id"), mode.alias("mode"), weeks.alias("weeks"), F.lit(True).alias("with_admin"))
    sections = spark.createDataFrame([("r", "S01", 1, "One", 12.0, False), ("r", "S02", 2, "Two", 12.0, False)], "rubric_id string, section_id string, pos int, name string, max double, admin boolean")
    week_map = spark.createDataFrame([("r", 1, "S01")], "rubric_id string, week int, section_id string")
    active = panel.active_sections(evals, sections, week_map)
    segments = docs.select("eval_id", F.explode(F.array(F.lit("S01"), F.lit("S02"))).alias("section_id"))
    words = F.when(F.col("section_id") == "S02", F.col("eval_id") % 9).otherwise(F.lit(50)).cast("int")
    segments = segments.select("eval_id", "section_id", (F.col("eval_id") % 7 != 0).alias("present"), words.alias("words"), F.lit(None).cast("int").alias("own_words"))
    conversion = spark.createDataFrame([("r", 3 * g, 3 * g + 2, g) for g in range(9)], "rubric_id string, min int, max int, grade int")
    return panel.score_documents(v, items(spark), sections, segments, evals, active, bands(spark), conversion, "scale")


_WEEKLY_SQL = f"""with {VOTES_SQL}, {_MEDIANS}, {BANDS_SQL},
s as (select doc_id, section_id, sum(coalesce(median, 0)) as pts from m group by 1, 2),
k as (select s.*, case when doc_id % 3 = 0 then 'complete' else 'weekly' end as mode, not (doc_id % 3 = 1 and section_id = 'S02') as active,
  doc_id % 7 <> 0 and (section_id = 'S01' or doc_id % 9 >= 5) as open from s),
t as (select doc_id, min(mode) as mode, cast(sum(case when active and open then pts else 0 end) as double) as total, cast(sum(case when active then 12 else 0 end) as double) as active_max from k group by 1),
u as (select *, case when mode = 'weekly' or active_max <> 24 then round(total / active_max * 100, 2) end as normalised from t)"""


@query(_WEEKLY_SQL + " select doc_id, mode, total, active_max, normalised from u")
def progressive_normalised(spark, sf_dir):
    return _weekly(spark, sf_dir)["totals"].select(F.col("eval_id").alias("doc_id"), "mode", "total", "active_max", "normalised")


@query(_WEEKLY_SQL + " select doc_id, (select label from bands where min <= coalesce(normalised, total) order by min desc limit 1) as band from u")
def quality_band(spark, sf_dir):
    return _weekly(spark, sf_dir)["totals"].select(F.col("eval_id").alias("doc_id"), "band")


@query(_WEEKLY_SQL + " select doc_id, case when mode = 'complete' and active_max = 24 then cast(round_even(total, 0) as int) // 3 end as grade from u")
def grade_conversion(spark, sf_dir):
    return _weekly(spark, sf_dir)["totals"].select(F.col("eval_id").alias("doc_id"), "grade")


_OPEN = "doc_id % 7 <> 0 and (section_id = 'S01' or doc_id % 9 >= 5)"


@query(_WEEKLY_SQL + f""" select doc_id, section_id, case when doc_id % 3 = 1 and section_id = 'S02' then 'inactive' when doc_id % 7 = 0 then 'missing' when not ({_OPEN}) then 'empty' else 'open' end as state,
  case when doc_id % 3 = 1 and section_id = 'S02' then null when {_OPEN} then cast(pts as double) else 0 end as subtotal from k""")
def section_states(spark, sf_dir):
    return _weekly(spark, sf_dir)["sections"].select(F.col("eval_id").alias("doc_id"), "section_id", "state", "subtotal")


_QWK = "case when count(distinct a) = 1 and min(a) = min(b) and max(a) = max(b) then 1.0 else 1 - sum((a - b) * (a - b)) / (sum(a * a) + sum(b * b) - 2.0 * sum(a) * sum(b) / count(*)) end"


def _dense(pairs: str, keys: str = "ja, jb") -> str:
    """d: the pairs with each label as its place among those that occur in its group."""
    return f"""labels as (select {keys}, v, dense_rank() over (partition by {keys} order by v) as p from (select distinct {keys}, unnest([a, b]) as v from {pairs})),
d as (select {keys}, x.p as a, y.p as b, q.a = q.b as same from {pairs} q join labels x using ({keys}) join labels y using ({keys}) where x.v = q.a and y.v = q.b)"""


def _pairs(spark, sf_dir):
    return ag.rater_pairs(votes(spark, sf_dir), ["doc_id", "item"], "judge")


@query(f"with {PAIRS_SQL}, {_dense('pairs')} select ja as judge_a, jb as judge_b, count(*) as n, round({_QWK}, 6) as qwk from d group by 1, 2")
def qwk_pairs(spark, sf_dir):
    p = _pairs(spark, sf_dir).withColumnsRenamed({"rater_a": "judge_a", "rater_b": "judge_b"})
    return ag.observed_qwk(p, ["judge_a", "judge_b"]).withColumn("qwk", F.round("qwk", 6))


_TOTALS_SQL = VOTES_SQL + """, totals as (select doc_id, judge, sum(coalesce(score, 0)) as score from votes group by 1, 2),
pt as (select a.doc_id, a.judge as ja, b.judge as jb, a.score as a0, b.score as b0 from totals a join totals b on a.doc_id = b.doc_id and a.judge < b.judge)"""


def _totals(spark, sf_dir):
    return votes(spark, sf_dir).groupBy("doc_id", "judge").agg(F.sum(F.coalesce("score", F.lit(0))).alias("score"))


@query(f"""with {_TOTALS_SQL}, labels as (select ja, jb, v, dense_rank() over (partition by ja, jb order by v) as p from (select distinct ja, jb, unnest([a0, b0]) as v from pt)),
d as (select pt.ja, pt.jb, x.p as a, y.p as b from pt join labels x on x.ja = pt.ja and x.jb = pt.jb and x.v = a0 join labels y on y.ja = pt.ja and y.jb = pt.jb and y.v = b0)
select ja as judge_a, jb as judge_b, round({_QWK}, 6) as qwk from d group by 1, 2""")
def qwk_totals_dense(spark, sf_dir):
    p = ag.dense_labels(ag.rater_pairs(_totals(spark, sf_dir), ["doc_id"], "judge"), ["rater_a", "rater_b"])
    return p.groupBy(F.col("rater_a").alias("judge_a"), F.col("rater_b").alias("judge_b")).agg(F.round(ag.qwk(F.col("a"), F.col("b")), 6).alias("qwk"))


@query(f"with {PAIRS_SQL} select ja as judge_a, jb as judge_b, round(avg((a = b)::int), 6) as exact, round(avg((abs(a - b) <= 1)::int), 6) as adjacent, round(avg(abs(a - b)), 6) as mae from pairs group by 1, 2")
def exact_adjacent_mae(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return _pairs(spark, sf_dir).groupBy(F.col("rater_a").alias("judge_a"), F.col("rater_b").alias("judge_b")).agg(F.round(ag.exact(a, b), 6).alias("exact"), F.round(ag.adjacent(a, b), 6).alias("adjacent"), F.round(ag.mean_error(a, b), 6).alias("mae"))


@query(f"""with {_TOTALS_SQL}, r as (select *, rank() over (partition by ja, jb order by a0) + (count(*) over (partition by ja, jb, a0) - 1) / 2.0 as ra,
  rank() over (partition by ja, jb order by b0) + (count(*) over (partition by ja, jb, b0) - 1) / 2.0 as rb from pt)
select ja as judge_a, jb as judge_b, round(corr(a0, b0), 6) as pearson, round(corr(ra, rb), 6) as spearman from r group by 1, 2""")
def pearson_spearman(spark, sf_dir):
    keys = ["rater_a", "rater_b"]
    p = ag.rater_pairs(_totals(spark, sf_dir), ["doc_id"], "judge")
    both = p.groupBy(*keys).agg(ag.pearson(F.col("a"), F.col("b")).alias("pearson")).join(ag.spearman(p, keys), keys)
    return both.select(F.col("rater_a").alias("judge_a"), F.col("rater_b").alias("judge_b"), F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"))


@query(f"""with {_TOTALS_SQL}, x as (select cast(score as double) as x, doc_id, judge from totals),
w as (select count(distinct doc_id) as n, count(distinct judge) as k, sum(x) as s, sum(x * x) as ss from x),
tt as (select sum(t * t) as tt from (select sum(x) as t from x group by doc_id)), rr as (select sum(r * r) as rr from (select sum(x) as r from x group by judge)),
q as (select n, k, ss, s * s / (n * k) as base, tt / k - s * s / (n * k) as ssr, rr / n - s * s / (n * k) as ssc from w, tt, rr),
z as (select n, k, ssr / (n - 1) as msr, ssc / (k - 1) as msc, (ss - base - ssr - ssc) / ((n - 1) * (k - 1)) as mse from q)
select n, k, round((msr - mse) / (msr + (k - 1) * mse + k * (msc - mse) / n), 6) as icc from z""")
def icc_totals(spark, sf_dir):
    return ag.icc21(_totals(spark, sf_dir).withColumnRenamed("judge", "rater"), "doc_id").select("n", "k", F.round("icc", 6).alias("icc"))


@query("""select v as value, case when v is null then 'no calculable' when v < 0 then 'pobre (peor que el azar)' when v <= 0.20 then 'leve' when v <= 0.40 then 'aceptable' when v <= 0.60 then 'moderado'
  when v <= 0.80 then 'sustancial' else 'casi perfecto' end as words, count(*) as n from (select round((doc_id % 130 - 20) / 100.0, 2)::double as v from documents) group by 1, 2""")
def landis_koch(spark, sf_dir):
    v = table(spark, sf_dir, "documents").select(F.round((F.col("doc_id") % 130 - 20) / 100.0, 2).alias("value"))
    return v.select("value", ag.interpret_kappa(F.col("value")).alias("words")).groupBy("value", "words").agg(F.count("*").alias("n"))


@query(f"with {PAIRS_SQL}, q as (select ja, jb, {_QWK} as q from pairs group by 1, 2) select round(avg(q), 6) as mean, count(q) as pairs from q")
def pairwise_mean(spark, sf_dir):
    return ag.mean_pairwise(ag.agreement_table(_pairs(spark, sf_dir), ["rater_a", "rater_b"])).select(F.round("mean", 6).alias("mean"), "pairs")


@query(f"with {PAIRS_SQL} select doc_id, ja as judge_a, jb as judge_b, count(*) as n, round({_QWK}, 6) as qwk from pairs group by grouping sets ((ja, jb), (ja, jb, doc_id))")
def human_baseline(spark, sf_dir):
    """Kappa of each pair of raters over all items, and by document, in one pass over the pairs."""
    p = _pairs(spark, sf_dir).select("doc_id", F.col("rater_a").alias("judge_a"), F.col("rater_b").alias("judge_b"), "a", "b")
    return p.groupingSets([["judge_a", "judge_b"], ["judge_a", "judge_b", "doc_id"]], "judge_a", "judge_b", "doc_id").agg(F.count("*").alias("n"), F.round(ag.qwk(F.col("a"), F.col("b")), 6).alias("qwk")).select("doc_id", "judge_a", "judge_b", "n", "qwk")


@query(f"with {VOTES_SQL} select doc_id, item, quantile_disc(score, 0.5) as lower_median, cast(median(score) as double) as median from votes group by 1, 2")
def juror_medians(spark, sf_dir):
    return ag.juror_medians(votes(spark, sf_dir), ["doc_id", "item"])


@query("""with p as (select quality as a, cast(case when n_chars > 900 then 1 else 0 end as int) as b, lang from labels join documents using (doc_id))
select lang, a as quality, b as long_text, count(*) as n from p group by 1, 2, 3""")
def label_confusion(spark, sf_dir):
    p = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return p.groupBy("lang", "quality", (F.col("n_chars") > 900).cast("int").alias("long_text")).agg(F.count("*").alias("n"))


@query(f"with p as (select quality as a, toxic as b, source from labels join documents using (doc_id)) select source, count(*) as n, round({_QWK}, 6) as qwk, round(avg((a = b)::int), 6) as exact from p group by 1")
def label_agreement(spark, sf_dir):
    p = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").withColumnsRenamed({"quality": "a", "toxic": "b"})
    return p.groupBy("source").agg(F.count("*").alias("n"), F.round(ag.qwk(F.col("a"), F.col("b")), 6).alias("qwk"), F.round(ag.exact(F.col("a"), F.col("b")), 6).alias("exact"))


_REPS = 2000


def _projects(spark, sf_dir):
    """Rated pairs by source, a null one being a project of its own."""
    sources = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("<null>")).alias("source"))
    return ag.project_sums(_pairs(spark, sf_dir).join(sources, "doc_id"), ["rater_a", "rater_b"], "source")


@query(f"""with {PAIRS_SQL}, s as (select coalesce(d.source, '<null>') as source, ja, jb, count(*) as n, sum(a) as sa, sum(b) as sb, sum(a * a) as saa, sum(b * b) as sbb, sum(a * b) as sab
  from pairs join documents d using (doc_id) group by 1, 2, 3),
p as (select source, row_number() over (order by source) as k from (select distinct source from s)),
w as (select rep, source, (rep * 7 + k * 13 + (rep * k) % 11) % 4 as w from range(0, {_REPS}) r(rep), p),
e as (select ja, jb, rep, 1 - (sum(w * saa) + sum(w * sbb) - 2.0 * sum(w * sab)) / nullif(sum(w * saa) + sum(w * sbb) - 2.0 * sum(w * sa) * sum(w * sb) / nullif(sum(w * n), 0), 0) as q from s join w using (source) group by 1, 2, 3)
select ja as judge_a, jb as judge_b, round(quantile_cont(q, 0.025), 6) as low, round(quantile_cont(q, 0.975), 6) as high, count(q) as replicates from e where q is not null group by 1, 2""")
def bootstrap_interval(spark, sf_dir):
    """Percentile interval of each pair's kappa over resampled sources, with weights that SQL can compute."""
    sums = _projects(spark, sf_dir)
    ranked = ag.numbered(sums, "project")[0].withColumn("k", F.col("k") + 1)
    rep = F.explode(F.sequence(F.lit(0), F.lit(_REPS - 1))).alias("rep")
    weights = ranked.select("project", "k", rep).select("rep", "project", ((F.col("rep") * 7 + F.col("k") * 13 + F.col("rep") * F.col("k") % 11) % 4).cast("double").alias("w"))
    out = ag.bootstrap_qwk(sums, weights, ["rater_a", "rater_b"])
    return out.select(F.col("rater_a").alias("judge_a"), F.col("rater_b").alias("judge_b"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "replicates")


@query()
def bootstrap_seeded(spark, sf_dir):
    """The same with 2000 replicates, each drawn by a generator of its own under seed 42."""
    sums = _projects(spark, sf_dir)
    return ag.bootstrap_qwk(sums, ag.Resamples(sums, _REPS), ["rater_a", "rater_b"])


def _study(spark, sf_dir):
    """Judge 1 as the system, the others as jurors."""
    v = votes(spark, sf_dir).where("score is not null").select(F.col("doc_id").alias("project"), "item_id", F.col("judge").cast("string").alias("rater"), "score")
    return v.where("rater = '1'").drop("rater"), v.where("rater <> '1'")


_FIXED_QWK = "1 - sum((a - b) * (a - b)) / nullif(sum(a * a) + sum(b * b) - 2.0 * sum(a) * sum(b) / count(*), 0)"
_STUDY_SQL = VOTES_SQL + """, v as (select doc_id, item, judge, score from votes where score is not null),
j as (select doc_id, item, quantile_disc(score, 0.5) as b from v where judge <> 1 group by 1, 2), i as (select v.score as a, j.b from v join j using (doc_id, item) where judge = 1),
jt as (select doc_id, median(t) as b from (select doc_id, judge, sum(score) as t from v where judge <> 1 group by 1, 2) group by 1), t as (select x.a, jt.b from (select doc_id, sum(score) as a from v where judge = 1 group by 1) x join jt using (doc_id))"""


@query(f"with {VOTES_SQL} select cast(y.judge as varchar) as rater, count(*) as n_items, round({_FIXED_QWK}, 6) as qwk, round(avg((a = b)::int), 6) as exact, round(avg((abs(a - b) <= 1)::int), 6) as adjacent "
       "from (select doc_id, item, score as a from votes where judge = 1 and score is not null) x join (select doc_id, item, judge, score as b from votes where judge <> 1 and score is not null) y using (doc_id, item) group by 1")
def validation_by_juror(spark, sf_dir):
    return validation.against_jurors(*_study(spark, sf_dir)).select("rater", "n_items", *[F.round(c, 6).alias(c) for c in ("qwk", "exact", "adjacent")])


@query(f"with {_STUDY_SQL}, r as (select count(*) as n_items, round({_FIXED_QWK}, 6) as qwk_items, round(avg((a = b)::int), 6) as exact, round(avg((abs(a - b) <= 1)::int), 6) as adjacent from i) "
       "select r.*, n_projects, mae_totals, pearson from r, (select count(*) as n_projects, round(avg(abs(a - b)), 6) as mae_totals, round(corr(a, b), 6) as pearson from t)")
def validation_by_median(spark, sf_dir):
    rounded = ("qwk_items", "exact", "adjacent", "mae_totals", "pearson")
    return validation.against_median(*_study(spark, sf_dir)).select("n_items", "n_projects", *[F.round(c, 6).alias(c) for c in rounded])


@query(f"with {VOTES_SQL}, p as (select a.judge as ja, b.judge as jb, a.score as a, b.score as b from votes a join votes b on a.doc_id = b.doc_id and a.item = b.item and a.judge < b.judge where a.score is not null and b.score is not null), "
       f"{_dense('p')} select cast(ja as varchar) as judge_a, cast(jb as varchar) as judge_b, count(*) as n, round({_QWK}, 6) as qwk from d group by 1, 2")
def panel_internal(spark, sf_dir):
    v = votes(spark, sf_dir).select(F.col("doc_id").alias("project"), "item_id", F.col("judge").cast("string").alias("judge"), F.col("score").cast("string").alias("level"))
    return validation.panel_agreement(v).withColumn("qwk", F.round("qwk", 6))


@query()
def validation_report(spark, sf_dir):
    system, jurors = _study(spark, sf_dir)
    v = votes(spark, sf_dir).select(F.col("doc_id").alias("project"), "item_id", F.col("judge").cast("string").alias("judge"), F.col("score").cast("string").alias("level"))
    return validation.report(system, jurors, v, ag.Resamples(system, _REPS))


@query(f"""with {PAIRS_SQL}, {_dense('pairs')} select ja as run_a, jb as run_b, count(*) as n, round({_QWK}, 6) as qwk, round(100 * avg(same::int), 2) as identical_pct from d group by 1, 2""")
def retest_runs(spark, sf_dir):
    runs = votes(spark, sf_dir).select(F.col("judge").alias("run"), F.col("doc_id").alias("project"), "item_id", "score")
    return ag.retest(runs).withColumn("qwk", F.round("qwk", 6))


@query(f"with {_TOTALS_SQL} select doc_id as project, round(stddev_pop(score), 3) as sd, count(*) as runs from totals group by 1")
def retest_spread(spark, sf_dir):
    return ag.run_spread(votes(spark, sf_dir).select(F.col("judge").alias("run"), F.col("doc_id").alias("project"), F.coalesce("score", F.lit(0)).alias("score")))


@query("select user_id, event_id, event_type from (select *, max(ts) over (partition by user_id) as top from events) where ts = top")
def latest_evaluation(spark, sf_dir):
    """Newest events of each user; ties stay."""
    return store.latest_per_project(table(spark, sf_dir, "events"), "user_id", "ts").select("user_id", "event_id", "event_type")


@query("""select user_id, max_by(event_type, (ts, event_id)) filter (event_type <> 'click') as state, round(max_by(value, (ts, event_id)) filter (value > 10), 6) as total from events group by 1""")
def state_log_coalesce(spark, sf_dir):
    """Partial updates folded: the last value that is not null of each column."""
    log = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("at"), F.when(F.col("event_type") != "click", F.col("event_type")).alias("state"), F.when(F.col("value") > 10, F.col("value")).alias("total"))
    return store.current_state(log, "user_id", "at", ["state", "total"]).select("user_id", "state", F.round("total", 6).alias("total"))


@query(f"""with {VOTES_SQL}, {_MEDIANS} select v.doc_id, v.item_id, string_agg('juez' || cast(judge as varchar) || '=' || coalesce(cast(score as varchar), 'None'), '|' order by judge) as votes,
  cast(coalesce(max(m.spread) >= 2, false) as int) as flagged from votes v join m on m.doc_id = v.doc_id and m.item = v.item group by 1, 2""")
def items_csv_shape(spark, sf_dir):
    from gradeloom.sources.files import items_csv

    return items_csv(panel.consolidate(_scale_votes(spark, sf_dir), "scale")).select(F.col("eval_id").alias("doc_id"), "item_id", "votes", "flagged")


@query(f"with {VOTES_SQL}, {_MEDIANS} select doc_id, cast(sum(coalesce(median, 0)) as double) as total, cast(sum(coalesce(median, 0)) filter (section_id = 'S01') as double) as sub_S01, cast(sum(coalesce(median, 0)) filter (section_id = 'S02') as double) as sub_S02 from m group by 1")
def consolidated_pivot(spark, sf_dir):
    from gradeloom.sources.files import consolidated

    s = section_subtotals(spark, sf_dir).withColumnRenamed("doc_id", "eval_id")
    return consolidated(s.groupBy("eval_id").agg(F.sum("subtotal").alias("total")), s, ["S01", "S02"]).withColumnRenamed("eval_id", "doc_id")


_ASCII = r"[\x20\x09-\x0D]+"
_TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '[a-záéíóúñü]+')"


@query(f"select doc_id, cast(len(list_filter(regexp_split_to_array(coalesce(text, ''), '{_ASCII}'), lambda w: w <> '')) as int) as words, cast(len({_TOKENS}) as int) as letter_tokens from documents")
def word_stats(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", tx.n_words(t).alias("words"), F.size(tx.letter_tokens(t)).alias("letter_tokens"))


@query(f"select doc_id, case when len({_TOKENS}) >= 50 then round(len(list_distinct({_TOKENS})) / len({_TOKENS}), 4) end as ttr from documents")
def ttr(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.type_token_ratio(tx.letter_tokens(F.coalesce("text", F.lit("")))).alias("ttr"))


@query(f"""with s as (select doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[.!?]+(?:[\\x20\\x09-\\x0D]|$)'), lambda s: len(list_filter(regexp_split_to_array(s, '{_ASCII}'), lambda w: w <> ''))), lambda n: n >= 3) as n from documents)
select doc_id, case when len(n) > 0 then round(list_sum(n) / len(n), 2) end as mean_sentence_words from s""")
def sentence_length(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.mean_sentence_words(F.col("text")).alias("mean_sentence_words"))


_SYLL = "(len(regexp_extract_all(lower(coalesce(text, '')), '[aeiouáéíóúü]+')) + len(regexp_extract_all(lower(coalesce(text, '')), '[aeoáéó][íú]|[íú][aeoáéó]')))"
_SENT = r"greatest(1, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[.!?]+(?:[\x20\x09-\x0D]|$)'), lambda s: regexp_replace(s, '[\x20\x09-\x0D]+', '', 'g') <> '')))"


_WORDS = f"len(list_filter(regexp_split_to_array(coalesce(text, ''), '{_ASCII}'), lambda w: w <> ''))"


@query(f"""with r as (select doc_id, {_WORDS} as words, len({_TOKENS})::double as w, {_SYLL}::double as y, {_SENT} as s from documents),
e as (select doc_id, case when words >= 30 then round(206.84 - 60.0 * coalesce(y / nullif(w, 0), 0) - 1.02 * (w / s), 2) end as ease from r)
select doc_id, ease, case when ease is null then null when ease >= 90 then 'muy fácil' when ease >= 80 then 'fácil' when ease >= 70 then 'algo fácil' when ease >= 60 then 'normal'
  when ease >= 50 then 'algo difícil' when ease >= 30 then 'difícil' else 'muy difícil' end as band from e""")
def readability_band(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", tx.readability(F.coalesce("text", F.lit(""))).alias("ease"))
    return d.select("doc_id", "ease", tx.ease_band(F.col("ease")).alias("band"))


@query()
def mtld(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", tx.letter_tokens(F.coalesce("text", F.lit(""))).alias("t"))
    return d.select("doc_id", F.when(F.size("t") >= 50, textstats.mtld(F.col("t"))).alias("mtld"))


@query(f"with {VOTES_SQL} select doc_id, round(count(*) filter (n > 0) / count(*), 4) as completeness, cast(coalesce(sum(n) filter (n > 0), 0) as bigint) as words from (select doc_id, section_id, count(score) - 8 as n from votes group by 1, 2) group by 1")
def completeness(spark, sf_dir):
    s = votes(spark, sf_dir).groupBy("doc_id", "section_id").agg((F.count("score") - 8).alias("words")).withColumn("present", F.col("words") > 0)
    return textstats.completeness(s)


_MAIL = "[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\\.[A-Za-z0-9_.-]*[A-Za-z0-9_]"


@query(f"select doc_id, sha256(regexp_replace(coalesce(text, ''), '{_MAIL}', '[CORREO]', 'g')) as redacted_sha256 from documents")
def redact_emails(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(redact.redact_emails(F.coalesce("text", F.lit(""))), 256).alias("redacted_sha256"))


@query(f"select lang, cast(sum(len(regexp_extract_all(coalesce(text, ''), '{_MAIL}'))) as bigint) as emails, count(*) filter (regexp_matches(coalesce(text, ''), '{_MAIL}')) as docs from documents group by 1")
def redaction_counts(spark, sf_dir):
    n = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_MAIL), F.lit(0)))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(n).alias("emails"), F.count_if(n > 0).alias("docs"))


@query()
def redact_documents(spark, sf_dir):
    """Numbered placeholders over each document as a single page, and what was replaced."""
    pages = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page_no"), "text")
    clean, reports, _ = redact.redact(pages)
    total = F.aggregate(F.map_values("counts"), F.lit(0), lambda a, v: a + v)
    return clean.join(reports, "doc_id").select("doc_id", F.length("text").alias("n_chars"), total.alias("replaced"), F.size("warnings").alias("warnings"))


@query("select conv_id, row_number() over (partition by conv_id order by turn) as n, turn, role from conversations")
def turns_order(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("n"), "turn", "role")


@query("select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn desc) as n from conversations) where n = 1")
def conversation_latest(spark, sf_dir):
    return store.upsert_last(table(spark, sf_dir, "conversations"), ["conv_id"], "turn").select("conv_id", "turn", "role")


@query("""with q as (select conv_id, turn, sha256(role || chr(1) || text) as request_id from conversations),
d as (select request_id, min((conv_id, turn)) as k from q group by 1), r as (select distinct request_id from q where (conv_id * 7 + turn) % 3 = 0)
select request_id from d where request_id not in (select request_id from r)""")
def requests_pending(spark, sf_dir):
    q = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(F.concat("role", F.lit("\x01"), "text"), 256).alias("request_id"))
    answers = q.where("(conv_id * 7 + turn) % 3 = 0").select("request_id", F.lit(200).alias("status"), F.lit(None).cast("string").alias("error"))
    return store.pending(q, answers).select("request_id")


@query("""with c as (select conv_id, turn, length(text) as tokens, sum(length(text)) over (partition by conv_id order by turn rows unbounded preceding) as s, row_number() over (partition by conv_id order by turn) as n from conversations)
select conv_id, turn, tokens from c where s <= 900 or n = 1""")
def token_budget_cut(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("tokens"))
    return panel.prefix_within_budget(c, 900, ["conv_id"], ["turn"])


_PRICES = [("user", 0.15, 0.60), ("assistant", 2.5, 10.0)]
_PRICES_SQL = "prices(model, usd_in, usd_out) as (values ('user', 0.15, 0.60), ('assistant', 2.5, 10.0))"


@query(f"""with {_PRICES_SQL}, c as (select conv_id, role, length(text) as ti, turn + 1 as tout from conversations)
select conv_id as eval_id, cast(sum(ti) as bigint) as tokens_in, cast(sum(tout) as bigint) as tokens_out, case when bool_or(role = 'assistant') then round(sum(ti * usd_in + tout * usd_out), 0)::double / 1e6 end as usd
from c left join prices on model = role group by 1""")
def cost_rollup(spark, sf_dir):
    calls = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("eval_id"), F.col("role").alias("model"), F.when(F.col("role") == "assistant", "judge").otherwise("other").alias("role"), F.length("text").cast("long").alias("tokens_in"), (F.col("turn") + 1).cast("long").alias("tokens_out"))
    return panel.cost_rollup(calls, spark.createDataFrame(_PRICES, "model string, usd_in double, usd_out double"))


@query(f"""with {_PRICES_SQL}, r as (select role as model, count(*) as requests, cast(sum(length(text) + 200) as bigint) as tokens_in from conversations group by 1)
select r.model, requests, tokens_in, requests * 900 as tokens_out, round((tokens_in * usd_in + requests * 900 * usd_out) / 1e6 * 0.5, 6) as usd from r left join prices p on p.model = r.model""")
def batch_cost(spark, sf_dir):
    r = table(spark, sf_dir, "conversations").select(F.col("role").alias("model"), F.length("text").cast("long").alias("tokens"))
    return store.batch_cost(r, spark.createDataFrame(_PRICES, "model string, usd_in double, usd_out double"))


@query("""with prices(model, usd_in, usd_out) as (values ('user', 1, 4), ('assistant', 3, 12)), c as (select conv_id, turn, role, case when turn % 2 = 0 then 'argument' else 'coherence' end as analysis, length(coalesce(text, '')) as n, turn + 1 as tout,
case when length(coalesce(text, '')) % 17 = 0 then 'failed at ' || turn end as error from conversations),
calls as (select c.*, round((n * usd_in + tout * usd_out) / 1e6, 6) as usd from c left join prices on model = role),
a as (select conv_id, analysis, bool_or(error is not null) as bad, arg_min(error, turn) filter (error is not null) as error, string_agg(n::varchar, ',' order by turn) as vals, sum(n) as ti, sum(tout) as tout, round(sum(usd), 6) as usd from calls group by 1, 2),
s as (select conv_id, max(case when analysis = 'argument' and not bad then vals end) as argument, max(case when analysis = 'argument' then error end) as argument_error,
max(case when analysis = 'coherence' and not bad then vals end) as coherence, max(case when analysis = 'coherence' then error end) as coherence_error,
sum(case when bad then 0 else ti end) as ti, sum(case when bad then 0 else tout end) as tout, sum(case when not bad then usd end) as usd from a group by 1)
select c.conv_id as eval_id, count(*) as score, cast(any_value(s.ti) + count(*) as bigint) as tokens_in, cast(any_value(s.tout) as bigint) as tokens_out, any_value(s.usd) is null as unpriced, cast(round(coalesce(any_value(s.usd), 0) * 1e6) as bigint) as micro_usd,
any_value(argument) as argument, any_value(argument_error) as argument_error, any_value(coherence) as coherence, any_value(coherence_error) as coherence_error from c join s using (conv_id) group by 1""")
def isolated_analyses(spark, sf_dir):
    """Scores of all conversations with two analyses of their turns, some of whose calls failed."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    n = F.length("text")
    calls = rows.select(
        F.col("conv_id").alias("eval_id"), F.when(F.col("turn") % 2 == 0, "argument").otherwise("coherence").alias("analysis"), F.col("turn").alias("pos"), F.col("role").alias("model"), n.cast("string").alias("value"),
        F.when(n % 17 == 0, F.concat(F.lit("failed at "), F.col("turn").cast("string"))).alias("error"), n.cast("long").alias("tokens_in"), (F.col("turn") + 1).cast("long").alias("tokens_out"),
    )
    # Whole prices: no call costs half a millionth, which Spark and the oracle round apart.
    prices = spark.createDataFrame([("user", 1.0, 4.0), ("assistant", 3.0, 12.0)], "model string, usd_in double, usd_out double")
    found = analyses.outcomes(calls, prices)
    scores = rows.groupBy(F.col("conv_id").alias("eval_id")).agg(F.count("*").alias("score"), F.count("*").alias("tokens_in"), F.lit(0).cast("long").alias("tokens_out"), F.lit(None).cast("double").alias("usd"))
    out = analyses.attach(scores, found, ["argument", "coherence"])
    joined = [F.when(F.col(c).isNotNull(), F.array_join(c, ",")).alias(c) for c in ("argument", "coherence")]
    return out.select("eval_id", "score", "tokens_in", "tokens_out", F.col("usd").isNull().alias("unpriced"), F.round(F.coalesce("usd", F.lit(0.0)) * 1e6).cast("long").alias("micro_usd"), *joined, "argument_error", "coherence_error")


_NOTICES = ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "under the"]
_NOTICES_SQL = ["(?i)" + r"\s+(?:\d{1,3}\s+)?".join(w.replace(".", r"\.") for w in p.split()) for p in _NOTICES]


def _notices_sql() -> str:
    steps = "".join(f", s{i + 1} as (select doc_id, n_pages, n_removed + len(regexp_extract_all(t, '{p}')) as n_removed, regexp_replace(t, '{p}', ' ', 'g') as t from s{i})" for i, p in enumerate(_NOTICES_SQL))
    return f"""with p as (select doc_id, coalesce(text, '') as text, unnest(range(greatest(1, (length(coalesce(text, '')) + 299) // 300))) as i from documents),
s0 as (select doc_id, count(*) as n_pages, 0 as n_removed, string_agg(substr(text, i * 300 + 1, 300), chr(12) order by i) as t from p group by 1){steps}
select doc_id, n_pages, n_removed, sha256(regexp_replace(t, '[ \\t\\n\\r\\f]', '', 'g')) as rest_sha256 from s{len(_NOTICES_SQL)}"""


@query(_notices_sql())
def template_phrases(spark, sf_dir):
    """Licence notices taken out of all documents, cut into pages of 300 characters that notices run across."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    each = docs.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.length("text") / 300)).cast("int") - 1)).alias("page_no"))
    pages = each.select("doc_id", "page_no", F.substring("text", F.col("page_no") * 300 + 1, F.lit(300)).alias("text"))
    clean = template.strip_phrases(pages, _NOTICES)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda x: x["text"]), "")
    return clean.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.max("n_removed").alias("n_removed"), F.sha2(F.regexp_replace(whole, r"[ \t\n\r\f]", ""), 256).alias("rest_sha256"))


@query("""with s as (select a.vec_id as query_id, b.vec_id as passage_id, list_dot_product(a.embedding::double[], b.embedding::double[]) as similarity from embeddings a, embeddings b where a.vec_id % 100 = 0),
r as (select *, row_number() over (partition by query_id order by similarity desc, passage_id) as rank from s) select query_id, passage_id, round(similarity, 6) as similarity, rank from r where rank <= 2""")
def passages_topk(spark, sf_dir):
    """The two nearest vectors, exactly, of every vector whose id is divisible by 100."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("passage_id"), F.col("embedding").alias("vector"))
    q = e.where("passage_id % 100 = 0").withColumnRenamed("passage_id", "query_id")
    return library.nearest(q, e).select("query_id", "passage_id", F.round("similarity", 6).alias("similarity"), "rank")


@query()
def passages_probed(spark, sf_dir):
    """The same through an index of all vectors that is built first; it finds nine in ten of them and more."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("passage_id"), F.col("embedding").alias("vector"))
    folder = new_folder(spark, "passages")
    vectors.build(e.where(F.size("vector") == F.lit(64)), folder)
    q = e.where("passage_id % 100 = 0").withColumnRenamed("passage_id", "query_id")
    return vectors.search(spark, folder, q).select("query_id", "passage_id", F.round("similarity", 6).alias("similarity"), "rank")


@query("select source as book, cast(count(*) as bigint) as fragments from documents group by 1")
def fragments_per_book(spark, sf_dir):
    return library.fragments_per_book(table(spark, sf_dir, "documents").withColumnRenamed("source", "book"))


@query()
def library_chunks(spark, sf_dir):
    """Passages of every document, as a library is filled."""
    pages = table(spark, sf_dir, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("page"), "text")
    return library.chunks(pages).select("id", "book", "page", F.length("text").alias("n_chars"))


_PAGES = [
    (1, 1, "PROYECTO DE TESIS\nAUTOR: Ana Pérez\n1. Título\nSistema de riego"), (1, 2, "ÍNDICE\n1. Título ...... 1\n2. Problema ...... 3"),
    (1, 3, "1.1. Problema central del estudio\nEl riego falla.\n1.2. Formulación de problema\n¿Cómo se riega?"), (1, 4, "texto .... 3\notro .... 5\nfin ..... 9\nREFERENCIAS\nRamos, A. (2015). Riego."),
    (2, 1, "2. Objetivos\nObjetivo general: medir.\nJustificación"), (2, 2, "esto es una línea de prosa muy larga que no parece un encabezado porque pasa de noventa letras y sigue\nANEXOS"),
]
_ALIASES = [("S01", 1, "titulo"), ("S02", 2, "problema"), ("S02", 2, "formulacion del problema"), ("S03", 3, "objetivos"), ("S03", 3, "objetivo general"), ("S05", 5, "justificacion")]
_PAGES_SQL = "pages(doc_id, page_no, text) as (select doc_id, 1, coalesce(text, '') from documents union all values " + ", ".join(f"({-d}, {p}, '{t}')" for d, p, t in _PAGES) + ")"


def _pages(spark, sf_dir):
    """Every document as one page, and some pages of a thesis."""
    own = spark.createDataFrame([(-d, p, t) for d, p, t in _PAGES], "doc_id long, page_no int, text string")
    return table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page_no"), "text").unionByName(own)


@query(f"""with {_PAGES_SQL}, l as (select doc_id, page_no, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') as ls from pages)
select doc_id, page_no, len(list_filter(ls[1:8], lambda x: regexp_matches(lower(x), '^\\s*([ií]ndice|tabla de contenido|contenido)s?\\b'))) > 0 or len(list_filter(ls, lambda x: regexp_matches(x, '\\.{{2,}}\\s*\\d{{1,4}}\\s*$'))) >= 3 as is_toc from l""")
def toc_pages(spark, sf_dir):
    return segment.toc_pages(_pages(spark, sf_dir))


@query()
def heading_candidates(spark, sf_dir):
    return segment.headings(_pages(spark, sf_dir)).select("doc_id", "line_idx", "heading", "number", "label")


_NAMES = ("problema central", "objetivo", "formulacion de problema", "el problema de hoy", "titulo")
_LOOKED_FOR = ("titulo", "problema", "formulacion de problema", "objetivos", "objetivo general", "justificacion")


@query("with s(section_id, n) as (select cast(doc_id as varchar), regexp_replace(lower(string_split(coalesce(text, ''), chr(10))[1]), '[^a-z ]', '', 'g') from documents union all values " + ", ".join(f"('-{i}', '{n}')" for i, n in enumerate(_NAMES)) + """)
select s.section_id, a.alias, case when s.n = a.alias then 3 when starts_with(s.n, a.alias) and length(s.n) <= length(a.alias) + 30 then 2 when starts_with(a.alias, s.n) and length(s.n) >= 6 then 2
  when contains(' ' || s.n || ' ', ' ' || a.alias || ' ') and length(s.n) <= length(a.alias) + 45 then 1 else 0 end as score from s, (values """ + ", ".join(f"('{a}')" for a in _LOOKED_FOR) + ") a(alias)")
def alias_scores(spark, sf_dir):
    """The first line of every document, and some headings, against aliases."""
    first = F.regexp_replace(F.lower(F.get(F.split(F.coalesce("text", F.lit("")), "\n"), F.lit(0))), "[^a-z ]", "")
    s = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("section_id"), first.alias("n"))
    s = s.unionByName(spark.createDataFrame([(f"-{i}", n) for i, n in enumerate(_NAMES)], "section_id string, n string"))
    return s.select("section_id", "n", F.explode(F.array(*map(F.lit, _LOOKED_FOR))).alias("alias")).select("section_id", "alias", segment.alias_score(F.col("n"), F.col("alias")).alias("score"))


@query()
def segment_documents(spark, sf_dir):
    aliases = spark.createDataFrame(_ALIASES, "section_id string, pos int, alias string")
    sections = spark.createDataFrame([("S01", "Título", 1), ("S02", "Problema", 2), ("S03", "Objetivos", 3), ("S05", "Justificación", 5)], "section_id string, name string, pos int")
    return segment.index_report(segment.segment(_pages(spark, sf_dir), aliases, sections))


_CITES = [(-1, "garcía", "2020"), (-1, "lópez", "2019"), (-1, "ramos", "2024"), (-2, "díaz", "2021")]
_REFS = [(-1, "garcía", "2020"), (-1, "zéniz ramos", "2024"), (-1, "torres", "2018"), (-2, "díaz", "2020")]


@query("with c(doc_id, s, y) as (select doc_id, lang || ' ' || coalesce(source, 'anon'), cast(2000 + n_chars % 20 as varchar) from documents union all values " + ", ".join(map(str, _CITES)) + """),
r(doc_id, s, y) as (select doc_id, coalesce(source, 'anon'), cast(2000 + (n_chars + doc_id % 2) % 20 as varchar) from documents union all values """ + ", ".join(map(str, _REFS)) + """)
select doc_id, s as surname, y as year from c where not exists (select 1 from r where r.doc_id = c.doc_id and r.y = c.y and (r.s = c.s or len(list_intersect(list_filter(string_split(r.s, ' '), lambda t: length(t) >= 3), list_filter(string_split(c.s, ' '), lambda t: length(t) >= 3))) > 0))""")
def citations_unmatched(spark, sf_dir):
    """A citation and a reference made of each document's columns, and some of a thesis."""
    d, kind = table(spark, sf_dir, "documents"), "doc_id long, surname string, year string"
    who, year = F.coalesce("source", F.lit("anon")), lambda n: (2000 + n % 20).cast("string").alias("year")
    cited = d.select("doc_id", F.concat("lang", F.lit(" "), who).alias("surname"), year(F.col("n_chars")))
    listed = d.select("doc_id", who.alias("surname"), year(F.col("n_chars") + F.col("doc_id") % 2))
    return textstats.unmatched(cited.unionByName(spark.createDataFrame(_CITES, kind)), listed.unionByName(spark.createDataFrame(_REFS, kind)))


@query()
def citation_reports(spark, sf_dir):
    """Citations and references of every whole text."""
    return textstats.citation_report(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"), F.col("text").alias("full_text")))


@query("select core, minor, case when core = 0 then case when minor = 0 then 5 when minor = 1 then 4 else 3 end when core = 1 then case when minor <= 1 then 3 else 2 end when core = 2 then 2 else 1 end as note "
       "from (select doc_id % 4 as core, (doc_id // 4) % 4 as minor from documents) group by 1, 2")
def coherence_note(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 4).alias("core"), F.expr("(doc_id div 4) % 4").alias("minor")).distinct()
    return d.select("core", "minor", argue.coherence_note(F.col("core"), F.col("minor")).alias("note"))


@query("""with f as (select conv_id as doc_id, turn as sentence_id, case (conv_id + turn) % 6 when 0 then 'afirmacion' when 1 then 'dato' when 2 then 'garantia' when 3 then 'respaldo' when 4 then 'refutacion' else 'ninguno' end as f, turn - 1 as ans from conversations),
c as (select doc_id, count(*) filter (f = 'afirmacion') as a, count(*) filter (f in ('dato', 'garantia', 'respaldo')) as g, count(*) filter (f = 'refutacion') as r, count(*) filter (f = 'refutacion' and ans >= 0) as ok,
  count(distinct f) filter (f <> 'ninguno') as parts from f group by 1)
select doc_id, parts as parts, round(parts / 6.0, 3) as index, case when a = 0 then 0 when g = 0 then 1 when r = 0 then 2 when ok = 0 then 3 when ok = 1 then 4 else 5 end as level from c""")
def toulmin_level(spark, sf_dir):
    names = F.array(*map(F.lit, ("afirmacion", "dato", "garantia", "respaldo", "refutacion", "ninguno")))
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("sentence_id"), "turn")
    labels = c.select("doc_id", "sentence_id", F.element_at(names, ((F.col("doc_id") + F.col("turn")) % 6 + 1).cast("int")).alias("function"), (F.col("turn") - 1).alias("answered_in"), F.col("turn").alias("pos"))
    sentences = c.select("doc_id", "sentence_id", F.lit("una frase").alias("sentence"))
    return argue.argument_scores(labels, sentences).select("doc_id", F.col("parts").cast("long").alias("parts"), "index", "level")


@query("select user_id as evaluation_id, max_by(event_type, (ts, event_id)) as last_kind, count(*) as events from events group by 1")
def progress_last_status(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("evaluation_id"), F.col("event_type").alias("kind"), F.struct("ts", "event_id").alias("ts"))
    return progress.last_status(e).select("evaluation_id", "last_kind", "events")


@query("select time_bucket(interval '1 hour', ts) as start, event_type as kind, count(*) as n from events group by 1, 2")
def progress_counts(spark, sf_dir):
    """Events by kind and hour: an extension, in batch what the stream computes."""
    e = table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("kind"))
    return progress.counts_by_window(e, "1 hour").select(F.col("window.start").alias("start"), "kind", "n")


_EPISODES_SQL = """with e as (select cast(user_id as varchar) as evaluation_id, case when event_type = 'signup' then 'escuchar' else event_type end as kind, ts, cast(event_id as varchar) as detail from events where user_id is not null and ts is not null),
o as (select *, coalesce(sum((kind = 'purchase')::int) over (partition by evaluation_id order by ts, kind, detail rows between unbounded preceding and 1 preceding), 0) as ends from e where kind <> 'escuchar'),
a as (select *, lag(ts) over w as before, row_number() over w as seq from o where ends = 0 window w as (partition by evaluation_id order by ts, kind, detail)),
p as (select *, coalesce(ts > before + interval 6 hour, false) as gap, sum(coalesce(ts > before + interval 6 hour, false)::int) over (partition by evaluation_id order by seq) as episode from a)
select evaluation_id, 'event' as status, kind, detail, ts, cast(episode as int) as episode, cast(seq as int) as seq from p
union all select evaluation_id, 'idle', null, null, before + interval 6 hour, cast(episode - 1 as int), cast(seq - 1 as int) from p where gap
union all select e.evaluation_id, 'replay', p.kind, p.detail, e.ts, cast(episode as int), cast(seq as int) from e join p using (evaluation_id) where e.kind = 'escuchar' and p.kind = 'purchase' and e.ts > p.ts"""


@query(_EPISODES_SQL)
def progress_episodes(spark, sf_dir):
    """Users' events as evaluations' progress: purchases end one, signups listen, six hours are a pause."""
    kind = F.when(F.col("event_type") == "signup", progress.LISTEN).otherwise(F.col("event_type"))
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("evaluation_id"), kind.alias("kind"), "ts", F.col("event_id").cast("string").alias("detail"))
    return progress.progress_log(e, ("purchase",), 6 * 3600)


_SENT = "conv_id % 4 <> 3"
_BATCH = "case conv_id % 5 when 0 then 'completed' when 1 then 'failed' when 2 then 'expired' when 3 then case when role = 'user' then 'in_progress' else 'completed' end else 'cancelled' end"
_REQUESTS_SQL = f"""with q as (select *, cast(conv_id as varchar) || ':' || cast(turn as varchar) as request_id, conv_id * 1000 + turn as pos, cast(length(coalesce(text, '')) as bigint) as tokens from conversations where conv_id is not null and turn is not null),
r as (select request_id, min_by(role, (pos, role)) as model, min_by(tokens, (pos, role)) as tokens, min(pos) as pos, bool_or({_SENT}) as went, min_by({_BATCH}, (pos, role)) as status,
  bool_or(conv_id % 5 = 0 and turn % 3 <> 1) as replied, bool_or(conv_id % 5 = 0 and turn % 3 <> 1 and conv_id % 2 = 0) as good from q group by 1),
s as (select *, case when replied and good then 'answered' when replied then 'failed' when went and status not in ('failed', 'expired', 'cancelled') then 'in flight' else 'pending' end as state from r),
u as (select *, sum(tokens + 2500) over w as upto, row_number() over w as n from s where state = 'pending' and model not in (select coalesce(role, '') from q where {_SENT} and {_BATCH} = 'in_progress') window w as (partition by model order by pos, request_id))
select s.request_id, s.model, s.state, cast(s.went::int as bigint) as attempts, coalesce(u.n = 1 or u.upto <= 1000000, false) as send from s left join u using (request_id)"""


@query(_REQUESTS_SQL)
def batch_requests(spark, sf_dir):
    """Turns as requests of their role: what became of each, and which go out next."""
    q = table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null")
    q = q.withColumns({"request_id": F.expr("concat(conv_id, ':', turn)"), "pos": F.expr("conv_id * 1000 + turn"), "tokens": F.length(F.coalesce("text", F.lit(""))).cast("long"), "_status": F.expr(_BATCH)})
    new = q.groupBy("request_id").agg(F.min_by(F.struct(F.col("role").alias("model"), "tokens", "pos", "conv_id", "turn", "_status", F.col("role")), F.struct("pos", "role")).alias("_q")).select("request_id", "_q.*")
    log = requests.record(spark.createDataFrame([], requests.REQUESTS), new.withColumn("body", F.lit("{}")))
    sent = new.where(_SENT).select(F.expr("concat_ws('-', role, conv_id % 5, _status)").alias("batch_id"), "request_id", F.lit(None).cast("timestamp").alias("sent_at"))
    batches = new.where(_SENT).select(F.expr("concat_ws('-', role, conv_id % 5, _status)").alias("batch_id"), "model", F.col("_status").alias("status")).distinct()
    answers = new.where("conv_id % 5 = 0 and turn % 3 <> 1").select("request_id", F.expr("case when conv_id % 2 = 0 then 200 else 500 end").alias("status"), F.lit(None).cast("string").alias("error"), F.lit("{}").alias("body"))
    known = requests.states(log, sent, batches, answers)
    going = requests.next_batch(known, batches).select("request_id", F.lit(True).alias("send"))
    return known.join(going, "request_id", "left").select("request_id", "model", "state", F.col("attempts").cast("long").alias("attempts"), F.coalesce("send", F.lit(False)).alias("send"))


_SHOWN = "case when q is null then 'NA' else printf('%.3f', round_even(q, 3)) end"
_WORDS_OF = "case when q is null then 'no calculable' when q < 0 then 'pobre (peor que el azar)' when q <= 0.20 then 'leve' when q <= 0.40 then 'aceptable' when q <= 0.60 then 'moderado' when q <= 0.80 then 'sustancial' else 'casi perfecto' end"


@query(f"""with {VOTES_SQL}, v as (select doc_id, item, judge as rater, score from votes where score is not null),
p as (select x.rater as ja, y.rater as jb, x.score as a, y.score as b from v x join v y on x.doc_id = y.doc_id and x.item = y.item and x.rater < y.rater),
i as (select ja, jb, {_FIXED_QWK} as q from p group by 1, 2),
s as (select doc_id, rater, sum(score) as t from v group by 1, 2), st as (select x.rater as ja, y.rater as jb, x.t as a, y.t as b from s x join s y on x.doc_id = y.doc_id and x.rater < y.rater), {_dense('st')},
t as (select ja, jb, case when count(*) >= 2 then {_QWK} end as q from d group by 1, 2)
select concat(ja, '|', jb) as par, (select {_SHOWN} from (select i.q as q)) as qwk_items_global, (select {_WORDS_OF} from (select i.q as q)) as interpretacion, (select {_SHOWN} from (select t.q as q)) as qwk_totales
from i left join t using (ja, jb)""")
def juror_pair_report(spark, sf_dir):
    """The table of pairs of jurors as it is written, with all three judges as jurors."""
    v = votes(spark, sf_dir).where("score is not null").select(F.col("doc_id").alias("project"), "item_id", F.col("judge").cast("string").alias("rater"), "score")
    return reports.juror_pair_rows(v)


@query(f"""with {_TOTALS_SQL}, k as (select doc_id from totals group by 1 having count(distinct judge) = (select count(distinct judge) from totals))
select doc_id as proyecto_id, sum(score) filter (judge = 1)::double as total_corrida1, sum(score) filter (judge = 2)::double as total_corrida2, sum(score) filter (judge = 3)::double as total_corrida3,
  round(stddev_pop(score), 3) as desviacion_estandar from totals join k using (doc_id) group by 1""")
def retest_totals(spark, sf_dir):
    runs = votes(spark, sf_dir).select(F.col("judge").alias("run"), F.col("doc_id").alias("project"), "item_id", F.coalesce("score", F.lit(0)).alias("score"))
    return reports.retest_total_rows(runs, [1, 2, 3])


_PART_SQL = f"""parts as (select doc_id, coalesce(text, '') as full_text, k as pos, 'S' || cast(k as varchar) as section_id, 'Parte ' || cast(k as varchar) as name,
  array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)), lambda l, i: (i - 1) % 3 = k), chr(10)) as text from documents, range(0, 3) r(k)),
sections as (select *, len(list_filter(regexp_split_to_array(text, '{_ASCII}'), lambda w: w <> '')) as words from parts)"""
_PART_WORDS = 40


def _parts(spark, sf_dir):
    """Each document's lines dealt out to three sections; those of 40 words and more are there."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("full_text"))
    lines = d.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("pos"), F.split("full_text", "\n").alias("lines"))
    text = F.array_join(F.filter("lines", lambda line, i: i % 3 == F.col("pos")), "\n")
    s = lines.select("doc_id", "pos", F.concat(F.lit("S"), F.col("pos").cast("string")).alias("section_id"), F.concat(F.lit("Parte "), F.col("pos").cast("string")).alias("name"), text.alias("text"))
    return d, s.withColumn("words", tx.n_words(F.col("text"))).withColumn("present", F.col("words") >= _PART_WORDS)


@query(f"""with {_PART_SQL}, b as (select doc_id, any_value(full_text) as full_text, coalesce(string_agg(text, chr(10) || chr(10) order by pos) filter (words >= {_PART_WORDS}), '') as joined,
  string_agg(section_id || '=' || cast(words as varchar), '|' order by pos) as section_words, count(*) filter (words >= {_PART_WORDS}) as sections_present, count(*) as n from sections group by doc_id),
f as (select *, case when joined = '' then full_text else joined end as body from b)
select doc_id, section_words, sections_present, round(sections_present / n, 4) as completeness, sha256(body) as body_sha256, len(list_filter(regexp_split_to_array(body, '{_ASCII}'), lambda w: w <> '')) as words from f""")
def document_bodies(spark, sf_dir):
    """Words by section, completeness and the body that all measures of a document are taken from."""
    shown = F.array_join(F.transform("section_words", lambda s: F.concat_ws("=", s["section_id"], s["words"].cast("string"))), "|")
    return textstats.bodies(*_parts(spark, sf_dir)).select("doc_id", shown.alias("section_words"), "sections_present", "completeness", F.sha2("body", 256).alias("body_sha256"), tx.n_words(F.col("body")).alias("words"))


@query(f"""with {_PART_SQL} select doc_id, sha256(string_agg('[' || section_id || ' ' || name || ']' || chr(10) || case when section_id = 'S1' then text else substring(text, 1, 1500) end, chr(10) || chr(10) order by pos)) as context_sha256
from sections where words >= {_PART_WORDS} group by 1""")
def cross_cutting_texts(spark, sf_dir):
    """What judges of cross-cutting dimensions read of each document: one section whole, of the others 1500 characters."""
    _, sections = _parts(spark, sf_dir)
    return invoke.cross_cutting(sections, ["S1"]).select("doc_id", F.sha2("context", 256).alias("context_sha256"))


@query(f"with {_PART_SQL} select doc_id, count(*) filter (words >= {_PART_WORDS}) as present, count(*) as sections, greatest(max(words), 1) as most_words from sections group by 1")
def index_counts(spark, sf_dir):
    return reports.index_counts(_parts(spark, sf_dir)[1])


@query(f"""with {VOTES_SQL}, {_MEDIANS}, s as (select doc_id, string_agg('juez' || cast(judge as varchar) || '=' || coalesce(cast(score as varchar), 'None'), '|' order by judge) as votes, section_id, item from votes group by doc_id, section_id, item)
select doc_id as project_id, 'r' as rubric_id, 'complete' as mode, section_id as seccion_id, 'Sección ' || section_id as seccion, 'i' || cast(item as varchar) as item_id, coalesce(cast(median as varchar), '0') as nivel_final,
  coalesce(median, 0)::double as puntaje, 3.0::double as puntaje_max, cast(coalesce(spread >= 2, false) as int) as discrepancia, votes as niveles_jueces,
  row_number() over (partition by doc_id order by section_id, item) as orden from m join s using (doc_id, section_id, item)""")
def items_export(spark, sf_dir):
    """The item table of every document; texts of judges, which the votes lack, are left out."""
    heads = spark.createDataFrame([("r", "S01", 1, "Sección S01"), ("r", "S02", 2, "Sección S02")], "rubric_id string, section_id string, pos int, name string")
    v = _scale_votes(spark, sf_dir)
    evals = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("eval_id"), F.col("doc_id").alias("project_id"), F.lit("r").alias("rubric_id"), F.lit("complete").alias("mode"))
    status = evals.select("eval_id", F.explode(F.array(F.lit("S01"), F.lit("S02"))).alias("section_id"), F.lit("open").alias("state"))
    scored = panel.item_scores(items(spark).select("section_id", "item_id", "pos", "weight", "partial"), panel.consolidate(v, "scale"), status, "scale")
    return reports.item_export(scored, evals, heads).drop("evidencia", "observacion")
