"""Reports of the validation and retest studies, as tables for CSV and as lines of Markdown.

Rows of a report are jurors, pairs of them, pairs of runs or projects; only the tables of
projects grow with the data, and those are written by all tasks. Lines of Markdown are few and
go into one file.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeloom.operators import agreement as ag
from gradeloom.operators import validation
from gradeloom.session import materialise
from gradeloom.sources.files import items_csv, shown, write_csv

LINE = "part int, key string, line string"


def percent_of_max(total: Column, normalised: Column, active_max: Column) -> Column:
    """The total of 100: the normalised one if there is one, else the share of the active maximum; 0 without a maximum."""
    return F.coalesce(normalised, F.when(F.coalesce(active_max, F.lit(0.0)) != 0, F.coalesce(total, F.lit(0.0)) / active_max * 100).otherwise(0.0))


def section_ratio(subtotal: Column, most: Column) -> Column:
    """Share of a section's maximum; 0 without a subtotal or a maximum."""
    return F.coalesce(F.when(most != 0, subtotal / most), F.lit(0.0))


def index_counts(sections: DataFrame) -> DataFrame:
    """(doc_id, present, sections, most_words) of doc_id, present, words; the most words are 1 at least, as bars are drawn by it."""
    return sections.groupBy("doc_id").agg(F.count_if(F.coalesce("present", F.lit(False))).alias("present"), F.count("*").alias("sections"), F.greatest(F.coalesce(F.max("words"), F.lit(1)), F.lit(1)).cast("long").alias("most_words"))


def juror_pair_rows(jurors: DataFrame) -> DataFrame:
    """(par, qwk_items_global, interpretacion, qwk_totales) of each pair of jurors."""
    by = ["rater_a", "rater_b"]
    items, totals = validation.human_baseline(jurors)
    rows = items.where("project is null").join(totals.select(*by, F.col("qwk").alias("_totals")), by, "left")
    return rows.select(F.concat_ws("|", *by).alias("par"), shown(F.col("qwk")).alias("qwk_items_global"), ag.interpret_kappa(F.col("qwk")).alias("interpretacion"), shown(F.col("_totals")).alias("qwk_totales"))


def system_rows(system: DataFrame, jurors: DataFrame) -> DataFrame:
    """(jurado, qwk_items, interpretacion, acuerdo_exacto, acuerdo_adyacente, n_items) of each juror."""
    rows = validation.against_jurors(system, jurors)
    return rows.select(F.col("rater").alias("jurado"), shown(F.col("qwk")).alias("qwk_items"), ag.interpret_kappa(F.col("qwk")).alias("interpretacion"), shown(F.col("exact")).alias("acuerdo_exacto"), shown(F.col("adjacent")).alias("acuerdo_adyacente"), "n_items")


def total_rows(system: DataFrame, jurors: DataFrame) -> DataFrame:
    """(proyecto_id, total_sistema, total_mediana_jurados) of each project that both sides have."""
    return validation.total_pairs(system, jurors).select(F.col("project").alias("proyecto_id"), F.col("a").alias("total_sistema"), F.col("b").cast("double").alias("total_mediana_jurados"))


def _table(part: int, rows: DataFrame, key: str, cells: list[Column | str]) -> DataFrame:
    """Rows as lines of a Markdown table, in the order of ``key``."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    return rows.select(F.lit(part).alias("part"), F.col(key).cast("string").alias("key"), line.alias("line"))


def _said(spark: SparkSession, part: int, *lines: str) -> DataFrame:
    return spark.createDataFrame([(part, f"{i:03d}", line) for i, line in enumerate(lines)], LINE)


def _listed(part: int, one: DataFrame, *lines: Column) -> DataFrame:
    """Lines made of the columns of a table of one row."""
    made = F.array(*[F.struct(F.format_string("%03d", F.lit(i)).alias("key"), line.alias("line")) for i, line in enumerate(lines)])
    return one.select(F.lit(part).alias("part"), F.explode(made).alias("_l")).select("part", "_l.*")


def _header(*names: str) -> tuple[str, str]:
    return "| " + " | ".join(names) + " |", "| " + " | ".join("---" for _ in names) + " |"


def _between(low: Column, high: Column, places: int) -> Column:
    return F.concat(F.lit("["), shown(low, places), F.lit(", "), shown(high, places), F.lit("]"))


def validation_lines(system: DataFrame, jurors: DataFrame, votes: DataFrame, weights: DataFrame, rubric: str, replicates: int) -> DataFrame:
    """(part, key, line) of the study's report, to be read in the order of part and key.

    system, jurors, votes and weights are as ``validation.report`` takes them.
    """
    spark = system.sparkSession
    pairs = materialise(juror_pair_rows(jurors), "pairs")
    median = materialise(validation.against_median(system, jurors), "median")
    bounds = validation.median_intervals(system, jurors, weights).groupBy().pivot("measure", ["qwk_items", "mae_totals"]).agg(F.first("low").alias("low"), F.first("high").alias("high"))
    one = median.withColumn("_one", F.lit(1)).join(bounds.withColumn("_one", F.lit(1)), "_one")
    panel = materialise(validation.panel_agreement(votes), "panel")
    mean = lambda df, c: df.agg(F.avg(F.col(c).try_cast("double")).alias("m"))
    words = lambda c: F.concat(F.lit("**"), shown(c), F.lit("** ("), ag.interpret_kappa(c), F.lit(")"))
    human, _ = validation.human_baseline(jurors)
    parts = [
        _said(spark, 0, "# Validación frente a jurados", ""),
        _listed(1, median, F.concat(F.lit(f"Rúbrica {rubric}; proyectos comunes: "), F.col("n_projects").cast("string"), F.lit(f"; {replicates} remuestreos de proyectos (IC 95 %)"))),
        _said(spark, 2, "", "## Jurados entre sí", "", *_header("Par", "QWK de ítems", "Interpretación", "QWK de totales")),
        _table(3, pairs, "par", [F.replace("par", F.lit("|"), F.lit(" / ")), "qwk_items_global", "interpretacion", "qwk_totales"]),
        _listed(4, mean(human.where("project is null"), "qwk"), F.lit(""), F.concat(F.lit("Promedio de los pares: "), words(F.col("m")))),
        _said(spark, 5, "", "## Sistema frente a jurados", "", *_header("Jurado", "QWK de ítems", "Interpretación", "Acuerdo exacto", "Acuerdo adyacente")),
        _table(6, system_rows(system, jurors), "jurado", ["jurado", "qwk_items", "interpretacion", "acuerdo_exacto", "acuerdo_adyacente"]),
        _table(7, median, "n_projects", [F.lit("mediana"), shown(F.col("qwk_items")), ag.interpret_kappa(F.col("qwk_items")), shown(F.col("exact")), shown(F.col("adjacent"))]),
        _listed(
            8, one, F.lit(""),
            F.concat(F.lit("- QWK de ítems con la mediana: "), words(F.col("qwk_items")), F.lit(" IC 95 % "), _between(F.col("qwk_items_low"), F.col("qwk_items_high"), 3)),
            F.concat(F.lit("- QWK de totales: "), shown(F.col("qwk_totals"))),
            F.concat(F.lit("- Error medio de totales: "), shown(F.col("mae_totals"), 2), F.lit(" IC 95 % "), _between(F.col("mae_totals_low"), F.col("mae_totals_high"), 2)),
            F.concat(F.lit("- Pearson: "), shown(F.col("pearson")), F.lit("; Spearman: "), shown(F.col("spearman"))),
            F.concat(F.lit("- ICC(2,1) de totales: "), shown(F.col("icc"))),
        ),
        _said(spark, 9, "", "## Jueces del sistema entre sí", "", *_header("Par", "QWK", "Interpretación")),
        _table(10, panel.withColumn("par", F.concat_ws(" / ", "judge_a", "judge_b")), "par", ["par", shown(F.col("qwk")), ag.interpret_kappa(F.col("qwk"))]),
        _listed(11, mean(panel, "qwk"), F.lit(""), F.concat(F.lit("Promedio del panel: "), words(F.col("m")))),
    ]
    return reduce(DataFrame.unionByName, parts)


def write_lines(lines: DataFrame, path: str) -> None:
    """The lines of a report in one file; they are as many as there are jurors, judges and runs, not documents."""
    lines.coalesce(1).sortWithinPartitions("part", "key").select("line").write.mode("overwrite").text(path)


def write_validation(system: DataFrame, jurors: DataFrame, votes: DataFrame, weights: DataFrame, rubric: str, replicates: int, path: str) -> None:
    """Three CSV folders and the report under ``path``, named by what the study calls them."""
    write_csv(juror_pair_rows(jurors), f"{path}/qwk_pares_jurados.csv")
    write_csv(system_rows(system, jurors), f"{path}/sistema_vs_jurados.csv")
    write_csv(total_rows(system, jurors), f"{path}/totales.csv")
    write_lines(validation_lines(system, jurors, votes, weights, rubric, replicates), f"{path}/reporte.md")


def _in_all(runs: DataFrame) -> DataFrame:
    """Rows of the projects that every run has."""
    return ag.complete_targets(runs, "project", "run")


def retest_total_rows(runs: DataFrame, run_ids: list) -> DataFrame:
    """(proyecto_id, total_corrida1, ..., desviacion_estandar) of the projects that all runs have.

    runs: run, project, item_id, score. The deviation is that of a whole population, 3 places.
    """
    sums = _in_all(runs).groupBy("project", "run").agg(F.sum("score").cast("double").alias("t"))
    wide = sums.groupBy("project").pivot("run", run_ids).agg(F.first("t"))
    named = wide.select(F.col("project").alias("proyecto_id"), *[F.col(f"`{r}`").alias(f"total_corrida{i}") for i, r in enumerate(run_ids, 1)])
    spread = sums.groupBy(F.col("project").alias("proyecto_id")).agg(F.round(F.stddev_pop("t"), 3).alias("desviacion_estandar"))
    return named.join(spread, "proyecto_id")


def retest_lines(runs: DataFrame, run_ids: list, rubric: str) -> DataFrame:
    """(part, key, line) of the report on how runs repeat each other."""
    spark, both = runs.sparkSession, _in_all(runs)
    pairs = materialise(ag.retest(both), "retest")
    _, _, icc = validation.retest_report(both)
    projects = both.agg(F.count_distinct("project").alias("n"))
    share = F.concat(F.format_string("%.1f", "identical_pct"), F.lit(" %"))
    parts = [
        _said(spark, 0, "# Estabilidad entre corridas", ""),
        _listed(1, projects, F.concat(F.lit(f"Rúbrica {rubric}; {len(run_ids)} corridas; proyectos: "), F.col("n").cast("string"))),
        _said(spark, 2, "", *_header("Corridas", "QWK de ítems", "Interpretación", "Ítems idénticos")),
        _table(3, pairs.withColumn("par", F.concat_ws(" / ", "run_a", "run_b")), "par", ["par", shown(F.col("qwk")), ag.interpret_kappa(F.col("qwk")), share]),
        _listed(4, pairs.agg(F.avg("qwk").alias("q"), F.avg("identical_pct").alias("s")), F.lit(""), F.concat(F.lit("- QWK promedio: **"), shown(F.col("q")), F.lit("**")), F.concat(F.lit("- Ítems idénticos, promedio: **"), shown(F.col("s"), 1), F.lit(" %**"))),
        _listed(5, icc, F.concat(F.lit("- ICC(2,1) de totales: **"), shown(F.col("icc")), F.lit("**"))),
    ]
    return reduce(DataFrame.unionByName, parts)


def write_retest(runs: DataFrame, run_ids: list, rubric: str, path: str) -> None:
    write_csv(retest_total_rows(runs, run_ids), f"{path}/retest_totales.csv")
    write_lines(retest_lines(runs, run_ids, rubric), f"{path}/retest.md")


#: Columns of the table of items, and what they are made of.
ITEM_COLUMNS = {
    "project_id": "project_id", "rubric_id": "rubric_id", "mode": "mode", "seccion_id": "section_id", "seccion": "name", "item_id": "item_id",
    "nivel_final": "level", "puntaje": "points", "puntaje_max": "max_points", "discrepancia": "flagged", "niveles_jueces": "votes",
    "evidencia": "evidence", "observacion": "observation",
}


def item_export(scored: DataFrame, evals: DataFrame, sections: DataFrame) -> DataFrame:
    """One row an item with the thirteen columns of the item table, and ``orden``, its place in its evaluation.

    scored: as ``panel.item_scores`` gives it; evals: eval_id, project_id, rubric_id, mode;
    sections: rubric_id, section_id, pos, name. Votes are k=v|k=v, flags 0 or 1.
    """
    about = evals.select("eval_id", "project_id", "rubric_id", "mode")
    named = sections.select("rubric_id", "section_id", F.col("pos").alias("_section"), "name")
    rows = items_csv(scored.drop("rubric_id", "mode", "name")).join(about, "eval_id").join(named, ["rubric_id", "section_id"], "left")
    place = F.row_number().over(Window.partitionBy("eval_id").orderBy("_section", "section_id", "pos", "item_id"))
    return rows.select(*[F.col(c).alias(n) for n, c in ITEM_COLUMNS.items()], place.alias("orden"))
