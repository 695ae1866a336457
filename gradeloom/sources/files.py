"""Documents, juror scores and results from files; results, items and tables to files."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.functions.text import clean_invisible

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_FALLBACK = "{http://schemas.openxmlformats.org/markup-compatibility/2006}Fallback"
PAGE_WORDS = 350


def _paragraph(node) -> str:
    out, stack = [], [node]
    while stack:
        at = stack.pop()
        if at.tag == _FALLBACK:
            continue
        if at.tag == f"{_W}t":
            out.append(at.text or "")
        elif at.tag in (f"{_W}tab", f"{_W}br", f"{_W}cr"):
            out.append("\t" if at.tag.endswith("tab") else "\n")
        stack += reversed(list(at))
    return "".join(out)


def docx_lines(content: bytes) -> list[str]:
    """Paragraphs and table rows of the body, in order; cells of a row are joined by bars."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    out = []
    for node in body if body is not None else ():
        if node.tag == f"{_W}p":
            out.append(_paragraph(node))
        elif node.tag == f"{_W}tbl":
            for row in node.findall(f"{_W}tr"):
                cells = ["\n".join(filter(str.strip, map(_paragraph, c.iter(f"{_W}p")))).strip() for c in row.findall(f"{_W}tc")]
                if any(cells):
                    out.append(" | ".join(cells))
    return out


def docx_pages(content: bytes) -> list[str]:
    """Pseudo-pages: one closes as soon as it has 350 words."""
    pages, held, words = [], [], 0
    for line in docx_lines(content):
        held.append(line)
        words += len(line.split())
        if words >= PAGE_WORDS:
            pages.append("\n".join(held))
            held, words = [], 0
    return pages + (["\n".join(held)] if any(map(str.strip, held)) or not pages else [])


def read_documents(spark: SparkSession, path: str, pdf: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """(path, page_no, text, paginated, error) of the .docx and .pdf files of a folder.

    PDFs need a decoder from bytes to pages. A file that fails gives one row with its error.
    """
    files = spark.read.format("binaryFile").load(path).where(F.lower("path").rlike(r"\.(docx|pdf)$")).select("path", "content")

    def run(batches):
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                word = name.lower().endswith(".docx")
                try:
                    if not word and pdf is None:
                        raise ValueError("no PDF decoder was given")
                    pages = docx_pages(content) if word else pdf(content)
                    if not any(p.strip() for p in pages):
                        raise ValueError("no text")
                    rows += [(name, i, p, not word, None) for i, p in enumerate(pages, 1)]
                except Exception as e:  # noqa: BLE001  a broken file must not stop the others
                    rows.append((name, 0, None, not word, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "page_no", "text", "paginated", "error"]).astype({"page_no": "int32"})

    out = files.mapInPandas(run, "path string, page_no int, text string, paginated boolean, error string")
    return out.withColumn("text", clean_invisible(F.col("text")))


def read_jurors(spark: SparkSession, path: str) -> DataFrame:
    """Juror scores from CSV, trimmed; of one (project, juror, item) the last line counts."""
    raw = spark.read.csv(path, header=True)
    clean = raw.select(*[F.trim(F.col(c)).alias(re.sub("^\ufeff", "", c).strip()) for c in raw.columns]).withColumn("_n", F.monotonically_increasing_id())
    last = clean.groupBy("proyecto_id", "jurado_id", "item_id").agg(F.max_by("puntaje", "_n").alias("puntaje"))
    return last.select(F.col("proyecto_id").alias("project"), F.col("jurado_id").alias("rater"), "item_id", F.col("puntaje").cast("int").alias("score"))


RESULT = "project_id string, rubric_id string, secciones array<struct<id:string,items:array<struct<id:string,nivel_final:long>>>>"


def read_results(spark: SparkSession, path: str, rubric: str | None = None) -> DataFrame:
    """Final levels that are integers, not texts, from result files; of one project the last file by name counts."""
    rows = spark.read.schema(RESULT).json(path, multiLine=True).withColumn("_file", F.col("_metadata.file_name"))
    rows = rows if rubric is None else rows.where(F.col("rubric_id") == rubric)
    last = rows.groupBy("project_id").agg(F.max_by("secciones", "_file").alias("secciones"))
    items = last.select(F.col("project_id").alias("project"), F.explode("secciones").alias("s")).select("project", F.explode("s.items").alias("i"))
    return items.where("i.nivel_final is not null").select("project", F.col("i.id").alias("item_id"), F.col("i.nivel_final").cast("int").alias("score"))


def items_csv(scored: DataFrame) -> DataFrame:
    """Item rows as the CSV has them: votes as k=v|k=v (None for a missing one), flags as 0 or 1."""
    votes = F.array_join(F.transform(F.array_sort(F.map_entries("votes")), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("None")))), "|")
    return scored.withColumn("votes", F.coalesce(votes, F.lit(""))).withColumn("flagged", F.col("flagged").cast("int"))


def consolidated(totals: DataFrame, sections: DataFrame, section_ids: list[str]) -> DataFrame:
    """One row a document with a column sub_<section> for each section of the rubric."""
    wide = sections.groupBy("eval_id").pivot("section_id", section_ids).agg(F.first("subtotal"))
    wide = wide.withColumnsRenamed({s: f"sub_{s}" for s in section_ids})
    return totals.join(wide, "eval_id", "left")


#: Columns of the consolidated table, and where they come from.
METRICS = {
    "fernandez_huerta": "ease", "szigriszt_pazos": "perspicuity", "ttr": "ttr", "mtld": "mtld", "palabras_totales": "words",
    "longitud_media_oracion": "mean_sentence_words", "citas_en_texto": "n_citations", "referencias_en_lista": "n_references",
    "n_citas_sin_referencia": "n_unreferenced", "n_referencias_nunca_citadas": "n_uncited", "secciones_presentes": "sections_present",
}
PANEL = {"pct_discrepancia": "disagreement_pct", "n_items_discrepantes": "n_flagged", "panel_incompleto": "incomplete"}
COHERENCE = {"coherencia_global": "note", "contradicciones_nucleo": "core", "contradicciones_menores": "minor"}
DIMENSIONS = ("coherencia_interna", "formalidad_registro", "claridad_tono")


def consolidated_row(base: DataFrame, dimensions: DataFrame, metrics: DataFrame, panel: DataFrame, argument: DataFrame, coherence: DataFrame, argued: tuple[str, ...] = ("S02", "S05")) -> DataFrame:
    """One row a document: ``base`` (see consolidated) with the columns of all analyses; null where one was not run.

    dimensions: eval_id, dimension, median; argument: eval_id, section_id, index, level; the
    others have a row for each eval_id, with the columns that the tables above name.
    """
    voices = dimensions.groupBy("eval_id").pivot("dimension", list(DIMENSIONS)).agg(F.first("median")).withColumnsRenamed({d: f"trans_{d}" for d in DIMENSIONS})
    pick = lambda table, names: table.select("eval_id", *[F.col(c).alias(n) for n, c in names.items()])
    of = lambda c, s: F.max(F.when(F.col("section_id") == s, F.col(c)))
    each = [x for s in argued for x in (of("index", s).alias(f"toulmin_indice_{s}"), of("level", s).alias(f"toulmin_nivel_{s}"))]
    argued_ = argument.groupBy("eval_id").agg(F.round(F.avg("index"), 3).alias("toulmin_indice_proyecto"), *each)
    sides = (voices, pick(metrics, METRICS), pick(panel, PANEL).withColumn("panel_incompleto", F.col("panel_incompleto").cast("int")), argued_, pick(coherence, COHERENCE))
    for side in sides:
        base = base.join(side, "eval_id", "left")
    return base.withColumn("panel_incompleto", F.coalesce("panel_incompleto", F.lit(0)))


def union_rows(frames: list[DataFrame]) -> DataFrame:
    """Rows of tables with different columns, in the order the columns first appear."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_results(docs: DataFrame, path: str) -> None:
    """Result rows as JSON lines; a new version never overwrites an older folder."""
    docs.select(F.to_json(F.struct(*docs.columns)).alias("value")).write.mode("errorifexists").text(path)


def prompts_hash(spark: SparkSession, paths: list[str]) -> DataFrame:
    """First 16 digits of the SHA-256 of the prompts' texts, in the order given."""
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("f"), "value")
    names = F.array(*[F.lit(p.rsplit("/", 1)[-1]) for p in paths])
    ordered = files.agg(F.array_sort(F.collect_list(F.struct(F.array_position(names, F.element_at(F.split("f", "/"), -1)).alias("n"), "value"))).alias("all"))
    return ordered.select(F.substring(F.sha2(F.array_join(F.transform("all", lambda x: x["value"]), ""), 256), 1, 16).alias("prompts_hash"))


def shown(value, places: int = 3):
    """A number with that many places, halves to even, NA where it is undefined."""
    number = value.cast("double")
    return F.when(number.isNull() | F.isnan(number), "NA").otherwise(F.format_string(f"%.{places}f", F.bround(number, places)))
