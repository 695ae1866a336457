"""Rubrics as tables: from JSON files, and from Markdown sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeloom.functions.text import fold_accents

SCHEMA = """id string, nombre string, tipo string, escala map<string,double>,
secciones array<struct<id:string,nombre:string,puntaje_max:double,aliases:array<string>,
  items:array<struct<id:string,criterio:string,peso:double,parcial:double,referencia:string>>>>,
niveles_calidad array<struct<min:double,max:double,etiqueta:string,accion:string>>,
conversion_vigesimal array<struct<min:int,max:int,nota:int>>"""


def read_rubrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path, multiLine=True)


def rubric_tables(rubrics: DataFrame) -> dict[str, DataFrame]:
    """rubrics, sections, aliases, items, bands and conversion of a table of rubrics."""
    about = rubrics.select(F.col("id").alias("rubric_id"), F.col("nombre").alias("name"), F.col("tipo").alias("kind"), F.col("escala").alias("scale"))
    sections = rubrics.select(F.col("id").alias("rubric_id"), "tipo", F.posexplode("secciones").alias("pos", "s"))
    head = sections.select("rubric_id", F.col("s.id").alias("section_id"), "pos", F.col("s.nombre").alias("name"), F.col("s.puntaje_max").alias("max"))
    aliases = sections.select("rubric_id", F.col("s.id").alias("section_id"), "pos", F.posexplode("s.aliases").alias("alias_pos", "alias"))
    items = sections.select("rubric_id", "tipo", F.col("s.id").alias("section_id"), F.posexplode("s.items").alias("pos", "i"))
    items = items.select("rubric_id", "section_id", F.col("i.id").alias("item_id"), "pos", F.col("i.criterio").alias("criterion"), F.col("i.peso").alias("weight"), F.when(F.col("tipo") != "dicotomica", F.col("i.parcial")).alias("partial"), F.col("i.referencia").alias("reference"))
    bands = rubrics.select(F.col("id").alias("rubric_id"), F.posexplode("niveles_calidad").alias("pos", "b")).select("rubric_id", "pos", F.col("b.min").alias("min"), F.col("b.max").alias("max"), F.col("b.etiqueta").alias("label"), F.col("b.accion").alias("action"))
    conversion = rubrics.select(F.col("id").alias("rubric_id"), F.explode("conversion_vigesimal").alias("c")).select("rubric_id", F.col("c.min").alias("min"), F.col("c.max").alias("max"), F.col("c.nota").alias("grade"))
    return {"rubrics": about, "sections": head, "aliases": aliases, "items": items, "bands": bands, "conversion": conversion}


def _packed(rows: DataFrame, by: list[str], order: str, name: str, fields: dict[str, str]) -> DataFrame:
    """Rows of each key as one array of structs, in the order of a column. A rubric has some hundred rows at most."""
    held = F.struct(F.col(order).alias("_at"), F.struct(*[F.col(c).alias(f) for f, c in fields.items()]).alias("_row"))
    return rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(held)), lambda x: x["_row"]).alias(name))


def rubric_documents(tables: dict[str, DataFrame]) -> DataFrame:
    """The nested rows that ``rubric_tables`` takes apart, made of its tables again; arrays without rows are empty."""
    at = ["rubric_id", "section_id"]
    items = _packed(tables["items"], at, "pos", "items", {"id": "item_id", "criterio": "criterion", "peso": "weight", "parcial": "partial", "referencia": "reference"})
    known = tables["aliases"].groupBy(*at).agg(F.transform(F.array_sort(F.collect_list(F.struct("alias_pos", "alias"))), lambda x: x["alias"]).alias("aliases"))
    heads = tables["sections"].join(known, at, "left").join(items, at, "left")
    none = lambda df, c: F.coalesce(c, F.array().cast(df.schema[c].dataType)).alias(c)
    heads = heads.select(*at, "pos", "name", "max", none(heads, "aliases"), none(heads, "items"))
    sections = _packed(heads, ["rubric_id"], "pos", "secciones", {"id": "section_id", "nombre": "name", "puntaje_max": "max", "aliases": "aliases", "items": "items"})
    bands = _packed(tables["bands"], ["rubric_id"], "pos", "niveles_calidad", {"min": "min", "max": "max", "etiqueta": "label", "accion": "action"})
    grades = _packed(tables["conversion"], ["rubric_id"], "min", "conversion_vigesimal", {"min": "min", "max": "max", "nota": "grade"})
    whole = tables["rubrics"].join(sections, "rubric_id", "left").join(bands, "rubric_id", "left").join(grades, "rubric_id", "left")
    return whole.select(F.col("rubric_id").alias("id"), F.col("name").alias("nombre"), F.col("kind").alias("tipo"), F.col("scale").alias("escala"), none(whole, "secciones"), none(whole, "niveles_calidad"), "conversion_vigesimal")


def write_rubrics(tables: dict[str, DataFrame], path: str) -> None:
    """One JSON file for each rubric, without what is null; ``read_rubrics`` reads the folder."""
    docs = rubric_documents(tables)
    lines = docs.select(F.to_json(F.struct(*docs.columns), {"pretty": "true", "ignoreNullFields": "true"}).alias("value"))
    lines.write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def rubric_catalogue(tables: dict[str, DataFrame]) -> DataFrame:
    """(rubric_id, name, kind, max, sections, items): what there is to choose from."""
    heads = tables["sections"].groupBy("rubric_id").agg(F.sum("max").alias("max"), F.count("*").alias("sections"))
    items = tables["items"].groupBy("rubric_id").agg(F.count("*").alias("items"))
    out = tables["rubrics"].join(heads, "rubric_id", "left").join(items, "rubric_id", "left")
    return out.select("rubric_id", "name", "kind", F.coalesce("max", F.lit(0.0)).alias("max"), F.coalesce("sections", F.lit(0)).alias("sections"), F.coalesce("items", F.lit(0)).alias("items"))


#: How the Markdown sources of rubrics are written.
HEADING = r"^\*\*(\d{1,2})\\?\.\s*(.+?)\s*\\?\[M[áa]ximo:\s*(\d+)\s*pts?\\?\.?\]\*\*\s*$"
REFERENCE = r"^_Referencia:\s*(.+?)_\s*$"
ITEM = r"^\d{1,2}\.\d{1,2}$"
SUBTOTAL = r"\*\*(\d+(?:\.\d+)?)\*\*"
BANDS_TITLE = "ESCALA DE INTERPRETACI"
RANGE, BELOW = r"^(\d+)\s*-\s*(\d+)$", r"(?i)^(?:Menor\s+a|<)\s*(\d+)$"
BLOCK, BLOCK_ITEM = r"^##\s+(.+?)\s*$", r"^0*(\d{1,2})$"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source, line_no, text): trimmed lines of each file, in order."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("source"), "value")
    return whole.select("source", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "text")).withColumn("text", F.trim("text"))


def _unescaped(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\\([\\.\[\]()\-_*])", "$1"))


def _cells(lines: DataFrame) -> DataFrame:
    """Table rows with their cells."""
    cells = F.transform(F.split(F.regexp_replace("text", r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c))
    return lines.where(F.startswith("text", F.lit("|"))).withColumn("cells", cells)


def _since(lines: DataFrame, found: Column, name: str, within: tuple[str, ...] = ()) -> DataFrame:
    """Add the last value of ``found`` up to each line of its source."""
    return lines.withColumn(name, F.last(found, ignorenulls=True).over(Window.partitionBy("source", *within).orderBy("line_no")))


def _condensed(reference: Column) -> Column:
    """The book by its short name, then those parts that name a chapter or pages."""
    parts = F.transform(F.split(F.regexp_replace(reference, r"Hern[áa]ndez-Sampieri\s*\(2018\),?", "HS2018"), ";"), lambda p: F.trim(p))
    useful = F.filter(parts, lambda p, i: (i == 0) | p.contains("Cap.") | p.contains("pp."))
    return F.trim(F.replace(F.array_join(useful, "; "), F.lit("HS2018 ,"), F.lit("HS2018")))


def parse_rubric(lines: DataFrame, three_levels: bool) -> dict[str, DataFrame]:
    """sections, items and warnings of rubrics whose sections are headed by number, name and maximum.

    lines: source, line_no, text. Rows of items have a weight and, with three levels, a partial
    value two cells on. What the source says is never mended; what does not fit is a warning.
    """
    head = F.when(F.col("text").rlike(HEADING), F.struct(F.regexp_extract("text", HEADING, 1).cast("int").alias("number"), _unescaped(F.regexp_extract("text", HEADING, 2)).alias("name"), F.regexp_extract("text", HEADING, 3).cast("double").alias("max")))
    inside = _since(lines.withColumn("_head", head), F.col("_head"), "s").where("s is not null").withColumn("section", F.col("s.number"))
    noted = F.when(F.col("text").rlike(REFERENCE), _condensed(_unescaped(F.regexp_extract("text", REFERENCE, 1))))
    inside = _since(inside, noted, "reference", ("section",))
    sections = inside.where("_head is not null").select("source", F.format_string("S%02d", F.col("section")).alias("section_id"), "section", F.col("s.name").alias("name"), F.col("s.max").alias("max"))
    rows = _cells(inside)
    at = rows.where((F.size("cells") >= (5 if three_levels else 4)) & F.get("cells", F.lit(0)).rlike(ITEM))
    partial = F.get("cells", F.lit(4)).try_cast("double") if three_levels else F.lit(None).cast("double")
    items = at.select("source", F.format_string("S%02d", F.col("section")).alias("section_id"), "section", "line_no", F.get("cells", F.lit(0)).alias("item_id"), _unescaped(F.get("cells", F.lit(1))).alias("criterion"), F.get("cells", F.lit(2)).try_cast("double").alias("weight"), partial.alias("partial"), *([F.col("reference")] if three_levels else []))
    readable = F.col("weight").isNotNull() & (F.col("partial").isNotNull() if three_levels else F.lit(True))
    sums = items.where(readable).groupBy("source", "section_id").agg(F.round(F.sum("weight"), 2).alias("weights"), F.count("*").alias("n"))
    told = sections.join(sums, ["source", "section_id"], "left")
    unread = items.where(~readable).select("source", F.concat("section_id", F.lit(": row "), "item_id", F.lit(" has unreadable numbers")).alias("warning"))
    empty = told.where("n is null").select("source", F.concat("section_id", F.lit(": no items")).alias("warning"))
    off = told.where("weights <> max").select("source", F.concat("section_id", F.lit(": weights add up to "), F.col("weights").cast("string"), F.lit(", maximum "), F.col("max").cast("string")).alias("warning"))
    said = F.regexp_extract(F.get("cells", F.lit(2)), SUBTOTAL, 1).try_cast("double")
    totals = rows.where((F.size("cells") >= 3) & F.upper(F.get("cells", F.lit(1))).contains("SUBTOTAL") & (said != F.col("s.max")))
    totals = totals.select("source", F.concat(F.format_string("S%02d", F.col("section")), F.lit(": subtotal "), said.cast("string"), F.lit(", maximum "), F.col("s.max").cast("string")).alias("warning"))
    astray = items.where(F.substring_index("item_id", ".", 1).cast("int") != F.col("section")).select("source", F.concat(F.lit("item "), "item_id", F.lit(" outside its section "), F.col("section").cast("string")).alias("warning"))
    warnings = unread.union(empty).union(off).union(totals).union(astray)
    return {"sections": sections, "items": items.where(readable), "warnings": warnings}


def parse_bands(lines: DataFrame) -> DataFrame:
    """Bands (source, min, max, label, action) of the table of interpretation; each ends a hundredth below the next higher one."""
    titled = _since(lines, F.when(F.upper("text").contains(BANDS_TITLE), F.lit(True)), "_in").where("_in")
    rows = _cells(titled).where(F.size("cells") >= 3)
    span = F.trim(F.replace(_unescaped(F.get("cells", F.lit(0))), F.lit("**"), F.lit("")))
    low = F.when(span.rlike(RANGE), F.regexp_extract(span, RANGE, 1).try_cast("double")).when(span.rlike(BELOW), 0.0)
    label = F.trim(F.substring_index(_unescaped(F.get("cells", F.lit(1))), " - ", 1))
    rows = rows.select("source", low.alias("min"), F.when(span.rlike(RANGE), F.regexp_extract(span, RANGE, 2).try_cast("double")).otherwise(0.0).alias("_top"), label.alias("label"), _unescaped(F.get("cells", F.lit(2))).alias("action")).where("min is not null")
    above = F.lag("min").over(Window.partitionBy("source").orderBy(F.col("min").desc()))
    return rows.select("source", "min", F.round(F.coalesce(above - 0.01, "_top"), 2).alias("max"), "label", "action")


def parse_form(lines: DataFrame, weight: float = 3.0) -> dict[str, DataFrame]:
    """sections, items and conversion of a form: titled blocks of numbered items, and a table of grades."""
    title = F.when(F.col("text").rlike(BLOCK), F.struct("line_no", F.regexp_extract("text", BLOCK, 1).alias("name")))
    inside = _since(lines.withColumn("_head", title), F.col("_head"), "b").where("b is not null")
    grades = fold_accents(F.col("b.name")).rlike("conversion|vigesimal")
    heads = inside.where(F.col("_head").isNotNull() & ~grades).select("source", F.col("line_no").alias("at"), F.col("b.name").alias("name"))
    heads = heads.withColumn("section_id", F.format_string("B%02d", F.row_number().over(Window.partitionBy("source").orderBy("at"))))
    rows = _cells(inside).where(F.size("cells") >= 2)
    number, second = F.regexp_extract(F.get("cells", F.lit(0)), BLOCK_ITEM, 1), F.get("cells", F.lit(1))
    items = rows.where(~grades & (number != "")).select("source", F.col("b.line_no").alias("at"), number.alias("item_id"), _unescaped(second).alias("criterion"), F.lit(weight).alias("weight"))
    items = items.join(heads.select("source", "at", "section_id"), ["source", "at"]).drop("at")
    span = _unescaped(F.get("cells", F.lit(0)))
    low = F.when(span.rlike(RANGE), F.regexp_extract(span, RANGE, 1).try_cast("int")).when(span.rlike(BELOW), 0)
    high = F.when(span.rlike(RANGE), F.regexp_extract(span, RANGE, 2).try_cast("int")).when(span.rlike(BELOW), F.regexp_extract(span, BELOW, 1).try_cast("int") - 1)
    conversion = rows.where(grades).select("source", low.alias("min"), high.alias("max"), second.try_cast("int").alias("grade")).where("min is not null and grade is not null")
    sections = heads.join(items.groupBy("source", "section_id").agg(F.sum("weight").alias("max")), ["source", "section_id"], "left").select("source", "section_id", "name", F.coalesce("max", F.lit(0.0)).alias("max"))
    return {"sections": sections, "items": items, "conversion": conversion}


def check_weights(items: DataFrame, sections: DataFrame) -> DataFrame:
    """Sections whose weights do not add up to their maximum."""
    sums = items.groupBy("rubric_id", "section_id").agg(F.round(F.sum("weight"), 2).alias("weights"), F.count("*").alias("items"))
    return sections.join(sums, ["rubric_id", "section_id"], "left").where("weights is null or abs(weights - max) > 0.005").select("rubric_id", "section_id", "max", "weights", "items")


