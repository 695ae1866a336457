"""A versioned store of projects and evaluations: snapshot tables under one commit pointer.

Each commit writes immutable Parquet parts, a folder a table; a manifest of the next number names, for each
table, the parts that are its rows. Rows that change cost their parts again, not their table. The manifest is written to a folder of its own and then renamed to its number,
which fails where that number is there: readers see whole versions only, and of two writers one loses and
raises. A crash before the rename leaves parts that no version names; ``vacuum`` removes them.

The tables of people's data are kept apart: ``mapping`` (placeholders and what they stand for) is read
by ``mapping_of`` alone, never with a project. A rewrite of a result first keeps the old one, once, in
``backups``. Nothing of a table passes through the driver; it handles the manifest, a row a part.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "name string, part string"
#: The tables and what identifies a row; a later commit's row takes the place of an earlier one of its key.
TABLES = {
    "projects": ("project_id", "project_id string, name string, kind string, pages int, words long, uploaded_at timestamp"),
    "pages": ("project_id, page_no", "project_id string, page_no int, text string"),
    "index": ("project_id, section_id", "project_id string, section_id string, name string, present boolean, heading string, page_no int, last_page int, words int"),
    "mapping": ("project_id, placeholder", "project_id string, placeholder string, original string"),
    "evaluations": ("evaluation_id", "evaluation_id string, project_id string, rubric_id string, mode string, state string, total double, level string, error string, created_at timestamp"),
    "results": ("evaluation_id", "evaluation_id string, body string, written_at timestamp"),
    "backups": ("evaluation_id", "evaluation_id string, body string, written_at timestamp"),
}
STATES = ("pendiente", "ejecutando", "completada", "error")


class Conflict(RuntimeError):
    """Another writer has made this version."""


def _path(spark: SparkSession, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def _files(spark: SparkSession, root: str):
    return _path(spark, root).getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    fs, at = _files(spark, root), _path(spark, f"{root}/versions")
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n) for n in names if n.isdigit())


def _manifest(spark: SparkSession, root: str, version: int) -> list[tuple[str, str]]:
    return [tuple(r) for r in spark.read.schema(MANIFEST).parquet(f"{root}/versions/{version:08d}").collect()] if version else []


def load(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """A table as of a version (the newest unless given; 0 is empty before any commit)."""
    known = versions(spark, root)
    version = (known[-1] if known else 0) if version is None else version
    if version and version not in known:
        raise ValueError(f"no version {version}")
    parts = [f"{root}/parts/{part}" for table, part in _manifest(spark, root, version) if table == name]
    schema = TABLES[name][1]
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)


def _columns(name: str) -> list[str]:
    return [c.split()[0] for c in TABLES[name][1].split(", ")]


def commit(spark: SparkSession, root: str, changes: dict[str, DataFrame], base: int, dropped: tuple[str, ...] = (), before_rename: Callable[[], None] | None = None) -> int:
    """Write the next version after ``base``: a part of rows is added to each table, the ``dropped`` parts are left out.

    Raises Conflict if that version is there. ``before_rename`` is called when all parts are written: for tests.
    """
    kept = [(name, part) for name, part in _manifest(spark, root, base) if part not in dropped]
    for name, rows in changes.items():
        part = f"{name}-{uuid.uuid4().hex}"
        kinds = dict(c.split() for c in TABLES[name][1].split(", "))
        rows.select(*[F.col(c).cast(kind).alias(c) for c, kind in kinds.items()]).write.parquet(f"{root}/parts/{part}")
        kept.append((name, part))
    fs, written = _files(spark, root), f"{root}/written/{uuid.uuid4().hex}"
    spark.createDataFrame(kept, MANIFEST).coalesce(1).write.parquet(written)
    if before_rename:
        before_rename()
    final = _path(spark, f"{root}/versions/{base + 1:08d}")
    fs.mkdirs(_path(spark, f"{root}/versions"))
    if fs.exists(final) or not fs.rename(_path(spark, written), final):
        raise Conflict(f"version {base + 1} is there already")
    return base + 1


def merge(spark: SparkSession, root: str, changes: dict[str, DataFrame], base: int | None = None, **how) -> int:
    """A commit in which rows take the place of those of their keys; of a key's new rows one stays.

    Only parts that hold such a key are written again; they are found by their key columns alone.
    """
    known = versions(spark, root)
    base = (known[-1] if known else 0) if base is None else base
    manifest, whole, dropped = _manifest(spark, root, base), {}, []
    for name, rows in changes.items():
        keys, schema = TABLES[name][0].split(", "), TABLES[name][1]
        fresh = rows.select(*_columns(name)).dropDuplicates(keys)
        read = lambda parts: spark.read.schema(schema).parquet(*[f"{root}/parts/{p}" for p in parts])  # noqa: B023, E731
        parts = [part for table, part in manifest if table == name]
        touched = []
        if parts:
            file = F.regexp_extract(F.col("_metadata.file_path"), "/parts/([^/]+)/", 1)
            touched = [r.part for r in read(parts).select(*keys, file.alias("part")).join(fresh.select(*keys), keys, "left_semi").select("part").distinct().collect()]
        whole[name] = read(touched).join(fresh.select(*keys), keys, "left_anti").select(*_columns(name)).unionByName(fresh) if touched else fresh
        dropped += touched
    return commit(spark, root, whole, base, tuple(dropped), **how)


def new_ids(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows with an id of their own: the prefix and twelve hex digits. Written once, as ids change when rows are computed again."""
    return rows.withColumn(column, F.concat(F.lit(prefix + "_"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 12)))


def save_projects(spark: SparkSession, root: str, projects: DataFrame, pages: DataFrame, index: DataFrame, mapping: DataFrame) -> int:
    """Add projects (project_id, name, kind) with their redacted pages, index report and placeholders, in one commit; pages and words are counted."""
    sums = pages.groupBy("project_id").agg(F.count("*").alias("pages"), F.sum(F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"(?U)\s+"), lambda w: w != ""))).alias("words"))
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    rows = projects.join(sums, "project_id", "left").withColumns({"pages": F.coalesce("pages", F.lit(0)), "words": F.coalesce("words", F.lit(0)), "uploaded_at": F.lit(now)})
    return merge(spark, root, {"projects": rows, "pages": pages, "index": index, "mapping": mapping})


def mapping_of(spark: SparkSession, root: str, projects: DataFrame) -> DataFrame:
    """What placeholders of some projects stand for: for local tracing, never shown with a project."""
    return load(spark, root, "mapping").join(projects.select("project_id").distinct(), "project_id", "left_semi")


def start_evaluations(spark: SparkSession, root: str, evaluations: DataFrame) -> int:
    """Add evaluations (evaluation_id, project_id, rubric_id, mode), pending and created now."""
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    none = lambda kind: F.lit(None).cast(kind)
    rows = evaluations.withColumns({"state": F.lit(STATES[0]), "total": none("double"), "level": none("string"), "error": none("string"), "created_at": F.lit(now)})
    return merge(spark, root, {"evaluations": rows})


def mark(spark: SparkSession, root: str, marks: DataFrame, results: DataFrame | None = None) -> int:
    """Set states: marks (evaluation_id, state, total, level, error), nulls leaving what is there; results (evaluation_id, body) go along in the same commit.

    Marks of unknown evaluations change nothing, as do their results.
    """
    known = versions(spark, root)
    base = known[-1] if known else 0
    held = load(spark, root, "evaluations", base)
    new = marks.dropDuplicates(["evaluation_id"]).select("evaluation_id", *[F.col(c).alias(f"_{c}") for c in ("state", "total", "level", "error")])
    rows = held.join(new, "evaluation_id").withColumns({c: F.coalesce(f"_{c}", c) for c in ("state", "total", "level", "error")})
    changes = {"evaluations": rows}
    if results is not None:
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        changes["results"] = results.join(held, "evaluation_id", "left_semi").withColumn("written_at", F.lit(now))
    return merge(spark, root, changes, base)


def rewrite(spark: SparkSession, root: str, results: DataFrame, before_rename: Callable[[], None] | None = None) -> int:
    """Put results (evaluation_id, body) in the place of known ones; the first body that a rewrite replaces is kept in backups, in the same commit."""
    known = versions(spark, root)
    base = known[-1] if known else 0
    held, kept = load(spark, root, "results", base), load(spark, root, "backups", base)
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    fresh = results.join(held.select("evaluation_id"), "evaluation_id", "left_semi").withColumn("written_at", F.lit(now))
    backups = held.join(fresh.select("evaluation_id"), "evaluation_id", "left_semi").join(kept.select("evaluation_id"), "evaluation_id", "left_anti")
    return merge(spark, root, {"results": fresh, "backups": backups}, base, before_rename=before_rename)


def complete_results(spark: SparkSession, root: str, asked: DataFrame, analysed: Callable[[DataFrame], DataFrame], force: bool = False) -> tuple[int, DataFrame]:
    """Rewrite results that lack one of their two analyses (all of ``asked`` if forced); (version, a status row for each asked).

    asked: evaluation_id. ``analysed`` takes (evaluation_id, body) and returns (evaluation_id, body, error): a row with an
    error leaves its result as it is and stops no other. Status: completed, complete before, unknown, or the error.
    """
    results = load(spark, root, "results")
    rows = asked.select("evaluation_id").distinct().join(results.select("evaluation_id", "body"), "evaluation_id", "left")
    both = F.get_json_object("body", "$.argumentacion").isNotNull() & F.get_json_object("body", "$.coherencia_global").isNotNull()
    open_ = rows.where(F.col("body").isNotNull() & (F.lit(force) | ~both))
    made = analysed(open_).select("evaluation_id", F.col("body").alias("_new"), F.col("error").alias("_error"))
    folder = f"{root}/written/{uuid.uuid4().hex}"
    made.write.parquet(folder)  # analyses cost, so they run once
    made = spark.read.schema(made.schema).parquet(folder)
    version = rewrite(spark, root, made.where("_error is null and _new is not null").select("evaluation_id", F.col("_new").alias("body")))
    status = rows.join(made, "evaluation_id", "left").select("evaluation_id", F.when(F.col("body").isNull(), "unknown").when(F.col("_error").isNotNull(), F.col("_error")).when(F.col("_new").isNotNull(), "completed").otherwise("complete before").alias("status"))
    return version, status


def vacuum(spark: SparkSession, root: str, keep: int) -> int:
    """Drop all but the newest ``keep`` versions, and what no kept one names; returns how many parts went. No writer may be at work."""
    fs, known = _files(spark, root), versions(spark, root)
    for v in known[:-keep] if keep else known:
        fs.delete(_path(spark, f"{root}/versions/{v:08d}"), True)
    named = {part for v in versions(spark, root) for _, part in _manifest(spark, root, v)}
    at = _path(spark, f"{root}/parts")
    gone = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName() not in named] if fs.exists(at) else []
    for path in [*gone, _path(spark, f"{root}/written")]:
        fs.delete(path, True)
    return len(gone)
