"""The artefact store: insert, rewrite, versions, crashes and writers that collide."""

import json

import pytest
from pyspark.sql import functions as F

from gradeloom.operators import artefacts


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.fixture
def root(spark, tmp_path):
    projects = spark.createDataFrame([("p1", "uno.pdf", "pdf"), ("p2", "dos.docx", "docx"), ("p3", "tres", "pdf")], "project_id string, name string, kind string")
    pages = spark.createDataFrame([("p1", 1, "una página con\nseis palabras, contadas"), ("p1", 2, None), ("p2", 1, "dos palabras")], "project_id string, page_no int, text string")
    index = spark.createDataFrame([("p1", "S01", "Título", True, "Título", 1, 1, 6)], artefacts.TABLES["index"][1])
    mapping = spark.createDataFrame([("p1", "[AUTOR_1]", "Ana"), ("p2", "[AUTOR_1]", "Eva")], artefacts.TABLES["mapping"][1])
    folder = str(tmp_path / "store")
    assert artefacts.save_projects(spark, folder, projects, pages, index, mapping) == 1
    evals = spark.createDataFrame([(f"e{i}", f"p{i}", "r", "completa") for i in (1, 2)], "evaluation_id string, project_id string, rubric_id string, mode string")
    assert artefacts.start_evaluations(spark, folder, evals) == 2
    return folder


def marks(spark, *given):
    return spark.createDataFrame(given, "evaluation_id string, state string, total double, level string, error string")


def results(spark, **bodies):
    return spark.createDataFrame(list(bodies.items()), "evaluation_id string, body string")


def test_projects_are_counted_and_names_kept_apart(spark, root):
    assert rows(artefacts.load(spark, root, "projects"), "project_id", "pages", "words") == [("p1", 2, 6), ("p2", 1, 2), ("p3", 0, 0)]
    assert rows(artefacts.mapping_of(spark, root, spark.createDataFrame([("p1",)], "project_id string")), "original") == [("Ana",)]
    for name in set(artefacts.TABLES) - {"mapping"}:
        assert "Ana" not in str(artefacts.load(spark, root, name).collect())
    assert artefacts.load(spark, root, "projects", 0).count() == 0
    with pytest.raises(ValueError):
        artefacts.load(spark, root, "projects", 9)


def test_marks_keep_what_they_do_not_name(spark, root):
    artefacts.mark(spark, root, marks(spark, ("e1", "ejecutando", None, None, None), ("nobody", "error", None, None, None)))
    v = artefacts.mark(spark, root, marks(spark, ("e1", "completada", 71.5, "Bueno", None)), results(spark, e1="{}", nobody="{}"))
    artefacts.mark(spark, root, marks(spark, ("e2", "error", None, None, "no text"), ("e1", None, None, None, "late")))
    got = rows(artefacts.load(spark, root, "evaluations"), "evaluation_id", "state", "total", "level", "error")
    assert got == [("e1", "completada", 71.5, "Bueno", "late"), ("e2", "error", None, None, "no text")]
    assert rows(artefacts.load(spark, root, "evaluations", v), "evaluation_id", "state", "error") == [("e1", "completada", None), ("e2", "pendiente", None)]
    assert rows(artefacts.load(spark, root, "results"), "evaluation_id") == [("e1",)]


def test_rewrite_keeps_the_first_body_and_old_versions(spark, root):
    v = artefacts.mark(spark, root, marks(spark, ("e1", "completada", 1.0, None, None)), results(spark, e1="first"))
    artefacts.rewrite(spark, root, results(spark, e1="second", unknown="x"))
    artefacts.rewrite(spark, root, results(spark, e1="third"))
    body = lambda name, version=None: rows(artefacts.load(spark, root, name, version), "evaluation_id", "body")
    assert body("results") == [("e1", "third")] and body("backups") == [("e1", "first")] and body("results", v) == [("e1", "first")]


def test_a_crash_between_write_and_commit_changes_nothing(spark, root):
    artefacts.mark(spark, root, marks(spark, ("e1", "completada", 1.0, None, None)), results(spark, e1="first"))
    before = artefacts.versions(spark, root)

    def crash():
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        artefacts.rewrite(spark, root, results(spark, e1="lost"), before_rename=crash)
    assert artefacts.versions(spark, root) == before and rows(artefacts.load(spark, root, "results"), "body") == [("first",)]
    assert artefacts.rewrite(spark, root, results(spark, e1="second")) == before[-1] + 1
    assert artefacts.vacuum(spark, root, keep=1) > 0
    assert artefacts.versions(spark, root) == [before[-1] + 1] and rows(artefacts.load(spark, root, "results"), "body") == [("second",)]
    assert artefacts.load(spark, root, "pages").count() == 3


def test_of_two_writers_one_loses(spark, root):
    base = artefacts.versions(spark, root)[-1]

    def other():
        artefacts.merge(spark, root, {"results": results(spark, e2="other").withColumn("written_at", F.lit(None).cast("timestamp"))}, base)

    with pytest.raises(artefacts.Conflict):
        artefacts.merge(spark, root, {"results": results(spark, e2="mine").withColumn("written_at", F.lit(None).cast("timestamp"))}, base, before_rename=other)
    assert rows(artefacts.load(spark, root, "results"), "body") == [("other",)]


def test_completing_results_one_by_one(spark, root):
    bodies = {"e1": {"argumentacion": {}, "coherencia_global": {}}, "e2": {"argumentacion": None}}
    artefacts.mark(spark, root, marks(spark, ("e1", "completada", 1.0, None, None), ("e2", "completada", 1.0, None, None)), results(spark, **{e: json.dumps(b) for e, b in bodies.items()}))
    asked = spark.createDataFrame([("e1",), ("e2",), ("e9",), ("e2",)], "evaluation_id string")
    analysed = lambda df: df.select("evaluation_id", F.concat("body", F.lit("+")).alias("body"), F.when(F.col("evaluation_id") == "e1", "ERROR x").alias("error"))
    _, status = artefacts.complete_results(spark, root, asked, analysed)
    assert rows(status, "evaluation_id", "status") == [("e1", "complete before"), ("e2", "completed"), ("e9", "unknown")]
    _, status = artefacts.complete_results(spark, root, asked, analysed, force=True)
    assert rows(status, "evaluation_id", "status") == [("e1", "ERROR x"), ("e2", "completed"), ("e9", "unknown")]
    assert rows(artefacts.load(spark, root, "backups"), "evaluation_id", "body") == [("e2", json.dumps(bodies["e2"]))]
    assert dict(rows(artefacts.load(spark, root, "results"), "evaluation_id", "body"))["e2"].endswith("++")


def test_only_parts_that_hold_a_changed_row_are_written_again(spark, root):
    parts = lambda: {p for n, p in artefacts._manifest(spark, root, artefacts.versions(spark, root)[-1]) if n == "evaluations"}
    first = parts()
    artefacts.start_evaluations(spark, root, spark.createDataFrame([("e3", "p3", "r", "completa")], "evaluation_id string, project_id string, rubric_id string, mode string"))
    assert len(parts()) == 2 and first < parts()
    artefacts.mark(spark, root, marks(spark, ("e3", "error", None, None, "x")))
    assert len(parts()) == 2 and first < parts()
    assert artefacts.load(spark, root, "evaluations").count() == 3


def test_ids_have_a_prefix(spark):
    got = [r.id for r in artefacts.new_ids(spark.range(50).select(F.col("id").alias("n")), "id", "proj").collect()]
    assert len(set(got)) == 50 and all(g.startswith("proj_") and len(g) == 17 for g in got)
