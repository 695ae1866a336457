import csv
import glob
import hashlib
import statistics

import pytest

from gradeloom.operators import agreement, invoke, redact, reports, textstats, validation
from gradeloom.sources import rubrics

#: Four projects of four items; the second juror takes one off each first item.
LEVELS = {"p1": [3, 2, 1, 0], "p2": [2, 2, 3, 1], "p3": [1, 0, 2, 3], "p4": [3, 3, 2, 2]}


@pytest.fixture(scope="module")
def study(spark):
    system = [(p, f"i{k}", s) for p, levels in LEVELS.items() for k, s in enumerate(levels)]
    jurors = [("J1", *r) for r in system] + [("J2", p, i, max(0, s - (i == "i0"))) for p, i, s in system]
    votes = [(p, i, j, "cumple" if s > 1 or j == "juez2" else "parcial") for p, i, s in system for j in ("juez1", "juez2")]
    s = spark.createDataFrame(system, "project string, item_id string, score int")
    return s, spark.createDataFrame(jurors, "rater string, project string, item_id string, score int"), spark.createDataFrame(votes, "project string, item_id string, judge string, level string")


def rows_of(path):
    out = []
    for name in sorted(glob.glob(f"{path}/*.csv")):
        with open(name, encoding="utf-8") as f:
            out += list(csv.DictReader(f))
    return out


def plain_qwk(a, b, k=4):
    n = len(a)
    seen = sum((x - y) ** 2 for x, y in zip(a, b, strict=True)) / n
    chance = sum((x - y) ** 2 for x in a for y in b) / n**2
    return 1 - seen / chance if chance else float("nan")


def test_validation_is_written_as_three_tables_and_a_report(spark, study, tmp_path):
    system, jurors, votes = study
    weights = agreement.resampled(system, 50)
    reports.write_validation(system, jurors, votes, weights, "ficha", 50, str(tmp_path))
    ours = [s for levels in LEVELS.values() for s in levels]
    theirs = [max(0, s - (k == 0)) for levels in LEVELS.values() for k, s in enumerate(levels)]
    kappa = f"{plain_qwk(ours, theirs):.3f}"
    pairs = rows_of(tmp_path / "qwk_pares_jurados.csv")
    assert list(pairs[0]) == ["par", "qwk_items_global", "interpretacion", "qwk_totales"]
    assert [(r["par"], r["qwk_items_global"], r["interpretacion"]) for r in pairs] == [("J1|J2", kappa, "casi perfecto")]
    found = {r["jurado"]: r for r in rows_of(tmp_path / "sistema_vs_jurados.csv")}
    assert found["J1"] == {"jurado": "J1", "qwk_items": "1.000", "interpretacion": "casi perfecto", "acuerdo_exacto": "1.000", "acuerdo_adyacente": "1.000", "n_items": "16"}
    assert (found["J2"]["qwk_items"], found["J2"]["acuerdo_exacto"]) == (kappa, "0.750")
    totals = {r["proyecto_id"]: (float(r["total_sistema"]), float(r["total_mediana_jurados"])) for r in rows_of(tmp_path / "totales.csv")}
    assert totals == {p: (sum(s), statistics.median([sum(s), sum(s) - (s[0] > 0)])) for p, s in LEVELS.items()}
    (name,) = glob.glob(f"{tmp_path}/reporte.md/*.txt")
    with open(name, encoding="utf-8") as f:
        text = f.read()
    assert text.startswith("# Validación frente a jurados\n\nRúbrica ficha; proyectos comunes: 4; 50 remuestreos")
    assert f"| J1 / J2 | {kappa} | casi perfecto |" in text and "| J1 | 1.000 | casi perfecto | 1.000 | 1.000 |" in text
    assert "- Error medio de totales: 0.50 IC 95 % [0.50, 0.50]" in text
    order = [text.index(t) for t in ("Jurados entre sí", "Promedio de los pares", "Sistema frente", "| mediana |", "ICC(2,1)", "Jueces del sistema", "juez1 / juez2", "Promedio del panel")]
    assert order == sorted(order)


def test_a_study_without_shared_projects_is_an_error(spark, study):
    system, jurors, _ = study
    with pytest.raises(Exception, match="no project has both"):
        validation.against_median(system.where("project = 'p1'"), jurors.where("project = 'p2'")).collect()


def test_retest_tables_leave_out_projects_that_a_run_lacks(spark, tmp_path):
    scores = {1: {"p1": [3, 1], "p2": [2, 2], "p3": [1, 1]}, 2: {"p1": [3, 2], "p2": [2, 2]}, 3: {"p1": [2, 2], "p2": [2, 1], "p3": [0, 0]}}
    rows = [(run, p, f"i{k}", s) for run, of in scores.items() for p, levels in of.items() for k, s in enumerate(levels)]
    reports.write_retest(spark.createDataFrame(rows, "run int, project string, item_id string, score int"), [1, 2, 3], "ficha", str(tmp_path))
    found = {r.pop("proyecto_id"): [float(v) for v in r.values()] for r in rows_of(tmp_path / "retest_totales.csv")}
    sums = {p: [float(sum(scores[r][p])) for r in (1, 2, 3)] for p in ("p1", "p2")}
    assert found == {p: [*t, round(statistics.pstdev(t), 3)] for p, t in sums.items()}
    (name,) = glob.glob(f"{tmp_path}/retest.md/*.txt")
    with open(name, encoding="utf-8") as f:
        text = f.read()
    assert "3 corridas; proyectos: 2" in text and text.count(" %") >= 3 and "ICC(2,1)" in text
    assert "| 1 / 2 |" in text and "| 75.0 % |" in text


@pytest.mark.parametrize("value, places, said", [(0.0625, 3, "0.062"), (2.5, 0, "2"), (None, 3, "NA"), (float("nan"), 2, "NA"), (-0.12345, 3, "-0.123")])
def test_numbers_are_shown_with_halves_to_even(spark, value, places, said):
    from pyspark.sql import functions as F

    from gradeloom.sources.files import shown

    assert spark.createDataFrame([(value,)], "v double").select(shown(F.col("v"), places)).first()[0] == said


def test_shares_without_a_maximum_are_zero(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(50.0, None, 80.0), (50.0, 61.0, 80.0), (50.0, None, 0.0), (None, None, 80.0), (50.0, None, None)], "t double, n double, m double")
    assert [r[0] for r in rows.select(reports.percent_of_max(F.col("t"), F.col("n"), F.col("m"))).collect()] == [62.5, 61.0, 0.0, 0.0, 0.0]
    assert [r[0] for r in rows.select(reports.section_ratio(F.col("t"), F.col("m"))).collect()] == [0.625, 0.625, 0.0, 0.0, 0.0]


def test_index_counts_have_a_least_width(spark):
    rows = spark.createDataFrame([(1, True, 30), (1, False, 0), (2, None, None), (2, False, 0)], "doc_id int, present boolean, words int")
    assert sorted(map(tuple, reports.index_counts(rows).collect())) == [(1, 1, 2, 30), (2, 0, 2, 1)]


RUBRICS = [
    ("a", "Rúbrica A", "tres_niveles", {"cumple": 1.0}, [("S02", "Dos", 2.0, ["dos", "2"], [("2.1", "x", 1.5, 0.5, "pp. 3"), ("2.2", "y", 0.5, None, None)]), ("S01", "Uno", 1.0, [], [("1.1", "z", 1.0, 0.0, None)])], [(50.0, 100.0, "Bueno", "seguir"), (0.0, 49.99, "Bajo", "repetir")], [(0, 40, 8), (41, 100, 15)]),
    ("b", "Rúbrica B", "dicotomica", {"cumple": 1.0, "no_cumple": 0.0}, [("S01", "Uno", 1.0, ["uno"], [("1.1", "z", 1.0, None, None)])], [], None),
]


def test_rubrics_come_back_from_their_files(spark, tmp_path):
    tables = rubrics.rubric_tables(spark.createDataFrame(RUBRICS, rubrics.SCHEMA))
    rubrics.write_rubrics(tables, str(tmp_path / "out"))
    files = glob.glob(f"{tmp_path}/out/*.txt")
    assert len(files) == 2
    back = {r.id: r.asDict(recursive=True) for r in rubrics.read_rubrics(spark, str(tmp_path / "out")).collect()}
    want = {r.id: r.asDict(recursive=True) for r in spark.createDataFrame(RUBRICS, rubrics.SCHEMA).collect()}
    assert back == want
    with open(next(f for f in files if '"b"' in open(f, encoding="utf-8").read()), encoding="utf-8") as f:
        assert "parcial" not in f.read()
    assert sorted(map(tuple, rubrics.rubric_catalogue(tables).collect())) == [("a", "Rúbrica A", "tres_niveles", 3.0, 2, 3), ("b", "Rúbrica B", "dicotomica", 1.0, 1, 1)]


def test_judge_roles_are_blocks_of_their_numbers(spark, tmp_path):
    good = tmp_path / "roles.md"
    good.write_text("# Roles\n\n## juez1\n\nMira el método.\n\nCon cuidado.\n## juez2 \nMira el estilo.\n### nota\nbreve\n## juez3\nMira las citas.\n", encoding="utf-8")
    assert {r.judge: r.role for r in invoke.judge_roles(spark, str(good)).collect()} == {1: "Mira el método.\n\nCon cuidado.", 2: "Mira el estilo.\n### nota\nbreve", 3: "Mira las citas."}
    for text in ("## juez1\na\n## juez2\nb\n", "## juez1\na\n## juez2\nb\n## juez3\nc\n## juez4\nd\n", ""):
        bad = tmp_path / f"bad{len(text)}.md"
        bad.write_text(text, encoding="utf-8")
        with pytest.raises(ValueError, match="judges 1 to 3"):
            invoke.judge_roles(spark, str(bad))


SECTIONS = [
    (1, 1, "S02", "Formulación del problema", True, 2, "b" * 2000), (1, 0, "S01", "Título", True, 1, "a" * 2000), (1, 2, "S03", "Anexos", False, 0, "no"),
    (2, 0, "S01", "Título", True, 0, None), (3, 0, "S01", "Otro", False, 4, "x y z w"),
]


def test_excerpts_are_titled_cut_and_in_order(spark):
    s = spark.createDataFrame(SECTIONS, "doc_id int, pos int, section_id string, name string, present boolean, words int, text string")
    assert {r.doc_id: r.context for r in invoke.cross_cutting(s, ["S01"]).collect()} == {1: f"[S01 Título]\n{'a' * 2000}\n\n[S02 Formulación del problema]\n{'b' * 1500}", 2: "[S01 Título]\n"}
    assert {r.doc_id: r.context for r in invoke.traceability(s, ["titulo", "formulacion"]).collect()} == {1: f"[Título]\n{'a' * 1200}\n\n[Formulación del problema]\n{'b' * 1200}"}


def test_bodies_are_the_present_sections_or_the_whole_text(spark):
    s = spark.createDataFrame(SECTIONS, "doc_id int, pos int, section_id string, name string, present boolean, words int, text string")
    docs = spark.createDataFrame([(1, "whole"), (2, "two words"), (3, "three"), (4, None)], "doc_id int, full_text string")
    found = {r.doc_id: r for r in textstats.bodies(docs, s).collect()}
    assert {k: r.body for k, r in found.items()} == {1: "a" * 2000 + "\n\n" + "b" * 2000, 2: "two words", 3: "three", 4: ""}
    assert {k: r.completeness for k, r in found.items()} == {1: 0.6667, 2: 1.0, 3: 0.0, 4: 0.0}
    assert [(x.section_id, x.words) for x in found[1].section_words] == [("S01", 1), ("S02", 2), ("S03", 0)]
    measured = {r.doc_id: r for r in textstats.document_metrics(docs, s).collect()}
    assert (measured[2].words, measured[2].n_citations, measured[4].words) == (2, 0, 0)


def test_citations_of_repeated_documents_count_once(spark):
    text = "Según García (2020) y (Pérez, 2019; López, 2018).\nREFERENCIAS\nGarcía, J. (2020). Uno.\nRuiz, A. (2001). Dos.\n"
    docs = spark.createDataFrame([(1, text, text), (1, text, text), (2, None, None)], "doc_id int, body string, full_text string")
    found = {r.doc_id: r for r in textstats.citation_report(docs).collect()}
    assert len(found) == 2 and textstats.citation_report(docs).count() == 2
    assert (found[1].n_references, found[1].uncited) == (2, ["ruiz (2001)"])
    assert set(found[1].unreferenced) >= {"lópez (2018)", "pérez (2019)"}
    assert (found[2].n_citations, found[2].unreferenced) == (0, [])


def test_replacements_add_up_by_type(spark):
    pages = spark.createDataFrame([(1, 1, "Autor: escriba a a@b.pe o c@d.pe"), (2, 1, "x@y.pe y x@y.pe"), (3, 1, None)], "doc_id int, page_no int, text string")
    _, found, _ = redact.redact(pages)
    plain = {}
    for r in found.collect():
        for k, n in (r.counts or {}).items():
            was = plain.get(k, (0, 0))
            plain[k] = (was[0] + n, was[1] + 1)
    assert plain["correo"] == (4, 2)
    assert {r.type: (r.replaced, r.docs) for r in redact.replacements_by_type(found).collect()} == plain


def test_prompts_are_hashed_in_the_order_given(spark, tmp_path):
    from gradeloom.sources.files import prompts_hash

    for name, text in (("z.md", "uno\n"), ("a.md", "dos")):
        (tmp_path / name).write_text(text, encoding="utf-8")
    found = prompts_hash(spark, [str(tmp_path / "z.md"), str(tmp_path / "a.md")]).first()[0]
    assert found == hashlib.sha256("uno\ndos".encode()).hexdigest()[:16]
