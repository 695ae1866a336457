"""Hand-computed values."""

import random

from pyspark.sql import functions as F

from gradeloom.functions import text as tx
from gradeloom.operators import agreement as ag
from gradeloom.operators import argue, library, panel, redact, segment, store, textstats, validation
from gradeloom.sources import files, rubrics

VOTE = "eval_id int, judge int, section_id string, item_id string, level string, score int, evidence string, observation string"


def vote_rows(item, levels):
    return [(1, j, "S01", item, v, None, f"e{j}", f"o{j}") for j, v in enumerate(levels, 1)]


def test_lower_median(spark):
    row = spark.range(1).select(*[panel.lower_median(F.array(*map(F.lit, x))).alias(str(i)) for i, x in enumerate(([0, 2], [1, 2], [0, 1, 2]))]).first()
    assert tuple(row) == (0, 1, 1)


def test_three_level_votes(spark):
    c, p, n = "cumple", "parcial", "no_cumple"
    cases = {"a": (c, p, n), "b": (c, c, n), "c": (p, p, c), "d": (n, p, n), "e": (c, c, c), "f": (c, None, p)}
    votes = spark.createDataFrame([r for k, v in cases.items() for r in vote_rows(k, v)], VOTE)
    got = {r.item_id: (r.median, r.flagged) for r in panel.consolidate(votes, "weighted").collect()}
    assert got == {"a": (1, True), "b": (2, True), "c": (1, False), "d": (0, False), "e": (2, False), "f": (1, False)}


def test_dichotomous_votes(spark):
    c, n = "cumple", "no_cumple"
    votes = spark.createDataFrame([r for k, v in {"a": (c, c, c), "b": (c, c, n), "c": (c, n, n), "d": (n, n, n)}.items() for r in vote_rows(k, v)], VOTE)
    got = {r.item_id: (r.median, r.flagged) for r in panel.consolidate(votes, "dichotomous").collect()}
    assert got == {"a": (1, False), "b": (1, True), "c": (0, True), "d": (0, False)}


def test_points_and_bands(spark):
    assert spark.range(1).select(panel.points("weighted", F.lit(1), F.lit(0.75), F.lit(None).cast("double"))).first()[0] == 0.38
    bands = spark.createDataFrame([("r", 0, 90.0, "E"), ("r", 1, 75.0, "B"), ("r", 2, 60.0, "R"), ("r", 3, 0.0, "I")], "rubric_id string, pos int, min double, label string")
    scores = spark.createDataFrame([("r", x) for x in (100.0, 90.0, 89.5, 75.0, 74.99, 60.0, 59.99, 0.0)], "rubric_id string, basis double")
    assert [r.band for r in panel.with_band(scores, bands).orderBy(F.desc("basis")).collect()] == list("EEBBRRII")


def test_dimension_takes_the_voice_of_the_median(spark):
    votes = spark.createDataFrame([(1, j, "d", s, f"r{j}") for j, s in enumerate((5, 3, 4), 1)], "eval_id int, judge int, dimension string, score int, reason string")
    assert tuple(panel.dimension_scores(votes).select("median", "reason").first()) == (4, "r3")


def test_agreement_values(spark):
    def of(a, b, f):
        return spark.createDataFrame(list(zip(a, b, strict=True)), "a int, b int").agg(f(F.col("a"), F.col("b"))).first()[0]

    assert of([0, 1, 2, 3], [0, 1, 2, 3], ag.qwk) == 1
    assert abs(of([0, 3], [3, 0], ag.qwk) + 1) < 1e-12
    assert (of([0, 1, 2, 3], [1, 2, 3, 3], ag.exact), of([0, 1, 2, 3], [1, 2, 3, 3], ag.adjacent)) == (0.25, 1.0)


def test_totals_are_weighted_by_dense_rank(spark):
    pairs = spark.createDataFrame([(10, 20), (20, 20), (50, 50), (50, 10)], "a int, b int").withColumn("k", F.lit(1))
    assert abs(ag.dense_labels(pairs, ["k"]).agg(ag.qwk(F.col("a"), F.col("b"))).first()[0]) < 1e-12


def test_icc_of_close_raters(spark):
    rows = [(r, p, float(10 * p + (p % 3 if r == "b" else 0))) for r in "ab" for p in range(1, 11)]
    icc = ag.icc21(spark.createDataFrame(rows, "rater string, project int, score double"), "project").first()["icc"]
    assert 0.99 < icc < 1


def test_bootstrap_weights_follow_the_seed(spark):
    names, draw = ["p", "q", "r"], random.Random(42)
    want = {}
    for rep in range(5):
        for _ in names:
            key = (rep, names[draw.randrange(3)])
            want[key] = want.get(key, 0) + 1
    got = {(r["rep"], r["project"]): r["w"] for r in ag.bootstrap_weights(spark.createDataFrame([(n,) for n in names], "project string"), 5, 42).collect()}
    assert got == want


def test_coherence_notes(spark):
    pairs = [(0, 0), (0, 1), (1, 0), (0, 2), (1, 2), (3, 0)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a int, b int")
    assert [r[0] for r in df.orderBy("i").select(argue.coherence_note(F.col("a"), F.col("b"))).collect()] == [5, 4, 3, 3, 2, 1]


def test_quotes_are_looked_for_by_overlap():
    words = "el sistema de riego mide la humedad del suelo cada hora".split()
    assert argue.quote_in_text("mide la humedad del suelo", words)
    assert not argue.quote_in_text("analiza el precio del cobre mundial", words)
    assert not argue.quote_in_text("", words)


def test_contradictions(spark):
    text = "El estudio se realiza en la ciudad de Trujillo. La muestra se toma en la ciudad de Lima este año."
    found = [
        (1, 0, "variables", "El estudio se realiza en la ciudad de Trujillo", "La muestra se toma en la ciudad de Lima"),
        (1, 1, "variables", "La muestra se toma en la ciudad de Lima", "El estudio se realiza en la ciudad de Trujillo"),
        (1, 2, "otro", "una cita inventada que nadie ha escrito jamás", "La muestra se toma en la ciudad de Lima"),
        (1, 3, "otro", "dos palabras", "La muestra se toma en la ciudad de Lima"),
    ]
    docs = spark.createDataFrame([(1, text), (2, "")], "doc_id int, text string")
    rows = argue.verify_contradictions(spark.createDataFrame(found, "doc_id int, pos int, type string, quote_a string, quote_b string"), docs)
    assert {r.pos: r.reason is None for r in rows.collect()} == {0: True, 2: False, 3: False}
    assert {r.doc_id: r.note for r in argue.coherence_scores(rows, docs).collect()} == {1: 3, 2: None}


def test_text_measures(spark):
    df = spark.createDataFrame([("palabra " * 120,), ("",), (None,)], "text string")
    got = [r[0] for r in df.select(tx.type_token_ratio(tx.letter_tokens(F.coalesce("text", F.lit(""))))).collect()]
    assert got == [round(1 / 120, 4), None, None]
    assert spark.range(1).select(F.size(tx.hedges(F.lit("Probablemente el método podría fallar; en general no.")))).first()[0] == 3


def test_citations_and_references(spark):
    body = "García (2020) y López (2019) dicen algo (Ramos, 2024; Díaz, 2021). Otros, no."
    full = body + "\nREFERENCIAS\nGarcía, A. (2020). Uno.\nZéniz Ramos, B. (2024). Dos.\nTorres, C. (2018). Tres.\nANEXOS\nDíaz, Z. (2021). Nada."
    row = textstats.citation_report(spark.createDataFrame([(1, body, full)], "doc_id int, body string, full_text string")).first()
    assert (row.n_citations, row.n_references) == (4, 3)
    assert row.unreferenced == ["díaz (2021)", "lópez (2019)"]
    assert row.uncited == ["torres (2018)"]


def test_redaction_numbers_placeholders(spark):
    page = "AUTOR: Ana Pérez Soto\nana@correo.pe\nDNI: 12345678\nOtra vez ana@correo.pe"
    clean, reports, mapping = redact.redact(spark.createDataFrame([(1, 1, page)], "doc_id int, page_no int, text string"))
    text = clean.first()["text"]
    assert "ana@correo.pe" not in text and "12345678" not in text and "Pérez" not in text
    assert mapping.count() >= 3 and sum(reports.first()["counts"].values()) >= 4


def test_latest_keeps_ties_and_upsert_the_last(spark):
    rows = spark.createDataFrame([("p", 1, "a"), ("p", 2, "b"), ("p", 2, "c"), ("q", 1, "d")], "project string, at int, name string")
    assert {r.name for r in store.latest_per_project(rows, "project", "at").collect()} == {"b", "c", "d"}
    assert store.upsert_last(rows, ["project"], "at").count() == 2


def test_chunks_part_at_lines(spark):
    def of(text):
        rows = library.chunks(spark.createDataFrame([("b", 1, text)], "book string, page int, text string")).orderBy("id").collect()
        return [r.text for r in rows]

    assert of("x" * 500 + "\n\n" + "y" * 500 + "\n" + "z" * 20) == ["x" * 500, "y" * 500 + " " + "z" * 20]
    assert of("a  b " * 30 + "\n" + "c" * 5) == [("a  b " * 30).strip() + " " + "c" * 5]
    # The space before a line counts: 450 + 1 + 449 is within 900, one more is not.
    assert [len(x) for x in of("x" * 450 + "\n" + "y" * 449)] == [900] and [len(x) for x in of("x" * 450 + "\n" + "y" * 450)] == [450, 450]
    assert of("short") == []


def test_one_label_agrees_with_itself(spark):
    of = lambda a, b: spark.createDataFrame(list(zip(a, b, strict=True)), "a int, b int").agg(ag.qwk(F.col("a"), F.col("b"))).first()[0]
    assert of([2, 2, 2], [2, 2, 2]) == 1.0 and of([2, 2], [1, 1]) == 0.0
    fixed = spark.createDataFrame([(2, 2)], "a int, b int").agg(ag.qwk(F.col("a"), F.col("b"), fixed_labels=True)).first()[0]
    assert fixed is None


def test_lexical_diversity(spark):
    texts = [["w"] * 60, [f"w{i}" for i in range(60)], [], None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t array<string>").select("i", textstats.mtld(F.col("t")).alias("m")).orderBy("i").collect()
    assert [r.m for r in rows] == [7.3, 0.0, None, None]


def test_sentences_and_bands(spark):
    text = "El valor es 3.14 en total. Hoy no llueve aquí! ¿Y mañana qué pasa? fin"
    assert spark.range(1).select(tx.sentences(F.lit(text))).first()[0] == ["El valor es 3.14 en total", "Hoy no llueve aquí", "¿Y mañana qué pasa", "fin"]
    values = spark.createDataFrame([(float(v),) for v in (130, 90, 89.99, 75, 60, 50, 30, 29.9, -5)] + [(None,)], "v double")
    assert [r[0] for r in values.select(tx.ease_band(F.col("v"))).collect()] == ["muy fácil", "muy fácil", "fácil", "algo fácil", "normal", "algo difícil", "difícil", "muy difícil", "muy difícil", None]
    of = lambda words: spark.range(1).select(tx.readability(F.lit("sol " * words))).first()[0]
    assert of(29) is None and of(30) == round(206.84 - 60 - 1.02 * 30, 2)


def test_argument_sentences(spark):
    text = "1. Planteamiento\nEl sistema mide la\nhumedad del suelo cada día. Según Ramos et al. Esto sigue igual siempre.\n• Una viñeta con cinco palabras\nSolo tres aquí"
    got = spark.range(1).select(argue.sentences_of(F.lit(text))).first()[0]
    assert got == ["El sistema mide la humedad del suelo cada día.", "Según Ramos et al. Esto sigue igual siempre.", "Una viñeta con cinco palabras"]


def test_a_judge_votes_once(spark):
    rows = [(1, 1, "S01", "a", None, s, "e", "o", n) for n, s in enumerate((3, 0))] + [(1, 2, "S01", "a", None, 2, "e", "o", 2)]
    votes = spark.createDataFrame(rows, VOTE + ", n int")
    assert panel.consolidate(votes, "scale", "n").first()["votes"] == {"juez1": "3", "juez2": "2"}
    assert panel.consolidate(votes.drop("n"), "scale").first()["votes"] == {"juez1": "0", "juez2": "2"}


def test_names_are_found_by_role(spark):
    first = "AUTORES:\nBach. PÉREZ SOTO, Ana\nLuis de la Cruz Díaz\nuna línea cualquiera\nJuan Torres Vega\nASESOR: Dr. Rosa Lima Paz\nMg. Iván Ríos Mora"
    second = "CO-ASESORA\nDr. Olga Paz Ruiz\nApellidos y nombres: Vela Rojas, Eva\norcid.org/0000-0001-2345-678X DNI N° 87654321 y 12345678, cel. 987 654 321"
    later = "Ana Pérez\nSoto citó a LUIS DE LA CRUZ DÍAZ; el 12345678 queda, DNI: 87654321 no"
    pages = [(1, 1, first), (1, 2, second), (1, 9, later), (2, 1, None)]
    clean, reports, secret = redact.redact(spark.createDataFrame(pages, "doc_id int, page_no int, text string"))
    mapping = {r.placeholder: r.original for r in secret.where("doc_id = 1").collect()}
    assert {k: v for k, v in mapping.items() if "AUTOR" in k} == {"[AUTOR_1]": "PÉREZ SOTO, Ana", "[AUTOR_2]": "Luis de la Cruz Díaz"}
    assert [mapping[f"[ASESOR_{i}]"] for i in (1, 2, 3, 4)] == ["Rosa Lima Paz", "Iván Ríos Mora", "Olga Paz Ruiz", "Vela Rojas, Eva"]
    text = {r.page_no: r.text for r in clean.where("doc_id = 1").collect()}
    assert text[9] == "[AUTOR_1] citó a [AUTOR_2]; el 12345678 queda, [DNI_1] no"
    assert "[ORCID_1]" in text[2] and "[DNI_1] y [DNI_2], cel. [TELEFONO_1]" in text[2]
    by_doc = {r.doc_id: r for r in reports.collect()}
    assert by_doc[1].counts["dni"] == 3 and by_doc[1].warnings == [] and len(by_doc[2].warnings) == 2 and by_doc[2].counts == {}


STUDY = {"tesis_a": (3, 2, 3, 1), "tesis_b": (2, 2, 1, 0), "tesis_c": (3, 3, 2, 2), "tesis_d": (1, 0, 1, 2)}


def study(spark):
    """Juror 1 scores as the system does, juror 2 a level less on the first item."""
    system = [(p, str(i), s) for p, scores in STUDY.items() for i, s in enumerate(scores, 1)]
    jurors = [(p, i, r, max(0, s - (r == "J2" and i == "1"))) for p, i, s in system for r in ("J1", "J2")]
    return spark.createDataFrame(system, "project string, item_id string, score int"), spark.createDataFrame(jurors, "project string, item_id string, rater string, score int")


def test_validation_study(spark):
    system, jurors = study(spark)
    by = {r.rater: r for r in validation.against_jurors(system, jurors).collect()}
    assert (by["J1"].qwk, by["J1"].exact, by["J1"].n_items) == (1.0, 1.0, 16) and by["J2"].qwk < 1
    row = validation.against_median(system, jurors).first()
    assert 0 < row.qwk_items < 1 and row.adjacent == 1.0 and row.mae_totals == 0.5 and row.pearson > 0.9 and row.n_projects == 4
    items, totals = validation.human_baseline(jurors)
    assert round(items.where("project is null").first()["qwk"], 4) == 0.8667 and items.where("project is not null").count() == 4
    assert totals.first()["n_projects"] == 4
    votes = [(p, str(i), f"juez{j}", str(max(0, s - (j == 3)))) for p, scores in STUDY.items() for i, s in enumerate(scores, 1) for j in (1, 2, 3)]
    votes = spark.createDataFrame(votes, "project string, item_id string, judge string, level string")
    own = {(r.judge_a, r.judge_b): round(r.qwk, 4) for r in validation.panel_agreement(votes).collect()}
    assert own == {("juez1", "juez2"): 1.0, ("juez1", "juez3"): 0.6216, ("juez2", "juez3"): 0.6216}
    weights = ag.bootstrap_weights(system.select("project"), 50)
    bounds = {r.measure: r for r in validation.median_intervals(system, jurors, weights).collect()}
    assert bounds["qwk_items"].low <= row.qwk_items <= bounds["qwk_items"].high and bounds["mae_totals"].low == 0.5
    assert {r.part for r in validation.report(system, jurors, votes, weights).collect()} == {"against juror", "against median", "interval", "jurors, items", "jurors, totals", "panel"}
    pairs, spread, icc = validation.retest_report(system.withColumn("run", F.explode(F.array(F.lit("r1"), F.lit("r2")))))
    assert pairs.first()["identical_pct"] == 100 and {r.sd for r in spread.collect()} == {0.0} and round(icc.first()["icc"], 6) == 1


def test_rubric_sources(spark):
    weighted = """**1\\. Título del proyecto \\[Máximo: 3 pts\\]**
_Referencia: Hernández-Sampieri (2018), Cap. 2, pp. 35-36; criterios propios; Cap. 3_
| **N** | **Criterio** | **Peso** | x | **Parcial** |
| --- | --- | --- | --- | --- |
| 1.1 | El título \\(breve\\) dice qué | 2 | 0 | 1 |
| 1.2 | Otro criterio | 1.5 | 0 | 0.75 |
| | SUBTOTAL | **4** | | |
**2. Problema [Máximo: 5 pts]**
| 2.1 | Mal | x | 0 | y |
**ESCALA DE INTERPRETACIÓN**
| Rango | Nivel | Acción |
| --- | --- | --- |
| 90 - 100 | Excelente - A | Aprobar |
| 75 - 89 | Bueno | Mejorar |
| Menor a 75 | Malo | Rehacer |"""
    lines = lambda text: spark.createDataFrame([("f", i, x.strip()) for i, x in enumerate(text.split("\n"))], "source string, line_no int, text string")
    found = rubrics.parse_rubric(lines(weighted), True)
    assert [(r.section_id, r.name, r.max) for r in found["sections"].orderBy("section_id").collect()] == [("S01", "Título del proyecto", 3.0), ("S02", "Problema", 5.0)]
    assert [(r.item_id, r.criterion, r.weight, r.partial, r.reference) for r in found["items"].orderBy("item_id").collect()] == [
        ("1.1", "El título (breve) dice qué", 2.0, 1.0, "HS2018 Cap. 2, pp. 35-36; Cap. 3"), ("1.2", "Otro criterio", 1.5, 0.75, "HS2018 Cap. 2, pp. 35-36; Cap. 3")]
    assert sorted(r.warning for r in found["warnings"].collect()) == ["S01: subtotal 4.0, maximum 3.0", "S01: weights add up to 3.5, maximum 3.0", "S02: no items", "S02: row 2.1 has unreadable numbers"]
    assert [(r.min, r.max, r.label) for r in rubrics.parse_bands(lines(weighted)).orderBy(F.desc("min")).collect()] == [(90.0, 100.0, "Excelente"), (75.0, 89.99, "Bueno"), (0.0, 74.99, "Malo")]
    form = "## TÍTULO\n| N° | Ítem |\n| --- | --- |\n| 01 | Es claro |\n| 02 | Es breve |\n## CONVERSIÓN A NOTA VIGESIMAL\n| Puntaje | Nota |\n| 86 - 90 | 18 |\n| < 10 | 1 |"
    parts = rubrics.parse_form(lines(form))
    assert [(r.section_id, r.name, r.max) for r in parts["sections"].collect()] == [("B01", "TÍTULO", 6.0)] and parts["items"].count() == 2
    assert sorted((r.min, r.max, r.grade) for r in parts["conversion"].collect()) == [(0, 9, 1), (86, 90, 18)]


def test_consolidated_row(spark):
    base = spark.createDataFrame([(1, 80.0), (2, 50.0)], "eval_id int, total double")
    dims = spark.createDataFrame([(1, "claridad_tono", 4)], "eval_id int, dimension string, median int")
    metrics = spark.createDataFrame([(1, *range(11))], "eval_id int, " + ", ".join(f"{c} int" for c in files.METRICS.values()))
    own = spark.createDataFrame([(1, 2.35, 2, True)], "eval_id int, disagreement_pct double, n_flagged int, incomplete boolean")
    argument = spark.createDataFrame([(1, "S02", 0.5, 3), (1, "S05", 1.0, 5)], "eval_id int, section_id string, index double, level int")
    coherence = spark.createDataFrame([(1, 3, 1, 0)], "eval_id int, note int, core int, minor int")
    one, two = files.consolidated_row(base, dims, metrics, own, argument, coherence).orderBy("eval_id").collect()
    assert (one.trans_claridad_tono, one.fernandez_huerta, one.pct_discrepancia, one.panel_incompleto, one.toulmin_indice_proyecto, one.toulmin_nivel_S05, one.coherencia_global) == (4, 0, 2.35, 1, 0.75, 5, 3)
    assert two.panel_incompleto == 0 and two.mtld is None and two.toulmin_indice_S02 is None


def test_gaps_are_filled_by_conventions(spark):
    cover = "UNIVERSIDAD PRIVADA DEL VALLE\nFACULTAD DE INGENIERÍA\nSistema de riego automático para el control de la humedad\nLínea de investigación: agua"
    general = "Técnica de contrastación: experimental\ncon grupo de control y dos mediciones sucesivas\n4. Línea de investigación\nnada"
    pages = spark.createDataFrame([(1, 1, cover), (1, 2, general), (2, 1, "Título: Riego por goteo en los valles del norte")], "doc_id int, page_no int, text string")
    problem = "El riego falla. ¿De qué manera influye el sistema\nen la humedad del suelo? ¿Corta?"
    rows = [(1, "S01", False, "", 0), (1, "S02", True, problem, 16), (1, "S03", False, "", 0), (1, "S12", True, "", 0), (2, "S01", False, "", 0), (2, "S02", False, "", 0)]
    found = spark.createDataFrame([(d, s, s, None, None, None, w, x, p) for d, s, p, x, w in rows], "doc_id int, section_id string, name string, heading string, page_no int, last_page int, words int, text string, present boolean")
    out, warnings = segment.complete(found, pages, spark.createDataFrame([("titulo",)], "alias string"))
    got = {(r.doc_id, r.section_id): (r.present, r.text) for r in out.collect()}
    assert got[1, "S01"] == (True, "Sistema de riego automático para el control de la humedad")
    assert got[1, "S03"] == (True, "¿De qué manera influye el sistema en la humedad del suelo?")
    assert got[1, "S12"] == (True, "De acuerdo con la técnica de contrastación: experimental con grupo de control y dos mediciones sucesivas")
    assert got[2, "S01"] == (True, "Riego por goteo en los valles del norte") and got[2, "S02"] == (False, "")
    told = {(r.doc_id, r.section_id, r.warning) for r in warnings.collect()}
    assert (2, None, "only 1 of 2 sections found") in told and (1, "S12", "taken from: Generalidades: técnica de contrastación") in told


def test_long_lists_of_names_are_read(spark):
    """As long a list as a text may hold; a stack of the size that a task has must do."""
    rows = [(1, "Zuza, " * 4000 + "Ramos (2020) dice."), (2, "Vega, " * 4000), (3, "Díaz, Vega y Ramos et al. (2019) y García-López e Ibarra (2021a)")]
    docs = spark.createDataFrame(rows, "doc_id long, body string")
    found = {tuple(r) for r in textstats.citations(docs).collect()}
    assert found == {(1, "zuza", "2020"), (3, "díaz", "2019"), (3, "garcía-lópez", "2021")}
