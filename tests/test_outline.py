"""Page marks, replacements, scopes and contexts on known cases."""

from pyspark.sql import functions as F

from driftline.functions import outline


def _one(spark, value, column):
    return spark.createDataFrame([(v,) for v in value], "x string").select(column(F.col("x"))).collect()


def test_pages(spark):
    assert [r[0] for r in _one(spark, ["## Risques [pdf.12]", "Texte [pdf.3] au milieu", "[pdf.7]  ", None], outline.inline_page)] == [12, None, 7, None]
    text = "## Risques [pdf.12]\n[pdf.13]\nUn texte [pdf.14] ici  \n\n### Crédit  [pdf.15]\r\n  [pdf.16]\n# Titre [pdf.1]"
    assert [r[0] for r in _one(spark, [text, None], outline.without_page_marks)] == ["## Risques\nUn texte [pdf.14] ici\n\n### Crédit\n# Titre [pdf.1]", ""]


def test_replacement(spark):
    cases = {'Le terme "ESG" par "Durabilité "': "term_replace:esg->durabilité", 'remplace "A" remplacé par "B". Ajout: c': "term_replace:a->b", "Suppression de sous-section: Risque climatique. Fin": "section_del:risque climatique", "PASSAGE AJOUTÉ : Liquidité\nsuite": "section_add:liquidité", "Passage supprimé: x": "section_del:x", "rien": "", None: ""}
    assert [r[0] for r in _one(spark, list(cases), outline.replacement)] == list(cases.values())


def test_scope_and_changes(spark):
    cases = [("unchanged", None, None, None, True, None, "hidden"), ("added", None, "Skip", None, True, None, "hidden"), ("added", "moved_text", None, None, True, None, "secondary"), ("added", None, None, " Minor ", True, None, "secondary"), ("added", None, None, None, None, None, "qualitative"), ("added", None, None, None, False, True, "qualitative"), ("added", None, None, None, False, None, "secondary")]
    frame = spark.createDataFrame([c[:6] for c in cases], "d string, a string, s string, e string, r boolean, n boolean")
    assert [r[0] for r in frame.select(outline.scope(*(F.col(c) for c in "dasern"), ["minor"])).collect()] == [c[6] for c in cases]
    frame = spark.createDataFrame([(None, None, 0, None), ("stable", 0, 0, 1), ("changed", None, None, None)], "s string, a int, b int, c int")
    assert [r[0] for r in frame.select(outline.changed(*(F.col(c) for c in "sabc"))).collect()] == [False, True, True]
    frame = spark.createDataFrame([(None, None, []), ("stable", ["x"], []), ("modifie", None, None), ("inchange", [], None)], "l string, a array<string>, b array<string>")
    assert [r[0] for r in frame.select(outline.meaningful(F.col("l"), [F.col("a"), F.col("b")])).collect()] == [False, True, True, False]


def test_context(spark):
    frame = spark.createDataFrame([("T2 2025", None), ("Q1-2025", ""), ("2024_t4", "T3 2024")], "c string, p string")
    got = frame.select(outline.quarter_context(F.col("c"), F.col("p")).alias("x")).select("x.comparison_label", "x.comparison_display_label", "x.previous.quarter").collect()
    assert [tuple(r) for r in got] == [("Q2-2025 vs Q1-2025", "T2 2025 vs T1 2025", 1), ("Q1-2025 vs Q3-2024", "T1 2025 vs T3 2024", 3), ("Q4-2024 vs Q3-2024", "T4 2024 vs T3 2024", 3)]
    assert [r[0] for r in _one(spark, ["T2-2025", "  ", None], outline.period_folder)] == ["t2_2025", None, None]
