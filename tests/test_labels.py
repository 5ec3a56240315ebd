"""Label keys and titles by cases with known answers."""

import pytest
from pyspark.sql import functions as F

from driftline.functions import labels


def column(spark, values, function):
    """The function of each value, in order, from a table (a literal would be folded)."""
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r[0] for r in df.repartition(1).sortWithinPartitions("i").select(function(F.col("v"))).collect()]


CASES = [
    ("Au 30 avril 2025", ""),
    ("Prets garantis au 30 avril 2025", "pret garanti"),
    ("Prets garantis (en millions de dollars)", "pret garanti"),
    ("Marge de credit (M$)", "marge de credit"),
    ("Ratio CET1 (%)", "ratio cet1"),
    ("Ratio CET1 au 30 avril 2025", "ratio cet1"),
    ("Actifs greves - en milliers de dollars canadiens", "actif greve"),
    ("Pour la periode close le 31/03/2025", ""),
    ("Total (CAD)", "total"),
    ("Note 3", ""),
    ("(1)", ""),
    ("1)", ""),
    ("Tier 1 (M$)", "tier 1"),
    ("CET1", "cet1"),
    ("Tier 2", "tier 2"),
    ("1 Trésorerie", "tresorerie"),
    ("32 Éléments hors bilan", "element hors bilan"),
    ("T o t a l net", "total net"),
    ("Total des actifs1", ""),
    ("Région2", "region"),
    ("Total des fonds propres réglementaires", "fonds propre reglementaire"),
    ("Première tranche", "tranche 1"),
    ("exposition liée au crédit", "exposition lie credit"),
    ("", ""),
    (None, ""),
]


def test_label_key(spark):
    assert column(spark, [c for c, _ in CASES], labels.label_key) == [w for _, w in CASES]


@pytest.mark.parametrize(
    "a, b",
    [
        ("29 Actifs d'instruments dérivés du NSFR", "27 Actifs d'instruments dérivés du NSFR"),
        ("Variation de l’actif net des régimes de retraite à prestations définies (déduction faite des passifs d’impôt)", "Variation de l'actif des régimes de retraite à prestations définies (déduction faite des passifs d'impôts)"),
        ("déduction faite des passifs d' impôt", "déduction faite des passifs d'impôts"),
        ("Autres éléments de fonds propres de catégorie 1", "Autres elements de fonds propres de categorie 1"),
        ("Fonds propres (fonds propres sous forme d'actions)", "fonds propres sous forme d'actions"),
    ],
)
def test_label_variants_share_a_key(spark, a, b):
    x, y = column(spark, [a, b], labels.label_key)
    assert x == y != ""


def test_dates_and_units(spark):
    given = ["31 janvier 2025", "Prets garantis au 30 avril 2025", "Prets garantis - 31/01/2025", "Pour la periode close le 31/03/2025"]
    assert column(spark, given[1:], labels.without_dates) == ["Prets garantis", "Prets garantis", ""]
    assert column(spark, ["Marge de credit (M$)", "Ratio CET1 (%)", "Total (CAD)", "Actifs greves - en milliers de dollars canadiens"], labels.without_units) == ["Marge de credit", "Ratio CET1", "Total", "Actifs greves"]
    assert column(spark, ["Total des actifs1", "Revenue2024", "Ratio (1)", "Prets 79"], labels.without_trailing_value) == ["Total des actifs", "Revenue", "Ratio", "Prets"]


def test_lines_that_are_no_labels(spark):
    given = ["12", "Total du passif", "Total des fonds propres", "Levier(4):", "Titres :", "en millions de dollars", "Note 2. Méthodes", "2025", "T2 2025", "Liquidité", "Prêts", None]
    want = ["number", "total", None, "section_header", None, "unit", "footnote", "number", "date", "section_header", None, None]
    assert column(spark, given, labels.excluded_line) == want
    assert column(spark, ["Au 31 octobre", "Prêts", "(en millions de dollars canadiens) Au 31 janvier 2025", "(1) Définition", ""], labels.date_line) == [True, False, True, True, False]


@pytest.mark.parametrize("cell, want", [("", "EMPTY"), ("12 pourcentage", "PERCENT"), ("en millions", "CURRENCY"), ("Exercice 2025", "YEAR"), ("31 mars 2025", "DATE"), ("Ended April", "DATE"), ("T1 2024", "DATE"), ("(1 234)", "NUMBER"), ("Pilier 3", "NUMBER"), ("Total", "TEXT")])
def test_header_type(spark, cell, want):
    assert column(spark, [cell], labels.header_type) == [want]


def test_titles(spark):
    assert column(spark, ["NOTATIONS DE CREDIT1", "Tableau 12", "Ratios (1)", "Prets 1, 2"], labels.title_without_notes) == ["NOTATIONS DE CREDIT", "Tableau 12", "Ratios", "Prets"]
    assert column(spark, ["31 janvier 2025", "Fonds propres au 31 octobre 2024", "Prets 30 avril 2025"], labels.title_without_dates) == ["", "Fonds propres", "Prets"]
    assert column(spark, ["Prets 79 772 76 163", "Tableau 28", "79,772 76,163 Prets"], labels.title_without_values) == ["Prets", "Tableau", "Prets"]
    assert column(spark, ["Prets 1 2 3", "Tableau 28", "a b c d 1 2", "a 1 b 2", ""], labels.title_has_values) == [True, False, True, True, False]
    assert column(spark, ["Tableau", "Résultats", "Fonds propres", ""], labels.generic_title) == [True, True, False, True]
    assert column(spark, ["24 Banque Royale du Canada Premier trimestre de 2025", "Premier trimestre"], labels.running_title) == [True, False]


def test_notes_and_splits(spark):
    got = column(spark, ["Prêts (1)(2)", "Dépôts¹", "Totals3", "CET1", "Ratio [4]"], labels.note_refs)
    assert [(r["text"], r["refs"]) for r in got] == [("Prêts", ["1", "2"]), ("Dépôts", ["1"]), ("Totals", ["3"]), ("CET1", []), ("Ratio", ["4"])]
    got = column(spark, ["AJOUTactions", "impotAJOUTactions", "net"], labels.post_normalized)
    assert [tuple(r) for r in got] == [("AJOUT actions", False, True), ("impot AJOUTactions", True, False), ("net", False, False)]
    assert column(spark, ["actions garantis frais nos", ""], labels.singular) == ["action garanti frais nos", ""]
    assert column(spark, ["12", "x", None], labels.coerced_int) == [12, 0, 0]
