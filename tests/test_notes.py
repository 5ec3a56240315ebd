"""Notes and labels that refer to them by cases with known answers."""

from pyspark.sql import functions as F

from driftline.functions import notes
from tests.test_labels import column


def over(spark, values, function):
    return spark.createDataFrame([(values,)], "v array<string>").select(function(F.col("v"))).first()[0]


def test_keys(spark):
    assert column(spark, ["Prêts (1) nets¹ [2]", None], notes.indicator_text) == ["prêtsnets", ""]
    assert column(spark, ["Voir pages 12 à 14 au 31 mars 2025 (T2 2025)"], notes.note_text) == ["voir __page__ au __date__ (__date__)"]
    assert column(spark, ["Au 31 mars 2025 – Prêts — nets (bloc 2) (1)", "Total :"], notes.diff_name) == ["Prêts - nets", "Total"]
    got = spark.createDataFrame([("Prêts (1)", "Prêts (2)"), ("Prêts", "Dépôts")], "a string, b string").select(notes.only_noise(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [True, False]


def test_markers(spark):
    assert column(spark, ["(1)", "[a]", "²", " ((3)) "], notes.marker_id) == ["1", "a", "2", "3"]
    assert over(spark, ["Prêts (1)²", "Total *", "x (abc)"], notes.marker_ids) == ["*", "1", "2"]


def test_parsing(spark):
    got = over(spark, ["(1) Une note", "2. Deux", "sans numéro", " "], notes.parsed_notes)
    assert [(r["marker"], r["text"], r["text_norm"]) for r in got] == [("1", "Une note", "une note"), ("2", "Deux", "deux"), ("", "sans numéro", "sans numero")]
    got = over(spark, ["a", "", '{"marker": "x", "text": "b"}', '{"value": "c"}'], notes.canonical_notes)
    assert [(r["id"], r["text"]) for r in got] == [("1", "a"), ("x", "b"), ("4", "c")]
    assert over(spark, ['{"id": "1", "text": "a"}', '{"id": "1", "text": "b"}'], notes.notes_by_id) == {"1": "b"}


def test_lines(spark):
    got = over(spark, ["Fonds propres de", "catégorie 1", "Total", "1. Prêts", "(¹)", "Autres éléments :", "de la suite"], notes.merged_lines)
    assert (got["labels"], got["merged"]) == (["Fonds propres de catégorie 1", "Total", "1. Prêts (¹)", "Autres éléments :", "de la suite"], 2)
    assert over(spark, ["Prêts", "Prêts – nets", "Prêts – bruts", "Autres"], notes.without_header_prefix) == ["Prêts", "nets", "bruts", "Autres"]
