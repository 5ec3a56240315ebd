"""Views and writers: what comes back is what was meant."""

import pytest
from pyspark.sql import functions as F

from driftline.operators import views
from driftline.sources import reports
from tests.test_labels import column


def pairs(spark):
    schema = "id string, table_status string, indicators_added array<string>, indicators_removed array<string>, indicators_renamed array<struct<`from`: string, `to`: string>>, footnotes_added array<string>, footnotes_removed array<string>"
    return spark.createDataFrame([("a", "changed", ["x"], ["y", "z"], [("o", "n")], ["1"], None), ("b", "uncertain", ["u"], None, None, None, None), ("c", "stable", None, None, None, None, None)], schema)


def test_change_rows(spark):
    rows = views.label_rows(pairs(spark), ["id"]).collect()
    assert {tuple(r) for r in rows} == {("a", "added", "x", None), ("a", "removed", "y", None), ("a", "removed", "z", None), ("a", "renamed", "n", "o")}
    assert views.label_rows(pairs(spark), ["id"], include_uncertain=True).count() == 5
    got = {r["id"]: (r["n_changes"], r["table_level_change"]) for r in views.footnote_counts(pairs(spark)).collect()}
    assert got == {"a": (5, "modifie"), "b": (1, "modifie"), "c": (0, "inchange")}
    one = spark.createDataFrame([("n",)], "id string")
    items = {tuple(r) for r in views.review_items(pairs(spark), one, one.limit(0), ["id"]).collect()}
    assert items == {("a", "indicator", "modified", 4), ("a", "footnote", "modified", 1), ("b", "indicator", "modified", 1), ("n", "indicator", "table_added", 1)}


def test_text_rows(spark):
    df = spark.createDataFrame([("modified", "a\x07 b", "c", ""), ("added", None, "n", ""), ("modified", "m", "m2", "moved_text")], "diff_type string, source_text_t1 string, source_text_t2 string, alignment_decision string")
    assert [(r["type"], r["text"]) for r in views.text_rows(df).collect()] == [("Suppression", "a b"), ("Ajout", "c"), ("Ajout", "n")]


def test_table_views(spark):
    arrays = spark.createDataFrame([(["Prêts (1)", "Au 31 mars 2025", "Dépôts"],)], "x array<string>")
    context, n, f = arrays.select(views.table_context(F.col("x")), views.real_labels(F.col("x")), views.features(F.col("x"))).first()
    assert [(r["label"], r["normalized"]) for r in context] == [("Prêts (1)", "pret"), ("Dépôts", "depot")] and n == 2 and f["n_indicators"] == 3
    assert column(spark, ["x"], lambda _: views.drastic_drop(F.lit(20), F.lit(3))) == [True] and column(spark, ["x"], lambda _: views.drastic_drop(F.lit(6), F.lit(1))) == [False]
    assert column(spark, ["Gestion du capital"], lambda s: views.table_uid(F.lit("RBC"), F.lit(2025), F.lit("T1"), s, F.lit(None), F.lit(7), F.lit(2))) == ["rbc_2025_t1_gestion-du-capital_na_p007_i02"]


def test_writers_round_trip(spark, tmp_path):
    schema = "bank_code string, year int, quarter string, table_id string, page int, ordinal int, title string, indicators array<string>, footnotes array<struct<id: string, text: string>>"
    rows = [("rbc", 2025, "t1", "b", 2, 1, "T", ["x"], [("1", "note"), ("2", "")]), ("rbc", 2025, "t1", "a", 1, 0, "T", [], None)]
    df = spark.createDataFrame(rows, schema)
    reports.write_tables(df, str(tmp_path / "tables"))
    back = spark.read.json(str(tmp_path / "tables"))
    assert {(r["table_id"], r["schema_version"]) for r in back.collect()} == {("a", 7), ("b", 7)}
    with pytest.raises(Exception, match="not unique"):
        reports.write_tables(df.unionByName(df), str(tmp_path / "twice"))
    reports.write_notes(df, str(tmp_path / "notes"))
    assert [(r["id"], r["text"]) for r in spark.read.json(str(tmp_path / "notes")).collect()] == [("1", "note")]
    changes = spark.createDataFrame([("s", "c1", 2, "late"), ("s", "c1", 1, "ear\x01ly"), ("s", "c2", 3, "x")], "section string, change_id string, position int, text string")
    reports.write_text_changes(changes, str(tmp_path / "changes"), ["section"])
    assert {(r["change_id"], r["text"]) for r in spark.read.json(str(tmp_path / "changes")).collect()} == {("c1", "early"), ("c2", "x")}
    decisions = spark.createDataFrame([("c1", "approved", 1), ("c1", "rejected", 2)], "change_id string, status string, decided_at int")
    reports.write_decisions(changes, decisions, str(tmp_path / "decided"), ["section"], ["change_id"])
    assert {(r["change_id"], r["status"]) for r in spark.read.json(str(tmp_path / "decided")).collect()} == {("c1", "rejected"), ("c2", "pending")}


def test_ranges_of_either_layout(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"sections": [{"section": "capital", "start_page": 3, "end_page": 9}]}')
    (tmp_path / "b.json").write_text('{"ranges": [{"section_key": "risk", "pages": [10, 20]}]}')
    got = {tuple(r) for r in reports.read_section_ranges(spark, str(tmp_path / "*.json")).collect()}
    assert got == {("capital", 3, 9), ("risk", 10, 20)}
