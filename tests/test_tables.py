"""Tables: what counts, candidates, decisions and events by cases with known answers."""

from pyspark.sql import functions as F

from driftline.functions import geometry
from driftline.operators import tables
from tests.test_labels import column


def test_partition_and_grading(spark):
    schema = "s string, labels array<string>, headers array<string>, title string, summary string"
    df = spark.createDataFrame([("ok", ["Prêts"], [], "T", "S"), ("confirmed_no_table", [], [], "", ""), (None, ["2025"], [], "", ""), ("strange", ["Prêts"], [], "", "S"), ("", [], ["a", "b"], "T", "")], schema)
    got = df.select(tables.partition(F.col("s"), F.col("labels"), F.col("headers")).alias("p"), tables.incompleteness(F.col("labels"), F.col("headers"), F.col("title"), F.col("summary")).alias("r")).collect()
    assert [r["p"] for r in got] == ["business", "artifact", "ghost", "suspect", "business"]
    assert [r["r"] for r in got] == [[], ["no_viable_indicators", "missing_table_summary"], ["no_viable_indicators", "missing_table_summary"], [], ["no_viable_indicators", "missing_body_row_labels", "missing_table_summary"]]
    arrays = spark.createDataFrame([(["x"], ""), (["dominant_contamination"], ""), (["missing_result"], "Titre manquant"), (["missing_expected_footnotes"], "")], "r array<string>, c string")
    assert [r[0] for r in arrays.select(tables.rescue_variant(F.col("r"), F.col("c"))).collect()] == ["same_crop_rescue", "tight_body", "top_extended", "bottom_extended"]


def test_candidates(spark):
    vec = "array<double>"
    schema = f"block string, side string, chunk string, concept {vec}, indicators {vec}, structure {vec}, footnotes {vec}"
    rows = [("b", "previous", "p1", [1.0, 0.0], [1.0, 0.0], [2.0, 0.0], None), ("b", "previous", "p2", [0.0, 1.0], [0.0, 3.0], [0.0, 1.0], [0.0, 1.0]), ("b", "current", "c1", [1.0, 0.0], [0.0, 1.0], [1.0, 0.0], [0.0, 2.0])]
    got = {r["left"]: round(r["score"], 6) for r in tables.candidates(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"p1": 0.5, "p2": 0.5}


def test_decisions(spark):
    previous = spark.createDataFrame([("r", p) for p in ("p1", "p2")], "r string, table_id string")
    current = spark.createDataFrame([("r", c) for c in ("c1", "c2", "c3", "c4")], "r string, table_id string")
    rows = [("r", "c1", "p1", "match"), ("r", "c2", "p9", "match"), ("r", "c3", None, "added"), ("r", "c9", None, "added")]
    first = tables.checked(spark.createDataFrame(rows, "r string, current_id string, previous_id string, decision string"), previous, current, ["r"], ["match", "added"])
    assert {(x["current_id"], x["problem"]) for x in first.collect()} == {("c1", None), ("c2", "unknown_previous"), ("c3", None), ("c9", "unknown_current"), ("c4", "missing")}
    repaired = tables.checked(spark.createDataFrame([("r", "c2", "p2", "match"), ("r", "c4", "p1", "match")], "r string, current_id string, previous_id string, decision string"), previous, current, ["r"], ["match", "added"])
    done = {(x["current_id"], x["previous_id"], x["decision"]) for x in tables.settled(first.where("current_id <> 'c9'"), repaired, ["r"]).collect()}
    assert done == {("c1", "p1", "match"), ("c2", "p2", "match"), ("c3", None, "added"), ("c4", None, "unresolved")}


def test_events_and_order(spark):
    previous = spark.createDataFrame([("r", "p1", 2, None), ("r", "p2", 1, None)], "r string, table_id string, page int, bbox_source string")
    current = spark.createDataFrame([("r", "c1", 1, None), ("r", "c2", 2, tables.BOUNDARY)], "r string, table_id string, page int, bbox_source string")
    pairs = spark.createDataFrame([("r", "p1", "c1")], "r string, previous_id string, current_id string")
    got = {(x["table_id"], x["event"], x["excluded"]) for x in tables.events(pairs, previous, current, ["r"]).collect()}
    assert got == {("p2", "removed", False), ("c2", "added", True)}
    both = spark.createDataFrame([("r", "p1", "c1"), ("r", "p2", "c2")], "r string, previous_id string, current_id string")
    assert {(x["previous_id"], x["position"]) for x in tables.sorted_pairs(both, previous, ["r"], ["page"]).collect()} == {("p2", 1), ("p1", 2)}


def test_variants_and_signatures(spark):
    df = spark.createDataFrame([("t", "a", ["x", "y", "z"]), ("t", "b", ["x", "y", "w"]), ("t", "c", ["x", "y", "z", "q", "r", "s"])], "t string, variant string, labels array<string>")
    assert [x["variant"] for x in tables.chosen_variant(df, ["t"]).collect()] == ["a"]
    items = spark.createDataFrame([("q", 1, "a"), ("q", 2, "b"), ("p", 2, "b"), ("p", 1, "a")], "q string, i int, s string")
    assert len({x["signature"] for x in tables.review_signature(items, ["q"], ["i", "s"]).collect()}) == 1


def test_boxes(spark):
    box = lambda *v: F.array(*map(F.lit, v))
    ok = lambda *v: column(spark, ["x"], lambda _: geometry.sane(box(*v)))[0]["reason"]
    assert [ok(0.1, 0.1, 0.9, 0.5), ok(0.0, 0.0, 1.0, 1.0), ok(0.1, 0.1, 0.11, 0.5), ok(0.5, 0.1, 0.4, 0.5)] == [None, "bbox_area_too_large", "bbox_too_narrow", "invalid_bbox"]
