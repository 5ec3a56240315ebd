"""Pair facts and gates on literal cards, and the loop of assignment and inspection against a plain one."""

import random

from pyspark.sql import functions as F

from driftline.operators import recovery
from tests.test_assignment import highest

SCHEMA = "bank string, table_id string, title string, summary string, indicators array<string>, headers array<string>, notes array<string>, row_count int"


def _cards(spark, rows):
    return recovery.normalized(spark.createDataFrame([("b", *r) for r in rows], SCHEMA))


OLD = [
    ("p1", "Tableau 3 Ratios au 31 janvier 2024", "Ratios de fonds propres", ["Ratio CET1", "Ratio de levier", "Fonds propres"], ["T1 2024"], ["Selon Bâle III"], 3),
    ("p2", "Liquidité", "", ["Actifs liquides"], ["Montant"], None, 4),
    ("p3", "Autre", None, ["Encaisse", "Dépôts stables", "Prêts"], [], ["Note commune"], 10),
    ("p4", "", "", None, None, None, None),
]
NEW = [
    ("c1", "Tableau 4 Ratios au 31 juillet 2024", "Ratios de fonds propres", ["Ratio CET1", "Ratio de levier", "Actifs pondérés"], ["T2 2024"], ["Selon Bâle III"], 3),
    ("c2", "Liquidité", "", ["Actifs liquides"], ["Montant"], [], 5),
    ("c3", "Encore", None, ["Encaisse", "Titres"], [], ["Note commune"], 9),
    ("c4", "", "", [], [], [], 0),
]


def test_facts_and_gates(spark):
    old, new = _cards(spark, OLD), _cards(spark, NEW)
    pairs = spark.createDataFrame([("b", "p1", "c1"), ("b", "p2", "c2"), ("b", "p3", "c3"), ("b", "p4", "c4"), ("b", "p1", "c9")], "bank string, previous_id string, current_id string")
    rows = {r["current_id"]: r for r in recovery.partitioned(pairs, old, new, ["bank"]).withColumns({"gate": recovery.objective(), "e": recovery.evidence()}).collect()}
    a = rows["c1"]
    assert a["title_exact"] and a["summary_exact"] and a["indicator_common_count"] == 2 and a["row_ratio"] == 1.0 and a["footnote_jaccard"] == 1.0
    assert abs(a["e"] - (0.5 * 2 / 3 + 0.15 * 0.5 + 0.1 * a["header_jaccard"] + 0.1 + 0.15)) < 1e-9 and a["is_trusted"]
    assert rows["c2"]["gate"] and rows["c2"]["indicator_jaccard"] == 1.0 and rows["c2"]["is_trusted"]  # one row, the same title
    assert rows["c3"]["gate"] and not rows["c3"]["is_trusted"]  # by its note and a shared row
    assert not rows["c4"]["gate"] and rows["c4"]["row_ratio"] == 0.0 and rows["c4"]["indicator_jaccard"] == 0.0
    assert rows["c9"]["indicator_common_count"] is None and not rows["c9"]["gate"] and not rows["c9"]["is_trusted"]


def test_shortlist_keeps_objective_pairs(spark):
    old, new = _cards(spark, OLD), _cards(spark, NEW)
    similar = spark.createDataFrame([("b", "p4", "c1", 0.9), ("b", "p3", "c1", 0.8), ("b", "p1", "c4", 0.7)], "bank string, previous_id string, current_id string, similarity double")
    listed = recovery.shortlist(similar, old, new, ["bank"], 1)
    assert {(r["previous_id"], r["current_id"]) for r in listed.collect()} == {("p4", "c1"), ("p1", "c1"), ("p1", "c4"), ("p2", "c2"), ("p3", "c3")}
    verdicts = spark.createDataFrame([("b", "p1", "c1", "same_table", 0.9), ("b", "p4", "c1", "same_table", 0.99), ("b", "p2", "c2", "same_table", 0.5), ("b", "p3", "c3", "different", 0.9), ("b", "p2", "c1", "same_table", 1.0)], "bank string, previous_id string, current_id string, verdict string, confidence double")
    chosen = recovery.judged(listed, verdicts, ["bank"], 0.7)
    edges = chosen.collect()
    assert [(e["previous_id"], e["current_id"]) for e in edges] == [("p1", "c1")] and abs(edges[0]["score"] - (0.8 * 0.9 + 0.2 * edges[0]["evidence"])) < 1e-12
    decided = {r["current_id"]: r["decision"] for r in recovery.decisions(new, chosen, ["bank"]).collect()}
    assert decided == {"c1": "matched", "c2": "added", "c3": "added", "c4": "added"}


def test_loop_ends_with_confirmed_pairs(spark):
    r = random.Random(8)
    rows = [(bank, f"p{a}", f"c{b}", round(r.random(), 3), r.random() < 0.5) for bank in "xyz" for a in range(5) for b in range(5) if r.random() < 0.7]
    edges = spark.createDataFrame([x[:4] for x in rows], "bank string, previous_id string, current_id string, score double")
    ok = spark.createDataFrame([(*x[:3], "confirmed", 0.9) for x in rows if x[4]] + [(*x[:3], "confirmed", 0.5) for x in rows if not x[4]], "bank string, previous_id string, current_id string, verdict string, confidence double")
    asked = []

    def inspect(pairs):
        asked.append({tuple(p)[:3] for p in pairs.collect()})
        return pairs.drop("score").join(ok, ["bank", "previous_id", "current_id"])

    found, took = recovery.recovered(edges, ["bank"], inspect)
    found, good = found.collect(), {x[:3] for x in rows if x[4]}
    assert {(f["bank"], f["previous_id"], f["current_id"]) for f in found} <= good
    for bank in "xyz":
        assert abs(sum(f["score"] for f in found if f["bank"] == bank) - highest([x[1:4] for x in rows if x[0] == bank and x[4]])) < 1e-9
    assert took["inspected"] == sum(map(len, asked)) == len(set().union(*asked)) and took["refused"] == len(set().union(*asked) - good) > 0
    none = recovery.recovered(edges.limit(0), ["bank"], inspect)
    assert none[0].count() == 0 and none[1]["rounds"] == 1


def test_only_blocks_with_refusals_are_assigned_again(spark, monkeypatch):
    edges = spark.createDataFrame([("x", "p1", "c1", 0.9), ("y", "p1", "c1", 0.9), ("y", "p2", "c1", 0.8)], "bank string, previous_id string, current_id string, score double")
    worked, assign = [], recovery.optimal
    monkeypatch.setattr(recovery, "optimal", lambda pairs, least: worked.append(pairs.count()) or assign(pairs, least))
    bad = (F.col("bank") == "y") & (F.col("previous_id") == "p1")
    found, took = recovery.recovered(edges, ["bank"], lambda pairs: pairs.select("bank", "previous_id", "current_id", F.when(bad, "rejected").otherwise("confirmed").alias("verdict"), F.lit(0.9).alias("confidence")))
    assert sorted((f["bank"], f["previous_id"]) for f in found.collect()) == [("x", "p1"), ("y", "p2")]
    assert worked == [3, 1] and took == {"rounds": 2, "inspected": 3, "refused": 1}
