"""Contents, titles, intervals, votes, the review queue and merged tables by cases with known answers."""

import pytest
from pyspark.sql import functions as F

from driftline.functions import geometry
from driftline.operators import diff, matching, metrics, reconcile, review, sections
from tests.test_labels import column


def test_contents_lines(spark):
    given = ["Gestion du capital ..... 25", "  sous-section 30-35", "Acquisition 4 Gestion du capital 25", "16 Bénéfice net 43 Gestion des risques", "Page 2", "Sans numéro", None]
    got = column(spark, given, sections.toc_entries)
    assert [[tuple(e) for e in r] for r in got] == [
        [("Gestion du capital", 25, 0)], [("sous-section", 30, 1)], [("Acquisition", 4, 0), ("Gestion du capital", 25, 0)], [("Bénéfice net", 16, 0), ("Gestion des risques", 43, 0)], [], [], []]


def test_sections_in_contents(spark):
    rows = [("r", "Gestion du capital", 20, 0), ("r", "Fonds propres", 22, 1), ("r", "Gestion des risques", 30, 0), ("r", "Risque de crédit", 33, 0), ("r", "Questions comptables", 50, 0)]
    entries = spark.createDataFrame(rows, "r string, title string, page int, level int")
    got = sections.sections_in_toc(entries, ["r"], {"capital": "gestion du capital", "risques": "gestion des risques|risque de"}).collect()
    assert {(x["section"], x["start_page"], x["end_page"]) for x in got} == {("capital", 20, 29), ("risques", 30, 49)}


def test_start_near_an_estimate(spark):
    pages = spark.createDataFrame([("r", 3, "Gestion du capital"), ("r", 9, "x\nGESTION DU CAPITAL\n"), ("r", 14, "Gestion des risques")], "r string, page int, text string")
    names = spark.createDataFrame([("c", "Gestion du capital"), ("k", "Gestion des risques")], "section string, name string")
    asked = spark.createDataFrame([("r", "c", 8), ("r", "k", 8), ("r", "z", 8)], "r string, section string, estimated_page int")
    got = {x["section"]: x["start_page"] for x in sections.start_near(pages, ["r"], asked, names).collect()}
    assert got == {"c": 9, "k": 14, "z": None}


def test_page_offsets(spark):
    pages = spark.createDataFrame([("a", p, f"Titre numero {p - 2}\ncorps") for p in range(5, 12)] + [("b", 1, "rien")], "r string, page int, text string")
    entries = spark.createDataFrame([("a", f"Titre numero {p}", p) for p in (4, 6, 8)] + [("b", "Un autre titre", 5)], "r string, title string, page int")
    got = {x["r"]: (x["offset"], x["status"]) for x in sections.page_offset(pages, ["r"], entries).collect()}
    assert got == {"a": (2, "inferred_override"), "b": (0, "configured_no_anchor")}


def test_ranges_and_windows(spark):
    ranges = spark.createDataFrame([("r", 0, 2), ("r", 40, 30)], "r string, start_page int, end_page int")
    wide = sections.padded(ranges, ["r"], 2)
    assert {(x["start_page"], x["end_page"]) for x in wide.collect()} == {(1, 4), (38, 42)}
    pages = spark.createDataFrame([("r", p) for p in range(1, 60)], "r string, page int")
    assert sorted(x["page"] for x in sections.pages_within(pages, wide, ["r"]).collect()) == [1, 2, 3, 4, 38, 39, 40, 41, 42]
    box = lambda *v: F.array(*map(F.lit, v))
    none = F.lit(None).cast("array<double>")
    window = lambda page: spark.range(1).select(sections.section_window(F.lit(page), F.lit(3), F.lit(5), box(0.1, 0.2, 0.9, 0.3), F.lit(5), box(0.1, 0.6, 0.9, 0.7), none)).first()[0]
    assert [tuple(window(p)) for p in (3, 4, 5)] == [(0.3, 1.0), (0.0, 1.0), (0.0, 0.6)]
    assert column(spark, ["x"], lambda _: sections.x_clusters(box(0.1, 0.12, 0.5, 0.9, 0.52))) == [3]


def test_zones_and_room(spark):
    rows = [("p", [0.1, 0.1, 0.9, 0.3]), ("p", [0.1, 0.36, 0.9, 0.8])]
    df = spark.createDataFrame(rows, "p string, box array<double>")
    zones = [x["zone"] for x in sections.footnote_zones(df, ["p"], "box").orderBy(F.col("box")[1]).collect()]
    assert zones[0] == pytest.approx([0.1, 0.3, 0.9, 0.36]) and zones[1] == pytest.approx([0.1, 0.8, 0.9, 0.94])
    room = sections.crop_room(df, ["p"], "box").orderBy(F.col("box")[1]).collect()
    assert room[0]["bottom_room"] == pytest.approx(0.03) and room[1]["bottom_room"] == pytest.approx(0.06)


def test_segments_and_missing_blocks(spark):
    rows = [(1, "Gestion du capital", "heading"), (2, "a", "text"), (3, "Notes", "heading"), (4, "b", "text"), (5, "Gestion du capital", "heading"), (6, "c", "text")]
    df = spark.createDataFrame([("r", *x) for x in rows], "r string, position int, text string, kind string")
    opens = F.when(F.col("text") == "Gestion du capital", "capital")
    closes = F.when(F.col("text") == "Notes", "capital")
    got = {x["position"]: x["section"] for x in sections.assigned_segments(df, ["r"], opens, closes).collect()}
    assert got == {1: "capital", 2: "capital", 3: None, 4: None, 5: None, 6: None}
    rendered = spark.createDataFrame([("r", "gestion ... A b!")], "r string, markdown string")
    assert [x["text"] for x in sections.missing_blocks(df, rendered, ["r"]).collect()] == ["c"]


def test_decoy_page(spark):
    numbered = "\n".join(f"{i} recommandation" for i in range(1, 25))
    assert column(spark, [numbered, "un\ndeux", "\n".join(["x"] * 30)], sections.decoy_page) == [True, False, False]


def test_review_queue(spark):
    raw = [(1, "t1", "indicator", "added", "A", "pending"), (2, "t1", "indicator", "added", " a", "approved"), (3, "t1", "footnote", "removed", "B", "rejected"), (4, "t2", "indicator", "added", "A", "approved"), (5, "t2", "indicator", "table_removed", "", "approved")]
    df = spark.createDataFrame(raw, "position int, table_id_t1 string, item_type string, change_type string, name string, status string").withColumn("confidence", F.lit(0.5))
    queue = review.queue(df)
    assert {(x["table_key"], x["type"], x["position"]) for x in queue.collect()} == {("::::t1|", "indicator_added", 1), ("::::t1|", "footnote_removed", 3), ("::::t2|", "table_removed", 5)}
    got = {x["table_key"]: (x["total_changes"], x["pending"], x["table_status"], x["decision"]) for x in review.tables(queue).collect()}
    assert got == {"::::t1|": (2, 1, "partial", "pending"), "::::t2|": (1, 0, "completed", "approved")}
    rows = spark.createDataFrame([("aucune", "CAPITAL", "MAJEUR"), ("revue_prioritaire", "x", None), ("revue_prioritaire", "RISQUE", "MINEUR")], "a string, c string, i string")
    ordered = rows.orderBy(review.item_priority(F.col("a"), F.col("c"), F.col("i"))).collect()
    assert [x["c"] for x in ordered] == ["RISQUE", "x", "CAPITAL"]


def test_fragments(spark):
    long = "la banque suit de près les ratios de liquidité exigés par les autorités de surveillance " * 2
    rows = [("s", 1, "removed", long, None), ("s", 2, "added", None, long + "fin"), ("s", 3, "added", None, "tout autre chose " * 8), ("u", 4, "added", None, long)]
    df = spark.createDataFrame(rows, "section string, node long, diff_type string, source_text_t1 string, source_text_t2 string")
    got = reconcile.marked(reconcile.edges(reconcile.one_sided(df))).collect()
    assert [(x["a"], x["b"], x["strength"]) for x in got] == [(1, 2, "strong")]


def test_duplicates_and_merges(spark):
    df = spark.createDataFrame([(1, "added", [1.0, 0.0]), (2, "added", [0.99, 0.05]), (3, "removed", [1.0, 0.0])], "id long, diff_type string, embedding array<double>").withColumns({"alignment_decision": F.lit(""), "source_text_t1": F.lit("a"), "source_text_t2": F.lit("b")})
    groups = reconcile.semantic_duplicates(df)
    assert {(x["id"], x["group"]) for x in groups.collect()} == {(1, 1), (2, 1), (3, 3)}
    verdicts = spark.createDataFrame([(1, "MAJEUR"), (2, "MINEUR"), (3, "MODERE")], "id long, impact string")
    assert {(x["id"], x["impact"], x["is_propagated"]) for x in reconcile.propagated(verdicts, groups, ["impact"]).collect()} == {(1, "MAJEUR", False), (2, "MAJEUR", True), (3, "MODERE", False)}
    pages = spark.createDataFrame([("k", 1, "a", [3, 1]), ("k", 2, "b", [2, 3])], "k string, i int, t string, pages array<int>")
    assert [tuple(x) for x in reconcile.merged_changes(pages, ["k"], "i").collect()] == [("k", 1, "a", [1, 2, 3], 2)]
    got = spark.range(1).select(reconcile.deduped_labels(F.array(*map(F.lit, ["a", " a", "b", ""])))).first()[0]
    assert (got["labels"], got["ratio"], got["removed"]) == (["a", "b"], 0.5, 2)


def test_richest_tables(spark):
    rows = [("p", 1, [0.1, 0.1, 0.9, 0.5], ["Prêts", "Dépôts"], [], [], "T"), ("p", 2, [0.1, 0.1, 0.9, 0.5], ["Prêts (1)", "Dépôts", "Actions"], [], [], "T"), ("p", 3, [0.1, 0.6, 0.9, 0.9], ["Prêts"], [], [], "T")]
    df = spark.createDataFrame(rows, "p string, k int, box array<double>, labels array<string>, headers array<string>, notes array<string>, title string")
    assert {(x["k"], x["merged"]) for x in reconcile.richest_tables(df, ["p"], "k", "box").collect()} == {(2, 2), (3, 1)}
    titles = spark.createDataFrame([("p", "Gestion du capital"), ("p", "Gestion du capital et liquidité"), ("p", "Autre")], "p string, t string")
    assert {x["t"] for x in reconcile.shorter_titles(titles, ["p"], "t").collect()} == {"Gestion du capital", "Autre"}


def test_renames_take_the_best_free_label(spark):
    rows = [("g", "a", "x", 0.9), ("g", "a", "y", 0.8), ("g", "b", "x", 0.95), ("g", "c", "y", 0.85), ("g", "c", "z", 0.8)]
    got = diff.renames(spark.createDataFrame(rows, "g string, removed string, added string, score double"), ["g"]).collect()
    assert {(x["removed"], x["added"]) for x in got} == {("a", "x"), ("c", "y")}


def test_one_to_one_equals_a_sorted_list(spark):
    import random

    rng = random.Random(5)
    rows = [(b, i, j, round(rng.random(), 2)) for b in "pq" for i in range(25) for j in range(20)]
    used, want = set(), set()
    for b, i, j, s in sorted(rows, key=lambda r: (-r[3], r[1], r[2])):
        if (b, "l", i) not in used and (b, "r", j) not in used:
            used |= {(b, "l", i), (b, "r", j)}
            want.add((b, i, j))
    got = matching.one_to_one(spark.createDataFrame(rows, "block string, left long, right long, score double"), [F.col("score")])
    assert {(x["block"], x["left"], x["right"]) for x in got.collect()} == want


def test_box_profiles(spark):
    box = F.array(*map(F.lit, (0.0, 0.0, 0.5, 0.5)))
    assert spark.range(1).select(geometry.area(box)).first()[0] == 0.25
    got = metrics.section_health(spark.createDataFrame([("r", "a", 0.9), ("r", "b", 0.5), ("q", "a", 0.9)], "r string, section string, confidence double"), ["r"], ["a", "b"])
    assert {(x["r"], x["status"]) for x in got.collect()} == {("r", "low_confidence"), ("q", "missing")}
