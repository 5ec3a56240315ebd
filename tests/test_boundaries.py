"""Bounds of sections against a plain version that goes through one report at a time."""

import random
import re

from driftline.operators import boundaries

STARTS = {"capital": ["gestion du capital", "gestion des fonds propres"], "risques": ["gestion des risques"]}
TITLES = ["gestion du capital", "gestion du", "gestion des risques du groupe", "gestion des", "risque de credit", "etats financiers", "gestion des fonds propr", "la gestion des fonds propres", "glossaire"]


def plain_hits(entries):
    hits = {}
    for concept in {e[0] for e in entries if e[0]}:
        items = [(t, p) for c, t, p in entries if c == concept and p is not None]
        starts = STARTS.get(concept, [])
        body = [i for i in items if i[1] >= 45]
        if not body and starts and not any(t == s or t.replace(" ", "") == s.replace(" ", "") or s in t for t, _ in items for s in starts):
            continue

        def fit(t):
            return 3 if t in starts else 2 if any((s.startswith(t) and len(t) >= 18) or s in t for s in starts) else 0

        pool = sorted(body or items)
        if pool:
            best = max((fit(t), p, len(t) <= 70) for t, p in pool)
            hits[concept] = min((t, p) for t, p in pool if (fit(t), p, len(t) <= 70) == best)
    return hits


def plain_bounds(hits, entries):
    order, out = sorted(hits, key=lambda c: (hits[c][1], c)), {}
    for i, c in enumerate(order):
        if i + 1 < len(order):
            end = hits[order[i + 1]][1] - 1
        else:
            later = [p for k, t, p in entries if p is not None and p > hits[c][1] and not re.match(r"risque\s+", t) and k != c]
            end = min(later) - 1 if later else None
        out[c] = (hits[c][0], hits[c][1], end)
    return out


def _reports(n=40, seed=3):
    r = random.Random(seed)
    return {i: [(r.choice([None, "capital", "risques"]), r.choice(TITLES), r.choice([None, r.randint(1, 44), r.randint(45, 90), r.randint(1, 90)])) for _ in range(r.randint(0, 7))] for i in range(n)}


def test_bounds_equal_plain(spark):
    reports = _reports()
    entries = spark.createDataFrame([(i, *e) for i, es in reports.items() for e in es], "id int, concept string, title string, page int")
    hits = boundaries.concept_hits(entries, ["id"], spark.createDataFrame(list(STARTS.items()), "concept string, starts array<string>"))
    got = {(r["id"], r["concept"]): (r["title"], r["page"], r["end_page"]) for r in boundaries.bounds(hits, entries, ["id"]).collect()}
    want = {(i, c): b for i, es in reports.items() for c, b in plain_bounds(plain_hits(es), es).items()}
    assert got == want and len(got) > 20


def test_resolved(spark):
    found = spark.createDataFrame([(1, "capital", "c", 50, None, None), (1, "risques", "r", 60, 80, "x"), (2, "capital", "c", 50, 99, "x"), (3, "capital", "c", 70, 75, "x"), (4, "capital", "c", 50, 90, "x"), (4, "risques", "r", 52, None, None)], "id int, concept string, title string, page int, end_page int, end_title string")
    reports = spark.createDataFrame([(1, 0.9, True, 100), (2, 0.3, True, 100), (3, 0.9, True, 100), (4, 0.9, True, 100), (5, 0.9, False, 100)], "id int, confidence double, has_anchor boolean, total_pages int")
    titles = spark.createDataFrame([(2, "risques", "alt r", 40, 55, "title_end"), (3, "risques", "alt r", 72, None, None), (4, "capital", "alt c", 50, 51, "title_end"), (4, "risques", "alt r", 52, 70, "title_end"), (1, "risques", "alt r", 61, 75, "title_end")], "id int, concept string, title string, page int, end_page int, end_method string")
    rows = {(r["id"], r["concept"]): tuple(r)[2:] for r in boundaries.resolved(reports, found, ["id"], ["capital", "risques"], titles).collect()}
    assert rows[1, "capital"] == ("c", 50, 59, "contents", "next_section", False)
    assert rows[1, "risques"] == ("r", 60, 75, "contents", "title_end", False)  # its title's own end is earlier
    assert rows[2, "capital"] == (None, None, None, "unresolved", None, False) and rows[2, "risques"] == ("alt r", 40, 55, "title", "title_end", False)
    assert rows[3, "capital"] == ("c", 70, 71, "contents", "next_section", True) and rows[3, "risques"] == ("alt r", 72, None, "title", "no_successor", False)
    assert rows[4, "capital"] == ("c", 50, 51, "contents", "next_section", True) and rows[4, "risques"] == ("r", 52, 70, "contents", "title_end", False)
    assert rows[5, "capital"][3] == rows[5, "risques"][3] == "unresolved"


def test_cross_validated(spark):
    """Agreement, disagreement with and without leave to move the pages, and content."""
    detections = [
        ("same", "section", 50, 60), ("same", "toc", 50, None), ("same", "scan", 50, 60),
        ("apart", "section", 10, 20), ("apart", "toc", 50, None), ("apart", "scan", 52, 70), ("apart", "scan", 51, 72),
        ("kept", "section", 10, 20), ("kept", "toc", 50, None), ("kept", "scan", 52, 70), ("alone", "section", 5, 9),
    ]
    sections = [("same", 50, 60, 0.9, False, 0.5, True), ("apart", 10, 20, 0.9, False, 1.0, True), ("kept", 10, 20, 0.9, True, 0.0, False), ("alone", 5, 9, 0.6, False, None, True), ("none", 7, None, 0.2, False, 0.0, False)]
    rows = boundaries.cross_validated(spark.createDataFrame(sections, "id string, start_page int, end_page int, confidence double, keep_bounds boolean, content_score double, content_valid boolean"), spark.createDataFrame(detections, "id string, source string, start_page int, end_page int"), ["id"])
    got = {r["id"]: (r["start_page"], r["end_page"], round(r["confidence"], 9), r["is_corrected"]) for r in rows.collect()}
    # apart: starts 10, 50, 51, 52 of weights 1, .8, .6, .6: half of 3 is reached at 50; ends 20, 70, 72 of 1, .6, .6 at 70.
    assert got == {"same": (50, 60, 1.0, False), "apart": (50, 70, 0.8, True), "kept": (10, 20, 0.2, False), "alone": (5, 9, 0.6, False), "none": (7, None, 0.0, False)}


def test_medians_equal_plain(spark):
    r = random.Random(5)
    rows = [(i, r.choice(["section", "toc", "scan", "other"]), r.choice([None, r.randint(1, 9)]), r.choice([None, r.randint(9, 20)])) for i in range(40) for _ in range(r.randint(1, 6))]
    got = {x["id"]: (x["median_start_page"], x["median_end_page"]) for x in boundaries.medians(spark.createDataFrame(rows, "id int, source string, start_page int, end_page int"), ["id"]).collect()}

    def median(pairs):
        pairs, total = sorted(pairs), sum(w for _, w in pairs)
        return next((p for i, (p, _) in enumerate(pairs) if sum(w for _, w in pairs[: i + 1]) >= total / 2 - 1e-9), None)

    weight = {**boundaries.SOURCES, "other": 0.0}
    for i in range(40):
        mine = [x for x in rows if x[0] == i]
        want = (median([(x[2], weight[x[1]]) for x in mine if x[2] is not None]), median([(x[3], weight[x[1]]) for x in mine if x[3] is not None and x[1] != "toc"]))
        assert got.get(i, (None, None)) == want


def test_suspicious(spark):
    from pyspark.sql import functions as F

    cases = [(1, 10, 100, False), (1, 2, 100, True), (1, 60, 100, True), (None, 5, 9, True), (1, None, 9, True), (1, 9, 10, True), (1, 9, None, False), (0, 9, 0, True)]
    rows = spark.createDataFrame([c[:3] for c in cases], "s int, e int, t int").select(boundaries.suspicious(F.col("s"), F.col("e"), F.col("t"))).collect()
    assert [x[0] for x in rows] == [c[3] for c in cases]
