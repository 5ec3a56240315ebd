"""Segments joined again, against a version that goes through a report in order."""

import random

from pyspark.sql import functions as F

from driftline.operators import segments

SCHEMA = "report int, position int, kind string, text string, page int"
OPEN = ["La banque a augmenté les provisions pour", "Le comité a revu la politique de crédit et", "Le ratio demeure supérieur à la cible de la"]
GOES_ON = ["les pertes de crédit attendues du trimestre.", "le plan de financement de la banque.", "direction, selon le modèle interne de"]
WHOLE = ["Le trimestre est clos.", "Les prêts ont augmenté de dix pour cent."]


def plain_reunited(rows, merges, ok):
    """``merges`` are pairs whose texts go on in each other, ``ok`` the confirmed ones."""
    kinds, pages, taken, seen = {p: k for _, p, k, _, _ in rows}, {p: g for _, p, _, _, g in rows}, set(), []
    for p in sorted(kinds):
        if p in taken or kinds[p] != "paragraph" or kinds.get(p + 1, "paragraph") == "paragraph":
            continue
        far = [q for q in range(p + 2, p + 13) if q in kinds and q not in taken and kinds[q] == "paragraph" and (pages[p] is None or pages[q] is None or abs(pages[p] - pages[q]) <= 1) and (p, q) in merges]
        if len(far) == 1:
            status = "joined" if (p, far[0]) in ok else "refused"
            taken |= {far[0]} if status == "joined" else set()
            seen.append((p, far[0], status))
        elif far:
            seen.append((p, far[0], "ambiguous"))
    return seen


def test_reunited_as_in_order(spark):
    r, rows = random.Random(9), []
    for report in range(25):
        for p in range(r.randint(1, 30)):
            kind = r.choice(["paragraph", "paragraph", "table", "heading"])
            rows.append((report, p, kind, r.choice(OPEN + GOES_ON + WHOLE * 3), r.choice([None, 1 + p // 8, 1 + p // 8])))
    frame = spark.createDataFrame(rows, SCHEMA)
    every = [(a[0], a[1], b[1], a[3], b[3]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] <= a[1] + 12]
    block = lambda c: F.struct(F.lit("paragraph").alias("kind"), F.col(c).alias("text"), F.lit(False).alias("hard"))
    known = spark.createDataFrame(every, "report int, p int, q int, a string, b string")
    merges = {tuple(x) for x in known.where(segments.boundary(block("a"), block("b"))["disposition"] == "merge").select("report", "p", "q").collect()}
    ok = [m for m in sorted(merges) if r.random() < 0.7]
    out, seen = segments.reunited(frame, ["report"], spark.createDataFrame(ok, "report int, position int, next int"))
    want = {(i, *s) for i in range(25) for s in plain_reunited([x for x in rows if x[0] == i], {m[1:] for m in merges if m[0] == i}, {m[1:] for m in ok if m[0] == i})}
    got = {tuple(x) for x in seen.collect()}
    assert got == want and {s for *_, s in got} == {"joined", "refused", "ambiguous"}
    text, joined = {(i, p): t for i, p, _, t, _ in rows}, {(i, p): q for i, p, q, s in want if s == "joined"}
    gone = {(i, q) for (i, _), q in joined.items()}
    assert {(x["report"], x["position"]): x["text"] for x in out.collect()} == {k: t if k not in joined else f"{t} {text[k[0], joined[k]]}" for k, t in text.items() if k not in gone}


def test_repaired(spark):
    rows = [
        (1, 0, "paragraph", OPEN[0] + " ", 1), (1, 1, "paragraph", " " + GOES_ON[2], 1), (1, 2, "paragraph", GOES_ON[0], 2), (1, 3, "paragraph", WHOLE[0], 2),
        (2, 0, "paragraph", OPEN[0], 1), (2, 1, "paragraph", GOES_ON[0], 3), (3, 0, "paragraph", OPEN[0], None), (3, 1, "table", GOES_ON[0], 1), (3, 2, "paragraph", None, 1),
    ]
    got = {(x["report"], x["position"]): (x["text"], x["parts"]) for x in segments.repaired(spark.createDataFrame(rows, SCHEMA), ["report"]).collect()}
    assert got[1, 0] == (f"{OPEN[0]} {GOES_ON[2]} {GOES_ON[0]}", [0, 1, 2]) and got[1, 3] == (WHOLE[0], [3])
    assert (2, 1) in got and (3, 1) in got and got[3, 2] == ("", [2])  # two pages apart, another kind, nothing
    unsure = [(1, 0, "paragraph", "Les provisions ont augmenté avec la croissance du portefeuille de prêts", 1), (1, 1, "paragraph", "Canada et États-Unis sont les marchés où la banque exerce ses activités.", 1)]
    frame = spark.createDataFrame(unsure, SCHEMA)
    assert segments.repaired(frame, ["report"]).count() == 2
    assert segments.repaired(frame, ["report"], spark.createDataFrame([(1, 1)], "report int, position int")).count() == 1


def test_deduplicated(spark):
    rows = [(1, 0, "paragraph", "a", 1), (1, 1, "paragraph", "A", 1), (1, 2, "table", "a", 1), (1, 3, "paragraph", "a", 1), (1, 4, "list_item", "a", 1), (1, 5, "list_item", "a", 1), (1, 6, "list_item", "a", 1), (1, 7, "paragraph", "", 1), (1, 8, "paragraph", "", 1)]
    got = segments.deduplicated(spark.createDataFrame(rows, SCHEMA), ["report"], F.lower("text"))
    assert sorted(r["position"] for r in got.collect()) == [0, 2, 3, 4, 7, 8]
