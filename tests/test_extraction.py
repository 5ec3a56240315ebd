"""Worth of row labels on known cases and against plain versions."""

import random

from pyspark.sql import functions as F

from driftline.functions import extraction

LABELS = ["Total", "Autres canada", "T1 2024", "2024", "Q 3", " ", "", None, "Prêts hypothécaires", "Ce tableau montre tout", "Le total de la banque et des filiales au Canada", "Fin.", "Rapport de gestion", "12,5", "Dépôts stables", "total du", "États-Unis", "Others", "q5"]
WANT = {"weak": {"Total", "Autres canada", "T1 2024", "2024", "Q 3", " ", "", None, "États-Unis", "Others"}, "prose": {"Ce tableau montre tout", "Le total de la banque et des filiales au Canada", "Fin.", "Rapport de gestion"}, "period": {"T1 2024", "2024", "Q 3", " ", "", None}}


def test_labels(spark):
    rows = spark.createDataFrame([(x,) for x in LABELS], "x string").select("x", extraction.weak(F.col("x")).alias("weak"), extraction.prose(F.col("x")).alias("prose"), extraction.period_like(F.col("x")).alias("period")).collect()
    for what, want in WANT.items():
        assert {r["x"] for r in rows if r[what]} == want, what


def test_tables(spark):
    cases = [
        ("Ratios", ["Prêts", "Dépôts", "Total"], ["A", "B"], False, (3, 2, 0, True)),
        ("Rapport de gestion", ["Prêts"], [], False, (1, 1, 2, False)),
        ("", ["T1 2024", "T2 2024", "2023"], ["A", "B"], False, (2, 0, 0, True)),
        ("", ["T1 2024", "T2 2024"], ["A"], False, (0, 0, 0, False)),
        (None, ["Prêts", "Ce tableau montre"], None, None, (1, 1, 2, False)),
        ("Ratios", ["Prêts", "Dépôts"], [], True, (2, 2, 0, False)),
        (None, None, None, False, (0, 0, 0, False)),
        ("Ratios", ["Rapport annuel", "12", None, " "], [], False, (0, 0, 0, False)),
    ]
    frame = spark.createDataFrame([c[:4] for c in cases], "t string, l array<string>, h array<string>, n boolean")
    t, l, h, n = (F.col(c) for c in "tlhn")
    got = frame.select(extraction.structural_rows(l, h), extraction.viable_rows(l), extraction.contamination(t, l), extraction.viable(t, l, h, n)).collect()
    assert [tuple(r) for r in got] == [c[4] for c in cases]


def test_right_column(spark):
    heads, first = ["Montant", "Taux", "Note"], ["Prêts", "Dépôts"]
    tail = ["un deux trois quatre cinq six sept huit neuf dix", "a b c d e f 7"]
    cases = [(heads, first, [*first, *tail], 3), (heads[:2], first, [*first, *tail], 0), (heads, first, [*first, tail[0]], 0), (heads, first, ["Autre", *first, *tail], 0), (heads, [], tail, 0), (heads, first, first, 0), (["2024", "Taux", "Note"], first, [*first, *tail], 0), (heads, first, [*first, "x", "y"], 0), (None, None, None, 0), (heads, first, [*first, tail[0], "court"], 2)]
    frame = spark.createDataFrame([(h, f, l) for h, f, l, _ in cases], "h array<string>, f array<string>, l array<string>")
    assert [r[0] for r in frame.select(extraction.right_column_bleed(F.col("l"), F.col("h"), F.col("f"))).collect()] == [c[3] for c in cases]


def test_counts_equal_plain(spark):
    r = random.Random(2)
    tables = [[r.choice(LABELS) for _ in range(r.randint(0, 8))] for _ in range(60)]
    weak, prose = WANT["weak"], WANT["prose"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(tables)], "i int, l array<string>")
    for row, labels in zip(frame.select("i", extraction.viable_rows(F.col("l")).alias("n")).orderBy("i").collect(), tables):
        assert row["n"] == sum(x not in weak and x not in prose and any(c.isalpha() for c in x) for x in labels)


def test_small_letters_of_a_label_are_made_once(spark):
    rule = spark.range(1).select(extraction.prose(F.col("id").cast("string")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert rule.count("regexp_replace(") == 1
