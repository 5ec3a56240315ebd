import difflib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.functions import geometry, period, predicates, similarity, text
from driftline.operators import diff, graph, matching, metrics, sequence


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0] if values else spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("year, quarter, want", [(2025, 1, (2024, 3)), (2025, 2, (2025, 1)), (2025, 3, (2025, 2)), (2025, 4, (2024, 4))])
def test_comparable_period(spark, year, quarter, want):
    y, q = F.lit(year), F.lit(quarter)
    assert tuple(spark.range(1).select(period.previous_year(y, q), period.previous_quarter(q)).first()) == want


@pytest.mark.parametrize("value, want", [("T2 2025", (2025, 2)), ("Q2-2025", (2025, 2)), ("2025_t2", (2025, 2)), ("none", (None, None))])
def test_quarter_ref(spark, value, want):
    assert tuple(one(spark, period.parse_quarter_ref(F.lit(value)))) == want


def test_quarter_errors(spark):
    assert one(spark, period.normalize_quarter(F.lit("Q3"))) == "t3"
    with pytest.raises(Exception, match="no quarter"):
        one(spark, period.normalize_quarter(F.lit("year")))


def test_text_cleaning(spark):
    assert one(spark, text.joined_letters(F.lit("T o t a l net"))) == "Total net"
    assert one(spark, text.unstuttered(F.lit("TToottaall net"))) == "Total net"
    assert one(spark, text.masked_numbers(F.lit("de 1 234,5 % à 7"))) == "de <nombre> à <nombre>"
    assert one(spark, text.unescaped(F.lit("a &amp;lt; b&nbsp;c"))) == "a &lt; b c"
    assert one(spark, text.footnote_key(F.lit("Voir pages 12 à 14 au 2025-01-31"))) == "voir __PAGE__ au __DATE__"


def test_predicates(spark):
    long = "La banque a maintenu une position de capital solide et les ratios de liquidité sont demeurés au-dessus des exigences réglementaires applicables pendant tout le trimestre."
    assert one(spark, predicates.narrative(F.lit(long)))
    assert not one(spark, predicates.narrative(F.lit("1 2 3 4 5")))
    assert one(spark, predicates.dense_numeric_line(F.lit("a\nw 1 x 2 y 3 z 4")))
    assert one(spark, predicates.short_label(F.lit("Risque de crédit")))


def test_boxes(spark):
    a, b = F.array(*map(F.lit, (0.0, 0.0, 0.5, 0.5))), F.array(*map(F.lit, (0.25, 0.25, 0.5, 0.75)))
    assert one(spark, geometry.overlap_of_first(a, b)) == pytest.approx(0.25)
    assert one(spark, geometry.overlap_of_smaller(a, b)) == pytest.approx(0.5)
    assert one(spark, geometry.valid(a)) and not one(spark, geometry.valid(F.array(F.lit(0.0))))


def test_similarity(spark):
    x, y = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))
    assert one(spark, similarity.cosine(x, y)) == pytest.approx(2**-0.5)
    assert one(spark, similarity.cosine(x, F.array(F.lit(0.0), F.lit(0.0)))) == 0
    df = spark.createDataFrame([("tide", "diet"), ("diet", "tide"), (None, "x")], "a string, b string")
    got = [r[0] for r in df.select(similarity.sequence_ratio("a", "b")).collect()]
    assert got == [difflib.SequenceMatcher(None, a or "", b, autojunk=False).ratio() for a, b in (("tide", "diet"), ("diet", "tide"), ("", "x"))]


def test_footnotes(spark):
    schema = "g int, note string, text string"
    old = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (1, "c", "z"), (1, "d", "w")], schema)
    new = spark.createDataFrame([(1, "a", "x"), (1, "e", "y"), (1, "c", "zz"), (1, "f", "v")], schema)
    got = {(r["op"], r["old_note"], r["new_note"]) for r in diff.footnote_diff(old, new, ["g"], "note", "text").collect()}
    assert got == {("same", "a", "a"), ("same", "b", "e"), ("modified", "c", "c"), ("removed", "d", None), ("added", None, "f")}


def test_optimal_beats_every_permutation(spark):
    rng = random.Random(4)
    for n in (2, 3, 5):
        score = [[round(rng.random(), 3) for _ in range(n)] for _ in range(n)]
        pairs = spark.createDataFrame([("b", i, j, score[i][j]) for i in range(n) for j in range(n)], "block string, left long, right long, score double")
        total = sum(r["score"] for r in matching.optimal(pairs, 0.0).collect())
        assert total == pytest.approx(max(sum(score[i][p[i]] for i in range(n)) for p in itertools.permutations(range(n))))
    assert matching._assign(2, np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1]), np.array([1.0, 2.0, 1.0, 3.0])).tolist() == [True, False, False, True]


def test_greedy_and_mutual_best(spark):
    pairs = spark.createDataFrame([("b", 1, 1, 0.9), ("b", 1, 2, 0.8), ("b", 2, 1, 0.85), ("b", 2, 2, 0.4)], "block string, left long, right long, score double")
    assert {(r.left, r.right) for r in matching.greedy(pairs, 0.35).collect()} == {(1, 1), (2, 2)}
    assert {(r.left, r.right) for r in matching.mutual_best(pairs, 0.35).collect()} == {(1, 1)}
    assert {(r.left, r.right) for r in matching.optimal(pairs, 0.35).collect()} == {(1, 2), (2, 1)}


def test_families_keep_their_cap(spark):
    edges = spark.createDataFrame([("s", i, i + 1, 0.9, True) for i in range(20)], "block string, a long, b long, score double, strong boolean")
    assert max(r["members"] for r in graph.families(edges, cap=4).collect()) <= 4


def test_components_match_union_find(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in graph.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: find(x) for x in nodes}
    assert graph.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_intervals_and_bounds(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 3, 4), (1, 5, 9), (1, 11, 12)], "g int, s int, e int")
    assert {(r.s, r.e, r.n_merged) for r in sequence.merged_intervals(df, ["g"], "s", "e").collect()} == {(0, 9, 3), (11, 12, 1)}
    ends = sequence.bounds_from_starts(df, ["g"], "s", F.lit(20)).orderBy("s").collect()
    assert [r["end"] for r in ends] == [2, 4, 10, 20]


def test_vote_needs_a_clear_winner(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 1), ("b", 2)], "g string, v int")
    got = {r["g"]: (r["winner"], r["accepted"]) for r in metrics.vote(df, ["g"], "v", 0.5, 2).collect()}
    assert got == {"a": (1, True), "b": (1, False)}


def test_matching_blocks_equal_the_library(monkeypatch):
    monkeypatch.setattr(similarity, "SMALL", 30)  # so that short lists take the way of long ones
    r = random.Random(1)
    for _ in range(400):
        k = r.choice([1, 2, 3, 8])
        a, b = ([r.randrange(k) for _ in range(r.randrange(60))] for _ in range(2))
        b = a[:30] + b + a[20:] if r.random() < 0.3 else b
        whole = difflib.SequenceMatcher(None, a, b, autojunk=False)
        assert similarity.matching_blocks(np.array(a, np.uint32), np.array(b, np.uint32)) == [tuple(m) for m in whole.get_matching_blocks() if m[2]]
        named = {"insert": "added", "delete": "removed", "replace": "modified"}
        assert list(similarity.changes_between(a, b)) == [(named[o[0]], *o[1:]) for o in whole.get_opcodes() if o[0] != "equal"]


def test_long_texts_are_compared(spark):
    """Two texts of 100,000 letters: minutes by pairs of equal letters, seconds by hashes of runs."""
    a, b = " ".join(f"mot{i * 7919 % 3001}" for i in range(14000)), " ".join(f"mot{i * 104729 % 2999}" for i in range(14000))
    rows = spark.createDataFrame([(a, a[:60000] + b[:30000])], "a string, b string")
    got = rows.select(similarity.sequence_ratio("a", "b").alias("r"), F.size(similarity.change_segments("a", "b")).alias("n")).first()
    assert 0.6 < got["r"] < 0.9 and got["n"] > 0
