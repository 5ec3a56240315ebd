"""Whether one text holds another is settled inside the tiles: no text is written or joined for a pair."""

import random

from pyspark.sql import functions as F

from driftline.operators import matching, reconcile


def test_held_keys_are_settled_in_the_tiles(spark):
    r = random.Random(8)
    rows = []
    for i in range(90):
        words = rows[-1][3][:-1] if i % 4 == 1 else r.sample(range(40), r.randint(3, 12))
        rows.append(("b", "previous" if i % 2 else "current", i, words, "".join(f"w{w}." for w in words) if i % 13 else ""))
    data = spark.createDataFrame(rows, "block string, side string, chunk long, words array<long>, key string")
    found = {(x["left"], x["right"]): round(x["score"], 9) for x in matching.overlap_pairs(data, 0.3, tile=16).collect()}
    want = {}
    for _, s, i, x, k in rows:
        for _, t, j, y, m in rows:
            if (s, t) == ("previous", "current") and x and y:
                score = 1.0 if k and m and (k in m or m in k) else len({*x} & {*y}) / len({*x, *y})
                if score >= 0.3:
                    want[i, j] = round(score, 9)
    assert found == want and 1.0 in found.values()


def test_edges_join_no_texts(spark):
    text = " ".join(f"word{i}" for i in range(30))
    nodes = spark.createDataFrame([("s", 0, "t1", text), ("s", 1, "t2", text + " behind")], "section string, node long, side string, text string")
    found = reconcile.edges(nodes).select(F.col("a"), F.col("b"), "score")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "contains" not in plan.lower() and "SortMergeJoin" not in plan
    assert [tuple(x) for x in found.collect()] == [(0, 1, 1.0)]
