"""Pairs of tiles: nothing is copied for each of the other tiles, and the pairs are those of all against all."""

import random

from pyspark.sql import functions as F

from driftline.operators import matching, reconcile


def _rows(spark, n):
    r = random.Random(3)
    words = lambda: r.sample(range(60), r.randint(4, 20))
    return [("b" if i % 9 else "c", "previous" if i % 2 else "current", i, words()) for i in range(n)]


def test_tiles_are_one_row_each_and_meet_by_a_product(spark):
    rows = spark.createDataFrame(_rows(spark, 400), "block string, side string, chunk long, words array<long>")
    tiles = matching._tiles(rows, matching._by_word, F.lit(0), 40)
    assert tiles.where("side = 'previous'").select(F.sum(F.size("chunks"))).first()[0] == 200
    met = matching._met_tiles(tiles)
    assert "CartesianProduct" in met._jdf.queryExecution().toString()
    n = {(r["block"], r["side"]): r["count"] for r in tiles.groupBy("block", "side").count().collect()}
    assert met.count() == sum(n[b, "previous"] * n[b, "current"] for b in "bc")


def test_overlaps_of_many_tiles(spark):
    data = _rows(spark, 300)
    rows = spark.createDataFrame(data, "block string, side string, chunk long, words array<long>")
    found = {(r["left"], r["right"]): (r["score"], r["held"]) for r in matching.overlap_pairs(rows, 0.2, tile=32).collect()}
    want = {}
    for b, s, i, x in data:
        for c, t, j, y in data:
            if b == c and (s, t) == ("previous", "current"):
                both, least = len({*x} & {*y}), min(len(x), len(y))
                held = both > 0 and both >= max(least / 2, least - 2)
                if held or both / len({*x, *y}) >= 0.2:
                    want[i, j] = both / len({*x, *y}), held
    assert found == want


def test_texts_that_hold_each_other(spark):
    base = " ".join(f"word{i}" for i in range(30))
    texts = [(0, "removed", base), (1, "added", base + " more words behind it"), (2, "added", base), (3, "added", base.replace("word7", "other")), (4, "added", " ".join(f"else{i}" for i in range(30)))]
    changes = spark.createDataFrame([("s", i, k, t if k == "removed" else None, t if k == "added" else None) for i, k, t in texts], "section string, node long, diff_type string, source_text_t1 string, source_text_t2 string")
    found = {r["b"]: r["score"] for r in reconcile.edges(reconcile.one_sided(changes)).collect()}
    assert found == {1: 1.0, 2: 1.0, 3: round(29 / 31, 4)}
