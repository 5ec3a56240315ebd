"""Tables as large as the labels are never sent through the driver, and blocks settled whole give the pairs of the rounds."""

import random

from driftline.operators import diff, matching
from driftline.sources.scratch import written
from pyspark.sql import functions as F


def test_renames_are_shuffled_however_small_they_look(spark):
    changes = spark.createDataFrame([(1, "a b", "removed"), (1, "a c", "added"), (1, "d", "added")], "g long, label string, op string")
    renamed = spark.createDataFrame([(1, "a b", "a c", 0.8)], "g long, removed string, added string, score double")
    found = diff.without_renamed(changes, renamed, ["g"], "label")
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(x["label"], x["op"]) for x in found.collect()} == {("a c", "renamed"), ("d", "added")}


def test_candidates_of_a_written_table_are_shuffled(spark):
    changes = written(spark.createDataFrame([(1, "a b c d e", "removed"), (1, "a b c d f", "added")], "g long, label string, op string"), "changes")
    found = diff.rename_candidates(changes, ["g"], "label", 0.6)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 1


def test_small_blocks_are_settled_at_once(spark, monkeypatch):
    r = random.Random(4)
    rows = [(f"b{k}", i, j, r.randint(1, 5) / 5) for k in range(3) for i in range(8) for j in range(8) if r.random() < 0.6]
    pairs = spark.createDataFrame(rows, "block string, left long, right long, score double")
    want = {tuple(x) for x in matching.one_to_one(pairs, [F.col("score")], block_pairs=0).collect()}
    names = []
    written = matching.written
    monkeypatch.setattr(matching, "written", lambda df, name, *more: names.append(name) or written(df, name, *more))
    assert {tuple(x) for x in matching.one_to_one(pairs, [F.col("score")]).collect()} == want and len(want) > 10
    assert names.count("won") == 1  # no round was needed
