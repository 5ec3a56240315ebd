"""First pairs of tiles: a task returns one a row, and they say what all pairs would."""

import random

from pyspark.sql import functions as F

from driftline.operators import matching


def test_first_pairs_of_tiles_are_those_of_all_pairs(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    rows = [("b", i, "previous" if i % 2 else "current", r.choices(words, k=r.randint(2, 12))) for i in range(240)]
    rows += [("b", 1000 + i, "previous" if i % 2 else "current", words[:5]) for i in range(60)]
    chunks = spark.createDataFrame(rows, "block string, chunk long, side string, tokens array<string>")
    args = (chunks, "block", "chunk", "side", "tokens")
    every = matching.tfidf_pairs(*args, 0.0, tile=64, best=0)
    first = matching.tfidf_pairs(*args, 0.35, tile=64, digits=4)
    # Copies meet each other in thousands of pairs; a task returns one a row.
    assert first.count() < 0.1 * every.count()
    taken = lambda df: {tuple(x) for x in matching.mutual_best(df, 0.35).select("block", "left", "right", "score").collect()}
    assert taken(first.distinct()) == taken(every.withColumn("score", F.round("score", 4)))
