"""Operators whose steps work within a key shuffle their rows once."""

from driftline.operators import diff, partition


def _shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_footnotes_are_shuffled_once(spark):
    kind = "cust long, pair long, note int, text string"
    old = spark.createDataFrame([(1, 1, 1, "a"), (1, 1, 2, "b"), (1, 1, 3, "c"), (1, 1, 3, "c"), (1, 1, None, "n")], kind)
    new = spark.createDataFrame([(1, 1, 1, "a"), (1, 1, 5, "b"), (1, 1, 3, "d"), (1, 1, 7, "e"), (1, 1, None, "n")], kind)
    found = diff.footnote_diff(old, new, ["cust", "pair"], "note", "text")
    assert _shuffles(found) == 1
    got = sorted(map(str, (tuple(r)[2:] for r in found.collect())))
    want = [("same", 1, 1, "a", "a"), ("same", 2, 5, "b", "b"), ("same", None, None, "n", "n"), ("modified", 3, 3, "c", "d"), ("removed", 3, None, "c", None), ("added", None, 7, None, "e")]
    assert got == sorted(map(str, want))


def test_terms_are_shuffled_with_their_paragraph(spark):
    rows = partition.sentence_rows(spark.createDataFrame([(1, "Un mot ici. Un mot là. Rien.")], "id long, text string"), ["id"], "text")
    assert _shuffles(partition.lexical(rows, ["id"])) == 1
