"""Rename candidates against all pairs, for sets of every size, and how few pairs are looked at."""

import random

from driftline.operators import diff


def _changes(seed, n, sizes, vocabulary):
    r = random.Random(seed)
    found = []
    for i in range(n):
        x = r.sample(range(vocabulary), r.choice(sizes))
        found += [(1, "removed", " ".join(f"w{k}" for k in x))]
        y = [k for k in x if r.random() > 0.1] + r.sample(range(vocabulary), r.randint(0, 2))
        found += [(1, "added", " ".join(f"w{k}" for k in y) or "none")]
    return sorted(set(found))


def test_candidates_are_those_of_all_pairs(spark):
    for seed, threshold in ((1, 0.8), (2, 0.5)):
        data = _changes(seed, 150, [1, 2, 3, 4, 5, 6, 8, 10, 13, 20, 24, 25, 30], 60)
        got = {(x["removed"], x["added"]): x["score"] for x in diff.rename_candidates(spark.createDataFrame(data, "g long, op string, label string"), ["g"], "label", threshold).collect()}
        want = {}
        for _, o, x in data:
            for _, p, y in data:
                a, b = set(x.split()), set(y.split())
                if (o, p) == ("removed", "added") and len(a & b) / len(a | b) >= threshold:
                    want[x, y] = len(a & b) / len(a | b)
        assert got == want and len(want) > 50


def test_labels_that_share_one_word_do_not_meet(spark):
    data = [(1, op, f"common a{k % 7} b{k % 11} c{k % 13} " + " ".join(f"{op[0]}{k}x{j}" for j in range(6))) for k in range(300) for op in ("removed", "added")]
    rows = spark.createDataFrame(data, "g long, op string, label string")
    assert diff._met_labels(rows, ["g"], "label", 0.8).count() == 0
