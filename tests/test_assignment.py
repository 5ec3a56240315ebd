"""Assignments of highest total: paths, certain pairs and auctions against an exhaustive search, and the recovery loop."""

import random
from functools import cache

import numpy as np
from pyspark.sql import functions as F

from driftline.operators import matching


def highest(pairs):
    """The highest total of a set of (left, right, score) that share no row, by trying all."""
    rows, score = sorted({p[0] for p in pairs}), {(a, b): s for a, b, s in pairs}
    cols = sorted({p[1] for p in pairs})

    @cache
    def best(i, used):
        if i == len(rows):
            return 0.0
        free = [s + best(i + 1, used | 1 << j) for j, c in enumerate(cols) if not used >> j & 1 and (s := score.get((rows[i], c))) is not None]
        return max([best(i + 1, used), *free])

    return best(0, 0)


def _graph(r, n, share, scores):
    return [(a, 100 + b, r.choice(scores) if scores else round(r.random(), 4)) for a in range(n) for b in range(n) if r.random() < share]


def test_paths_find_the_highest_total():
    r = random.Random(3)
    for _ in range(300):
        pairs = _graph(r, r.randint(1, 6), r.choice([0.3, 0.6, 1]), r.choice([None, [0.25, 0.5, 0.75]]))
        if pairs:
            a, b, s = (np.array(c) for c in zip(*pairs))
            chosen = matching._assign(a.max() + 1, a, b - 100, s)
            assert len(set(a[chosen])) == chosen.sum() == len(set(b[chosen])) and abs(s[chosen].sum() - highest(pairs)) < 1e-9


def test_optimal_over_blocks(spark):
    r = random.Random(5)
    rows = [(block, a, b, s) for block in range(12) for a, b, s in _graph(r, r.randint(2, 6), 0.7, [0.5, 0.8, 0.9] if block % 2 else None)]
    found = matching.optimal(spark.createDataFrame(rows, "block int, left int, right int, score double"), 0.0).collect()
    for block in {x[0] for x in rows}:
        mine = [f for f in found if f["block"] == block]
        assert len({f["left"] for f in mine}) == len(mine) == len({f["right"] for f in mine})
        assert abs(sum(f["score"] for f in mine) - highest([x[1:] for x in rows if x[0] == block])) < 1e-6


def test_auction(spark):
    """Rounds of bids over several graphs at once, with ties that make rows outbid each other."""
    r = random.Random(7)
    rows = [(10 * g + a, 1000 * g + b, s) for g in range(4) for a, b, s in _graph(r, 4, 0.8, [0.5, 0.9] if g % 2 else [0.1, 0.3, 0.6, 0.9])]
    found = matching.auction(spark.createDataFrame(rows, "a int, b int, score double"), digits=1).collect()
    score = {(a, b): s for a, b, s in rows}
    assert len({f["a"] for f in found}) == len(found) == len({f["b"] for f in found})
    assert abs(sum(score[f["a"], f["b"]] for f in found) - sum(highest([x for x in rows if x[0] // 10 == g]) for g in range(4))) < 1e-9


def test_certain_pairs_are_in_a_best_assignment(spark):
    r = random.Random(6)
    rows = [(block, a, b, s) for block in range(30) for a, b, s in _graph(r, r.randint(1, 6), 0.5, r.choice([None, [0.25, 1.0]]))]
    won, rest = matching._decided(spark.createDataFrame(rows, "block int, left int, right int, score double"))
    won, rest = won.collect(), rest.collect()
    assert len(won) > 20
    for block in {x[0] for x in rows}:
        kept = sum(w["score"] for w in won if w["block"] == block) + highest([(x["left"], x["right"], x["score"]) for x in rest if x["block"] == block])
        assert abs(kept - highest([x[1:] for x in rows if x[0] == block])) < 1e-9


def test_one_large_component(spark):
    """A component of 100,000 pairs in one bounded task; its total is that of the same graph by numbers alone."""
    rng = np.random.default_rng(1)
    n = 10_000
    pair = np.unique(np.repeat(np.arange(n), 10) * n + rng.integers(0, n, 10 * n))
    score = 0.5 + rng.integers(0, 5000, len(pair)) / 10_000
    frame = spark.createDataFrame([("b", int(p // n), int(p % n), float(s)) for p, s in zip(pair, score)], "block string, left int, right int, score double")
    total = matching.optimal(frame, 0.35).agg(F.sum("score"), F.countDistinct("left"), F.count("*")).first()
    chosen = matching._assign(n, pair // n, pair % n, score)
    assert total[1] == total[2] and abs(total[0] - score[chosen].sum()) < 1e-6


def test_long_chains_of_preferences(spark):
    """Each row prefers the next one's partner: one pair a round, far more rounds than are made over all of Spark."""
    rows = [("b", i, i + d, 1000.0 - 2 * i - d) for i in range(300) for d in (0, 1)]
    r = random.Random(4)
    rows += [(f"x{g}", a, b, s) for g in range(8) for a, b, s in _graph(r, 6, 0.6, [0.2, 0.5, 0.9])]
    want = set()
    for block in {x[0] for x in rows}:
        left, right = set(), set()
        for _, a, b, s in sorted((x for x in rows if x[0] == block), key=lambda x: (-x[3], x[1], x[2])):
            if a not in left and b not in right:
                want.add((block, a, b, s))
                left.add(a)
                right.add(b)
    frame = spark.createDataFrame(rows, "block string, left int, right int, score double")
    for rounds in (0, 2):
        assert {tuple(x) for x in matching.one_to_one(frame, [F.col("score")], rounds=rounds).collect()} == want
