"""Families in rounds: the same as from one sorted list, with no component in one task."""

import random

import pytest

from driftline.operators import graph


def _by_list(edges, cap):
    family = {}
    for block, a, b, score, strong in sorted(edges, key=lambda e: (-e[3], e[1], e[2])):
        x, y = family.setdefault((block, a), {(block, a)}), family.setdefault((block, b), {(block, b)})
        if x is y or len(x) + len(y) > cap or (not strong and len(x) > 1 and len(y) > 1):
            continue
        x |= y
        for node in y:
            family[node] = x
    return {(block, node, min(own)[1], len(own)) for (block, node), own in family.items()}


@pytest.mark.parametrize("rounds, task_edges", [(6, 2_000_000), (1, 2_000_000), (2, 0)])
def test_families_of_one_large_component(spark, rounds, task_edges):
    r = random.Random(5)
    edges = {(b, i, j): r.randint(24, 100) / 100 for b in "xy" for i in range(40) for j in range(40, 80) if r.random() < 0.3}
    rows = [(*k, s, s >= 0.8) for k, s in edges.items()]
    df = spark.createDataFrame(rows, "block string, a long, b long, score double, strong boolean")
    found = {(f["block"], f["node"], f["family"], f["members"]) for f in graph.families(df, 10, rounds, task_edges).collect()}
    assert found == _by_list(rows, 10)
