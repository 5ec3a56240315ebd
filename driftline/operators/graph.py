"""Graph operators over edge tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.sources.scratch import drop_written, written


def connected(edges: DataFrame, name: str = "components", max_rounds: int = 40) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, root)``, root being the smallest node reached.

    Contraction: every node points at its smallest neighbour, pointers are followed twice, and the edges are
    renamed by the pointers, until none is left. Minima are pre-aggregated map-side, and every join stands
    directly on two shuffles, so that a hub with millions of neighbours is split by adaptive execution. Each
    step is a table in the shared folder. Isolated nodes do not appear in the result.
    """
    cur = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    roots = None
    for _ in range(max_rounds):
        if roots is not None and cur.isEmpty():
            return roots
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).select("node", F.least("node", "to").alias("to")), name)
        for _ in range(2):
            after = up.select(F.col("node").alias("to"), F.col("to").alias("next"))
            jumped = written(up.join(after, "to").select("node", F.col("next").alias("to")), name)
            drop_written(up)
            up = jumped
        if roots is None:
            roots = up.withColumnRenamed("to", "root")
            roots._driftline_path = None
        else:
            step = up.select(F.col("node").alias("root"), "to")
            renamed = written(roots.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root")), name)
            drop_written(roots)
            roots = renamed
        left, right = up.select(F.col("node").alias("a"), F.col("to").alias("x")), up.select(F.col("node").alias("b"), F.col("to").alias("y"))
        nxt = cur.join(left, "a").join(right, "b").where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
        nxt = written(nxt, name)
        drop_written(cur)
        cur = nxt
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _merge_families(cap: int):
    def run(edges: pd.DataFrame) -> pd.DataFrame:
        """Best edge first; a weak edge never joins two formed families, and no family outgrows the cap."""
        family: dict = {}
        for e in edges.sort_values(["score", "a", "b"], ascending=[False, True, True]).itertuples():
            left, right = family.setdefault(e.u, [{e.u}, e.nu]), family.setdefault(e.v, [{e.v}, e.nv])
            if left is right or left[1] + right[1] > cap or (not e.strong and left[1] > 1 and right[1] > 1):
                continue
            left[0] |= right[0]
            left[1] += right[1]
            for node in right[0]:
                family[node] = left
        rows = [(old, min(own), n) for old, (own, n) in family.items()]
        return pd.DataFrame(rows, columns=["old", "new", "n"]).assign(block=edges["block"].iloc[0])

    return run


def _open(edges: DataFrame, cap: int) -> DataFrame:
    """Edges that may still join two families. These only grow, so a refusal is for good."""
    return edges.where((F.col("u") != F.col("v")) & (F.col("nu") + F.col("nv") <= cap) & (F.col("strong") | (F.col("nu") == 1) | (F.col("nv") == 1)))


def _first_of_both(edges: DataFrame) -> DataFrame:
    """Families ``(block, old, new, n)`` joined by edges that are the first in order of both their families."""
    key = F.struct((-F.col("score")).alias("s"), "a", "b", "u", "v", "nu", "nv").alias("key")
    both = edges.select("block", F.col("u").alias("old"), key).unionByName(edges.select("block", F.col("v").alias("old"), key))
    won = both.groupBy("block", "old").agg(F.min("key").alias("key")).groupBy("block", "key").agg(F.count("*").alias("k")).where("k = 2")
    new = won.select("block", F.explode(F.array("key.u", "key.v")).alias("old"), F.least("key.u", "key.v").alias("new"), (F.col("key.nu") + F.col("key.nv")).alias("n"))
    return new


def families(edges: DataFrame, cap: int = 10, rounds: int = 6, task_edges: int = 2_000_000) -> DataFrame:
    """Constrained merging of ``edges(block, a, b, score, strong)``: ``(block, node, family, members)``.

    Best edge first, ties by the ids. An edge that comes first among those of both its families finds them as the sorted
    list would, so all such edges are taken at once, in rounds over all blocks. What is left after ``rounds`` rounds is
    parted by connected component: those of at most ``task_edges`` edges are merged each in a task, larger ones go on.
    """
    one = F.lit(1).cast("long")
    rows = edges.where("a <> b").select("block", "a", "b", "score", "strong", F.col("a").alias("u"), F.col("b").alias("v"), one.alias("nu"), one.alias("nv"))
    left = written(rows, "edges")
    nodes = left.select("block", F.col("a").alias("node")).unionByName(left.select("block", F.col("b").alias("node"))).distinct()
    home = written(nodes.select("block", "node", F.col("node").alias("family"), one.alias("members")), "families")
    kind = edges.schema["a"].dataType.simpleString()
    schema = f"old {kind}, new {kind}, n long, block {edges.schema['block'].dataType.simpleString()}"
    done = 0
    while not left.isEmpty():
        done += 1
        if done == rounds + 1:
            name = lambda c: F.xxhash64("block", c)
            named = written(left.withColumns({"_a": name("u"), "_b": name("v")}), "edges")
            roots = connected(named.select(F.col("_a").alias("a"), F.col("_b").alias("b"))).select(F.col("node").alias("_a"), "root")
            placed = written(named.join(roots, "_a").drop("_a", "_b"), "placed")
            sizes = placed.groupBy("root").agg(F.count("*").alias("k"))
            small = placed.join(sizes.where(F.col("k") <= task_edges), "root", "left_semi")
            moved = written(small.groupBy("root").applyInPandas(_merge_families(cap), schema), "moved")
            rest = placed.join(sizes.where(F.col("k") > task_edges), "root", "left_semi").select(left.columns)
        else:
            moved = written(_first_of_both(left), "moved")
            of = lambda x: moved.select("block", F.col("old").alias(x), F.col("new").alias(f"_{x}"), F.col("n").alias(f"_n{x}"))
            after = left.join(of("u"), ["block", "u"], "left").join(of("v"), ["block", "v"], "left")
            now = lambda x: F.coalesce(f"_{x}", x).alias(x)
            rest = _open(after.select("block", "a", "b", "score", "strong", now("u"), now("v"), now("nu"), now("nv")), cap)
        rest = written(rest, "edges")
        drop_written(left)
        left = rest
        into = moved.select("block", F.col("old").alias("family"), "new", "n")
        settled = home.join(into, ["block", "family"], "left").select("block", "node", F.coalesce("new", "family").alias("family"), F.coalesce("n", "members").alias("members"))
        settled = written(settled, "families")
        drop_written(home)
        home = settled
    return home.select("node", "family", "members", "block")
