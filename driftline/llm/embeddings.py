"""Near-duplicate vectors: spherical k-means cells, blocked cosine products inside them, one representative a group.

Only vectors of one label (and one length) are compared. Equal vectors are collapsed to one weighted vector
first. A vector is put into its nearest cells, so a pair just across a border still meets; a pair that meets in
several cells is counted in the first. Large cells are compared block by block.

How many cells a vector is put into is worked out from what is to be found: around vectors of the sample, others are
drawn at exactly the least cosine that links, which are the pairs that cells part most easily, and the number is the
least by which the asked share of these pairs meets. For a recall of 1 it is not measured but proved: a vector goes to
each cell whose border is no farther from it than a linked vector can be.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import block_pairs, connected, drop_written, written


def fit_cells(sample: np.ndarray, k: int, rounds: int = 10, seed: int = 11) -> np.ndarray:
    """Unit centroids of spherical k-means over unit rows; a cell that empties takes the worst-placed row."""
    pick = np.random.default_rng(seed).permutation(len(sample))[:k]
    centres = sample[pick]
    for _ in range(rounds):
        best, cell = np.zeros(len(sample)), np.zeros(len(sample), np.int64)
        for at in range(0, len(sample), 2048):
            near = sample[at : at + 2048] @ centres.T
            cell[at : at + 2048], best[at : at + 2048] = near.argmax(1), near.max(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, sample)
        norms = np.linalg.norm(sums, axis=1)
        lost = np.flatnonzero(norms < 1e-9)
        if len(lost):
            worst = np.argsort(best, kind="stable")[: len(lost)]
            sums[lost], norms[lost] = sample[worst], 1.0
        centres = sums / norms[:, None]
    return centres


def probes_for(sample: np.ndarray, centres: np.ndarray, threshold: float, recall: float, pairs: int = 2000, seed: int = 12) -> int:
    """Nearest cells by which at least ``recall`` of the pairs of cosine ``threshold`` meet, over drawn pairs."""
    rng = np.random.default_rng(seed)
    x = sample[rng.integers(0, len(sample), pairs)]
    u = rng.normal(size=x.shape)
    u -= (u * x).sum(1, keepdims=True) * x
    u /= np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-300)
    y = threshold * x + np.sqrt(1 - threshold * threshold) * u
    rank = lambda v: np.argsort(np.argsort(-(v @ centres.T), axis=1, kind="stable"), axis=1)
    meet = np.concatenate([np.maximum(rank(x[at : at + 256]), rank(y[at : at + 256])).min(1) for at in range(0, pairs, 256)]) + 1
    return int(np.sort(meet)[min(pairs - 1, int(np.ceil(recall * pairs)))])


def _unit(rows: pd.Series) -> np.ndarray:
    x = np.stack(rows.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # tiny or huge components neither vanish nor overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _assign(centres: np.ndarray, probes: int, threshold: float):
    """Cells of each vector: the nearest ``probes``, or with 0 all that a vector linked to it may be nearest to."""
    apart = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0)) if not probes else None
    reach = np.sqrt(1 - threshold * threshold)

    def run(batches):
        for pdf in (whole.iloc[at : at + 2048] for whole in batches for at in range(0, len(whole), 2048)):
            if not len(pdf):
                continue
            fits = (pdf["dim"] == centres.shape[1]).to_numpy()
            for part, nearest in ((pdf[fits], True), (pdf[~fits], False)):
                if not len(part):
                    continue
                if not nearest:
                    cells = np.zeros((len(part), 1), np.int64)
                else:
                    near = _unit(part["vector"]) @ centres.T
                    if probes:
                        cells = np.argsort(-near, axis=1, kind="stable")[:, : min(probes, near.shape[1])]
                    else:
                        own = near.argmax(1)
                        within = near.max(1)[:, None] - near <= reach * apart[own] + 1e-9
                        cells = [np.flatnonzero(w) for w in within]
                yield part.assign(cells=[sorted(map(int, c)) for c in cells])

    return run


def _local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index connected to each of n nodes by the edges a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("gid", kind="stable", ignore_index=True)
        cell = int(pdf["cell"].iloc[0])
        same = bool((pdf["block_a"] == pdf["block_b"]).iloc[0])
        left = np.flatnonzero((pdf["block"] == pdf["block_a"]).to_numpy())
        right = left if same else np.flatnonzero((pdf["block"] == pdf["block_b"]).to_numpy())
        unit = _unit(pdf["vector"])
        close = unit[left] @ unit[right].T >= threshold
        if same:
            close &= np.triu(np.ones_like(close), 1)
        a, b = np.nonzero(close)
        a, b = left[a], right[b]
        cells = pdf["cells"].to_numpy()
        # Compared in an earlier cell already: the two share a cell with a smaller number.
        first = np.fromiter((next(c for c in cells[x] if c in cells[y]) == cell for x, y in zip(a, b, strict=True)), bool, len(a)) if any(c[0] < cell for c in cells) else np.ones(len(a), bool)
        a, b = a[first], b[first]
        if not len(a):
            return pd.DataFrame({"gid": [], "links": [], "root": []}).astype(np.int64)
        weight = pdf["weight"].to_numpy(np.int64)
        links = np.zeros(len(pdf), np.int64)
        np.add.at(links, a, weight[b])
        np.add.at(links, b, weight[a])
        gid = pdf["gid"].to_numpy()
        out = pd.DataFrame({"gid": gid, "links": links, "root": gid[_local_roots(len(pdf), a, b)]})
        return out[links > 0]

    return run


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93, recall: float = 0.995, probes: int | None = None, cell_rows: int = 2048, max_cells: int = 4096, sample_rows: int = 65_536, block_rows: int = 256) -> DataFrame:
    """One row per row of ``df``: key, ``n_links``, ``component_id`` (smallest key reachable) and ``kept``.

    Vectors are linked if their labels are equal and their cosine is at least ``threshold``. A vector that is
    null, empty, zero or holds null or non-finite components, has a null label or a null key, links with
    nothing: its component is itself and it is kept. Rows that repeat a key count as vectors of their own; other
    columns are ignored; an empty table gives an empty result. The centroids are fitted on at most
    ``sample_rows`` distinct vectors, the only sampled step; every vector is assigned and compared. ``recall`` is the
    share of the pairs at the threshold that are to be met, 1 for all of them; ``probes`` sets the number of nearest
    cells outright. Cells hold about ``cell_rows`` vectors up to ``max_cells`` times as many (8 million), beyond which
    they grow with the table and are compared by more pairs of blocks.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"), F.col(label).alias("label"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists("vector", lambda x: x != 0)
    usable = F.col("key").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.coalesce(bad, F.lit(True))
    rows = rows.withColumn("gid", F.when(usable, F.xxhash64("label", "vector")))
    distinct = rows.where("gid is not null").groupBy("label", "vector").agg(F.first("gid").alias("gid"), F.min("key").alias("least"), F.count("*").alias("weight"))
    distinct = written(distinct.withColumn("dim", F.size("vector")), "vectors")
    dims = distinct.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    dim, n = (dims[0]["dim"], dims[0]["n"]) if dims else (1, 0)
    k = int(min(max_cells, max(1, -(-n // cell_rows))))
    take = min(sample_rows, max(4096, 16 * k))  # vectors to a centroid, not a share of the table
    sample = distinct.where(F.col("dim") == dim).orderBy("gid").limit(take).select("vector").toPandas()
    centres = fit_cells(_unit(sample["vector"]), k) if len(sample) else np.ones((1, dim))
    if probes is None:
        probes = 0 if recall >= 1 else min(k, probes_for(_unit(sample["vector"]), centres, threshold, recall)) if len(sample) else 1
    schema = f"label {df.schema[label].dataType.simpleString()}, vector array<double>, gid long, weight long, dim int"
    assigned = distinct.select("label", "vector", "gid", "weight", "dim").mapInPandas(_assign(centres, probes, threshold), f"{schema}, cells array<int>")
    members = assigned.withColumn("cell", F.explode("cells"))
    paired = block_pairs(members, ["label", "dim", "cell"], "gid", block_rows)
    found = paired.groupBy("label", "dim", "cell", "block_a", "block_b").applyInPandas(_compare(threshold), "gid long, links long, root long")
    found = written(found, "links")
    links = found.groupBy("gid").agg(F.sum("links").alias("links"))
    roots = connected(found.select(F.col("gid").alias("a"), F.col("root").alias("b")))
    named = roots.join(distinct.select(F.col("gid").alias("node"), "least"), "node")
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    grouped = roots.join(least, "root").select(F.col("node").alias("gid"), "component")
    facts = distinct.select("gid", "least", "weight").join(links, "gid", "left").join(grouped, "gid", "left")
    facts = written(facts.select("gid", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "least").alias("component")), "facts")
    drop_written(found)
    out = rows.select("key", "gid").join(facts, "gid", "left")
    component = F.coalesce("component", "key")
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(True)).alias("kept"))


def sql(table: str = "embeddings", threshold: float = 0.93) -> str:
    """The same result in DuckDB's SQL by comparing all pairs, for tables of moderate size with one row a key."""
    return f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM {table} WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
    p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= {threshold}),
    c AS (SELECT vec_id AS node, vec_id AS root FROM {table} UNION SELECT p.b, c.root FROM c JOIN p ON p.a = c.node),
    r AS (SELECT node, min(root) AS root FROM c GROUP BY 1), n AS (SELECT a, count(*) AS n FROM p GROUP BY 1)
    SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, r.root AS component_id, vec_id = r.root AS kept FROM {table} JOIN r ON node = vec_id LEFT JOIN n ON a = vec_id"""
