"""Exact top-k by integer inner product: a Voronoi kNN join.

The largest inner products of a query are its nearest neighbours once every vector x gets one more component,
``sqrt(M^2 - |x|^2)`` with M the longest length, and the query gets 0 there: the squared distance is then
``|q|^2 + M^2 - 2 q.x``. In that space rows are put into the cells of pivots, and small summaries of the cells (farthest
query, nearest k + 1 rows) bound how far the k-th neighbour of any query of a cell can be. A row is sent to a group of
query cells only if it lies within that bound of one of them; each group is solved by itself, in bounded blocks of
queries and slices of rows, by exact integer products. The bounds are computed in doubles and widened by far more than
their rounding, so they only ever send too much.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.common import drop_written, written
from driftline.llm.embeddings import fit_cells

#: Widening of distances that are computed in doubles, in parts of the longest vector.
SLACK = 1e-6


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(squares, 0))


class _Cells:
    """Pivots of the vectors of one length, in parts of the longest vector; other lengths are a single cell each."""

    def __init__(self, dim: int, largest: float, longest: float, pivots: np.ndarray):
        self.dim, self.largest, self.longest, self.pivots = dim, largest, longest, pivots

    def lifted(self, x: np.ndarray, query: np.ndarray) -> np.ndarray:
        x = x / self.largest / self.longest
        rest = np.sqrt(np.maximum(1 - (x * x).sum(1), 0))
        return np.column_stack([x, np.where(query, 0.0, rest)])

    def to_pivots(self, x: np.ndarray, query: np.ndarray) -> np.ndarray:
        return _distances(self.lifted(x, query), self.pivots)


def _parts(batches, size: int = 2048):
    """Runs of rows of one length, as ``(dim, rows, vectors)``."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            dims = part.column("dim").to_numpy()
            for dim in np.unique(dims):
                rows = part.take(pa.array(np.flatnonzero(dims == dim)))
                yield int(dim), rows, _matrix(rows.column("vector"), int(dim))


def _summary(cells: _Cells):
    """Each row's cell and its distance from the pivot."""

    def run(batches):
        for dim, rows, x in _parts(batches):
            query = rows.column("is_query").to_numpy(zero_copy_only=False)
            if dim != cells.dim:
                continue
            for kind, of in ((False, np.zeros(len(x), bool)), (True, np.ones(len(x), bool))):
                pick = np.flatnonzero(query) if kind else np.arange(len(x))
                if not len(pick):
                    continue
                d = cells.to_pivots(x[pick], of[pick])
                cell = d.argmin(1)
                yield pa.RecordBatch.from_pydict({"cell": cell.astype(np.int32), "is_query": np.full(len(pick), kind), "distance": d[np.arange(len(pick)), cell]})

    return run


class _Plan:
    """Which rows meet which queries: the reach of every query cell, the group of every cell, blocks of every group."""

    def __init__(self, cells: _Cells, reach: np.ndarray, group: np.ndarray):
        self.cells, self.reach, self.group = cells, reach, group
        self.blocks: dict[tuple[int, int], tuple[int, int]] = {}

    def needed(self, dim: int, x: np.ndarray):
        """Groups with the rows that they need; vectors of another length than the usual one form one group."""
        if dim != self.cells.dim:
            yield 0, np.arange(len(x))
            return
        near = self.cells.to_pivots(x, np.zeros(len(x), bool)) <= self.reach[None, :]
        for g in np.unique(self.group[self.group >= 0]):
            yield int(g), np.flatnonzero(near[:, self.group == g].any(1))

    def own(self, dim: int, x: np.ndarray) -> np.ndarray:
        return self.group[self.cells.to_pivots(x, np.ones(len(x), bool)).argmin(1)] if dim == self.cells.dim else np.zeros(len(x), int)


def _counted(plan: _Plan):
    def run(batches):
        for dim, rows, x in _parts(batches):
            query = np.flatnonzero(rows.column("is_query").to_numpy(zero_copy_only=False))
            found = [(g, len(pick), 0) for g, pick in plan.needed(dim, x)] + [(int(g), 0, int(n)) for g, n in zip(*np.unique(plan.own(dim, x[query]), return_counts=True))]
            columns = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array([dim] * len(found), pa.int32()), *(pa.array(c, pa.int64()) for c in columns)], ["dim", "grp", "n_rows", "n_queries"])

    return run


def _dealt(plan: _Plan):
    """Copies of rows for each block of queries of the groups that need them, and of queries for each slice of rows."""

    def copies(rows, dim, g, pick, block, part, asked):
        arrays = [pa.array(np.full(len(pick), dim, np.int32)), pa.array(np.full(len(pick), g, np.int64)), pa.array(block.astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(np.full(len(pick), asked))]
        taken = rows.select(["uid", "key", "vector"]).take(pa.array(pick))
        return pa.RecordBatch.from_arrays(arrays + taken.columns, ["dim", "grp", "block", "slice", "asked", "uid", "key", "vector"])

    def run(batches):
        for dim, rows, x in _parts(batches):
            mixed = rows.column("uid").to_numpy() * np.int64(0x5851F42D4C957F2D) >> np.int64(33)
            for g, pick in plan.needed(dim, x):
                blocks, parts = plan.blocks.get((dim, g), (0, 0))
                for block in range(blocks if len(pick) else 0):
                    yield copies(rows, dim, g, pick, np.full(len(pick), block), mixed[pick] % parts, False)
            query = np.flatnonzero(rows.column("is_query").to_numpy(zero_copy_only=False))
            own = plan.own(dim, x[query])
            for g in np.unique(own):
                pick = query[own == g]
                blocks, parts = plan.blocks[dim, int(g)]
                for part in range(parts):
                    yield copies(rows, dim, int(g), pick, mixed[pick] % blocks, np.full(len(pick), part), True)

    return run


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integers held as doubles, exact; what 64 bits can't hold is set to their bounds."""
    dim = a.shape[1]
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(dim, 1)
    if most < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in row] for row in m], object).reshape(m.shape)
    return np.clip(whole(a) @ whole(b).T, -(2**63), 2**63 - 1).astype(np.int64)


def _solved(k: int):
    def run(table: pa.Table) -> pa.Table:
        asked = table.column("asked").to_numpy(zero_copy_only=False)
        dim = table.column("dim")[0].as_py()
        key = table.column("key").combine_chunks()
        void = key.is_null().to_numpy(zero_copy_only=False)
        number, uid = key.fill_null(0).to_numpy(zero_copy_only=False), table.column("uid").to_numpy()
        order = np.lexsort((uid, number, void))
        left, right = order[asked[order]], order[~asked[order]]
        names = ["quid", "query_id", "uid", "vec_id", "score"]
        schema = pa.schema([(n, pa.int64()) for n in names])
        if not len(left) or not len(right):
            return schema.empty_table()
        x = _matrix(table.column("vector"), dim)
        found = []
        for at in range(0, len(left), 256):
            some = left[at : at + 256]
            score = products(x[some], x[right])
            own = uid[some][:, None] == uid[right][None, :]
            keep = ~own
            if len(right) > k + 1:  # the own row may be one of the k + 1 best
                cut = np.partition(score, len(right) - k - 1, axis=1)[:, len(right) - k - 1]
                keep &= score >= cut[:, None]
            i, j = np.nonzero(keep)
            rank = np.lexsort((j, -score[i, j].astype(object) if score.min() == -(2**63) else -score[i, j], i))
            i, j = i[rank], j[rank]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            i, j = i[place < k], j[place < k]
            found.append((some[i], right[j], score[i, j]))
        a, b, s = (np.concatenate(c) for c in zip(*found))
        return pa.table([pa.array(uid[a]), key.take(pa.array(a)), pa.array(uid[b]), key.take(pa.array(b)), pa.array(s)], schema=schema)

    return run


def top_k(df: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 5, scale: float = 256.0, cell_rows: int = 2048, max_pivots: int = 1024, sample_rows: int = 16_384, block_queries: int = 1024, slice_rows: int = 8192) -> DataFrame:
    """The ``k`` best rows for every row for which ``queries`` holds: ``query_id``, ``rank`` from 1, ``vec_id``, ``score``.

    A vector counts as ``floor(scale * x)``, the score is the inner product, ties go to the smaller key (a null key last).
    Vectors that are null or hold null or non-finite components take no part; only vectors of one length are compared
    (empty ones among themselves, with score 0). A query's own row is left out, other rows that repeat its key or vector
    are not; a repeated query row is a query of its own. A row with a null key can be found. Fewer rows than ``k`` give
    as many as there are; an empty table gives none; other columns are ignored. Scores are exact also for huge
    components; one that 64 bits can't hold is set to their bound.

    The pivots alone come from a sample (``sample_rows`` vectors at most, one pivot for ``cell_rows`` rows, ``max_pivots``
    at most); they decide how much is compared, not what is found.
    """
    rows = df.select(F.col(key).cast("long").alias("key"), F.coalesce(queries, F.lit(False)).alias("is_query"), F.col(vector).cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vector").isNotNull()).where(~F.coalesce(bad, F.lit(True)))
    rows = rows.withColumn("vector", F.transform("vector", lambda x: F.when(F.abs(x) < 2.0**50, F.floor(x * scale).cast("double")).otherwise(F.greatest(F.least(x * scale, F.lit(1.7e308)), F.lit(-1.7e308)))))
    largest = F.coalesce(F.array_max(F.transform("vector", lambda x: F.abs(x))), F.lit(0.0))
    rows = written(rows.select(F.monotonically_increasing_id().alias("uid"), "key", "is_query", F.size("vector").alias("dim"), "vector", largest.alias("largest")), "vectors")
    usual = rows.groupBy("dim").agg(F.count("*").alias("n"), F.max("largest").alias("largest")).orderBy(F.desc("n"), "dim").limit(1).collect()
    dim, n, most = (usual[0]["dim"], usual[0]["n"], usual[0]["largest"]) if usual else (0, 0, 0.0)
    most = most or 1.0
    part = rows.where(F.col("dim") == dim)
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + (x / most) * (x / most))
    longest = (part.agg(F.max(F.sqrt(squares)).alias("m")).collect()[0]["m"] if n else None) or 1.0
    longest *= 1 + 1e-12
    p = int(min(max_pivots, max(1, -(-n // cell_rows))))
    sample = part.orderBy(F.xxhash64("uid")).limit(int(min(sample_rows, 64 * p))).select("vector").toArrow().column("vector") if p > 1 else None
    cells = _Cells(dim, most, longest, np.zeros((1, dim + 1)))
    if sample is not None and len(sample) > p:
        lifted = cells.lifted(_matrix(sample, dim), np.zeros(len(sample), bool))
        cells.pivots = fit_cells(lifted, p)
    plan = _planned(part, cells, k, block_queries)
    fields = "uid", "key", "is_query", "dim", "vector"
    counts = rows.select(*fields).mapInArrow(_counted(plan), "dim int, grp long, n_rows long, n_queries long").groupBy("dim", "grp").agg(F.sum("n_rows").alias("r"), F.sum("n_queries").alias("q")).where("q > 0").collect()
    plan.blocks = {(c["dim"], c["grp"]): (-(-c["q"] // block_queries), max(1, -(-c["r"] // slice_rows))) for c in counts}
    dealt = rows.select(*fields).mapInArrow(_dealt(plan), "dim int, grp long, block int, slice int, asked boolean, uid long, key long, vector array<double>")
    solved = dealt.groupBy("dim", "grp", "block", "slice").applyInArrow(_solved(k), "quid long, query_id long, uid long, vec_id long, score long")
    best = Window.partitionBy("quid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "uid")
    return solved.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _planned(part: DataFrame, cells: _Cells, k: int, block_queries: int) -> _Plan:
    """Reach and group of every query cell, from summaries of the cells: at most ``k + 2`` numbers a pivot."""
    p = len(cells.pivots)
    placed = written(part.select("uid", "key", "is_query", "dim", "vector").mapInArrow(_summary(cells), "cell int, is_query boolean, distance double"), "placed")
    nearest = Window.partitionBy("cell").orderBy("distance")
    known = placed.where("not is_query").withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= k + 1).select("cell", "distance").collect()
    asked = placed.where("is_query").groupBy("cell").agg(F.max("distance").alias("far"), F.count("*").alias("n")).collect()
    drop_written(placed)
    apart = _distances(cells.pivots, cells.pivots)
    to, away = np.array([r["cell"] for r in known], int), np.array([r["distance"] for r in known])
    reach, group, weight = np.full(p, -1.0), np.full(p, -1), np.zeros(p, np.int64)
    for r in asked:
        i, bound = r["cell"], np.inf
        if len(known) > k:
            # No query of the cell is farther from these rows than by way of the two pivots; one of them may be itself.
            bound = np.partition(apart[i, to] + away, k)[k] + r["far"]
        reach[i], weight[i] = (bound + r["far"]) * (1 + SLACK) + SLACK, r["n"]
    used = np.flatnonzero(weight)
    if len(used):
        groups = int(min(len(used), max(1, -(-weight.sum() // block_queries))))
        centres = fit_cells(cells.pivots[used] / np.maximum(np.linalg.norm(cells.pivots[used], axis=1, keepdims=True), 1e-300), groups) if groups > 1 else None
        group[used] = 0 if centres is None else (cells.pivots[used] @ centres.T).argmax(1)
    return _Plan(cells, reach, group)


def sql(table: str = "embeddings", k: int = 5) -> str:
    """The same in DuckDB's SQL by comparing every query with every row, for tables with one row a key and one length."""
    return f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM {table} WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
    s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.x, v.x)::BIGINT AS score FROM v q JOIN v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id AND len(q.x) = len(v.x)),
    r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""
