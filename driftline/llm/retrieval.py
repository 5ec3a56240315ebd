"""Ranked lexical search over a two-level quantised index.

The index holds, block of documents by block, the postings of every term: at the first level one byte a posting, its
impact rounded up, and at the second its exact number of occurrences; the documents of a block are kept with their lengths.
A byte bounds what a posting adds from above and, less one step, from below. A search reads the first level alone: the
k-th largest lower bound of an item over all blocks is a score that its k-th best document reaches, so only documents
whose upper bound reaches it can be among the k best, ties included. Blocks that hold such a document are read again at
the second level, and just those documents are scored exactly.

Blocks are cut where the texts are read, so building the index moves nothing between tasks; a frequent term has postings
in every block and is nowhere together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.common import drop_written, row_id, slices, written

#: Fixed values of the score.
UNIT, TF, LENGTH, B = 1_000_000_000, 1000, 8, 75
#: What a document adds for a term of weight one is below 10^6; a byte counts it in steps of this.
STEP = -(-(UNIT // TF) // 255)
#: The most bytes of terms that are broadcast; more of them are joined by a shuffle.
BROADCAST_BYTES = 8 << 20
#: ASCII letters folded, all ASCII signs but digits and letters to blanks; bytes of other characters stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


@dataclass
class Index:
    """``table`` has a row for each block and term, and one with a null term for the block's documents."""

    table: DataFrame
    n_docs: int
    n_terms: int


def _offset(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a document's length makes of it: ``100 - b + b n N / L``, in whole numbers of any size."""
    value, place = np.unique(lengths, return_inverse=True)
    return np.array([100 - B + B * int(n) * n_docs // n_terms for n in value], np.int64)[place]


def _saturation(tf: np.ndarray, offset: np.ndarray) -> np.ndarray:
    return UNIT * tf // (TF * tf + LENGTH * offset)


def _totals(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            n = [len(words(t)) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"docs": [sum(map(bool, n))], "terms": [sum(n)]})


def _binary(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Values cut at ``starts`` (one more than there are cells) as an array of their bytes."""
    offsets = (starts * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


INDEX = "block long, term binary, docs binary, impacts binary, tfs binary, keys array<long>, lengths binary"
_INDEX = pa.schema([("block", pa.int64()), ("term", pa.binary()), ("docs", pa.binary()), ("impacts", pa.binary()), ("tfs", pa.binary()), ("keys", pa.list_(pa.int64())), ("lengths", pa.binary())])


def _inverted(part: pa.RecordBatch, block: int, n_docs: int, n_terms: int) -> pa.RecordBatch:
    found = [words(t) for t in part.column("text").to_pylist()]
    lengths = np.array([len(w) for w in found], np.int64)
    flat = np.empty(int(lengths.sum()), object)
    flat[:] = [w for ws in found for w in ws]
    code, terms = pd.factorize(flat)
    pair, tf = np.unique(code * np.int64(len(found)) + np.repeat(np.arange(len(found)), lengths), return_counts=True)
    doc = pair % len(found)
    impact = -(-_saturation(tf, _offset(lengths, n_docs, n_terms)[doc] if n_terms else doc) // STEP)
    starts = np.searchsorted(pair // len(found), np.arange(len(terms) + 1))
    none, n = pa.nulls, len(terms)
    rows = [pa.array(list(terms), pa.binary()), _binary(doc.astype("<u2"), starts), _binary(impact.astype(np.uint8), starts), _binary(tf.astype("<u4"), starts), none(n, pa.list_(pa.int64())), none(n, pa.binary())]
    keys = pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), part.column("key"))
    last = [none(1, pa.binary())] * 4 + [keys, _binary(lengths.astype("<i8"), np.array([0, len(found)]))]
    columns = [pa.concat_arrays([a, b]) for a, b in zip(rows, last)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n + 1, block)), *columns], schema=_INDEX)


def _blocks(n_docs: int, n_terms: int, block_docs: int):
    def run(batches):
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text"):
                for at in range(0, part.num_rows, block_docs):
                    yield _inverted(part.slice(at, block_docs), block, n_docs, n_terms)
                    block += 1

    return run


def build(df: DataFrame, key: str = "doc_id", text: str = "text", block_docs: int = 4096) -> Index:
    """The index of all rows of ``df``: every term of every whole text.

    A term is a longest run of ASCII letters, digits and characters beyond ASCII, ASCII letters in lower case. A null text
    and one without terms add nothing to the counts and are never found; a null key is kept; rows that repeat a key are
    documents of their own; other columns are ignored. A block holds ``block_docs`` documents (65,536 at most) and about
    4 MB of text, or a single longer text. The bytes hold for the counts of this table: more rows need a new index.
    """
    docs = df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("text"))
    sums = docs.select("text").mapInArrow(_totals, "docs long, terms long").agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).collect()[0]
    n_docs, n_terms = sums["docs"] or 0, sums["terms"] or 0
    return Index(written(docs.mapInArrow(_blocks(n_docs, n_terms, min(block_docs, 65_536)), INDEX), "index"), n_docs, n_terms)


def _asked(batches):
    for batch in batches:
        rows = [(i, *t) for i, w in enumerate(batch.column("text").to_pylist()) for t in zip(*np.unique(np.array(words(w), object), return_counts=True))]
        at = pa.array([r[0] for r in rows], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("item").take(at), pa.array([r[1] for r in rows], pa.binary()), pa.array([int(r[2]) for r in rows], pa.int64())], ["item", "term", "times"])


class _Items:
    """The items of one block of them, and the matrix row of each."""

    def __init__(self, items: list[bytes]):
        self.items = sorted(set(items))
        self.row = {item: i for i, item in enumerate(self.items)}


def _upper(table: pa.Table, items: _Items, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Upper bounds of every item and document of a block, and by how much a score may be less."""
    upper, gap = np.zeros((len(items.items), n), np.int64), np.zeros((len(items.items), n), np.int64)
    for docs, impacts, asked in zip(table.column("docs").to_pylist(), table.column("impacts").to_pylist(), table.column("asked").to_pylist()):
        doc, impact = np.frombuffer(docs, "<u2"), np.frombuffer(impacts, np.uint8).astype(np.int64)
        rows, weight = _rows(asked, items)
        upper[rows[:, None], doc[None, :]] += weight[:, None] * (impact * STEP)[None, :]
        gap[rows[:, None], doc[None, :]] += weight[:, None] * np.where(impact > 0, STEP - 1, 0)[None, :]
    return upper, gap


def _rows(asked: list[dict], items: _Items) -> tuple[np.ndarray, np.ndarray]:
    known = [a for a in asked if a["item"] in items.row]
    return np.array([items.row[a["item"]] for a in known], int), np.array([a["weight"] for a in known], np.int64)


def _bounds(k: int):
    """For every item with a document in the block, its largest upper bound and its ``k`` largest lower ones."""

    def run(table: pa.Table) -> pa.Table:
        items = _Items([a["item"] for asked in table.column("asked").to_pylist() for a in asked])
        n = 1 + max(int(np.frombuffer(d, "<u2").max()) for d in table.column("docs").to_pylist())
        upper, gap = _upper(table, items, n)
        low = upper - gap
        if n > k:
            low = np.partition(low, n - k, axis=1)[:, n - k :]
        rows = [(item, int(most), [int(v) for v in lows if v > 0]) for item, most, lows in zip(items.items, upper.max(1), low) if most > 0]
        first = lambda c: pa.array([table.column(c)[0].as_py()] * len(rows), pa.int64())
        return pa.table([first("part"), first("block"), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], names=["part", "block", "item", "most", "lows"])

    return run


def _rescored(k: int, n_docs: int, n_terms: int):
    """Exact scores of the documents whose bound reaches the item's: at most ``k`` of a block and item go on."""
    schema = pa.schema([("item", pa.binary()), ("key", pa.int64()), ("score", pa.int64())])

    def run(table: pa.Table, alive: pa.Table) -> pa.Table:
        if not alive.num_rows or not table.num_rows:
            return schema.empty_table()
        one = alive.slice(0, 1).to_pylist()[0]
        least = {a["item"]: a["least"] for a in one["alive"]}
        items, keys, lengths = _Items(list(least)), one["keys"], np.frombuffer(one["lengths"], "<i8")
        offset = _offset(lengths, n_docs, n_terms)
        upper, _ = _upper(table, items, len(keys))
        reach = upper >= np.array([least[i] for i in items.items])[:, None]
        score = np.zeros_like(upper)
        for docs, tfs, asked in zip(table.column("docs").to_pylist(), table.column("tfs").to_pylist(), table.column("asked").to_pylist()):
            doc, (rows, weight) = np.frombuffer(docs, "<u2"), _rows(asked, items)
            held = reach[rows[:, None], doc[None, :]]
            some = np.flatnonzero(held.any(0))
            exact = _saturation(np.frombuffer(tfs, "<u4").astype(np.int64)[some], offset[doc[some]])
            score[rows[:, None], doc[some][None, :]] += weight[:, None] * exact[None, :] * held[:, some]
        void = np.array([x is None for x in keys])
        number = np.array([x or 0 for x in keys], np.int64)
        i, j = np.nonzero(reach & (score > 0))
        rank = np.lexsort((number[j], void[j], -score[i, j], i))
        i, j = i[rank], j[rank]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        i, j = i[place < k], j[place < k]
        return pa.table([pa.array([items.items[x] for x in i], pa.binary()), pa.array([keys[x] for x in j], pa.int64()), pa.array(score[i, j])], schema=schema)

    return run


def search(index: Index, items: DataFrame, key: str = "item_id", text: str = "text", doc_key: str = "doc_id", k: int = 10, block_items: int = 256) -> DataFrame:
    """The ``k`` highest-scoring documents of every item: ``key``, ``rank`` from 1, ``doc_key``, ``score``.

    Only documents with a score above 0 are found; equal scores go to the smaller document key (a null key last). An item
    with a null text or without a term of the index has no rows; items that repeat a key with another text are ranked by
    themselves, equal rows once; other columns are ignored. A term that an item repeats counts as often.
    """
    known = items.select(F.col(key).alias("name"), F.col(text).alias("text")).distinct().withColumn("item", row_id(F.col("name"), F.col("text")))
    known = written(known, "items")
    parts = max(1, -(-known.count() // block_items))
    terms = known.where("text is not null").select("item", F.col("text").cast("binary").alias("text")).mapInArrow(_asked, "item binary, term binary, times long")
    terms = terms.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(parts)).cast("int"))
    bare = written(terms.groupBy("part", "term").agg(F.collect_list(F.struct("item", "times")).alias("asked")), "terms")
    postings = index.table.where("term is not null")

    def meet(rows: DataFrame, asked: DataFrame, size: int) -> DataFrame:
        return rows.join(F.broadcast(asked) if size <= BROADCAST_BYTES else asked, "term")

    size = bare.agg(F.sum(F.length("term") + 32 * F.size("asked"))).collect()[0][0] or 0
    held = meet(postings.select("term", F.length("docs").alias("bytes")), bare.select("term").distinct(), size)
    frequency = held.groupBy("term").agg((F.sum("bytes") / 2).cast("long").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * index.n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weighed = bare.join(frequency, "term").withColumn("w", weight).select("part", "term", F.transform("asked", lambda a: F.struct(a["item"].alias("item"), (a["times"] * F.col("w")).alias("weight"))).alias("asked"))
    asked = written(weighed, "asked")
    drop_written(bare)

    first = meet(postings.select("block", "term", "docs", "impacts"), asked, size).drop("term")
    bounds = written(first.groupBy("part", "block").applyInArrow(_bounds(k), "part long, block long, item binary, most long, lows array<long>"), "bounds")
    best = Window.partitionBy("item").orderBy(F.desc("low"))
    lows = bounds.select("item", F.explode("lows").alias("low")).withColumn("n", F.row_number().over(best)).where(F.col("n") <= k)
    least = lows.groupBy("item").agg(F.when(F.count("*") == k, F.min("low")).otherwise(1).alias("least"))
    alive = bounds.select("part", "block", "item", "most").join(least, "item").where("most >= least")
    alive = written(alive.groupBy("part", "block").agg(F.collect_list(F.struct("item", "least")).alias("alive")), "alive")  # at most the items of one part
    places = alive.select("part", "block")
    places = F.broadcast(places) if 16 * alive.count() <= BROADCAST_BYTES else places
    owned = index.table.where("term is null").select("block", "keys", "lengths")
    alive = alive.join(owned.join(places.select("block").distinct(), "block", "left_semi"), "block")

    second = meet(postings.select("block", "term", "docs", "impacts", "tfs"), asked, size).drop("term").withColumn("part", F.col("part").cast("long"))
    second = second.join(places, ["part", "block"], "left_semi")
    scored = second.groupBy("part", "block").cogroup(alive.groupBy("part", "block")).applyInArrow(_rescored(k, index.n_docs, index.n_terms), "item binary, key long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(known.select("item", "name"), "item").select(F.col("name").alias(key), "rank", F.col("key").alias(doc_key), "score")


def sql(documents: str = "documents", items: str = "benchmark", k: int = 10) -> str:
    """The same in DuckDB's SQL by scoring every document that shares a term with an item."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    terms = lambda c: f"unnest(regexp_extract_all(translate({c}, '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))"
    return f"""WITH t AS (SELECT doc_id, {terms("text")} AS term FROM {documents}), f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
    d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM f GROUP BY 1), s AS (SELECT count(*) AS nd, sum(n)::BIGINT AS l FROM d),
    w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * nd + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM f, s GROUP BY term, nd),
    q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {terms("text")} AS term FROM {items}) GROUP BY ALL),
    x AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // l))))::BIGINT AS score FROM q JOIN w USING (term) JOIN f USING (term) JOIN d USING (doc_id), s GROUP BY ALL),
    r AS (SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank FROM x WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {k}"""
