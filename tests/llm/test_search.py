"""Top-k by inner product, ranked lexical search and fill-in-middle, against plain versions of themselves."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from driftline.llm import infill, knn, retrieval
from tests.llm.oracle import best_products, cut_text, ranked


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, key string, uid long")


def test_top_k_clusters_and_copies(spark):
    """Three tight clusters and a third of all rows one vector: pruned by pivots, in many blocks, and nothing is lost."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(3, 12)) * 4
    rows = [(i, (centres[i % 3] + rng.normal(size=12) * 0.05).tolist(), 0, "x", 5) for i in range(600)]
    rows += [(600 + i, centres[0].tolist(), 0, "x", 5) for i in range(300)]
    found = knn.top_k(_vectors(spark, rows), F.col("vec_id") % 50 == 0, cell_rows=60, block_queries=4, slice_rows=100)
    assert sorted(map(tuple, found.collect())) == best_products([(r[0], r[1]) for r in rows], 5)


def test_top_k_sends_only_what_is_needed(spark):
    rng = np.random.default_rng(4)
    centres = np.eye(4) * 10
    rows = [(i, (centres[i % 4] + rng.normal(size=4) * 0.01).tolist(), 0, "", 0) for i in range(800)]
    cells = knn._Cells(4, 1.0, 10.2, np.column_stack([centres / 10.2, np.sqrt(np.maximum(1 - (centres**2).sum(1) / 10.2**2, 0))]))
    frame = spark.createDataFrame([(i, i, i % 50 == 0, 4, v) for i, v, *_ in rows], "uid long, key long, is_query boolean, dim int, vector array<double>")
    plan = knn._planned(frame, cells, 5, 1)
    sent = sum(len(pick) for _, pick in plan.needed(4, np.array([r[1] for r in rows])))
    assert len(set(plan.group.tolist()) - {-1}) == 2 and sent == 400  # the two clusters that hold queries


def test_top_k_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, [1.0, 2.0]), (50, [0.5, -3.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 0.0]), (None, [9.0, 9.0]), (5, [1e300, 1.0]), (6, [0.001, -0.001]), (100, []), (7, []), (150, [1.0, 2.0, 3.0]), (8, [1e12, -1e12, 1.0])]
    found = knn.top_k(_vectors(spark, [(*r, 1, "k", 2) for r in rows]), F.col("vec_id") % 50 == 0, k=3)
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, best_products(rows, 3)))
    assert knn.top_k(_vectors(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    assert knn.top_k(_vectors(spark, [(0, [1.0], 1, "", 1)]), F.col("vec_id") % 50 == 0).count() == 0


WORDS = ["the", "of", "Été", "naïve", "x1", "Stone", "stone-mill", "a'b", "漢字", "river_bank", "q"]


def _texts(n, seed):
    rng = random.Random(seed)
    return [" ".join(rng.choices(WORDS, k=rng.randint(1, 30))) + rng.choice(["", ".", "\n!?"]) for _ in range(n)]


def test_ranked_search(spark):
    docs = [(i, t, 1, "z") for i, t in enumerate(_texts(300, 1))]
    docs += [(1000 + i, docs[7][1], 1, "z") for i in range(150)]  # a third of the rows are copies
    docs += [(None, docs[7][1], 1, "z"), (5, docs[5][1], 1, "z"), (2000, None, 1, "z"), (2001, "", 1, "z"), (2002, " ,;\x00\t", 1, "z"), (2003, "stone " * 20000, 1, "z"), (2004, "漢" * 30000, 1, "z")]
    items = [(1, "Stone river_bank the the", 3), (2, docs[7][1], 3), (2, "naïve ÉTÉ", 3), (3, None, 3), (4, "unheard words", 3), (5, "", 3), (6, "of", 3), (6, "of", 3), (None, "q q q x1", 3)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, block int, term string").repartition(7)
    asked = spark.createDataFrame(items, "item_id long, text string, part int")
    for block, part in ((4096, 256), (16, 2)):
        found = retrieval.search(retrieval.build(frame, block_docs=block), asked, block_items=part)
        assert sorted(map(repr, map(tuple, found.collect()))) == ranked([d[:2] for d in docs], items, 10)
    none = retrieval.build(frame.limit(0))
    assert retrieval.search(none, asked).count() == 0
    assert retrieval.search(retrieval.build(frame), asked.limit(0)).count() == 0


def test_bytes_bound_scores():
    """The byte of a posting is an upper bound, and less one step a lower one, whatever the document."""
    for tf in (1, 2, 3, 50, 10**6):
        for offset in (25, 100, 10**5, 10**12):
            exact = int(retrieval._saturation(np.array([tf]), np.array([offset]))[0])
            byte = -(-exact // retrieval.STEP)
            assert byte <= 255 and byte * retrieval.STEP >= exact >= byte * retrieval.STEP - (retrieval.STEP - 1 if byte else 0)


def test_elias_fano():
    rng = random.Random(5)
    for n in (0, 1, 2, 9, 1000):
        for step in (1, 3, 700):
            values = np.cumsum([rng.randint(1, step) for _ in range(n)]).astype(np.int64)
            coded = infill.ef_encode(values)
            assert infill.ef_size(coded) == n and [infill.ef_select(coded, i) for i in range(n)] == values.tolist()


TEXTS = [None, "", "one", "a\nb\nc\n", "a\n\n\n", "\n", "\r\nx\r\n", "été\n漢字\n😀 z", "holds <P> mark\nb", "<S>", "x<M", "line\n" * 5000, "y" * 100_000]


def test_fill_in_middle(spark):
    rows = [(i, t, "n", "s") for i, t in enumerate(TEXTS * 8)]
    rows += [(1000 + i, "hot\ntext\nof many", "n", "s") for i in range(300)] + [(7, "again\nand again", "n", "s")] * 3 + [(None, "p\nq\nr", "n", "s")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, digest string, slice string")
    for fim, spm in ((100, 50), (60, 100)):
        want = sorted(repr(cut_text(k, t, 7, fim, spm)) for k, t, *_ in rows)
        texts = sorted(repr(tuple(r)) for r in infill.cut_documents(frame, fim_rate=fim, spm_rate=spm).collect())
        assert texts == want
    hashed = infill.digests(frame).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert sorted(repr(tuple(r)) for r in hashed) == sorted(repr((*c[:5], sha(c[5]), sha(c[6]))) for c in (cut_text(k, t, 7, 100, 50) for k, t, *_ in rows))
    assert infill.digests(frame.limit(0)).count() == 0
    assert {r["form"] for r in hashed} == {"plain", "psm", "spm"}


def test_index_has_one_entry_a_text(spark):
    frame = spark.createDataFrame([(i, f"t{i % 5}\nz") for i in range(40)], "doc_id long, text string")
    none = spark.createDataFrame([], "digest binary, slices int")
    entries = infill.index(frame, "doc_id", "text", none).collect()
    assert len(entries) == 5 and sorted(k["key"] for e in entries for k in e["keys"]) == list(range(40))
    dealt = frame.select(infill._digest(F.col("text")).alias("digest"), F.lit(3).alias("slices")).distinct()
    assert {len(e["keys"]) < 8 for e in infill.index(frame, "doc_id", "text", dealt).collect()} == {True}
