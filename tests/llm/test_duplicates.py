"""Pairs, lines and vectors against brute force, and odd rows."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.llm import embeddings, jaccard, lines
from driftline.llm.queries import QUERIES


def unions(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def shingles(t):
    w = (t or "").lower().encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def check_jaccard(spark, rows, **options):
    sets = [shingles(t) for _, t in rows]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    root = unions(len(rows), pairs)
    links = np.bincount([x for p in pairs for x in p], minlength=len(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("set", F.lit("clash")).withColumn("row", F.lit(1))
    got = {r["doc_id"]: r for r in jaccard.near_duplicates(df, **options).collect()}
    assert len(got) == len(rows)
    for i, (key, _) in enumerate(rows):
        least = min(rows[j][0] for j in range(len(rows)) if root[j] == root[i])
        assert (got[key]["class_id"], got[key]["n_links"], got[key]["kept"]) == (least, links[i], key == least)


def test_jaccard_equals_brute_force(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    for k in range(60):  # one large group of near copies, and a passage that many texts share
        words = list(base)
        for j in rng.choice(120, 3, replace=False):
            words[j] = f"x{k}_{j}"
        rows.append((10_000 + k, " ".join(words)))
        rows.append((20_000 + k, " ".join(base[:20] + [f"y{k}_{j}" for j in range(60)])))
    odd = [None, "", "one two", "one two", "One  two", "a b c d e", " \n", "z " * 4000, "z " * 4001]
    check_jaccard(spark, rows + [(30_000 + i, t) for i, t in enumerate(odd)])
    check_jaccard(spark, rows, bucket_rows=10, block_rows=16, small=0)


def test_jaccard_empty_and_null_keys(spark):
    schema = "doc_id long, text string"
    assert jaccard.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    got = jaccard.near_duplicates(spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (None, "q"), (4, "a b c d e f")], schema)).collect()
    assert sorted((r["doc_id"] is None, r["class_id"] or 0, r["n_links"], r["kept"]) for r in got) == [(False, 4, 2, True), (False, 4, 2, True), (True, 0, 0, True), (True, 4, 2, False)]


@pytest.mark.parametrize("depth", [1, 2])
def test_families_joined_by_one_pair(spark, depth):
    """Two families of over 200 sets in the same buckets; a is near the first only, b near the second only, and near each other."""
    def sketch(*changed):
        tokens = np.zeros(64, np.uint64)
        for at, value in changed:
            tokens[at] = value
        low = (tokens & np.uint64(15)).reshape(4, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))
        return [int(v) for v in np.bitwise_or.reduce(low, axis=1).view(np.int64)]

    places = lambda n: [(i, 1) for i in range(n)]
    family_1 = [(i, sketch((63, i % 15))) for i in range(250)]
    family_2 = [(1000 + i, sketch(*places(45), (63, i % 15))) for i in range(250)]
    rows = [(k, list(range(jaccard.TOKENS)), *s) for k, s in family_1 + [(500, sketch(*places(15))), (600, sketch(*places(30)))] + family_2]
    sets = spark.createDataFrame(rows, "set long, tokens array<int>, k0 long, k1 long, k2 long, k3 long")
    for run in range(2):
        edges = [(r["a"], r["b"]) for r in jaccard._run(sets, run, jaccard.sketch_limit(0.8), 0.8, 200, depth).collect()]
        at = {r[0]: i for i, r in enumerate(rows)}
        assert len(set(unions(len(rows), [(at[a], at[b]) for a, b in edges]))) == 1


def distance(x, y):
    prev = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        cur = [i]
        for j, d in enumerate(y, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (c != d)))
        prev = cur
    return prev[-1]


def line_oracle(rows):
    """Brute force by edit similarity alone, over words cut here: what goes by key, and the number of linked pairs."""
    found = []
    for key, text in rows:
        for pos, line in enumerate((text or "").split("\n")):
            words = tuple(w for w in re.split(r"[\x00-/:-@\[-`{-\x7f]+", line.lower()) if w)
            if len(words) >= 5:
                found.append((key, pos, words))
    found.sort()
    norms = sorted({w for _, _, w in found})
    at = {n: i for i, n in enumerate(norms)}
    pairs = [(a, b) for a, x in enumerate(norms) for b, y in enumerate(norms[:a]) if abs(len(x) - len(y)) <= 0.2 * max(len(x), len(y)) and distance(x, y) <= int(0.2 * max(len(x), len(y)) + 1e-9)]
    root, first, gone = unions(len(norms), pairs), set(), {}
    for key, pos, w in found:
        if root[at[w]] in first:
            gone.setdefault(key, set()).add(pos)
        first.add(root[at[w]])
    return gone, len(pairs)


def test_lines_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    rows, base = [], [f"word{i}" for i in range(60)]
    for k in range(80):
        near = list(base)
        near[rng.integers(60)] = f"v{k}"
        own = " ".join(f"u{k}x{j}" for j in range(12))
        rows.append((k, "\n".join([" ".join(near), own, "short line", "A common line, that repeats 12 times.", own.upper() + "!"])))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "one " * 300 + "\n" + "one " * 300), (104, "a common LINE that repeats 99 times")]
    gone, n_pairs = line_oracle(rows)
    assert n_pairs > 20
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("gone", F.lit("clash"))
    got = {r["doc_id"]: r for r in lines.deduplicated(df).collect()}
    assert len(got) == len(rows)
    for key, t in rows:
        drop = gone.get(key, set())
        want = t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in drop)
        assert (got[key]["text"], got[key]["n_dropped"]) == (want, len(drop))
    assert got[100]["n_lines"] == 0
    assert lines.deduplicated(df.limit(0)).count() == 0


def edited(rng, words, edits, tag):
    """Words with so many of them replaced, left out or put in."""
    words = list(words)
    for e in range(edits):
        at, how = int(rng.integers(len(words))), rng.integers(3)
        words[at : at + (how < 2)] = [] if how == 1 else [f"{tag}e{e}"]
    return words


def test_lines_recall_by_edit_similarity_alone(spark):
    """Every pair of edit similarity 0.8 is linked, at any length and at any number of edits that leaves it so."""
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for n in (5, 6, 9, 10, 14, 20, 30, 45, 60, 120):
        for k in range(12):
            base = [vocabulary[int(400 * x * x)] for x in rng.random(n)]
            near = edited(rng, base, 1 + k % (n // 5), f"n{n}k{k}")
            while len(near) < 5 or n // 5 > 0.2 * max(n, len(near)) + 1e-9:
                near = edited(rng, base, 1, f"n{n}k{k}")
            rows += [(10_000 * n + k, " ".join(base)), (10_000 * n + 5_000 + k, " ".join(near))]
    got = {r["doc_id"]: r["n_dropped"] for r in lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    kept_near = [d for d, n in got.items() if d % 10_000 >= 5_000 and n == 0]
    assert not kept_near and sum(got.values()) >= 120


def line_query(spark, folder, texts):
    """What op2_line_dedup leaves of texts numbered from 0."""
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return [r["text"] for r in QUERIES["op2_line_dedup"](spark, str(folder)).orderBy("doc_id").collect()]


def test_short_lines_that_repeat_go(spark, tmp_path):
    texts = ["Read more\none two", "read MORE!\n--\n\n--", "短い行です\nRead", "短い行です\nread less"]
    assert line_query(spark, tmp_path, texts) == ["Read more\none two", "--\n\n--", "短い行です\nRead", "read less"]


def test_rows_that_differ_in_digits_stay(spark, tmp_path):
    table = "2021 | 341 | 552 | 120 | 77\n2020 | 118 | 904 | 333 | 61"
    long = " ".join(f"word{i}" for i in range(9))
    assert line_query(spark, tmp_path, [table, "2021 | 341 | 552 | 120 | 77\n2020 | 118 | 904 | 333 | 62\n2019 | 118 | 905 | 334 | 62", f"{long} 12", f"{long} 13"]) == [table, "2019 | 118 | 905 | 334 | 62", f"{long} 12", ""]


@pytest.mark.parametrize("n", [5, 9, 10, 20, 40, 60, 200])
def test_lines_just_similar_enough_share_a_block(spark, n):
    """Pairs at 0.8 or just above it, words changed, left out or put in anywhere: at least 0.97 have a block in common."""
    rng = np.random.default_rng(n)
    rows, tries = [], 200
    for k in range(tries):
        base = [f"w{x}" for x in rng.integers(0, 5000, n)]
        near = edited(rng, base, n // 5, f"k{k}")
        while len(near) < 5 or distance(base, near) > 0.2 * max(n, len(near)) + 1e-9:
            near = edited(rng, base, n // 5, f"k{k}")
        rows.append((k, base, near))
    df = spark.createDataFrame(rows, "k int, a array<string>, b array<string>")
    met = df.select(F.arrays_overlap(lines.blocks_of(F.col("a"), F.size("a"), 0.8), lines.blocks_of(F.col("b"), F.size("b"), 0.8)).alias("met"))
    assert met.where("met").count() >= (0.97 if n > 10 else 1) * tries


def test_lines_of_one_block_that_differ(spark):
    """A passage that thousands of otherwise different lines share links none of them, in any number of slices."""
    rng = np.random.default_rng(4)
    passage = [f"p{i}" for i in range(12)]
    rows = [(k, " ".join(passage + [f"w{x}" for x in rng.integers(0, 10**6, 14)])) for k in range(2500)]
    rows += [(5000 + k, " ".join(passage + [f"z{x}" for x in range(14)] + [f"end{k}"])) for k in range(2)]
    got = {r["doc_id"]: r["n_dropped"] for r in lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [k for k, n in got.items() if n] == [5001]


def test_lines_odd_rows(spark):
    rows = [(None, "one two three four five six"), (3, "ONE two, three four five six"), (3, "ONE two, three four five six"), (None, "x"), (4, None), (None, None), (5, "5 6 7 8 9\n5 6 7 8 9")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("clash")).withColumn("key", F.lit("clash"))
    got = sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"], r["key"]) for r in lines.deduplicated(df).collect()), key=repr)
    want = [(3, rows[1][1], 1, 0), (3, rows[1][1], 1, 0), (4, None, 0, 0), (5, "5 6 7 8 9", 2, 1), (None, "", 1, 1), (None, "x", 1, 0), (None, None, 0, 0)]
    assert got == sorted(((*w, "clash") for w in want), key=repr)


def vectors(seed=1, n=300, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dim))
    x = centres[rng.integers(0, 20, n)] + rng.normal(scale=0.25, size=(n, dim))
    return x.astype(np.float32)


def test_embeddings_equal_brute_force(spark):
    x = vectors()
    x[7] = x[3]
    label = [i % 3 for i in range(len(x))]
    label[7] = label[3]
    rows = [(i, [float(v) for v in x[i]], label[i]) for i in range(len(x))]
    odd = [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [float("nan")] * 16, 1), (904, [None] + [1.0] * 15, 1), (905, [float("inf")] + [1.0] * 15, 1), (906, [1.0] * 16, None), (907, [1.0, 2.0], 1), (908, [1.0, 2.0], 1)]
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    pairs = [(a, b) for a in range(len(x)) for b in range(a + 1, len(x)) if label[a] == label[b] and u[a] @ u[b] >= 0.93]
    root, links = unions(len(x), pairs), np.bincount([v for p in pairs for v in p], minlength=len(x))
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").withColumn("gid", F.lit("clash"))
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df, cell_rows=60, block_rows=16, probes=8).collect()}
    assert len(got) == len(rows) + len(odd) and len(pairs) > 50
    for i in range(len(x)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (links[i], root[i], root[i] == i)
    for key, *_ in odd[:7]:
        assert (got[key]["n_links"], got[key]["component_id"], got[key]["kept"]) == (0, key, True)
    assert (got[908]["n_links"], got[908]["component_id"]) == (1, 907)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_embeddings_recall(spark, seed):
    x = vectors(seed, 1500)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    true = np.count_nonzero(np.triu(u @ u.T >= 0.93, 1))
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], 0) for i in range(len(x))], "vec_id long, embedding array<float>, label int")
    found = embeddings.near_duplicates(df, cell_rows=200).agg(F.sum("n_links")).first()[0] / 2
    assert 0.9 * true <= found <= true


def test_queries_are_whole(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name in ("op1_ngram_jaccard", "op2_line_dedup"):
        assert QUERIES[name](spark, sf_dir).count() == n


def join_rows(df, key):
    """Rows that the joins on ``key`` make when ``df`` runs."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            todo.append(node.plan())
        else:
            if "Join" in name and key in node.simpleString(100):
                total += node.metrics().apply("numOutputRows").value()
            children = node.children().iterator()
            while children.hasNext():
                todo.append(children.next())
    return total


def test_lines_of_a_block_make_no_pairs_unless_similar(spark, monkeypatch):
    r = np.random.default_rng(5)
    base = [f"common{i}" for i in range(60)]
    texts = []
    for k in range(60):
        words = list(base)
        for i in r.choice(60, 7, replace=False):
            words[i] = f"own{k}x{i}"
        texts.append(" ".join(words))
    same = lambda a, b: sum(x == y for x, y in zip(a.split(), b.split()))
    similar = sum(same(a, b) >= 48 for i, a in enumerate(texts) for b in texts[:i])
    made, write = [], lines.written
    monkeypatch.setattr(lines, "written", lambda df, name, *codec: made.append(join_rows(df, "slice")) or write(df, name, *codec) if name in ("pairs", "links") else write(df, name, *codec))
    rows = lines.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    want = unions(60, [(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts[:i]) if same(a, b) >= 48])
    assert [x["n_dropped"] for x in sorted(rows)] == [int(w != i) for i, w in enumerate(want)]
    assert sum(made) <= similar


def test_sketches_of_the_next_scale_only_where_a_similar_line_may_have_it(spark):
    rng = np.random.default_rng(6)
    found = {}
    for n in (20, 100, 101, 103, 127, 128, 203, 206):
        words = [f"w{x}" for x in rng.integers(0, 10**6, n)]
        df = spark.createDataFrame([(words,)], "w array<string>").select(lines._sketches(lines.codes_of(F.col("w")), 0.8).alias("s"))
        found[n] = df.first()["s"]["c0"] is not None
    assert found == {20: False, 100: False, 101: False, 103: True, 127: True, 128: False, 203: False, 206: True}
    base = [f"w{x}" for x in rng.integers(0, 10**6, 128)]
    pairs = [(1, " ".join(base)), (2, " ".join(base[:103])), (3, "x y z " + " ".join(base[:99]))]
    got = {r["doc_id"]: r["n_dropped"] for r in lines.deduplicated(spark.createDataFrame(pairs, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 1, 3: 1}  # 103 of 128 words are similar to them over two scales; the third to the second
