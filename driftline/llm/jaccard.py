"""N-gram Jaccard join by chosen paths.

A document is the set of its five-word shingles. Each set is embedded as ``TOKENS`` minhash tokens. A run samples
token positions; sets that share the token at a sampled position meet in a bucket. In a bucket all sets are compared
by sketch: those near the bucket's pivot are linked to it, so only the others, the far ones, are compared with the
whole bucket, in slices where it is large. Only where that would be too many pairs is the bucket split again on tokens
sampled for it. Runs are repeated until a further run finds (almost) nothing that the runs before it had not put
together.

What a run leaves are groups of sets that may be similar. Inside the groups every pair is compared exactly, block
by block, which gives the links; nothing is emitted per pair. Equal sets are collapsed before all that. Sets and rows
go by 128-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import connected, drop_written, partitions, row_id, runs_of_rows, written
from driftline.llm.embeddings import _local_roots

SHINGLE = 5
TOKENS = 64
_NIBBLE = 0x1111111111111111
_RANDOM = np.random.default_rng(64_05)
_WORD_MIX = _RANDOM.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULTIPLY = _RANDOM.integers(1, 2**63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RANDOM.integers(0, 2**63, TOKENS, dtype=np.uint64)


def _word_codes(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """64-bit codes of words, the same in every task."""
    for w in {*words}.difference(known):
        known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingles(text: str | None, known: dict[bytes, int] | None = None) -> np.ndarray:
    """Sorted distinct 64-bit codes of the five-word shingles of the lower-cased text; a shorter text is one shingle."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros(0, np.uint64)
    codes = _word_codes(words, {} if known is None else known)
    n = max(1, len(words) - SHINGLE + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(words))):
        out += codes[k : k + n] * _WORD_MIX[k]
    out ^= out >> np.uint64(29)
    return np.unique(out * np.uint64(0xBF58476D1CE4E5B9))


def _embed(batches):
    """One row a document: the hash of its set, the set's size, its minhash tokens and their low four bits."""
    known: dict[bytes, int] = {}
    for whole in batches:
        for pdf in runs_of_rows(whole, "text"):
            if len(known) > 200_000:
                known.clear()
            sets = [shingles(t, known) for t in pdf["text"]]
            full = [i for i, s in enumerate(sets) if len(s)]
            if not full:
                continue
            values = np.concatenate([sets[i] for i in full])
            starts = np.cumsum([0, *(len(sets[i]) for i in full[:-1])])
            mins = np.empty((len(full), TOKENS), np.uint32)
            for k in range(TOKENS):
                mixed = values * _MULTIPLY[k] + _ADD[k]
                mins[:, k] = np.minimum.reduceat((mixed >> np.uint64(32)).astype(np.uint32), starts)
            low = (mins & 15).astype(np.uint64).reshape(len(full), 4, 16)
            sketch = np.bitwise_or.reduce(low << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=2).view(np.int64)
            ids = [hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest() for i in full]
            yield pd.DataFrame({"row": pdf["row"].to_numpy()[full], "set": ids, "size": [len(sets[i]) for i in full], "tokens": list(mins.view(np.int32)), **{f"k{j}": sketch[:, j] for j in range(4)}})


def _differ(a: str, b: str) -> Column:
    """How many of the tokens' low bits differ between two sketches."""
    total = None
    for j in range(4):
        x = F.col(f"{a}{j}").bitwiseXOR(F.col(f"{b}{j}"))
        x = x.bitwiseOR(F.shiftright(x, 1))
        x = F.bit_count(x.bitwiseOR(F.shiftright(x, 2)).bitwiseAND(F.lit(_NIBBLE)))
        total = x if total is None else total + x
    return total


def sketch_limit(threshold: float) -> int:
    """Differing tokens up to which a pair is looked at: three and a half deviations beyond what the threshold expects."""
    expect = (1 - threshold) * 15 / 16
    return int(np.ceil(TOKENS * expect + 3.5 * np.sqrt(TOKENS * expect * (1 - expect))))


def _sketched(limit: int):
    """Edges that connect what some far sets of a bucket and some of all its sets, a slice and a block, are near."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        code, ids = pd.factorize(pdf["set"], sort=True)
        sketch = pdf[[f"k{j}" for j in range(4)]].to_numpy().view(np.uint64)
        far = pdf["far"].to_numpy()
        left, right = np.flatnonzero(far), np.flatnonzero(~far)
        found_a, found_b, found_d = [], [], []
        for at in range(0, len(left), 128):
            mine = left[at : at + 128]
            differ = np.zeros((len(mine), len(right)), np.int16)
            for j in range(4):
                x = sketch[mine, j][:, None] ^ sketch[right, j][None, :]
                x |= x >> np.uint64(1)
                differ += np.bitwise_count((x | x >> np.uint64(2)) & np.uint64(_NIBBLE))
            a, b = np.nonzero((differ <= limit) & (code[mine][:, None] != code[right][None, :]))
            found_a.append(code[mine[a]]), found_b.append(code[right[b]]), found_d.append(differ[a, b])
        if not found_a:
            return pd.DataFrame({"a": ids[:0], "b": ids[:0], "differ": np.zeros(0, np.int32)})
        # Of these edges a spanning forest is enough to tell what is together; the closest of each set stay besides.
        a, b, d = np.concatenate(found_a), np.concatenate(found_b), np.concatenate(found_d).astype(np.int32)
        root = _local_roots(len(ids), a, b)
        order = np.argsort(d, kind="stable")
        first = np.union1d(np.unique(a[order], return_index=True)[1], np.unique(b[order], return_index=True)[1])
        closest = order[first]
        joined = np.flatnonzero(root != np.arange(len(ids)))
        return pd.DataFrame({"a": np.concatenate([ids[a[closest]], ids[joined]]), "b": np.concatenate([ids[b[closest]], ids[root[joined]]]), "differ": np.concatenate([d[closest], np.full(len(joined), limit, np.int32)])})

    return one


def _blockwise(placed: DataFrame, load: DataFrame, limit: int, slice_rows: int = 512, block_rows: int = 4096) -> DataFrame:
    """Edges ``(a, b, differ)`` of the far sets of the buckets in ``load(node, members, n_far)`` with all sets there.

    The far sets of a bucket are dealt to slices and all its sets to blocks; a task meets one slice and one block, so
    it is bounded, and the rows are as many as the sets times the slices, few where few sets are far.
    """
    sized = load.select("node", F.ceil(F.col("n_far") / F.lit(slice_rows)).cast("int").alias("slices"), F.ceil(F.col("members") / F.lit(block_rows)).cast("int").alias("blocks"))
    rows = placed.join(sized, "node")
    sketch = [f"k{j}" for j in range(4)]
    dealt = lambda c, seed: F.pmod(F.xxhash64("set", F.lit(seed)), F.col(c)).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    far = rows.where(F.col("differ") > limit).select("node", dealt("slices", 3).alias("slice"), each("blocks").alias("block"), F.lit(True).alias("far"), "set", *sketch)
    others = rows.select("node", each("slices").alias("slice"), dealt("blocks", 4).alias("block"), F.lit(False).alias("far"), "set", *sketch)
    kind = placed.schema["set"].dataType.simpleString()
    return far.unionByName(others).groupBy("node", "slice", "block").applyInPandas(_sketched(limit), f"a {kind}, b {kind}, differ int")


def _run(sets: DataFrame, run: int, limit: int, threshold: float, bucket_rows: int, depth: int, direct_pairs: int = 1 << 26) -> DataFrame:
    """Candidate edges ``(a, b, differ)`` of one run.

    Large buckets are compared directly up to ``direct_pairs`` pairs of a far set and another, else split again.
    """
    sketch = [f"k{j}" for j in range(4)]
    made: list[DataFrame] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        made.append(written(df, name))
        return made[-1]

    def split(rows: DataFrame, node: Column) -> DataFrame:
        """Two token positions sampled for each node; a set goes on to one child by each."""
        def child(n: int) -> Column:
            place = F.pmod(F.xxhash64(node, F.lit(n)), F.lit(TOKENS // 2)).cast("int") * 2 + F.lit(n + 1)
            return F.xxhash64(node, place, F.element_at("tokens", place))

        return rows.withColumn("node", F.explode(F.array(child(0), child(1)))).select("node", "set", *sketch)

    drawn = F.struct(F.xxhash64("set", F.lit(run)), "set")  # another pivot in each run
    edges, rows = [], split(sets, F.lit(run))
    for level in range(depth):
        rows = kept(rows, "buckets")
        pivots = rows.groupBy("node").agg(F.min_by("set", drawn).alias("pivot"), *(F.min_by(k, drawn).alias(f"p{k[1]}") for k in sketch), F.count("*").alias("members")).where("members > 1")
        placed = rows.join(kept(pivots, "pivots"), "node").withColumn("differ", _differ("k", "p"))
        placed = kept(placed.select("node", "set", "pivot", "members", "differ", *sketch), "placed")
        is_far = F.col("differ") > limit
        edges.append(placed.where((F.col("set") != F.col("pivot")) & ~is_far).select(F.col("set").alias("a"), F.col("pivot").alias("b"), "differ"))
        # A small bucket meets as a whole.
        small, large = placed.where(F.col("members") <= bucket_rows), placed.where(F.col("members") > bucket_rows)
        mine = small.where(is_far).select("node", F.col("set").alias("a"), *(F.col(k).alias(f"u{k[1]}") for k in sketch))
        others = small.select("node", F.col("set").alias("b"), *(F.col(k).alias(f"v{k[1]}") for k in sketch))
        met = mine.join(others, "node").where((F.col("a") != F.col("b")) & (_differ("u", "v") <= limit))
        edges.append(met.select("a", "b", _differ("u", "v").alias("differ")))
        load = kept(large.groupBy("node", "members").agg(F.count(F.when(is_far, 1)).alias("n_far")).where("n_far > 0"), "load")
        last = level == depth - 1
        few = F.col("n_far") * F.col("members") <= direct_pairs
        edges.append(kept(_blockwise(large, load if last else load.where(few), limit), "blocks"))
        more = load.where(~few).select("node")
        if last or more.isEmpty():
            break
        rows = split(large.join(more, "node", "left_semi").select("node", "set").join(sets.select("set", "tokens", *sketch), "set"), F.col("node"))
    found = edges[0]
    for e in edges[1:]:
        found = found.unionByName(e)
    found = found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), "differ").distinct()
    found = written(found, "candidates")
    for t in made:
        drop_written(t)
    return found


def _sets_of(batches):
    known: dict[bytes, int] = {}
    for whole in batches:
        for pdf in runs_of_rows(whole, "text"):
            if len(known) > 200_000:
                known.clear()
            yield pd.DataFrame({"set": pdf["set"], "group": pdf["group"], "weight": pdf["weight"], "codes": [shingles(t, known).tobytes() for t in pdf["text"]]})


def _shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the left with the right sets."""
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, n = np.unique(values, return_inverse=True, return_counts=True)
    often = n[code] > 1
    code, owner = np.unique(code[often], return_inverse=True)[1], owner[often]
    width = int(code.max()) + 1 if len(code) else 0
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    step = 4096
    for a in range(0, width, step):
        lo, hi = np.searchsorted(code, [a, a + step])
        hot = np.zeros((len(sets), min(step, width - a)), np.float32)
        hot[owner[lo:hi], code[lo:hi] - a] = 1
        out += hot[left] @ hot[right].T
    return out


def _compare(threshold: float):
    def one(rows: list[tuple]) -> pd.DataFrame:
        rows.sort(key=lambda r: r[0])
        block = np.array([r[3] for r in rows])
        low, high = rows[0][4], rows[0][5]
        sets = [np.frombuffer(r[2], np.uint64) for r in rows]
        sizes = np.array([len(s) for s in sets], np.float64)
        left = np.flatnonzero(block == low)
        right = left if low == high else np.flatnonzero(block == high)
        if not len(left) or not len(right):
            return pd.DataFrame()
        both = _shared(sets, left, right).astype(np.float64)
        close = both >= threshold * (sizes[left][:, None] + sizes[right][None, :] - both) - 1e-9
        if low == high:
            close &= np.triu(np.ones_like(close), 1)
        a, b = np.nonzero(close)
        a, b = left[a], right[b]
        weight = np.array([r[1] for r in rows], np.int64)
        links = np.zeros(len(rows), np.int64)
        np.add.at(links, a, weight[b])
        np.add.at(links, b, weight[a])
        ids = np.array([r[0] for r in rows], object)
        out = pd.DataFrame({"set": ids, "links": links, "root": ids[_local_roots(len(rows), a, b)]})
        return out[links > 0]

    def run(batches):
        """Rows sorted by pair of blocks: each run of equal keys is one comparison of at most two blocks."""
        key, held, done = None, [], []
        for pdf in batches:
            for r in pdf[["set", "weight", "codes", "block", "block_a", "block_b", "group"]].itertuples(index=False, name=None):
                now = (r[6], r[4], r[5])
                if now != key:
                    if held:
                        done.append(one(held))
                    key, held = now, []
                held.append(r)
            if done:
                yield pd.concat(done) if any(map(len, done)) else pd.DataFrame({"set": [], "links": [], "root": []})
                done = []
        if held:
            last = one(held)
            if len(last):
                yield last

    return run


def _paired_blocks(coded: DataFrame, block_rows: int, block_bytes: int) -> DataFrame:
    """Each group dealt to blocks of about so many rows or bytes, and each row to the pairs of blocks it belongs to."""
    sizes = coded.groupBy("group").agg(F.count("*").alias("members"), F.sum(F.length("codes")).alias("bytes")).where("members > 1")
    blocks = F.ceil(F.greatest(F.col("members") / F.lit(block_rows), F.col("bytes") / F.lit(block_bytes))).cast("int")
    sized = sizes.select("group", blocks.alias("blocks"))
    dealt = coded.join(sized, "group").withColumn("block", F.pmod(F.xxhash64("set", F.lit(3)), F.col("blocks")).cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.withColumns({"block_a": F.least("block", "other"), "block_b": F.greatest("block", "other")}).drop("other", "blocks")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, recall: float = 0.999, runs: int = 3, max_runs: int = 40, bucket_rows: int = 200, depth: int = 4, block_rows: int = 1024, block_bytes: int = 8 << 20, small: int = 500_000) -> DataFrame:
    """One row per row of ``docs``: key, ``class_id``, ``n_links`` and ``kept``; ``row`` and ``class`` tell rows and groups.

    Documents are linked if the Jaccard similarity of their five-word shingle sets is at least ``threshold``;
    ``n_links`` counts the other rows linked directly, ``class_id`` is the least key reachable by links (the own
    one included), and ``kept`` marks the row whose key that is. A text that is null or blank has no shingles and
    links with nothing. Rows may repeat: equal rows link with each other and are kept alike. A null key counts as
    larger than any other and is kept if its class has no other key. Texts of any length are compared whole. Empty
    tables give empty results; other columns are ignored.
    The method may miss links; runs are repeated until one of them finds less than ``1 - recall`` outside what is
    already together. Should ``max_runs`` end that before, an error says so. Every link it reports is exact.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), row_id(F.col(key), F.col(text)).alias("row"), F.col(text).alias("text"))
    schema = "row binary, set binary, size int, tokens array<int>, k0 long, k1 long, k2 long, k3 long"
    embedded = written(rows.select("row", "text").mapInPandas(_embed, schema), "embedded")
    first = F.first(F.struct("tokens", "k0", "k1", "k2", "k3")).alias("s")
    sets = embedded.groupBy("set").agg(F.count("*").alias("weight"), F.min("row").alias("row"), first)
    sets = written(sets.select("set", "weight", "row", "s.*"), "sets")
    of = written(embedded.select("row", "set").distinct(), "of")
    drop_written(embedded)

    limit, likely = sketch_limit(threshold), int((1 - threshold) * TOKENS)
    edges = _run(sets, 0, limit, threshold, bucket_rows, depth)
    for r in range(1, runs):
        edges = edges.unionByName(_run(sets, r, limit, threshold, bucket_rows, depth))
    groups = connected(edges.select("a", "b"), "groups")
    for r in range(runs, max_runs + 1):
        if r == max_runs:
            raise RuntimeError(f"{max_runs} runs do not reach the asked recall")
        more = _run(sets, r, limit, threshold, bucket_rows, depth)
        home = groups.select(F.col("node").alias("a"), F.col("root").alias("x")), groups.select(F.col("node").alias("b"), F.col("root").alias("y"))
        seen = more.where(F.col("differ") <= likely).join(home[0], "a", "left").join(home[1], "b", "left")
        apart = F.coalesce("x", "a") != F.coalesce("y", "b")
        n, new = seen.agg(F.count("*"), F.count(F.when(apart, 1))).first()
        if new:
            edges = edges.unionByName(more)
            groups = connected(edges.select("a", "b"), "groups")
        if new <= (1 - recall) * n:
            break

    chosen = sets.select("set", "weight", "row").join(groups.select(F.col("node").alias("set"), F.col("root").alias("group")), "set")
    chosen = written(chosen, "chosen")
    if chosen.count() <= small:  # counted: else the texts are shuffled by row
        chosen = F.broadcast(chosen)
    texts = rows.select("row", "text").join(chosen, "row").dropDuplicates(["set"])  # equal rows share a row id
    coded = written(texts.mapInPandas(_sets_of, "set binary, group binary, weight long, codes binary"), "codes")
    pairs = _paired_blocks(coded, block_rows, block_bytes)
    keys = ["group", "block_a", "block_b"]
    dealt = pairs.repartition(partitions(spark), *keys).sortWithinPartitions(*keys)
    found = written(dealt.mapInPandas(_compare(threshold), "set binary, links long, root binary"), "links")
    drop_written(coded)

    links = found.groupBy("set").agg(F.sum("links").alias("links"))
    roots = connected(found.select(F.col("set").alias("a"), F.col("root").alias("b")), "classes")
    facts = sets.select("set", "weight").join(links, "set", "left").join(roots.withColumnRenamed("node", "set"), "set", "left")
    facts = written(facts.select("set", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "set").alias("class")), "facts")
    drop_written(found)
    # Keys by row, row by set, set by class: the least key of a class is a grouped minimum.
    member = of.join(facts, "set").select("row", "n_links", "class")
    keyed = written(rows.select("key", "row").join(member, "row", "left"), "keyed")
    least = written(keyed.where("class is not null").groupBy("class").agg(F.min("key").alias("least")), "least")
    out = keyed.join(least, "class", "left")
    class_id = F.coalesce("least", "key")
    return out.select(F.col("key").alias(key), class_id.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce(F.col("key") == class_id, class_id.isNull()).alias("kept"), "row", "class")
