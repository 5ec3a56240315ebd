"""One-to-one matching of two sides by scored candidate pairs ``(block, left, right, score)``."""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.operators.graph import connected
from driftline.sources.scratch import drop_written, written


def top_k(pairs: DataFrame, side: str, other: str, k: int) -> DataFrame:
    """Each row's best ``k`` candidates, ties by the other side's id; the rank is added as ``rank``."""
    w = Window.partitionBy("block", side).orderBy(F.desc("score"), other)
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mutual_best(pairs: DataFrame, minimum: float) -> DataFrame:
    """Pairs that are each other's best candidate with at least that score."""
    best_right = top_k(pairs, "left", "right", 1).drop("rank")
    best_left = top_k(pairs, "right", "left", 1).select("block", "left", "right")
    return best_right.join(best_left, ["block", "left", "right"]).where(F.col("score") >= minimum)


def clear_margin(pairs: DataFrame, margin: float) -> DataFrame:
    """Rows of the left side with their best score, the next one, and whether the lead is clear."""
    w = Window.partitionBy("block", "left").orderBy(F.desc("score"), "right")
    ranked = pairs.withColumns({"rank": F.row_number().over(w), "second": F.lead("score").over(w)}).where("rank = 1")
    second = F.coalesce("second", F.lit(0.0))
    return ranked.select("block", "left", "right", "score", second.alias("second"), (F.col("score") - second >= margin).alias("clear"))


def _settled(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pairs of one component taken as ``one_to_one`` does, by their places in the orders of both sides."""
    l, r = (np.unique(pdf[c], return_inverse=True)[1] for c in ("left", "right"))
    i, j = pdf["_i"].to_numpy(), pdf["_j"].to_numpy()
    open_, taken = np.arange(len(pdf)), []
    while len(open_):
        first_l, first_r = np.full(l.max() + 1, len(pdf) + 1), np.full(r.max() + 1, len(pdf) + 1)
        np.minimum.at(first_l, l[open_], i[open_])
        np.minimum.at(first_r, r[open_], j[open_])
        won = open_[(first_l[l[open_]] == i[open_]) & (first_r[r[open_]] == j[open_])]
        if not len(won):
            raise RuntimeError("the two orders run in a circle")
        taken.append(won)
        open_ = open_[~np.isin(l[open_], l[won]) & ~np.isin(r[open_], r[won])]
    return pdf.iloc[np.concatenate(taken)].drop(columns=["root", "_i", "_j"])


def one_to_one(pairs: DataFrame, best: list[Column], right_best: list[Column] | None = None, rounds: int = 6, task_pairs: int = 2_000_000, block_pairs: int = 100_000) -> DataFrame:
    """Pairs ``(block, left, right, ...)`` taken best first, each row of either side once, in rounds over all blocks.

    ``best`` are columns by which a larger value is better; ties go to the lesser left, then right id. A pair that is
    the best left for both its rows is taken, its rows' other pairs go, and so on until none is left: the same pairs
    as from one sorted list, with no block in one task. With ``right_best`` the right side has an order of its own; the
    two orders must not run in a circle. Blocks of at most ``block_pairs`` pairs are settled each in a task from the start;
    the others go in rounds. After ``rounds`` rounds little is left of most tables, but a chain of preferences
    may go on for as many as it has pairs: connected components of at most ``task_pairs`` pairs are then settled each in
    a task, and larger ones go on in rounds.
    """
    ranked = pairs.withColumn("_l", F.struct(*(c.alias(f"b{i}") for i, c in enumerate(best))))
    ranked = ranked.withColumn("_r", F.struct(*(c.alias(f"b{i}") for i, c in enumerate(right_best))) if right_best else F.col("_l"))
    every, n = written(ranked, "pairs"), 0
    order = lambda by, key: Window.partitionBy(*by).orderBy(F.desc(key), "left", "right")

    def settled(rows: DataFrame, by: str) -> DataFrame:
        ordered = rows.withColumns({"_i": F.row_number().over(order([by], "_l")), "_j": F.row_number().over(order([by], "_r"))})
        return written(ordered.select(*pairs.columns, F.col(by).alias("root"), "_i", "_j").groupBy("root").applyInPandas(_settled, pairs.schema), "won")

    counts = written(every.groupBy("block").agg(F.count("*").alias("n")), "counts")
    of = lambda cond: every.join(counts.where(cond).select("block"), "block", "left_semi").select(ranked.columns)
    most = min(block_pairs, task_pairs)
    taken = [settled(of(F.col("n") <= most), "block")]
    left = written(of(F.col("n") > most), "pairs")
    drop_written(every)
    while not left.isEmpty():
        n += 1
        if n == rounds + 1:
            node = lambda side: F.xxhash64("block", F.lit(side), side)
            named = written(left.withColumns({"_a": node("left"), "_b": node("right")}), "pairs")
            home = connected(named.select(F.col("_a").alias("a"), F.col("_b").alias("b"))).select(F.col("node").alias("_a"), "root")
            placed = written(named.join(home, "_a").drop("_a", "_b"), "placed")
            sizes = placed.groupBy("root").agg(F.count("*").alias("n"))
            taken.append(settled(placed.join(sizes.where(F.col("n") <= task_pairs), "root", "left_semi"), "root"))
            left = written(placed.join(sizes.where(F.col("n") > task_pairs), "root", "left_semi").select(ranked.columns), "pairs")
            continue
        won = left.withColumns({"_i": F.row_number().over(order(["block", "left"], "_l")), "_j": F.row_number().over(order(["block", "right"], "_r"))}).where("_i = 1 and _j = 1").drop("_i", "_j")
        won = written(won, "won")
        if n > rounds and won.isEmpty():
            raise RuntimeError("the two orders run in a circle")
        taken.append(won.drop("_l", "_r"))
        # What is written looks smaller than it is, so its size must not decide that all of it goes through the driver.
        gone = lambda side: won.select("block", side).hint("merge")
        rest = left.join(gone("left"), ["block", "left"], "left_anti").join(gone("right"), ["block", "right"], "left_anti")
        rest = written(rest, "pairs")
        drop_written(left)
        left = rest
    return reduce(DataFrame.unionByName, taken)


def greedy(pairs: DataFrame, minimum: float) -> DataFrame:
    """Highest score first (ties by ids), each row used once."""
    return one_to_one(pairs.where(F.col("score") >= minimum), [F.col("score")]).select(pairs.columns)


def _assign(n: int, left: np.ndarray, right: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Which of the scored pairs an assignment of highest total takes, by shortest augmenting paths along the pairs alone.

    A left row may stay free at no gain. ``n`` counts the left rows; both sides are numbered from 0. The work goes with the
    pairs that paths touch, and what is held with their number, never with the product of the sides.
    """
    order = np.argsort(left, kind="stable")
    starts = np.searchsorted(left[order], np.arange(n + 1))
    to, cost = right[order].tolist(), (-score[order]).tolist()
    m = int(right.max()) + 1 if len(right) else 0
    # Behind the right rows stand n places of no cost, one for each left row.
    price, owner, taken = [0.0] * (m + n), [-1] * (m + n), [-1] * n
    for row in range(n):
        best, via, done, heap = {}, {}, set(), []
        # Lengths count from the free row; a matched row is reached at the length of the place that it holds.
        at, base = row, 0.0
        while True:
            own = taken[at]
            shift = (0.0 if own < 0 else -(cost[own] if own < len(cost) else 0.0) + price[to[own] if own < len(cost) else m + at]) + base
            for e in (*range(starts[at], starts[at + 1]), len(cost) + at):
                place, c = (to[e], cost[e]) if e < len(cost) else (m + at, 0.0)
                length = shift + c - price[place]
                if place not in done and length < best.get(place, np.inf) - 1e-15:
                    best[place], via[place] = length, (at, e)
                    heapq.heappush(heap, (length, place))
            while True:
                length, place = heapq.heappop(heap)
                if place not in done and length == best[place]:
                    break
            done.add(place)
            if owner[place] < 0:
                break
            at, base = owner[place], length
        for p in done:
            price[p] -= length - best[p]
        while True:
            at, e = via[place]
            before = taken[at]
            owner[place], taken[at] = at, e
            if at == row:
                break
            place = to[before] if before < len(cost) else m + at
    chosen = np.zeros(len(score), bool)
    chosen[order[[e for e in taken if 0 <= e < len(cost)]]] = True
    return chosen


def _decided(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs that some best assignment holds for certain, and the pairs of rows that are left.

    A pair that scores at least as much as the best other pairs of both its rows together can replace them in any
    assignment. Of such pairs that share a row the first is taken.
    """
    w = lambda side: Window.partitionBy("block", side).orderBy(F.desc("score"), "left", "right")
    other = lambda side, id_: F.coalesce(F.when(F.row_number().over(w(side)) == 1, F.lead("score").over(w(side))).otherwise(F.first("score").over(w(side))), F.lit(0.0))
    sure = edges.withColumns({"_a": other("left", "right"), "_b": other("right", "left")}).where(F.col("score") >= F.col("_a") + F.col("_b")).drop("_a", "_b")
    won = sure.withColumns({"_i": F.row_number().over(w("left")), "_j": F.row_number().over(w("right"))}).where("_i = 1 and _j = 1").drop("_i", "_j")
    won = written(won, "won")
    rest = edges.join(won.select("block", "left"), ["block", "left"], "left_anti").join(won.select("block", "right"), ["block", "right"], "left_anti")
    return won, written(rest, "edges")


def auction(edges: DataFrame, digits: int = 6, step: int = 8) -> DataFrame:
    """The pairs of ``edges(a, b, score)`` that an assignment of highest total takes, in rounds of bids, for graphs of any size.

    Every row without a place bids for the one that is worth most to it after its price, by as much as it is worth more than
    the next best and a little more; the highest bid takes the place and sets its price. A row may stay free: it then has
    a place of its own, and the row on the other side that stays free has one too, so all rows find a place and prices may
    start anywhere. The little more is made smaller in phases until it is less than a unit of the last digit shared by all
    rows; the total is then the highest for scores of so many digits. A round is a join and two grouped maxima over the
    rows that have no place; no task holds more than the pairs of one row.
    """
    spark = edges.sparkSession
    known = written(edges.select(F.struct(F.lit(0).alias("s"), F.col("a").alias("id")).alias("a"), F.struct(F.lit(1).alias("s"), F.col("b").alias("id")).alias("b"), F.round(F.col("score") * 10**digits).cast("long").alias("gain")), "pairs")
    sides = known.select(F.countDistinct("a").alias("n"), F.countDistinct("b").alias("m"), F.max("gain").alias("most")).first()
    unit = sides["n"] + sides["m"] + 1
    none = F.lit(0).cast("long")
    both = [known.select("a", "b", (F.col("gain") * unit).alias("gain")), known.select(F.col("b").alias("a"), F.col("a").alias("b"), none.alias("gain")), known.select("a", F.col("a").alias("b"), none.alias("gain")).distinct(), known.select(F.col("b").alias("a"), "b", none.alias("gain")).distinct()]
    wanted = written(reduce(DataFrame.unionByName, both).withColumnRenamed("a", "person").withColumnRenamed("b", "place"), "wanted")
    people = written(wanted.select("person").distinct(), "people")
    kind = wanted.schema["place"].dataType
    state = written(spark.createDataFrame([], T.StructType([T.StructField("place", kind), T.StructField("price", T.LongType()), T.StructField("owner", kind)])), "state")
    more = max(1, sides["most"] * unit // 4)
    while True:
        while True:
            free = people.join(state.select(F.col("owner").alias("person")), "person", "left_anti")
            asked = wanted.join(free, "person", "left_semi").join(state.select("place", "price"), "place", "left").withColumn("worth", F.col("gain") - F.coalesce("price", none))
            w = Window.partitionBy("person").orderBy(F.desc("worth"), "place")
            top = asked.withColumn("rank", F.row_number().over(w)).where("rank <= 2")
            bids = top.groupBy("person").agg(F.max(F.when(F.col("rank") == 1, F.struct("place", "gain"))).alias("first"), F.max(F.when(F.col("rank") == 2, F.col("worth"))).alias("next"))
            bids = bids.select("person", "first.place", (F.col("first.gain") - F.col("next") + more).alias("bid"))
            won = bids.groupBy("place").agg(F.max(F.struct("bid", "person")).alias("w")).select("place", "w.bid", "w.person")
            after = state.join(won, "place", "full").select("place", F.coalesce("bid", "price").alias("price"), F.coalesce("person", "owner").alias("owner"))
            after = written(after, "state")
            drop_written(state)
            state = after
            if state.where("owner is not null").count() == unit - 1:
                break
        if more == 1:
            break
        more = max(1, more // step)
        state = written(state.withColumn("owner", F.lit(None).cast(kind)), "state")
    return state.where("owner.s = 0 and place.s = 1").select(F.col("owner.id").alias("a"), F.col("place.id").alias("b"))


def optimal(pairs: DataFrame, minimum: float, task_pairs: int = 2_000_000) -> DataFrame:
    """The assignment of highest total score; a row stays unmatched rather than take a pair below ``minimum``.

    Pairs that are certain are taken first, which also parts what is left. Rows that no chain of pairs connects are then
    matched independently: a connected component of at most ``task_pairs`` pairs by paths in one task, a larger one by
    an auction in rounds over all of Spark (exact for scores of six digits).
    """
    node = lambda side: F.xxhash64("block", F.lit(side), side)
    left, taken = written(pairs.where(F.col("score") >= minimum), "edges"), []
    for _ in range(6):
        won, rest = _decided(left)
        drop_written(left)
        taken, left = [*taken, won], rest
        if left.isEmpty() or won.isEmpty():
            break
    good = left.withColumns({"_a": node("left"), "_b": node("right")})
    home = connected(good.select(F.col("_a").alias("a"), F.col("_b").alias("b"))).select(F.col("node").alias("_a"), "root")
    placed = written(good.join(home, "_a"), "placed")
    sizes = placed.groupBy("root").agg(F.count("*").alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, r = np.unique(pdf["left"], return_inverse=True)
        _, c = np.unique(pdf["right"], return_inverse=True)
        return pdf[_assign(len(rows), r, c, pdf["score"].to_numpy(float))]

    small = placed.join(sizes.where(F.col("n") <= task_pairs), "root", "left_semi").select(*pairs.columns, "root")
    found = small.groupBy("root").applyInPandas(lambda pdf: run(pdf).drop(columns="root"), pairs.schema)
    large = placed.join(sizes.where(F.col("n") > task_pairs), "root", "left_semi")
    if not large.isEmpty():
        large = written(large, "large")
        chosen = auction(large.select(F.col("_a").alias("a"), F.col("_b").alias("b"), "score"))
        found = found.unionByName(large.join(chosen.select(F.col("a").alias("_a"), F.col("b").alias("_b")), ["_a", "_b"]).select(pairs.columns))
    return reduce(DataFrame.unionByName, [t.select(pairs.columns) for t in taken], found)


def unmatched(rows: DataFrame, matched: DataFrame, side: str) -> DataFrame:
    """Rows of a side (``block``, ``side``) in no pair."""
    return rows.join(matched.select("block", side), ["block", side], "left_anti")


#: Tiles of a side beyond which a block's tiles meet as a Cartesian product, which reads them again, copying none.
JOINED_TILES = 2
#: Blocks up to which their counts are broadcast.
FEW_BLOCKS = 10_000
#: Bytes of text that count as one row of a tile.
ROW_BYTES = 8192


def _tiles(rows: DataFrame, pack, load: Column, size: int) -> DataFrame:
    """Rows ``(block, side, chunk, ...)`` dealt to tiles of about ``size``, one row a tile: its chunks and packed values.

    ``load`` is what a row counts for besides one. Blocks of one side are left out; ``large`` ones have more than
    ``JOINED_TILES`` tiles on a side.
    """
    kind = rows.schema["block"].dataType.simpleString(), rows.schema["chunk"].dataType.simpleString()
    of = lambda s, c: F.when(F.col("side") == s, c)
    n = lambda s: F.ceil(F.greatest(F.count(of(s, 1)), F.coalesce(F.sum(of(s, load)), F.lit(0))) / F.lit(size)).cast("int").alias(s)
    counts = rows.groupBy("block").agg(n("previous"), n("current")).where("previous > 0 and current > 0")
    own = F.when(F.col("side") == "previous", F.col("previous")).otherwise(F.col("current"))
    counts = written(counts, "blocks")
    # A row a block: broadcast, as long as there are few, so that the rows are shuffled once, to their tiles.
    counts = F.broadcast(counts) if counts.count() <= FEW_BLOCKS else counts.hint("merge")
    dealt = rows.join(counts, "block").withColumns({"_t": F.pmod(F.xxhash64("chunk"), own).cast("int"), "large": F.greatest("previous", "current") > JOINED_TILES}).drop("previous", "current")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        return pd.DataFrame({"block": [first["block"]], "side": [first["side"]], "large": [first["large"]], "chunks": [pdf["chunk"].to_numpy()], "data": [[x.tobytes() for x in pack(pdf)]]})

    packed = dealt.groupBy("block", "side", "_t").applyInPandas(run, f"block {kind[0]}, side string, large boolean, chunks array<{kind[1]}>, data array<binary>")
    return written(packed, "tiles")


def _met_tiles(tiles: DataFrame) -> DataFrame:
    """Every previous tile with every current one of its block. No tile is copied for each of the others: tiles of small
    blocks are joined, those of large ones read again by each task of the product."""
    of = lambda s: tiles.where(F.col("side") == s).select("block", "large", F.col("chunks").alias(f"{s}_chunks"), F.col("data").alias(f"{s}_data"))
    left, right = of("previous"), of("current")
    joined = left.where("not large").drop("large").join(right.where("not large").drop("large"), "block")
    sizes = {r["side"]: r["n"] for r in tiles.where("large").groupBy("side").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return joined
    # Each part of a side is read again for each part of the other, so parts are as large as a task may hold.
    dealt = lambda df, s: df.where("large").drop("large").repartition(min(sizes[s], max(12, sizes[s] // 128)))
    left, right = dealt(left, "previous"), dealt(right, "current").withColumnRenamed("block", "_block")
    # Said as two comparisons, so that it is no key to shuffle a whole block by.
    product = left.join(right.hint("shuffle_replicate_nl"), (F.col("block") <= F.col("_block")) & (F.col("block") >= F.col("_block")))
    return joined.unionByName(product.drop("_block"))


def _tile_pairs(matrix, minimum: float, best: int = 3):
    """Pairs of two tiles with at least ``minimum`` or below 0, and of every row its ``best`` of a positive score."""

    def pairs(block, left, left_data, right, right_data) -> pd.DataFrame:
        score = matrix(left_data, len(left), right_data, len(right))
        keep = (score >= minimum) | (score < 0)
        for axis, size in ((1, len(right)), (0, len(left))) if best else ():
            # With those so near the last of them that rounded scores may be equal.
            n = size - min(best, size)
            keep |= score >= np.take(np.partition(score, n, axis=axis), [n], axis=axis) - 1e-4
        a, b = np.nonzero(keep & (score != 0))
        return pd.DataFrame({"block": block, "left": np.asarray(left)[a], "right": np.asarray(right)[b], "score": score[a, b].astype(np.float64)})

    def run(batches):
        for pdf in batches:
            for t in pdf.itertuples():
                yield pairs(t.block, t.previous_chunks, t.previous_data, t.current_chunks, t.current_data)

    return run


def _tile_firsts(matrix, minimum: float, digits: int):
    """Of every row of both sides the first pair by rounded score and the other side's id that a task meets, if it has at
    least ``minimum``. A task holds one pair a row, whatever the number of tiles that it compares."""

    def better(known: dict, tile: tuple, own: np.ndarray, score: np.ndarray, other: np.ndarray) -> None:
        if tile not in known:
            known[tile] = (own, score.copy(), other.copy())
            return
        _, s, o = known[tile]
        wins = (score > s) | ((score == s) & (other < o))
        s[wins], o[wins] = score[wins], other[wins]

    def run(batches):
        lefts, rights = {}, {}
        for pdf in batches:
            for t in pdf.itertuples():
                left, right = np.asarray(t.previous_chunks), np.asarray(t.current_chunks)
                score = matrix(t.previous_data, len(left), t.current_data, len(right))
                np.floor(score * 10**digits + 0.5, out=score)
                score /= 10**digits
                for known, own, other, s in ((lefts, left, right, score), (rights, right, left, score.T)):
                    order = np.argsort(other, kind="stable")
                    top = s[:, order].argmax(axis=1)
                    better(known, (t.block, own[0]), own, s[np.arange(len(own)), order[top]], other[order[top]])
        for known, names in ((lefts, ("left", "right")), (rights, ("right", "left"))):
            for (block, _), (own, score, other) in known.items():
                kept = (score >= minimum) & (score > 0)
                yield pd.DataFrame({"block": block, names[0]: own[kept], names[1]: other[kept], "score": score[kept]})[["block", "left", "right", "score"]]

    return run


def _pairs_of(rows: DataFrame, pack, load: Column, matrix, minimum: float, tile: int, best: int = 3, digits: int | None = None) -> DataFrame:
    kind = lambda c: rows.schema[c].dataType.simpleString()
    schema = f"block {kind('block')}, left {kind('chunk')}, right {kind('chunk')}, score double"
    met = _met_tiles(_tiles(rows, pack, load, tile)).select("block", "previous_chunks", "previous_data", "current_chunks", "current_data")
    return met.mapInPandas(_tile_pairs(matrix, minimum, best) if digits is None else _tile_firsts(matrix, minimum, digits), schema)


def _places(n: int) -> type:
    """What the places of ``n`` rows are packed as."""
    return np.uint16 if n <= 1 << 16 else np.int32


def _by_word(side: pd.DataFrame) -> list[np.ndarray]:
    """Distinct words in order, how many rows have each, these rows and their weights, and the words of each row."""
    sizes = np.array([len(x) for x in side["words"]], np.int32)
    words, rows = np.concatenate([np.asarray(x, np.int64) for x in side["words"]]), np.repeat(np.arange(len(side), dtype=np.int32), sizes)
    order = np.argsort(words, kind="stable")
    own, n = np.unique(words, return_counts=True)
    weights = np.concatenate([np.asarray(x, np.float64) for x in side["weights"]])[order] if "weights" in side else np.empty(0)
    return [own, n.astype(np.int32), rows[order].astype(_places(len(side))), weights, sizes]


def _ranges(starts: np.ndarray, times: np.ndarray) -> np.ndarray:
    """``starts`` counted on for ``times``, one behind the other."""
    return np.arange(times.sum()) + np.repeat(starts - (np.cumsum(times) - times), times)


def _products(left: list[bytes], n_left: int, right: list[bytes], n_right: int, kind=np.float64) -> np.ndarray:
    """Products of sparse vectors: rare words pair by pair, frequent ones as matrices over ranges of words."""
    sides, found = [], [np.frombuffer(d[0], np.int64) for d in (left, right)]
    _, *places = np.intersect1d(*found, assume_unique=True, return_indices=True)
    for d, at, size in zip((left, right), places, (n_left, n_right)):
        n = np.frombuffer(d[1], np.int32).astype(np.int64)
        v = np.frombuffer(d[3], np.float64)
        sides.append((np.frombuffer(d[2], _places(size)).astype(np.int32), v if len(v) else None, (np.cumsum(n) - n)[at], n[at]))
    (ra, va, sa, na), (rb, vb, sb, nb) = sides
    out = np.zeros(n_left * n_right, kind)
    rare = na * nb <= 1024
    of = np.flatnonzero(rare)
    # So many words at a time that their pairs stay bounded.
    for part in np.split(of, np.flatnonzero(np.diff(np.cumsum(na[of] * nb[of]) >> 22)) + 1) if len(of) else ():
        i = _ranges(sa[part], na[part])
        times = np.repeat(nb[part], na[part])
        j = _ranges(np.repeat(sb[part], na[part]), times)
        i = np.repeat(i, times)
        out += np.bincount(ra[i].astype(np.int64) * n_right + rb[j], None if va is None else va[i] * vb[j], len(out)).astype(kind, copy=False)
    out = out.reshape(n_left, n_right)
    often = np.flatnonzero(~rare)
    for at in range(0, len(often), 4096):
        part, dense = often[at : at + 4096], []
        for r, v, starts, n, size in ((ra, va, sa, na, n_left), (rb, vb, sb, nb, n_right)):
            hit = _ranges(starts[part], n[part])
            m = np.zeros((size, len(part)), kind)
            m[r[hit], np.repeat(np.arange(len(part)), n[part])] = 1 if v is None else v[hit]
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out


def _sparse(*sides) -> np.ndarray:
    return np.minimum(_products(*sides), 1.0)


def _overlaps(left: list[bytes], n_left: int, right: list[bytes], n_right: int) -> np.ndarray:
    """Jaccard similarity of word sets, below 0 where one text may hold the other, its first and last word cut perhaps:
    where half of the smaller set and all but two of it are shared. Counts are exact in single precision."""
    both = _products(left, n_left, right, n_right, np.float32)
    a, b = (np.frombuffer(d[4], np.int32).astype(np.float32) for d in (left, right))
    least = np.minimum(a[:, None], b[None, :])
    held = (both >= np.maximum(0.5 * least, least - 2)) & (both > 0)
    out = both / np.maximum(a[:, None].astype(np.float64) + b[None, :] - both, 1.0)
    return np.where(held, -out, out)


def _with_keys(side: pd.DataFrame) -> list[np.ndarray]:
    """As ``_by_word``, and the keys of the rows one behind the other with their sizes."""
    keys = [x.encode() for x in side["key"]]
    return [*_by_word(side), np.frombuffer(b"".join(keys), np.uint8), np.array([len(k) for k in keys], np.int64)]


def _held_or_overlaps(left: list[bytes], n_left: int, right: list[bytes], n_right: int) -> np.ndarray:
    """Jaccard similarity of word sets, 1 where the key of one text holds that of the other. A text without a key holds none.

    The keys lie in the tiles, so no text is written or sent for a pair, however many pairs may hold each other.
    """
    out = _overlaps(left, n_left, right, n_right)
    sides = []
    for d in (left, right):
        ends = np.cumsum(np.frombuffer(d[6], np.int64))
        sides.append([d[5][a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())])
    a, b = sides
    i, j = np.nonzero(out < 0)
    held = np.fromiter((bool(x and y) and (y in x if len(x) >= len(y) else x in y) for x, y in ((a[k], b[m]) for k, m in zip(i.tolist(), j.tolist()))), bool, len(i))
    out[i, j] = np.where(held, 1.0, -out[i, j])
    return out


def _stacked(side: pd.DataFrame) -> list[np.ndarray]:
    return [np.stack(side["vector"].to_numpy()).astype(np.float64)]


def _plain(left: list[bytes], n_left: int, right: list[bytes], n_right: int) -> np.ndarray:
    return np.frombuffer(left[0]).reshape(n_left, -1) @ np.frombuffer(right[0]).reshape(n_right, -1).T


def _dense(left: list[bytes], n_left: int, right: list[bytes], n_right: int) -> np.ndarray:
    def unit(data: bytes, n: int) -> np.ndarray:
        x = np.frombuffer(data).reshape(n, -1)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

    return np.clip(unit(left[0], n_left) @ unit(right[0], n_right).T, 0.0, 1.0)


def _ragged(side: pd.DataFrame) -> list[np.ndarray]:
    """Sizes of vectors, -1 for none, and their components one behind the other."""
    known = [x for x in side["vector"] if x is not None]
    return [np.array([-1 if x is None else len(x) for x in side["vector"]], np.int32), np.concatenate([np.empty(0), *known]).astype(np.float64)]


def _cosines(left: list[bytes], n_left: int, right: list[bytes], n_right: int) -> np.ndarray:
    """As ``similarity.cosine`` clamped to 0 and 1: 0 where a side is none or zero or the sizes differ."""
    sizes = [np.frombuffer(d[0], np.int32) for d in (left, right)]
    width, sides = max(1, *(int(n.max()) for n in sizes)), []
    for d, n in zip((left, right), sizes):
        m = np.zeros((len(n), width))
        m[np.arange(width) < n[:, None]] = np.frombuffer(d[1])
        sides.append(m)
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        norm = np.sqrt((sides[0] ** 2).sum(axis=1))[:, None] * np.sqrt((sides[1] ** 2).sum(axis=1))
        score = sides[0] @ sides[1].T / norm
        # A value that is no number is above all others for the engine, so the upper bound replaces it.
        score = np.where(np.isnan(score), 1.0, np.clip(score, 0.0, 1.0))
    return np.where((sizes[0][:, None] == sizes[1]) & (norm != 0), score, 0.0)


def _tile_top(matrix, k: int, digits: int):
    """Of every previous row the first ``k`` current ones that a task meets, by rounded score and id; itself not counted."""

    def run(batches):
        known: dict = {}
        for pdf in batches:
            for t in pdf.itertuples():
                left, right = np.asarray(t.previous_chunks), np.asarray(t.current_chunks)
                score = np.floor(matrix(t.previous_data, len(left), t.current_data, len(right)) * 10**digits + 0.5).astype(np.int64)
                order = np.argsort(right)
                right, score = right[order], score[:, order]
                score[left[:, None] == right] = -1
                n = min(k, len(right))
                # Score and place as one number, so that none are equal and ties go to the lesser id.
                top = np.argpartition(-score * len(right) + np.arange(len(right)), n - 1, axis=1)[:, :n]
                score, other = np.take_along_axis(score, top, axis=1), right[top]
                tile = (t.block, left[0])
                if tile in known:
                    score, other = np.hstack([known[tile][1], score]), np.hstack([known[tile][2], other])
                    first = np.lexsort((other, -score), axis=1)[:, :k]
                    score, other = np.take_along_axis(score, first, axis=1), np.take_along_axis(other, first, axis=1)
                known[tile] = left, score, other
        for (block, _), (left, score, other) in known.items():
            kept = score >= 0
            yield pd.DataFrame({"block": block, "left": np.repeat(left, score.shape[1])[kept.ravel()], "right": other[kept], "score": score[kept] / 10**digits})

    return run


def nearest(queries: DataFrame, rows: DataFrame, k: int, digits: int = 6, tile: int = 1024) -> DataFrame:
    """The ``k`` rows of its block nearest to each query by clamped, rounded cosine: ``(block, left, right, score, rank)``.

    Both are ``(block, chunk, vector)`` with numbers as ids; ties go to the lesser id, and a query is none of its own rows.
    The scores are products of tiles; a task returns ``k`` rows a query, not every pair.
    """
    whole = lambda v: F.when(~F.exists(v, lambda x: x.isNull()), v.cast("array<double>"))
    side = lambda df, name: df.where("block is not null").select("block", F.lit(name).alias("side"), "chunk", whole(F.col("vector")).alias("vector"))
    both = side(queries, "previous").unionByName(side(rows, "current"))
    kind = lambda c: both.schema[c].dataType.simpleString()
    met = _met_tiles(_tiles(both, _ragged, F.coalesce(F.size("vector"), F.lit(0)) / 512, tile)).select("block", "previous_chunks", "previous_data", "current_chunks", "current_data")
    found = met.mapInPandas(_tile_top(_cosines, k, digits), f"block {kind('block')}, left {kind('chunk')}, right {kind('chunk')}, score double")
    return top_k(found, "left", "right", k)


def product_pairs(rows: DataFrame, minimum: float, tile: int = 1024, best: int = 3) -> DataFrame:
    """Products of previous with current vectors as they are: all of at least ``minimum`` and the best few of every row."""
    return _pairs_of(rows.where("vector is not null"), _stacked, F.size("vector") / 512, _plain, minimum, tile, best)


def vector_pairs(rows: DataFrame, minimum: float, tile: int = 1024, best: int = 3) -> DataFrame:
    """Cosines of previous with current rows ``(block, side, chunk, vector)`` of a block: all of at least ``minimum``, and
    the ``best`` of every row. Rows without a vector are left out."""
    return _pairs_of(rows.where("vector is not null"), _stacked, F.size("vector") / 512, _dense, minimum, tile, best)


def overlap_pairs(rows: DataFrame, minimum: float, tile: int = 1024) -> DataFrame:
    """Pairs of previous and current rows ``(block, side, chunk, words)``, distinct hashes of words, whose sets overlap by
    ``minimum`` or of which one may hold the other (``held``); whether it does is for the caller to work out.

    Where rows have a ``key``, their text without its spaces and signs, it is worked out, ``(block, left, right, score)``: the score
    is 1 where one key holds the other. A held text shares half of its words, its first and last one perhaps apart.
    """
    if "key" in rows.columns:
        load = F.greatest(F.size("words") / 512, F.octet_length("key") / ROW_BYTES)
        rows = rows.withColumn("key", F.coalesce("key", F.lit("")))
        return _pairs_of(rows.where(F.size("words") > 0), _with_keys, load, _held_or_overlaps, minimum, tile, 0)
    found = _pairs_of(rows.where(F.size("words") > 0), _by_word, F.size("words") / 512, _overlaps, minimum, tile, 0)
    return found.select("block", "left", "right", F.abs("score").alias("score"), (F.col("score") < 0).alias("held"))


def tfidf_pairs(chunks: DataFrame, block: str, chunk: str, side: str, tokens: str, minimum: float = 0.0, tile: int = 1024, best: int = 3, digits: int | None = None) -> DataFrame:
    """TF-IDF cosine of a previous and a current chunk inside a block: all pairs of at least ``minimum`` that share a token,
    and the ``best`` of every chunk whatever their score. With ``digits`` scores are rounded to as many, and only the first
    pair of every chunk is returned (once or more), by score and the other's id: all that ``mutual_best`` asks for.

    Smooth idf over the chunks of both sides, ``ln((1 + n) / (1 + df)) + 1``, and L2 norms. The counts are grouped
    sums; the products are those of matrices, tile by tile, so a frequent token is no hot key and nothing is written
    for each pair and token.
    """
    one = chunks.select(F.col(block).alias("block"), F.col(side).alias("side"), F.col(chunk).alias("chunk"), F.explode(tokens).alias("token"))
    tf = written(one.groupBy("block", "side", "chunk", F.xxhash64("token").alias("token")).agg(F.count("*").alias("tf")), "terms")
    has = lambda s: F.max(F.when(F.col("side") == s, 1).otherwise(0))
    df = tf.groupBy("block", "token").agg(F.count("*").alias("df"), (has("previous") + has("current") == 2).alias("met"))
    n = chunks.groupBy(F.col(block).alias("block")).agg(F.count("*").alias("n"))
    weighted = tf.join(df, ["block", "token"]).join(n, "block").withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    rows = weighted.groupBy("block", "side", "chunk").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_list(F.when(F.col("met"), F.struct("token", "w"))).alias("terms"))
    # Words that one side alone has count for the norms, and meet nothing.
    rows = rows.select("block", "side", "chunk", F.transform("terms", lambda t: t["token"]).alias("words"), F.transform("terms", lambda t: t["w"] / F.col("norm")).alias("weights"))
    return _pairs_of(rows.where(F.size("words") > 0), _by_word, F.size("words") / 512, _sparse, minimum, tile, best, digits)
