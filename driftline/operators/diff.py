"""Differences between two periods: label sets, footnote multisets, numeric dictionaries."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.operators.matching import one_to_one


def label_diff(previous: DataFrame, current: DataFrame, by: list[str], key: str) -> DataFrame:
    """Full outer join on ``by`` and the label key: one row a label with ``op`` added, removed or kept.

    Both sides hold one row a key. The join and every later aggregate by ``by`` share one shuffle.
    """
    left, right = previous.withColumn("in_previous", F.lit(True)), current.withColumn("in_current", F.lit(True))
    joined = left.join(right, [*by, key], "full")
    op = F.when(F.col("in_previous").isNull(), "added").when(F.col("in_current").isNull(), "removed").otherwise("kept")
    return joined.withColumn("op", op).drop("in_previous", "in_current")


def change_counts(changes: DataFrame, by: list[str]) -> DataFrame:
    count = lambda op: F.count(F.when(F.col("op") == op, 1)).alias(f"n_{op}")
    return changes.groupBy(*by).agg(count("added"), count("removed"), count("kept"))


def _met_labels(changes: DataFrame, by: list[str], key: str, threshold: float) -> DataFrame:
    """Pairs of a removed and an added label of a group that may be alike, with the sizes of their token sets; some repeat.

    Pairs meet on four tokens of both prefixes: of the rarest tokens, of which one set of n needs n - ceil(t n) + 4 for no
    pair to be lost. One token alone would do with a shorter prefix, but where labels are made of a few words each, it is
    shared by a large part of the group. Sets so small or so large that four tokens are too many or have too many
    choices meet on one. Labels of a group are so never multiplied out; of a pair only the labels are shuffled.
    """
    tokens = F.array_distinct(F.filter(F.split(key, " "), lambda t: t != ""))
    rows = changes.where("op <> 'kept'").select(*by, "op", key, tokens.alias("tokens")).where(F.size("tokens") > 0)
    counts = rows.select(*by, F.explode("tokens").alias("token")).groupBy(*by, "token").agg(F.count("*").alias("n"))
    each = rows.select(*by, "op", key, F.size("tokens").alias("size"), F.explode("tokens").alias("token")).join(counts.hint("merge"), [*by, "token"])
    ordered = each.groupBy(*by, "op", key, "size").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("rare"))
    least = lambda n: math.ceil(n * threshold - 1e-9)
    fours = [n for n in range(1, 200) if least(n) >= 4 and n - least(n) <= 4]
    low, high = (fours[0], fours[-1]) if fours else (1, 0)
    # By their last place, so that the choices of a shorter prefix come first.
    choices = sorted(combinations(range(8), 4), key=lambda c: c[::-1])
    size, rare = F.col("size"), F.transform("rare", lambda x: x["token"])
    spare = size - F.ceil(size * F.lit(threshold) - 1e-9).cast("int")
    chosen = F.slice(F.array(*(F.array(*map(F.lit, c)) for c in choices)), F.lit(1), F.element_at(F.array(*(F.lit(math.comb(n + 4, 4)) for n in range(5))), F.least(spare, F.lit(4)) + 1))
    four = F.transform(chosen, lambda c: F.xxhash64(*(F.get(rare, F.get(c, F.lit(i))) for i in range(4))))
    single = F.transform(F.slice(rare, F.lit(1), spare + 1), lambda t: F.xxhash64(t))
    none = F.array().cast("array<bigint>")
    by_four = size.between(low, high)
    # A set of the middle sizes also meets those outside them that are near enough in size.
    by_one = ~by_four | (size <= (low - 1) / threshold + 1e-9) | (size >= (high + 1) * threshold - 1e-9)
    signs = F.concat(F.transform(F.when(by_four, four).otherwise(none), lambda h: F.struct(F.lit(True).alias("by_four"), h.alias("sign"))), F.transform(F.when(by_one, single).otherwise(none), lambda h: F.struct(F.lit(False).alias("by_four"), h.alias("sign"))))
    one = ordered.select(*by, "op", key, "size", by_four.alias("middle"), F.explode(signs).alias("s")).select(*by, "op", key, "size", "middle", "s.by_four", "s.sign")
    side = lambda op: one.where(F.col("op") == op).select(*by, "by_four", "sign", F.col(key).alias(op), F.col("size").alias(f"{op}_size"), F.col("middle").alias(f"{op}_middle"))
    a, b = F.col("removed_size"), F.col("added_size")
    fits = (F.least(a, b) >= F.greatest(a, b) * threshold - 1e-9) & (F.col("by_four") == (F.col("removed_middle") & F.col("added_middle")))
    # A written table of labels is a few MB of files and many times that as rows, so its size must not choose the joins.
    return side("removed").join(side("added").hint("merge"), [*by, "by_four", "sign"]).where(fits)


def rename_candidates(changes: DataFrame, by: list[str], key: str, threshold: float = 0.8) -> DataFrame:
    """Removed and added labels of a group whose token sets have at least that Jaccard similarity."""
    met = _met_labels(changes, by, key, threshold)
    a, b = F.col("removed_size"), F.col("added_size")
    shared = F.size(F.array_intersect(F.split("removed", " "), F.filter(F.split("added", " "), lambda t: t != "")))
    # A pair that meets more than once is scored each time, and only pairs that are alike are shuffled.
    scored = met.select(*by, "removed", "added", (shared / (a + b - shared)).alias("score"))
    return scored.where(F.col("score") >= threshold).dropDuplicates([*by, "removed", "added"])


def renames(candidates: DataFrame, by: list[str]) -> DataFrame:
    """One to one: removed labels in order each take the best label that is still free, the first of equals."""
    rows = candidates.withColumns({"block": F.to_json(F.struct(*by)), "left": F.col("removed"), "right": F.col("added")})
    # A removed label prefers the best score, an added one the first of the removed labels.
    first = -F.dense_rank().over(Window.partitionBy("block").orderBy("removed"))
    rows = rows.withColumn("first", first)
    return one_to_one(rows, [F.col("score")], [F.col("first")]).select(*by, "removed", "added", "score")


def without_renamed(changes: DataFrame, renamed: DataFrame, by: list[str], key: str) -> DataFrame:
    """Changes in which a renamed label is one row: op renamed under its new name, with the old one, and its score."""
    old = renamed.select(*by, F.col("removed").alias(key), F.lit("removed").alias("op"))
    new = renamed.select(*by, F.col("added").alias(key), F.lit("added").alias("op"))
    # Renames are about as many as labels: they are shuffled, never sent whole through the driver, however small their files look.
    rest = changes.join(old.unionByName(new).hint("merge"), [*by, key, "op"], "left_anti")
    none = F.lit(None)
    rows = rest.select(*by, key, "op", none.cast("string").alias("previous"), none.cast("double").alias("score"))
    return rows.unionByName(renamed.select(*by, F.col("added").alias(key), F.lit("renamed").alias("op"), F.col("removed").alias("previous"), "score"))


def footnote_diff(previous: DataFrame, current: DataFrame, by: list[str], note: str, text: str) -> DataFrame:
    """Footnotes ``(by, note, text)`` matched as a multiset: equal note and text first, then equal text; of what
    is left an equal note is modified, the rest added or removed. One row a footnote or pair with ``op``.

    Both sides are shuffled once, by ``by``; every step numbers the rows of a key that are still open on either side, and
    rows of one number are a pair. A null is equal to nothing.
    """
    side = lambda df, old: df.select(*by, note, text, F.lit(old).alias("_old"))
    rows = side(previous, True).unionByName(side(current, False)).repartition(*by).withColumn("_step", F.lit(0))
    is_old, seen = F.col("_old"), {"note": F.lit(None), "text": F.lit(None)}
    for step, keys in enumerate(([note, text], [text], [note]), 1):
        nth = F.row_number().over(Window.partitionBy(*by, *keys, "_step", "_old").orderBy(note, text))
        pair = Window.partitionBy(*by, *keys, "_step", "_nth")
        known = reduce(Column.__and__, [F.col(c).isNotNull() for c in (*by, *keys)])
        new = lambda c: F.max(F.when(~is_old, F.struct(c))).over(pair)[c]
        rows = rows.withColumn("_nth", nth).withColumns({"_both": known & (F.col("_step") == 0) & (F.min("_old").over(pair) != F.max("_old").over(pair)), f"_note{step}": new(note), f"_text{step}": new(text)})
        rows = rows.withColumn("_step", F.when(F.col("_both"), step).otherwise(F.col("_step"))).drop("_nth", "_both")
    for c in seen:
        seen[c] = F.when(F.col("_step") == 1, F.col(f"_{c}1")).when(F.col("_step") == 2, F.col(f"_{c}2")).when(F.col("_step") == 3, F.col(f"_{c}3")).when(~is_old, F.col({"note": note, "text": text}[c]))
    op = F.when(F.col("_step") == 3, "modified").when(F.col("_step") > 0, "same").when(is_old, "removed").otherwise("added")
    own = lambda c: F.when(is_old, F.col(c))
    # Of a pair the old row stands for both.
    return rows.where(is_old | (F.col("_step") == 0)).select(*by, op.alias("op"), own(note).alias("old_note"), seen["note"].alias("new_note"), own(text).alias("old_text"), seen["text"].alias("new_text"))


def numeric_delta(previous: Column, current: Column) -> Column:
    """Current minus previous, a missing side counting as zero."""
    return F.coalesce(current, F.lit(0)) - F.coalesce(previous, F.lit(0))


def without_noise(renamed: DataFrame, previous: str, current: str, key) -> DataFrame:
    """Renames that are still different under ``key``, a function of a column."""
    return renamed.where(key(F.col(previous)) != key(F.col(current)))
