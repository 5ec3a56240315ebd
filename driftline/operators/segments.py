"""Segments of a converted report put together again where a sentence was cut: at the next segment, or beyond what lies between.

Segments are rows ``(by, position, kind, text, page, ...)`` with positions counted from 0 in each report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.text import blank
from driftline.operators.chunks import boundary
from driftline.sources.scratch import drop_written, written

#: Fixed value: how many segments behind one its continuation is looked for.
WINDOW = 12
SEGMENT = "struct<position: int, kind: string, text: string, page: int, hard: boolean, parts: array<int>>"


def _near(a: Column, b: Column) -> Column:
    """Whether two pages are the same or next to each other; an unknown page is near any."""
    return F.coalesce(F.abs(a - b) <= 1, F.lit(True))


def joined_text(a: Column, b: Column) -> Column:
    return F.concat(F.rtrim(a), F.lit(" "), F.ltrim(b))


def deduplicated(segments: DataFrame, by: list[str], key: Column) -> DataFrame:
    """Without paragraphs and list items whose key is not empty and that of the segment right before, of the same kind.

    ``is_duplicate`` rows are left out; what they repeat may itself be a repeat.
    """
    w = Window.partitionBy(*by).orderBy("position")
    rows = segments.withColumn("_key", key)
    again = F.col("kind").isin("paragraph", "list_item") & (F.col("_key") != "") & (F.col("kind") == F.lag("kind").over(w)) & (F.col("_key") == F.lag("_key").over(w))
    return rows.withColumn("_again", F.coalesce(again, F.lit(False))).where("not _again").drop("_key", "_again")


def repaired(segments: DataFrame, by: list[str], decisions: DataFrame | None = None) -> DataFrame:
    """Segments with those joined to the one before them that plainly go on in it: ``position`` of the first, ``parts`` of all.

    Of ambiguous boundaries ``decisions`` ``(by, position)`` name the segments that a reviewer joins to the one before;
    others stay apart. More than a page between two segments parts them. The segments of a report are worked in order,
    since what was joined is what the next one is held against.
    """
    rows = segments
    if decisions is not None:
        rows = rows.join(decisions.select(*by, "position").distinct().withColumn("_joined", F.lit(True)), [*by, "position"], "left")
    said = F.coalesce("_joined", F.lit(False)) if decisions is not None else F.lit(False)
    one = F.struct(F.col("position").cast("int").alias("position"), "kind", blank(F.col("text")).alias("text"), F.col("page").cast("int").alias("page"), F.lit(False).alias("hard"), F.array(F.col("position").cast("int")).alias("parts"), said.alias("said"))
    found = rows.groupBy(*by).agg(F.array_sort(F.collect_list(one)).alias("s"))

    def step(done: Column, b: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        current = F.struct(b["kind"].alias("kind"), b["text"].alias("text"), (~_near(last["page"], b["page"])).alias("hard"))
        rule = boundary(last, current)["disposition"]
        into = F.coalesce(last.isNotNull() & ((rule == "merge") | ((rule == "ambiguous") & b["said"])), F.lit(False))
        both = F.struct(last["position"], last["kind"], joined_text(last["text"], b["text"]), last["page"], last["hard"], F.concat(last["parts"], b["parts"])).cast(SEGMENT)
        alone = F.struct(b["position"], b["kind"], b["text"], b["page"], b["hard"], b["parts"]).cast(SEGMENT)
        return F.when(into, F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(both))).otherwise(F.concat(done, F.array(alone)))

    folded = F.aggregate("s", F.array().cast(f"array<{SEGMENT}>"), step)
    return found.select(*by, F.explode(folded).alias("r")).select(*by, "r.position", "r.kind", "r.text", "r.page", "r.parts")


def continuations(segments: DataFrame, by: list[str], window: int = WINDOW) -> DataFrame:
    """Pairs ``(by, position, next)`` of a paragraph that breaks off before something else and a later one that goes on.

    Candidates lie two to ``window`` segments on and a page away at most; a segment meets only those places.
    """
    w = Window.partitionBy(*by).orderBy("position")
    rows = segments.withColumn("_after", F.lead("kind").over(w)).where("kind = 'paragraph'")
    first = rows.where("_after is not null and _after <> 'paragraph'").select(*by, "position", F.col("text").alias("_text"), F.col("page").alias("_page"), F.explode(F.sequence(F.col("position") + 2, F.col("position") + window)).alias("next"))
    second = rows.select(*by, F.col("position").alias("next"), "text", "page")
    met = first.join(second, [*by, "next"]).where(_near(F.col("_page"), F.col("page")))
    block = lambda t: F.struct(F.lit("paragraph").alias("kind"), blank(t).alias("text"), F.lit(False).alias("hard"))
    return met.where(boundary(block(F.col("_text")), block(F.col("text")))["disposition"] == "merge").select(*by, "position", "next")


def reunited(segments: DataFrame, by: list[str], decisions: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Segments with far continuations joined, and the pairs ``(by, position, next, status)`` that were looked at.

    In the order of a report a paragraph is joined with its continuation if it has exactly one that was not yet taken, and
    ``decisions`` ``(by, position, next)`` confirm it; what was taken is neither a paragraph of its own nor a continuation
    of another. A paragraph is settled in the round in which no earlier one that is still open could take it or what it
    looks at, so a round settles every report in many places at once and the outcome is that of going through in order.
    """
    pairs = written(continuations(segments, by, window), "continuations")
    ok = decisions.select(*by, "position", "next").distinct().withColumn("ok", F.lit(True))
    left, done = pairs, None
    while not left.isEmpty():
        # The earliest open paragraph that looks at a place; a paragraph whose places and own place have none before it is settled.
        looks = left.groupBy(*by, F.col("next").alias("place")).agg(F.min("position").alias("earliest"))
        places = left.select(*by, "position", F.col("next").alias("place")).unionByName(left.select(*by, "position", F.col("position").alias("place"))).distinct()
        blocked = places.join(looks, [*by, "place"]).where("earliest < position").select(*by, "position").distinct()
        free = left.join(blocked, [*by, "position"], "left_anti")
        one = free.groupBy(*by, "position").agg(F.count("*").alias("n"), F.min("next").alias("next"))
        judged = one.join(ok, [*by, "position", "next"], "left").select(*by, "position", "next", F.when(F.col("n") > 1, "ambiguous").when(F.col("ok"), "joined").otherwise("refused").alias("status"))
        judged = written(judged, "judged")
        done = judged if done is None else done.unionByName(judged)
        taken = judged.where("status = 'joined'").select(*by, F.col("next").alias("place"))
        rest = left.join(judged.select(*by, "position"), [*by, "position"], "left_anti")
        rest = rest.join(taken.withColumnRenamed("place", "next"), [*by, "next"], "left_anti").join(taken.withColumnRenamed("place", "position"), [*by, "position"], "left_anti")
        rest = written(rest.select(pairs.columns), "continuations")
        drop_written(left)
        left = rest
    if done is None:
        done = pairs.withColumn("status", F.lit("refused"))
    won = done.where("status = 'joined'").select(*by, "position", "next")
    gone = won.select(*by, F.col("next").alias("position"))
    text = segments.select(*by, F.col("position").alias("next"), F.col("text").alias("_more"))
    rows = segments.join(gone, [*by, "position"], "left_anti").join(won.join(text, [*by, "next"]).select(*by, "position", "next", "_more"), [*by, "position"], "left")
    merged = F.when(F.col("next").isNotNull(), joined_text(blank(F.col("text")), blank(F.col("_more")))).otherwise(F.col("text"))
    return rows.withColumn("text", merged).withColumn("joined_with", F.col("next")).drop("_more", "next"), done
