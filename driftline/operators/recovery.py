"""What is left of the tables of two periods after a first matching: objective facts of a pair, which pairs stand, and the
loop that assigns, has the assignment inspected, and assigns again without the pairs that were refused.

Cards are rows ``(by, table_id, title, summary, indicators, headers, notes, row_count)`` with keys in place of the printed
texts, as ``normalized`` makes them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.labels import label_key, matching_key, without_periods
from driftline.functions.similarity import jaccard
from driftline.functions.text import blank
from driftline.operators.matching import optimal
from driftline.sources.scratch import written

#: What each fact adds to the strength of the evidence.
WEIGHTS = {"indicator_smaller_coverage": 0.50, "indicator_jaccard": 0.15, "header_jaccard": 0.10, "footnote_jaccard": 0.10, "title_exact": 0.075, "summary_exact": 0.075}
#: Shares of a judge's confidence and of the evidence in a pair's score; the least confidence of a verdict.
CONFIDENCE, EVIDENCE, MIN_CONFIRMED = 0.80, 0.20, 0.75
CARD = ["title", "summary", "indicators", "headers", "notes", "row_count"]


def _keys(values: Column, key: Callable[[Column], Column]) -> Column:
    return F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: key(blank(x))), lambda k: k != "")


def normalized(cards: DataFrame) -> DataFrame:
    """Cards with keys for titles, summaries, indicators, headers and notes, and a row count of at least 0.

    Without a row count the indicators are counted. Null arrays count as empty, null texts as empty texts.
    """
    dated = lambda c: matching_key(without_periods(blank(c)))
    title = matching_key(F.regexp_replace(without_periods(blank(F.col("title"))), r"(?i)\btableau\s+\d+\b", " "))
    indicators = _keys(F.col("indicators"), label_key)
    new = {"title": title, "summary": dated(F.col("summary")), "indicators": indicators, "headers": F.array_distinct(_keys(F.col("headers"), dated)), "notes": F.array_distinct(_keys(F.col("notes"), matching_key))}
    rows = cards.withColumns(new)
    return rows.withColumn("row_count", F.greatest(F.coalesce(F.col("row_count").cast("int"), F.size("indicators")), F.lit(0)))


def pair_facts(pairs: DataFrame, previous: DataFrame, current: DataFrame, by: list[str]) -> DataFrame:
    """Pairs ``(by, previous_id, current_id, ...)`` with what their normalised cards have in common.

    A pair of which a card is unknown has nulls and passes no gate.
    """
    side = lambda df, name: df.select(*by, F.col("table_id").alias(f"{name}_id"), F.struct(*CARD).alias(f"_{name}"))
    rows = pairs.join(side(previous, "previous"), [*by, "previous_id"], "left").join(side(current, "current"), [*by, "current_id"], "left")
    a, b = F.col("_previous"), F.col("_current")
    x, y = F.array_distinct(a["indicators"]), F.array_distinct(b["indicators"])
    common, small = F.size(F.array_intersect(x, y)), F.least(F.size(x), F.size(y))
    large = F.greatest(a["row_count"], b["row_count"], F.lit(1))
    known = a.isNotNull() & b.isNotNull()
    facts = {
        "title_exact": (a["title"] != "") & (a["title"] == b["title"]),
        "summary_exact": (a["summary"] != "") & (a["summary"] == b["summary"]),
        "indicator_common_count": common,
        "indicator_smaller_coverage": F.when(small > 0, common / small).otherwise(0.0),
        "indicator_jaccard": jaccard(x, y),
        "header_jaccard": jaccard(a["headers"], b["headers"]),
        "footnote_jaccard": jaccard(a["notes"], b["notes"]),
        "row_ratio": F.least(a["row_count"], b["row_count"]) / large,
        "row_delta": F.abs(a["row_count"] - b["row_count"]),
    }
    return rows.withColumns({n: F.when(known, c) for n, c in facts.items()}).drop("_previous", "_current")


def objective() -> Column:
    """Whether the facts of a pair show more than one title or first row: the least that any match must have."""
    n, cover, rows, notes = (F.col(c) for c in ("indicator_common_count", "indicator_smaller_coverage", "row_ratio", "footnote_jaccard"))
    title, summary = F.col("title_exact"), F.col("summary_exact")
    signature = (n >= 2) & (cover >= 0.5)
    small_table = (n == 1) & (cover == 1.0) & (rows >= 0.75) & (title | summary)
    by_notes = (notes >= 0.5) & (rows >= 0.6) & (title | summary | (n >= 1))
    grown = (n >= 1) & (cover == 1.0) & title & summary & (F.col("header_jaccard") >= 0.8)
    return F.coalesce(signature | small_table | by_notes | grown, F.lit(False))


def evidence() -> Column:
    """Strength of the evidence between 0 and 1."""
    return F.least(F.lit(1.0), reduce(lambda a, b: a + b, [w * F.col(n).cast("double") for n, w in WEIGHTS.items()]))


def trusted() -> Column:
    """Whether a first pair is so well founded that it is not looked at again."""
    n, cover = F.col("indicator_common_count"), F.col("indicator_smaller_coverage")
    named = F.col("title_exact") & (cover >= 0.7) & (F.col("header_jaccard") >= 0.6)
    whole = (F.col("indicator_jaccard") >= 0.8) & (F.col("row_ratio") >= 0.75)
    return F.coalesce(objective() & ((F.col("summary_exact") & (n >= 1)) | named | whole), F.lit(False))


def partitioned(pairs: DataFrame, previous: DataFrame, current: DataFrame, by: list[str]) -> DataFrame:
    """First pairs with ``is_trusted``: the others are released to the recovery."""
    return pair_facts(pairs, previous, current, by).withColumn("is_trusted", trusted())


def anchors(previous: DataFrame, current: DataFrame, by: list[str]) -> DataFrame:
    """Pairs of tables that could pass the gate: those that share an indicator key, or a note with a title or summary.

    Pairs meet on what they share, through lists by key; a key that a table repeats counts once.
    """
    def shared(keys: Column) -> DataFrame:
        side = lambda df, name: df.select(*by, F.col("table_id").alias(f"{name}_id"), F.explode(F.array_distinct(keys)).alias("_key"))
        return side(previous, "previous").join(side(current, "current"), [*by, "_key"]).select(*by, "previous_id", "current_id")

    named = F.transform(F.filter(F.array(F.concat(F.lit("t:"), "title"), F.concat(F.lit("s:"), "summary")), lambda k: F.length(k) > 2), lambda k: k)
    noted = F.flatten(F.transform(named, lambda t: F.transform("notes", lambda n: F.concat(t, F.lit("|"), n))))
    return shared(F.col("indicators")).unionByName(shared(noted)).distinct()


def shortlist(similar: DataFrame, previous: DataFrame, current: DataFrame, by: list[str], k: int) -> DataFrame:
    """For every current table its ``k`` most similar previous ones, and beyond them all that pass the gate.

    ``similar`` are pairs ``(by, previous_id, current_id, similarity)``, such as ``tables.candidates`` gives. Equal
    similarities go by the evidence, then by the previous id. The facts, ``is_objective`` and ``evidence`` are added.
    """
    pairs = similar.select(*by, "previous_id", "current_id", "similarity").unionByName(anchors(previous, current, by).withColumn("similarity", F.lit(None).cast("double")))
    pairs = pairs.groupBy(*by, "previous_id", "current_id").agg(F.max("similarity").alias("similarity"))
    rows = pair_facts(pairs, previous, current, by).withColumns({"is_objective": objective(), "evidence": evidence()})
    w = Window.partitionBy(*by, "current_id").orderBy(F.desc_nulls_last("similarity"), F.desc("evidence"), "previous_id")
    ranked = rows.withColumn("rank", F.row_number().over(w))
    return ranked.where((F.col("rank") <= k) & F.col("similarity").isNotNull() | F.col("is_objective")).drop("rank")


def judged(listed: DataFrame, verdicts: DataFrame, by: list[str], least: float) -> DataFrame:
    """Pairs of a shortlist that a judge calls the same table with at least that confidence, and that pass the gate.

    ``verdicts`` are ``(by, previous_id, current_id, verdict, confidence)``; verdicts on pairs outside the list don't count.
    ``score`` is mostly the confidence, and the evidence.
    """
    rows = listed.join(verdicts, [*by, "previous_id", "current_id"]).where((F.col("verdict") == "same_table") & (F.col("confidence") >= least) & F.col("is_objective"))
    return rows.withColumn("score", CONFIDENCE * F.col("confidence") + EVIDENCE * F.col("evidence"))


def recovered(edges: DataFrame, by: list[str], inspect: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, dict[str, int]]:
    """The best assignment in which every pair was confirmed, and what it took: rounds, inspections, refusals.

    ``edges`` are ``(by, previous_id, current_id, score, ...)``. Each round assigns anew and gives the pairs that were not
    yet seen to ``inspect``, which returns ``(by, previous_id, current_id, verdict, confidence)``; a pair is confirmed if
    the verdict says so with enough confidence, and refused otherwise, also without a row. Refused pairs are left out from
    then on, until a round refuses none. Blocks are assigned independently: one without a refusal keeps its assignment, and
    a round works on the others alone. Only pairs that an assignment proposes are ever inspected. Every round but the
    last refuses a pair for good, so the loop ends.
    """
    pair = ["block", "left", "right"]
    block = F.to_json(F.struct(*by)) if by else F.lit("")
    left = written(edges.withColumns({"block": block, "left": F.col("current_id"), "right": F.col("previous_id")}), "edges")
    kept, seen = [], None
    took = {"rounds": 0, "inspected": 0, "refused": 0}
    while True:
        took["rounds"] += 1
        assigned = written(left.join(optimal(left.select(*pair, "score"), 0.0).select(pair), pair, "left_semi"), "assigned")
        asked = assigned if seen is None else written(assigned.join(seen, pair, "left_anti"), "asked")
        n = asked.count()
        if not n:
            break
        said = inspect(asked.select(edges.columns)).where((F.col("verdict") == "confirmed") & (F.col("confidence") >= MIN_CONFIRMED))
        said = written(asked.join(said.select(*by, "previous_id", "current_id"), [*by, "previous_id", "current_id"], "left_semi").select(pair), "confirmed")
        refused = written(asked.select(pair).join(said, pair, "left_anti"), "refused")
        bad = refused.count()
        took["inspected"], took["refused"] = took["inspected"] + n, took["refused"] + bad
        if not bad:
            break
        again = refused.select("block").distinct()
        kept.append(assigned.join(again, "block", "left_anti"))
        seen = written((said if seen is None else seen.unionByName(said)).join(again, "block", "left_semi"), "seen")
        left = written(left.join(again, "block", "left_semi").join(refused, pair, "left_anti"), "edges")
    return reduce(DataFrame.unionByName, [*kept, assigned]).select(edges.columns), took


def decisions(current: DataFrame, matched: DataFrame, by: list[str]) -> DataFrame:
    """One decision for every current table: matched with its previous one, or added."""
    rows = current.select(*by, F.col("table_id").alias("current_id")).distinct().join(matched.select(*by, "current_id", "previous_id", "confidence"), [*by, "current_id"], "left")
    return rows.select(*by, "current_id", F.when(F.col("previous_id").isNull(), "added").otherwise("matched").alias("decision"), "previous_id", F.col("confidence").alias("match_confidence"))
