"""Tables of two periods put side by side: which count, candidates, checked decisions, events, and gradings.

Tables are rows ``(by, table_id, ...)``; ``by`` names a report or a pair of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.text import blank
from driftline.operators import matching
from driftline.operators.views import real_labels

# Weights of the views of a table, and what extraction says of it.
VIEWS = {"concept": 0.35, "indicators": 0.40, "structure": 0.15, "footnotes": 0.10}
ARTIFACT, BUSINESS = ["confirmed_no_table"], ["ok", "confirmed_empty_structure", "partial"]
BOUNDARY = "page_context_inventory_boundary_candidate"
#: The crop that is tried next, by the first of these sets that the reasons touch.
RESCUES = [
    ("bottom_extended", ["missing_expected_footnotes"], r"footnote|notes? de bas de page|renvois de notes"),
    ("top_extended", ["top_context_missing_title"], r"titre manquant|missing title|en-têtes? manquants?|missing header"),
    ("top_trim", ["generic_page_title"], None),
    ("tight_body", ["generic_title_without_support", "dominant_contamination", "narrative_indicator_contamination"], None),
    ("body_expanded", ["missing_result", "output_budget_truncated", "no_viable_indicators", "missing_body_row_labels", "weak_indicator_only", "low_density_vertical"], None),
]


def partition(status: Column, labels: Column, headers: Column) -> Column:
    """artifact, ghost (no real label and no header), business or suspect; what was confirmed as no table is told first."""
    s = F.lower(F.trim(F.coalesce(F.nullif(F.trim(status), F.lit("")), F.lit("ok"))))
    n_headers = F.size(F.filter(F.coalesce(headers, F.array().cast("array<string>")), lambda h: F.trim(blank(h)) != ""))
    return F.when(s.isin(ARTIFACT), "artifact").when((real_labels(labels) == 0) & (n_headers == 0), "ghost").when(s.isin(BUSINESS), "business").otherwise("suspect")


def candidates(cards: DataFrame, k: int = 5, minimum: float = 2.0) -> DataFrame:
    """The best ``k`` previous tables of every current one by the weighted cosine of their views, and all of at least ``minimum``.

    ``cards`` are ``(block, side, chunk)`` with a vector a view; a missing view adds nothing. The weighted sum of cosines
    is one product of unit vectors put behind one another, so the pairs come tile by tile.
    """
    none = F.array().cast("array<double>")

    def scaled(view: str, weight: float) -> Column:
        v = F.coalesce(F.col(view).cast("array<double>"), none)
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
        width = F.max(F.size(v)).over(Window.partitionBy("block"))
        return F.transform(F.when(norm > 0, v).otherwise(F.array_repeat(F.lit(0.0), F.greatest(width, F.lit(0)))), lambda x: F.when(norm > 0, x / norm * weight**0.5).otherwise(0.0))

    rows = cards.select("block", "side", "chunk", F.concat(*(scaled(v, w) for v, w in VIEWS.items())).alias("vector"))
    pairs = matching.product_pairs(rows, minimum, best=k)
    w = Window.partitionBy("block", "right").orderBy(F.desc("score"), "left")
    return pairs.withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= k) | (F.col("score") >= minimum))


def checked(decisions: DataFrame, previous: DataFrame, current: DataFrame, by: list[str], allowed: list[str]) -> DataFrame:
    """What is wrong with each decision ``(by, current_id, previous_id, decision)``, and a row for each table without one.

    ``problem`` is null for a decision that stands: its table is known and decided once, its decision allowed, and its
    previous table, which only a match has, known and used once. Others are to be asked again.
    """
    has = lambda df, name: df.select(*by, F.col("table_id").alias(name), F.lit(True).alias(f"_{name}")).distinct()
    rows = decisions.join(has(previous, "previous_id"), [*by, "previous_id"], "left").join(has(current, "current_id"), [*by, "current_id"], "full")
    given = F.col("decision").isNotNull()
    twice = F.count(F.when(given, 1)).over(Window.partitionBy(*by, "current_id")) > 1
    reused = F.col("previous_id").isNotNull() & (F.count("previous_id").over(Window.partitionBy(*by, "previous_id")) > 1)
    is_match = F.col("decision") == "match"
    problem = (
        F.when(~given, "missing")
        .when(F.col("_current_id").isNull(), "unknown_current")
        .when(~F.col("decision").isin(allowed), "not_allowed")
        .when(twice, "duplicate")
        .when(is_match & F.col("previous_id").isNull(), "malformed")
        .when(~is_match & F.col("previous_id").isNotNull(), "malformed")
        .when(is_match & F.col("_previous_id").isNull(), "unknown_previous")
        .when(reused, "reused_previous")
    )
    return rows.select(*by, "current_id", "previous_id", "decision", problem.alias("problem"))


def settled(first: DataFrame, repaired: DataFrame, by: list[str]) -> DataFrame:
    """Decisions that stand, then those that stand after a repair of the others, and the rest as unresolved."""
    good = first.where("problem is null")
    again = repaired.where("problem is null").join(good.select(*by, "current_id"), [*by, "current_id"], "left_anti")
    again = again.join(good.where("previous_id is not null").select(*by, "previous_id"), [*by, "previous_id"], "left_anti")
    done = good.unionByName(again.select(good.columns))
    rest = first.select(*by, "current_id").where("current_id is not null").distinct().join(done.select(*by, "current_id"), [*by, "current_id"], "left_anti")
    none = F.lit(None).cast("string")
    return done.drop("problem").unionByName(rest.select(*by, "current_id", none.alias("previous_id"), F.lit("unresolved").alias("decision")))


def sorted_pairs(pairs: DataFrame, previous: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Pairs with ``position``: that of their previous table in its report; unknown ones last."""
    w = Window.partitionBy(*by).orderBy(*order)
    placed = previous.select(*by, F.col("table_id").alias("previous_id"), F.row_number().over(w).alias("_p"))
    rows = pairs.join(placed, [*by, "previous_id"], "left")
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("_p").asc_nulls_last(), "current_id"))).drop("_p")


def events(pairs: DataFrame, previous: DataFrame, current: DataFrame, by: list[str]) -> DataFrame:
    """Tables in no pair as added or removed, and those that only an inventory of page edges named as ``excluded``."""
    gone = previous.join(pairs.select(*by, F.col("previous_id").alias("table_id")), [*by, "table_id"], "left_anti").withColumn("event", F.lit("removed"))
    new = current.join(pairs.select(*by, F.col("current_id").alias("table_id")), [*by, "table_id"], "left_anti").withColumn("event", F.lit("added"))
    rows = gone.unionByName(new, allowMissingColumns=True)
    edge = F.coalesce(F.col("bbox_source") == BOUNDARY, F.lit(False)) if "bbox_source" in rows.columns else F.lit(False)
    return rows.withColumn("excluded", edge)


def suspects(first: DataFrame, second: DataFrame, by: list[str]) -> DataFrame:
    """Suspect tables of two lists, once each, those of the first before those of the second, in order of page."""
    rows = first.withColumn("_k", F.lit(0)).unionByName(second.withColumn("_k", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in rows.columns if c not in (*by, "table_id", "_k")]
    one = rows.groupBy(*by, "table_id").agg(F.min_by(F.struct(*rest), "_k").alias("r"))
    return one.select(*by, "table_id", "r.*")


def rescue_variant(reasons: Column, critiques: Column | None = None) -> Column:
    """The crop to try next by what is missing or wrong; the same crop again where nothing of it tells."""
    text = F.lower(blank(critiques)) if critiques is not None else F.lit("")

    def touched(rule: tuple) -> Column:
        hit = F.arrays_overlap(reasons, F.array(*map(F.lit, rule[1])))
        return hit | text.rlike(rule[2]) if rule[2] else hit

    out = reduce(lambda c, rule: c.when(touched(rule), rule[0]), RESCUES[1:], F.when(touched(RESCUES[0]), RESCUES[0][0]))
    return out.otherwise("same_crop_rescue")


def incompleteness(labels: Column, headers: Column, title: Column, summary: Column, box: Column | None = None) -> Column:
    """Reasons why an extracted table is incomplete, in order; empty if there is none."""
    n, heads = real_labels(labels), F.size(F.filter(F.coalesce(headers, F.array().cast("array<string>")), lambda h: F.trim(blank(h)) != ""))
    has_title, has_summary = F.trim(blank(title)) != "", F.trim(blank(summary)) != ""
    rules = [(n == 0, "no_viable_indicators"), ((n == 0) & (heads >= 2) & (has_title | has_summary), "missing_body_row_labels"), (~has_summary, "missing_table_summary")]
    if box is not None:
        rules += [((box[1] < 0.15) & ~has_title, "top_context_missing_title"), ((box[3] - box[1] > 0.25) & (n <= 2), "low_density_vertical")]
    return F.array_compact(F.array(*(F.when(F.coalesce(rule, F.lit(False)), name) for rule, name in rules)))


def chosen_variant(variants: DataFrame, by: list[str]) -> DataFrame:
    """Of several readings ``(by, variant, labels)`` of a table the one that the others agree with most.

    A label's votes are the readings that have it; a reading's score is the sum of its labels' votes less three times
    how far its number of labels is from the median; ties go to the first name.
    """
    one = variants.select(*by, "variant", F.explode(F.array_distinct("labels")).alias("label"))
    votes = one.groupBy(*by, "label").agg(F.count("*").alias("v"))
    score = one.join(votes, [*by, "label"]).groupBy(*by, "variant").agg(F.sum("v").alias("votes"))
    sizes = variants.select(*by, "variant", F.size("labels").alias("n"))
    middle = sizes.groupBy(*by).agg(F.percentile("n", 0.5).alias("median"))
    rows = sizes.join(score, [*by, "variant"], "left").join(middle, by).withColumn("score", F.coalesce("votes", F.lit(0)) - 3 * F.abs(F.col("n") - F.col("median")))
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "variant")
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").select(*by, "variant", "n", "score")


def quality_counts(tables: DataFrame, by: list[str]) -> DataFrame:
    """How many tables are of each status, were cut off, or are of low confidence."""
    n = lambda rule: F.count(F.when(rule, 1))
    status = F.lower(blank(F.col("extraction_status")))
    return tables.groupBy(*by).agg(
        F.count("*").alias("n_tables"), n(status.isin("", "ok")).alias("n_ok"), n(status.isin(ARTIFACT)).alias("n_artifact"), n(~status.isin("", *ARTIFACT, *BUSINESS)).alias("n_suspect"),
        n(F.coalesce("truncated", F.lit(False))).alias("n_truncated"), n(F.coalesce("confidence", F.lit(0.0)) < 0.85).alias("n_low_confidence"),
    )


def review_signature(changes: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """A digest of a queue that does not depend on the order of its items."""
    rows = changes.groupBy(*by).agg(F.array_sort(F.collect_list(F.to_json(F.struct(*columns)))).alias("items"))
    return rows.select(*by, F.sha2(F.to_json("items"), 256).alias("signature"))
