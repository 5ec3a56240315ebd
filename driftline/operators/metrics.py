"""Counts, rates, votes and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts_by(df: DataFrame, dimensions: list[str]) -> DataFrame:
    """Independent counts by each dimension and in all, in one pass: ``dimension``, ``value``, ``n``."""
    sets = [[F.col(d)] for d in dimensions]
    out = df.groupingSets([*sets, []], *map(F.col, dimensions)).agg(F.count("*").alias("n"), *(F.grouping(d).alias(f"_{d}") for d in dimensions))
    dimension, value = F.lit("total"), F.lit("all")
    for d in dimensions:
        own = F.col(f"_{d}") == 0
        dimension, value = F.when(own, d).otherwise(dimension), F.when(own, F.col(d).cast("string")).otherwise(value)
    return out.select(dimension.alias("dimension"), value.alias("value"), "n")


def status_progress(df: DataFrame, by: list[str], status: Column, decided: list[str]) -> DataFrame:
    """Rows, decided rows, remaining ones and the percentage, rounded half up."""
    done = F.count(F.when(status.isin(decided), 1))
    out = df.groupBy(*by).agg(F.count("*").alias("n"), done.alias("n_decided"))
    return out.withColumns({"n_remaining": F.col("n") - F.col("n_decided"), "percent": F.floor(100 * F.col("n_decided") / F.col("n") + 0.5).cast("long")})


def vote(df: DataFrame, by: list[str], ballot: str, minimum_share: float, minimum_votes: int) -> DataFrame:
    """The most frequent ballot of each group, if it has the share and votes asked for and no rival ties it."""
    counted = df.groupBy(*by, ballot).agg(F.count("*").alias("votes"))
    w = Window.partitionBy(*by)
    ranked = counted.withColumns({"all_votes": F.sum("votes").over(w), "rank": F.row_number().over(w.orderBy(F.desc("votes"), ballot)), "rivals": F.count("*").over(Window.partitionBy(*by, "votes"))})
    won = (F.col("votes") >= minimum_share * F.col("all_votes")) & (F.col("votes") >= minimum_votes) & (F.col("rivals") == 1)
    return ranked.where("rank = 1").select(*by, F.col(ballot).alias("winner"), "votes", "all_votes", won.alias("accepted"))


def weighted_agreement(df: DataFrame, by: list[str], value: str, weight: str, single: float = 0.55) -> DataFrame:
    """One minus a tenth of the weighted variance, not below zero; a single source has a fixed confidence."""
    w, x = F.col(weight), F.col(value)
    out = df.groupBy(*by).agg(F.count("*").alias("sources"), F.sum(w).alias("sw"), F.sum(w * x).alias("swx"), F.sum(w * x * x).alias("swxx"))
    variance = F.greatest(F.col("swxx") / F.col("sw") - F.pow(F.col("swx") / F.col("sw"), 2), F.lit(0.0))
    return out.select(*by, "sources", F.when(F.col("sources") == 1, single).otherwise(F.greatest(1 - variance / 10, F.lit(0.0))).alias("confidence"))


def consensus(df: DataFrame, signal: list[str], member: str, keep: int, agree: int) -> DataFrame:
    """Signals seen by at least ``keep`` members, and whether ``agree`` of them make it a consensus."""
    out = df.select(*signal, member).distinct().groupBy(*signal).agg(F.count("*").alias("members"))
    return out.where(F.col("members") >= keep).withColumn("is_consensus", F.col("members") >= agree)


def precision(predicted: DataFrame, gold: DataFrame, key: list[str], expected: str) -> DataFrame:
    """Predictions that gold knows: how many, how many right, and the share (null without any)."""
    joined = predicted.select(*key).distinct().join(gold, key)
    out = joined.agg(F.count("*").alias("judged"), F.count(F.when(F.col(expected), 1)).alias("true_positives"))
    return out.withColumn("precision", F.col("true_positives") / F.nullif("judged", F.lit(0)))


def first_wins(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row a key: the first in order, with the number of rows it stands for. Aggregated map-side, no window."""
    rest = [c for c in df.columns if c not in key]
    kept = df.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("_row"), F.count("*").alias("n_merged"))
    return kept.select(*key, "_row.*", "n_merged")


def apply_decisions(items: DataFrame, decisions: DataFrame, key: list[str]) -> DataFrame:
    """Items with their decision (``pending`` without one); of several the latest ``decided_at`` counts."""
    latest = decisions.groupBy(*key).agg(F.max_by("decision", "decided_at").alias("decision"))
    return items.join(latest, key, "left").withColumn("decision", F.coalesce("decision", F.lit("pending")))


def global_summary(changes: DataFrame, by: list[str]) -> DataFrame:
    """Totals of changes with their verdicts, counts by impact, category and action, the first five summaries, and how
    much it matters: ELEVEE from three relevant major changes on, MOYENNE from one relevant change on."""
    relevant = F.coalesce("is_relevant", F.lit(False))
    named = lambda c, none, f: f(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(none)))
    impact, category, action = named("impact_level", "MINEUR", F.upper), named("category", "INCONNU", F.upper), named("action_requise", "aucune", F.lower)
    rows = changes.select(*by, "position", relevant.alias("relevant"), impact.alias("impact"), category.alias("category"), action.alias("action"), F.trim(F.coalesce("change_summary", F.lit(""))).alias("summary"))
    totals = rows.groupBy(*by).agg(F.count("*").alias("total"), F.count(F.when(F.col("relevant"), 1)).alias("total_relevant"), F.count(F.when(F.col("relevant") & (F.col("impact") == "MAJEUR"), 1)).alias("n_major"))

    def counted(column: str) -> DataFrame:
        n = rows.groupBy(*by, column).agg(F.count("*").alias("n"))
        return n.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias(f"by_{column}"))

    w = Window.partitionBy(*by).orderBy("position")
    first = rows.where("summary <> ''").withColumn("_n", F.row_number().over(w)).where("_n <= 5").groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "summary"))), lambda x: x["summary"]).alias("highlights"))
    out = totals
    for part in (counted("impact"), counted("category"), counted("action")):
        out = out.join(part, by)
    matter = F.when(F.col("n_major") >= 3, "ELEVEE").when(F.col("total_relevant") > 0, "MOYENNE").otherwise("FAIBLE")
    return out.join(first, by, "left").withColumns({"highlights": F.coalesce("highlights", F.array().cast("array<string>")), "pertinence_globale": matter}).drop("n_major")


def quality_metrics(changes: DataFrame, by: list[str]) -> DataFrame:
    """Rates of ambiguous, reviewed and duplicate changes, and how many came by which way.

    ``changes`` have ``alignment_type``, ``alignment_decision``, ``review_required``, ``source`` and ``dedup_group``.
    """
    n = lambda rule: F.count(F.when(rule, 1))
    ambiguous = (F.col("alignment_type") == "ambiguous") | (F.coalesce("alignment_decision", F.lit("")) == "uncertain")
    source = F.coalesce("source", F.lit(""))
    sent = (source != "") & ~source.isin("deterministic_prefilter", "alignment_review_required", "semantic_alignment_decision")
    out = changes.groupBy(*by).agg(
        F.count("*").alias("total_changes"), n(ambiguous).alias("ambiguous_alignment_count"), n(source == "deterministic_prefilter").alias("triage_prefiltered_count"), n(sent).alias("triage_sent_count"),
        F.countDistinct("dedup_group").alias("triage_dedup_group_count"), F.count("dedup_group").alias("triage_dedup_member_count"), n(F.coalesce("review_required", F.lit(False))).alias("human_review_count"),
    )
    rate = lambda c: F.round(c / F.col("total_changes"), 4)
    return out.withColumns({"ambiguous_alignment_rate": rate(F.col("ambiguous_alignment_count")), "human_review_rate": rate(F.col("human_review_count")), "triage_duplicate_rate": rate(F.col("triage_dedup_member_count") - F.col("triage_dedup_group_count"))})


def usage(records: DataFrame, by: list[str]) -> DataFrame:
    """Token sums and calls; a total that is missing everywhere is prompt and completion together."""
    whole = lambda c: F.sum(F.coalesce(F.col(c).try_cast("long"), F.lit(0)))
    out = records.groupBy(*by).agg(whole("prompt_tokens").alias("prompt_tokens_total"), whole("completion_tokens").alias("completion_tokens_total"), whole("total_tokens").alias("_t"), F.count("*").alias("comparison_calls_total"))
    total = F.when(F.col("_t") == 0, F.col("prompt_tokens_total") + F.col("completion_tokens_total")).otherwise(F.col("_t"))
    return out.withColumn("total_tokens_total", total).drop("_t")


def usage_cost(records: DataFrame, prices: dict[str, tuple[float, float]]) -> DataFrame:
    """Records with their cost by model, prices in dollars a million tokens in and out; an unknown model costs nothing."""
    price = lambda k: F.coalesce(*(F.when(F.col("model") == m, p[k]) for m, p in prices.items()), F.lit(0.0))
    return records.withColumn("cost_usd", F.round((F.col("prompt_tokens") * price(0) + F.col("completion_tokens") * price(1)) / 1e6, 6))


def changed_tables(pairs: DataFrame, alone: DataFrame, by: list[str], pair_id: str) -> DataFrame:
    """Distinct tables of a side that changed in a pair or are on that side only."""
    changed = (F.coalesce("table_status", F.lit("stable")) != "stable") | (F.coalesce("footnotes_changed", F.lit(0)) > 0)
    ids = pairs.where(changed).select(*by, F.col(pair_id).alias("id")).unionByName(alone.select(*by, F.col("table_id").alias("id")))
    return ids.where("id is not null and id <> ''").groupBy(*by).agg(F.countDistinct("id").alias("n_changed"))


def high_priority(assessed: DataFrame, by: list[str]) -> DataFrame:
    """How many pairs, added and removed tables are of high priority."""
    return assessed.groupBy(*by).agg(F.count(F.when(F.col("review_priority").isin("prioritaire", "critique"), 1)).alias("n_high_priority"))


def section_health(sections: DataFrame, by: list[str], targets: list[str], least: float = 0.6) -> DataFrame:
    """Confidence of the target sections, the best of each and the least of all, and missing, low_confidence or complete."""
    best = sections.where(F.col("section").isin(targets)).groupBy(*by, "section").agg(F.max("confidence").alias("c"))
    out = best.groupBy(*by).agg(F.min("c").alias("confidence"), F.array_sort(F.collect_set("section")).alias("found"))
    missing = F.array_except(F.array(*map(F.lit, targets)), F.col("found"))
    return out.withColumns({"missing": missing, "status": F.when(F.size(missing) > 0, "missing").when(F.col("confidence") < least, "low_confidence").otherwise("complete")})
