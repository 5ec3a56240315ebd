"""Two periods of text put side by side: candidates, one-to-one pairs, what kind of pair, and the changes that follow.

Pairs are rows ``(block, left, right, tfidf, embedding)`` with, where there are any, the units' ``left_role`` and
``right_role``, ``left_marker`` and ``right_marker``, ``left_order`` and ``right_order``. A block (a section of a pair
of documents, say) is never matched across; within it everything is joins, grouped maxima and windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.similarity import sequence_ratio
from driftline.functions.text import blank, heading_key, numeric_tokens, semantic, squeezed
from driftline.operators.matching import one_to_one

# Thresholds.
WEAK, STRONG, EMBEDDING_WEAK, EMBEDDING_STRONG, EMBEDDING_SURE = 0.35, 0.85, 0.55, 0.85, 0.92
MARGIN, HYBRID_MARGIN, GROUPED, EXACT = 0.10, 0.08, 0.82, 0.98
HEADING_STRONG, HEADING_CONTAINED, HEADING_HYBRID = 0.82, 0.75, 0.55
BODY_EMBEDDING, BODY_TFIDF, HYBRID_TFIDF, HYBRID_EMBEDDING = 0.90, 0.35, 0.50, 0.85
MIN_FRAGMENT, MIN_OVERLAP, MIN_EMBEDDING = 80, 0.24, 0.72
STRONG_OVERLAP, STRONG_EMBEDDING, MUTUAL, NEAR_BEST = 0.50, 0.88, 0.78, 0.08
BATCHES = {"matched_strong": 5, "matched_weak": 1, "possible_added": 3, "possible_removed": 3}


def roles_compatible(a: Column, b: Column) -> Column:
    """An introduction is never paired with an item of its list."""
    return ~F.coalesce(((a == "context") & (b == "item")) | ((a == "item") & (b == "context")), F.lit(False))


def same_marker(a: Column, b: Column) -> Column:
    """Both units have a mark, and it is the same but for case and brackets."""
    bare = lambda m: F.regexp_replace(F.lower(F.trim(blank(m))), r"[().]", "")
    return (bare(a) != "") & (bare(a) == bare(b)) & ~bare(a).isin("-", "•", "*")


def prepared(pairs: DataFrame) -> DataFrame:
    """Pairs whose roles go together, with ``score``, the better signal, and what settles ties."""
    has = lambda c: F.col(c) if c in pairs.columns else F.lit(None).cast("string")
    order = lambda c: F.col(c) if c in pairs.columns else F.lit(0)
    rows = pairs.where(roles_compatible(has("left_role"), has("right_role")))
    extra = {"embedding": F.lit(0.0)} if "embedding" not in pairs.columns else {}
    rows = rows.withColumns(extra | {"marker_match": same_marker(has("left_marker"), has("right_marker")).cast("int"), "distance": F.abs(order("left_order") - order("right_order"))})
    return rows.withColumn("score", F.greatest("tfidf", "embedding"))


def _best_first(other: str) -> list[Column]:
    return [F.desc("score"), F.desc("embedding"), F.desc("tfidf"), F.desc("marker_match"), F.asc("distance"), F.asc(other)]


def shortlist(pairs: DataFrame, side: str, k: int = 5) -> DataFrame:
    """The best ``k`` partners of each row of a side, ``rank`` from 1; the score is the better of the two signals."""
    other = "right" if side == "left" else "left"
    w = Window.partitionBy("block", side).orderBy(*_best_first(other))
    return prepared(pairs).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def merged_shortlists(*lists: DataFrame, side: str = "left", k: int = 5) -> DataFrame:
    """Several shortlists as one: each signal at its best, ranked anew."""
    rows = lists[0].select("block", "left", "right", "tfidf", "embedding")
    for one in lists[1:]:
        rows = rows.unionByName(one.select("block", "left", "right", "tfidf", "embedding"))
    best = rows.groupBy("block", "left", "right").agg(F.max("tfidf").alias("tfidf"), F.max("embedding").alias("embedding"))
    return shortlist(best, side, k)


def _ranked(pairs: DataFrame) -> DataFrame:
    """Each pair with its rank on both sides and whether both sides' best lead clearly."""
    left, right = Window.partitionBy("block", "left").orderBy(*_best_first("right")), Window.partitionBy("block", "right").orderBy(*_best_first("left"))
    lead = lambda w: F.col("score") - F.coalesce(F.lead("score").over(w), F.lit(-1.0))
    rows = prepared(pairs).withColumns({"left_rank": F.row_number().over(left), "right_rank": F.row_number().over(right), "left_lead": lead(left), "right_lead": lead(right)})
    margin = F.when(F.col("embedding") > 0, HYBRID_MARGIN).otherwise(MARGIN)
    return rows.withColumn("clear", (F.col("left_lead") >= margin) & (F.col("right_lead") >= margin))


def signals_agree(tfidf: Column, embedding: Column) -> Column:
    """Whether the signals of a pair that is best on both sides support it: one of them is strong."""
    return (embedding >= EMBEDDING_STRONG) | (tfidf >= STRONG)


def hybrid_type(score: Column, tfidf: Column, embedding: Column, clear: Column, left_text: Column, right_text: Column) -> Column:
    """matched_strong, matched_weak or ambiguous; different numbers leave a pair ambiguous."""
    facts = (numeric_tokens(F.lower(left_text)) != numeric_tokens(F.lower(right_text))) & (score >= WEAK)
    strong = signals_agree(tfidf, embedding)
    return F.when(facts, "ambiguous").when((score >= EMBEDDING_WEAK) & clear & strong, "matched_strong").when((score >= WEAK) & clear & strong, "matched_weak").otherwise("ambiguous")


def score_type(score: Column, clear: Column) -> Column:
    return F.when(score >= STRONG, "matched_strong").when((score >= WEAK) & clear, "matched_weak").otherwise("ambiguous")


def _with_leftovers(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """The pairs, and the units of either side in none of them as possible_removed and possible_added."""
    l, r = left.select("block", F.col("unit").alias("left")), right.select("block", F.col("unit").alias("right"))
    none = lambda name, like: F.lit(None).cast(like.schema[name].dataType).alias(name)
    columns = ["block", "left", "right", "alignment_type", "score", "tfidf", "embedding", "reason"]
    rest = lambda rows, kind, why: (F.lit(kind).alias("alignment_type"), F.lit(0.0).alias("score"), F.lit(0.0).alias("tfidf"), F.lit(0.0).alias("embedding"), F.lit(why).alias("reason"))
    gone = l.join(pairs.select("block", "left"), ["block", "left"], "left_anti").select("block", "left", none("right", r), *rest(l, "possible_removed", "unmatched_t1"))
    new = r.join(pairs.select("block", "right"), ["block", "right"], "left_anti").select("block", none("left", l), "right", *rest(r, "possible_added", "unmatched_t2"))
    return pairs.select(columns).unionByName(gone).unionByName(new)


def aligned_hybrid(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Credible pairs that are best for both sides, with their type, and the leftovers.

    ``left`` and ``right`` hold the units ``(block, unit, text)``. Two rows that are each other's best are in no other
    such pair, so no order of taking them is needed.
    """
    credible = (F.col("score") >= WEAK) | (F.col("embedding") >= EMBEDDING_WEAK)
    best = _ranked(pairs).where((F.col("left_rank") == 1) & (F.col("right_rank") == 1) & credible)
    texts = lambda side, name: side.select("block", F.col("unit").alias(name), F.col("text").alias(f"{name}_text"))
    rows = best.join(texts(left, "left"), ["block", "left"]).join(texts(right, "right"), ["block", "right"])
    kind = hybrid_type(F.col("score"), F.col("tfidf"), F.col("embedding"), F.col("clear"), F.col("left_text"), F.col("right_text"))
    return _with_leftovers(rows.withColumns({"alignment_type": kind, "reason": F.lit("hybrid_tfidf_embedding")}), left, right)


def aligned_tfidf(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """The best pairs first, each unit once, by the words alone; with the leftovers."""
    rows = _ranked(pairs.withColumn("embedding", F.lit(0.0)))
    taken = one_to_one(rows.where(F.col("score") >= WEAK), [F.col("score"), F.col("marker_match"), -F.col("distance")])
    return _with_leftovers(taken.withColumns({"alignment_type": score_type(F.col("score"), F.col("clear")), "reason": F.lit("tfidf_one_to_one")}), left, right)


def regrouped(alignments: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Leftovers beside a pair joined to it where the whole then is nearly verbatim, and more so than the pair alone.

    ``left`` and ``right`` hold ``(block, unit, text, heading, order)``. Of several that fit the closest is taken, each
    record once. Returns ``(block, left, right, added_left, added_right, score)`` of the pairs that grow.
    """
    of = lambda side, name: side.select("block", F.col("unit").alias(name), F.col("text").alias(f"{name}_text"), F.col("heading").alias(f"{name}_heading"), F.col("order").alias(f"{name}_order"))
    matched = alignments.where("left is not null and right is not null").join(of(left, "left"), ["block", "left"]).join(of(right, "right"), ["block", "right"])
    matched = matched.withColumn("alone", sequence_ratio("left_text", "right_text"))
    gone = alignments.where("alignment_type = 'possible_removed'").select("block", F.col("left").alias("extra")).join(of(left, "extra"), ["block", "extra"])
    new = alignments.where("alignment_type = 'possible_added'").select("block", F.col("right").alias("extra")).join(of(right, "extra"), ["block", "extra"])

    def proposed(rest: DataFrame, side: str) -> DataFrame:
        other = "right" if side == "left" else "left"
        near = (F.abs(F.col("extra_order") - F.col(f"{side}_order")) == 1) & F.col("extra_heading").eqNullSafe(F.col(f"{side}_heading"))
        rows = matched.join(rest, "block").where(near)
        whole = F.when(F.col("extra_order") < F.col(f"{side}_order"), F.concat_ws(" ", F.trim("extra_text"), F.trim(f"{side}_text"))).otherwise(F.concat_ws(" ", F.trim(f"{side}_text"), F.trim("extra_text")))
        scored = rows.withColumn("ratio", sequence_ratio(whole, f"{other}_text")).where((F.col("ratio") >= GROUPED) & (F.col("ratio") > F.col("alone")))
        return scored.select("block", F.concat_ws("|", "left", "right").alias("pair"), F.concat(F.lit(f"{side}:"), F.col("extra").cast("string")).alias("rest"), "left", "right", F.lit(side).alias("side"), "extra", F.col("ratio").alias("score"))

    found = proposed(gone, "left").unionByName(proposed(new, "right"))
    taken = one_to_one(found.withColumnsRenamed({"left": "was_left", "right": "was_right", "pair": "left", "rest": "right"}), [F.col("score")])
    extra = lambda side: F.when(F.col("side") == side, F.col("extra"))
    return taken.select("block", F.col("was_left").alias("left"), F.col("was_right").alias("right"), extra("left").alias("added_left"), extra("right").alias("added_right"), "score")


def exact(alignments: DataFrame, left_text: str = "left_text", right_text: str = "right_text") -> DataFrame:
    """Alignments with ``exact``: strong ones that are the same almost to the word, which need no verdict, and what they
    come to, unchanged or modified."""
    ask = (F.col("alignment_type") == "matched_strong") & ((F.col("embedding") >= STRONG) | (F.col("tfidf") >= STRONG))
    ratio = sequence_ratio(F.when(ask, F.col(left_text)), F.when(ask, F.col(right_text)))
    same = squeezed(F.col(left_text)) == squeezed(F.col(right_text))
    rows = alignments.withColumn("exact", ask & (ratio >= EXACT))
    return rows.withColumn("diff_type", F.when(F.col("exact"), F.when(same, "unchanged").otherwise("modified")))


def orphan_changes(alignments: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Leftovers as changes, removed or added, with their texts and what they mean."""
    of = lambda side, name: side.select("block", F.col("unit").alias(name), F.col("text").alias(f"text_{name}"))
    gone = alignments.where("alignment_type = 'possible_removed'").join(of(left, "left"), ["block", "left"]).select("block", F.col("left").cast("string").alias("unit"), F.lit("removed").alias("diff_type"), F.col("text_left").alias("source_text_t1"), F.lit("").alias("source_text_t2"))
    new = alignments.where("alignment_type = 'possible_added'").join(of(right, "right"), ["block", "right"]).select("block", F.col("right").cast("string").alias("unit"), F.lit("added").alias("diff_type"), F.lit("").alias("source_text_t1"), F.col("text_right").alias("source_text_t2"))
    rows = gone.unionByName(new)
    return rows.withColumns({"semantic_text_t1": semantic(F.col("source_text_t1")), "semantic_text_t2": semantic(F.col("source_text_t2"))})


def batches(alignments: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Alignments with ``batch``: neighbours of one type together, so many at most as the type allows."""
    w = Window.partitionBy(*by).orderBy(*order)
    new_run = F.coalesce(F.col("alignment_type") != F.lag("alignment_type").over(w), F.lit(True)).cast("int")
    rows = alignments.withColumn("_new", new_run).withColumn("_run", F.sum("_new").over(w))
    place = F.row_number().over(Window.partitionBy(*by, "_run").orderBy(*order)) - 1
    size = F.lit(1)
    for kind, n in BATCHES.items():
        size = F.when(F.col("alignment_type") == kind, n).otherwise(size)
    rows = rows.withColumn("_first", (place % size == 0).cast("int"))
    return rows.withColumn("batch", F.format_string("b%02d", F.sum("_first").over(w) - 1)).drop("_new", "_run", "_first")


def paired_subsections(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Subsections ``(by, position, heading, body)`` of both sides under the same heading key; of the right side's with
    one key the last counts, and each left one with that key meets it. Unpaired ones have nulls on the other side."""
    l = left.select(*by, heading_key(F.col("heading")).alias("key"), F.col("heading").alias("heading_t1"), F.col("body").alias("body_t1"))
    last = right.groupBy(*by, heading_key(F.col("heading")).alias("key")).agg(F.max_by(F.struct("heading", "body"), "position").alias("r"))
    return l.join(last, [*by, "key"], "full").select(*by, "key", "heading_t1", F.coalesce("body_t1", F.lit("")).alias("body_t1"), F.col("r.heading").alias("heading_t2"), F.coalesce("r.body", F.lit("")).alias("body_t2"))


def subsections(df: DataFrame, by: list[str], text: str) -> DataFrame:
    """Parts of Markdown under ``### `` headings, those with a body; what stands before the first is ``__intro__``."""
    marked = F.regexp_replace(F.concat(F.lit("### __intro__\n"), blank(F.col(text))), r"(?m)^### (.+)$", "\u0001$1\u0002")
    parts = F.filter(F.split(marked, "\u0001"), lambda p: p != "")
    rows = df.select(*by, F.posexplode(parts).alias("position", "part"))
    rows = rows.select(*by, "position", F.trim(F.substring_index("part", "\u0002", 1)).alias("heading"), F.regexp_replace(F.substring_index("part", "\u0002", -1), r"^\s+|\s+$", "").alias("body"))
    return rows.where("heading <> '' and body <> ''")


def one_contains_other(a: Column, b: Column) -> Column:
    x, y = heading_key(a), heading_key(b)
    return (x != "") & (y != "") & (x.contains(y) | y.contains(x))


def orphan_tier(heading_score: Column, tfidf: Column, embedding: Column, contained: Column) -> Column:
    """On what two subsections without a partner are the same: heading, body or both; null if on nothing."""
    by_heading = (heading_score >= HEADING_STRONG) | (contained & (heading_score >= HEADING_CONTAINED))
    return (
        F.when(by_heading, "deterministic_heading")
        .when((embedding >= BODY_EMBEDDING) & (tfidf >= BODY_TFIDF), "deterministic_embedding")
        .when((heading_score >= HEADING_HYBRID) & ((tfidf >= HYBRID_TFIDF) | (embedding >= HYBRID_EMBEDDING)), "deterministic_hybrid")
    )


def matched_orphans(candidates: DataFrame) -> DataFrame:
    """Candidates ``(block, left, right, tfidf, embedding)``, headings on both sides, one to one by tier and scores."""
    scored = candidates.withColumn("heading_score", sequence_ratio(heading_key(F.col("left")), heading_key(F.col("right"))))
    tier = orphan_tier(F.col("heading_score"), F.col("tfidf"), F.col("embedding"), one_contains_other(F.col("left"), F.col("right")))
    rows = scored.withColumn("match_source", tier).where("match_source is not null")
    rank = F.when(F.col("match_source") == "deterministic_heading", 3).when(F.col("match_source") == "deterministic_embedding", 2).otherwise(1)
    return one_to_one(rows, [rank, F.col("embedding"), F.col("tfidf"), F.col("heading_score")])


def subsection_changes(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Whole subsections that came, went or were renamed, of pairs as ``paired_subsections`` gives them."""
    gone, new = F.col("heading_t2").isNull(), F.col("heading_t1").isNull()
    renamed = ~gone & ~new & (squeezed(F.col("heading_t1")) != squeezed(F.col("heading_t2")))
    kind = F.when(new, "added").when(gone, "removed").when(renamed, "renamed")
    rows = pairs.withColumn("diff_type", kind).where("diff_type is not null")
    summary = F.when(F.col("diff_type") == "added", F.concat(F.lit("Sous-section ajoutée: "), F.col("heading_t2"))).when(F.col("diff_type") == "removed", F.concat(F.lit("Sous-section supprimée: "), F.col("heading_t1"))).otherwise(F.concat(F.lit("Sous-section renommée: "), F.col("heading_t1"), F.lit(" -> "), F.col("heading_t2")))
    heading = F.when(F.col("diff_type") == "renamed", F.concat_ws(" → ", "heading_t1", "heading_t2")).otherwise(F.coalesce("heading_t2", "heading_t1"))
    return rows.select(*by, "diff_type", heading.alias("subsection_heading"), summary.alias("change_summary"), "body_t1", "body_t2")


def residual(text: Column, fragments: Column) -> Column:
    """A text without the fragments that it holds, each at its first place, the rest trimmed and joined by a space.

    Places are taken from the text as it is, so a fragment may lie across another.
    """
    t = blank(text)
    spans = F.filter(F.transform(F.filter(fragments, lambda f: blank(f) != ""), lambda f: F.struct(F.instr(t, f).alias("s"), (F.instr(t, f) + F.length(f)).alias("e"))), lambda x: x["s"] > 0)
    spans = F.array_sort(spans)
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("kept"))

    def step(a: Column, x: Column) -> Column:
        piece = F.trim(t.substr(a["at"], F.greatest(x["s"] - a["at"], F.lit(0))))
        return F.struct(F.greatest(a["at"], x["e"]).cast("int").alias("at"), F.when((x["s"] > a["at"]) & (piece != ""), F.concat(a["kept"], F.array(piece))).otherwise(a["kept"]).alias("kept"))

    done = F.aggregate(spans, start, step)
    tail = F.trim(t.substr(done["at"], F.length(t)))
    return F.trim(F.array_join(F.when(tail != "", F.concat(done["kept"], F.array(tail))).otherwise(done["kept"]), " "))
