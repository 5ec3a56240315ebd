"""Fragments that were moved, cut or joined: pairs across a section, families of them, duplicates and merged rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions import geometry
from driftline.functions.labels import label_key
from driftline.functions.similarity import candidate_score, cosine
from driftline.functions.text import blank, compact_key, let, meaningful_tokens, squeezed
from driftline.operators.alignment import MIN_EMBEDDING, MIN_FRAGMENT, MIN_OVERLAP, MUTUAL, NEAR_BEST, STRONG_EMBEDDING, STRONG_OVERLAP
from driftline.operators import matching
from driftline.operators.graph import connected
from driftline.sources.scratch import written


def one_sided(changes: DataFrame) -> DataFrame:
    """Added and removed changes with enough text as nodes ``(section, node, side, text)``; ``node`` is ``change``'s id."""
    t = F.when(F.col("diff_type") == "removed", F.col("source_text_t1")).when(F.col("diff_type") == "added", F.col("source_text_t2"))
    side = F.when(F.col("diff_type") == "removed", "t1").otherwise("t2")
    rows = changes.where(F.lower("diff_type").isin("added", "removed")).select("section", "node", side.alias("side"), F.trim(blank(t)).alias("text"), *[c for c in ("embedding",) if c in changes.columns])
    return rows.where(F.length("text") >= MIN_FRAGMENT)


def edges(nodes: DataFrame) -> DataFrame:
    """Credible pairs of a removed and an added node of a section: ``(block, a, b, token_overlap, embedding_score, score)``.

    The pairs are found tile by tile in each section, by the overlap of words and by embeddings where there are some.
    """
    key, words = compact_key(F.col("text")), meaningful_tokens(F.col("text"))
    vector = F.col("embedding") if "embedding" in nodes.columns else F.lit(None).cast("array<double>")
    side = F.when(F.col("side") == "t1", "previous").otherwise("current")
    rows = nodes.select(F.col("section").alias("block"), F.col("node").alias("chunk"), side.alias("side"), key.alias("key"), words.alias("named"), vector.alias("vector"))
    rows = written(rows, "nodes")
    # Scores count as rounded, and the rounded one may be the least when the score is just below.
    pairs = matching.overlap_pairs(rows.select("block", "side", "chunk", "key", F.transform("named", lambda w: F.xxhash64(w)).alias("words")), MIN_OVERLAP - 1e-4)
    overlap = pairs.select("block", F.col("left").alias("a"), F.col("right").alias("b"), F.round("score", 4).alias("token_overlap"))
    if "embedding" not in nodes.columns:
        return overlap.where(F.col("token_overlap") >= MIN_OVERLAP).withColumns({"embedding_score": F.lit(0.0), "score": F.col("token_overlap")})
    near = matching.vector_pairs(rows.select("block", "side", "chunk", "vector"), MIN_EMBEDDING)
    of = lambda s, n: rows.where(F.col("side") == s).select("block", F.col("chunk").alias(n), F.col("key").alias(f"{n}k"), F.col("named").alias(f"{n}w"), F.col("vector").alias(f"{n}v"))
    met = overlap.select("block", "a", "b").unionByName(near.select("block", F.col("left").alias("a"), F.col("right").alias("b"))).distinct().join(of("previous", "a"), ["block", "a"]).join(of("current", "b"), ["block", "b"])
    overlap = F.round(candidate_score(F.col("ak"), F.col("bk"), F.col("aw"), F.col("bw")), 4)
    near = F.round(F.coalesce(cosine(F.col("av"), F.col("bv"), 0.0, 1.0), F.lit(0.0)), 4)
    out = met.select("block", "a", "b", overlap.alias("token_overlap"), near.alias("embedding_score"))
    return out.where((F.col("token_overlap") >= MIN_OVERLAP) | (F.col("embedding_score") >= MIN_EMBEDDING)).withColumn("score", F.greatest("token_overlap", "embedding_score"))


def marked(found: DataFrame) -> DataFrame:
    """Edges with ``strength``: strong, mutual_near_best (close to the best of both sides) or retrieval_only."""
    best = lambda side: F.max("score").over(Window.partitionBy("block", side))
    strong = (F.col("token_overlap") >= STRONG_OVERLAP) | (F.col("embedding_score") >= STRONG_EMBEDDING)
    near = (F.col("score") >= MUTUAL) & (F.col("score") >= best("a") - NEAR_BEST) & (F.col("score") >= best("b") - NEAR_BEST)
    return found.withColumn("strength", F.when(strong, "strong").when(near, "mutual_near_best").otherwise("retrieval_only")).withColumn("strong", F.col("strength") == "strong")


def semantic_duplicates(changes: DataFrame, threshold: float = 0.92) -> DataFrame:
    """Changes ``(id, embedding, ...)`` of equal type, decision and shape that are alike, with their group's least id.

    Only changes with the same ``diff_type``, ``alignment_decision`` and sides present are compared. Equal vectors count as
    one, so copies are compared once however many they are; the others meet tile by tile. A change without a vector is
    alone.
    """
    shape = F.concat_ws("|", F.lower(blank(F.col("diff_type"))), F.lower(blank(F.col("alignment_decision"))), (F.trim(blank(F.col("source_text_t1"))) != "").cast("string"), (F.trim(blank(F.col("source_text_t2"))) != "").cast("string"))
    rows = written(changes.select("id", shape.alias("shape"), F.col("embedding").cast("array<double>").alias("embedding")), "shapes")
    usable = rows.where(F.exists("embedding", lambda x: x != 0))
    one = written(usable.groupBy("shape", "embedding").agg(F.min("id").alias("least")), "vectors")
    sides = one.select(F.col("shape").alias("block"), F.explode(F.array(F.lit("previous"), F.lit("current"))).alias("side"), F.col("least").alias("chunk"), F.size("embedding").alias("dim"), F.col("embedding").alias("vector"))
    sides = sides.withColumn("block", F.concat_ws("#", "block", "dim")).drop("dim")
    alike = matching.vector_pairs(sides, threshold, best=0).where((F.col("left") < F.col("right")) & (F.col("score") >= threshold))
    roots = connected(alike.select(F.col("left").alias("a"), F.col("right").alias("b"))).select(F.col("node").alias("least"), "root")
    named = usable.join(one, ["shape", "embedding"]).join(roots, "least", "left").select("id", F.coalesce("root", "least").alias("_group"))
    return rows.select("id").join(named, "id", "left").select("id", F.coalesce("_group", "id").alias("group"))


def propagated(verdicts: DataFrame, groups: DataFrame, columns: list[str]) -> DataFrame:
    """The verdict of each group's representative, its least id, given to all members."""
    first = groups.join(verdicts.select("id", *columns), "id").groupBy("group").agg(F.min_by(F.struct(*columns), "id").alias("v"))
    return groups.join(first, "group", "left").select("id", "group", "v.*", (F.col("id") != F.col("group")).alias("is_propagated"))


def merged_changes(changes: DataFrame, by: list[str], order: str, pages: str = "pages") -> DataFrame:
    """One row a key: the first in order, its pages those of all, sorted, and how many it stands for."""
    rest = [c for c in changes.columns if c not in (*by, pages)]
    one = changes.groupBy(*by).agg(F.min_by(F.struct(*rest), order).alias("r"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce(F.col(pages), F.array().cast("array<int>")))))).alias(pages), F.count("*").alias("n_merged"))
    return one.select(*by, "r.*", pages, "n_merged")


def joined_summaries(changes: DataFrame, by: list[str], order: str, summary: str) -> DataFrame:
    """One row a key, its distinct summaries joined in order."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(summary).alias("s"))))
    return changes.where(F.trim(blank(F.col(summary))) != "").groupBy(*by).agg(F.min(order).alias(order), F.array_join(F.array_distinct(F.transform(parts, lambda p: p["s"])), " ").alias(summary))


def deduped_labels(labels: Column, threshold: float = 0.15) -> Column:
    """Labels without repeats and blanks, their duplicate ratio and how many went; left alone below the threshold."""
    def kept(p: Column) -> Column:
        first = F.filter(p["given"], lambda x, i: (F.get(p["keys"], i) != "") & (F.array_position(p["keys"], F.get(p["keys"], i)) == i + 1))
        return let(first, lambda f: decided(p["given"], f))

    def decided(given: Column, first: Column) -> Column:
        n, m = F.size(given), F.size(first)
        ratio = F.when(n > 0, 1.0 - m / n).otherwise(0.0)
        apply = (ratio >= threshold) & (m < n)
        return F.struct(F.when(apply, first).otherwise(given).alias("labels"), ratio.alias("ratio"), F.when(apply, n - m).otherwise(0).alias("removed"))

    return let(let(F.coalesce(labels, F.array().cast("array<string>")), lambda g: F.struct(g.alias("given"), F.transform(g, squeezed).alias("keys"))), kept)


def label_overlap(a: Column, b: Column) -> Column:
    """Shared keys over the smaller of two arrays of label keys."""
    small = F.least(F.size(a), F.size(b))
    return F.when(small > 0, F.size(F.array_intersect(a, b)) / small).otherwise(0.0)


def label_keys(labels: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.coalesce(labels, F.array().cast("array<string>")), label_key), lambda k: k != ""))


def richness(labels: Column, headers: Column, notes: Column, title: Column) -> Column:
    """How much a table holds: labels, headers, notes, length of its title."""
    size = lambda a: F.greatest(F.size(a), F.lit(0))
    return F.struct(size(labels).alias("labels"), size(headers).alias("headers"), size(notes).alias("notes"), F.length(F.trim(blank(title))).alias("title"))


def richest_tables(tables: DataFrame, page: list[str], key: str, box: str, overlap: float = 0.9, labels: float = 0.8) -> DataFrame:
    """Tables ``(page, key, box, labels, headers, notes, title)`` of a page that are one and the same reduced to the richest.

    Two are the same if their boxes overlap by ``overlap`` of the smaller and their labels by ``labels``; what a chain
    of such pairs connects is one table. ``merged`` counts how many each stands for.
    """
    rows = tables.withColumns({"_node": F.xxhash64(*page, key), "_keys": label_keys(F.col("labels"))})
    side = lambda n: rows.select(*page, F.col("_node").alias(n), F.col(box).alias(f"{n}_box"), F.col("_keys").alias(f"{n}_labels"))
    pairs = side("a").join(side("b"), page).where("a < b")
    same = (geometry.overlap_of_smaller(F.col("a_box"), F.col("b_box")) >= overlap) & (label_overlap(F.col("a_labels"), F.col("b_labels")) >= labels)
    roots = connected(pairs.where(same).select("a", "b"))
    grouped = rows.join(roots.withColumnRenamed("node", "_node"), "_node", "left").withColumn("_root", F.coalesce("root", "_node")).drop("root")
    best = F.struct(richness(F.col("labels"), F.col("headers"), F.col("notes"), F.col("title")), -F.col("_node"))
    w = Window.partitionBy("_root")
    ranked = grouped.withColumns({"merged": F.count("*").over(w), "_rank": F.row_number().over(w.orderBy(F.desc_nulls_last(best)))})
    return ranked.where("_rank = 1").drop("_rank", "_root", "_node", "_keys")


def shorter_titles(entries: DataFrame, page: list[str], title: str, longest: int = 90, least: int = 12) -> DataFrame:
    """Entries of a page without those too long, and without those that hold a shorter one of ``least`` letters or more."""
    key = compact_key(F.col(title))
    rows = entries.where(F.length(title) <= longest).withColumn("_key", key)
    one = rows.groupBy(*page, "_key").agg(F.min(title).alias("_least"))
    rows = rows.join(one, [*page, "_key"]).where(F.col(title) == F.col("_least")).drop("_least").dropDuplicates([*page, "_key"])
    short = rows.where(F.length("_key") >= least).select(*page, F.col("_key").alias("_inner"))
    held = rows.join(short, page).where(F.col("_key").contains(F.col("_inner")) & (F.col("_key") != F.col("_inner"))).select(*page, "_key").distinct()
    return rows.join(held, [*page, "_key"], "left_anti").drop("_key")


def first_titles(entries: DataFrame, by: list[str], title: str, page: str, prefix: int = 30) -> DataFrame:
    """One entry for each opening of a title: the one on the lowest page."""
    key = F.left(squeezed(F.lower(title)), F.lit(prefix))
    rest = [c for c in entries.columns if c not in by]
    return entries.groupBy(*by, key.alias("_key")).agg(F.min_by(F.struct(*rest), F.struct(page, title)).alias("r")).select(*by, "r.*")


def distinct_queries(queries: Column) -> Column:
    """Queries without blanks, once each whatever their case, in order."""
    kept = F.filter(F.transform(queries, lambda q: F.trim(blank(q))), lambda q: q != "")
    keys = F.transform(kept, F.lower)
    return F.filter(kept, lambda q, i: F.array_position(keys, F.lower(q)) == i + 1)
