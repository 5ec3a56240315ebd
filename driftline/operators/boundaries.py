"""Where the sections of a report begin and end, from its table of contents and, where that says too little, from titles.

Entries are rows ``(by, concept, title, page)``: a line of the contents with the section that it names (null for none), its
title's key and its physical page. Everything is grouped aggregates and windows by report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.operators.sections import consensus

# From this page on is the body of a report; least confidence in contents; starts this near are ambiguous.
BODY, MIN_CONFIDENCE, NEAR = 45, 0.55, 3
#: Titles that stand inside a section and end none.
NESTED = r"^risque\s+|faits?\s+nouveaux?\s+en\s+matiere\s+de\s+reglementation"
#: The section whose own name in a later title does not end it.
RISKS, RISK_TITLE = "gestion_risques", "gestion des risques"


def compact(title: Column) -> Column:
    return F.regexp_replace(F.lower(title), "[^a-z0-9]", "")


def specificity(title: Column, starts: Column) -> Column:
    """How well a title fits one of the titles under which a section begins: 3 the same, 2 a part of it or more, 0 not."""
    same = F.exists(starts, lambda s: (s != "") & ((title == s) | (compact(title) == compact(s))))
    near = F.exists(starts, lambda s: (s != "") & ((s.startswith(title) & (F.length(title) >= 18)) | title.contains(s)))
    return F.when(F.coalesce(same, F.lit(False)), 3).when(F.coalesce(near, F.lit(False)), 2).otherwise(0)


def concept_hits(entries: DataFrame, by: list[str], starts: DataFrame) -> DataFrame:
    """The entry at which each section begins: ``(by, concept, title, page)``, one a section.

    ``starts`` are ``(concept, starts)``. Entries in the body of the report come first; early ones count where there are no
    others, and only if one of them is not merely the beginning of a known title. Of these the best title counts, then
    the last page, then a title of at most 70 letters, then the first title by order.
    """
    rows = entries.where("concept is not null and page is not null").join(starts, "concept", "left")
    rows = rows.withColumn("starts", F.coalesce("starts", F.array().cast("array<string>")))
    known = F.exists("starts", lambda s: (s != "") & ((F.col("title") == s) | (compact(F.col("title")) == compact(s)) | F.col("title").contains(s)))
    whole = (F.size(F.filter("starts", lambda s: s != "")) == 0) | known
    rank = F.struct(specificity(F.col("title"), F.col("starts")).alias("fit"), "page", (F.length("title") <= 70).alias("short"))
    rows = rows.withColumns({"body": F.col("page") >= BODY, "whole": F.coalesce(whole, F.lit(False)), "rank": rank})
    # Of equal ranks the title that is first by its letters; min_by over a negative rank has no such tie.
    w = Window.partitionBy(*by, "concept").orderBy(F.desc("body"), F.desc("rank"), "title")
    any_whole = F.max("whole").over(Window.partitionBy(*by, "concept"))
    found = rows.withColumns({"n": F.row_number().over(w), "any_whole": any_whole}).where("n = 1 and (body or any_whole)")
    return found.select(*by, "concept", "title", "page")


def bounds(hits: DataFrame, entries: DataFrame, by: list[str], nested: str = NESTED) -> DataFrame:
    """Sections ``(by, concept, title, page, end_page, end_title)``: each ends before the next one begins.

    The last of a report ends before the first later entry that neither names it again nor has a title of what stands
    inside it; without one its end is null.
    """
    w = Window.partitionBy(*by).orderBy("page", "concept")
    rows = hits.withColumns({"next_page": F.lead("page").over(w), "next_title": F.lead("title").over(w)})
    last = rows.where("next_page is null").select(*by, F.col("concept").alias("last_concept"), F.col("page").alias("last_page"))
    later = entries.select(*by, "concept", "title", "page").join(last, by).where((F.col("page") > F.col("last_page")) & ~F.col("title").rlike(nested) & ~F.coalesce(F.col("concept") == F.col("last_concept"), F.lit(False)))
    later = later.where(~((F.col("last_concept") == RISKS) & F.col("title").contains(RISK_TITLE)))
    after = later.groupBy(*by).agg(F.min(F.struct("page", "title")).alias("after"))
    rows = rows.join(after, by, "left")
    end, title = F.coalesce("next_page", F.when(F.col("next_page").isNull(), F.col("after.page"))), F.coalesce("next_title", F.when(F.col("next_page").isNull(), F.col("after.title")))
    return rows.select(*by, "concept", "title", "page", (end - 1).alias("end_page"), title.alias("end_title"))


def resolved(reports: DataFrame, found: DataFrame, by: list[str], concepts: list[str], titles: DataFrame) -> DataFrame:
    """Sections of every report with start, end and the ways in which they were found.

    ``reports`` are ``(by, confidence, has_anchor, total_pages)``, ``found`` what ``bounds`` gives, ``titles`` what a search
    for titles gives: ``(by, concept, title, page, end_page, end_method)``. The contents count where they are sure enough
    and anchored; sections that they lack are taken from the titles. An end that is missing or reaches into the next
    section is set before it; a section from the contents also ends where its own title's end is earlier. ``ambiguous``
    says that the next section begins within three pages. A section that neither has comes with nulls as ``unresolved``.
    """
    sure = F.coalesce((F.col("confidence") >= MIN_CONFIDENCE) & F.col("has_anchor"), F.lit(False))
    wanted = reports.select(*by, "total_pages", sure.alias("sure"), F.explode(F.array(*map(F.lit, concepts))).alias("concept"))
    toc = found.select(*by, "concept", F.struct("title", "page", "end_page").alias("toc"))
    alt = titles.select(*by, "concept", F.struct("title", "page", "end_page", "end_method").alias("alt"))
    rows = wanted.join(toc, [*by, "concept"], "left").join(alt, [*by, "concept"], "left")
    # Contents count as a whole only if they have a section at all.
    use = F.col("sure") & F.col("toc").isNotNull()
    pick = lambda c: F.when(use, F.col(f"toc.{c}")).otherwise(F.col(f"alt.{c}"))
    rows = rows.select(*by, "concept", "total_pages", "alt", use.alias("from_toc"), pick("title").alias("title"), pick("page").alias("page"), pick("end_page").alias("end"))
    rows = rows.withColumn("method", F.when(F.col("from_toc"), "contents").when(F.col("page").isNotNull(), "title").otherwise("unresolved"))
    w = Window.partitionBy(*by, F.col("page").isNull()).orderBy("page", "concept")
    rows = rows.withColumn("next", F.when(F.col("page").isNotNull(), F.lead("page").over(w)))
    reaches = F.col("next").isNotNull() & (F.col("end").isNull() | (F.col("end") >= F.col("next")))
    end = F.when(reaches, F.col("next") - 1).otherwise(F.col("end"))
    way = F.when(reaches, "next_section").when(F.col("end").isNull() & F.col("page").isNotNull(), "no_successor").when(F.col("from_toc"), "contents").otherwise(F.col("alt.end_method"))
    rows = rows.withColumns({"_end": end, "_way": way})
    own = F.col("alt.end_page")
    tighter = F.col("from_toc") & own.isNotNull() & (own <= F.coalesce(F.col("next") - 1, own)) & (F.col("_end").isNull() | (own < F.col("_end")))
    return rows.select(
        *by, "concept", "title", "page", F.when(tighter, own).otherwise(F.col("_end")).alias("end_page"), "method", F.when(tighter, F.col("alt.end_method")).otherwise(F.col("_way")).alias("end_method"),
        F.coalesce(F.col("next") - F.col("page") <= NEAR, F.lit(False)).alias("ambiguous"),
    )


#: How much a source's pages weigh, and shortest and longest sections.
SOURCES = {"section": 1.0, "toc": 0.8, "scan": 0.6}
SHORTEST, LONGEST = 3, 50


def medians(detections: DataFrame, by: list[str]) -> DataFrame:
    """Weighted medians of start and end pages by ``by``: the first page by which half of the weight is reached.

    ``detections`` are ``(by, source, start_page, end_page)``; a missing page weighs nothing, a table of contents says
    nothing of ends.
    """
    weight = F.coalesce(*(F.when(F.col("source") == s, w) for s, w in SOURCES.items()), F.lit(0.0))
    out = None
    for page in ("start_page", "end_page"):
        known = detections.withColumn("w", weight).where(F.col(page).isNotNull() & (F.lit(True) if page == "start_page" else F.col("source") != "toc"))
        so_far = F.sum("w").over(Window.partitionBy(*by).orderBy(page).rangeBetween(Window.unboundedPreceding, 0))
        half = F.sum("w").over(Window.partitionBy(*by)) / 2
        # A hair below the half, since sums of tenths are not exact.
        found = known.withColumns({"so_far": so_far, "half": half}).where(F.col("so_far") >= F.col("half") - 1e-9).groupBy(*by).agg(F.min(page).alias(f"median_{page}"))
        out = found if out is None else out.join(found, by, "full")
    return out


def cross_validated(sections: DataFrame, detections: DataFrame, by: list[str]) -> DataFrame:
    """Sections ``(by, start_page, end_page, confidence, keep_bounds, content_score, content_valid)`` judged by all sources.

    ``detections`` hold what every source says of a section, the section's own row among them, in the same pages. Agreement
    over 0.7 adds 0.2 to the confidence; under 0.5 it costs 0.3, and the pages become the weighted medians unless
    ``keep_bounds``, with a confidence of 0.7 at most where that changes them. Then the content adds a tenth of its score
    or, if it is not valid, costs 0.4.
    """
    agreed, middle = consensus(detections, by, SOURCES), medians(detections, by)
    rows = sections.join(agreed, by, "left").join(middle, by, "left")
    score, c = F.coalesce("consensus", F.lit(0.0)), F.col("confidence")
    start, end = F.coalesce("median_start_page", "start_page"), F.coalesce("median_end_page", "end_page")
    moved = (score < 0.5) & ~F.coalesce("keep_bounds", F.lit(False)) & ~(start.eqNullSafe(F.col("start_page")) & end.eqNullSafe(F.col("end_page")))
    first = F.when(score > 0.7, F.least(F.lit(1.0), c + 0.2)).when(moved, F.least(c, F.lit(0.7))).when(score < 0.5, F.greatest(F.lit(0.0), c - 0.3)).otherwise(c)
    last = F.when(F.coalesce("content_valid", F.lit(False)), F.least(F.lit(1.0), first + 0.1 * F.coalesce("content_score", F.lit(0.0)))).otherwise(F.greatest(F.lit(0.0), first - 0.4))
    return rows.select(*by, F.when(moved, start).otherwise(F.col("start_page")).alias("start_page"), F.when(moved, end).otherwise(F.col("end_page")).alias("end_page"), last.alias("confidence"), score.alias("consensus"), moved.alias("is_corrected"))


def suspicious(start: Column, end: Column, total_pages: Column, shortest: int = SHORTEST, longest: int = LONGEST) -> Column:
    """Whether bounds can't be right: missing, too short or long, or more than four fifths of the report."""
    length = end - start + 1
    missing = F.coalesce(start, F.lit(0)) == 0
    missing = missing | (F.coalesce(end, F.lit(0)) == 0)
    return missing | F.coalesce((length < shortest) | (length > longest), F.lit(True)) | F.coalesce((total_pages > 0) & (length > total_pages * 0.8), F.lit(False))
