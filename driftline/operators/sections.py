"""Where sections of a report begin and end: tables of contents, titles on pages, votes, intervals and windows.

Pages are rows ``(by, page, text)``; ``by`` names a report. Titles of the sections looked for come as a table
``(section, name)`` or as regular expressions by section, so that no list of names is built in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.text import blank, folded, squeezed

# What lines of a table of contents look like, and what its page holds.
NUMBER_TITLE = r"(?U)(\d{1,3})\s+(\p{L}[^0-9]+?)(?=\s+\d{1,3}\s+\p{Lu}|\s*$)"
TITLE_NUMBER = r"(?U)(\p{L}[^0-9]{2,}?)\s+(\d{1,3})(?=\s+\p{L}|\s*$)"
PAGE_AT_END = r"(\d{1,3})(?:\s*[-–]\s*\d{1,3})?\s*$"
STRONG_MARKERS = r"table\s+des\s+matieres|table\s+of\s+contents|\bcontents\b"
SOFT_MARKERS = r"\bsommaire\b|rapport\s+de\s+gestion|guide\s+du\s+lecteur"
ENTRY = "array<struct<title: string, page: int, level: int>>"


def _key(text: Column) -> Column:
    return squeezed(F.lower(folded(text)))


def toc_entries(line: Column, max_pages: int = 200) -> Column:
    """The entries of a line of a table of contents: several columns of them, one with its page behind or before, or none.

    Pages under 3 and over ``max_pages`` and titles of under three letters are no entries. An indented line or one that
    starts with a small letter is of level 1.
    """
    t = blank(line)
    page = lambda c: c.try_cast("int")
    clean = lambda c: F.regexp_replace(F.regexp_replace(F.trim(c), r"\.+$", ""), r"\s{2,}", " ")
    good = lambda e: (e["page"] >= 3) & (e["page"] <= max_pages) & (F.length(e["title"]) >= 3)

    def columns(pattern: str, title: int, number: int) -> Column:
        titles, pages = F.regexp_extract_all(t, F.lit(pattern), F.lit(title)), F.regexp_extract_all(t, F.lit(pattern), F.lit(number))
        return F.filter(F.zip_with(titles, pages, lambda x, n: F.struct(clean(x).alias("title"), page(n).alias("page"), F.lit(0).alias("level"))), good)

    first, second = columns(NUMBER_TITLE, 2, 1), columns(TITLE_NUMBER, 1, 2)
    many = F.when(F.size(first) > 0, first).otherwise(second)
    behind, before = F.regexp_extract(t, PAGE_AT_END, 1), F.regexp_extract(t, r"^(\d{1,3})\s+", 1)
    title = F.when(behind != "", F.regexp_replace(t, PAGE_AT_END, "")).otherwise(F.regexp_replace(t, r"^\d{1,3}\s+", ""))
    title = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(title, r"\.{2,}", " "), "[-–]{2,}", " "), r"\s{2,}", " "))
    level = F.when(t.rlike(r"^(?: {2}|\t)") | ~title.rlike(r"^\p{Lu}"), 1).otherwise(0)
    single = F.filter(F.array(F.struct(title.alias("title"), page(F.when(behind != "", behind).otherwise(before)).alias("page"), level.alias("level"))), good)
    none = F.array().cast(ENTRY)
    return F.coalesce(F.when(F.size(many) >= 2, many.cast(ENTRY)).otherwise(single.cast(ENTRY)), none)


def toc_page_score(page: Column, text: Column, names: list[str] | None = None) -> Column:
    """How much a page looks like a table of contents: markers, place, lines that start or end in a number, names."""
    t = _key(text)
    lines = F.filter(F.transform(F.split(blank(text), "\n"), lambda x: F.trim(x)), lambda x: (F.length(x) >= 5) & (F.length(x) <= 160) & x.rlike(r"\d{1,3}\s*$|^\d{1,3}\s+"))
    points = lambda rule, n: F.when(rule, float(n)).otherwise(0.0)
    score = points(t.rlike(STRONG_MARKERS), 50) + points(t.rlike(SOFT_MARKERS), 20) + points(page.between(10, 25), 10) + points(page.between(15, 20), 20) + F.least(F.size(lines), F.lit(12)) * 3.0
    for name in names or ():
        score = score + points(t.contains(_key(F.lit(name))), 20)
    return F.when(t == "", 0.0).otherwise(score)


def decoy_page(text: Column) -> Column:
    """A page of numbered recommendations that only looks like a table of contents."""
    lines = F.filter(F.transform(F.split(blank(text), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    numbers = F.transform(lines, lambda x: F.regexp_extract(x, r"^(\d{1,3})\b", 1).try_cast("int"))
    found = F.filter(numbers, lambda n: n.isNotNull())
    runs = F.aggregate(found, F.struct(F.lit(-1).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best")), lambda a, n: _longer(a, n))["best"]
    n, size = F.size(found), F.size(lines)
    return (size >= 20) & (((n >= 20) & (runs >= 12)) | ((n >= 24) & (n >= 0.45 * size)))


def _longer(a: Column, n: Column) -> Column:
    run = F.when(n == a["last"] + 1, a["run"] + 1).otherwise(1)
    return F.struct(n.alias("last"), run.alias("run"), F.greatest(a["best"], run).alias("best"))


def sections_in_toc(entries: DataFrame, by: list[str], patterns: dict[str, str], excluded: dict[str, str] | None = None, min_length: int = 5) -> DataFrame:
    """The first entry of each section that a pattern names, to the page before the next main entry of another section.

    ``entries`` are ``(by, title, page, level)``. The next entry is of level 0 and at least ``min_length`` pages on; the
    end is null where there is none.
    """
    title = F.lower(folded(F.col("title")))
    kind = None
    for section, pattern in patterns.items():
        rule = title.rlike(pattern)
        if excluded and section in excluded:
            rule = rule & ~title.rlike(excluded[section])
        kind = F.when(rule, section) if kind is None else kind.when(rule, section)
    rows = entries.withColumn("section", kind)
    starts = rows.where("section is not null").groupBy(*by, "section").agg(F.min_by(F.struct("title", "page"), F.struct("page", "title")).alias("s"))
    starts = starts.select(*by, "section", F.col("s.title").alias("title_found"), F.col("s.page").alias("start_page"))
    mains = rows.where("level = 0").select(*by, F.col("section").alias("_other"), F.col("page").alias("_page"))
    later = starts.join(mains, by).where((F.col("_page") >= F.col("start_page") + min_length) & ~F.col("section").eqNullSafe(F.col("_other")))
    ends = later.groupBy(*by, "section").agg((F.min("_page") - 1).alias("end_page"))
    return starts.join(ends, [*by, "section"], "left")


def start_near(pages: DataFrame, by: list[str], estimates: DataFrame, names: DataFrame, first_page: int = 6) -> DataFrame:
    """The first page near an estimate with a line that is the section's name: two before to four after, else six to eight.

    ``estimates`` are ``(by, section, estimated_page)``, ``names`` ``(section, name)``. Pages before ``first_page`` are
    the table of contents. Null where no page has it.
    """
    lines = pages.select(*by, "page", F.explode(F.split("text", "\n")).alias("line")).select(*by, "page", _key(F.col("line")).alias("key")).where("key <> ''")
    titled = lines.join(names.select("section", _key(F.col("name")).alias("key")), "key").select(*by, "section", "page").distinct()
    near = estimates.join(titled.where(F.col("page") >= first_page), [*by, "section"], "left")
    gap = F.col("page") - F.col("estimated_page")
    narrow, wide = F.min(F.when(gap.between(-2, 4), F.col("page"))), F.min(F.when(gap.between(-6, 8), F.col("page")))
    return near.groupBy(*by, "section", "estimated_page").agg(F.coalesce(narrow, wide).alias("start_page"))


def ended(sections: DataFrame, by: list[str], total_pages: str = "total_pages") -> DataFrame:
    """Sections with their end: given, scanned, before the next one, from the table of contents, or by default length.

    ``sections`` have ``start_page`` and the columns ``end_given``, ``end_scanned``, ``end_toc`` (null where unknown)
    and ``default_length``; the first that is known counts, and never lies before the start.
    """
    nxt = F.lead("start_page").over(Window.partitionBy(*by).orderBy("start_page", "section")) - 1
    by_default = F.least(F.col(total_pages), F.col("start_page") + F.col("default_length") - 1)
    rows = sections.withColumn("_next", nxt)
    end = F.coalesce("end_given", "end_scanned", "_next", "end_toc", by_default)
    method = F.when(F.col("end_given").isNotNull(), "given").when(F.col("end_scanned").isNotNull(), "scan").when(F.col("_next").isNotNull(), "next_section").when(F.col("end_toc").isNotNull(), "toc").otherwise("default_length")
    return rows.withColumns({"end_page": F.greatest(end, F.col("start_page")), "end_method": method}).drop("_next")


def constrained(start: Column, end: Column, total: Column, least: Column, most: Column, default: Column) -> Column:
    """An interval of at least ``least`` and at most ``most`` pages within the report, with its spans and the reason."""
    first = F.coalesce(end, F.least(total, start + default - 1))
    span = F.greatest(first - start + 1, F.lit(1))
    longer = F.when(span < least, F.least(total, start + least - 1)).otherwise(first)
    now = F.greatest(longer - start + 1, F.lit(1))
    last = F.when(now > most, F.least(total, start + most - 1)).otherwise(longer)
    text = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in p])
    why = F.concat_ws("; ", F.when(end.isNull(), text("end_missing->default_", default)), F.when(span < least, text("min_enforced_", span, "->", least)), F.when(now > most, text("max_enforced_", now, "->", most)))
    return F.struct(last.alias("end_page"), span.alias("detected_span"), F.greatest(last - start + 1, F.lit(1)).alias("final_span"), F.nullif(why, F.lit("")).alias("reason"))


def page_offset(pages: DataFrame, by: list[str], entries: DataFrame, configured: int = 0, largest: int = 20, top_lines: int = 12, anchors: int = 2) -> DataFrame:
    """By how much printed pages differ from physical ones: each entry votes once, for the page whose top holds its title.

    Of several pages the one closest to the configured offset counts. The winner needs six tenths of the votes, no tie
    and ``anchors`` votes (one, if it is the only vote and for the configured offset); else the configured one stays.
    """
    top = pages.select(*by, "page", F.slice(F.split("text", "\n"), 1, top_lines).alias("lines")).select(*by, F.col("page").alias("physical"), F.explode("lines").alias("line")).select(*by, "physical", _key(F.col("line")).alias("key"))
    asked = entries.where("page >= 3").select(*by, "title", "page", _key(F.col("title")).alias("key")).where(F.length(F.regexp_replace("key", "[^a-z0-9]", "")) >= 8)
    offset = F.col("physical") - F.col("page")
    hits = asked.join(top, [*by, "key"]).withColumn("offset", offset).where(F.col("offset").between(0, largest))
    one = hits.groupBy(*by, "title", "page").agg(F.min_by("offset", F.struct(F.abs(F.col("offset") - configured), F.col("offset"))).alias("offset"))
    votes = one.groupBy(*by, "offset").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by)
    ranked = votes.withColumns({"all": F.sum("n").over(w), "place": F.row_number().over(w.orderBy(F.desc("n"), F.abs(F.col("offset") - configured), "offset")), "second": F.coalesce(F.lead("n").over(w.orderBy(F.desc("n"), F.abs(F.col("offset") - configured), "offset")), F.lit(0))})
    best = ranked.where("place = 1")
    ratio = F.col("n") / F.col("all")
    enough = (F.col("n") >= anchors) | ((F.col("all") == 1) & (F.col("offset") == configured))
    sure = (F.col("second") < F.col("n")) & (ratio >= 0.6) & enough
    found = best.select(*by, F.when(sure, F.col("offset")).otherwise(configured).alias("offset"), F.round(ratio, 3).alias("confidence"), F.when(~sure, "ambiguous").when(F.col("offset") == configured, "confirmed").otherwise("inferred_override").alias("status"))
    whole = pages.select(*by).distinct().join(found, by, "left")
    return whole.select(*by, F.coalesce("offset", F.lit(configured)).alias("offset"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("status", F.lit("configured_no_anchor")).alias("status"))


def consensus(detections: DataFrame, by: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """Agreement of several detections ``(by, source, start_page, end_page)`` on a section's pages.

    One minus a tenth of the weighted variance, 0.55 for a single source; starts count six, ends four tenths.
    """
    weights = weights or {"section": 1.0, "toc": 0.8, "scan": 0.6}
    weight = F.coalesce(*(F.when(F.col("source") == s, w) for s, w in weights.items()), F.lit(0.6))
    rows = detections.withColumn("w", weight)

    def agreed(column: str) -> tuple[Column, ...]:
        x, w = F.col(column).cast("double"), F.when(F.col(column).isNotNull(), F.col("w"))
        return F.count(column).alias(f"n_{column}"), F.sum(w).alias(f"w_{column}"), F.sum(w * x).alias(f"x_{column}"), F.sum(w * x * x).alias(f"xx_{column}")

    out = rows.groupBy(*by).agg(*agreed("start_page"), *agreed("end_page"))

    def value(c: str) -> Column:
        mean = F.col(f"x_{c}") / F.col(f"w_{c}")
        variance = F.greatest(F.col(f"xx_{c}") / F.col(f"w_{c}") - mean * mean, F.lit(0.0))
        return F.when(F.col(f"n_{c}") == 1, 0.55).otherwise(1 - F.least(variance / 10, F.lit(1.0)))

    start, end = F.when(F.col("n_start_page") > 0, value("start_page")), F.when(F.col("n_end_page") > 0, value("end_page"))
    return out.select(*by, F.coalesce(start * 0.6 + end * 0.4, start, end, F.lit(0.0)).alias("consensus"))


def toc_quality(entries: DataFrame, found: DataFrame, by: list[str], total_pages: Column, expected: int = 2) -> DataFrame:
    """How far a table of contents is to be trusted: entries, sections found, and the span of their pages."""
    n = entries.groupBy(*by).agg(F.count("*").alias("n"))
    s = found.groupBy(*by).agg(F.countDistinct("section").alias("n_sections"), (F.max("start_page") - F.min("start_page") + 1).alias("span"))
    rows = n.join(s, by, "left")
    score = 0.4 * F.least(F.col("n") / 25.0, F.lit(1.0)) + 0.4 * F.coalesce(F.col("n_sections") / expected, F.lit(0.0)) + F.coalesce(0.2 * F.least(F.col("span") / F.greatest(total_pages, F.lit(1)) * 2.0, F.lit(1.0)), F.lit(0.0))
    return rows.select(*by, F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)).alias("quality"))


def padded(ranges: DataFrame, by: list[str], padding: int) -> DataFrame:
    """Page ranges from page 1 on, no end before its start, widened on both sides."""
    start = F.greatest(F.col("start_page"), F.lit(1))
    end = F.greatest(F.col("end_page"), start)
    pad = max(0, padding)
    return ranges.select(*by, F.greatest(start - pad, F.lit(1)).alias("start_page"), (end + pad).alias("end_page"))


def pages_within(pages: DataFrame, ranges: DataFrame, by: list[str], size: int = 16) -> DataFrame:
    """Pages that lie in any of their report's ranges, each once; ranges meet pages in bins of ``size`` pages."""
    bin_ = lambda c: F.floor(F.col(c) / size)
    binned = ranges.select(*by, "start_page", "end_page", F.explode(F.sequence(bin_("start_page"), bin_("end_page"))).alias("_bin"))
    rows = pages.withColumn("_bin", bin_("page"))
    hit = rows.join(binned, [*by, "_bin"]).where(F.col("page").between(F.col("start_page"), F.col("end_page"))).select(*by, "page").distinct()
    return pages.join(hit, [*by, "page"], "left_semi")


def section_window(page: Column, start: Column, end: Column, anchor: Column, next_start: Column, next_anchor: Column, end_anchor: Column) -> Column:
    """Top and bottom of a section on a page: below its title on the first, above the next one's title on the last.

    Anchors are boxes of titles on the first page of a section, the next one's, and what ends a section, or null.
    """
    top = F.when((page == start) & anchor.isNotNull(), F.greatest(F.lit(0.0), anchor[3])).otherwise(0.0)
    shared = (page == end) & (end == next_start) & next_anchor.isNotNull()
    bottom = F.when(shared, F.least(F.lit(1.0), next_anchor[1])).when((page == end) & end_anchor.isNotNull(), F.least(F.lit(1.0), end_anchor[1])).otherwise(1.0)
    return F.struct(top.alias("top"), F.when(bottom <= top, 1.0).otherwise(bottom).alias("bottom"))


def footnote_zones(tables: DataFrame, by: list[str], box: str, height: float = 0.14) -> DataFrame:
    """The strip under each table of a page, down to the next one below or ``height``, as ``zone``; none where there is no room."""
    b = F.col(box)
    top = F.lead(b[1]).over(Window.partitionBy(*by).orderBy(b[1], b[0]))
    low = F.least(b[3] + height, F.coalesce(F.when(top > b[3], top), F.lit(1.0)), F.lit(1.0))
    rows = tables.withColumn("_low", low)
    return rows.withColumn("zone", F.when(F.col("_low") > b[3], F.array(b[0], b[3], b[2], F.col("_low")))).drop("_low")


def crop_room(tables: DataFrame, by: list[str], box: str, top: float = 0.02, bottom: float = 0.06) -> DataFrame:
    """How far a crop may reach beyond each table: the given room, or half the gap to a neighbour that is closer."""
    b, w = F.col(box), Window.partitionBy(*by).orderBy(F.col(box)[1], F.col(box)[0])
    above, below = F.lag(b[3]).over(w), F.lead(b[1]).over(w)
    room = lambda gap, most: F.greatest(F.least(F.coalesce(gap / 2, F.lit(most)), F.lit(most)), F.lit(0.0))
    return tables.withColumns({"top_room": F.least(room(b[1] - above, top), b[1]), "bottom_room": F.least(room(below - b[3], bottom), 1 - b[3])})


def next_sections(sections: DataFrame, by: list[str]) -> DataFrame:
    """Sections in order of page, height and key, with the next one's key and page."""
    w = Window.partitionBy(*by).orderBy("start_page", "y", "section")
    return sections.withColumns({"ordinal": F.row_number().over(w), "next_section": F.lead("section").over(w), "next_page": F.lead("start_page").over(w)})


def assigned_segments(segments: DataFrame, by: list[str], opens: Column, closes: Column) -> DataFrame:
    """Segments in order with the section they are in: the last one opened, null once it is closed for good.

    ``opens`` is the section that a segment's heading opens, ``closes`` the one that it ends; a section that was closed
    does not open again.
    """
    w = Window.partitionBy(*by).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    rows = segments.withColumns({"_opens": opens, "_closes": closes})
    shut = rows.where("_closes is not null").groupBy(*by, F.col("_closes").alias("section")).agg(F.min("position").alias("_shut"))
    rows = rows.withColumn("section", F.last("_opens", ignorenulls=True).over(w)).join(shut, [*by, "section"], "left")
    return rows.withColumn("section", F.when(F.col("_shut").isNull() | (F.col("position") < F.col("_shut")), F.col("section"))).drop("_opens", "_closes", "_shut")


def missing_blocks(blocks: DataFrame, rendered: DataFrame, by: list[str]) -> DataFrame:
    """Blocks whose key is nowhere in the text that was rendered; headings and captions may be left out."""
    key = F.regexp_replace(_key(F.col("text")), "[^a-z0-9]", "")
    whole = rendered.select(*by, F.regexp_replace(_key(F.col("markdown")), "[^a-z0-9]", "").alias("_whole"))
    rows = blocks.where(~F.col("kind").isin("heading", "caption")).withColumn("_key", key).where("_key <> ''").join(whole, by, "left")
    return rows.where(~F.coalesce(F.col("_whole").contains(F.col("_key")), F.lit(False))).drop("_key", "_whole")


def x_clusters(xs: Column, tolerance: float = 0.06) -> Column:
    """How many groups the left edges of a page's blocks form: a value joins a group within ``tolerance`` of its mean."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0).alias("size"))

    def step(a: Column, x: Column) -> Column:
        same = (a["size"] > 0) & (F.abs(x - a["mean"]) <= tolerance)
        return F.struct((a["n"] + F.when(same, 0).otherwise(1)).alias("n"), F.when(same, (a["mean"] * a["size"] + x) / (a["size"] + 1)).otherwise(x).alias("mean"), F.when(same, a["size"] + 1).otherwise(1).alias("size"))

    return F.aggregate(F.sort_array(xs), start, step)["n"]


def interpolated_page(events: DataFrame, pairs: DataFrame, by: list[str]) -> DataFrame:
    """The page on the other side that an event's page comes to: between the pairs before and after it, in proportion.

    ``events`` are ``(by, event, page)``, ``pairs`` ``(by, page, other_page)``: an as-of join on both sides, as one pass
    of windows over both tables. Beyond the first or last pair the distance to it is kept; null without a pair.
    """
    none = F.lit(None)
    rows = events.select(*by, "page", "event", none.cast("int").alias("other_page"), F.lit(1).alias("_k")).unionByName(pairs.select(*by, "page", none.cast(events.schema["event"].dataType).alias("event"), F.col("other_page").cast("int").alias("other_page"), F.lit(0).alias("_k")))
    known = F.when(F.col("_k") == 0, F.struct("page", "other_page"))
    w = Window.partitionBy(*by).orderBy("page", "_k", "other_page")
    back = Window.partitionBy(*by).orderBy("page", F.desc("_k"), "other_page")
    rows = rows.withColumns({"_before": F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_after": F.first(known, True).over(back.rowsBetween(0, Window.unboundedFollowing))})
    as_double = lambda c: F.struct(c["page"].cast("double").alias("page"), c["other_page"].cast("double").alias("other_page"))
    a, b, p = F.when(F.col("_before").isNotNull(), as_double(F.col("_before"))), F.when(F.col("_after").isNotNull(), as_double(F.col("_after"))), F.col("page").cast("double")
    between = F.when(a["page"] == b["page"], a["other_page"]).otherwise(a["other_page"] + (p - a["page"]) * (b["other_page"] - a["other_page"]) / (b["page"] - a["page"]))
    guess = F.coalesce(between, a["other_page"] + p - a["page"], b["other_page"] + p - b["page"])
    return rows.where("_k = 1").select(*by, "event", "page", F.greatest(F.round(guess), F.lit(1)).cast("int").alias("other_page"))
