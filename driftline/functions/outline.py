"""Page marks of a converted text, what a summary says was replaced, and how far a change counts.

Every function works on one row and stays in built-in expressions. Null texts count as empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftline.functions import period
from driftline.functions.text import blank

# A page's mark behind a heading, and how summaries name what was replaced, taken out and put in.
PAGE = r"\s*\[pdf\.(\d+)\]\s*$"
REPLACED = r"(?iu)\"([^\"]+)\"\s*(?:par|en|à|remplacé par|modifié en)\s*\"([^\"]+)\""
TAKEN_OUT = r"(?iu)(?:passage(?: de sous-section)? supprimé|suppression(?: de sous-section)?)\s*:\s*([^\n.]+)"
PUT_IN = r"(?iu)(?:passage(?: de sous-section)? ajouté|ajout(?: de sous-section)?)\s*:\s*([^\n.]+)"
#: Reasons by which a change counts for less, and the lists of a compared pair.
SECONDARY = ["deplacement_texte", "formatage_visuel", "mise_a_jour_calendrier", "operation_interne_banque", "reformulation_mineure", "variation_numerique_propre_banque"]
DIFFS = ["indicators_added", "indicators_removed", "indicators_renamed", "footnotes_added", "footnotes_removed", "footnotes_renamed"]


def inline_page(line: Column) -> Column:
    """The page named at the end of a line; null if there is none."""
    return F.nullif(F.regexp_extract(blank(line), PAGE, 1), F.lit("")).cast("int")


def without_page_marks(text: Column) -> Column:
    """A text without lines that only name a page, and without the pages behind headings of two and three signs."""
    bare = lambda l: F.trim(F.regexp_replace(l, PAGE, ""))

    def line(l: Column) -> Column:
        head = lambda mark: F.concat(F.lit(mark), bare(F.substring(l, len(mark) + 1, 1_000_000)))
        return F.when(l.startswith("### "), head("### ")).when(l.startswith("## "), head("## ")).otherwise(l)

    lines = F.transform(F.split(blank(text), "\r\n|\r|\n"), lambda l: F.rtrim(l))
    return F.array_join(F.transform(F.filter(lines, lambda l: ~F.trim(l).rlike(r"^\[pdf\.\d+\]\s*$")), line), "\n")


def replacement(summary: Column) -> Column:
    """``term_replace:a->b``, ``section_del:a`` or ``section_add:a``, the first that a summary says; empty for none."""
    s = blank(summary)
    part = lambda pattern, k: F.lower(F.trim(F.regexp_extract(s, pattern, k)))
    return (
        F.when(s.rlike(REPLACED), F.concat(F.lit("term_replace:"), part(REPLACED, 1), F.lit("->"), part(REPLACED, 2)))
        .when(s.rlike(TAKEN_OUT), F.concat(F.lit("section_del:"), part(TAKEN_OUT, 1)))
        .when(s.rlike(PUT_IN), F.concat(F.lit("section_add:"), part(PUT_IN, 1)))
        .otherwise("")
    )


def scope(diff_type: Column, decision: Column, source: Column, exclusion: Column, relevant: Column, new_idea: Column, secondary: list[str] = SECONDARY) -> Column:
    """``hidden``, ``secondary`` or ``qualitative``; ``relevant`` and ``new_idea`` are null where nobody judged."""
    same = lambda c, v: F.lower(F.trim(blank(c))) == v
    minor = F.lower(F.trim(blank(exclusion))).isin(secondary) | same(decision, "moved_text")
    counts = F.coalesce(relevant, F.lit(False)) | F.coalesce(new_idea, F.lit(False)) | (relevant.isNull() & new_idea.isNull())
    return F.when(same(diff_type, "unchanged") | same(source, "skip"), "hidden").when(minor, "secondary").when(counts, "qualitative").otherwise("secondary")


def changed(status: Column, added: Column, removed: Column, modified: Column) -> Column:
    """Whether a compared table changed: its status, or the count of a kind of note."""
    return (F.coalesce(status, F.lit("stable")) != "stable") | reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(0)) != 0 for c in (added, removed, modified)])


def meaningful(level: Column, diffs: list[Column]) -> Column:
    """Whether a pair is worth a look: its level, or one of its ``DIFFS`` with an entry."""
    return ~F.coalesce(level, F.lit("inchange")).isin("inchange", "stable") | reduce(lambda a, b: a | b, [F.coalesce(F.size(d), F.lit(0)) > 0 for d in diffs])


def quarter_context(current: Column, previous: Column | None = None) -> Column:
    """Both periods of a comparison with their labels; the earlier one is the comparable one where none is given."""
    ref = period.parse_quarter_ref(current)
    y, q = ref["year"], ref["quarter"]
    py, pq = period.previous_year(y, q), period.previous_quarter(q)
    if previous is not None:
        given, own = F.trim(blank(previous)) != "", period.parse_quarter_ref(previous)
        py, pq = F.when(given, own["year"]).otherwise(py), F.when(given, own["quarter"]).otherwise(pq)

    def side(year: Column, quarter: Column) -> Column:
        return F.struct(quarter.alias("quarter"), year.alias("year"), period.key_label(year, quarter).alias("label"), period.display_label(year, quarter).alias("display_label"))

    vs = lambda label: F.concat(label(y, q), F.lit(" vs "), label(py, pq))
    return F.struct(side(y, q).alias("current"), side(py, pq).alias("previous"), F.lit("current_vs_previous").alias("comparison_direction"), vs(period.key_label).alias("comparison_label"), vs(period.display_label).alias("comparison_display_label"))


def period_folder(value: Column) -> Column:
    """A period as a folder's name: small letters, underscores; null for a blank one."""
    return F.replace(F.nullif(F.lower(F.trim(blank(value))), F.lit("")), F.lit("-"), F.lit("_"))
