"""Rows that reports, exports and reviewers read, made of compared tables and text changes.

A compared pair is a row with its ids, titles and arrays of what was added, removed and renamed; a text change is a row
as the rules take it. Nothing here shuffles but where a row is looked up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.labels import date_line, excluded_line, label_key, matching_key
from driftline.functions.text import blank, let, squeezed, truncated_at_sentence, without_controls

EMPTY = "array<string>"


def _array(df: DataFrame, name: str, kind: str = EMPTY) -> Column:
    none = F.array().cast(kind)
    return F.coalesce(F.col(name), none) if name in df.columns else none


def published_types(diff_type: Column, decision: Column | None = None) -> Column:
    """What a change is published as: a modification as a deletion and an addition, a moved text as nothing."""
    moved = F.lit(False) if decision is None else F.lower(blank(decision)) == "moved_text"
    one = lambda *names: F.array(*map(F.lit, names))
    kind = F.lower(blank(diff_type))
    return F.when(moved, F.array().cast(EMPTY)).when(kind == "added", one("Ajout")).when(kind == "removed", one("Suppression")).when(kind == "modified", one("Suppression", "Ajout")).when(kind == "renamed", one("Renommage")).otherwise(F.array().cast(EMPTY))


def text_rows(changes: DataFrame) -> DataFrame:
    """Text changes as export rows, one for each published type, with the text of the side that it is about."""
    decision = F.col("alignment_decision") if "alignment_decision" in changes.columns else None
    rows = changes.withColumn("type", F.explode(published_types(F.col("diff_type"), decision)))
    own = F.when(F.col("type") == "Suppression", F.col("source_text_t1")).when(F.col("type") == "Ajout", F.col("source_text_t2")).otherwise(F.concat_ws(" → ", "source_text_t1", "source_text_t2"))
    return rows.withColumn("text", without_controls(squeezed(own)))


def label_rows(pairs: DataFrame, ids: list[str], include_uncertain: bool = False) -> DataFrame:
    """One row a changed label of compared pairs: added, removed, or renamed with its old name.

    Pairs whose status is uncertain are left out unless asked for. A renamed label is ``{from, to}``.
    """
    rows = pairs if include_uncertain or "table_status" not in pairs.columns else pairs.where(F.coalesce("table_status", F.lit("")) != "uncertain")
    renamed = "array<struct<`from`: string, `to`: string>>"
    entry = lambda kind, new, old: F.struct(F.lit(kind).alias("change"), new.alias("label"), old.alias("previous"))
    none = F.lit(None).cast("string")
    each = F.concat(
        F.transform(_array(rows, "indicators_added"), lambda x: entry("added", x, none)),
        F.transform(_array(rows, "indicators_removed"), lambda x: entry("removed", x, none)),
        F.transform(_array(rows, "indicators_renamed", renamed), lambda x: entry("renamed", x["to"], x["from"])),
    )
    return rows.select(*ids, F.explode(each).alias("c")).select(*ids, "c.*")


def footnote_counts(pairs: DataFrame) -> DataFrame:
    """Pairs with how many notes were added, removed and modified, and whether anything at all differs."""
    size = lambda n, kind=EMPTY: F.size(_array(pairs, n, kind))
    renamed = "array<struct<`from`: string, `to`: string>>"
    rows = pairs.withColumns({"notes_added": size("footnotes_added"), "notes_removed": size("footnotes_removed"), "notes_modified": size("footnotes_renamed", renamed)})
    labels = size("indicators_added") + size("indicators_removed") + size("indicators_renamed", renamed)
    total = labels + F.col("notes_added") + F.col("notes_removed") + F.col("notes_modified")
    return rows.withColumns({"n_changes": total, "has_diff": total > 0, "table_level_change": F.when(total > 0, "modifie").otherwise("inchange")})


def drastic_drop(before: Column, after: Column) -> Column:
    """A table that lost four fifths of its rows and more than five."""
    lost = before - after
    return (before > 0) & (lost > 5) & (lost / before >= 0.8)


def review_items(pairs: DataFrame, added: DataFrame, removed: DataFrame, ids: list[str]) -> DataFrame:
    """One item for the labels and one for the notes of each pair that changed, and one for each table on one side only."""
    rows = footnote_counts(pairs)
    n_labels = F.col("n_changes") - F.col("notes_added") - F.col("notes_removed") - F.col("notes_modified")
    n_notes = F.col("notes_added") + F.col("notes_removed") + F.col("notes_modified")
    item = lambda df, kind, change, n: df.select(*ids, F.lit(kind).alias("item_type"), F.lit(change).alias("change_type"), n.cast("long").alias("n"))
    one = F.lit(1)
    return (
        item(rows.where(n_labels > 0), "indicator", "modified", n_labels)
        .unionByName(item(rows.where(n_notes > 0), "footnote", "modified", n_notes))
        .unionByName(item(added, "indicator", "table_added", one))
        .unionByName(item(removed, "indicator", "table_removed", one))
    )


def table_context(labels: Column) -> Column:
    """Labels without lines that are only dates, each with its key."""
    given = F.filter(F.coalesce(labels, F.array().cast(EMPTY)), lambda x: ~date_line(x))
    return F.transform(given, lambda x: F.struct(x.alias("label"), label_key(x).alias("normalized")))


def real_labels(labels: Column) -> Column:
    """How many labels are neither empty, nor numbers, dates or units."""
    return F.size(F.filter(F.coalesce(labels, F.array().cast(EMPTY)), lambda x: (squeezed(x) != "") & excluded_line(x).isNull()))


def features(labels: Column) -> Column:
    """How many labels a table has, and a digest of their sorted keys, repeats kept."""
    keys = F.filter(F.transform(F.coalesce(labels, F.array().cast(EMPTY)), matching_key), lambda k: k != "")
    return let(keys, lambda k: F.struct(F.size(k).alias("n_indicators"), F.concat(F.lit("sha1:"), F.sha1(F.array_join(F.array_sort(k), "|"))).alias("signature")))


def table_uid(bank: Column, year: Column, quarter: Column, section: Column, number: Column, page: Column, index: Column) -> Column:
    """A table's id, the same whenever the same report is read."""
    slug = F.regexp_replace(matching_key(section), " ", "-")
    return F.concat_ws("_", F.lower(blank(bank)), year.cast("string"), F.lower(blank(quarter)), slug, F.coalesce(number.cast("string"), F.lit("na")), F.format_string("p%03d", page.cast("int")), F.format_string("i%02d", index.cast("int")))


def display_rows(changes: DataFrame, limit: int = 300) -> DataFrame:
    """What analysts see of a change: subsection, type, both texts and what changed, cut at a sentence."""
    heading = F.trim(blank(F.col("subsection_heading")))
    slug = F.regexp_replace(F.regexp_replace(F.expr("replace(coalesce(change_id, ''), concat(coalesce(section_key, ''), '_'), '')"), r"_change_\d+$", ""), "_", " ")
    label = F.when(~heading.isin("", "__intro__", "full"), heading).when(F.trim(slug).isin("", "full"), "").otherwise(F.trim(slug))
    kind = F.coalesce(*(F.when(F.lower("diff_type") == k, v) for k, v in (("added", "Ajout"), ("removed", "Suppression"), ("modified", "Modification"), ("renamed", "Renommage"), ("unchanged", "Inchangé"))), F.lit(""))
    return changes.select("change_id", label.alias("subsection"), kind.alias("type"), blank(F.col("source_text_t1")).alias("previous"), blank(F.col("source_text_t2")).alias("current"), truncated_at_sentence(F.col("change_summary"), limit).alias("what_changed"))
