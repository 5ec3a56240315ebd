"""The review queue: what analysts decide on, grouped by table, once each, in order of urgency, and what they decided.

A raw change is a row ``(bank, section, table_id_t1, table_id_t2, title, page_t1, page_t2, item_type, change_type, name,
name_from, name_to, footnote_ref, description, status, confidence, position)``; missing columns count as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.text import blank, squeezed

# The order of urgency.
ACTIONS = {"revue_prioritaire": 0, "investigation": 1, "confirmation": 2, "information": 3, "aucune": 4}
CATEGORIES = {"REGLEMENTAIRE": 0, "RISQUE": 1, "CAPITAL": 2, "STRUCTURE": 3, "NON_PERTINENT": 4, "INCONNU": 5}
IMPACTS = {"MAJEUR": 0, "MODERE": 1, "MINEUR": 2}
RELEVANCE = {"REGLEMENTAIRE": 0, "NOUVELLE_DIVULGATION": 1, "STRUCTUREL": 2, "NON_SIGNIFICATIF": 3, "NON_CLASSIFIE": 4}
RISKS = {"ELEVE": 0, "MODERE": 1, "FAIBLE": 2}
TABLE_CHANGES = ["table_added", "table_removed", "structure_change", "uncertain", "modified"]
DECIDED = ["approved", "rejected"]


def rank_of(value: Column, order: dict[str, int], last: int) -> Column:
    out = F.lit(last)
    for name, place in order.items():
        out = F.when(value == name, place).otherwise(out)
    return out


def change_type(item_type: Column, kind: Column) -> Column:
    """The type of a change by its item, a label or a note, and what happened to it."""
    note = F.when(kind == "added", "footnote_added").when(kind == "removed", "footnote_removed").otherwise("footnote_modified")
    return F.when(item_type == "footnote", note).when(kind == "removed", "indicator_removed").when(kind == "renamed", "indicator_renamed").otherwise("indicator_added")


def table_key(bank: Column, section: Column, id_t1: Column, id_t2: Column, title: Column, page_t1: Column, page_t2: Column) -> Column:
    """The key of a table or a pair of tables: by ids, else by a hash of title and pages."""
    s = F.trim(F.lower(blank(section)))
    ids = F.concat(blank(id_t1), F.lit("|"), blank(id_t2))
    name = F.left(squeezed(F.lower(blank(title))), F.lit(120))
    page = lambda p, none: F.coalesce(p.cast("string"), F.lit(none))
    short = lambda kind, *parts: F.concat(F.lit(f"{kind}:"), F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(16)))
    named = short("title", s, name, page(page_t1, ""), page(page_t2, ""))
    unknown = short("unknown", s, page(page_t1, "None"), page(page_t2, "None"), F.coalesce(title, F.lit("")))
    return F.concat(F.lower(blank(bank)), F.lit("::"), s, F.lit("::"), F.when(ids != "|", ids).when(name != "", named).otherwise(unknown))


def _what(kind: Column, c) -> Column:
    """What makes two changes of one type the same: name, both names, note or description."""
    clean = lambda n: F.trim(F.lower(blank(c(n))))
    return F.when(kind == "indicator_renamed", F.concat_ws("\u0001", clean("name_from"), clean("name_to"))).when(kind.startswith("indicator"), clean("name")).when(kind.startswith("footnote"), blank(c("footnote_ref"))).otherwise(blank(c("description")))


def queue(raw: DataFrame) -> DataFrame:
    """Raw changes as the queue's changes: one row a table and change, the first of equals, with ``table_key``.

    A table that was added or removed as a whole has that one change, the last such, and no other. Tables without a
    change do not appear. Notes are optional, all else is required.
    """
    c = lambda n: F.col(n) if n in raw.columns else F.lit(None).cast("string")
    key = table_key(c("bank"), c("section"), c("table_id_t1"), c("table_id_t2"), c("title"), c("page_t1"), c("page_t2"))
    kind = F.when(c("change_type").isin(TABLE_CHANGES), c("change_type")).otherwise(change_type(c("item_type"), c("change_type")))
    rows = raw.withColumns({"table_key": key, "type": kind})
    whole = F.col("type").isin("table_added", "table_removed")
    wholes = rows.where(whole).groupBy("table_key").agg(F.max("position").alias("_whole"))
    marked = rows.join(wholes, "table_key", "left").where(F.col("_whole").isNull() | (whole & (F.col("position") == F.col("_whole")))).drop("_whole")
    what = _what(F.col("type"), c)
    rest = [x for x in marked.columns if x not in ("table_key", "type")]
    first = marked.groupBy("table_key", "type", what.alias("what")).agg(F.min_by(F.struct(*rest), "position").alias("r"))
    return first.select("table_key", "type", "what", "r.*", (F.coalesce(F.col("r.item_type") if "item_type" in rest else F.lit(None), F.lit("indicator")) != "footnote").alias("is_required"))


def tables(changes: DataFrame) -> DataFrame:
    """The queue's tables: counts by type, validated and pending, status and what was decided, in all.

    ``status`` of a change is pending until it is approved or rejected. A table is completed when none is pending,
    partial when some are decided; it is approved or rejected when all required changes are (all, if none is required).
    """
    is_ = lambda *names: F.count(F.when(F.col("type").isin(*names), 1))
    status = F.coalesce("status", F.lit("pending"))
    done = F.count(F.when(status.isin(DECIDED), 1))
    required = F.col("is_required")
    out = changes.groupBy("table_key").agg(
        F.count("*").alias("total_changes"), is_("indicator_added").alias("indicators_added"), is_("indicator_removed").alias("indicators_removed"), is_("indicator_renamed").alias("indicators_renamed"),
        is_("footnote_added", "footnote_removed", "footnote_modified").alias("footnotes_changed"), done.alias("validated"), F.max("confidence").alias("confidence"),
        F.count(F.when(required, 1)).alias("_n"), F.count(F.when(status == "approved", 1)).alias("_a"), F.count(F.when(status == "rejected", 1)).alias("_r"), F.count(F.when(required & (status == "approved"), 1)).alias("_ra"), F.count(F.when(required & (status == "rejected"), 1)).alias("_rr"),
    )
    n, a, r = (F.when(F.col("_n") > 0, x).otherwise(y) for x, y in ((F.col("_n"), F.col("total_changes")), (F.col("_ra"), F.col("_a")), (F.col("_rr"), F.col("_r"))))
    out = out.withColumns({
        "pending": F.col("total_changes") - F.col("validated"),
        "table_status": F.when(F.col("total_changes") == F.col("validated"), "completed").when(F.col("validated") > 0, "partial").otherwise("pending"),
        "decision": F.when(a == n, "approved").when(r == n, "rejected").otherwise("pending"),
    })
    return out.drop("_n", "_a", "_r", "_ra", "_rr")


def item_priority(action: Column, category: Column, impact: Column) -> Column:
    """A key by which the queue's items sort: action, category, impact; unknown values last."""
    return F.struct(rank_of(F.lower(F.trim(blank(action))), ACTIONS, 5).alias("action"), rank_of(F.upper(F.trim(blank(category))), CATEGORIES, 6).alias("category"), rank_of(F.upper(F.trim(blank(impact))), IMPACTS, 3).alias("impact"))


def table_priority(relevance: Column, risk: Column, n_changes: Column, confidence: Column) -> Column:
    """A key by which tables sort: relevance, risk, most changes, least confidence."""
    return F.struct(rank_of(F.upper(blank(relevance)), RELEVANCE, 5).alias("relevance"), rank_of(F.upper(blank(risk)), RISKS, 3).alias("risk"), (-n_changes).alias("changes"), confidence.alias("confidence"))


def retained_priority(new_idea: Column, impact: Column, n_themes: Column, section: Column, page: Column, diff_type: Column) -> Column:
    """A key by which retained changes sort: new ideas, impact, most themes, section, page, type."""
    first = F.when(page.isNull(), "").otherwise(F.format_string("%06d", page.cast("int")))
    return F.struct(F.when(F.coalesce(new_idea, F.lit(False)), 0).otherwise(1).alias("idea"), rank_of(F.upper(F.coalesce(impact, F.lit("MINEUR"))), IMPACTS, 99).alias("impact"), (-n_themes).alias("themes"), blank(section).alias("section"), first.alias("page"), F.lower(blank(diff_type)).alias("type"))


def row_priority(relevant: Column, impact: Column, new_idea: Column, category: Column, section: Column, diff_type: Column) -> Column:
    """A key by which rows of a report sort: relevant, impact, new ideas, category, section, type."""
    yes = lambda c: F.when(F.coalesce(c, F.lit(False)), 0).otherwise(1)
    return F.struct(yes(relevant).alias("relevant"), rank_of(F.upper(blank(impact)), IMPACTS, 99).alias("impact"), yes(new_idea).alias("idea"), rank_of(F.upper(blank(category)), CATEGORIES, 5).alias("category"), blank(section).alias("section"), blank(diff_type).alias("type"))


def written_back(decisions: DataFrame, elements: DataFrame) -> DataFrame:
    """Decisions ``(table_id_t1, table_id_t2, type, name, status)`` with whether the element they are about is there.

    ``elements`` hold the changes of the compared pairs under the same columns. A decision is pending, matched or
    unmatched; an element that occurs twice takes a decision once.
    """
    known = elements.select("table_id_t1", "table_id_t2", "type", "name").distinct().withColumn("_there", F.lit(True))
    open_ = F.lower(F.coalesce("status", F.lit("pending"))).isin("pending", "skipped", "")
    rows = decisions.join(known, ["table_id_t1", "table_id_t2", "type", "name"], "left")
    return rows.withColumn("outcome", F.when(open_, "pending").when(F.col("_there"), "matched").otherwise("unmatched")).drop("_there")
