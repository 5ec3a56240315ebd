"""Queries of the change rules, the review queue and the section operators, with the same result in SQL.

An order stands for a text change: its sentence is one of a few in French, with a date and an amount; the sentence of
the customer's order before is the text of the earlier period.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.functions import labels, rules, text
from driftline.operators import alignment, chunks, coverage, graph, metrics, reconcile, review, sections
from driftline.plans.reporting import query, read
from driftline.sources.scratch import written

SENTENCES = [
    "Le ratio CET1 et les fonds propres ont augmenté",
    "Le risque de crédit lié aux garanties hypothécaires demeure élevé",
    "La banque suit la liquidité et le financement de gros",
    "Le comité du conseil d'administration a revu son mandat",
    "Une nouvelle exigence du BSIF a suivi la ligne directrice",
    "Les données et le cyber occupent les fournisseurs",
    "Un rachat et une acquisition ont eu lieu",
    "Le coefficient de plancher attend un report",
    "Le modèle interne sert trimestriellement au calcul",
    "Les tarifs douaniers et les sanctions pèsent",
    "Le risque de modèle et la validation des modèles",
    "Un renommage touche la terminologie",
]
THEMES = [[], ["LIQUIDITE"], ["GOUVERNANCE_RISQUES", "INCONNU"], ["risque_emergent"], ["MONTANT_REGLEMENTAIRE", "RATIOS_REGLEMENTAIRES"], ["MODIFICATION_METHODOLOGIE"], ["STRUCTURE_RAPPORT"], ["SUJET_EMERGENT_HORS_GRILLE"]]


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _among(needles: list[str], column: str = "t") -> str:
    return " OR ".join([f"contains({column}, {_quoted(n)})" for n in needles] or ["false"])


def _overlap(names: list[str]) -> str:
    return f"list_has_any(themes, {names!r})" if names else "false"


def change_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as changes: ids, both texts, type, verdict and themes."""
    pick = lambda options, key: F.element_at(F.array(*options), F.pmod(key, F.lit(len(options))).cast("int") + 1)
    key = F.col("o_orderkey")
    said = F.concat(pick([F.lit(s) for s in SENTENCES], key), F.lit(" le "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" pour "), F.col("o_totalprice").cast("decimal(12,2)").cast("string"), F.lit(" M$"))
    themes = pick([F.array(*map(F.lit, t)).cast("array<string>") for t in THEMES], key)
    before = F.lag("source_text_t2").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = read(spark, sf_dir, "orders").withColumns({"source_text_t2": said, "themes": themes, "is_relevant": F.col("o_orderstatus") == "O", "nouvelle_idee": key % 3 == 0})
    rows = rows.withColumn("source_text_t1", before)
    return rows.withColumn("diff_type", F.when(F.col("source_text_t1").isNull(), "added").otherwise("modified"))


CHANGES = f"""raw AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, {[s for s in SENTENCES]!r}[o_orderkey % {len(SENTENCES)} + 1] || ' le ' || strftime(o_orderdate, '%Y-%m-%d') || ' pour ' || o_totalprice::DECIMAL(12,2) || ' M$' AS t2,
  [{', '.join(f"{t!r}::VARCHAR[]" for t in THEMES)}][o_orderkey % {len(THEMES)} + 1] AS given, o_orderstatus = 'O' AS relevant, o_orderkey % 3 = 0 AS idea FROM orders),
  ch AS (SELECT *, list_transform(given, lambda x: upper(x)) AS themes, lag(t2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS t1 FROM raw)""".replace('"Le comité du conseil d\'administration a revu son mandat"', "'Le comité du conseil d''administration a revu son mandat'")


def _found(name: str, column: str) -> str:
    """Sorted distinct matches of a signal in lower case. The engine's own word borders know ASCII only."""
    pattern = rules.SIGNALS[name].replace("'", "''")
    return rf"list_sort(list_distinct(list_transform(regexp_extract_all(coalesce({column}, ''), '(?i)(?:^|[^\pL\pN_])({pattern})(?:$|[^\pL\pN_])', 1), lambda x: lower(x))))"


def _has(name: str, column: str) -> str:
    pattern = rules.SIGNALS[name].replace("'", "''")
    return rf"regexp_matches(coalesce({column}, ''), '(?i)(?:^|[^\pL\pN_])(?:{pattern})(?:$|[^\pL\pN_])')"


@query(
    f"""WITH {CHANGES} SELECT o_orderkey, {_has('operation', "concat_ws(' ', t1, t2)")} AS operation, {_found('methodology', 't1')} <> {_found('methodology', 't2')} AS methodology,
len(list_filter({_found('regulatory', 't2')}, lambda x: NOT list_contains({_found('regulatory', 't1')}, x))) > 0 AS regulatory, {_has('governance', 't2')} OR {_has('regulatory', 't2')} AS protected,
t1 IS NULL AND NOT {_has('operation', "concat_ws(' ', t1, t2)")} AND {_has('regulatory', 't2')} AS disclosure FROM ch"""
)
def change_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = change_rows(spark, sf_dir)
    c = {n: F.col(n) for n in ("source_text_t1", "source_text_t2", "diff_type")}
    a, b = F.col("source_text_t1"), F.col("source_text_t2")
    return rows.select("o_orderkey", rules.combined_text(c).rlike(rules.signal("operation")).alias("operation"), rules.methodology_signal(a, b).alias("methodology"), rules.new_regulatory_substance(a, b).alias("regulatory"), rules.governance_protected(b).alias("protected"), rules.pure_regulatory_disclosure(c).alias("disclosure"))


@query()
def change_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a change is left out before any verdict. It takes the similarity of texts, which SQL cannot express."""
    rows = change_rows(spark, sf_dir)
    c = {n: F.col(n) for n in ("source_text_t1", "source_text_t2", "diff_type")}
    return rules.with_exclusions(rows, c).select("o_orderkey", "cosmetic", "bank")


_CASES = "CASE " + " ".join(f"WHEN {_among(n)} OR {_overlap(t)} THEN {_quoted(c)}" for c, n, t in rules.CATEGORIES) + f" ELSE {_quoted(rules.OTHERWISE)} END"
_KEY = f"trim(regexp_replace(lower(translate(t2, '{text.ACCENTED}', '{text.FOLDED}')), '\\s+', ' ', 'g'))"


@query(f"WITH {CHANGES}, k AS (SELECT o_orderkey, o_custkey, themes, {_KEY} AS t FROM ch) SELECT o_orderkey, {_CASES} AS category, array_to_string(list_filter(named, lambda x, i: x IS NOT NULL AND list_position(named, x) = i), ' · ') AS labels FROM (SELECT *, list_transform(themes, lambda x: MAP {rules.SUBJECTS!r}[x]) AS named FROM k)")
def change_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = change_rows(spark, sf_dir)
    return rows.select("o_orderkey", rules.category({"themes": F.col("themes")}, F.col("source_text_t2")).alias("category"), rules.secondary_labels(F.col("themes")).alias("labels"))


def _legacy(value: int) -> str:
    of = lambda *names: _overlap(list(names))
    ladder = [(of(rules.OFF_GRID), "INCONNU", "autre"), (of(*rules.CAPITAL_THEMES), "CAPITAL", "capital"), (of("LIQUIDITE"), "REGLEMENTAIRE", "liquidite"), (of("EXIGENCES_REGLEMENTAIRES", "NOUVELLE_MENTION_REGLEMENTAIRE"), "REGLEMENTAIRE", "conformite"),
              (of("MODIFICATION_TEXTE_RISQUE", "FACTEUR_RISQUE_CHANGEMENT", "HYPOTHESES_EXPLICATIONS_RISQUES"), "RISQUE", "credit"), (of("RISQUE_EMERGENT", "RISQUE_DONNEES", "RISQUE_TIERS_CLOUD", "ESG_CLIMATIQUE"), "RISQUE", "autre"), (of("GOUVERNANCE_RISQUES", "CONTROLE_CONFORMITE"), "STRUCTURE", "conformite")]
    none = ("NON_PERTINENT", "autre")[value]
    return f"CASE WHEN NOT relevant THEN '{none}' " + " ".join(f"WHEN {rule} THEN '{(c, k)[value]}'" for rule, c, k in ladder) + f" ELSE '{('STRUCTURE', 'autre')[value]}' END"


@query(
    f"""WITH {CHANGES}, v AS (SELECT o_orderkey, relevant, idea, list_distinct(list_transform(themes, lambda x: CASE WHEN list_contains({list(rules.SUBJECTS)!r}, x) THEN x ELSE '{rules.OFF_GRID}' END)) AS themes FROM ch),
l AS (SELECT *, CASE WHEN NOT relevant THEN 'MINEUR' WHEN idea AND {_overlap(rules.PRIORITY_THEMES)} THEN 'MAJEUR' ELSE 'MODERE' END AS impact_level FROM v)
SELECT o_orderkey, impact_level, CASE impact_level WHEN 'MINEUR' THEN 'aucune' WHEN 'MAJEUR' THEN 'revue_prioritaire' ELSE 'investigation' END AS action_requise, {_legacy(0)} AS category, {_legacy(1)} AS risk_type,
relevant AND (impact_level = 'MAJEUR' OR (impact_level = 'MODERE' AND (idea OR {_overlap(rules.MODERATE_THEMES)}))) AS retained FROM l"""
)
def triage_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = change_rows(spark, sf_dir).withColumn("themes", rules.known_themes(F.col("themes")))
    relevant, idea, themes = F.col("is_relevant"), F.col("nouvelle_idee"), F.col("themes")
    level = rules.impact(relevant, idea, F.arrays_overlap(themes, F.array(*map(F.lit, rules.PRIORITY_THEMES))))
    rows = rows.select("o_orderkey", "is_relevant", "nouvelle_idee", "themes", level.alias("v")).select("*", "v.*")
    legacy = rules.legacy_fields(relevant, themes, F.col("impact_level"))
    kept = rules.retained_by_impact({n: F.col(n) for n in ("is_relevant", "nouvelle_idee", "themes", "impact_level")})
    return rows.select("o_orderkey", "impact_level", "action_requise", legacy["category"].alias("category"), legacy["risk_type"].alias("risk_type"), kept.alias("retained"))


def raw_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as raw changes of a table, the order."""
    part, line = F.col("l_partkey"), F.col("l_linenumber")
    kind = F.when(part % 11 == 0, "table_added").when(part % 11 < 4, "removed").when(part % 11 == 4, "renamed").otherwise("added")
    status = F.when(F.col("l_quantity").cast("int") % 4 == 0, "approved").when(F.col("l_quantity").cast("int") % 4 == 1, "rejected").otherwise("pending")
    name = F.concat(F.lit("n"), (part % 5).cast("string"))
    return read(spark, sf_dir, "lineitem").select(
        F.lit("RBC").alias("bank"), F.col("l_linestatus").alias("section"), F.col("l_orderkey").cast("string").alias("table_id_t1"), F.lit("").alias("table_id_t2"), F.lit("t").alias("title"), F.lit(1).alias("page_t1"), F.lit(1).alias("page_t2"),
        F.when(line % 3 == 0, "footnote").otherwise("indicator").alias("item_type"), kind.alias("change_type"), name.alias("name"), name.alias("name_from"), (part % 3).cast("string").alias("name_to"), (F.col("l_suppkey") % 2).cast("string").alias("footnote_ref"),
        F.lit("whole").alias("description"), status.alias("status"), F.col("l_discount").alias("confidence"), (line * 1_000_000_000_000 + part * 1_000_000_000 + F.round(F.col("l_extendedprice") * 100)).cast("long").alias("position"),
    )


_QUEUE = """raw AS (SELECT 'rbc::' || lower(l_linestatus) || '::' || l_orderkey || '|' AS table_key, CASE WHEN l_linenumber % 3 = 0 THEN 'footnote' ELSE 'indicator' END AS item, CASE WHEN l_partkey % 11 = 0 THEN 'table_added' WHEN l_partkey % 11 < 4 THEN 'removed' WHEN l_partkey % 11 = 4 THEN 'renamed' ELSE 'added' END AS kind,
  'n' || (l_partkey % 5) AS name, (l_partkey % 3)::VARCHAR AS name_to, (l_suppkey % 2)::VARCHAR AS ref, CASE l_quantity::INT % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'pending' END AS status, l_discount AS confidence,
  (l_linenumber * 1000000000000 + l_partkey * 1000000000 + round(l_extendedprice * 100))::BIGINT AS position FROM lineitem),
  typed AS (SELECT *, CASE WHEN kind = 'table_added' THEN kind WHEN item = 'footnote' THEN 'footnote_' || CASE kind WHEN 'renamed' THEN 'modified' ELSE kind END ELSE 'indicator_' || kind END AS type FROM raw),
  whole AS (SELECT table_key, max(position) AS last FROM typed WHERE type = 'table_added' GROUP BY 1),
  open AS (SELECT t.* FROM typed t LEFT JOIN whole w USING (table_key) WHERE w.last IS NULL OR (t.type = 'table_added' AND t.position = w.last)),
  q AS (SELECT table_key, type, CASE WHEN type = 'indicator_renamed' THEN name || chr(1) || name_to WHEN type = 'table_added' THEN 'whole' WHEN item = 'footnote' THEN ref ELSE name END AS what, min_by(status, position) AS status, min_by(confidence, position) AS confidence, min_by(item, position) <> 'footnote' AS required FROM open GROUP BY ALL)"""


@query(
    f"""WITH {_QUEUE}, t AS (SELECT table_key, count(*) AS total_changes, count(*) FILTER (type = 'indicator_added') AS indicators_added, count(*) FILTER (type = 'indicator_removed') AS indicators_removed, count(*) FILTER (type = 'indicator_renamed') AS indicators_renamed,
count(*) FILTER (type LIKE 'footnote%') AS footnotes_changed, count(*) FILTER (status <> 'pending') AS validated, max(confidence) AS confidence, bool_or(required) AS any_required, bool_and(status = 'approved') AS a, bool_and(status = 'rejected') AS r,
bool_and(status = 'approved') FILTER (required) AS ra, bool_and(status = 'rejected') FILTER (required) AS rr FROM q GROUP BY 1)
SELECT table_key, total_changes, indicators_added, indicators_removed, indicators_renamed, footnotes_changed, validated, confidence, total_changes - validated AS pending, CASE WHEN validated = total_changes THEN 'completed' WHEN validated > 0 THEN 'partial' ELSE 'pending' END AS table_status,
CASE WHEN CASE WHEN any_required THEN ra ELSE a END THEN 'approved' WHEN CASE WHEN any_required THEN rr ELSE r END THEN 'rejected' ELSE 'pending' END AS decision FROM t"""
)
def review_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.tables(review.queue(raw_review(spark, sf_dir)))


@query(
    f"""WITH {CHANGES}, n AS (SELECT c.*, c_nationkey AS nation, CASE WHEN relevant AND idea THEN 'MAJEUR' WHEN relevant THEN 'MODERE' ELSE 'MINEUR' END AS impact FROM ch c JOIN customer ON o_custkey = c_custkey),
h AS (SELECT nation, string_agg(t2, '|' ORDER BY o_orderkey) AS highlights FROM (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY o_orderkey) AS k FROM n) WHERE k <= 5 GROUP BY 1)
SELECT nation, count(*) AS total, count(*) FILTER (relevant) AS total_relevant, count(*) FILTER (impact = 'MAJEUR') AS n_major, count(*) FILTER (impact = 'MINEUR') AS n_minor,
CASE WHEN count(*) FILTER (relevant AND impact = 'MAJEUR') >= 3 THEN 'ELEVEE' WHEN count(*) FILTER (relevant) > 0 THEN 'MOYENNE' ELSE 'FAIBLE' END AS pertinence_globale, any_value(highlights) AS highlights FROM n JOIN h USING (nation) GROUP BY nation"""
)
def global_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("is_relevant") & F.col("nouvelle_idee"), "MAJEUR").when(F.col("is_relevant"), "MODERE").otherwise("MINEUR")
    customer = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation"))
    rows = change_rows(spark, sf_dir).join(customer, "o_custkey").select("nation", F.col("o_orderkey").alias("position"), "is_relevant", level.alias("impact_level"), F.lit(None).cast("string").alias("category"), F.lit("").alias("action_requise"), F.col("source_text_t2").alias("change_summary"))
    n = lambda c, k: F.coalesce(F.try_element_at(c, F.lit(k)), F.lit(0)).cast("long")
    out = metrics.global_summary(rows, ["nation"])
    return out.select("nation", "total", "total_relevant", n("by_impact", "MAJEUR").alias("n_major"), n("by_impact", "MINEUR").alias("n_minor"), "pertinence_globale", F.array_join("highlights", "|").alias("highlights"))


_TYPES = "CASE o_orderkey % 4 WHEN 0 THEN 'ambiguous' WHEN 1 THEN 'matched_strong' WHEN 2 THEN 'matched_weak' ELSE 'possible_added' END"


@query(
    f"""WITH c AS (SELECT o_custkey, o_orderkey, {_TYPES} AS alignment_type, o_orderkey % 7 = 0 AS unsure, CASE o_orderkey % 3 WHEN 0 THEN 'deterministic_prefilter' WHEN 1 THEN 'model' END AS source, CASE WHEN o_orderkey % 5 < 2 THEN o_orderkey % 10 END AS g, o_orderstatus = 'P' AS review FROM orders)
SELECT o_custkey, count(*) AS total_changes, count(*) FILTER (alignment_type = 'ambiguous' OR unsure) AS ambiguous_alignment_count, count(*) FILTER (source = 'deterministic_prefilter') AS triage_prefiltered_count, count(*) FILTER (source = 'model') AS triage_sent_count,
count(DISTINCT g) AS triage_dedup_group_count, count(g) AS triage_dedup_member_count, count(*) FILTER (review) AS human_review_count, round(count(*) FILTER (alignment_type = 'ambiguous' OR unsure) / count(*), 4) AS ambiguous_alignment_rate,
round(count(*) FILTER (review) / count(*), 4) AS human_review_rate, round((count(g) - count(DISTINCT g)) / count(*), 4) AS triage_duplicate_rate FROM c GROUP BY 1"""
)
def alignment_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    kind = F.when(k % 4 == 0, "ambiguous").when(k % 4 == 1, "matched_strong").when(k % 4 == 2, "matched_weak").otherwise("possible_added")
    rows = read(spark, sf_dir, "orders").select("o_custkey", kind.alias("alignment_type"), F.when(k % 7 == 0, "uncertain").alias("alignment_decision"), F.when(k % 3 == 0, "deterministic_prefilter").when(k % 3 == 1, "model").alias("source"), F.when(k % 5 < 2, k % 10).alias("dedup_group"), (F.col("o_orderstatus") == "P").alias("review_required"))
    return metrics.quality_metrics(rows, ["o_custkey"])


@query(
    f"""WITH c AS (SELECT o_custkey, o_orderkey, {_TYPES} AS kind FROM orders), r AS (SELECT *, CASE WHEN kind = lag(kind) OVER w THEN 0 ELSE 1 END AS s FROM c WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
i AS (SELECT *, sum(s) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS island FROM r), p AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, island ORDER BY o_orderkey) - 1 AS k FROM i),
f AS (SELECT *, CASE WHEN k % CASE kind WHEN 'matched_strong' THEN 5 WHEN 'possible_added' THEN 3 ELSE 1 END = 0 THEN 1 ELSE 0 END AS first FROM p)
SELECT o_custkey, o_orderkey, format('b{{:02d}}', (sum(first) OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::BIGINT - 1) AS batch FROM f"""
)
def comparison_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    kind = F.when(k % 4 == 0, "ambiguous").when(k % 4 == 1, "matched_strong").when(k % 4 == 2, "matched_weak").otherwise("possible_added")
    rows = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", kind.alias("alignment_type"))
    return alignment.batches(rows, ["o_custkey"], ["o_orderkey"]).select("o_custkey", "o_orderkey", "batch")


@query(
    """WITH d AS (SELECT l_orderkey, CASE l_linenumber % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 ELSE 0.6 END::DOUBLE AS w, l_quantity::INT AS s, CASE WHEN l_partkey % 4 > 0 THEN l_quantity::INT + l_partkey % 9 END AS e FROM lineitem),
a AS (SELECT l_orderkey, count(s) AS ns, sum(w) AS ws, sum(w * s) AS xs, sum(w * s * s) AS xxs, count(e) AS ne, sum(w) FILTER (e IS NOT NULL) AS we, sum(w * e) AS xe, sum(w * e * e) AS xxe FROM d GROUP BY 1),
v AS (SELECT l_orderkey, CASE WHEN ns = 1 THEN 0.55 ELSE 1 - least(greatest(xxs / ws - pow(xs / ws, 2), 0) / 10, 1) END AS s, CASE WHEN ne = 1 THEN 0.55 WHEN ne > 1 THEN 1 - least(greatest(xxe / we - pow(xe / we, 2), 0) / 10, 1) END AS e FROM a)
SELECT l_orderkey, round(coalesce(s * 0.6 + e * 0.4, s, e, 0), 4) AS consensus FROM v"""
)
def page_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("l_quantity").cast("int")
    source = F.when(F.col("l_linenumber") % 3 == 0, "section").when(F.col("l_linenumber") % 3 == 1, "toc").otherwise("scan")
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", source.alias("source"), start.alias("start_page"), F.when(F.col("l_partkey") % 4 > 0, start + F.col("l_partkey") % 9).alias("end_page"))
    return sections.consensus(rows, ["l_orderkey"]).withColumn("consensus", F.round("consensus", 4))


@query(
    """WITH d AS (SELECT event_id, (event_id % 50)::INT + 1 AS s, CASE WHEN event_id % 3 > 0 THEN (event_id % 50)::INT + (user_id % 40)::INT END AS e FROM events), f AS (SELECT *, coalesce(e, least(80, s + 9)) AS e0 FROM d), g AS (SELECT *, greatest(e0 - s + 1, 1) AS span FROM f),
h AS (SELECT *, CASE WHEN span < 5 THEN least(80, s + 4) ELSE e0 END AS e1 FROM g), i AS (SELECT *, greatest(e1 - s + 1, 1) AS now FROM h)
SELECT event_id, (CASE WHEN now > 30 THEN least(80, s + 29) ELSE e1 END)::INT AS end_page, span::INT AS detected_span, nullif(concat_ws('; ', CASE WHEN e IS NULL THEN 'end_missing->default_10' END, CASE WHEN span < 5 THEN 'min_enforced_' || span || '->5' END, CASE WHEN now > 30 THEN 'max_enforced_' || now || '->30' END), '') AS reason FROM i"""
)
def section_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = (F.col("event_id") % 50).cast("int") + 1
    end = F.when(F.col("event_id") % 3 > 0, (F.col("event_id") % 50).cast("int") + (F.col("user_id") % 40).cast("int"))
    found = sections.constrained(start, end, F.lit(80), F.lit(5), F.lit(30), F.lit(10))
    return read(spark, sf_dir, "events").select("event_id", found.alias("f")).select("event_id", F.col("f.end_page").cast("int").alias("end_page"), F.col("f.detected_span").cast("int").alias("detected_span"), "f.reason")


@query(
    """WITH e AS (SELECT user_id, event_id::INT AS page, event_id AS event FROM events WHERE event_type <> 'click'), p AS (SELECT user_id, event_id::INT AS page, (event_id * 3 // 2)::INT AS other_page FROM events WHERE event_type = 'click'),
b AS (SELECT e.*, p.page AS pa, p.other_page AS oa FROM e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.page >= p.page), a AS (SELECT b.*, p.page AS pb, p.other_page AS ob FROM b ASOF LEFT JOIN p ON b.user_id = p.user_id AND b.page <= p.page)
SELECT user_id, event, page, greatest(round(coalesce(CASE WHEN pa = pb THEN oa ELSE oa + (page - pa) * (ob - oa) / (pb - pa) END, oa + page - pa, ob + page - pb)), 1)::INT AS other_page FROM a"""
)
def interpolated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("user_id", F.col("event_id").cast("int").alias("page"), F.col("event_id").alias("event"), "event_type")
    pairs = e.where("event_type = 'click'").select("user_id", "page", F.floor(F.col("event") * 3 / 2).cast("int").alias("other_page"))
    return sections.interpolated_page(e.where("event_type <> 'click'").drop("event_type"), pairs, ["user_id"])


@query(
    """WITH l AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN upper(p_name[1]) || p_name[2:] || ' ..... ' || p_size WHEN 1 THEN upper(p_name[1]) || p_name[2:] || ' ' || p_size || ' Total ' || (p_size + 1) WHEN 2 THEN p_size || ' ' || p_name ELSE p_name END AS line FROM part),
e AS (SELECT p_partkey, upper(p_name[1]) || p_name[2:] AS title, p_size AS page, 0 AS level FROM part WHERE p_partkey % 4 IN (0, 1) UNION ALL SELECT p_partkey, CASE WHEN p_size = 2 THEN upper(p_name[1]) || p_name[2:] || ' 2 ' ELSE '' END || 'Total', p_size + 1, 0 FROM part WHERE p_partkey % 4 = 1 AND p_size > 1 UNION ALL SELECT p_partkey, p_name, p_size, 1 FROM part WHERE p_partkey % 4 = 2)
SELECT p_partkey, title, page::INT AS page, level::INT AS level FROM e WHERE page >= 3"""
)
def contents_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    name = F.concat(F.upper(F.left("p_name", F.lit(1))), F.substring("p_name", 2, 1000))
    line = F.when(k % 4 == 0, F.concat(name, F.lit(" ..... "), size)).when(k % 4 == 1, F.concat(name, F.lit(" "), size, F.lit(" Total "), (F.col("p_size") + 1).cast("string"))).when(k % 4 == 2, F.concat(size, F.lit(" "), "p_name")).otherwise(F.col("p_name"))
    return read(spark, sf_dir, "part").select("p_partkey", F.explode(sections.toc_entries(line)).alias("e")).select("p_partkey", "e.title", "e.page", "e.level")


@query(
    r"""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda b: regexp_replace(b, '^\s+|\s+$', '', 'g')), lambda b: b <> '') AS parts FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(parts) AS n_blocks, len(list_filter(parts, lambda b: regexp_matches(string_split(b, chr(10))[1], '^[ \t]*(?:\[\s*[xX]?\s*\]|[-*+][ \t]|[•◦▪‣⁃∙●○◉■□◆◇►▸▹‰]|\d{1,3}[.)][ \t])[ \t]*\S'))) AS n_lists FROM p"""
)
def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", chunks.blocks(F.col("text")).alias("b"))
    return rows.select("doc_id", F.size("b").cast("long").alias("n_blocks"), F.size(F.filter("b", lambda x: x["kind"] == "list")).cast("long").alias("n_lists"))


@query()
def text_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as units: an order-dependent fold over the blocks of a text, which SQL cannot express."""
    return chunks.chunks(read(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], "text").select("doc_id", "position", "kind", "unit_role", F.length("comparison_text").alias("n_chars"), "needs_partition")


def _words(column: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower(translate({column}, '{text.ACCENTED}', '{text.FOLDED}')), '[a-z0-9]{{3,}}'), lambda x: NOT list_contains({text.FRAGMENT_STOPWORDS!r}, x)))"


@query(
    f"""WITH n AS (SELECT coalesce(lang, '') AS block, doc_id AS node, doc_id % 2 = 0 AS old, regexp_replace(lower(translate(text, '{text.ACCENTED}', '{text.FOLDED}')), '[^a-z0-9]', '', 'g') AS key, {_words('text')} AS w FROM documents WHERE length(trim(text)) >= 80),
p AS (SELECT a.block, a.node AS a, b.node AS b, CASE WHEN a.key <> '' AND b.key <> '' AND (contains(a.key, b.key) OR contains(b.key, a.key)) THEN 1.0 ELSE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) END AS score
  FROM n a JOIN n b ON a.block = b.block AND a.old AND NOT b.old AND len(a.w) > 0 AND len(b.w) > 0),
e AS (SELECT block, a, b, round(score, 4) AS score FROM p WHERE round(score, 4) >= 0.24)
SELECT block, a, b, score, CASE WHEN score >= 0.5 THEN 'strong' WHEN score >= 0.78 AND score >= max(score) OVER (PARTITION BY block, a) - 0.08 AND score >= max(score) OVER (PARTITION BY block, b) - 0.08 THEN 'mutual_near_best' ELSE 'retrieval_only' END AS strength FROM e"""
)
def fragment_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A language stands for a section, even documents for removed and odd ones for added fragments."""
    old, block = F.col("doc_id") % 2 == 0, F.coalesce("lang", F.lit(""))
    changes = read(spark, sf_dir, "documents").select(block.alias("section"), F.col("doc_id").alias("node"), F.when(old, "removed").otherwise("added").alias("diff_type"), F.when(old, F.col("text")).alias("source_text_t1"), F.when(~old, F.col("text")).alias("source_text_t2"))
    return reconcile.marked(reconcile.edges(reconcile.one_sided(changes))).select("block", "a", "b", "score", "strength")


@query()
def fragment_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of fragments along strong and mutual edges, by a constrained merge that SQL cannot express."""
    return graph.families(fragment_edges(spark, sf_dir).where("strength <> 'retrieval_only'").withColumn("strong", F.col("strength") == "strong"))


_BY_RUNS = "CASE WHEN doc_id // 20 % 2 = 0 THEN 't1' ELSE 't2' END"


@query(
    rf"""WITH d AS (SELECT coalesce(lang, '') || ':' || coalesce(source, '') AS section, doc_id, {_BY_RUNS} AS side, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda w: w <> '') AS w FROM documents),
a AS (SELECT section, doc_id, side, len(w) AS n, w, unnest(range(0, greatest(len(w) - {coverage.ANCHOR}, 0) + 1)) AS i FROM d WHERE len(w) > 0),
g AS (SELECT section, doc_id, side, n, i, least(n, {coverage.ANCHOR}) || ':' || array_to_string(w[i + 1:i + {coverage.ANCHOR}], ' ') AS run FROM a),
h AS (SELECT DISTINCT section, side, run FROM g), k AS (SELECT g.doc_id, unnest(range(i, i + least(n, {coverage.ANCHOR}))) AS place FROM g SEMI JOIN h ON g.section = h.section AND g.run = h.run AND g.side <> h.side),
c AS (SELECT doc_id, count(DISTINCT place) AS covered FROM k GROUP BY 1)
SELECT section, doc_id, side, len(w)::BIGINT AS n_words, coalesce(covered, 0) AS covered FROM d LEFT JOIN c USING (doc_id) WHERE len(w) > 0"""
)
def fragment_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document stands word for word in documents of the other period in its section."""
    docs = read(spark, sf_dir, "documents")
    side = F.when(F.floor(F.col("doc_id") / 20) % 2 == 0, "t1").otherwise("t2")
    section = F.concat(F.coalesce("lang", F.lit("")), F.lit(":"), F.coalesce("source", F.lit("")))
    rows = coverage.covered_words(docs.select(section.alias("component"), F.col("doc_id").alias("node"), side.alias("side"), "text"))
    return rows.select(F.col("component").alias("section"), F.col("node").alias("doc_id"), "side", "n_words", "covered")


def planted_fragments(docs: DataFrame) -> DataFrame:
    """Changes in which every document went as a whole and came back in two pieces.

    Of every three documents one comes back as it was, one with its last four words replaced, and one with the words of
    its second half in the other order. ``node`` is four times the id, and one or two more for the pieces.
    """
    section = F.concat(F.coalesce("lang", F.lit("")), F.lit(":"), F.coalesce("source", F.lit("")))
    rows = docs.select("doc_id", section.alias("section"), coverage.words(F.col("text")).alias("w")).where(F.size("w") >= 20)
    half = F.floor(F.size("w") / 2).cast("int")
    second = F.slice("w", half + 1, F.size("w"))
    new = F.concat(F.slice(second, F.lit(1), F.size(second) - 4), F.array(*map(F.lit, ["durabilité", "et", "prudence", "accrue"])))
    second = F.when(F.col("doc_id") % 3 == 1, new).when(F.col("doc_id") % 3 == 2, F.reverse(second)).otherwise(second)
    joined = lambda w: F.array_join(w, " ")
    parts = F.array(F.struct(F.lit(0).alias("p"), joined("w").alias("t")), F.struct(F.lit(1).alias("p"), joined(F.slice("w", F.lit(1), half)).alias("t")), F.struct(F.lit(2).alias("p"), joined(second).alias("t")))
    rows = rows.select("section", "doc_id", F.explode(parts).alias("x"))
    old = F.col("x.p") == 0
    return rows.select("section", (F.col("doc_id") * 4 + F.col("x.p")).alias("node"), F.when(old, "removed").otherwise("added").alias("diff_type"), F.when(old, F.col("x.t")).alias("source_text_t1"), F.when(~old, F.col("x.t")).alias("source_text_t2"))


@query()
def reconciled_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted moves and cuts: found by families, judged by coverage, and what is left of the changes."""
    changes = written(planted_fragments(read(spark, sf_dir, "documents")), "changes")
    nodes = reconcile.one_sided(changes)
    edges = reconcile.marked(reconcile.edges(nodes)).where("strength <> 'retrieval_only'")
    found = coverage.components(nodes, graph.families(edges))
    covered = written(coverage.coverage(found), "covered")
    rows = coverage.reconciled(changes, covered, coverage.verdicts(covered))
    return rows.select("section", "node", "diff_type", "alignment_type", "alignment_decision", "alignment_id", F.length("source_text_t1").alias("n_chars_t1"), F.length("source_text_t2").alias("n_chars_t2"))


@query(
    """WITH u AS (SELECT l_orderkey, l_returnflag AS model, (l_quantity * 100)::BIGINT AS p, (l_extendedprice)::BIGINT AS c FROM lineitem)
SELECT l_orderkey, sum(p)::BIGINT AS prompt_tokens_total, sum(c)::BIGINT AS completion_tokens_total, count(*) AS comparison_calls_total, sum(p + c)::BIGINT AS total_tokens_total, round(sum(round((p * CASE model WHEN 'A' THEN 2.5 ELSE 0 END + c * CASE model WHEN 'A' THEN 10.0 ELSE 0 END) / 1e6, 6)), 6) AS cost_usd FROM u GROUP BY 1"""
)
def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("model"), F.round(F.col("l_quantity") * 100).cast("long").alias("prompt_tokens"), F.rint("l_extendedprice").cast("long").alias("completion_tokens"), F.lit(0).cast("long").alias("total_tokens"))
    cost = metrics.usage_cost(rows, {"A": (2.5, 10.0)}).groupBy("l_orderkey").agg(F.round(F.sum("cost_usd"), 6).alias("cost_usd"))
    return metrics.usage(rows, ["l_orderkey"]).join(cost, "l_orderkey")


_NOISE = r"CASE p_size % 8 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN 'Total du ' || p_name WHEN 2 THEN 'Note ' || p_size || '. ' || p_name WHEN 3 THEN 'en millions de dollars' WHEN 4 THEN 'T2 20' || (10 + p_size) WHEN 5 THEN p_name || ' (4):' WHEN 6 THEN 'Liquidité' ELSE p_name END"


@query(
    f"""WITH l AS (SELECT p_size, {_NOISE} AS line FROM part) SELECT CASE WHEN regexp_full_match(line, '[0-9]+') THEN 'number' WHEN line LIKE 'Total du %' THEN 'total' WHEN line LIKE '%:' THEN 'section_header' WHEN line LIKE 'en millions%' THEN 'unit'
WHEN line LIKE 'Note %' THEN 'footnote' WHEN regexp_full_match(line, 'T[1-4] 20[0-9]{{2}}') THEN 'date' WHEN line = 'Liquidité' THEN 'section_header' END AS reason, count(*) AS n FROM l GROUP BY 1"""
)
def excluded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name, size = F.col("p_size") % 8, F.col("p_name"), F.col("p_size").cast("string")
    cat = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    line: Column = F.when(k == 0, size).when(k == 1, cat("Total du ", name)).when(k == 2, cat("Note ", size, ". ", name)).when(k == 3, "en millions de dollars").when(k == 4, cat("T2 20", (F.col("p_size") + 10).cast("string"))).when(k == 5, cat(name, " (4):")).when(k == 6, "Liquidité").otherwise(name)
    return read(spark, sf_dir, "part").select(labels.excluded_line(line).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
