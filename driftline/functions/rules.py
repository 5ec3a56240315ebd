"""Rules that sort changes: what is only formatting, what is a bank's own business, what is kept, and under which heading.

A change is a row with ``diff_type``, ``alignment_type``, ``alignment_decision``, the texts of both periods
(``source_text_t1``, ``source_text_t2``, ``semantic_text_t1``, ``semantic_text_t2``), ``change_summary`` and
``subsection_heading``; a verdict, where one came in, is in ``is_relevant``, ``nouvelle_idee``, ``impact_level`` and
``themes``. The functions take a mapping of these names to columns, so that they work on any table; a name that is
missing counts as null. Everything is built-in expressions but the similarity of two texts, which is asked for only
where the rules before it leave the question open.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.similarity import sequence_ratio_from
from driftline.functions.text import blank, folded, let, squeezed

Change = dict[str, Column]

# Thresholds, and the words (without regard to case, whole words) of each signal.
COSMETIC, NOISE, SAME_UNDATED = 0.985, 0.92, 0.98
MONTHS = "janvier|février|fevrier|mars|avril|mai|juin|juillet|août|aout|septembre|octobre|novembre|décembre|decembre"
DATE = rf"\d{{1,2}}\s+(?:{MONTHS})\s+\d{{4}}|\d{{4}}-\d{{2}}-\d{{2}}"
SIGNALS = {
    "operation": r"acquisition|acquérir|rachet|rachat|émission|émettre|dividende|fusion|achat\s+d['’]actions|billets?\s+à\s+moyen\s+terme|cwb|canadian\s+western\s+bank|transaction\s+d['’]entreprise|offre\s+publique\s+d['’]achat|opa|spin[- ]?off",
    "calendar": r"jusqu['’]à\s+nouvel\s+ordre|report(?:é|er|ait)?|calendrier|échéanc|exercice\s+\d{4}|à\s+compter|progressiv|coefficient\s+de\s+plancher|plancher\s+de\s+fonds",
    "methodology": r"méthodolog|trimestriellement|périodiquement|mensuellement|approche\s+standard|approche\s+interne|airb|modèle\s+interne|sensibilités\s+standard|calcul(?:é|er)?\s+selon",
    "process": r"processus|proc[ée]dure|flux\s+de\s+travail|workflow|cha[iî]ne\s+de\s+traitement|mode\s+op[ée]ratoire",
    "regulatory": r"b-15|ligne\s+directrice|tlac|bâle\s+iii|nouvelle\s+exigence|entrée\s+en\s+vigueur|exigence\s+additionnelle|cadre\s+réglementaire|avis\s+du\s+bsif|préavis|report\s+indéfini|révisions?\s+à\s+la\s+ligne\s+directrice|ctap",
    "governance": r"gouvernance|comit[ée]s?|conseil\s+d['’]administration|mandat|lignes?\s+de\s+d[ée]fense|responsabilit[ée]s?|supervision|reddition\s+de\s+comptes|escalade|autorit[ée]\s+d[ée]cisionnelle|droits?\s+d['’]approbation|culture\s+de\s+risque|r[ée]mun[ée]ration|app[ée]tit\s+(?:pour\s+le|au)\s+risque|imp[ôo]t|fiscalit[ée]|d[ée]sinterm[ée]diation|donn[ée]es?|technologies?|cyber|blanchiment|sanctions?|bsif|b[âa]le|tarifs?|commerciale?|cryptos?|climatique?|environnemental|mod[èe]les?",
    "reference": r"OSFI|BSIF|Bâle|Basel|TLAC|LCR|NSFR|CET1|Tier\s*1|Tier\s*2|Pilier\s*[123]|IFRS|IAS|NIIF|BISM|VaR",
    "rename": r"renomm(?:e|age|er)|retitr(?:e|age)|intitul[ée]|dénomination|code de conduite|code de déontologie|politique|section|titre",
    "rename_context": r"comit[ée]|gouvernance|conformit[ée]|mandat|autorité|politique|section|titre|intitul[ée]|code de conduite|code de déontologie|règlementaire|BSIF|AMF|comité",
    "floor": r"bsif|plancher\s+de\s+fonds|coefficient\s+de\s+plancher",
    "floor_word": r"bsif|plancher|coefficient",
    "delay": r"report|retard|jusqu['’]à\s+nouvel\s+ordre",
}
CALENDAR_SUBJECT = r"coefficient\s+de\s+plancher|plancher\s+des?\s+fonds\s+propres|entrée\s+en\s+vigueur|report\s+des?\s+exigences|calendrier\s+d['’]application"
CALENDAR_REGIME = r"préavis|preavis|report\s+indéfini|report\s+indefini|révisions?\s+à\s+la\s+ligne\s+directrice|\bctap\b"
VOLATILE = rf"\b\d{{1,2}}\s+(?:{MONTHS})\s+\d{{4}}\b|\b\d{{4}}-\d{{2}}-\d{{2}}\b|\b(?:t|q)\s*[1-4]\s*[\-/–]?\s*\d{{2,4}}\b|\bexercice\s+\d{{4}}\b|\btrimestre\s+(?:de\s+)?\d{{4}}\b|\b\d{{4}}\b|\d[\d\s .,]*\s*(?:%|m\$|g\$|mds?|millions?|milliards?)?\b"
NUMERIC_TOKEN = r"\b\S*\d\S*\b"
PRIORITY_THEMES = ["RISQUE_EMERGENT", "RISQUE_MACRO_GEOPOLITIQUE", "MODIFICATION_METHODOLOGIE", "EXIGENCES_REGLEMENTAIRES", "NOUVELLE_MENTION_REGLEMENTAIRE", "MONTANT_REGLEMENTAIRE", "GOUVERNANCE_RISQUES"]
MODERATE_THEMES = ["MODIFICATION_METHODOLOGIE", "NOUVELLE_MENTION_REGLEMENTAIRE", "EXIGENCES_REGLEMENTAIRES", "FONDS_PROPRES_REGLEMENTAIRES", "DIVULGATION_RETRAIT", "FACTEUR_RISQUE_CHANGEMENT", "RISQUE_EMERGENT", "RISQUE_DONNEES", "RISQUE_TIERS_CLOUD", "RISQUE_MACRO_GEOPOLITIQUE"]
CAPITAL_THEMES = ["CAPITAL_REGLEMENTAIRE", "FONDS_PROPRES_REGLEMENTAIRES", "RATIOS_REGLEMENTAIRES"]
OFF_GRID = "SUJET_EMERGENT_HORS_GRILLE"
DECISIONS = ["same_disclosure", "distinct_disclosures", "moved_text", "uncertain"]
SUBJECTS = {
    "DIVULGATION_AJOUT": "Information ajoutée",
    "DIVULGATION_RETRAIT": "Information retirée",
    "MODIFICATION_TEXTE_RISQUE": "Texte de risque modifié",
    "MODIFICATION_METHODOLOGIE": "Méthode de calcul ou approche modifiée",
    "FACTEUR_RISQUE_CHANGEMENT": "Facteur de risque modifié",
    "CAPITAL_REGLEMENTAIRE": "Capital réglementaire",
    "LIQUIDITE": "Liquidité",
    "FONDS_PROPRES_REGLEMENTAIRES": "Fonds propres réglementaires",
    "EXIGENCES_REGLEMENTAIRES": "Exigences réglementaires ou conformité",
    "RATIOS_REGLEMENTAIRES": "Ratio ou seuil prudentiel",
    "STRUCTURE_RAPPORT": "Structure du rapport",
    "HYPOTHESES_EXPLICATIONS_RISQUES": "Hypothèses ou explications de risque",
    "ESG_CLIMATIQUE": "Risque climatique / ESG",
    "RISQUE_EMERGENT": "Risque émergent : IA, cybersécurité, fraude, cryptoactifs ou modèles tiers",
    "RISQUE_DONNEES": "Risque et gouvernance des données",
    "RISQUE_TIERS_CLOUD": "Risque de tiers, fournisseurs et services infonuagiques",
    "RISQUE_MACRO_GEOPOLITIQUE": "Risque commercial et géopolitique : tarifs douaniers, sanctions, conflits",
    "GOUVERNANCE_RISQUES": "Gouvernance des risques",
    "CONTROLE_CONFORMITE": "Contrôle interne ou conformité",
    "NOUVELLE_MENTION_REGLEMENTAIRE": "Nouvelle mention réglementaire",
    "MONTANT_REGLEMENTAIRE": "Montant ou seuil réglementaire",
    "SUJET_EMERGENT_HORS_GRILLE": "À qualifier — sujet émergent hors grille",
}
#: Headings in the order in which they are tried, the words that lead to them and the themes that do.
CATEGORIES: list[tuple[str, list[str], list[str]]] = [
    ("À qualifier — sujet émergent hors grille", [], [OFF_GRID]),
    ("17 — APR (RWA)", ["actifs ponderes", " apr", "rwa", "risk-weighted"], []),
    ("14 — Risque de modèle", ["risque de modele", "validation des modeles", "e-23"], []),
    ("6 — Intelligence artificielle", ["intelligence artificielle", "ia generative", " ai "], []),
    ("7 — Cyberrisque", ["cyber", "ransomware", "hameconnage", "phishing", "attaque par deni"], []),
    ("8 — Données et technologie", ["donnees", "technologie", "infonuag", "cloud", "fournisseur critique", "tiers critique"], []),
    ("9 — Risque climatique / ESG", ["climat", "esg", "b-15", "durabilite", "nzba"], ["ESG_CLIMATIQUE"]),
    ("5 — Géopolitique", ["tarif douanier", "geopolit", "ukraine", "moyen-orient", "sanction", "guerre commerciale"], ["RISQUE_MACRO_GEOPOLITIQUE"]),
    ("4 — Contexte économique", ["inflation", "recession", "chomage", "croissance economique"], []),
    ("10 — Risque de crédit", ["risque de credit", "hypothec", "endettement des menages", "garantie"], []),
    ("11 — Risque de marché", ["risque de marche", "var", "rtipb", "risque de change", "risque actions", "sensibilite aux taux"], []),
    ("12 — Risque de liquidité", ["liquidite", " lcr", " nsfr", "financement"], ["LIQUIDITE"]),
    ("13 — Risque opérationnel", ["risque operationnel", "continuite des affaires", "paiement", "fraude"], []),
    ("15 — Conformité juridique et réglementaire", ["aml", "fat", "blanchiment", "protection des consommateurs", "vie privee", "confidentialite", "loi fiscale"], ["CONTROLE_CONFORMITE"]),
    ("3 — Gouvernance", ["comite", "conseil d'administration", "audit interne", "trois lignes de defense"], ["GOUVERNANCE_RISQUES"]),
    ("2 — Cadre de gestion des risques", ["appetit pour le risque", "cadre de gestion des risques", "taxonomie des risques", "simulation de crise", "controle interne"], []),
    ("16 — Fonds propres", ["cet1", "tier 1", "tier 2", "tlac", "fonds propres", "capital economique"], CAPITAL_THEMES),
    ("19 — Tableaux", ["tableau", "colonnes ajoutees"], []),
    ("18 — Terminologie", ["renommage", "terminologie", "vocabulaire"], []),
    ("20 — Sections ajoutées ou supprimées", ["sous-section", "section ajoutee", "section retiree"], ["STRUCTURE_RAPPORT"]),
    ("1 — Changements réglementaires", ["bsif", "osfi", "bale", "ligne directrice", "reglement"], ["NOUVELLE_MENTION_REGLEMENTAIRE", "EXIGENCES_REGLEMENTAIRES", "MONTANT_REGLEMENTAIRE"]),
]
OTHERWISE, TABLES = "2 — Cadre de gestion des risques", "19 — Tableaux"
#: Table themes by what titles and labels hold, in the order in which they are tried.
TITLE_THEMES = [
    ("risque_credit", ["risque de credit", "credit risk", "perte de credit", "pertes de credit", "expected credit", "expositions au risque de credit", "provisions pour pertes sur creances"]),
    ("risque_marche", ["risque de marche", "market risk", "trading", "valeur a risque", "value at risk", "var"]),
    ("risque_operationnel", ["risque operationnel", "operational risk", "cyber", "fraude"]),
    ("liquidite", ["liquidite", "liquidity", "lcr", "nsfr", "hqla", "ratio structurel de liquidite"]),
    ("capital", ["capital", "fonds propres", "cet1", "tier 1", "tlac", "levier", "leverage"]),
    ("financement", ["financement", "funding", "depot", "depots"]),
]
LABEL_THEMES = [
    ("capital", ["ratio cet1", "ratio tier 1", "ratio total", "ratio de levier", "tlac"]),
    ("liquidite", ["lcr", "nsfr", "hqla", "liquidite", "ratio structurel de liquidite"]),
    ("risque_credit", ["pertes de credit", "perte de credit", "expected credit", "provision", "provisions", "exposition", "expositions", "ecl"]),
    ("risque_marche", ["trading", "var", "value at risk", "valeur a risque", "sensibilite"]),
    ("risque_operationnel", ["operational", "operationnel", "cyber", "fraude"]),
    ("financement", ["depots", "depot", "funding", "financement"]),
]
SECTION_THEMES = {"capital": "capital", "capital_management": "capital", "liquidite": "liquidite", "liquidity": "liquidite", "funding": "financement", "funding_management": "financement"}
IMPACT_THEMES, RISK_THEMES = ["capital", "liquidite", "financement"], ["risque_credit", "risque_marche", "risque_operationnel"]
SECTIONS = [
    ("capital_management", ["gestion capital", "gestion du capital", "gestion fonds propres", "gestion des fonds propres", "situation des fonds propres", "fonds propres", "capitalisation"]),
    ("risk_management", ["gestion risques", "gestion des risques", "gestion du risque", "risk management", "risque"]),
    ("regulatory_updates", ["faits nouveaux en matiere de reglementation", "reglementation", "regulatory updates", "regulatory update"]),
]


def signal(name: str) -> str:
    return rf"(?iu)\b(?:{SIGNALS[name]})\b"


def _get(change: Change, name: str, kind: str = "string") -> Column:
    return change.get(name, F.lit(None).cast(kind))


def _text(change: Change, side: str) -> Column:
    """The source text of a side, or where that is empty the semantic one."""
    return F.coalesce(F.nullif(_get(change, f"source_text_{side}"), F.lit("")), _get(change, f"semantic_text_{side}"), F.lit(""))


def _lower(change: Change, name: str) -> Column:
    return F.lower(F.trim(blank(_get(change, name))))


def _filled(text: Column) -> Column:
    return F.trim(F.regexp_replace(blank(text), r"\s", " ")) != ""


def found(text: Column, pattern: str) -> Column:
    """Distinct matches in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(blank(text), F.lit(pattern), F.lit(0)), F.lower))


def _differ(a: Column, b: Column) -> Column:
    """Whether two arrays of distinct values hold others; each is named once, so its matches are found once."""
    return F.sort_array(a) != F.sort_array(b)


def _has(text: Column, needles: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(n) for n in needles], F.lit(False))


def _themes(change: Change) -> Column:
    none = F.array().cast("array<string>")
    return F.transform(F.coalesce(_get(change, "themes", "array<string>"), none), lambda t: F.upper(F.trim(t)))


def _any_theme(change: Change, names: list[str]) -> Column:
    return F.arrays_overlap(_themes(change), F.array(*map(F.lit, names))) if names else F.lit(False)


def cosmetic_key(text: Column) -> Column:
    return squeezed(F.lower(folded(text)))


def masked(text: Column) -> Column:
    """Without dates, periods and amounts."""
    return squeezed(F.regexp_replace(blank(text), "(?iu)" + VOLATILE, " "))


def _alike(a: Column, b: Column, ask: Column, least: float) -> Column:
    """Similarity of two texts without accents and case; not worked out where ``ask`` is false, 0 where one is empty.

    Below ``least`` the value is only known to be smaller."""
    x, y = cosmetic_key(a), cosmetic_key(b)
    ask = ask & (x != "") & (y != "")
    return F.when(ask, sequence_ratio_from(F.when(ask, x), F.when(ask, y), least)).otherwise(0.0)


def _dates_differ(a: Column, b: Column) -> Column:
    dates = rf"(?iu)\b(?:{DATE})\b"
    return _differ(found(a, dates), found(b, dates))


def isolated_date_change(a: Column, b: Column, ask: Column | None = None) -> Column:
    """Texts that are alike but for their dates."""
    bare = lambda t: F.regexp_replace(blank(t), rf"(?iu)\b(?:{DATE})\b", " ")
    differ = _dates_differ(a, b)
    return differ & (_alike(bare(a), bare(b), differ if ask is None else differ & ask, SAME_UNDATED) >= SAME_UNDATED)


def methodology_signal(a: Column, b: Column) -> Column:
    """A word of method that only one side has."""
    return _differ(found(a, signal("methodology")), found(b, signal("methodology")))


def new_regulatory_substance(a: Column, b: Column) -> Column:
    """A regulatory mention that only the later side has; one that went is a matter of wording."""
    return F.size(F.array_except(found(b, signal("regulatory")), found(a, signal("regulatory")))) > 0


def new_calendar_regime(a: Column, b: Column) -> Column:
    pattern = f"(?iu){CALENDAR_REGIME}"
    return F.size(F.array_except(found(b, pattern), found(a, pattern))) > 0


def calendar_reschedule(a: Column, b: Column, combined: Column) -> Column:
    """A known requirement that is put off."""
    subject = f"(?iu)(?:{CALENDAR_SUBJECT})"
    about = combined.rlike(signal("calendar")) & (combined.rlike(subject) | combined.rlike(signal("floor")))
    shared = F.arrays_overlap(found(a, subject), found(b, subject))
    updated = blank(a).rlike(subject) & blank(b).rlike(signal("calendar"))
    return about & (shared | updated | (combined.rlike(signal("floor_word")) & combined.rlike(signal("delay"))))


def combined_text(change: Change) -> Column:
    parts = [_get(change, n) for n in ("change_summary", "source_text_t1", "source_text_t2", "semantic_text_t1", "semantic_text_t2")]
    return F.concat_ws(" ", *(F.when(_filled(p), p) for p in parts))


def pure_regulatory_disclosure(change: Change) -> Column:
    """A requirement mentioned for the first time, and no deal of the bank with it."""
    new = _text(change, "t2")
    return (_lower(change, "diff_type") == "added") & _filled(new) & ~combined_text(change).rlike(signal("operation")) & new.rlike(signal("regulatory"))


def governance_protected(text: Column) -> Column:
    return blank(text).rlike(signal("governance")) | blank(text).rlike(signal("regulatory"))


def with_exclusions(rows: DataFrame, change: Change, cosmetic: str = "cosmetic", bank: str = "bank") -> DataFrame:
    """Rows with both exclusions. What both ask, and the texts to compare, are columns of their own first: the engine would
    else find the same matches anew for every place at which a rule names them."""
    a, b, combined = _text(change, "t1"), _text(change, "t2"), combined_text(change)
    of = lambda name: F.col(f"_x_{name}")
    known = {
        "numbers": _differ(found(a, NUMERIC_TOKEN), found(b, NUMERIC_TOKEN)),
        "dates": _dates_differ(a, b),
        "operation": combined.rlike(signal("operation")),
        "masked_a": masked(a),
        "masked_b": masked(b),
    }
    out = rows.withColumns({f"_x_{n}": c for n, c in known.items()})
    asked = {"open": _open(change, of("numbers") if _sourced(change) else None), "compare": _filled(a) & _filled(b) & ~of("operation")}
    out = out.withColumns({f"_x_{n}": c for n, c in asked.items()})
    facts = {n: of(n) for n in (*known, *asked)}
    out = out.withColumns({cosmetic: cosmetic_exclusion(change, facts), bank: bank_exclusion(change, facts)})
    return out.drop(*(f"_x_{n}" for n in facts))


def _sourced(change: Change) -> bool:
    """Whether there are no other texts than the sources, so that both exclusions are about the same."""
    return "semantic_text_t1" not in change and "semantic_text_t2" not in change


def _open(change: Change, numbers: Column | None = None) -> Column:
    """Whether both texts are there and hold the same numbers and references."""
    a, b = blank(_get(change, "source_text_t1")), blank(_get(change, "source_text_t2"))
    if numbers is None:
        numbers = _differ(found(a, NUMERIC_TOKEN), found(b, NUMERIC_TOKEN))
    same_facts = ~numbers & ~_differ(found(a, signal("reference")), found(b, signal("reference")))
    return _lower(change, "diff_type").isin("modified", "unchanged") & _filled(a) & _filled(b) & same_facts


def cosmetic_exclusion(change: Change, facts: Change | None = None) -> Column:
    """Why a change is plainly cosmetic: deplacement_texte, formatage_visuel or reformulation_mineure; null if it is not.

    ``facts`` are those of ``with_exclusions``, where they are known."""
    a, b = blank(_get(change, "source_text_t1")), blank(_get(change, "source_text_t2"))
    open_ = facts["open"] if facts else _open(change)
    compact = lambda t: F.regexp_replace(cosmetic_key(t), r"(?U)[^\w]+", "")
    protected = F.concat(a, F.lit(" "), b).rlike(signal("governance"))
    alike = _alike(a, b, open_ & ~protected, COSMETIC)
    return (
        F.when(_lower(change, "alignment_decision") == "moved_text", "deplacement_texte")
        .when(~open_, F.lit(None).cast("string"))
        .when((compact(a) == compact(b)) & (a != b), "formatage_visuel")
        .when(protected, F.lit(None).cast("string"))
        .when(alike >= COSMETIC, "reformulation_mineure")
        .when(isolated_date_change(a, b, open_ & ~protected), "reformulation_mineure")
    )


def bank_exclusion(change: Change, facts: Change | None = None) -> Column:
    """Why a change is the bank's own business: an operation, a calendar update or numbers; null if it is not.

    ``facts`` are those of ``with_exclusions``, where they are known."""
    a, b, combined = _text(change, "t1"), _text(change, "t2"), combined_text(change)
    facts = facts or {}
    both = _filled(a) & _filled(b)
    operation = facts.get("operation", combined.rlike(signal("operation")))
    changed = _lower(change, "diff_type").isin("modified", "unchanged") & both
    x, y = facts.get("masked_a", masked(a)), facts.get("masked_b", masked(b))
    alike = _alike(x, y, facts.get("compare", both & ~operation), NOISE)
    numbers, dates = facts.get("numbers", _differ(found(a, NUMERIC_TOKEN), found(b, NUMERIC_TOKEN))), facts.get("dates", _dates_differ(a, b))
    method, regime, put_off = methodology_signal(a, b), new_calendar_regime(a, b), calendar_reschedule(a, b, combined)
    none = F.lit(None).cast("string")
    noise = (alike >= NOISE) & (numbers | dates)
    return (
        F.when(operation & ~pure_regulatory_disclosure(change), "operation_interne_banque")
        .when(both & method, none)
        .when(both & new_regulatory_substance(a, b) & (alike < NOISE), none)
        .when(~changed | (x == "") | (y == ""), none)
        .when((numbers | dates) & put_off & ~regime, "mise_a_jour_calendrier")
        .when(noise & regime, none)
        .when(noise & dates & (combined.rlike(signal("calendar")) | ~numbers), "mise_a_jour_calendrier")
        .when(noise, "variation_numerique_propre_banque")
    )


def governance_rename(change: Change, renamed: Column | None = None) -> Column:
    """A rename of a committee, a code or a section; ``renamed`` says whether labels or notes were."""
    text = F.concat_ws(" ", *(_get(change, n) for n in ("change_summary", "source_text_t1", "source_text_t2", "semantic_text_t1", "semantic_text_t2")))
    by = _lower(change, "diff_type") == "renamed"
    return text.rlike(signal("rename")) & text.rlike(signal("rename_context")) & (by if renamed is None else by | F.coalesce(renamed, F.lit(False)))


def impact(relevant: Column, new_idea: Column, priority: Column) -> Column:
    """Level and action: what is relevant is moderate at least, and major if it is new and of a priority theme."""
    level = F.when(~relevant, "MINEUR").when(new_idea & priority, "MAJEUR").otherwise("MODERE")
    action = F.when(~relevant, "aucune").when(new_idea & priority, "revue_prioritaire").otherwise("investigation")
    return F.struct(level.alias("impact_level"), action.alias("action_requise"))


def known_themes(themes: Column) -> Column:
    """Theme codes in upper case, once each in order; an unknown one becomes the theme off the grid."""
    codes = F.transform(F.coalesce(themes, F.array().cast("array<string>")), lambda t: F.upper(F.trim(blank(t))))
    return F.array_distinct(F.transform(F.filter(codes, lambda t: t != ""), lambda t: F.when(t.isin(list(SUBJECTS)), t).otherwise(OFF_GRID)))


def triage(change: Change) -> Column:
    """The verdict that is kept: the one that came in, overruled by the exclusions, with its impact."""
    reason = bank_exclusion(change)
    was = F.coalesce(_get(change, "is_relevant", "boolean"), F.lit(False))
    relevant = was & reason.isNull()
    idea = relevant & (F.coalesce(_get(change, "nouvelle_idee", "boolean"), F.lit(False)) | governance_rename(change))
    themes = F.when(was & reason.isNotNull(), F.array().cast("array<string>")).otherwise(known_themes(_get(change, "themes", "array<string>")))
    process = idea & F.array_contains(themes, "CONTROLE_CONFORMITE") & combined_text(change).rlike(signal("process"))
    priority = F.arrays_overlap(themes, F.array(*map(F.lit, PRIORITY_THEMES))) | process
    level = impact(relevant, idea, priority)
    return F.struct(
        relevant.alias("is_relevant"), idea.alias("nouvelle_idee"), themes.alias("themes"), level["impact_level"].alias("impact_level"), level["action_requise"].alias("action_requise"),
        F.when(~relevant, F.coalesce(reason, F.lit("non_pertinent_autre"))).alias("exclusion_reason"), F.when(was & reason.isNotNull(), "post_llm_guardrail").alias("source_guardrail"),
    )


def prefilter(change: Change) -> Column:
    """The first reason to leave a change out before any verdict: cosmetic, then the bank's own; null if there is none."""
    return F.coalesce(cosmetic_exclusion(change), bank_exclusion(change))


def legacy_fields(relevant: Column, themes: Column, impact_level: Column) -> Column:
    """Category, risk type and scores as older consumers read them."""
    change = {"themes": themes}
    of = lambda *names: _any_theme(change, list(names))
    emerging = of("RISQUE_EMERGENT", "RISQUE_DONNEES", "RISQUE_TIERS_CLOUD")
    regulatory = of("EXIGENCES_REGLEMENTAIRES", "NOUVELLE_MENTION_REGLEMENTAIRE")
    risk = of("MODIFICATION_TEXTE_RISQUE", "FACTEUR_RISQUE_CHANGEMENT", "HYPOTHESES_EXPLICATIONS_RISQUES")
    rules = [(of(OFF_GRID), "INCONNU", "autre"), (of(*CAPITAL_THEMES), "CAPITAL", "capital"), (of("LIQUIDITE"), "REGLEMENTAIRE", "liquidite"), (regulatory, "REGLEMENTAIRE", "conformite"), (risk, "RISQUE", "credit"), (emerging, "RISQUE", "autre"), (of("ESG_CLIMATIQUE"), "RISQUE", "autre"), (of("GOUVERNANCE_RISQUES", "CONTROLE_CONFORMITE"), "STRUCTURE", "conformite")]
    category, kind = F.when(~relevant, "NON_PERTINENT"), F.when(~relevant, "autre")
    for rule, c, k in rules:
        category, kind = category.when(rule, c), kind.when(rule, k)
    level = F.upper(F.coalesce(impact_level, F.lit("MINEUR")))
    score = F.when(relevant & (level == "MAJEUR"), "ELEVEE").when(relevant & (level == "MODERE"), "MOYENNE").otherwise("FAIBLE")
    return F.struct(
        category.otherwise("STRUCTURE").alias("category"), kind.otherwise("autre").alias("risk_type"), score.alias("relevance_score"), F.when(relevant, 0.85).otherwise(0.0).alias("confidence"),
        (relevant & of("NOUVELLE_MENTION_REGLEMENTAIRE")).alias("regulatory_reference_added"), (relevant & of("MODIFICATION_METHODOLOGIE")).alias("methodology_change"), (relevant & of("MONTANT_REGLEMENTAIRE")).alias("quantitative_changed"),
    )


def alignment_review(change: Change) -> Column:
    """Whether the relation of the two texts has to be looked at again."""
    decision = _lower(change, "alignment_decision")
    return F.when(decision.isin(DECISIONS), decision == "uncertain").otherwise(_lower(change, "alignment_type") == "ambiguous")


def retained_by_impact(change: Change) -> Column:
    """Major, or moderate with a new idea or a theme of method or regulation."""
    level = F.upper(F.coalesce(_get(change, "impact_level"), F.lit("MINEUR")))
    idea = F.coalesce(_get(change, "nouvelle_idee", "boolean"), F.lit(False))
    return F.coalesce(_get(change, "is_relevant", "boolean"), F.lit(False)) & ((level == "MAJEUR") | ((level == "MODERE") & (idea | _any_theme(change, MODERATE_THEMES))))


def retained_as_substance(change: Change) -> Column:
    """Relevant with a theme, or a new calendar regime, or a whole paragraph with a regulatory reference that came or went."""
    a, b = blank(_get(change, "source_text_t1")), blank(_get(change, "source_text_t2"))
    themed = F.coalesce(_get(change, "is_relevant", "boolean"), F.lit(False)) & (F.size(_themes(change)) > 0)
    whole = _lower(change, "diff_type").isin("added", "removed") & F.when(a != "", a).otherwise(b).rlike(signal("reference"))
    return themed | new_calendar_regime(a, b) | whole


def category(change: Change, text: Column, section: Column | None = None, table: Column | None = None) -> Column:
    """The one heading of a change: the first of ``CATEGORIES`` whose words or themes it has."""
    corpus = squeezed(F.lower(folded(F.concat_ws(" ", blank(text), blank(section) if section is not None else F.lit("")))))

    def first(t: Column) -> Column:
        out = F
        for name, needles, themes in CATEGORIES:
            rule = _has(t, needles) | _any_theme(change, themes)
            out = out.when(rule if name != TABLES or table is None else rule | table, name)
        return out.otherwise(OTHERWISE)

    return let(corpus, first)


def secondary_labels(themes: Column) -> Column:
    """What analysts call the themes, once each, in order."""
    names = F.create_map(*[F.lit(x) for pair in SUBJECTS.items() for x in pair])
    found_ = F.transform(F.coalesce(themes, F.array().cast("array<string>")), lambda t: F.try_element_at(names, F.upper(t)))
    return F.array_join(F.array_distinct(F.filter(found_, lambda t: t.isNotNull())), " · ")


def canonical_section(section: Column) -> Column:
    """One of three sections by what its name holds, else the name in snake case."""
    def name(t: Column) -> Column:
        snake = F.replace(t, F.lit(" "), F.lit("_"))
        return reduce(lambda out, rule: out.when(_has(t, rule[1]), rule[0]), SECTIONS, F.when(snake.isin([s for s, _ in SECTIONS]), snake)).otherwise(snake)

    return let(squeezed(F.regexp_replace(F.lower(folded(section)), "[^a-z0-9]+", " ")), name)


def business_type(section: Column, change_type: Column) -> Column:
    """IFC, RG or PB, by section and else by the type of change."""
    s, t = canonical_section(section), F.lower(blank(change_type))
    return F.when(s == "regulatory_updates", "IFC").when(s == "risk_management", "RG").when(s == "capital_management", "PB").when(t.contains("reg"), "IFC").when(t.contains("risk"), "RG").otherwise("PB")


def _theme_key(text: Column) -> Column:
    return squeezed(F.regexp_replace(F.lower(folded(text)), r"[^a-z0-9\s]+", " "))


def _first_theme(text: Column, rules: list[tuple[str, list[str]]]) -> Column:
    return let(_theme_key(text), lambda key: reduce(lambda out, r: out.when(_has(key, r[1]), r[0]), rules, F.when(F.lit(False), F.lit(""))))


def table_theme(section: Column, title: Column, labels: Column, notes: Column) -> Column:
    """By title, else section, else row labels, else notes; ``autre`` where none tells."""
    name = F.lower(F.trim(blank(section)))
    by_name = reduce(lambda c, kv: c.when(name == kv[0], kv[1]), SECTION_THEMES.items(), F.when(F.lit(False), F.lit("")))
    joined = lambda a: F.array_join(F.coalesce(a, F.array().cast("array<string>")), " ")
    return F.coalesce(_first_theme(title, TITLE_THEMES), by_name, _first_theme(section, TITLE_THEMES), _first_theme(joined(labels), LABEL_THEMES), _first_theme(joined(notes), LABEL_THEMES), F.lit("autre"))


def assessment(theme: Column, kind: Column, labels_changed: Column, renamed: Column, notes_changed: Column) -> Column:
    """Significance and priority of a table's change by theme and numbers of changes, and a sentence about it.

    ``labels_changed`` and ``notes_changed`` count what was added or removed, ``renamed`` what got another name.
    """
    total = labels_changed + renamed + notes_changed
    whole, high, risk = kind.isin("ajoute", "supprime"), theme.isin(IMPACT_THEMES), theme.isin(RISK_THEMES)
    significance = F.when(whole, F.when(high, "eleve").otherwise("moyen")).when(total == 0, "faible").when(high, "eleve").when(risk, "moyen").otherwise(F.when(total >= 2, "moyen").otherwise("faible"))
    priority = (
        F.when(whole, F.when(high, "critique").when(risk, "prioritaire").otherwise("normale"))
        .when(total == 0, "normale")
        .when(high, F.when(labels_changed + notes_changed >= 2, "critique").otherwise("prioritaire"))
        .when(risk, F.when(total >= 2, "prioritaire").otherwise("normale"))
        .otherwise(F.when(total >= 3, "prioritaire").otherwise("normale"))
    )
    return F.struct(significance.alias("change_significance"), priority.alias("review_priority"))
