"""Blocks, boundaries, lists, enumerations and rules by cases with known answers."""

from pyspark.sql import functions as F

from driftline.functions import predicates, rules, text
from driftline.operators import alignment, chunks
from tests.test_labels import column


def test_blocks_and_boundaries(spark):
    markdown = "La banque gère son capital de\n\nmanière prudente.\n\n### Titre\nAutre phrase.\n\n- un\n- deux\n\n- trois\n\nGestion du capital\n\nLe capital est composé de plusieurs éléments importants pour la banque."
    got = column(spark, [markdown], chunks.blocks)[0]
    assert [(b["kind"], b["hard"]) for b in got] == [("paragraph", False), ("paragraph", False), ("paragraph", True), ("list", False), ("list", False), ("paragraph", False), ("paragraph", False)]
    fixed = column(spark, [markdown], lambda t: chunks.grouped_lists(chunks.labelled(chunks.repaired(chunks.blocks(t)))))[0]
    assert [b["text"] for b in fixed] == ["La banque gère son capital de manière prudente.", "Autre phrase.", "- un\n- deux\n\n- trois", "Gestion du capital\n\nLe capital est composé de plusieurs éléments importants pour la banque."]
    reasons = column(spark, [markdown], lambda t: chunks.boundaries(chunks.blocks(t)))[0]
    assert [r["disposition"] for r in reasons] == ["merge", "hard", "hard", "hard", "hard", "keep"]
    assert column(spark, [None, " \n "], chunks.blocks) == [[], []]


def test_list_items(spark):
    got = column(spark, ["- un", "  1. deux", "• • trois", "[x] quatre", "texte", "-", None], chunks.list_item)
    assert [r and tuple(r) for r in got] == [("-", "un", 0), ("1.", "deux", 2), ("-", "trois", 0), ("-", "quatre", 0), None, None, None]
    assert column(spark, ["- a\n2) b\nc"], chunks.without_markers) == ["a\nb\nc"]


def test_enumerations(spark):
    t = "Les mesures suivantes ont été prises : i) hausser le capital; ii) réduire le risque; et iii) revoir la politique."
    got = column(spark, [t, "voir a) et c) ici", "la note (1) seule", None], chunks.enumeration)
    assert [(u["unit_role"], u["marker"], u["comparison_text"]) for u in got[0]] == [("context", None, "Les mesures suivantes ont été prises :"), ("item", "i)", "hausser le capital"), ("item", "ii)", "réduire le risque"), ("item", "iii)", "revoir la politique.")]
    assert got[1:] == [None, None, None]
    assert column(spark, ["iv", "IIII", "xl", "abc"], chunks.roman_to_int) == [4, None, 40, None]


def test_chunks(spark):
    t = "Le comité examine les éléments suivants de près :\n\n- le capital\n- le risque\n\nUne phrase simple."
    df = spark.createDataFrame([("d", t, "Gestion du capital", "Section"), ("e", None, None, None)], "doc string, body string, sub string, sec string")
    got = chunks.chunks(df, ["doc"], "body", "sub", "sec").orderBy("position").collect()
    assert [(r["chunk_id"], r["kind"], r["unit_role"], r["comparison_text"], r["parent_chunk_id"]) for r in got] == [
        ("gestion_du_capital_c00", "list_context", "context", "Le comité examine les éléments suivants de près :", None),
        ("gestion_du_capital_c01", "list_item", "item", "le capital", "gestion_du_capital_c00"),
        ("gestion_du_capital_c02", "list_item", "item", "le risque", "gestion_du_capital_c00"),
        ("gestion_du_capital_c03", "paragraph", "standalone", "Une phrase simple.", None),
    ]
    assert got[0]["hierarchy_path"] == "Section > Gestion du capital" and got[1]["parent_context"] == got[0]["text"]


def test_block_predicates(spark):
    assert column(spark, ["s.o.", "- S. O.", "so what", ""], predicates.not_applicable) == [True, True, False, False]
    assert column(spark, ["(en millions de dollars canadiens)", "en millions de dollars et plus"], predicates.unit_label) == [True, False]
    assert column(spark, ["T33 État des flux (en millions de dollars)", "Tableau 3 Prêts (en milliards de dollars)", "Prêts"], predicates.table_caption) == [True, True, False]
    assert column(spark, ["24 Banque Royale du Canada Premier trimestre de 2025", "12 | BMO rapport annuel 2024", "Le premier trimestre"], predicates.running_chrome) == [True, True, False]
    assert column(spark, ["(1) Note", "Source : BSIF", "12 mots ici", "Texte."], predicates.footnote) == [True, True, True, False]
    assert column(spark, ["| a | b |\n|---|---|", "s.o.", "Texte"], predicates.comparable) == [False, False, True]
    got = column(spark, ["", "en millions de dollars", "Bonjour , monde", "s. o. – sans objet"], predicates.cleanup)
    assert [(r["keep"], r["text"], r["reason"]) for r in got] == [(False, "", "empty_fragment"), (False, "en millions de dollars", "table_unit_label"), (True, "Bonjour, monde", ""), (False, "s. o. – sans objet", "table_marker_definition")]


def test_text_functions(spark):
    assert column(spark, ["Le BSIF exige 4,5 % (voir 3) — IV points"], text.semantic) == ["Le <regulateur> exige <nombre> (voir <nombre>) points"]
    assert column(spark, ["Une phrase. " * 10], lambda t: text.truncated_at_sentence(t, 60)) == [("Une phrase. " * 5).strip()]
    assert column(spark, ["abcdef", None], lambda t: text.head_and_tail(t, 4, "..")) == ["a..f", ""]


def changes(spark, rows):
    names = "diff_type alignment_type alignment_decision source_text_t1 source_text_t2 change_summary".split()
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{n} string" for n in names))


def test_exclusions(spark):
    same = "La banque gère ses activités de manière prudente et suit ses limites internes chaque jour"
    rows = [
        ("modified", "", "moved_text", "a", "b", ""),
        ("modified", "", "", f"{same}.", f"{same} .", ""),
        ("modified", "", "", f"{same} avec soin.", f"{same} avec soin", ""),
        ("modified", "", "", "Le comité suit les limites.", "Le comité suit les limite.", ""),
        ("modified", "", "", f"{same} au 31 mars 2024.", f"{same} au 31 mai 2024.", ""),
        ("modified", "", "", f"{same} et détient 12 345 actions.", f"{same} et détient 23 456 actions.", ""),
        ("added", "", "", "", "Rachat d'actions par la banque.", ""),
        ("modified", "", "", "Le calcul est fait.", "Le calcul est fait trimestriellement.", ""),
        ("added", "", "", "", "Une ligne directrice nouvelle.", ""),
    ]
    df = changes(spark, rows)
    c = {n: F.col(n) for n in df.columns if n != "i"}
    got = df.select("i", rules.cosmetic_exclusion(c).alias("cosmetic"), rules.bank_exclusion(c).alias("bank"), rules.pure_regulatory_disclosure(c).alias("pure")).orderBy("i").collect()
    assert [r["cosmetic"] for r in got] == ["deplacement_texte", "formatage_visuel", "formatage_visuel", None, "reformulation_mineure", None, None, None, None]
    assert [r["bank"] for r in got] == [None, None, None, None, "mise_a_jour_calendrier", "variation_numerique_propre_banque", "operation_interne_banque", None, None]
    assert [r["pure"] for r in got] == [False] * 8 + [True]


def test_verdicts(spark):
    df = spark.createDataFrame([(True, True, ["risque_emergent"], "x"), (True, False, ["inconnu"], "x"), (True, True, ["LIQUIDITE"], "rachat d'actions"), (False, True, [], "x")], "is_relevant boolean, nouvelle_idee boolean, themes array<string>, source_text_t2 string")
    got = [r[0] for r in df.select(rules.triage({n: F.col(n) for n in df.columns})).collect()]
    assert [(r["impact_level"], r["action_requise"], r["themes"], r["exclusion_reason"]) for r in got] == [
        ("MAJEUR", "revue_prioritaire", ["RISQUE_EMERGENT"], None), ("MODERE", "investigation", ["SUJET_EMERGENT_HORS_GRILLE"], None), ("MINEUR", "aucune", [], "operation_interne_banque"), ("MINEUR", "aucune", [], "non_pertinent_autre")]
    names = ["Risque de crédit accru", "Les tarifs : guerre commerciale", "ratio CET1", "rien"]
    assert column(spark, names, lambda t: rules.category({}, t)) == ["10 — Risque de crédit", "5 — Géopolitique", "16 — Fonds propres", "2 — Cadre de gestion des risques"]
    assert column(spark, ["Gestion du capital", "Regulatory updates", "Autre chose"], rules.canonical_section) == ["capital_management", "regulatory_updates", "autre_chose"]


def test_alignment(spark):
    side = "block string, unit string, text string, heading string, order int"
    left = spark.createDataFrame([("b", "l1", "alpha beta gamma", "h", 0), ("b", "l2", "un deux trois", "h", 1), ("b", "l3", "quatre cinq", "h", 2)], side)
    right = spark.createDataFrame([("b", "r1", "alpha beta gamma", "h", 0), ("b", "r2", "un deux trois quatre cinq", "h", 1)], side)
    pairs = spark.createDataFrame([("b", "l1", "r1", 1.0, 0.95), ("b", "l1", "r2", 0.1, 0.2), ("b", "l2", "r2", 0.7, 0.86), ("b", "l3", "r2", 0.5, 0.6)], "block string, left string, right string, tfidf double, embedding double")
    got = alignment.aligned_hybrid(pairs, left, right)
    assert {(r["left"], r["right"], r["alignment_type"]) for r in got.collect()} == {("l1", "r1", "matched_strong"), ("l2", "r2", "matched_strong"), ("l3", None, "possible_removed")}
    grown = alignment.regrouped(got, left, right).collect()
    assert [(r["left"], r["right"], r["added_left"]) for r in grown] == [("l2", "r2", "l3")]
    words = alignment.aligned_tfidf(pairs.drop("embedding"), left, right).collect()
    assert {(r["left"], r["right"]) for r in words} == {("l1", "r1"), ("l2", "r2"), ("l3", None)}
    assert column(spark, ["aa bb cc dd"], lambda t: alignment.residual(t, F.array(F.lit("bb"), F.lit("dd"), F.lit("zz")))) == ["aa cc"]


def test_subsections(spark):
    df = spark.createDataFrame([("d", "intro\n### Un [pdf.3]\ncorps 1\n### Vide\n### Deux\ncorps 2")], "d string, t string")
    got = alignment.subsections(df, ["d"], "t").orderBy("position").collect()
    assert [(r["heading"], r["body"]) for r in got] == [("__intro__", "intro"), ("Un [pdf.3]", "corps 1"), ("Deux", "corps 2")]
    other = spark.createDataFrame([("d", "### UN\nautre\n### Trois\ncorps 3")], "d string, t string")
    pairs = alignment.paired_subsections(alignment.subsections(df, ["d"], "t"), alignment.subsections(other, ["d"], "t"), ["d"])
    found = {(r["diff_type"], r["subsection_heading"]) for r in alignment.subsection_changes(pairs, ["d"]).collect()}
    assert found == {("removed", "__intro__"), ("removed", "Deux"), ("added", "Trois"), ("renamed", "Un [pdf.3] → UN")}


def test_costly_rules_of_units_come_last(spark):
    """Sentences are cut once for a verdict, words counted only behind a colon, texts cut only where they have marks."""
    rule = str(chunks.needs_partition(F.col("t")))
    assert rule.count("split(") == 1
    context = str(predicates.list_context(F.col("t")))
    assert context.index("endswith") < context.index("regexp_extract_all")
    texts = ["Un deux trois quatre cinq :", "un deux :", "| a | b |\n| - | - |", "a | b", "|---|---|", None, "s.o.", "x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.orderBy("i").select(predicates.list_context(F.col("t")).alias("c"), predicates.comparable(F.col("t")).alias("k")).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, True), (False, False), (False, True), (False, False), (False, False), (False, False), (False, True)]
