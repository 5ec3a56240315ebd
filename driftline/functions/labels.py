"""Row labels, table titles and header cells: the keys under which they are found again, and what they are not.

Every function works on one column and stays in built-in expressions; null counts as empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftline.functions.text import blank, folded, joined_letters, let, squeezed

# What dates, units, notes and headings look like in French and English reports (accents folded).
MONTHS_FR = "janv(?:ier)?|fevr(?:ier)?|mars|avr(?:il)?|mai|juin|juill(?:et)?|aout|sept(?:embre)?|oct(?:obre)?|nov(?:embre)?|dec(?:embre)?"
MONTHS_EN = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
MONTH_NAMES_FR = "janvier|fevrier|mars|avril|mai|juin|juillet|aout|septembre|octobre|novembre|decembre"
MONTH_NAMES_EN = "january|february|march|april|may|june|july|august|september|october|november|december"
SUPERSCRIPTS = "¹²³⁴⁵⁶⁷⁸⁹⁰"
NUMERIC_DATE = r"\d{1,2}[\s./-]\d{1,2}[\s./-]\d{2,4}|\d{4}[\s./-]\d{1,2}[\s./-]\d{1,2}"
DATE_ALONE = rf"(?i)^\s*(?:au|a|as\s+at|as\s+of|for\s+the\s+(?:period|quarter)\s+ended)\s+(?:{NUMERIC_DATE}|\d{{1,2}}\s+(?:{MONTHS_FR}|{MONTHS_EN})[\s.]*(?:\d{{4}})?|(?:{MONTHS_FR}|{MONTHS_EN})[\s.]*\d{{4}})\s*$"
DATE_PREFIX = r"(?i)^\s*(?:au\b|a\s|as\s+at|as\s+of|for\s+the\s+(?:period|quarter)\s+ended|trimestre\s+termine\s+le|pour\s+la\s+periode\s+close\s+le)\s*"
DATE_SUFFIX = rf"(?i)(?:[\s\-–—,;]+(?:au|a|as\s+at|as\s+of|le|du)\s+)?(?:{NUMERIC_DATE}|\d{{1,2}}\s+(?:{MONTHS_FR}|{MONTHS_EN})[\s.]*(?:\d{{2,4}})?|(?:{MONTHS_FR}|{MONTHS_EN})[\s.]*\d{{2,4}}|[tq][1-4]\s+20\d{{2}}|(?:1er|premier|deuxieme|troisieme|quatrieme)\s+trimestre\s+20\d{{2}}|exercice\s+20\d{{2}})\s*$"
TEMPORAL = [
    r"(?i)\b(?:as at|au)\b",
    r"(?i)\b(?:for the quarter ended|quarter ended|trimestre termine le)\b",
    r"(?i)\b(?:trimestre|quarter)\s*(?:[1-4]|i{1,3}|iv)\b",
    r"(?i)\b(?:t|q)\s*[1-4]\b",
    r"(?i)\b(?:s|h)\s*[12]\b",
    r"(?i)\b(?:1er|premier|deuxieme|troisieme|quatrieme)\s+trimestre\b",
]
CALENDAR = [r"\b(?:19|20)\d{2}\b", r"\b\d{1,2}[/-]\d{1,2}(?:[/-]\d{2,4})?\b", rf"(?i)\b(?:{MONTH_NAMES_FR}|{MONTH_NAMES_EN})\b"]
UNIT_PHRASE = r"(?i)[\s\-–—]+(?:(?:en\s+)?(?:millions?|milliards?|milliers?)\s+de\s+dollars?\s+canadiens?|(?:en\s+)?(?:millions?|milliards?|milliers?)\s+de\s+dollars?|(?:en\s+)?(?:millions?|milliards?|milliers?)\s+dollars?|en\s+milliers?\s+(?:d\s*'?\s*actions?|de\s+parts?)|en\s+\$|en\s+G\s*\$|en\s+M\s*\$|en\s+k\s*\$|(?:en\s+)?pourcentage|points?\s+de\s+base|\bpb\b|\bbps\b)\s*$"
UNIT_PARENTHESIS = r"(?i)\s*\(\s*(?:(?:en\s+)?(?:millions?|milliards?|milliers?)\s*(?:de\s+dollars?)?|M\s*\$?|G\s*\$?|k\s*\$?|%|CAD|USD|EUR)\s*\)\s*"
UNIT_HEADER = r"(?i)^\(?(?:\s*en\s+(?:millions?|milliards?|milliers?)\s+de\s+dollars|\s*in\s+(?:millions?|billions?|thousands?)(?:\s+of\s+(?:Canadian\s+)?dollars)?)(?:\s+canadiens)?(?:\s*,?\s*(?:sauf\s+indication\s+contraire|except\s+(?:as|where|otherwise)\s+\w+))?\s*\)?\s*"
UNIT_SHARES = r"(?i)^\(?\s*en\s+milliers?\s+(?:d\s*'?\s*actions?|de\s+parts?)"
UNIT_IN_TITLE = r"(?i)\s*[\(\[]?\s*(?:en\s+)?(?:millions?|milliards?)\s*(?:de\s+dollars?|\s*\$|dollars?)?|[\(\[]?\s*en\s+\$\s*[\)\]]?|[\(\[]?\s*(?:en\s+)?dollars?\s*[\)\]]?|[\(\[]?\s*%\s*[\)\]]?\s*[\)\]]?\s*"
NOTE = rf"\(\d+\)|\[\d+\]|\([a-zA-Z]\)|[a-zA-Z]\)|[*†‡]+|[{SUPERSCRIPTS}]+"
TRAILING_NOTE = rf"\s*(?:{NOTE})\s*$"
TRAILING_NOTES = rf"(?:\s*,?\s*(?:[\(\[]\d+[\)\]]|\([a-zA-Z]\)|[a-zA-Z]\)|[*†‡]+|[{SUPERSCRIPTS}]+))+[\s,;:.]*$"
TRAILING_NUMBER = r"\s+\d{1,4}(?:[.,]\d+)?\s*$"
MEANT_NUMBERS = [
    r"\b(?:pilier|pillar|niveau|tier|phase|etape)\s+[0-9]+\b",
    r"\b(?:ratio|note|scenario)\s+[0-9]+\b",
    r"\b(?:serie|series|tranche|classe|class)\s+[0-9]+\b",
    r"\b(?:categorie|category)\s+[0-9]+\b",
    r"\b(?:cet|tier|pilier|pillar|at|tlac|lcr|nsfr)\s*[0-9]+\b",
]
NOTE_LINE = r"(?i)^\s*(?:[\(\[]\d+[\)\]]|\d+\)|[a-z]\)|note\s*\d+\s*[.:\-–—]?)\s*"
DATE_LINES = [
    r"^pour\s+les?\s+trois\s+mois(?:\s+.*)?$",
    r"^pour\s+la\s+periode(?:\s+.*)?$",
    r"^pour\s+l[' ]exercice(?:\s+.*)?$",
    r"^au\s*\d{1,2}\s*[a-z]+(\s*\d{4})?\s*(\(.*\))?\s*$",
    r"^\d{1,2}\s+[a-z]+(\s+\d{4})?$",
    r"^\d{1,2}[/-]\d{1,2}[/-]\d{2,4}$",
    r"^\d{4}[/-]\d{1,2}[/-]\d{1,2}$",
    r"^trimestre\s+termine(?:\s+le)?(?:\s+.*)?$",
    r"^trimestre\s+clos\s+le(?:\s+.*)?$",
    r"^pour\s+le\s+trimestre\s+termine(?:\s+le)?(?:\s+.*)?$",
    r"^pour\s+le\s+trimestre\s+clos(?:\s+le)?(?:\s+.*)?$",
    r"^20\d{2}$",
    r"^[tq][1-4]\s+20\d{2}$",
    r"^as\s+at\s+.+$",
    r"^for\s+the\s+quarter\s+ended(?:\s+.*)?$",
    r"^for\s+the\s+three\s+months(?:\s+.*)?$",
    r"^for\s+the\s+period(?:\s+.*)?$",
]
DATE_LINES_WITH_MORE = [
    r"^\s*au\s+\d{1,2}\s+[a-z]+\s+\d{4}\b.*$",
    r"^\s*(?:as\s+of|at)\s+\w+\s+\d{1,2},\s*\d{4}\b.*$",
    rf"^\s*\d{{1,2}}\s+(?:{MONTH_NAMES_FR})(?:\s+\d{{4}})?(?:\s+[\d,\s*]+)?\s*$",
    r"^\s*au\s+\d{1,2}\s+[a-z]+(?:\s+\d{4})?(?:\s*[\d,\s\)*]+)?\s*$",
]
UNIT_LINES = [
    r"^\s*en\s*$",
    r"^\s*en\s+(?:millions?|milliards?|milliers?)\b.*$",
    r"^\s*\(?\s*en\s+(?:millions?|milliards?|milliers?)\s+de\s+\w+.*$",
    r"^\s*in\s+(?:millions?|billions?|thousands?)\b.*$",
    r"^\s*moyenne\s+du\s+trimestre\s+(?:clos|termine)\b.*$",
]
UNIT_WORD = r"^\s*(?:en\s+millions?\s+de\s+dollars?|sorties|ca|\$\s*ca|%)\s*$"
UNIT_START = r"^\s*\(?\s*(?:en\s+)?(?:millions?|milliards?|milliers?)\s*(?:de\s+)?(?:dollars?|\$|cad|usd)?\b"
TOTAL_START = r"^\s*total\s+(?:du|des)\b"
TOTAL_ALONE = r"^\s*total\s+(?:du\s+passif\s+et\s+des\s+capitaux?\s+propres|des\s+elements?\s+hors\s+bilan)\s*$"
TOTAL_MEANT = r"^\s*total\s+(?:des\s+fonds\s+propres|des\s+actifs\s+ponder|du\s+capital|de\s+la\s+capacite|tlac|des\s+expositions?|des\s+provisions?|des\s+prets?|des\s+depots?|des\s+revenus?|des\s+charges?|des\s+passifs?)\b"
NOTES_AT_END = rf"\s*(?:[\(\[]\d+[\)\]]|[{SUPERSCRIPTS}]+|[*†‡§]+|,\s*\d+(?:\s*,\s*\d+)*)*\s*$"
COLON_MEANT = r"^\s*(?:titres?|depots?\s+(?:stables?|non\s+stables?|operationnels?|de\s+particuliers?)|financement\s+(?:non\s+garanti|garanti|de\s+gros)|prets?\s+class|titres?\s+liquides?|sorties?\s+de\s+tresorerie|entrees?\s+de\s+tresorerie|engagements?\s+hors\s+bilan|actifs?|passifs?\s+et\s+(?:capitaux|interdependants?)|passifs?\s+(?:et\s+)?autres|ventilation|autres\s+passifs?|depots?|fonds\s+propres)"
SECTION_NAMES = ["general", "liquidite", "risque de credit", "autres risques", "risque de marche", "risque operationnel"]
SAME_IN_PLURAL = "frais moins plus cours temps cas mois pays tiers poids biais avis sens fonds corps bras choix voix prix noix index flux taux bas hors sous vers dans sans puis tres apres mais des les ces ses nos vos tes mes aux".split()
WORDINGS = [
    (r"\bd\s+impots\b", "d impot"),
    (r"\b(?:avec|aux)\s+termes?\b", " terme "),
    (r"\bpremiere?\s+tranche\b", "tranche 1"),
    (r"\bdeuxieme?\s+tranche\b", "tranche 2"),
    (r"\btroisieme?\s+tranche\b", "tranche 3"),
    (r"\bquatrieme?\s+tranche\b", "tranche 4"),
]
WORDINGS_AT_LAST = [
    (r"\bdes\s+taux\b", "de taux"),
    (r"\bactif net des regimes? de retraite a prestations? definies?\b", "actif des regimes de retraite a prestations definies"),
    (r"\b(?:lie|liee|lies|liees)\b", "lie"),
    (r"\b(?:relatif|relative|relatifs|relatives)\b", "relatif"),
    (r"\bresiduels\b", "residuel"),
]
GENERIC_TITLES = ["tableau", "table", "resultats", "informations", "donnees", "annexe", "tableau principal", "details", "autres", "total"]
HEADER_TYPES = [
    ("PERCENT", r"%|pourcentage|percent"),
    ("CURRENCY", r"\b(?:dollars?|cad|usd|eur|en\s+millions?|en\s+milliards?|in\s+millions?|in\s+billions?)\b"),
    ("DATE", rf"\b(?:au|as at|ended|termine|clos|trimestre|quarter|q[1-4]|t[1-4]|{MONTH_NAMES_FR}|{MONTH_NAMES_EN})\b"),
    ("YEAR", r"\b(?:19|20)\d{2}\b"),
    ("NUMBER", r"\d"),
]
RUNNING_TITLES = [r"(?i)(?:\d+\s+)?Banque\s+Royale\s+du\s+Canada\s+(?:Premier|Deuxi[eè]me|Troisi[eè]me|Quatri[eè]me)\s+trimestre", r"(?i)^\s*\d+\s+[A-Za-z].*(?:trimestre|quarter)\b"]
TITLE_DATES = [r"(?i)\b(?:au|as at|for the quarter ended|trimestre termine le)\b.*$", rf"(?i)^\s*\d{{1,2}}\s+(?:{MONTH_NAMES_FR})(?:\s+\d{{4}})?\s*$", rf"(?i)^\s*\d{{1,2}}\s+(?:{MONTH_NAMES_FR})(?:\s+\d{{4}})?\s+", rf"(?i)\s+\d{{1,2}}\s+(?:{MONTH_NAMES_FR})(?:\s+\d{{4}})?\s*$"]


def _rewritten(text: Column, rules: list[tuple[str, str]]) -> Column:
    return reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), rules, text)


def _rewritten_if(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The same for rules that rarely apply: where none of them is found none is tried."""
    return let(text, lambda t: F.when(_any(t, [p.removeprefix("(?i)") if p.startswith("(?i)") else f"(?-i:{p})" for p, _ in rules]), _rewritten(t, rules)).otherwise(t))


def _any(text: Column, patterns: list[str], flags: str = "(?i)") -> Column:
    """Whether one of the patterns is found, by one expression of them all."""
    return text.rlike(flags + "|".join(f"(?:{p})" for p in patterns))


def _without(text: Column, *patterns: str) -> Column:
    return _rewritten(text, [(p, "") for p in patterns])


def _n_words(text: Column) -> Column:
    """Words between white space; 0 for a blank text."""
    return F.when(squeezed(text) == "", 0).otherwise(F.size(F.split(squeezed(text), " ")))


def ascii_folded(text: Column) -> Column:
    """Accents folded, and every other sign outside ASCII left out."""
    return let(folded(text), lambda t: F.when(F.octet_length(t) == F.length(t), t).otherwise(F.regexp_replace(t, r"[^\x00-\x7f]", "")))


def matching_key(text: Column) -> Column:
    """Accent-free lower-case letters and digits, single-spaced."""
    t = F.lower(ascii_folded(text))
    return squeezed(F.regexp_replace(F.regexp_replace(t, r"[_\-/]+", " "), r"[^a-z0-9\s]", " "))


def without_periods(text: Column, calendar: bool = True) -> Column:
    """Without phrases that name a period, and without years, dates and months where ``calendar`` is set."""
    t = _rewritten_if(ascii_folded(text), [(p, " ") for p in TEMPORAL + (CALENDAR if calendar else [])])
    return _without(squeezed(t), r"^[ \-:;,./]+", r"[ \-:;,./]+$")


def without_dates(label: Column) -> Column:
    """A row label without its dates; empty if it is nothing but one."""
    return let(folded(F.trim(blank(label))), lambda t: F.when(t.rlike(DATE_ALONE), "").otherwise(squeezed(without_periods(_without(t, DATE_PREFIX, DATE_SUFFIX)))))


def without_units(label: Column) -> Column:
    """A row label without units and currencies in brackets or at its end."""
    return squeezed(_without(F.trim(blank(label)), UNIT_PARENTHESIS, UNIT_PHRASE))


def without_trailing_value(label: Column) -> Column:
    """Without digits glued to the last word, a note at the end, and a number after it."""
    t = F.regexp_replace(blank(label), r"([^\d\s]+)\d+$", "$1")
    return squeezed(_without(t, TRAILING_NOTE, TRAILING_NUMBER))


def number_is_meant(label: Column) -> Column:
    """Whether a number belongs to the name: a tier, a series, a ratio."""
    return let(matching_key(label), lambda key: _any(key, MEANT_NUMBERS, ""))


def without_note_variants(label: Column) -> Column:
    """The matching key without notes at the end, nor a number there that is not meant."""
    bare = _without(blank(label), TRAILING_NOTES, TRAILING_NOTE)
    return let(bare, lambda t: matching_key(F.when(number_is_meant(t), t).otherwise(_without(t, TRAILING_NUMBER))))


def without_repeated_name(label: Column, pattern: str) -> Column:
    """``X (X more)`` or ``X: X more`` as what says more, by a pattern of two groups."""
    clean = lambda t, k: _without(squeezed(F.regexp_extract(t, pattern, k)), r"^[ \-:;,]+", r"[ \-:;,]+$")
    key = lambda t: matching_key(F.regexp_replace(t, r"[^a-zA-Z0-9\sÀ-ÿ]", " "))

    def shorter(t: Column) -> Column:
        def chosen(p: Column) -> Column:
            found = (p["a"] != "") & (p["b"] != "")
            return F.when(found & (p["a"] == p["b"]), p["name"]).when(found & p["b"].startswith(F.concat(p["a"], F.lit(" "))), p["more"]).otherwise(t)

        parts = let(F.struct(clean(t, 1).alias("name"), clean(t, 2).alias("more")), lambda x: F.struct(x["name"].alias("name"), x["more"].alias("more"), key(x["name"]).alias("a"), key(x["more"]).alias("b")))
        return F.when(t.rlike(pattern), let(parts, chosen)).otherwise(t)

    return let(blank(label), shorter)


def without_repeated_parenthesis(label: Column) -> Column:
    return without_repeated_name(label, r"^\s*([^()]+?)\s*\(\s*([^()]+?)\s*\)\s*[.]?\s*$")


def without_repeated_separator(label: Column) -> Column:
    return without_repeated_name(label, r"^\s*([^:;–—-]+?)\s*[:;–—-]\s*(.+?)\s*$")


def singular(text: Column) -> Column:
    """Words of over three letters without their final s, but for those that have it in the singular too."""
    one = lambda w: F.when((F.length(w) > 3) & w.endswith("s") & ~w.isin(SAME_IN_PLURAL), F.left(w, F.length(w) - 1)).otherwise(w)
    return F.array_join(F.transform(F.split(squeezed(text), " "), one), " ")


def _unit_header(plain: Column) -> Column:
    rest = F.trim(F.regexp_replace(plain, UNIT_HEADER, ""))
    return plain.rlike(UNIT_SHARES) | (plain.rlike(UNIT_HEADER) & F.trim(F.regexp_replace(rest, r"[\d)*\s]+$", "")).rlike(r"(?i)^$|^(?:au|as\s+at|pour|for)\b"))


def _plain(text: Column) -> Column:
    return F.trim(ascii_folded(F.trim(blank(text))))


def date_line(text: Column) -> Column:
    """A line that is only a period, a unit or the start of a note."""
    return let(_plain(text), lambda t: (t != "") & (_any(t, DATE_LINES + UNIT_LINES + DATE_LINES_WITH_MORE) | _unit_header(t) | t.rlike(NOTE_LINE)))


def section_line(text: Column) -> Column:
    """A short label that ends in a colon, notes aside, and neither names an item with sub-lines nor breaks one down."""
    core = F.rtrim(F.regexp_replace(F.trim(folded(blank(text))), NOTES_AT_END, ""))

    def heads(c: Column) -> Column:
        label = F.trim(F.regexp_replace(c, r":+$", ""))
        return c.endswith(":") & (label != "") & (_n_words(label) <= 8) & ~label.rlike("(?i)" + COLON_MEANT) & ~label.rlike("(?i)dont|including|of which")

    return let(core, heads)


def excluded_line(text: Column) -> Column:
    """Why a line is no row label: number, total, section_header, unit, footnote or date; null if it may be one."""
    def why(t: Column) -> Column:
        n = _n_words(t)
        like = lambda *p: _any(t, list(p))
        return (
            F.when(t == "", F.lit(None).cast("string"))
            .when(t.rlike(r"^\s*\d+\s*$"), "number")
            .when(like(TOTAL_ALONE) | (like(TOTAL_START) & (n <= 6) & ~like(TOTAL_MEANT)), "total")
            .when(section_line(text), "section_header")
            .when(like(UNIT_WORD, *UNIT_LINES) | (like(UNIT_START) & (n <= 12)) | _unit_header(t), "unit")
            .when(t.rlike(NOTE_LINE), "footnote")
            .when(like(*DATE_LINES, *DATE_LINES_WITH_MORE), "date")
            .when(F.lower(squeezed(t)).isin(SECTION_NAMES), "section_header")
        )

    return let(_plain(text), why)


def _undated(t: Column) -> Column:
    """A label without dates and units, the units staying where nothing else would be left."""
    return let(without_dates(t), lambda u: let(without_units(u), lambda v: F.when(F.length(F.regexp_replace(v, r"\W", "")) >= 2, v).otherwise(u)))


def _without_unit_header(t: Column) -> Column:
    rest = F.when(t.rlike(UNIT_HEADER), F.trim(F.regexp_replace(t, UNIT_HEADER, ""))).otherwise(F.trim(F.regexp_replace(t, UNIT_SHARES, "")))
    return let(rest, lambda r: F.when(r == "", t).otherwise(r))


def _without_total(t: Column) -> Column:
    prefix = r"^total\s+(?:des?\s+|du\s+|d[' ]\s*)"
    return let(F.trim(F.regexp_replace(t, prefix, "")), lambda r: F.when(t.rlike(prefix) & (_n_words(r) >= 2), r).otherwise(t))


def label_key(label: Column) -> Column:
    """The key under which the label of a row is found again in another period; empty for a line that is no label."""
    t = F.regexp_replace(folded(label), r"^\d{1,3}\s+(?=[A-Za-z])", "")
    t = F.regexp_replace(F.regexp_replace(t, "[’`´ʼʻ＇]", "'"), r"(?i)\b([dljscnmt])'\s+", "$1'")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, "[\"“”‘’]", " "), r"[\s ]+", " "))
    t = without_repeated_separator(without_repeated_parenthesis(t))
    t = F.regexp_replace(t, r"(?i)(series?\s+\d{4})[-\s]*[a-z0-9]+(?:\(\d+\))?", "$1")
    t = squeezed(joined_letters(t))
    t = F.regexp_replace(t, rf"\)\s*[\d{SUPERSCRIPTS}]{{1,3}}", ")")
    t = F.regexp_replace(t, rf"(?<=[a-zA-Z]{{5}})[\d{SUPERSCRIPTS}]{{1,2}}(?=\W|$)", "")

    def key(c: Column) -> Column:
        k = _undated(c)
        k = F.regexp_replace(F.regexp_replace(k, r"\b(\d{1,3})[.,]0{1,4}(?=\s*%)", "$1"), r"\b(\d{1,3})[.,](\d{0,3}[1-9])0*(?=\s*%)", "$1,$2")
        k = F.regexp_replace(let(k, _without_unit_header), r"(?i)d'impots?", "d'impot")
        k = _rewritten_if(without_note_variants(k), WORDINGS)
        k = let(k, lambda x: F.when(number_is_meant(x), x).otherwise(without_trailing_value(x)))
        k = let(singular(F.lower(squeezed(_rewritten_if(k, WORDINGS_AT_LAST)))), _without_total)
        return F.when((c == "") | date_line(c) | excluded_line(c).isNotNull(), "").otherwise(k)

    return let(t, key)


def header_type(cell: Column) -> Column:
    """What a header cell names: EMPTY, PERCENT, CURRENCY, DATE, YEAR, NUMBER or TEXT, the first that holds."""
    def first(key: Column) -> Column:
        return reduce(lambda out, t: out.when(key.rlike(t[1]), t[0]), HEADER_TYPES, F.when(key == "", "EMPTY")).otherwise("TEXT")

    return let(matching_key(cell), first)


def header_types(cells: Column) -> Column:
    return F.transform(F.coalesce(cells, F.array().cast("array<string>")), header_type)


def generic_title(title: Column, more: list[str] | None = None) -> Column:
    """A title that names nothing in particular."""
    key = matching_key(title)
    extra = [matching_key(F.lit(x)) for x in more or ()]
    return reduce(lambda a, b: a | b, [key == x for x in extra], (key == "") | key.isin(GENERIC_TITLES))


def running_title(title: Column) -> Column:
    """A page header or footer that was read as a title."""
    return _any(F.trim(blank(title)), RUNNING_TITLES, "")


def title_without_dates(title: Column) -> Column:
    t = _without(folded(title), TITLE_DATES[0])
    return F.when(F.trim(t).rlike(TITLE_DATES[1]), "").otherwise(squeezed(without_periods(_without(t, TITLE_DATES[2], TITLE_DATES[3]))))


def title_without_notes(title: Column) -> Column:
    """Without note references at the end; a number of its own, as in ``Tableau 12``, stays."""
    t = _without(blank(title), r"\s*[\(\[]\d+[\)\]]\s*$", r"\s*\d+\)\s*$")
    return squeezed(_without(F.regexp_replace(t, r"([a-zA-ZÀ-ÿ])\d+\s*$", "$1"), r"\s+\d+\s*,\s*\d+(?:\s*,\s*\d+)*\s*$"))


def title_without_units(title: Column, bank: Column | None = None) -> Column:
    """Without units; of one bank's titles a subtitle is cut after twelve words."""
    t = squeezed(F.regexp_replace(blank(title), UNIT_IN_TITLE, " "))
    if bank is None:
        return t
    head, words = F.substring_index(t, " - ", 1), F.split(squeezed(F.substring(t, F.length(F.substring_index(t, " - ", 1)) + 4, 1_000_000)), " ")
    long = (F.lower(F.trim(blank(bank))) == "rbc") & t.contains(" - ") & (F.size(words) > 12)
    return F.when(long, F.concat(head, F.lit(" - "), F.array_join(F.slice(words, 1, 12), " "))).otherwise(t)


def title_without_values(title: Column) -> Column:
    """Without the runs of two or more numbers that a title took over from the columns."""
    run = r"\d+(?:[.,]\d+)?(?:\s*,?\s*\d+(?:[.,]\d+)?)+"
    return squeezed(_without(F.trim(blank(title)), rf"\s+{run}\s*$", rf"^\s*{run}\s+"))


def title_has_values(title: Column, share: float = 0.4, trailing: int = 2, run: int = 3) -> Column:
    """A run of numbers, too large a share of them, or some at the end."""
    words = F.split(squeezed(title), " ")
    numbers = F.transform(words, lambda w: w.rlike(r"^[\d,.]+$").cast("int"))
    n = F.aggregate(numbers, F.lit(0), lambda a, x: a + x)
    line = F.array_join(numbers.cast("array<string>"), "")
    return (squeezed(title) != "") & (line.contains("1" * run) | line.endswith("1" * trailing) | ((n >= 2) & (n / F.size(words) > share)))


def split_case(text: Column) -> Column:
    """A space where a small letter meets a capital."""
    return F.regexp_replace(blank(text), "([a-z])([A-Z])", "$1 $2")


def split_change_tag(text: Column) -> Column:
    return F.regexp_replace(blank(text), "^(AJOUT|SUPPRESSION|RENOMMAGE)(?=[a-zA-ZÀ-ÿ])", "$1 ")


def post_normalized(text: Column) -> Column:
    """Both splits, and whether each changed anything."""
    case = split_case(text)
    tag = split_change_tag(case)
    return F.struct(tag.alias("text"), (case != blank(text)).alias("case_split"), (tag != case).alias("tag_split"))


def note_refs(label: Column) -> Column:
    """A label without its notes, and their numbers in order, repeats kept; a glued digit counts after five letters."""
    marks = rf"\((\d{{1,2}})\)|\[(\d{{1,2}})\]|([{SUPERSCRIPTS}])"
    t = blank(label)
    found = F.transform(F.regexp_extract_all(t, F.lit(marks), F.lit(0)), lambda m: F.translate(m, SUPERSCRIPTS + "()[]", "1234567890"))
    bare = F.rtrim(F.regexp_replace(t, marks, ""))
    glued = F.regexp_extract(bare, r"[A-Za-zÀ-ÿ]{5}(\d)$", 1)
    refs = F.when(glued != "", F.concat(found, F.array(glued))).otherwise(found)
    return F.struct(squeezed(F.when(glued != "", F.left(bare, F.length(bare) - 1)).otherwise(bare)).alias("text"), refs.alias("refs"))


def first_column(labels: Column) -> Column:
    """Labels of a table as entries: place from 0, text without notes, key, note numbers."""
    def entry(label: Column, i: Column) -> Column:
        return let(note_refs(label), lambda n: F.struct(i.alias("row_idx"), n["text"].alias("text"), matching_key(n["text"]).alias("text_norm"), n["refs"].alias("note_refs")))

    return F.transform(F.coalesce(labels, F.array().cast("array<string>")), entry)


def coerced_int(value: Column) -> Column:
    """A whole number, 0 where there is none."""
    return F.coalesce(value.try_cast("int"), F.lit(0))


def coerced_float(value: Column) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(0.0))
