"""Footnotes and the labels that refer to them: markers, parsing, keys for differences, and lines that go on.

Arrays are those of one table, so what depends on order is an expression over them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftline.functions.labels import SUPERSCRIPTS, matching_key
from driftline.functions.text import blank, let, squeezed

# Dates, pages and markers as notes have them, and what starts or continues a label.
MONTHS = "janvier|février|mars|avril|mai|juin|juillet|août|septembre|octobre|novembre|décembre"
NOTE_DATE = rf"(?iu)\d{{1,2}}\s*(?:{MONTHS})\s*\d{{4}}|T[1-4]\s*[-–]?\s*\d{{4}}|\d{{4}}\s*[-–]?\s*T[1-4]|(?:premier|deuxième|troisième|quatrième)\s+trimestre\s+\d{{4}}"
NOTE_PAGES = r"(?iu)pages?\s+\d+\s*[àa]\s*\d+"
DATE_PREFIX = rf"(?iu)^(?:Au\s+)?\d{{1,2}}\s+(?:{MONTHS})\s+\d{{4}}\s*[–—−\-]\s*"
NOTE_START = r"^\s*\(?(\d+)\)?\s*[.:\-–—]?\s*"
NEW_ITEMS = ["total", "region", "région", "region:", "région:", "passifs", "actifs", "capitaux propres", "capital", "resultat", "résultat"]
GOING_ON = "a à au aux avec category catégorie categories catégories de des du en et fonds for of or ordinaires par pour propres supplementaire supplementaires supplémentaire supplémentaires sur termes the".split()
MARKS = r"[¹²³⁴⁵⁶⁷⁸⁹⁰*†‡\[\](){}<>.,;:\-–—/\\]"
TOKEN = "[A-Za-zÀ-ÿ0-9¹²³⁰-ₙ]+"


def _unsuperscripted(text: Column) -> Column:
    return F.translate(text, SUPERSCRIPTS, "")


def without_markers(text: Column) -> Column:
    """Without ``(1)``."""
    return F.trim(F.regexp_replace(blank(text), r"\s*\(\d{1,2}\)\s*", ""))


def indicator_text(name: Column) -> Column:
    """A label in lower case without note marks."""
    return F.lower(squeezed(_unsuperscripted(F.regexp_replace(F.trim(blank(name)), r"\s*[\(\[]\d{1,2}[\)\]]\s*", ""))))


def note_text(text: Column) -> Column:
    """A note in lower case with its dates and page ranges masked."""
    return F.lower(squeezed(F.regexp_replace(F.regexp_replace(F.trim(blank(text)), NOTE_DATE, "__DATE__"), NOTE_PAGES, "__PAGE__")))


def without_references(text: Column) -> Column:
    """Page ranges and dates as tokens; nothing else changes."""
    return F.trim(F.regexp_replace(F.regexp_replace(blank(text), NOTE_PAGES, "__PAGE__"), rf"(?iu)\d{{1,2}}\s*(?:{MONTHS})\s*\d{{4}}", "__DATE__"))


def diff_name(name: Column) -> Column:
    """A label as differences are shown: no marks, block numbers, dates in front or closing punctuation, plain dashes."""
    t = _unsuperscripted(F.regexp_replace(F.trim(blank(name)), r"\s*[\(\[]\d{1,2}[\)\]]\s*$", ""))
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)\s*\(bloc\s+\d+\)\s*$", ""), DATE_PREFIX, "")
    return squeezed(F.regexp_replace(F.regexp_replace(t, r"\s*[–—−‐]\s*", " - "), r"[:;,. ]+$", ""))


def without_header_prefix(labels: Column, reach: int = 7) -> Column:
    """Labels by ``diff_name``, without the name of a header up to ``reach`` rows above that they repeat before a dash."""
    def stripped(names: Column) -> Column:
        def one(name: Column, i: Column) -> Column:
            above = F.slice(names, F.greatest(i - reach + 1, F.lit(1)), F.least(i, F.lit(reach)))
            heads = F.filter(above, lambda h: (h != "") & name.startswith(F.concat(h, F.lit(" - "))) & (F.length(name) > F.length(h) + 3))
            return let(F.try_element_at(heads, F.lit(-1)), lambda h: F.when(h.isNotNull(), F.substring(name, F.length(h) + 4, F.length(name))).otherwise(name))

        return F.transform(names, lambda n, i: F.when(i > 0, one(n, i)).otherwise(n))

    return let(F.transform(labels, diff_name), stripped)


def only_noise(previous: Column, current: Column, note: bool = False) -> Column:
    """Whether a rename changes nothing but a marker (a label) or a date or page (a note)."""
    clean = without_references if note else without_markers
    return clean(previous) == clean(current)


def marker_id(value: Column) -> Column:
    """A marker without brackets, superscripts plain, in lower case."""
    t = F.translate(F.trim(blank(value)), "⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789")
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(t, r"^(?:\(\s*|\[\s*|\{\s*)+(?=.*[)\]}]$)", ""), r"(?:\s*[)\]}])+$", "")))


def marker_ids(values: Column) -> Column:
    """The markers that titles, headers or labels show, once each, sorted."""
    marks = lambda v: F.concat(F.regexp_extract_all(blank(v), F.lit("[⁰¹²³⁴-⁹*†‡]+"), F.lit(0)), F.regexp_extract_all(blank(v), F.lit(r"\(\s*([0-9a-zA-Z]{1,2})\s*\)"), F.lit(1)))
    found = F.flatten(F.transform(F.coalesce(values, F.array().cast("array<string>")), marks))
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, marker_id), lambda m: m != "")))


def parsed_notes(notes: Column) -> Column:
    """Raw notes as entries: marker, raw and bare text, key; blank ones are left out."""
    def entry(raw: Column) -> Column:
        text = F.trim(F.regexp_replace(raw, NOTE_START, ""))
        return let(text, lambda t: F.struct(F.regexp_extract(raw, NOTE_START, 1).alias("marker"), raw.alias("raw_text"), t.alias("text"), matching_key(t).alias("text_norm"), F.lit("table").alias("scope")))

    given = F.transform(F.coalesce(notes, F.array().cast("array<string>")), lambda n: F.trim(blank(n)))
    return F.transform(F.filter(given, lambda n: n != ""), entry)


def canonical_notes(notes: Column) -> Column:
    """Notes as ``{id, text}``: of JSON objects their id or marker and text or value, of plain texts their place from 1.

    Empty texts are left out; a missing id is the place.
    """
    fields = "id string, marker string, text string, value string"

    def entry(n: Column, i: Column) -> Column:
        parsed = F.when(n.startswith("{"), F.from_json(n, fields))
        text = F.when(parsed.isNotNull(), F.coalesce(parsed["text"], parsed["value"])).otherwise(n)
        name = F.coalesce(F.nullif(F.trim(F.coalesce(parsed["id"], parsed["marker"])), F.lit("")), (i + 1).cast("string"))
        return F.struct(name.alias("id"), F.trim(blank(text)).alias("text"))

    given = F.transform(F.coalesce(notes, F.array().cast("array<string>")), lambda n: F.trim(blank(n)))
    return F.filter(F.transform(given, entry), lambda e: e["text"] != "")


def notes_by_id(notes: Column) -> Column:
    """Canonical notes as a map; of several with one id the last counts."""
    entries = canonical_notes(notes)
    return let(entries, lambda es: F.map_from_entries(F.filter(es, lambda e, i: ~F.exists(F.slice(es, i + 2, F.size(es)), lambda o: o["id"] == e["id"]))))


def new_item(label: Column) -> Column:
    """A line that begins a label: numbered, lettered, a known heading, or a long one with a capital."""
    t = squeezed(label)
    long = t.rlike(r"^\p{Lu}") & (F.size(F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0))) >= 4) & (F.length(t) >= 20)
    return (t != "") & (t.rlike(r"^\s*\d+[.)]\s+|^\s*[A-Z]\.\s+") | F.lower(t).isin(NEW_ITEMS) | long)


def goes_on(previous: Column, current: Column, most_tokens: int = 6, most_letters: int = 120) -> Column:
    """Whether a line continues the label above it: small letters or mostly marks, few words or only joining ones."""
    a, b = squeezed(previous), squeezed(current)
    signs = F.regexp_replace(b, " ", "")
    mostly_marks = F.length(F.regexp_replace(signs, MARKS, "")) <= 0.3 * F.length(signs)
    tokens = F.regexp_extract_all(b, F.lit(TOKEN), F.lit(0))
    joining = (F.size(tokens) > 0) & F.forall(tokens, lambda t: F.lower(t).isin(GOING_ON))
    starts = b.rlike(r"^\p{Ll}") | mostly_marks
    fits = F.length(a) + F.length(b) + 1 <= most_letters
    return (a != "") & (b != "") & ~new_item(b) & ~a.rlike(r"[.!?;:]\s*$") & starts & ((F.size(tokens) <= most_tokens) | joining) & fits


def merged_lines(labels: Column, most_tokens: int = 6, most_letters: int = 120) -> Column:
    """Labels with lines that continue the one above joined to it, and how many were."""
    given = F.filter(F.transform(F.coalesce(labels, F.array().cast("array<string>")), squeezed), lambda x: x != "")
    none = F.array().cast("array<string>")

    def step(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        join = F.coalesce(goes_on(last, x, most_tokens, most_letters), F.lit(False))
        return F.when(join, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.concat(last, F.lit(" "), x)))).otherwise(F.concat(done, F.array(x)))

    return let(given, lambda g: let(F.aggregate(g, none, step), lambda m: F.struct(m.alias("labels"), (F.size(g) - F.size(m)).alias("merged"))))
