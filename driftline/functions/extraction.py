"""What the row labels of an extracted table are worth: real rows, weak names, prose, periods, and rows of a neighbour.

Every function works on one row and stays in built-in expressions. Null labels and arrays count as empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftline.functions.text import blank, let, squeezed

# Titles of pages, names that tell no table from another, and what prose is known by.
PAGE_TITLES = ["rapport de gestion", "management's discussion and analysis", "management discussion and analysis", "rapport annuel", "shareholders report", "rapport aux actionnaires"]
WEAK = ["total", "totaux", "autres", "autre", "other", "others", "canada", "united states", "états-unis", "etats-unis"]
WEAK_WORDS = ["total", "totaux", "autres", "autre", "other", "others", "canada", "united", "states", "états", "etats", "unis"]
PROSE = ["texte narratif", "rapport de gestion", "cette section", "ce tableau", "comprend", "comprennent", "inclut", "incluent", "présente", "presente", "présentent", "presentent", "représente", "represente", "décrit", "decrit", "description"]
PROSE_WORDS = [" la ", " le ", " les ", " des ", " du ", " au ", " aux "]


def signal(text: Column) -> Column:
    """Small letters, single-spaced."""
    return F.lower(squeezed(text))


def page_title(text: Column) -> Column:
    return signal(text).isin(PAGE_TITLES)


def period_like(label: Column) -> Column:
    """Blank, a year, or a quarter with or without its year."""
    return signal(label).rlike(r"^$|^(?:q|t)\s*[1-4](?:\s*\d{4})?$|^\d{4}$")


def weak(label: Column) -> Column:
    """A label that names no row in particular, or a period."""

    def rule(s: Column) -> Column:
        words = F.split(s, " ")
        return s.isin(WEAK) | ((F.size(words) <= 3) & F.forall(words, lambda w: w.isin(WEAK_WORDS))) | period_like(s)

    return let(signal(label), rule)


def prose(label: Column) -> Column:
    """A label that reads like a sentence."""

    def rule(s: Column) -> Column:
        has = lambda parts: reduce(lambda a, b: a | b, [s.contains(p) for p in parts])
        return (s != "") & (has(PROSE) | s.endswith(".") | ((F.size(F.split(s, " ")) >= 6) & has(PROSE_WORDS)))

    # Bound once: each part would else make the label's small letters anew.
    return let(signal(label), rule)


def _given(labels: Column) -> Column:
    return F.filter(F.transform(F.coalesce(labels, F.array().cast("array<string>")), lambda x: F.trim(blank(x))), lambda x: x != "")


def _count(labels: Column, rule) -> Column:
    return F.size(F.filter(_given(labels), rule))


def _row(label: Column) -> Column:
    return ~page_title(label) & label.rlike(r"\p{L}")


def structural_rows(labels: Column, headers: Column) -> Column:
    """Rows that a table really has; two periods or more count too where two headers or more stand over them."""
    plain = _count(labels, lambda x: _row(x) & ~period_like(x) & ~prose(x))
    # A bare year has no letter and is no row; a quarter has one.
    periods = _count(labels, lambda x: _row(x) & period_like(x))
    return plain + F.when((periods >= 2) & (F.size(_given(headers)) >= 2), periods).otherwise(0)


def viable_rows(labels: Column) -> Column:
    """Rows whose labels can tell a table from another."""
    return _count(labels, lambda x: _row(x) & ~weak(x) & ~prose(x))


def contamination(title: Column, labels: Column) -> Column:
    """Two for the title of a page, two for each label that is prose."""
    return F.when(page_title(title), 2).otherwise(0) + 2 * _count(labels, prose)


def contaminated(title: Column, labels: Column, headers: Column) -> Column:
    """Whether prose outweighs the rows, or there is none."""
    rows = structural_rows(labels, headers)
    return (rows <= 0) | (contamination(title, labels) >= rows + 1)


def viable(title: Column, labels: Column, headers: Column, no_table: Column) -> Column:
    """Whether an extraction holds a table."""
    return ~F.coalesce(no_table, F.lit(False)) & ~contaminated(title, labels, headers)


def _tokens(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def _bleeds(label: Column) -> Column:
    """A label as the text of a column on the right would give."""
    s = signal(label)
    n = _tokens(s)
    links = F.size(F.split(s, " de ")) + F.size(F.split(s, " du ")) - 2
    return (s != "") & ((n >= 10) | ((n >= 7) & (s.rlike(r"\p{Nd}") | (label.contains("(") & label.contains(")")))) | ((n >= 8) & (links >= 2)))


def _text_header(header: Column) -> Column:
    return (F.size(F.split(header, " ")) <= 4) & (F.length(header) <= 28) & header.rlike(r"\p{L}") & ~header.rlike(r"\p{Nd}")


def right_column_bleed(labels: Column, headers: Column, first: Column) -> Column:
    """How far a second extraction took in a column on the right: its labels go on behind those of the ``first`` one.

    0 unless three headers are short texts, the first labels are all there in front, and two or more behind them are
    longer by two and a half words on average, one of them at least like prose of a column.
    """
    new, old = _given(labels), _given(first)
    tail = F.slice(new, F.size(old) + 1, F.greatest(F.size(new) - F.size(old), F.lit(0)))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + _tokens(y)) / F.size(a)
    heads = F.transform(_given(headers), squeezed)
    odd = F.size(F.filter(tail, _bleeds))
    shape = (F.size(heads) >= 3) & F.forall(F.slice(heads, 1, 3), _text_header) & (F.size(old) > 0) & (F.slice(new, F.lit(1), F.greatest(F.size(old), F.lit(1))) == old) & (F.size(tail) >= 2)
    return F.when(shape & (odd > 0), F.when(mean(tail) >= mean(old) + 2.5, odd + F.size(tail) - 1).otherwise(0)).otherwise(0)
