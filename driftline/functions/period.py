"""Reporting periods: parsing, labels and the comparable earlier period."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quarter_number(value: Column) -> Column:
    """1 to 4 out of ``Q2``, ``t3``, ``T2 2025`` or ``2``; null if there is none."""
    return F.try_to_number(F.nullif(F.regexp_extract(F.lower(F.trim(value)), r"(?:^|[^0-9])[qt]? ?([1-4])(?![0-9])", 1), F.lit("")), F.lit("9")).cast("int")


def normalize_quarter(value: Column) -> Column:
    """``t1`` to ``t4``; a value without a quarter is an error."""
    n = quarter_number(value)
    return F.when(n.isNull(), F.raise_error(F.concat(F.lit("no quarter in "), F.coalesce(value, F.lit("null"))))).otherwise(F.concat(F.lit("t"), n.cast("string")))


def parse_quarter_ref(value: Column) -> Column:
    """``T2 2025``, ``Q2-2025`` and ``2025_t2`` as a struct of year and quarter."""
    text = F.lower(value)
    first = F.regexp_extract(text, r"[qt]([1-4])[ _-]?(\d{4})", 1), F.regexp_extract(text, r"[qt]([1-4])[ _-]?(\d{4})", 2)
    second = F.regexp_extract(text, r"(\d{4})[ _-]?[qt]([1-4])", 2), F.regexp_extract(text, r"(\d{4})[ _-]?[qt]([1-4])", 1)
    pick = lambda k: F.when(first[0] != "", first[k]).when(second[0] != "", second[k]).cast("int")
    return F.struct(pick(1).alias("year"), pick(0).alias("quarter"))


def previous_quarter(quarter: Column) -> Column:
    """The quarter compared with: the one before, Q3 for Q1, and Q4 for Q4 (both of the year before)."""
    return F.when(quarter == 1, 3).when(quarter == 4, 4).otherwise(quarter - 1).cast("int")


def previous_year(year: Column, quarter: Column) -> Column:
    return F.when(quarter.isin(1, 4), year - 1).otherwise(year).cast("int")


def key_label(year: Column, quarter: Column) -> Column:
    """``Q2-2025``."""
    return F.concat(F.lit("Q"), quarter.cast("string"), F.lit("-"), year.cast("string"))


def display_label(year: Column, quarter: Column) -> Column:
    """``T2 2025``."""
    return F.concat(F.lit("T"), quarter.cast("string"), F.lit(" "), year.cast("string"))


def duration(seconds: Column) -> Column:
    """``MM:SS`` of a number of seconds, never negative."""
    s = F.greatest(F.floor(seconds), F.lit(0))
    return F.format_string("%02d:%02d", F.floor(s / 60), F.pmod(s, F.lit(60)))
