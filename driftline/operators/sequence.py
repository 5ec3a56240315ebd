"""Operators over ordered rows: islands, local structure, intervals, carried values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, by: list[str], order: list[str], same: Column, name: str = "island") -> DataFrame:
    """Number runs of neighbouring rows; ``same`` says whether a row continues the one before it (null: no)."""
    w = Window.partitionBy(*by).orderBy(*order)
    starts = F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)
    return df.withColumn("_starts", starts).withColumn(name, F.sum("_starts").over(w)).drop("_starts")


def before(column: str, by: list[str], order: list[str]) -> Column:
    return F.lag(column).over(Window.partitionBy(*by).orderBy(*order))


def merged_runs(df: DataFrame, by: list[str], order: str, kind: str, text: str, glue: str = "\n") -> DataFrame:
    """Neighbours of one kind as one row: first place, number of rows, joined text."""
    runs = islands(df.withColumn("_before", before(kind, by, [order])), by, [order], F.col(kind) == F.col("_before")).drop("_before")
    parts = F.sort_array(F.collect_list(F.struct(order, text)))
    return runs.groupBy(*by, "island", kind).agg(F.min(order).alias(order), F.count("*").alias("n_rows"), F.array_join(F.transform(parts, lambda p: p[text]), glue).alias(text))


def without_adjacent_repeats(df: DataFrame, by: list[str], order: str, keys: list[str]) -> DataFrame:
    """Drop a row whose keys equal those of the row before it."""
    w = Window.partitionBy(*by).orderBy(order)
    repeat = F.struct(*keys) == F.lag(F.struct(*keys)).over(w)
    return df.withColumn("_repeat", F.coalesce(repeat, F.lit(False))).where("not _repeat").drop("_repeat")


def local_structure(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Index, count, role (single, first, middle, last) and the id ``tbl_pPPP_iNN`` of the rows of a page."""
    w = Window.partitionBy(by)
    ranked = df.withColumns({"index_on_page": F.row_number().over(w.orderBy(*order)), "rows_on_page": F.count("*").over(w)})
    i, n = F.col("index_on_page"), F.col("rows_on_page")
    role = F.when(n == 1, "single").when(i == 1, "first").when(i == n, "last").otherwise("middle")
    return ranked.withColumns({"page_role": role, "table_id": F.format_string("tbl_p%03d_i%02d", F.col(by), i)})


def merged_intervals(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Overlapping or touching intervals as one: start, end and how many there were."""
    w = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = islands(df.withColumn("_reach", reach), by, [start, end], F.col(start) <= F.col("_reach"))
    return runs.groupBy(*by, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_merged")).drop("island")


def carried(df: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The last non-null value so far, the row's own included: which section, anchor or marker is open."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def bounds_from_starts(df: DataFrame, by: list[str], start: str, last: Column) -> DataFrame:
    """Each start with its end: the next start minus one, ``last`` for the final one, never before the start."""
    nxt = F.lead(start).over(Window.partitionBy(*by).orderBy(start))
    return df.withColumn("end", F.greatest(F.coalesce(nxt - 1, last), F.col(start)))


def round_robin(df: DataFrame, source: str, order: list[str], key: str, limit: int) -> DataFrame:
    """Interleave ranked sources: all first places, then all second ones; a key counts at its first place.

    ``limit`` is the size of the list asked for.
    """
    ranked = df.withColumn("place", F.row_number().over(Window.partitionBy(source).orderBy(*order)))
    first = ranked.groupBy(key).agg(F.min(F.struct("place", source)).alias("at"))
    return first.select(key, "at.*").orderBy("place", source, key).limit(limit)
