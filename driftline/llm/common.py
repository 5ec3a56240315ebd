"""Helpers of the training-data operators: tables and pairs of blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators.graph import connected
from driftline.sources.scratch import drop_written, new_path, partitions, scratch, together, written

__all__ = ["block_pairs", "connected", "drop_written", "new_path", "partitions", "row_hashes", "row_id", "runs_of_rows", "scratch", "slices", "table", "together", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_id(key: Column, text: Column) -> Column:
    """128 bits that tell a row by key and text, in which nulls and values never look alike."""
    key = key.cast("string")
    named = F.coalesce(F.concat(F.lit("k"), F.length(key).cast("string"), F.lit(":"), key), F.lit("n"))
    return F.unhex(F.md5(F.concat(named, F.coalesce(F.concat(F.lit("t"), text), F.lit("n")))))


def row_hashes(key: Column, text: Column) -> tuple[Column, Column]:
    """The same as two hashes of 64 bits, which cost less."""
    parts = [key.isNull(), text.isNull(), key, text]
    return F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *parts)


def slices(batch: pa.RecordBatch, text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about ``most`` bytes together, one row at least.

    What a task works on at once is so bounded by bytes, however long the texts are; a longer text is a run of its own.
    """
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    run = np.cumsum(sizes + 64) // most
    starts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
    for a, b in zip(starts, starts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def runs_of_rows(pdf: pd.DataFrame, text: str, most: int = 4 << 20) -> Iterator[pd.DataFrame]:
    """The same for a batch in pandas, by characters."""
    run = np.cumsum(pdf[text].str.len().fillna(0).to_numpy(np.int64) + 64) // most
    starts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(pdf)]
    for a, b in zip(starts, starts[1:]):
        if b > a:
            yield pdf.iloc[a:b]


def block_pairs(rows: DataFrame, by: list[str], member: str, size: int) -> DataFrame:
    """Deal each group of ``rows`` to pairs of blocks of about ``size`` members, so that every two members meet once.

    Adds ``block`` (the row's own), ``block_a`` and ``block_b`` (the pair, a <= b). A group of n blocks gives each
    row n times, so a group of any size is compared by many bounded tasks. Groups of one row are left out.
    """
    sizes = rows.groupBy(*by).agg(F.count("*").alias("members")).where("members > 1")
    sized = sizes.select(*by, F.ceil(F.col("members") / F.lit(size)).cast("int").alias("blocks"))
    dealt = rows.join(sized, by).withColumn("block", F.pmod(F.xxhash64(member, F.lit(3)), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return dealt.withColumn("other", other).withColumns({"block_a": F.least("block", "other"), "block_b": F.greatest("block", "other")}).drop("other", "blocks")
