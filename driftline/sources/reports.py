"""Report artifacts: table and text comparisons as JSON, canonical Markdown, gold CSV; and the writers for results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.functions.text import without_controls

TABLES_VERSION, TEXT_VERSION = 7, 3
TABLES_SCHEMA = """bank_code string, year int, quarter string, created_at string, schema_version int, tables array<struct<table_id: string, page: int,
 section: string, title: string, bbox: array<double>, extraction_status: string, headers: array<string>, table_summary: string, row_count: int,
 indicators: array<string>, footnotes: array<struct<id: string, text: string>>>>"""
CHANGE = """struct<change_id: string, section_key: string, subsection_heading: string, diff_type: string, source_text_t1: string, source_text_t2: string,
 pages_t1: array<int>, pages_t2: array<int>, change_summary: string, alignment_decision: string, tfidf_score: double, embedding_score: double,
 genai_triage: struct<is_relevant: boolean, nouvelle_idee: boolean, impact_level: string, action_requise: string, themes_amf: array<string>>>"""
TEXT_SCHEMA = f"bank_code string, quarter_from string, quarter_to string, schema_version int, section_comparisons array<struct<section_key: string, section_title: string, block_comparisons: array<{CHANGE}>>>"


def _versioned(df: DataFrame, version: int) -> DataFrame:
    """Rows of that schema version; any other version is an error, not a row left out."""
    wrong = F.raise_error(F.concat(F.lit(f"schema_version is not {version}: "), F.coalesce(F.col("schema_version").cast("string"), F.lit("null"))))
    return df.withColumn("schema_version", F.when(F.col("schema_version") == version, F.col("schema_version")).otherwise(wrong.cast("int")))


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """One row a table of ``tables.json`` files, with its file's bank and period."""
    files = _versioned(spark.read.schema(TABLES_SCHEMA).option("mode", "FAILFAST").option("multiLine", True).json(path), TABLES_VERSION)
    return files.select("bank_code", "year", "quarter", "schema_version", F.posexplode("tables").alias("ordinal", "t")).select("bank_code", "year", "quarter", "schema_version", "ordinal", "t.*")


def table_cards(tables: DataFrame) -> DataFrame:
    """The view that matching works on: title, size, first label, number of notes."""
    return tables.select("bank_code", "year", "quarter", "ordinal", "table_id", "page", "section", F.trim("title").alias("title"), F.coalesce("row_count", F.size("indicators")).alias("row_count"), F.try_element_at("indicators", F.lit(1)).alias("first_indicator"), F.greatest(F.size("footnotes"), F.lit(0)).alias("footnote_count"))


def repeated_ids(tables: DataFrame) -> DataFrame:
    """Table ids that a file holds more than once."""
    return tables.groupBy("bank_code", "year", "quarter", "table_id").agg(F.count("*").alias("n")).where("n > 1")


def read_text_changes(spark: SparkSession, path: str, include_unchanged: bool = False) -> DataFrame:
    """One row a change of text comparison files; ``unchanged`` ones only if asked for."""
    files = _versioned(spark.read.schema(TEXT_SCHEMA).option("mode", "FAILFAST").option("multiLine", True).json(path), TEXT_VERSION)
    sections = files.select("bank_code", "quarter_from", "quarter_to", "schema_version", F.explode("section_comparisons").alias("s"))
    rows = sections.select("bank_code", "quarter_from", "quarter_to", "schema_version", "s.section_title", F.explode("s.block_comparisons").alias("c")).select("bank_code", "quarter_from", "quarter_to", "schema_version", "section_title", "c.*")
    return rows if include_unchanged else rows.where("diff_type <> 'unchanged'")


def read_gold(spark: SparkSession, path: str, expected: str) -> DataFrame:
    """A gold CSV with a header, its ``expected`` column as a boolean."""
    rows = spark.read.option("header", True).csv(path)
    return rows.withColumn(expected, F.lower(F.trim(expected)).isin("true", "1", "yes"))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Lines of Markdown files with the section, subsection and page that hold: headings and ``[pdf.N]`` carry on."""
    files = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("line_number", "line"))
    so_far = Window.partitionBy("file").orderBy("line_number").rowsBetween(Window.unboundedPreceding, 0)
    bare = F.trim(F.regexp_replace("line", r"\[pdf\.[0-9]+\]", ""))
    page = F.try_to_number(F.nullif(F.regexp_extract("line", r"\[pdf\.([0-9]+)\]", 1), F.lit("")), F.lit("999999")).cast("int")
    section = F.when(bare.startswith("## "), F.trim(F.substring(bare, 4, 1_000_000)))
    opened = F.when(bare.startswith("### "), F.trim(F.substring(bare, 5, 1_000_000))).when(bare.startswith("## "), F.lit(""))
    rows = files.withColumns({"page": F.last(page, True).over(so_far), "section": F.last(section, True).over(so_far), "subsection": F.nullif(F.last(opened, True).over(so_far), F.lit(""))})
    return rows.where(~bare.startswith("#") & (bare != "")).withColumn("text", bare).drop("line")


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """JSON by bank and period; the partitions that come are replaced, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).json(path)


def write_ordered_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """CSV parts in one global order, sorted by ranges and not in one task."""
    df.orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def read_change_records(spark: SparkSession, root: str, period: str | None = None, include_unchanged: bool = False) -> DataFrame:
    """The changes of all text comparisons under ``root/<bank>/<period>/``, with bank and period by their folders where
    the file names none."""
    rows = read_text_changes(spark, f"{root}/*/*/text_comparison.json", include_unchanged).withColumn("_path", F.input_file_name())
    folder = lambda k: F.element_at(F.split("_path", "/"), k)
    rows = rows.withColumns({"bank_code": F.lower(F.coalesce(F.nullif("bank_code", F.lit("")), folder(-3))), "period": F.translate(F.lower(folder(-2)), "-", "_")}).drop("_path")
    return rows if period is None else rows.where(F.col("period") == period.lower().replace("-", "_"))


def read_section_ranges(spark: SparkSession, path: str) -> DataFrame:
    """Page ranges of sections, whichever of the known layouts a file has: a list under ``sections`` or ``ranges`` with
    ``start_page`` and ``end_page``, or pages as ``[start, end]``."""
    schema = "sections array<struct<section: string, section_key: string, start_page: int, end_page: int, pages: array<int>>>, ranges array<struct<section: string, section_key: string, start_page: int, end_page: int, pages: array<int>>>"
    files = spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path)
    rows = files.select(F.explode(F.coalesce("sections", "ranges")).alias("r"))
    start, end = F.coalesce("r.start_page", F.try_element_at("r.pages", F.lit(1))), F.coalesce("r.end_page", F.try_element_at("r.pages", F.lit(-1)))
    return rows.select(F.coalesce("r.section", "r.section_key").alias("section"), start.alias("start_page"), end.alias("end_page")).where("start_page is not null")


def _once(df: DataFrame, by: list[str], key: str) -> DataFrame:
    """The rows; a key that a group holds twice is an error."""
    seen = F.count("*").over(Window.partitionBy(*by, key))
    twice = F.raise_error(F.concat(F.lit(f"{key} is not unique: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return df.withColumn("_n", seen).withColumn(key, F.when(F.col("_n") == 1, F.col(key)).otherwise(twice.cast(df.schema[key].dataType))).drop("_n")


def write_tables(tables: DataFrame, path: str) -> None:
    """Tables by bank and period in order of page and place; a table id that comes twice is an error."""
    rows = _once(tables, ["bank_code", "year", "quarter"], "table_id").withColumn("schema_version", F.lit(TABLES_VERSION))
    write_partitioned(rows.repartition("bank_code", "year", "quarter").sortWithinPartitions("bank_code", "year", "quarter", "page", "ordinal"), path, ["bank_code", "year", "quarter"])


def write_labels(tables: DataFrame, path: str) -> None:
    """The labels of tables, one row a table."""
    write_partitioned(tables.select("bank_code", "year", "quarter", "table_id", "page", "title", "indicators"), path, ["bank_code", "year", "quarter"])


def write_notes(tables: DataFrame, path: str) -> None:
    """The notes of tables that have some, one row a note."""
    rows = tables.select("bank_code", "year", "quarter", "table_id", F.explode("footnotes").alias("f")).select("bank_code", "year", "quarter", "table_id", "f.id", "f.text")
    write_partitioned(rows.where("text is not null and text <> ''"), path, ["bank_code", "year", "quarter"])


def write_text_changes(changes: DataFrame, path: str, by: list[str], key: str = "change_id") -> None:
    """Text changes without control characters, one a key: the first by ``position`` where there is one."""
    texts = {f.name: without_controls(F.col(f.name)) for f in changes.schema.fields if f.dataType.simpleString() == "string" and f.name not in by}
    rows = changes.withColumns(texts)
    rest = [c for c in rows.columns if c not in (*by, key)]
    order = F.col("position") if "position" in rows.columns else F.struct(*(c for c in rest if c in texts))
    one = rows.groupBy(*by, key).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*by, key, "r.*")
    write_partitioned(one.withColumn("schema_version", F.lit(TEXT_VERSION)), path, by)


def write_report(rows: DataFrame, path: str, period: str) -> None:
    """A report of one period; those of other periods stay."""
    write_partitioned(rows.withColumn("period", F.lit(period.lower().replace("-", "_"))), path, ["period"])


def write_decisions(changes: DataFrame, decisions: DataFrame, path: str, by: list[str], key: list[str]) -> None:
    """Changes written back with the latest decision on each; without one they are pending."""
    latest = decisions.groupBy(*key).agg(F.max_by("status", "decided_at").alias("status"))
    rows = changes.drop("status").join(latest, key, "left").withColumn("status", F.coalesce("status", F.lit("pending")))
    write_partitioned(rows, path, by)
