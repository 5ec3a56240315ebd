import json
import time

import pytest
from pyspark.sql import functions as F

from driftline.sources import reports


def table(i, **more):
    return {"table_id": f"t{i}", "page": i, "section": "capital", "title": f" Title {i} ", "indicators": ["a", "b"], "footnotes": [{"id": "1", "text": "n"}], **more}


def test_tables(spark, tmp_path):
    (tmp_path / "tables.json").write_text(json.dumps({"bank_code": "x", "year": 2025, "quarter": "t2", "schema_version": 7, "tables": [table(1), table(1), table(2, indicators=[])]}, indent=1))
    rows = reports.read_tables(spark, str(tmp_path / "tables.json"))
    cards = {(r["ordinal"], r["title"], r["row_count"], r["first_indicator"], r["footnote_count"]) for r in reports.table_cards(rows).collect()}
    assert cards == {(0, "Title 1", 2, "a", 1), (1, "Title 1", 2, "a", 1), (2, "Title 2", 0, None, 1)}
    assert [(r["table_id"], r["n"]) for r in reports.repeated_ids(rows).collect()] == [("t1", 2)]
    (tmp_path / "old.json").write_text(json.dumps({"bank_code": "x", "schema_version": 6, "tables": [table(1)]}))
    with pytest.raises(Exception, match="schema_version is not 7"):
        reports.read_tables(spark, str(tmp_path / "old.json")).collect()


def test_text_changes(spark, tmp_path):
    change = lambda i, kind: {"change_id": f"c{i}", "diff_type": kind, "pages_t1": [1], "genai_triage": {"is_relevant": True}}
    (tmp_path / "text.json").write_text(json.dumps({"bank_code": "x", "schema_version": 3, "section_comparisons": [{"section_key": "s", "section_title": "S", "block_comparisons": [change(1, "added"), change(2, "unchanged")]}]}))
    assert [r["change_id"] for r in reports.read_text_changes(spark, str(tmp_path / "text.json")).collect()] == ["c1"]
    assert reports.read_text_changes(spark, str(tmp_path / "text.json"), include_unchanged=True).count() == 2


def test_markdown_and_sinks(spark, tmp_path):
    (tmp_path / "a.md").write_text("## Risk [pdf.3]\nfirst\n\n### Credit [pdf.4]\nsecond\n## Capital\nthird\n")
    rows = reports.read_markdown(spark, str(tmp_path / "a.md")).orderBy("line_number")
    assert [(r["text"], r["section"], r["subsection"], r["page"]) for r in rows.collect()] == [("first", "Risk", None, 3), ("second", "Risk", "Credit", 4), ("third", "Capital", None, 4)]
    reports.write_ordered_csv(rows.select("text", "page"), str(tmp_path / "csv"), ["text"])
    assert [r["text"] for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()] == ["first", "second", "third"]
    (tmp_path / "gold.csv").write_text("t1_uid,t2_uid,expected_match\na,b,True\nc,d,false\n")
    assert [r["expected_match"] for r in reports.read_gold(spark, str(tmp_path / "gold.csv"), "expected_match").collect()] == [True, False]
    reports.write_partitioned(rows.select("text", "section"), str(tmp_path / "out"), ["section"])
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_written_leaves_no_shuffle_files(spark):
    """The shuffles that made a table go with the query; what the session is set to stays."""
    from driftline.sources import scratch

    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {x for x in blocks.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x}
    before, setting = shuffles(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    df = spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count()
    assert len(scratch.written(df, "groups").collect()) == 7
    for _ in range(50):  # files go in the background
        if shuffles() <= before:
            break
        time.sleep(0.1)
    assert shuffles() <= before and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
