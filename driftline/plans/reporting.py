"""Queries of the reporting operators over the driver's tables, with the same result in SQL.

The tables stand in for reports: a nation for an institution, a part name for a row label, the quarter of the order
date for the period, an order for a page, a conversation for a chain of text blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.functions import labels, period, predicates, similarity, text
from driftline.operators import diff, graph, matching, metrics, sequence
from driftline.sources.scratch import partitions, written

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labels_by_period(spark: SparkSession, sf_dir: str, full: bool = False) -> DataFrame:
    """Distinct ``(nation, label, year, quarter)``, the label by its key.

    The labels come as a report prints them: with a note, a date, a unit or a row number, depending on the quarter.
    Their keys are worked out once a distinct label. ``full`` labels also say where a line is sold.
    """
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter"))
    customer = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    name = F.concat("p_name", F.lit(" by "), F.replace(F.lower("p_brand"), F.lit("#"), F.lit(" ")), F.lit(" of the "), F.lower("p_type"), F.lit(" line"))
    if full:
        name = F.concat("p_name", F.lit(" of the "), F.lower("p_type"), F.lit(" line by "), F.replace(F.lower("p_brand"), F.lit("#"), F.lit(" ")), F.lit(" in retail stores"))
    part = read(spark, sf_dir, "part").select("p_partkey", name.alias("name"))
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    joined = items.join(orders, items.l_orderkey == orders.o_orderkey).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    printed = F.when(F.col("quarter") == 1, F.concat("name", F.lit(" (1)"))).when(F.col("quarter") == 2, F.concat("name", F.lit(" au 30 avril "), F.col("year").cast("string"))).when(F.col("quarter") == 3, F.concat("name", F.lit(" (en millions de dollars)"))).otherwise(F.concat(F.lit("29 "), "name"))
    rows = joined.select("nation", printed.alias("printed"), "year", "quarter").distinct()
    rows = written(rows, "printed")
    keys = rows.select("printed").distinct().withColumn("label", labels.label_key(F.col("printed")))
    # Every query of changes reads this table several times; written once, no label is keyed twice.
    return written(rows.join(keys, "printed").select("nation", "label", "year", "quarter").distinct(), "labels")


LABELS = r"""printed AS (SELECT DISTINCT c_nationkey AS nation, year(o_orderdate)::INT AS year, quarter(o_orderdate)::INT AS quarter,
  CASE quarter(o_orderdate) WHEN 1 THEN name || ' (1)' WHEN 2 THEN name || ' au 30 avril ' || year(o_orderdate) WHEN 3 THEN name || ' (en millions de dollars)' ELSE '29 ' || name END AS printed
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN (SELECT p_partkey, p_name || ' by ' || replace(lower(p_brand), '#', ' ') || ' of the ' || lower(p_type) || ' line' AS name FROM part) ON l_partkey = p_partkey),
  bare AS (SELECT nation, year, quarter, regexp_replace(regexp_replace(printed, '^[0-9]{1,3} +', ''), ' *(\([0-9]+\)|au [0-9]+ [a-z]+ [0-9]{4}|\(en millions de dollars\))$', '') AS label FROM printed),
  labels AS (SELECT DISTINCT nation, year, quarter, array_to_string(list_transform(string_split(label, ' '), lambda w: CASE WHEN length(w) > 3 AND right(w, 1) = 's' THEN left(w, length(w) - 1) ELSE w END), ' ') AS label FROM bare)"""
FULL_LABELS = LABELS.replace("p_name || ' by ' || replace(lower(p_brand), '#', ' ') || ' of the ' || lower(p_type) || ' line' AS name", "p_name || ' of the ' || lower(p_type) || ' line by ' || replace(lower(p_brand), '#', ' ') || ' in retail stores' AS name")
#: Pairs of a period and the one it is compared with, where both exist.
PAIRS = f"""{LABELS}, periods AS (SELECT DISTINCT nation, year, quarter FROM labels),
  pairs AS (SELECT a.nation, a.year, a.quarter, b.year AS prev_year, b.quarter AS prev_quarter FROM periods a JOIN periods b ON a.nation = b.nation
    AND b.quarter = CASE a.quarter WHEN 1 THEN 3 WHEN 4 THEN 4 ELSE a.quarter - 1 END AND b.year = CASE WHEN a.quarter IN (1, 4) THEN a.year - 1 ELSE a.year END),
  cur AS (SELECT p.nation, p.year, p.quarter, l.label FROM pairs p JOIN labels l USING (nation, year, quarter)),
  prev AS (SELECT p.nation, p.year, p.quarter, l.label FROM pairs p JOIN labels l ON l.nation = p.nation AND l.year = p.prev_year AND l.quarter = p.prev_quarter),
  changes AS (SELECT nation, year, quarter, label, CASE WHEN p.label IS NULL THEN 'added' WHEN c.label IS NULL THEN 'removed' ELSE 'kept' END AS op
    FROM (SELECT *, label AS l2 FROM prev) p FULL JOIN cur c USING (nation, year, quarter, label))""".replace("p.label IS NULL", "p.l2 IS NULL").replace("cur c USING", "(SELECT *, label AS l3 FROM cur) c USING").replace("c.label IS NULL", "c.l3 IS NULL")


def label_changes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = labels_by_period(spark, sf_dir)
    periods = labels.select("nation", "year", "quarter").distinct()
    earlier = periods.select("nation", F.col("year").alias("prev_year"), F.col("quarter").alias("prev_quarter"))
    want = periods.withColumns({"prev_year": period.previous_year(F.col("year"), F.col("quarter")), "prev_quarter": period.previous_quarter(F.col("quarter"))})
    pairs = want.join(earlier, ["nation", "prev_year", "prev_quarter"])
    current = labels.join(pairs.select("nation", "year", "quarter"), ["nation", "year", "quarter"])
    old = labels.withColumnRenamed("year", "prev_year").withColumnRenamed("quarter", "prev_quarter")
    previous = old.join(pairs, ["nation", "prev_year", "prev_quarter"]).select("nation", "year", "quarter", "label")
    return diff.label_diff(previous, current, ["nation", "year", "quarter"], "label")


@query(f"WITH {PAIRS} SELECT nation, year, quarter, count(*) FILTER (op = 'added') AS n_added, count(*) FILTER (op = 'removed') AS n_removed, count(*) FILTER (op = 'kept') AS n_kept FROM changes GROUP BY ALL")
def label_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.change_counts(label_changes_of(spark, sf_dir), ["nation", "year", "quarter"])


@query(f"WITH {PAIRS} SELECT nation, year, quarter, label, op, 'T' || quarter || ' ' || year AS period FROM changes WHERE op <> 'kept'")
def label_change_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = label_changes_of(spark, sf_dir).where("op <> 'kept'")
    return rows.select("nation", "year", "quarter", "label", "op", period.display_label(F.col("year"), F.col("quarter")).alias("period"))


_RENAMES = f"""WITH {PAIRS}, t AS (SELECT nation, year, quarter, op, label, list_distinct(string_split(label, ' ')) AS toks FROM changes WHERE op <> 'kept'),
u AS (SELECT nation, year, quarter, op, label, len(toks) AS n, unnest(toks) AS tok FROM t),
s AS (SELECT a.nation, a.year, a.quarter, a.label AS removed, b.label AS added, count(*) AS common, any_value(a.n) AS na, any_value(b.n) AS nb FROM u a JOIN u b USING (nation, year, quarter, tok) WHERE a.op = 'removed' AND b.op = 'added' GROUP BY ALL)
SELECT nation, year, quarter, removed, added, round(common / (na + nb - common), 6) AS score FROM s WHERE common / (na + nb - common) >= 0.8"""


@query(_RENAMES)
def rename_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = diff.rename_candidates(label_changes_of(spark, sf_dir), ["nation", "year", "quarter"], "label", 0.8)
    return found.withColumn("score", F.round("score", 6))


@query(f"WITH {PAIRS} SELECT nation, year, quarter, count(*) FILTER (op = 'added') AS n_added, count(*) FILTER (op = 'removed') AS n_removed FROM changes WHERE op <> 'kept' GROUP BY ALL")
def label_counts_with_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added and removed labels counted from the table in which renamed ones are one row: both counts come out whole."""
    by = ["nation", "year", "quarter"]
    changes = written(label_changes_of(spark, sf_dir).where("op <> 'kept'"), "changes")
    found = diff.without_renamed(changes, diff.renames(diff.rename_candidates(changes, by, "label", 0.8), by), by, "label")
    n = lambda op: F.count(F.when(F.col("op").isin(op, "renamed"), 1))
    return found.groupBy(*by).agg(n("added").alias("n_added"), n("removed").alias("n_removed"))


@query()
def label_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ["nation", "year", "quarter"]
    return diff.renames(diff.rename_candidates(label_changes_of(spark, sf_dir), by, "label", 0.8), by)


@query(
    f"""WITH {LABELS} SELECT DISTINCT year, quarter, 'Q' || quarter || '-' || year AS period, 'T' || quarter || ' ' || year AS display,
CASE WHEN quarter IN (1, 4) THEN year - 1 ELSE year END AS prev_year, CASE quarter WHEN 1 THEN 3 WHEN 4 THEN 4 ELSE quarter - 1 END AS prev_quarter FROM labels"""
)
def period_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, q = F.col("year"), F.col("quarter")
    dates = read(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter")).distinct()
    return dates.select("year", "quarter", period.key_label(y, q).alias("period"), period.display_label(y, q).alias("display"), period.previous_year(y, q).alias("prev_year"), period.previous_quarter(q).alias("prev_quarter"))


@query(f"WITH {FULL_LABELS} SELECT year, quarter, label, count(DISTINCT nation) AS members, count(DISTINCT nation) >= 20 AS is_consensus FROM labels GROUP BY ALL HAVING count(DISTINCT nation) >= 3")
def label_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.consensus(labels_by_period(spark, sf_dir, full=True), ["year", "quarter", "label"], "nation", 3, 20)


@query(
    """WITH c AS (SELECT o_custkey AS cust, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
notes AS (SELECT cust, n, l_linenumber AS note, l_returnflag || l_linestatus || (l_quantity::INT % 3) AS text FROM lineitem JOIN c ON l_orderkey = o_orderkey ),
last AS (SELECT cust, max(n) AS last FROM c GROUP BY 1),
a AS (SELECT cust, n + 1 AS pair, note, text FROM notes JOIN last USING (cust) WHERE n < last), b AS (SELECT cust, n AS pair, note, text FROM notes WHERE n > 1),
a1 AS (SELECT *, row_number() OVER (PARTITION BY cust, pair, note, text) AS k FROM a), b1 AS (SELECT *, row_number() OVER (PARTITION BY cust, pair, note, text) AS k FROM b),
same1 AS (SELECT cust, pair, note, text FROM a1 JOIN b1 USING (cust, pair, note, text, k)),
a2 AS (SELECT cust, pair, note, text, row_number() OVER (PARTITION BY cust, pair, text ORDER BY note) AS k FROM a1 ANTI JOIN b1 USING (cust, pair, note, text, k)),
b2 AS (SELECT cust, pair, note, text, row_number() OVER (PARTITION BY cust, pair, text ORDER BY note) AS k FROM b1 ANTI JOIN a1 USING (cust, pair, note, text, k)),
same2 AS (SELECT cust, pair, a2.note AS old_note, b2.note AS new_note, text FROM a2 JOIN b2 USING (cust, pair, text, k)),
a3 AS (SELECT cust, pair, note, text, row_number() OVER (PARTITION BY cust, pair, note ORDER BY text) AS k FROM a2 ANTI JOIN b2 USING (cust, pair, text, k)),
b3 AS (SELECT cust, pair, note, text, row_number() OVER (PARTITION BY cust, pair, note ORDER BY text) AS k FROM b2 ANTI JOIN a2 USING (cust, pair, text, k))
SELECT cust, pair, op, old_note::VARCHAR AS old_note, new_note::VARCHAR AS new_note, old_text, new_text FROM (SELECT cust, pair, 'same' AS op, note AS old_note, note AS new_note, text AS old_text, text AS new_text FROM same1
UNION ALL SELECT cust, pair, 'same', old_note, new_note, text, text FROM same2
UNION ALL SELECT cust, pair, 'modified', note, note, a3.text, b3.text FROM a3 JOIN b3 USING (cust, pair, note, k)
UNION ALL SELECT cust, pair, 'removed', note, NULL, text, NULL FROM a3 ANTI JOIN b3 USING (cust, pair, note, k)
UNION ALL SELECT cust, pair, 'added', NULL, note, NULL, text FROM b3 ANTI JOIN a3 USING (cust, pair, note, k))"""
)
def footnote_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes of every order against those of the customer's order before."""
    w = Window.partitionBy("o_custkey")
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").withColumns({"n": F.row_number().over(w.orderBy("o_orderkey")), "last": F.count("*").over(w)})
    items = read(spark, sf_dir, "lineitem")
    words = F.concat("l_returnflag", "l_linestatus", (F.col("l_quantity").cast("int") % 3).cast("string"))
    notes = items.join(orders, items.l_orderkey == orders.o_orderkey).select(F.col("o_custkey").alias("cust"), "n", "last", F.col("l_linenumber").alias("note"), words.alias("text"))
    notes = written(notes, "notes")
    old = notes.where("n < last").select("cust", (F.col("n") + 1).alias("pair"), "note", "text")
    new = notes.where("n > 1").select("cust", F.col("n").alias("pair"), "note", "text")
    return diff.footnote_diff(old, new, ["cust", "pair"], "note", "text").withColumns({c: F.col(c).cast("string") for c in ("old_note", "new_note")})


@query(
    """WITH q AS (SELECT o_custkey AS cust, year(o_orderdate)::INT AS year, quarter(o_orderdate)::INT AS quarter, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL)
SELECT c.cust, c.year, c.quarter, round(c.total - coalesce(b.total, 0), 2) AS delta FROM q c LEFT JOIN q b ON b.cust = c.cust
  AND b.quarter = CASE c.quarter WHEN 1 THEN 3 WHEN 4 THEN 4 ELSE c.quarter - 1 END AND b.year = CASE WHEN c.quarter IN (1, 4) THEN c.year - 1 ELSE c.year END"""
)
def numeric_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("cust"), F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    before = d.select("cust", F.col("year").alias("prev_year"), F.col("quarter").alias("prev_quarter"), F.col("total").alias("before"))
    now = d.withColumns({"prev_year": period.previous_year(F.col("year"), F.col("quarter")), "prev_quarter": period.previous_quarter(F.col("quarter"))})
    out = now.join(before, ["cust", "prev_year", "prev_quarter"], "left")
    return out.select("cust", "year", "quarter", F.round(diff.numeric_delta(F.col("before"), F.col("total")), 2).alias("delta"))


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), k AS (SELECT doc_id, trim(regexp_replace(coalesce(line, ''), '\\s+', ' ', 'g')) AS line FROM l)
SELECT line, count(DISTINCT doc_id) AS n_docs FROM k WHERE line <> '' GROUP BY line HAVING count(DISTINCT doc_id) >= 3"""
)
def repeated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", text.squeezed(F.col("line")).alias("line"))
    return lines.where("line <> ''").distinct().groupBy("line").agg(F.count("*").alias("n_docs")).where("n_docs >= 3")


@query(
    """SELECT left(lower(text), 120) AS prefix, min(doc_id) AS doc_id, count(*) AS n_merged FROM documents WHERE text IS NOT NULL GROUP BY 1"""
)
def first_wins_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.left(F.lower("text"), F.lit(120)).alias("prefix"))
    return metrics.first_wins(docs.withColumn("at", F.col("doc_id")), ["prefix"], "at").select("prefix", "doc_id", "n_merged")


@query(
    """WITH t AS (SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS s FROM conversations),
i AS (SELECT *, sum(s) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM t)
SELECT conv_id, role, min(turn) AS turn, count(*) AS n_rows, string_agg(text, chr(10) ORDER BY turn) AS text FROM i GROUP BY conv_id, island, role"""
)
def merged_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return sequence.merged_runs(rows, ["conv_id"], "turn", "role", "text").drop("island")


@query(
    """SELECT conv_id, turn, role, text FROM (SELECT *, lag(text) OVER w AS lt, lag(role) OVER w AS lr FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE NOT coalesce(lt = text AND lr = role, false)"""
)
def adjacent_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.without_adjacent_repeats(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), ["conv_id"], "turn", ["role", "text"])


@query(
    """SELECT l_orderkey AS page, l_linenumber, i AS index_on_page, n AS rows_on_page, CASE WHEN n = 1 THEN 'single' WHEN i = 1 THEN 'first' WHEN i = n THEN 'last' ELSE 'middle' END AS page_role,
format('tbl_p{:03d}_i{:02d}', l_orderkey, i) AS table_id
FROM (SELECT l_orderkey, l_linenumber, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber, l_partkey))::INT AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)"""
)
def page_local_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), "l_linenumber", "l_extendedprice", "l_partkey")
    return sequence.local_structure(rows, "page", ["l_extendedprice", "l_linenumber", "l_partkey"]).drop("l_extendedprice", "l_partkey")


@query(
    """WITH e AS (SELECT event_type, user_id % 10 AS bucket, dayofweek(ts) AS day FROM events)
SELECT 'total' AS dimension, 'all' AS value, count(*) AS n FROM e UNION ALL SELECT 'event_type', event_type, count(*) FROM e GROUP BY 2
UNION ALL SELECT 'bucket', bucket::VARCHAR, count(*) FROM e GROUP BY 2 UNION ALL SELECT 'day', day::VARCHAR, count(*) FROM e GROUP BY 2"""
)
def counts_by_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 10).alias("bucket"), (F.dayofweek("ts") - 1).alias("day"))
    return metrics.counts_by(e, ["event_type", "bucket", "day"])


@query(
    """SELECT n_name AS section, count(*) AS n, count(*) FILTER (o_orderstatus IN ('F', 'P')) AS n_decided, count(*) FILTER (o_orderstatus NOT IN ('F', 'P')) AS n_remaining,
floor(100.0 * count(*) FILTER (o_orderstatus IN ('F', 'P')) / count(*) + 0.5)::BIGINT AS percent FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"""
)
def review_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return metrics.status_progress(rows.withColumnRenamed("n_name", "section"), ["section"], F.col("o_orderstatus"), ["F", "P"])


@query(
    """SELECT o_custkey AS queue, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY
CASE left(o_orderpriority, 1) WHEN '1' THEN 0 WHEN '2' THEN 1 WHEN '3' THEN 2 ELSE 3 END, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey) AS position
FROM orders"""
)
def review_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.left("o_orderpriority", F.lit(1))
    action = F.when(level == "1", 0).when(level == "2", 1).when(level == "3", 2).otherwise(3)
    state = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    w = Window.partitionBy("o_custkey").orderBy(action, state, F.desc("o_totalprice"), "o_orderkey")
    return read(spark, sf_dir, "orders").withColumn("position", F.row_number().over(w)).select(F.col("o_custkey").alias("queue"), "o_orderkey", "position")


@query(
    """WITH i AS (SELECT user_id, floor(epoch(ts))::BIGINT AS s, floor(epoch(ts))::BIGINT + floor(value * 600)::BIGINT AS e FROM events WHERE value IS NOT NULL AND value >= 0),
r AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
g AS (SELECT *, sum(CASE WHEN s <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM r)
SELECT user_id, min(s) AS s, max(e) AS e, count(*) AS n_merged FROM g GROUP BY user_id, k"""
)
def merged_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.unix_timestamp("ts")
    rows = read(spark, sf_dir, "events").where("value is not null and value >= 0").select("user_id", start.alias("s"), (start + F.floor(F.col("value") * 600)).alias("e"))
    return sequence.merged_intervals(rows, ["user_id"], "s", "e")


@query(
    """SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id::VARCHAR END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS section FROM events"""
)
def section_of_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    opened = F.when(F.col("event_type") == "purchase", F.col("event_id").cast("string"))
    return sequence.carried(rows, ["user_id"], ["ts", "event_id"], opened, "section").select("event_id", "user_id", "section")


@query(
    """SELECT l_suppkey, page, greatest(coalesce(lead(page) OVER (PARTITION BY l_suppkey ORDER BY page) - 1, page + 50), page) AS "end" FROM (SELECT DISTINCT l_suppkey, l_orderkey AS page FROM lineitem)"""
)
def section_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = read(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_orderkey").alias("page")).distinct()
    return sequence.bounds_from_starts(starts, ["l_suppkey"], "page", F.col("page") + 50)


@query(
    """WITH v AS (SELECT l_suppkey, l_linenumber AS ballot, count(*) AS votes FROM lineitem GROUP BY ALL),
r AS (SELECT *, sum(votes) OVER (PARTITION BY l_suppkey) AS all_votes, row_number() OVER (PARTITION BY l_suppkey ORDER BY votes DESC, ballot) AS k, count(*) OVER (PARTITION BY l_suppkey, votes) AS rivals FROM v)
SELECT l_suppkey, ballot AS winner, votes, all_votes::BIGINT AS all_votes, votes >= 0.15 * all_votes AND votes >= 2 AND rivals = 1 AS accepted FROM r WHERE k = 1"""
)
def offset_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.vote(read(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber"), ["l_suppkey"], "l_linenumber", 0.15, 2)


@query(
    """WITH w AS (SELECT l_partkey, l_linenumber AS x, CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'N' THEN 0.8 ELSE 0.6 END::DOUBLE AS w FROM lineitem),
a AS (SELECT l_partkey, count(*) AS sources, sum(w) AS sw, sum(w * x) AS swx, sum(w * x * x) AS swxx FROM w GROUP BY 1)
SELECT l_partkey, sources, round(CASE WHEN sources = 1 THEN 0.55 ELSE greatest(1 - greatest(swxx / sw - pow(swx / sw, 2), 0.0) / 10, 0.0) END, 4) AS confidence FROM a"""
)
def position_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    rows = read(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_linenumber").alias("x"), F.when(flag == "A", 1.0).when(flag == "N", 0.8).otherwise(0.6).alias("w"))
    return metrics.weighted_agreement(rows, ["l_partkey"], "x", "w").withColumn("confidence", F.round("confidence", 4))


@query(
    """SELECT count(*) AS judged, count(*) FILTER (quality = 0) AS true_positives, round(count(*) FILTER (quality = 0) / count(*), 6) AS precision
FROM documents JOIN labels USING (doc_id) WHERE regexp_matches(text, '[#*$%&]{3}| \\| ')"""
)
def gold_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    predicted = read(spark, sf_dir, "documents").where(F.col("text").rlike(r"[#*$%&]{3}| \| ")).select("doc_id")
    gold = read(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 0).alias("expected"))
    return metrics.precision(predicted, gold, ["doc_id"], "expected").withColumn("precision", F.round("precision", 6))


@query(
    """WITH d AS (SELECT user_id, event_type AS decision, ts, event_id FROM events WHERE event_type IN ('click', 'purchase')),
l AS (SELECT user_id, max_by(decision, (ts, event_id)) AS decision FROM d GROUP BY 1)
SELECT coalesce(decision, 'pending') AS decision, count(*) AS n FROM customer LEFT JOIN l ON c_custkey = user_id GROUP BY 1"""
)
def decision_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    decisions = read(spark, sf_dir, "events").where(F.col("event_type").isin("click", "purchase")).select("user_id", F.col("event_type").alias("decision"), F.struct("ts", "event_id").alias("decided_at"))
    return metrics.apply_decisions(items, decisions, ["user_id"]).groupBy("decision").agg(F.count("*").alias("n"))


@query(
    """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT vec_id AS query, label, v AS u FROM e WHERE vec_id % 50 = 0),
s AS (SELECT query, vec_id, round(greatest(0, least(1, list_cosine_similarity(u, v))), 6) AS score FROM q JOIN e USING (label) WHERE vec_id <> query)
SELECT query, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS k FROM s) WHERE k <= 5"""
)
def similar_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest_vectors(spark, sf_dir, 5).select(F.col("left").alias("query"), F.col("right").alias("vec_id"), "score")


def _nearest_vectors(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The ``k`` best of all vectors of its label for each of the stated queries (ids divisible by 50)."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("label").alias("block"), F.col("vec_id").alias("chunk"), F.col("embedding").alias("vector"))
    return matching.nearest(rows.where("chunk % 50 = 0"), rows, k)


@query(
    """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT a.vec_id AS l, b.vec_id AS r, a.label AS label, round(greatest(0, least(1, list_cosine_similarity(a.v, b.v))), 6) AS score FROM e a JOIN e b ON a.label = b.label WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 1),
x AS (SELECT *, row_number() OVER (PARTITION BY label, l ORDER BY score DESC, r) AS i, row_number() OVER (PARTITION BY label, r ORDER BY score DESC, l) AS j FROM s WHERE score > 0)
SELECT label AS block, l AS "left", r AS "right", score FROM x WHERE i = 1 AND j = 1 AND score >= 0.2"""
)
def mutual_best_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even ids are one period, odd ones the other; all vectors of both sides compete."""
    side = F.when(F.col("vec_id") % 2 == 0, "previous").otherwise("current")
    rows = read(spark, sf_dir, "embeddings").select(F.col("label").alias("block"), side.alias("side"), F.col("vec_id").alias("chunk"), F.col("embedding").cast("array<double>").alias("vector"))
    pairs = matching.vector_pairs(rows, 0.2).withColumn("score", F.round("score", 6))
    return matching.mutual_best(pairs, 0.2).select("block", "left", "right", "score")


@query(
    """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT vec_id AS query, label, v AS u FROM e WHERE vec_id % 50 = 0),
s AS (SELECT query, vec_id, round(greatest(0, least(1, list_cosine_similarity(u, v))), 6) AS score FROM q JOIN e USING (label) WHERE vec_id <> query),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS place FROM s), f AS (SELECT vec_id, min({'place': place, 'query': query}) AS spot FROM k GROUP BY 1)
SELECT vec_id, (spot.place)::INT AS place, spot.query AS query FROM f ORDER BY place, query, vec_id LIMIT 160"""
)
def round_robin_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    # 160 rows of one query stand before any row at a later place, so no such row is among the first 160.
    rows = _nearest_vectors(spark, sf_dir, 160).select(F.col("left").alias("query"), F.col("right").alias("vec_id"), "score")
    return sequence.round_robin(rows, "query", [F.desc("score"), "vec_id"], "vec_id", 160)


_TFIDF = rf"""WITH d AS (SELECT coalesce(lang, '') || ':' || coalesce(source, '') AS block, doc_id, CASE WHEN doc_id // 20 % 2 = 0 THEN 'previous' ELSE 'current' END AS side,
  list_filter(list_transform(regexp_extract_all(translate(lower(text), '{text.ACCENTED}', '{text.FOLDED}'), '[\pL\pN_' || chr(39) || ']+'), lambda x: trim(x, '_' || chr(39))), lambda x: length(x) > 2 AND NOT list_contains({text.STOPWORDS!r}, x) AND NOT regexp_full_match(x, '[0-9]+')) AS toks
  FROM documents WHERE text IS NOT NULL),
t AS (SELECT block, side, doc_id, token, count(*) AS tf FROM (SELECT block, side, doc_id, unnest(toks) AS token FROM d) GROUP BY ALL),
f AS (SELECT block, token, count(*) AS df FROM t GROUP BY ALL), n AS (SELECT block, count(*) AS n FROM d GROUP BY 1),
w AS (SELECT t.block, side, doc_id, token, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM t JOIN f USING (block, token) JOIN n USING (block)),
u AS (SELECT block, side, doc_id, token, w / sqrt(sum(w * w) OVER (PARTITION BY block, side, doc_id)) AS w FROM w),
s AS (SELECT a.block, a.doc_id AS l, b.doc_id AS r, round(least(sum(a.w * b.w), 1.0), 4) AS score FROM u a JOIN u b ON a.block = b.block AND a.token = b.token AND a.side = 'previous' AND b.side = 'current' GROUP BY ALL),
x AS (SELECT *, row_number() OVER (PARTITION BY block, l ORDER BY score DESC, r) AS i, row_number() OVER (PARTITION BY block, r ORDER BY score DESC, l) AS j FROM s)"""


def _chunk_pairs(spark: SparkSession, sf_dir: str, minimum: float = 0.24, best: int = 0, first: bool = False) -> DataFrame:
    """Whole documents as chunks, met by language and source; ids go to the two periods by runs of 20.

    All pairs whose rounded score is at least ``minimum``, and the ``best`` of every chunk. With ``first`` only the first
    pair of every chunk by rounded score and id, worked out once.

    A source holds ids of one parity only, so parity can't be the side."""
    docs = read(spark, sf_dir, "documents").where("text is not null")
    block = F.concat(F.coalesce("lang", F.lit("")), F.lit(":"), F.coalesce("source", F.lit("")))
    rows = docs.select(block.alias("block"), "doc_id", F.when(F.floor(F.col("doc_id") / 20) % 2 == 0, "previous").otherwise("current").alias("side"), text.tfidf_tokens(F.col("text")).alias("tokens"))
    if first:
        return written(matching.tfidf_pairs(rows, "block", "doc_id", "side", "tokens", minimum, digits=4), "pairs")
    return matching.tfidf_pairs(rows, "block", "doc_id", "side", "tokens", minimum - 1e-4, best=best).withColumn("score", F.round("score", 4))


@query(f"""{_TFIDF} SELECT block, l AS "left", r AS "right", score FROM x WHERE i = 1 AND j = 1 AND score >= 0.35""")
def aligned_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.mutual_best(_chunk_pairs(spark, sf_dir, 0.35, first=True).distinct(), 0.35).select("block", "left", "right", "score")


@query(
    f"""{_TFIDF}, y AS (SELECT *, lead(score) OVER (PARTITION BY block, l ORDER BY score DESC, r) AS nxt FROM x)
SELECT block, l AS "left", r AS "right", score, coalesce(nxt, 0.0) AS second, score - coalesce(nxt, 0.0) >= 0.1 AS clear FROM y WHERE i = 1"""
)
def clear_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.clear_margin(_chunk_pairs(spark, sf_dir, 1.0, best=2), 0.1)


@query()
def greedy_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.greedy(_chunk_pairs(spark, sf_dir, 0.35), 0.35)


@query()
def optimal_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.optimal(_chunk_pairs(spark, sf_dir, 0.35), 0.35)


@query()
def change_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _chunk_pairs(spark, sf_dir).where("score >= 0.24").select("block", F.col("left").alias("a"), F.col("right").alias("b"), "score", (F.col("score") >= 0.5).alias("strong"))
    return graph.families(edges)


@query()
def verbatim_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = matching.mutual_best(_chunk_pairs(spark, sf_dir, 0.6, first=True).distinct(), 0.6)
    docs = read(spark, sf_dir, "documents")
    old, new = docs.select(F.col("doc_id").alias("left"), F.col("text").alias("previous")), docs.select(F.col("doc_id").alias("right"), F.col("text").alias("current"))
    # A pair of long texts takes seconds of its own, so the few pairs are dealt to as many tasks as there are.
    rows = pairs.join(old, "left").join(new, "right").repartition(4 * partitions(spark), "left", "right")
    return rows.select("left", "right", F.round(similarity.sequence_ratio("previous", "current"), 4).alias("ratio"), F.explode(similarity.change_segments("previous", "current")).alias("change")).select("left", "right", "ratio", "change.*")


@query(
    f"""SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS span_key, regexp_replace(lower(translate(text, '{text.ACCENTED}', '{text.FOLDED}')), '[^a-z0-9]', '', 'g') AS compact_key,
trim(regexp_replace(regexp_replace(lower(text), '[^a-zàâäçéèêëîïôöùûüÿœ0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS block_key FROM documents WHERE text IS NOT NULL"""
)
def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return read(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.span_key(t).alias("span_key"), text.compact_key(t).alias("compact_key"), text.block_key(t).alias("block_key"))


def _signs(pattern: str) -> str:
    return f"length(line) - length(regexp_replace(line, '{pattern}', '', 'g'))"


@query(
    rf"""WITH l AS (SELECT doc_id, regexp_replace(unnest(string_split(text, chr(10))), '^\s+|\s+$', '', 'g') AS line FROM documents), f AS (SELECT doc_id, line, length(line) AS n, regexp_extract_all(line, '[A-Za-zÀ-ÿ]{{2,}}') AS w,
{_signs(r"\pL")} AS a, {_signs(r"\p{Nd}")} AS d, {_signs("[.;:?!]")} AS m, regexp_extract_all(lower(line), '[\pL\pN_]+') AS toks, len(regexp_extract_all(lower(line), '(?:^|[^\pL\pN_])de plus(?:$|[^\pL\pN_])')) AS more FROM l)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (len(w) >= 18 AND n >= 120 AND NOT regexp_matches(line, '[\t|]') AND NOT regexp_matches(line, '(?i)^(?:tableau|table)(?:$|[^\pL\pN_])') AND a >= 0.45 * n AND d <= 0.2 * n
AND len(list_filter(w, lambda x: length(x) <= 3)) <= 0.5 * len(w) AND (m >= 1 OR len(list_filter(toks, lambda x: list_contains({[c for c in predicates.CONNECTORS if " " not in c]!r}, x))) + more >= 4)) AS n_narrative FROM f GROUP BY 1"""
)
def narrative_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count(F.when(predicates.narrative(F.col("line")), 1)).alias("n_narrative"))


@query(
    """SELECT page_id, len(regexp_extract_all(html, '<h[1-6][^>]*>')) AS n_headings, len(regexp_extract_all(html, '<li[^>]*>')) AS n_items, len(regexp_extract_all(html, '[0-9]+(?:[.,][0-9]+)*')) AS n_numbers,
regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1) AS heading FROM pages WHERE html IS NOT NULL"""
)
def page_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("html")
    n = lambda p: F.size(F.regexp_extract_all(h, F.lit(p), F.lit(0))).cast("long")
    return read(spark, sf_dir, "pages").where("html is not null").select("page_id", n("<h[1-6][^>]*>").alias("n_headings"), n("<li[^>]*>").alias("n_items"), n(r"[0-9]+(?:[.,][0-9]+)*").alias("n_numbers"), F.regexp_extract(h, "<h1[^>]*>([^<]*)</h1>", 1).alias("heading"))


@query(
    rf"""WITH c AS (SELECT p_name AS t FROM part UNION ALL SELECT p_size::VARCHAR FROM part UNION ALL SELECT p_retailprice::DECIMAL(12,2)::VARCHAR || ' CAD' FROM part UNION ALL SELECT strftime(o_orderdate, '%Y-%m-%d') FROM orders
UNION ALL SELECT year(o_orderdate)::VARCHAR FROM orders UNION ALL SELECT 'T' || quarter(o_orderdate) || ' ' || year(o_orderdate) FROM orders UNION ALL SELECT CASE p_size % 3 WHEN 0 THEN 'en millions' WHEN 1 THEN p_size || ' pourcentage' ELSE ' - ' END FROM part),
k AS (SELECT trim(regexp_replace(regexp_replace(regexp_replace(lower(translate(t, '{text.ACCENTED}', '{text.FOLDED}')), '[_/-]+', ' ', 'g'), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS t FROM c)
SELECT CASE WHEN t = '' THEN 'EMPTY' WHEN regexp_matches(t, 'pourcentage|percent') THEN 'PERCENT' WHEN regexp_matches(t, '\b(dollars?|cad|usd|eur|en millions?|en milliards?|in millions?|in billions?)\b') THEN 'CURRENCY'
WHEN regexp_matches(t, '\b(au|as at|ended|termine|clos|trimestre|quarter|q[1-4]|t[1-4]|{labels.MONTH_NAMES_FR}|{labels.MONTH_NAMES_EN})\b') THEN 'DATE' WHEN regexp_matches(t, '\b(19|20)[0-9]{{2}}\b') THEN 'YEAR' WHEN regexp_matches(t, '[0-9]') THEN 'NUMBER' ELSE 'TEXT' END AS type, count(*) AS n FROM k GROUP BY 1"""
)
def header_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, orders = read(spark, sf_dir, "part"), read(spark, sf_dir, "orders")
    unit = F.when(F.col("p_size") % 3 == 0, "en millions").when(F.col("p_size") % 3 == 1, F.concat(F.col("p_size").cast("string"), F.lit(" pourcentage"))).otherwise(" - ")
    quarter = F.concat(F.lit("T"), F.quarter("o_orderdate").cast("string"), F.lit(" "), F.year("o_orderdate").cast("string"))
    price = F.concat(F.col("p_retailprice").cast("decimal(12,2)").cast("string"), F.lit(" CAD"))
    cells = [part.select(F.col("p_name").alias("t")), part.select(F.col("p_size").cast("string")), part.select(price), orders.select(F.date_format("o_orderdate", "yyyy-MM-dd")), orders.select(F.year("o_orderdate").cast("string")), orders.select(quarter), part.select(unit)]
    rows = cells[0]
    for c in cells[1:]:
        rows = rows.union(c)
    return rows.select(labels.header_type(F.col("t")).alias("type")).groupBy("type").agg(F.count("*").alias("n"))


@query(
    f"""WITH {PAIRS} SELECT nation, count(*) FILTER (op <> 'kept') AS n_changes, count(DISTINCT (year, quarter)) FILTER (op <> 'kept') AS n_changed, count(DISTINCT (year, quarter)) AS n_pairs,
round(count(*) FILTER (op <> 'kept') / count(*), 4) AS change_rate FROM changes GROUP BY nation"""
)
def changed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = label_changes_of(spark, sf_dir)
    changed = F.col("op") != "kept"
    n = F.count(F.when(changed, 1))
    return c.groupBy("nation").agg(n.alias("n_changes"), F.countDistinct(F.when(changed, F.struct("year", "quarter"))).alias("n_changed"), F.countDistinct(F.struct("year", "quarter")).alias("n_pairs"), F.round(n / F.count("*"), 4).alias("change_rate"))


@query(
    """SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, count(*) FILTER (value IS NULL) AS n_missing, min(ts) AS first_ts, max(ts) AS last_ts,
count(DISTINCT user_id) AS n_users FROM events GROUP BY 1"""
)
def usage_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.count(F.when(F.col("value").isNull(), 1)).alias("n_missing"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.countDistinct("user_id").alias("n_users"))


@query(
    """WITH p AS (SELECT l_suppkey, l_orderkey FROM lineitem), s AS (SELECT l_suppkey, min(l_orderkey) AS lo, min(l_orderkey) + 200 AS hi FROM lineitem GROUP BY 1)
SELECT s.l_suppkey AS section, count(*) AS n_orders, sum(o_totalprice)::DECIMAL(18,2)::VARCHAR AS total FROM s JOIN orders ON o_orderkey BETWEEN lo AND hi GROUP BY 1"""
)
def pages_in_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range join by bins of pages: each section is copied to the bins it touches, then compared exactly."""
    sections = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("section")).agg(F.min("l_orderkey").alias("lo")).withColumn("hi", F.col("lo") + 200)
    size = 100
    binned = sections.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / size), F.floor(F.col("hi") / size))))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.floor(F.col("o_orderkey") / size).alias("bin"))
    inside = orders.join(binned, "bin").where("o_orderkey between lo and hi")
    return inside.groupBy("section").agg(F.count("*").alias("n_orders"), F.sum("o_totalprice").cast("decimal(18,2)").cast("string").alias("total"))
