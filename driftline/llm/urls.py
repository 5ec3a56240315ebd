"""URL filters: prefix rules on hosts and paths, matched by a sort-merge range join.

A rule's key is its host with the labels reversed, then its path; all urls under the rule lie in one interval of
the sorted keys, and intervals of one host nest or are disjoint. A url is looked up once for each suffix of its
host that has rules. Within a host the sweep goes through rules and urls in key order; each rule carries the
stack of rules that are open where it starts, the url takes the stack of the last rule before it, and its
answer is the innermost entry that still holds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def stacks(rules: DataFrame) -> DataFrame:
    """Rules ``(verdict, host, path)`` with the stack of the rules of that host that hold them, outermost first.

    Of rules with the same host and path, one that blocks wins. Null hosts or paths count as empty.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    one = rules.groupBy(F.translate(blank("host"), _UPPER, _LOWER).alias("host"), blank("path").alias("path")).agg(F.max("verdict").alias("verdict"))
    inner = one.select("host", "path", F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.col("path").substr(F.lit(1), n))).alias("outer_path"))
    outer = one.select("host", F.col("path").alias("outer_path"), "verdict")
    entry = F.struct(F.length("outer_path").alias("size"), F.col("outer_path").alias("path"), "verdict")
    return inner.join(outer, ["host", "outer_path"]).groupBy("host", "path").agg(F.sort_array(F.collect_list(entry)).alias("stack"))


def judged(urls: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow", slice_rows: int = 256, small_hosts: int = 50_000) -> DataFrame:
    """One row per row of ``urls``: its key, ``host``, ``path``, ``rule`` (null where none fits) and ``verdict``.

    The longest fitting rule wins (host and path together; of equal lengths the longer host). Null urls and
    urls without ``://`` have an empty host and path, which only a rule with an empty host fits. Rows with
    equal or null keys are judged one by one and all returned. Hosts are dealt to slices of about
    ``slice_rows`` urls (or as many as the host has rules), into each of which the host's rules are copied, so that a host with a third of all
    urls is swept by many tasks; an empty table gives an empty result.
    """
    rows = urls.select(F.col(key).alias("row_key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    ruled = stacks(rules)
    hosts = ruled.groupBy(F.col("host").alias("suffix")).agg(F.count("*").alias("n_rules"))
    distinct = rows.groupBy("host", "path").agg(F.count("*").alias("n"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    small = hosts.count() <= small_hosts  # what may be broadcast is counted, and does not depend on the urls
    asked = distinct.withColumn("suffix", F.explode(suffixes)).join(F.broadcast(hosts) if small else hosts, "suffix").select("suffix", "host", "path", "n_rules")
    # How many slices each host needs: counted map-side, never by one task. A slice holds at least as many urls
    # as the host has rules, so copies of rules never outnumber the urls.
    load = asked.groupBy("suffix").agg(F.ceil(F.count("*") / F.greatest(F.lit(slice_rows), F.max("n_rules"))).cast("int").alias("slices"))
    put = asked.join(F.broadcast(load) if small else load, "suffix").withColumn("slice", F.pmod(F.xxhash64("host", "path"), F.col("slices")).cast("int"))
    swept_urls = put.select("suffix", "slice", "path", F.lit(1).alias("kind"), "host", F.lit(None).cast(ruled.schema["stack"].dataType).alias("stack"))
    marks = ruled.withColumnRenamed("host", "suffix").join(load, "suffix")
    marks = marks.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    marks = marks.select("suffix", "slice", "path", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("host"), "stack")
    key_order = F.concat(reversed_host(F.col("suffix")), F.lit("\u0001"), F.col("path"))
    sweep = Window.partitionBy("suffix", "slice").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    open_now = F.last("stack", ignorenulls=True).over(sweep)
    swept = swept_urls.unionByName(marks).withColumn("key", key_order).withColumn("open", open_now).where("kind = 1")
    fits = F.try_element_at(F.filter("open", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(-1))
    found = swept.withColumn("hit", fits).where("hit is not null")
    order = F.struct((F.length("suffix") + F.col("hit.size")).alias("size"), F.length("suffix").alias("host_size"), F.concat("suffix", "hit.path").alias("rule"), F.col("hit.verdict").alias("verdict"))
    best = found.groupBy("host", "path").agg(F.max(order).alias("best"))
    joined = rows.join(best, ["host", "path"], "left")
    return joined.select(F.col("row_key").alias(key), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
