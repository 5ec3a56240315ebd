"""Mixing sources to target weights.

Tokens are counted by cell (source, language, topic); iterative proportional fitting rakes the cells' token mass
to the target shares of all three margins; a document is then drawn with the probability its cell asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.common import drop_written, written

MARGINS = ("source", "lang", "topic")
NONE = "(none)"
WORD = r"[^\x20\x09-\x0D]+"


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def topic_of(text: Column, tokens: Column) -> Column:
    """A coarse topic read off the whole text, where no topic column is given."""
    return (
        F.when(text.contains(" | "), "tabular")
        .when(text.rlike(r"[{};]|= ?\""), "code")
        .when(text.rlike(r"[$%&#*]{3}"), "marked")
        .when(text.rlike("[0-9]"), "numeric")
        .when(tokens < 60, "short")
        .otherwise("prose")
    )


def labelled(docs: DataFrame, topic: str | None = None) -> DataFrame:
    """``docs`` with ``mix_source``, ``mix_lang``, ``mix_topic`` (nulls become ``(none)``) and ``mix_tokens``."""
    rows = docs.withColumn("mix_tokens", n_tokens(F.col("text")))
    named = F.col(topic) if topic else topic_of(F.coalesce("text", F.lit("")), F.col("mix_tokens"))
    return rows.withColumns({"mix_source": F.coalesce("source", F.lit(NONE)), "mix_lang": F.coalesce("lang", F.lit(NONE)), "mix_topic": F.coalesce(named, F.lit(NONE))})


def cells(rows: DataFrame) -> DataFrame:
    """Token counts by cell, summed map-side; cells without a token are left out."""
    by = [F.col(f"mix_{m}").alias(m) for m in MARGINS]
    return rows.groupBy(*by).agg(F.sum("mix_tokens").cast("double").alias("tokens")).where("tokens > 0")


def tempered(counted: DataFrame, margin: str, power: float) -> DataFrame:
    """Target shares ``(value, share)`` of a margin: its token shares raised to ``power`` and scaled to one.

    1 keeps the shares, 0 makes them equal; in between small sources, languages or topics gain.
    """
    powered = counted.groupBy(F.col(margin).alias("value")).agg(F.pow(F.sum("tokens"), F.lit(power)).alias("x"))
    whole = powered.agg(F.sum("x").alias("all"))  # one row
    return powered.join(F.broadcast(whole)).select("value", (F.col("x") / F.col("all")).alias("share"))


def _worst(raked: DataFrame) -> float:
    """The largest difference between a margin's share and its target."""
    worst = None
    for m in MARGINS:
        own = raked.groupBy(m).agg((F.sum("mass") / F.max("all")).alias("is"), F.max(f"to_{m}").alias("to")).agg(F.max(F.abs(F.col("is") - F.col("to"))).alias("d"))
        worst = own if worst is None else worst.unionByName(own)
    return worst.agg(F.max("d")).first()[0] or 0.0


def rake(counted: DataFrame, targets: dict[str, DataFrame], max_sweeps: int = 200, small_cells: int = 100_000, tolerance: float = 1e-12) -> DataFrame:
    """The cells with ``mass``: their tokens, scaled margin by margin towards the target shares of the whole.

    Sweeps are repeated until every margin is within ``tolerance`` of its target; after ``max_sweeps``, which only
    targets that contradict each other reach, the last state is returned. A value that a margin's targets don't name
    keeps nothing; targets for values without tokens are ignored.
    Up to ``small_cells`` counted cells are raked in one task, whose windows then need no shuffle; more are raked
    by grouped sums and joins, written margin by margin; the windows are written every eighth sweep.
    """
    small = counted.count() <= small_cells
    total = counted.agg(F.sum("tokens").alias("all"))  # one row
    cur = counted.join(F.broadcast(total)).withColumn("mass", F.col("tokens"))
    for margin in MARGINS:
        want = targets[margin].select(F.col("value").alias(margin), F.col("share").alias(f"to_{margin}"))
        cur = cur.join(F.broadcast(want) if small else want, margin, "left").fillna({f"to_{margin}": 0.0})
    columns = cur.columns
    cur = written(cur.coalesce(1) if small else cur, "cells")
    for _ in range(0, max_sweeps, 8):
        nxt = cur.coalesce(1) if small else cur
        for _ in range(8):
            for margin in MARGINS:
                if small:
                    nxt = nxt.withColumn("have", F.sum("mass").over(Window.partitionBy(margin)))
                else:
                    nxt = nxt.join(nxt.groupBy(margin).agg(F.sum("mass").alias("have")), margin)
                scaled = F.col("mass") * (F.col(f"to_{margin}") / F.col("have")) * F.col("all")
                nxt = nxt.withColumn("mass", F.when(F.col("have") > 0, scaled).otherwise(0.0)).select(columns)
                if not small:  # a plan that holds itself twice is written before it doubles again
                    last, cur = cur, written(nxt, "cells")
                    drop_written(last)
                    nxt = cur
        if small:
            last, cur = cur, written(nxt, "cells")
            drop_written(last)
        if _worst(cur) <= tolerance:
            break
    return cur


def drawn(key: Column, seed: int) -> Column:
    """A number in [0, 1) fixed by key and seed, the same in any engine that has MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mixed(docs: DataFrame, powers: dict[str, float] | None = None, targets: dict[str, DataFrame] | None = None, rate: float = 1.0, seed: int = 5, topic: str | None = None, key: str = "doc_id", small_cells: int = 100_000) -> DataFrame:
    """``docs`` with their cell, ``mix_tokens``, ``mix_ratio``, ``mix_probability``, ``mix_copies`` and ``kept``.

    ``mix_ratio`` is a cell's raked mass over its tokens. The sample holds a document ``mix_copies`` (long) times: the
    whole part of ``rate * mix_ratio``, and once more with a probability that is the fraction, decided by a hash of its
    key; so the tokens of the sample meet the targets of all margins, those above one as well. ``mix_probability`` is
    that of being in it at all, and ``kept`` whether it is. Documents without tokens (null or blank texts) have no
    mass: probability 0 and not kept. Rows with equal or null keys are decided alike; an empty table gives an empty
    result. Columns ``mix_*`` and ``kept`` are replaced.
    """
    docs = docs.drop(*(c for c in docs.columns if c.startswith("mix_") or c == "kept"))
    rows = labelled(docs, topic)
    counted = written(cells(rows), "counted")
    powers = powers or {"source": 0.7, "lang": 0.8, "topic": 0.9}
    targets = targets or {m: written(tempered(counted, m, powers[m]), "targets") for m in MARGINS}
    raked = rake(counted, targets, small_cells=small_cells)
    ratio = raked.select(*(F.col(m).alias(f"mix_{m}") for m in MARGINS), (F.col("mass") / F.col("tokens")).alias("mix_ratio"))
    if ratio.count() <= small_cells:  # sources times languages times topics, counted before it is broadcast
        ratio = F.broadcast(ratio)
    out = rows.join(ratio, [f"mix_{m}" for m in MARGINS], "left")
    has = F.col("mix_tokens") > 0
    out = out.withColumn("mix_ratio", F.when(has, F.coalesce("mix_ratio", F.lit(0.0))).otherwise(0.0))
    asked = F.col("mix_ratio") * F.lit(rate)
    copies = F.floor(asked) + (drawn(F.col(key), seed) < asked - F.floor(asked)).cast("long")
    out = out.withColumns({"mix_probability": F.least(F.lit(1.0), asked), "mix_copies": copies})
    return out.withColumn("kept", F.col("mix_copies") > 0)


def sql(docs: str = "documents", powers: dict[str, float] | None = None, seed: int = 5, sweeps: int = 40) -> str:
    """The same result in DuckDB's SQL: the sweeps unrolled, ratios rounded."""
    powers = powers or {"source": 0.7, "lang": 0.8, "topic": 0.9}
    steps = [
        f"""r AS (SELECT *, CASE WHEN t LIKE '% | %' THEN 'tabular' WHEN regexp_matches(t, '[{{}};]|= ?"') THEN 'code'
            WHEN regexp_matches(t, '[$%&#*]{{3}}') THEN 'marked' WHEN regexp_matches(t, '[0-9]') THEN 'numeric'
            WHEN mix_tokens < 60 THEN 'short' ELSE 'prose' END AS mix_topic
          FROM (SELECT doc_id, coalesce(source, '{NONE}') AS mix_source, coalesce(lang, '{NONE}') AS mix_lang, coalesce(text, '') AS t,
            len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS mix_tokens FROM {docs}))""",
        "c AS MATERIALIZED (SELECT mix_source AS source, mix_lang AS lang, mix_topic AS topic, sum(mix_tokens)::DOUBLE AS tokens FROM r GROUP BY ALL HAVING sum(mix_tokens) > 0)",
    ]
    steps += [f"g_{m} AS MATERIALIZED (SELECT {m}, x / sum(x) OVER () AS share FROM (SELECT {m}, pow(sum(tokens), {powers[m]}) AS x FROM c GROUP BY {m}))" for m in MARGINS]
    steps.append("m0 AS (SELECT *, tokens AS mass, sum(tokens) OVER () AS whole FROM c)")
    n = 0
    for _ in range(sweeps):
        for m in MARGINS:
            steps.append(f"m{n + 1} AS MATERIALIZED (SELECT a.* REPLACE (a.mass * (g.share / sum(a.mass) OVER (PARTITION BY a.{m})) * a.whole AS mass) FROM m{n} a JOIN g_{m} g USING ({m}))")
            n += 1
    draw = f"('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0"
    return f"""WITH {', '.join(steps)}
    SELECT doc_id, mix_source, mix_lang, mix_topic, mix_tokens, round(coalesce(mass / tokens, 0), 6) AS mix_ratio, round(least(1.0, coalesce(mass / tokens, 0)), 6) AS mix_probability,
      floor(coalesce(mass / tokens, 0))::BIGINT + (({draw}) < coalesce(mass / tokens, 0) - floor(coalesce(mass / tokens, 0)))::BIGINT AS mix_copies,
      ({draw}) < coalesce(mass / tokens, 0) AS kept
    FROM r LEFT JOIN m{n} m ON r.mix_tokens > 0 AND m.source = mix_source AND m.lang = mix_lang AND m.topic = mix_topic"""
