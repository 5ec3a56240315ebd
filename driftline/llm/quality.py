"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per failed rule; a
policy is a mask over those bits, so a new policy version, or the question "what would rule X alone change",
needs no second look at the text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import slices

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_shouts long, n_upper long, n_letters long"

_WINDOW = 5
_SYMBOLS = b"#*$%&|<>"
_MULTIPLIERS = np.random.default_rng(20240229).integers(1, 2**63, _WINDOW + 1, dtype=np.uint64) * 2 + 1


def _repeated(words: list[list[bytes]]) -> np.ndarray:
    """Words of each text that lie in a five-word window found twice or more in that text."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    total = int(sizes.sum())
    if total < _WINDOW:
        return np.zeros(len(words), np.int64)
    numbers: dict[bytes, int] = {}
    codes = np.fromiter((numbers.setdefault(w, len(numbers)) for ws in words for w in ws), np.uint64, total)
    text = np.repeat(np.arange(len(words)), sizes)
    n = total - _WINDOW + 1
    key = text[:n].astype(np.uint64) * _MULTIPLIERS[_WINDOW]
    for k in range(_WINDOW):
        key += codes[k : k + n] * _MULTIPLIERS[k]
    inside = text[:n] == text[_WINDOW - 1 :]
    starts = np.flatnonzero(inside)
    starts = starts[pd.Series(key[starts]).duplicated(keep=False).to_numpy()]
    cover = np.zeros(total + _WINDOW, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + _WINDOW, -1)
    return np.bincount(text[np.cumsum(cover)[:total] > 0], minlength=len(words))


def _measure(texts: list[str | None]) -> dict[str, list]:
    texts = [t or "" for t in texts]
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    words = [b.split() for b in raw]  # bytes.split() cuts at exactly \x20 and \x09-\x0D
    counts = np.array([np.bincount(np.frombuffer(b, np.uint8), minlength=256) for b in raw]).reshape(-1, 256)
    space = counts[:, [32, *range(9, 14)]].sum(1)
    points = counts[:, :128].sum(1) + counts[:, 192:].sum(1)
    dup, lines = [], []
    for b in raw:
        filled = [x for x in b.split(b"\n") if x.strip()]
        lines.append(len(filled))
        dup.append(len(filled) - len(set(filled)))
    upper, letters = counts[:, 65:91].sum(1), counts[:, 97:123].sum(1) + counts[:, 65:91].sum(1)
    out = {"n_words": [len(w) for w in words], "word_chars": points - space, "n_symbols": counts[:, list(_SYMBOLS)].sum(1), "n_dup_lines": dup}
    return out | {"n_repeat_words": _repeated(words), "n_lines": lines, "n_shouts": counts[:, 33], "n_upper": upper, "n_letters": letters}


def measured(df: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``df`` with the measurements beside its columns; a measurement's name replaces a column of the same name.

    The text is read once, in Arrow batches of bounded bytes, and does not come back without ``keep_text``; nothing is
    shuffled. Null and empty texts measure zero everywhere; rows may repeat and keys may be null.
    """
    names = [x.split()[0] for x in MEASURES.split(", ")]
    kept = [c for c in df.columns if c not in names and (keep_text or c != text)]

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, text)):
            table = batch.select(kept)
            got = _measure(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*table.columns, *(pa.array(np.asarray(got[n], np.int64)) for n in names)], [*kept, *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in kept)
    return df.mapInArrow(run, f"{fields}, {MEASURES}")


#: The rules in bit order: a rule fails where its condition is true. Append only, since stored ledgers hold bits.
RULES: dict[str, str] = {
    "too_short": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "shouting": "10 * n_shouts > 3 * n_words",
    "upper_case": "n_letters >= 50 and 2 * n_upper > n_letters",
    "repeated_lines": "n_lines >= 5 and 2 * n_dup_lines > n_lines",
    "long_words": "n_words >= 10 and word_chars > 20 * n_words",
    "short_words": "n_words >= 10 and 10 * word_chars < 18 * n_words",
}
BASE = ("too_short", "repeated_words")
#: Versioned policies: which rules count.
POLICIES: dict[str, tuple[str, ...]] = {"base": BASE, "v1": (*BASE, "symbols", "shouting"), "v2": tuple(RULES)}


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(policy: str) -> int:
    return sum(map(bit, POLICIES[policy]))


def ledger(df: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """The measurements and ``failed_bits``: each rule evaluated once, over stored measurements, JVM-side."""
    bits = None
    for rule, condition in RULES.items():
        one = F.when(F.expr(condition), F.lit(bit(rule)).cast("long")).otherwise(F.lit(0).cast("long"))
        bits = one if bits is None else bits.bitwiseOR(one)
    return measured(df, text, keep_text).withColumn("failed_bits", bits)


def verdict(policy: str) -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("failed_bits").bitwiseAND(F.lit(mask(policy))) == 0


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """What each rule of a policy does: documents it fails, fails alone, and that pass without it.

    The ledger is first counted by its bits (at most two to the number of rules rows, map-side), and every
    ablation is bit arithmetic over those counts. An empty ledger gives the rules with zero counts.
    """
    whole = mask(policy)
    rules = df_rules(rows, policy)
    counts = rows.groupBy(F.col("failed_bits").bitwiseAND(F.lit(whole)).alias("bits")).agg(F.count("*").alias("n"))
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    only = F.col("bits") == F.col("bit")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias
    joined = rules.join(counts, hit, "left")
    fails = F.col("bits") != 0
    without = F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0
    return joined.groupBy("policy", "rule", "bit").agg(total(hit & fails)("n_failed"), total(only)("n_failed_alone"), total(fails & without)("n_passed_without"))


def df_rules(rows: DataFrame, policy: str) -> DataFrame:
    return rows.sparkSession.createDataFrame([(policy, r, bit(r)) for r in POLICIES[policy]], "policy string, rule string, bit long")


def quality(df: DataFrame, policy: str = "v2", text: str = "text", keep_text: bool = True) -> DataFrame:
    """The ledger with ``policy``, ``base_failed`` and ``kept`` under that policy (which must hold the base rules)."""
    rows = ledger(df, text, keep_text)
    failed = F.col("failed_bits").bitwiseAND(F.lit(mask("base"))) != 0
    return rows.withColumns({"policy": F.lit(policy), "base_failed": failed, "kept": ~failed & verdict(policy)})


_SPACE = r"\x20\x09-\x0D"


def sql(docs: str = "documents", policy: str = "v2") -> str:
    """The same result in DuckDB's SQL, for tables of moderate size: every five-word window becomes a row."""
    bits = " + ".join(f"CASE WHEN {c} THEN {bit(r)} ELSE 0 END" for r, c in RULES.items())
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^{_SPACE}]+') AS w FROM {docs}),
    o AS (SELECT row_number() OVER () AS r, * FROM d),
    x AS (SELECT r, unnest(generate_series(1, len(w) - 4)) AS i, w FROM o WHERE len(w) >= 5), y AS (SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(w[i:i + 4], ' ')) AS n FROM x),
    z AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(generate_series(i, i + 4)) AS p FROM y WHERE n > 1) GROUP BY 1),
    l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{_SPACE}]')) AS lines FROM o),
    m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(z.n, 0) AS n_repeat_words,
      len(lines) AS n_lines, length(t) - length(replace(t, '!', '')) AS n_shouts, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper, length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) AS n_letters FROM l LEFT JOIN z USING (r)),
    b AS (SELECT *, ({bits})::BIGINT AS failed_bits FROM m)
    SELECT *, '{policy}' AS policy, failed_bits & {mask('base')} <> 0 AS base_failed, failed_bits & {mask(policy) | mask('base')} = 0 AS kept FROM b"""


def ablations_sql(docs: str = "documents", policy: str = "v2") -> str:
    """The ablations in DuckDB's SQL, straight from the failure bits of every document."""
    rules = ", ".join(f"('{policy}', '{r}', {bit(r)}::BIGINT)" for r in POLICIES[policy])
    return f"""WITH q AS ({sql(docs, policy)}), r(policy, rule, bit) AS (VALUES {rules}), f AS (SELECT failed_bits & {mask(policy)} AS bits FROM q)
    SELECT policy, rule, bit, count(*) FILTER (bits & bit <> 0) AS n_failed, count(*) FILTER (bits = bit) AS n_failed_alone, count(*) FILTER (bits <> 0 AND bits & (~bit) = 0) AS n_passed_without FROM r LEFT JOIN f ON true GROUP BY ALL"""
