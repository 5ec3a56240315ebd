"""Fill-in-middle: a distinct-text index with Elias-Fano lists of line ends, and a seeded cut of every document.

Documents with the same text are one entry of the index. They are told by the SHA-256 digest of the whole text and its
length, so entries never mix contents; copies are put together where they are read, and a text is shuffled to its entry
once, with the keys of the documents that have it, which are joined back to the entry there. The ends of an entry's lines are worked out once and kept as an Elias-Fano
list (about two bits a line beyond its low bits) of which any end is read without the others; a document's cut selects
two of them. A text that a large share of all rows have gets several entries, to which its documents are dealt, so no
entry has more than its share of keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.llm.common import partitions

#: Fixed values of the format: before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ORDERS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}


def ends(text: bytes) -> np.ndarray:
    """Byte offsets behind each line, a last line without a line feed included."""
    found = np.flatnonzero(np.frombuffer(text, np.uint8) == 10).astype(np.int64) + 1
    return found if not len(text) or (len(found) and found[-1] == len(text)) else np.append(found, len(text))


def ef_encode(values: np.ndarray) -> bytes:
    """Rising whole numbers as an Elias-Fano list: their number, the width of the low bits, low bits, unary high parts."""
    n = len(values)
    if not n:
        return bytes(9)
    width = max(0, int(values[-1] // n).bit_length() - 1)
    low = (values[:, None] >> np.arange(width) & 1).astype(np.uint8) if width else np.zeros((n, 0), np.uint8)
    high = np.zeros(int(values[-1] >> width) + n, np.uint8)
    high[(values >> width) + np.arange(n)] = 1
    return n.to_bytes(8, "little") + bytes([width]) + np.packbits(low.ravel(), bitorder="little").tobytes() + np.packbits(high, bitorder="little").tobytes()


def ef_size(coded: bytes) -> int:
    return int.from_bytes(coded[:8], "little")


def ef_select(coded: bytes, i: int) -> int:
    """The ``i``-th value: the place of the ``i``-th one among the high bits, by counts of bits, and its low bits."""
    n, width = ef_size(coded), coded[8]
    start = 9 + -(-n * width // 8)
    high = np.frombuffer(coded, np.uint8, offset=start)
    before = np.cumsum(np.bitwise_count(high), dtype=np.int64)
    at = int(np.searchsorted(before, i, side="right"))
    left = i - (int(before[at - 1]) if at else 0)
    place = 8 * at + [b for b in range(8) if high[at] >> b & 1][left]
    first = i * width
    bits = int.from_bytes(coded[9 + first // 8 : 9 + -(-(first + width) // 8)], "little") >> first % 8
    return (place - i) << width | bits & (1 << width) - 1


def cut(coded: bytes, key: str, seed: int, fim_rate: int, spm_rate: int) -> tuple[str, int, int]:
    """The form that a document's draws give, and where in its bytes the prefix and the middle end."""
    drawn = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(drawn[at : at + 8], 16) for at in (0, 8, 16, 24))
    n = ef_size(coded)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    form = "plain" if h3 % 100 >= fim_rate else "spm" if h4 % 100 < spm_rate else "psm"
    return form, *(ef_select(coded, u - 1) if u else 0 for u in (a, b))


def transform(text: str, form: str, prefix: str, middle: str, suffix: str) -> str:
    part = {PREFIX: prefix, SUFFIX: suffix, MIDDLE: middle}
    return text if form == "plain" else "".join(mark + part[mark] for mark in ORDERS[form])


def restore(output: str, form: str) -> str:
    """The text again: the parts between the three marks, which no cut text holds, in their first order."""
    if form == "plain":
        return output
    marks = ORDERS[form]
    rest, last = output.split(marks[2])
    first, second = rest.removeprefix(marks[0]).split(marks[1])
    part = dict(zip(marks, (first, second, last)))
    return part[PREFIX] + part[MIDDLE] + part[SUFFIX]


ENDS = T.StructType([T.StructField("ends", T.BinaryType()), T.StructField("marked", T.BooleanType())])


@F.pandas_udf(ENDS)
def _entries(text: pd.Series) -> pd.DataFrame:
    marked = [any(mark in t for mark in (PREFIX, SUFFIX, MIDDLE)) for t in text]
    return pd.DataFrame({"ends": [ef_encode(ends(t.encode())) for t in text], "marked": marked})


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _key(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit(""))


def slices_of(df: DataFrame, text: str) -> tuple[DataFrame, int]:
    """Texts with more than their share of the rows as ``(digest, slices)``, and how many rows a slice holds.

    The share is a part of the whole by the number of shuffle partitions, so this table has fewer rows than four times
    that number, whatever the size of ``df``.
    """
    share = max(4096, -(-df.count() // (4 * partitions(df.sparkSession))))
    counted = df.groupBy(_digest(F.coalesce(text, F.lit(""))).alias("digest")).agg(F.count("*").alias("n")).where(F.col("n") > share)
    return counted.select("digest", F.ceil(F.col("n") / share).cast("int").alias("slices")), share


def index(df: DataFrame, key: str, text: str, slices: DataFrame) -> DataFrame:
    """One entry ``(digest, size, slice, text, ends, marked, keys)`` for each distinct text, or slice of its rows.

    ``keys`` are those of the rows that have the text, so that they are joined back without a shuffle of their own; a
    slice bounds their number. Copies are put together before the shuffle, which thus moves a text once a task at most.
    """
    rows = df.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"), F.xxhash64(F.monotonically_increasing_id()).alias("deal"))
    rows = rows.withColumns({"digest": _digest(F.col("text")), "size": F.octet_length("text").cast("long")})
    dealt = rows.join(F.broadcast(slices), "digest", "left").withColumn("slice", F.coalesce(F.pmod("deal", "slices"), F.lit(0)).cast("int"))
    found = dealt.groupBy("digest", "size", "slice").agg(F.first("text").alias("text"), F.collect_list(F.struct("key")).alias("keys"))
    return found.withColumn("e", _entries("text")).select("digest", "size", "slice", "text", "e.ends", "e.marked", "keys")


def _cut_rows(seed: int, fim_rate: int, spm_rate: int, digest: bool):
    fields = [("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType()), ("restored", T.StringType())]

    @F.pandas_udf(T.StructType([T.StructField(n, t) for n, t in fields]))
    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for keys, texts, coded, marked in parts:
            rows = []
            for key, text, e, plain in zip(keys, texts, coded, marked):
                form, a, b = cut(e, key, seed, fim_rate, spm_rate)
                if plain or not text:
                    form = "plain"
                raw = text.encode()
                prefix, middle, suffix = (p.decode() for p in (raw[:a], raw[a:b], raw[b:]))
                output = transform(text, form, prefix, middle, suffix)
                back = restore(output, form)
                if digest:
                    output, back = (hashlib.sha256(x.encode()).hexdigest() for x in (output, back))
                rows.append((form, None if form == "plain" else len(prefix), None if form == "plain" else len(middle), output, back))
            out = pd.DataFrame(rows, columns=[n for n, _ in fields])
            yield out.assign(prefix_chars=out["prefix_chars"].astype("Int64"), middle_chars=out["middle_chars"].astype("Int64"))

    return run


def _joined(df: DataFrame, key: str, text: str) -> DataFrame:
    """Every document with its entry: ``(key, text, ends, marked)``, one row for each row."""
    entries = index(df, key, text, slices_of(df, text)[0])
    return entries.select(F.explode("keys").alias("k"), "text", "ends", "marked").select("k.key", "text", "ends", "marked")


def cut_documents(df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 7, fim_rate: int = 100, spm_rate: int = 50) -> DataFrame:
    """Documents cut for fill-in-middle: key, ``n`` lines, ``form``, ``prefix_chars``, ``middle_chars``, ``output``, ``restored``.

    Two draws of the document's key choose the lines between which the middle lies, a third whether it is cut at all, a
    fourth the order of the parts. A null text counts as empty; an empty text and one that holds a mark stay plain, with
    null lengths. A null key draws as the empty string. Rows that repeat a key and text come out as often as they go in,
    cut alike; other columns are left out; texts of any length are cut whole; an empty table gives an empty one.
    ``restored`` is the text rebuilt from the output and form alone.
    """
    return _cut(df, key, text, seed, fim_rate, spm_rate, False)


def digests(df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 7, fim_rate: int = 100, spm_rate: int = 50) -> DataFrame:
    """The same with hexadecimal SHA-256 digests, ``output_sha256`` and ``restored_sha256``, in place of the texts."""
    return _cut(df, key, text, seed, fim_rate, spm_rate, True)


def _cut(df: DataFrame, key: str, text: str, seed: int, fim_rate: int, spm_rate: int, digest: bool) -> DataFrame:
    rows = _joined(df, key, text)
    size = F.when(F.length("ends") > 0, F.conv(F.hex(F.reverse(F.substring("ends", 1, 8))), 16, 10).cast("long"))
    found = rows.select(F.col("key").alias(key), size.alias("n"), _cut_rows(seed, fim_rate, spm_rate, digest)(_key(F.col("key")), "text", "ends", "marked").alias("c"))
    end = "_sha256" if digest else ""
    return found.select(key, "n", "c.form", "c.prefix_chars", "c.middle_chars", F.col("c.output").alias("output" + end), F.col("c.restored").alias("restored" + end))


def sql(table: str = "documents", seed: int = 7, fim_rate: int = 100, spm_rate: int = 50) -> str:
    """The digests in DuckDB's SQL, straight from the definition."""
    draw = lambda at: f"('0x' || substr(h, {at}, 8))::BIGINT"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS h, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS units FROM {table}),
    e AS (SELECT *, len(units) AS n, {draw(1)} % (len(units) + 1) AS u, {draw(9)} % (len(units) + 1) AS v,
      CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR {draw(17)} % 100 >= {fim_rate} THEN 'plain' WHEN {draw(25)} % 100 < {spm_rate} THEN 'spm' ELSE 'psm' END AS form FROM d),
    p AS (SELECT *, array_to_string(units[1:least(u, v)], '') AS prefix, array_to_string(units[least(u, v) + 1:greatest(u, v)], '') AS middle, array_to_string(units[greatest(u, v) + 1:], '') AS suffix FROM e)
    SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END) AS output_sha256,
      sha256(text) AS restored_sha256 FROM p"""
