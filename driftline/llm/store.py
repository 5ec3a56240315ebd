"""Token-id files with a minimal perfect hash index.

A store is a folder of
* ``shard-<n>.ids``: 16 bytes of header (magic, version, bytes an id, shard number), then the ids of its
  documents one after the other, in ascending key order, each document closed by the end id;
* ``index-<p>.mph``: for the keys of hash bucket p, a minimal perfect hash (one seed for each group of a few
  keys) and, in the order it gives, a stored fingerprint and the place: shard, offset, length, start.

A key is looked up by hashing it to a bucket, hashing it to a group, and hashing it with the group's seed to its
slot: three steps and four small reads whatever the number of documents. The fingerprint rejects keys that were never stored.

Shards and index files are written by the tasks under an attempt's own name and then renamed, and what was
written is known from the table the tasks return, so a lost executor only repeats its own files.
"""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pandas as pd
import xxhash
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import bpe
from driftline.llm.common import new_path, partitions, runs_of_rows, written

MAGIC, VERSION = b"DLID", 1
HEADER, INDEX_HEADER = "<4sHHQ", "<4sHHQQ"
HEADER_BYTES, INDEX_HEADER_BYTES = struct.calcsize(HEADER), struct.calcsize(INDEX_HEADER)
SLOT = np.dtype([("fingerprint", "<u4"), ("shard", "<u4"), ("n_tokens", "<u8"), ("offset", "<u8"), ("start", "<u8")])
MAX_BUCKETS = 65_536  # bounds the number of index files
GROUP_KEYS = 4
_SPAN = 8 << 20  # bytes of neighbouring payloads read at once


def _open(uri: str):
    return arrow_fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def _put(files, own: str, path: str) -> None:
    """Rename; where a file system does not rename onto a file that a lost attempt left, that file goes first."""
    try:
        files.move(own, path)
    except OSError:
        if files.get_file_info(path).type == arrow_fs.FileType.NotFound:
            raise
        files.delete_file(path)
        files.move(own, path)


def _write_whole(uri: str, data_parts) -> None:
    """Write under a name of this attempt's own, then rename: a repeated task replaces whole files only."""
    files, path = _open(uri)
    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
    context = TaskContext.get()
    own = f"{path}.{context.taskAttemptId() if context else 0}.tmp"
    with files.open_output_stream(own) as out:
        for part in data_parts:
            out.write(part)
    _put(files, own, path)


def _mix(x: np.ndarray, seed) -> np.ndarray:
    """A 64-bit finaliser over uint64 arrays (wrapping arithmetic)."""
    x = (x + np.uint64(0x9E3779B97F4A7C15) * (np.atleast_1d(np.asarray(seed, np.uint64)) + np.uint64(1))).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _free(slots: np.ndarray, taken: np.ndarray) -> int | None:
    """The first column of ``slots`` whose slots are all free and differ from one another."""
    for k in np.flatnonzero(~np.logical_or.reduce(taken[slots], 0)).tolist():
        if len(slots) == 1 or len(set(slots[:, k].tolist())) == len(slots):
            return k
    return None


def minimal_hash(keys: np.ndarray) -> np.ndarray:
    """Seeds of the groups, by which _slot() maps the distinct uint64 ``keys`` one to one onto 0..n-1.

    Hash and displace: groups from the largest on try seeds until all their keys fall on free slots.
    """
    n = len(keys)
    n_groups = max(1, -(-n // GROUP_KEYS))
    group = (_mix(keys, 0) % np.uint64(n_groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    bounds = np.searchsorted(group[order], np.arange(n_groups + 1))
    seeds, taken = np.zeros(n_groups, "<u4"), np.zeros(n, bool)
    tries, more = np.arange(1, 97, dtype=np.uint64), np.arange(1, 513, dtype=np.uint64)
    sizes = np.diff(bounds)
    by_size = np.argsort(-sizes, kind="stable")
    by_size = by_size[: np.count_nonzero(sizes)]
    # The first tries of many groups at once, one by one only what is free of them, and more tries for groups that found none.
    for k in range(0, len(by_size), 1024):
        some = by_size[k : k + 1024]
        at = np.repeat(bounds[some] - np.cumsum(sizes[some]) + sizes[some], sizes[some]) + np.arange(sizes[some].sum())
        first = _mix(keys[order[at]][:, None], tries[None, :]) % np.uint64(n)
        columns, end = first.astype(np.int64), 0
        for g in some.tolist():
            own, begin = keys[order[bounds[g] : bounds[g + 1]]], end
            end += len(own)
            slots, before = columns[begin:end], 0
            while (found := _free(slots, taken)) is None:
                before += slots.shape[1]
                slots = (_mix(own[:, None], (more + np.uint64(before))[None, :]) % np.uint64(n)).astype(np.int64)
            seeds[g] = before + found + 1
            taken[slots[:, found]] = True
    return seeds


def _slot(keys: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    group = (_mix(keys, 0) % np.uint64(len(seeds))).astype(np.int64)
    return (_mix(keys, seeds[group].astype(np.uint64)) % np.uint64(n)).astype(np.int64)


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 0xF1A9) >> np.uint64(32)).astype("<u4")


def _codes(pdf: pd.DataFrame) -> np.ndarray:
    """What is hashed: the key itself, or for the nth row of a repeated key the key moved by n."""
    keys, nth = pdf["key"].to_numpy(np.int64).astype(np.uint64), pdf["nth"].to_numpy(np.int64).astype(np.uint64)
    return np.where(nth > 0, keys ^ _mix(nth, 0xD0C), keys)


def _index_file(folder: str, bucket: int) -> str:
    return f"{folder}/index-{bucket:05d}.mph"


def _shard_file(folder: str, shard: int) -> str:
    return f"{folder}/shard-{shard:06d}.ids"


def _write_index(folder: str):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = _codes(pdf)
        seeds = minimal_hash(keys)
        slots = np.zeros(len(keys), SLOT)
        at = _slot(keys, seeds, len(keys))
        for name in ("shard", "n_tokens", "offset", "start"):
            slots[name][at] = pdf[name].to_numpy()
        slots["fingerprint"][at] = _fingerprint(keys)
        bucket = int(pdf["bucket"].iloc[0])
        _write_whole(_index_file(folder, bucket), [struct.pack(INDEX_HEADER, MAGIC, VERSION, 0, len(keys), len(seeds)), seeds.tobytes(), slots.tobytes()])
        return pd.DataFrame({"bucket": [bucket], "keys": [len(keys)]})

    return build


def _look_up(folder: str):
    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = _codes(pdf)
        files, path = _open(_index_file(folder, int(pdf["bucket"].iloc[0])))
        with files.open_input_file(path) as source:
            data = source.read()
        _, _, _, n, n_seeds = struct.unpack_from(INDEX_HEADER, data)
        seeds = np.frombuffer(data, "<u4", n_seeds, INDEX_HEADER_BYTES)
        slots = np.frombuffer(data, SLOT, n, INDEX_HEADER_BYTES + 4 * n_seeds)
        found = slots[_slot(keys, seeds, n)]
        held = found["fingerprint"] == _fingerprint(keys)
        out = pd.DataFrame({"key": pdf["key"], "nth": pdf["nth"], **{name: found[name].astype(np.int64) for name in ("shard", "n_tokens", "offset", "start")}})
        return out[held]

    return search


def _encode_shards(folder: str, vocabulary, end_id: int, width: int):
    """Tasks of one range of keys each, sorted: write the shard, return a row for each document."""

    def run(batches):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        memo = _memo(vocabulary.value, Tokenizer, width)
        shard = TaskContext.get().partitionId()
        closing = end_id.to_bytes(width, "little")
        uri = _shard_file(folder, shard)
        files, path = _open(uri)
        files.create_dir(path.rsplit("/", 1)[0], recursive=True)
        own, offset, out = f"{path}.{TaskContext.get().taskAttemptId()}.tmp", HEADER_BYTES, None
        last, seen = None, 0
        for pdf in (part for whole in batches for part in runs_of_rows(whole, "text")):
            if out is None:
                out = files.open_output_stream(own)
                out.write(struct.pack(HEADER, MAGIC, VERSION, width, shard))
            payloads = [p + closing for p in memo.many(pdf["text"].tolist())]
            out.write(b"".join(payloads))
            sizes = np.fromiter(map(len, payloads), np.int64, len(payloads))
            ends = offset + np.cumsum(sizes)
            nth = []
            for key in pdf["doc_id"]:
                seen = seen + 1 if key == last else 0
                last = key
                nth.append(seen)
            yield pd.DataFrame({"key": pdf["doc_id"], "nth": nth, "shard": shard, "offset": ends - sizes, "n_tokens": sizes // width})
            offset = int(ends[-1])
        if out is not None:
            out.close()
            _put(files, own, path)

    return run


class _Pieces:
    """The tokenizers library over whole texts, with the ids of pieces that recur kept in two bounded generations."""

    SEP = "<|endoftext|>"

    def __init__(self, vocabulary: str, kind, width: int, limit: int = 500_000):
        self.tokenizer, self.dtype, self.limit = kind.from_str(vocabulary), f"<u{width}", limit
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        sep = self.tokenizer.token_to_id(self.SEP)
        added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.sep = sep if added == {self.SEP} else None
        # Byte-level vocabularies write a space as U+0120 and a line end as U+010A.
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        self.spaced = np.array([x.startswith("\u0120") for x in names])
        self.line_end = np.array([x == "\u010a" for x in names])
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _split(self, parts: list[str]) -> list[bytes]:
        """Ids of any pieces: the special token between two of them is a border, and shows where to cut."""
        ids = np.array(self.tokenizer.encode(self.SEP.join(parts), add_special_tokens=False).ids, self.dtype)
        borders = np.flatnonzero(ids == self.sep)
        return [(own[1:] if len(own) and own[0] == self.sep else own).tobytes() for own in np.split(ids, borders)]

    def _words(self, parts: list[str], before: str = "") -> list[bytes]:
        """Ids of words of letters, all with a space in front or all after a line end: written one after the other.

        Only a word's first token holds its space (or is the line end), which shows where to cut.
        """
        ids = np.array(self.tokenizer.encode_batch_fast([before + before.join(parts)], add_special_tokens=False)[0].ids, self.dtype)
        firsts = np.flatnonzero(self.line_end[ids] if before else self.spaced[ids])
        if len(firsts) != len(parts):  # the library sees other letters than Python does
            return self._split(parts)
        begins = (firsts + (1 if before else 0)).tolist()
        ends = [*firsts[1:].tolist(), len(ids)]
        raw, width = ids.tobytes(), ids.itemsize
        return [raw[width * a : width * b] for a, b in zip(begins, ends, strict=True)]

    def _learn(self, pieces: list[str], encode) -> None:
        for k in range(0, len(pieces), 4096):
            part = pieces[k : k + 4096]
            self.new.update(zip(part, encode(part), strict=True))

    def _missing(self, pieces) -> list[str]:
        """Those in neither generation; what is found in the old one is carried over."""
        fresh = []
        for p in pieces:
            got = self.old.get(p)
            if got is None:
                fresh.append(p)
            else:
                self.new[p] = got
        return fresh

    def many(self, texts: list[str | None]) -> list[bytes]:
        cut = [[] if not t else None if self.sep is None or self.SEP in t else bpe.pieces(t) for t in texts]
        if len(self.new) > self.limit:
            self.old, self.new = self.new, {}
        fresh = self._missing(set().union(*filter(None, cut)).difference(self.new))
        words = {p: _cut(p) for p in fresh}
        spaced, bare, rest = [], [], []
        for w in self._missing(set().union(*words.values()).difference(self.new)):
            (spaced if w[0] == " " and w[1:].isalpha() else bare if w.isalpha() else rest).append(w)
        self._learn(spaced, self._words)
        self._learn(bare, lambda part: self._words(part, "\n"))
        self._learn(rest, self._split)
        self.new[""] = b""
        get = self.new.__getitem__
        for p, ws in words.items():
            if len(ws) > 1:
                self.new[p] = b"".join(map(get, ws))
        return [self._whole(t) if c is None else b"".join(map(get, c)) for t, c in zip(texts, cut, strict=True)]


def _cut(piece: str) -> list[str]:
    """The words of a piece. A space, letters, then full stops or commas, the usual case, needs no pattern."""
    core = piece.rstrip(".,")
    if core[:1] == " " and core[1:].isalpha():
        return [core, piece[len(core) :]] if len(core) < len(piece) else [piece]
    return bpe.cut_words(piece)


_memos: dict[tuple[int, int], _Pieces] = {}


def _memo(vocabulary: str, kind, width: int) -> _Pieces:
    key = hash(vocabulary), width
    if key not in _memos:
        _memos[key] = _Pieces(vocabulary, kind, width)
    return _memos[key]


def _spans(pdf: pd.DataFrame, width: int):
    """Runs of rows whose payloads lie one behind the other in a shard, of about ``_SPAN`` bytes."""
    shard, offset, size = (pdf[c].to_numpy(np.int64) for c in ("shard", "offset", "n_tokens"))
    start, at = 0, 0
    for k in range(1, len(pdf) + 1):
        at += int(size[k - 1]) * width
        if k == len(pdf) or at >= _SPAN or shard[k] != shard[start] or offset[k] != offset[k - 1] + size[k - 1] * width:
            yield start, k, at
            start, at = k, 0


def _read_payloads(folder: str, width: int):
    """Rows sorted by shard and offset: read the payloads back, neighbours at once, and return the CRC-32 of each over
    32-bit ids."""

    def run(batches):
        held, source = None, None
        for pdf in batches:
            sums = np.zeros(len(pdf), np.int64)
            sizes = pdf["n_tokens"].to_numpy(np.int64) * width
            for first, last, n in _spans(pdf, width):
                shard = int(pdf["shard"].iloc[first])
                if shard != held:
                    if source is not None:
                        source.close()
                    files, path = _open(_shard_file(folder, shard))
                    source, held = files.open_input_file(path), shard
                data, at = source.read_at(n, int(pdf["offset"].iloc[first])), 0
                for k in range(first, last):
                    sums[k] = zlib.crc32(np.frombuffer(data, f"<u{width}", int(sizes[k]) // width, at).astype("<u4").tobytes())
                    at += int(sizes[k])
            yield pdf.assign(ids_crc32=sums)
        if source is not None:
            source.close()

    return run


class TokenStore:
    """A written store. ``folder`` must be reachable by every executor."""

    def __init__(self, spark: SparkSession, folder: str, n_buckets: int, width: int):
        self.spark, self.folder, self.n_buckets, self.width = spark, folder, n_buckets, width

    def bucket(self, key: str = "key"):
        return F.pmod(F.xxhash64(key, "nth", F.lit(7)), F.lit(self.n_buckets)).cast("int")

    def places(self, keys: DataFrame) -> DataFrame:
        """Shard, offset, length and start of each row of ``keys(key, nth)``; rows whose key is not stored are left out."""
        asked = keys.select("key", "nth", self.bucket().alias("bucket"))
        return asked.groupBy("bucket").applyInPandas(_look_up(self.folder), "key long, nth long, shard long, n_tokens long, offset long, start long")

    def digests(self, keys: DataFrame) -> DataFrame:
        """Places with ``ids_crc32``, read from the shards by ranges of their bytes."""
        found = self.places(keys)
        dealt = found.repartitionByRange(partitions(self.spark), "shard", "offset").sortWithinPartitions("shard", "offset")
        return dealt.mapInPandas(_read_payloads(self.folder, self.width), "key long, nth long, shard long, n_tokens long, offset long, start long, ids_crc32 long")

    def bucket_of(self, key: int, nth: int = 0) -> int:
        """The same as ``bucket()``, without Spark."""
        h = 42
        for part in (struct.pack("<q", key), struct.pack("<q", nth), struct.pack("<i", 7)):
            h = xxhash.xxh64_intdigest(part, seed=h)
        return (h - (1 << 64) if h >> 63 else h) % self.n_buckets

    def get(self, key: int, nth: int = 0) -> np.ndarray | None:
        """The ids of one document, null if its key is not stored: three hashes and four small reads, no Spark job."""
        code = _codes(pd.DataFrame({"key": [int(key)], "nth": [nth]}))
        files, path = _open(_index_file(self.folder, self.bucket_of(int(key), nth)))
        if files.get_file_info(path).type == arrow_fs.FileType.NotFound:
            return None
        with files.open_input_file(path) as index:
            _, _, _, n, n_seeds = struct.unpack(INDEX_HEADER, index.read_at(INDEX_HEADER_BYTES, 0))
            group = int(_mix(code, 0)[0] % np.uint64(n_seeds))
            seed = np.frombuffer(index.read_at(4, INDEX_HEADER_BYTES + 4 * group), "<u4")
            slot = int(_mix(code, seed.astype(np.uint64))[0] % np.uint64(n))
            place = np.frombuffer(index.read_at(SLOT.itemsize, INDEX_HEADER_BYTES + 4 * n_seeds + SLOT.itemsize * slot), SLOT)[0]
        if place["fingerprint"] != _fingerprint(code)[0]:
            return None
        files, path = _open(_shard_file(self.folder, int(place["shard"])))
        with files.open_input_file(path) as source:
            return np.frombuffer(source.read_at(int(place["n_tokens"]) * self.width, int(place["offset"])), f"<u{self.width}")


def write_store(docs: DataFrame, vocabulary: str, end_id: int = 0, key: str = "doc_id", text: str = "text", bucket_keys: int = 256, folder: str | None = None) -> tuple[TokenStore, DataFrame]:
    """Encode ``docs`` with the tokenizers library and write a store; return it with its keys ``(key, nth)``.

    Documents are ordered by key and then text. Null texts count as empty and hold only the end id. A null key is
    stored as the smallest long, so it comes first. Rows that share a key are all stored and told apart by
    ``nth``, 0 for the first. An empty table gives a store without files. Other columns are ignored.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    width = 2 if vocabulary_size(vocabulary) <= 1 << 16 else 4
    shared = spark.sparkContext.broadcast(vocabulary)  # one vocabulary file
    rows = docs.select(F.coalesce(F.col(key), F.lit(-(2**63))).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ranged = rows.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    placed = written(ranged.mapInPandas(_encode_shards(folder, shared, end_id, width), "key long, nth long, shard long, offset long, n_tokens long"), "places")
    # Shards are ranges of keys: a shard starts after the ids of all shards before it, one row for each shard.
    totals = placed.groupBy("shard").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs")).orderBy("shard").collect()
    base, before = [], 0
    for r in totals:
        base.append((r["shard"], before))
        before += r["n"]
    n_docs = sum(r["docs"] for r in totals)
    bases = spark.createDataFrame(base, "shard long, base long")  # one row a shard
    n_buckets = max(1, min(MAX_BUCKETS, -(-n_docs // bucket_keys)))
    store = TokenStore(spark, folder, n_buckets, width)
    local = (F.col("offset") - F.lit(HEADER_BYTES)) / F.lit(width)
    entries = placed.join(F.broadcast(bases), "shard").select("key", "nth", "shard", "offset", "n_tokens", (F.col("base") + local.cast("long")).alias("start"))
    built = entries.withColumn("bucket", store.bucket()).groupBy("bucket").applyInPandas(_write_index(folder), "bucket int, keys long")
    built.agg(F.sum("keys")).collect()
    return store, placed.select("key", "nth")


def vocabulary_size(vocabulary: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_str(vocabulary).get_vocab_size(with_added_tokens=True)
