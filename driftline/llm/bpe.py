"""Byte-pair encoding by a tokenization automaton.

States are "the last token was q", arcs are tokens. The automaton starts with one state that loops on every
byte; each merge (u, v) -> w then adds a gadget: tokens u now lead to a fresh copy of their old target without
its arc v, and wherever u v could be walked an arc w is added that leads to where v led. The result accepts
exactly the token sequences that greedy merging produces, so each word has one accepted path.

All arcs at once would be vocabulary times vocabulary bits. What the gadgets do to one arc depends on that arc
alone, so the compiled form holds, for each arc, the merge that removed it: found from the gadgets that made its
two ends when the arc is first met, and kept in the transition table. Words are then encoded by table lookups
along a byte trie of the tokens; decoding emits the byte label of each arc.
"""

from __future__ import annotations

import hashlib
import json
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from driftline.llm.common import slices

#: Fixed value: how a byte-level vocabulary cuts a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NEVER = 1 << 60
_ARCS = 1_000_000  # arcs whose removal is remembered; bounds memory, changes no result
cut_words = regex.compile(WORDS).findall


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins of a byte-level vocabulary: visible Latin-1 as itself, the rest from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Automaton:
    """Compiled from the JSON of a byte-level BPE vocabulary."""

    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        ids, back = spec["model"]["vocab"], _byte_of_char()
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens") or ()}
        size = 1 + max([*ids.values(), *self.special.values()])
        self.label: list[bytes] = [b""] * size
        for piece, i in ids.items():
            self.label[i] = bytes(back[c] for c in piece)
        for content, i in self.special.items():
            self.label[i] = content.encode()
        self.born, self.left, self.right = [0] * size, [-1] * size, [-1] * size
        self.merge: dict[int, int] = {}
        self.size = size
        for n, (a, b) in enumerate(spec["model"]["merges"], 1):
            self._add_gadget(n, ids[a], ids[b], ids[a + b])
        self.removed: dict[int, int] = {}
        self.trie: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for i in ids.values():
            at = 0
            for byte in self.label[i]:
                nxt = self.trie[at].get(byte)
                if nxt is None:
                    nxt = self.trie[at][byte] = len(self.trie)
                    self.trie.append({})
                    self.ends.append(-1)
                at = nxt
            self.ends[at] = i
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _add_gadget(self, n: int, u: int, v: int, w: int) -> None:
        self.born[w], self.left[w], self.right[w] = n, u, v
        self.merge[u * self.size + v] = n

    def removal(self, q: int, t: int) -> int:
        """The merge that removed arc t from the state after q; 0 if it never was there, _NEVER if it still is."""
        key = q * self.size + t
        known = self.removed.get(key)
        if known is None:
            bq, bt = self.born[q], self.born[t]
            if bq > bt:  # q leads to where its right half led when q was made
                there = self.removal(self.right[q], t) >= bq
            elif bt:  # t was added wherever its left half could still be walked
                there = self.removal(q, self.left[t]) > bt
            else:
                there = True
            known = self.removed[key] = self.merge.get(key, _NEVER) if there else 0
        return known

    def word(self, data: bytes) -> list[int]:
        """The one accepted path of a word: longest arc first, and back where no arc leads on.

        An accepted path to a position is unique, so a position that led nowhere is never entered again.
        """
        if len(self.removed) > _ARCS:
            self.removed.clear()
        n, trie, ends, size, removed = len(data), self.trie, self.ends, self.size, self.removed
        out, starts, rest, dead = [], [], [], set()
        i = 0
        while i < n:
            at, open_arcs = 0, []
            for j in range(i, n):
                at = trie[at].get(data[j], 0)
                if not at:
                    break
                if ends[at] >= 0:
                    open_arcs.append((j + 1, ends[at]))
            while True:
                if not open_arcs:
                    dead.add(i)
                    out.pop()
                    i, open_arcs = starts.pop(), rest.pop()
                    continue
                j, t = open_arcs.pop()
                if j in dead:
                    continue
                if out:
                    gone = removed.get(out[-1] * size + t)
                    if (self.removal(out[-1], t) if gone is None else gone) != _NEVER:
                        continue
                out.append(t)
                starts.append(i)
                rest.append(open_arcs)
                i = j
                break
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a text without special tokens in it."""
        return [i for w in cut_words(text) for i in self.word(w.encode())]

    def decode(self, ids) -> str:
        return b"".join(map(self.label.__getitem__, ids)).decode("utf-8", "replace")


#: A space that another white space or nothing follows: not the start of a word.
_UNEVEN = regex.compile(r" \s| \Z")


def pieces(text: str) -> list[str]:
    """Cut a text before each space that a visible character follows; a word starts there in every encoding."""
    if "\u0000" not in text and not _UNEVEN.search(text):
        return text.replace(" ", "\u0000 ").split("\u0000")
    parts = text.split(" ")
    out = [parts[0]]
    for p in parts[1:]:
        if p and not p[0].isspace():
            out.append(" " + p)
        else:
            out[-1] += " " + p
    return out


class Memo(dict):
    """Piece -> its ids as little-endian unsigned integers, in two generations so that memory stays bounded."""

    def __init__(self, encode, limit: int = 300_000):
        super().__init__()
        self.encode, self.limit, self.old = encode, limit, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            found = array("I", self.encode(piece)).tobytes()
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        if len(piece) <= 64:
            self[piece] = found
        return found


_workers: dict[str, tuple[Automaton, Memo]] = {}


def automaton(vocabulary: str) -> tuple[Automaton, Memo]:
    """One automaton for each Python worker and vocabulary."""
    key = hashlib.sha256(vocabulary.encode()).hexdigest()
    if key not in _workers:
        made = Automaton(vocabulary)
        _workers[key] = made, Memo(made.encode)
    return _workers[key]


def encode_bytes(text: str | None, made: Automaton, memo: Memo) -> bytes:
    """Ids of a whole text as little-endian unsigned 32-bit integers; special tokens in the text count as such."""
    if not text:
        return b""
    if made.cut is None or not any(s in text for s in made.special):
        return b"".join(map(memo.__getitem__, pieces(text)))
    out = []
    for k, part in enumerate(made.cut.split(text)):
        if k % 2:
            out.append(np.array([made.special[part]], "<u4").tobytes())
        elif part:
            out += map(memo.__getitem__, pieces(part))
    return b"".join(out)


def _ids_of(texts: list[str | None], made: Automaton, memo: Memo) -> tuple[list[np.ndarray], pa.ListArray]:
    """Ids of texts, one by one and as an Arrow column over one buffer."""
    ids = [np.frombuffer(encode_bytes(t, made, memo), "<u4") for t in texts]
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    flat = np.concatenate(ids).view(np.int32) if ids else np.zeros(0, np.int32)
    return ids, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def encoded(df: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """``df`` with ``ids`` (array of int, empty for a null or empty text); a column of that name is replaced."""
    kept = [f for f in df.schema.fields if f.name != "ids"]
    names = [f.name for f in kept]
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)  # of fixed size: one vocabulary file

    def run(batches):
        made, memo = automaton(shared.value)
        for batch in (part for whole in batches for part in slices(whole, text)):
            _, column = _ids_of(batch.column(text).to_pylist(), made, memo)
            yield pa.RecordBatch.from_arrays([*batch.select(names).columns, column], [*names, "ids"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return df.mapInArrow(run, f"{fields}, ids array<int>")


def round_trips(df: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """``df`` without its text, with ``ids`` and ``round_trip``: whether decoding the ids gives the text again.

    Both ways are gone in one task, so the text and the ids cross into Python once. A null text counts as empty.
    """
    kept = [f for f in df.schema.fields if f.name not in (text, "ids", "round_trip")]
    names = [f.name for f in kept]
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        made, memo = automaton(shared.value)
        for batch in (part for whole in batches for part in slices(whole, text)):
            texts = batch.column(text).to_pylist()
            ids, column = _ids_of(texts, made, memo)
            same = [made.decode(i.tolist()) == (t or "") for i, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.select(names).columns, column, pa.array(same, pa.bool_())], [*names, "ids", "round_trip"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return df.mapInArrow(run, f"{fields}, ids array<int>, round_trip boolean")


def decoded(df: DataFrame, vocabulary: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of its ids; null ids give a null text, broken UTF-8 becomes U+FFFD."""
    kept = [f for f in df.schema.fields if f.name != out]
    names = [f.name for f in kept]
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        made, _ = automaton(shared.value)
        for batch in (whole.slice(k, 64) for whole in batches for k in range(0, whole.num_rows, 64)):
            texts = [made.decode(x.values.to_numpy(zero_copy_only=False).tolist()) if x.is_valid else None for x in batch.column(ids)]
            yield pa.RecordBatch.from_arrays([*batch.select(names).columns, pa.array(texts, pa.string())], [*names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return df.mapInArrow(run, f"{fields}, `{out}` string")


def digests(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: the key, ``n_tokens``, and SHA-256 of the ids and of the text decoded from them.

    The ids stay in the Python worker. Null texts count as empty; rows with equal or null keys stay apart.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        made, memo = automaton(shared.value)
        label = made.label.__getitem__
        for batch in (part for whole in batches for part in slices(whole, text)):
            n, a, b = [], [], []
            for t in batch.column(text).to_pylist():
                raw = encode_bytes(t, made, memo)
                ids = np.frombuffer(raw, "<u4")
                n.append(len(ids))
                a.append(hashlib.sha256(raw).hexdigest())
                back = b"".join(map(label, ids.tolist()))
                b.append(hashlib.sha256(back.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")

