"""Language identification as inference in a mixture of languages.

Each language has a character-trigram model. A document's words are drawn from a mixture of languages whose
proportions are estimated by expectation maximisation; how many languages it is written in is chosen by
penalised likelihood, one more language having to raise the log-likelihood by more than its penalty.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import runs_of_rows

UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_CHARS = 1 << 20  # characters worked on at once in a task; bounds memory, changes no result


def _grams(word: str) -> list[str]:
    core = f" {''.join(filter(str.isalpha, word))} "
    return [core[i : i + 3] for i in range(len(core) - 2)]


def _count_grams(batches):
    """Trigram counts by language, summed over each batch before anything is shuffled."""
    for pdf in batches:
        words: dict[str, Counter] = {}
        for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
            words.setdefault(lang, Counter()).update(text.lower().split())
        rows = []
        for lang, seen in words.items():
            grams: Counter = Counter()
            for word, n in seen.items():
                for g in _grams(word):
                    grams[g] += n
            rows += [(lang, g, n) for g, n in grams.items()]
        yield pd.DataFrame(rows, columns=["lang", "gram", "n"])


class Model:
    """Log-probabilities of trigrams by language: small, since it is learnt from a bounded sample."""

    def __init__(self, langs: list[str], grams: dict[str, int], logs: np.ndarray):
        self.langs, self.grams, self.logs = langs, grams, logs


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows_per_lang: int = 5_000, smoothing: float = 0.5) -> Model:
    """Learn from at most about ``rows_per_lang`` rows of each language, picked by a hash of the key.

    That bound is the only limit: it keeps the model's size and cost from growing with the corpus. Rows with a
    null text or language are not learnt from; with no rows left the model knows no language.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not totals:
        return Model([], {}, np.zeros((0, 0)))
    share = F.create_map(*[F.lit(x) for k, n in sorted(totals.items()) for x in (k, min(1.0, rows_per_lang / n))])
    drawn = F.pmod(F.xxhash64("key", F.lit(17)), F.lit(1_000_000)) / F.lit(1_000_000.0)
    counted = rows.where(drawn < F.element_at(share, F.col("lang"))).select("lang", "text").mapInPandas(_count_grams, "lang string, gram string, n long")
    found = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect()
    langs = sorted(totals)
    grams = {g: i for i, g in enumerate(sorted({r["gram"] for r in found}))}
    counts = np.zeros((len(grams) + 1, len(langs)))  # the last row: trigrams never seen
    for r in found:
        counts[grams[r["gram"]], langs.index(r["lang"])] = r["n"]
    return Model(langs, grams, np.log((counts + smoothing) / (counts + smoothing).sum(0)))


class _Words:
    """Likelihood rows of the words met so far in this task; emptied when it grows past a bound."""

    def __init__(self, model: Model, limit: int = 200_000):
        self.model, self.limit = model, limit
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.likelihood = np.zeros((1024, len(self.model.langs)))
        self.shift = np.zeros(1024)

    def codes(self, texts: list[list[str]]) -> np.ndarray:
        if len(self.rows) > self.limit:
            self.clear()
        new = [w for w in {w for t in texts for w in t} if w not in self.rows]
        if new:
            get, none = self.model.grams.get, len(self.model.grams)
            flat, starts, known = [], [], []
            for w in new:
                starts.append(len(flat))
                g = [get(x, none) for x in _grams(w)]
                known.append(bool(g) and len(w) > 0 and any(map(str.isalpha, w)))
                flat += g or [none]
            total = np.add.reduceat(self.model.logs[np.array(flat)], np.array(starts), axis=0)
            total[~np.array(known)] = 0  # a word without letters speaks for no language
            first, size = len(self.rows), len(self.rows) + len(new)
            if size > len(self.shift):
                room = 2 * size
                self.likelihood = np.resize(self.likelihood, (room, total.shape[1]))
                self.shift = np.resize(self.shift, room)
            top = total.max(1)
            self.likelihood[first:size], self.shift[first:size] = np.exp(total - top[:, None]), top
            self.rows.update(zip(new, range(first, size), strict=True))
        get = self.rows.__getitem__
        return np.fromiter((get(w) for t in texts for w in t), np.int64, sum(map(len, texts)))


def _em(like: np.ndarray, doc: np.ndarray, starts: np.ndarray, sizes: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihoods (without the words' shifts) of documents over their allowed languages."""
    share = allowed / allowed.sum(1, keepdims=True)
    for _ in range(rounds):
        part = like * share[doc]
        part /= np.maximum(part.sum(1, keepdims=True), 1e-300)
        share = np.add.reduceat(part, starts, axis=0) / sizes[:, None]
    fit = np.log(np.maximum((like * share[doc]).sum(1), 1e-300))
    return share, np.add.reduceat(fit, starts)


def _infer(words: list[list[str]], memory: _Words, rounds: int, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """For non-empty word lists: proportions over the chosen languages, and their number."""
    codes = memory.codes(words)
    like = memory.likelihood[codes]
    sizes = np.array([len(w) for w in words])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    doc = np.repeat(np.arange(len(words)), sizes)
    full, _ = _em(like, doc, starts, sizes, np.ones((len(words), like.shape[1])), rounds)
    rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1)
    best = number = score = None
    for k in range(1, like.shape[1] + 1):
        share, fit = _em(like, doc, starts, sizes, (rank < k).astype(float), 0 if k == 1 else rounds)
        value = fit - penalty * (k - 1) * np.log(np.maximum(sizes, 2))
        if best is None:
            best, number, score = share, np.ones(len(words), np.int64), value
        else:
            better = (value > score) & (number == k - 1)
            if not better.any():
                break
            best[better], number[better], score[better] = share[better], k, value[better]
    return best, number


def predicted(docs: DataFrame, model: Model, text: str = "text", rounds: int = 8, penalty: float = 4.0, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (the share of its words in that language) and ``n_langs``.

    A text that is null or has no letter gets ``und`` and 0, and so does every text if no language was learnt.
    Equal shares are settled by the language's name. Columns of those names are replaced; the others stay, but for the
    text without ``keep_text``. Rows may repeat, keys may be null, and texts of any length are read whole.
    """
    own = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score", "n_langs") and (keep_text or f.name != text)]
    names = [f.name for f in own]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of bounded size, see train()

    def run(batches):
        model = shared.value
        memory = _Words(model)
        for whole in batches:
            for pdf in runs_of_rows(whole, text, _CHARS):
                texts = pdf[text].tolist()
                fit = [i for i, t in enumerate(texts) if t and model.langs and _LETTER.search(t)]
                lang, score, n = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), np.int32)
                if fit:
                    share, number = _infer([texts[i].lower().split() for i in fit], memory, rounds, penalty)
                    top = share.argmax(1)
                    score[fit], n[fit] = np.clip(share[np.arange(len(fit)), top], 0, 1), number
                    for i, t in zip(fit, top, strict=True):
                        lang[i] = model.langs[t]
                yield pdf[names].assign(lang_pred=lang, score=score, n_langs=n)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own)
    return docs.mapInPandas(run, f"{fields}, lang_pred string, score double, n_langs int")


def held_out(key: str = "doc_id"):
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(4)) == 2
