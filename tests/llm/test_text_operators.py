"""Quality, language, BPE, token files: brute force, the tokenizers library, held-out accuracy, odd rows."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.llm import bpe, language, quality, store
from driftline.llm.queries import QUERIES, vocabulary

WORD = re.compile("[^\x20\x09-\x0d]+")
ODD = [None, "", " ", "a", "a b c d e f g h i j", "x y z w v " * 3, "<|endoftext|> a<|endoftext|>", "don't  can't\t\n  x", "日本語 🙂🙂 é b", "the " * 3000, "a\n\na\n a\nb # *", "uuuuuu aaaaaaa", "\x1c\x85 nbsp"]


def table(spark, texts, extra=True):
    rows = [(i, t, "en", "noise", 1.0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, ids string, n_words double")
    return df if extra else df.select("doc_id", "text")


def brute_measures(t):
    t = t or ""
    words, places = WORD.findall(t), defaultdict(list)
    for i in range(len(words) - 4):
        places[tuple(words[i : i + 5])].append(i)
    covered = {j for v in places.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_quality_measures(spark, sf_dir):
    docs = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()] + ODD + ODD[:3]
    got = {r["doc_id"]: r for r in quality.quality(table(spark, docs)).collect()}
    assert len(got) == len(docs)
    for i, t in enumerate(docs):
        r = got[i]
        want = brute_measures(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["base_failed"] and r["kept"])
    assert quality.quality(table(spark, docs).limit(0)).count() == 0


def test_quality_keeps_clean_documents(spark, sf_dir):
    rows = QUERIES["op7_quality_rules"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").collect()
    clean = [r["kept"] for r in rows if r["quality"] == 1 and not r["base_failed"]]
    junk = [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(clean) == len(clean) and not any(junk)


def test_ablations(spark, sf_dir):
    rows = quality.ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")).cache()
    bits = [r["failed_bits"] for r in rows.collect()]
    for r in quality.ablations(rows, "v2").collect():
        assert r["n_failed"] == sum(bool(b & r["bit"]) for b in bits)
        assert r["n_failed_alone"] == sum((b & quality.mask("v2")) == r["bit"] for b in bits)


def test_language_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = QUERIES["op10_language"](spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_odd_rows(spark, sf_dir):
    model = language.train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    got = {r["doc_id"]: r for r in language.predicted(table(spark, [*ODD, "123 !!", "\n"]), model).collect()}
    assert len(got) == len(ODD) + 2
    for i in (0, 1, 2, len(ODD), len(ODD) + 1):
        assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
    assert got[3]["lang_pred"] in model.langs and got[3]["ids"] == "noise"
    nothing = language.train(table(spark, ODD).limit(0))
    assert {r["lang_pred"] for r in language.predicted(table(spark, ODD), nothing).collect()} == {"und"}


def test_mixture_shares(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) > 1500")
    model = language.train(docs)
    en, fr = (docs.where(F.col("lang") == x).orderBy("doc_id").first()["text"].split()[:150] for x in ("en", "fr"))
    got = language.predicted(table(spark, [" ".join(en + fr[:100])]), model).first()
    assert got["lang_pred"] == "en" and got["n_langs"] >= 2 and got["score"] == pytest.approx(0.6, abs=0.12)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_str(vocabulary())


def test_automaton_equals_library(library, sf_dir):
    made, memo = bpe.automaton(vocabulary())
    rng = np.random.default_rng(5)
    texts = [t or "" for t in ODD] + ["".join(rng.choice(list("aehint é\n\t .,'1🙂"), rng.integers(1, 60))) for _ in range(500)]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(bpe.encode_bytes(t, made, memo), "<u4").tolist() == ids
        assert made.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_automaton_rules():
    """A small vocabulary against plain greedy merging, over every word of up to six letters."""
    import itertools
    import json

    merges = [("a", "b"), ("b", "b"), ("ab", "b"), ("a", "a"), ("aa", "ab"), ("b", "a")]
    pieces = ["a", "b", *dict.fromkeys(x + y for x, y in merges)]
    made = bpe.Automaton(json.dumps({"model": {"vocab": {p: i for i, p in enumerate(pieces)}, "merges": merges}}))
    for n in range(1, 7):
        for word in itertools.product("ab", repeat=n):
            parts = list(word)
            while True:
                ranks = [(merges.index((x, y)), i) for i, (x, y) in enumerate(itertools.pairwise(parts)) if (x, y) in merges]
                if not ranks:
                    break
                rank = min(ranks)[0]
                out, i = [], 0
                while i < len(parts):
                    if tuple(parts[i : i + 2]) == merges[rank]:
                        out.append(parts[i] + parts[i + 1])
                        i += 2
                    else:
                        out.append(parts[i])
                        i += 1
                parts = out
            assert [pieces[t] for t in made.word("".join(word).encode())] == parts


def test_bpe_query(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in QUERIES["op9_bpe"](spark, sf_dir).collect()}
    for r in docs:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert got[r["doc_id"]]["n_tokens"] == len(ids)
        assert got[r["doc_id"]]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_odd_rows(spark):
    coded = bpe.encoded(table(spark, ODD), vocabulary())
    back = {r["doc_id"]: r for r in bpe.decoded(coded, vocabulary()).collect()}
    assert [back[i]["decoded"] for i in range(len(ODD))] == [t or "" for t in ODD]
    assert bpe.digests(table(spark, ODD).limit(0), vocabulary()).count() == 0


def test_store_equals_library(spark, sf_dir, library):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    got = {r["doc_id"]: r for r in QUERIES["op8_token_files"](spark, sf_dir).collect()}
    start = 0
    for i, t in docs:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_store_odd_rows(spark, library):
    rows = spark.createDataFrame([(5, "b a"), (5, "b a"), (None, "x"), (-3, None), (7, ""), (5, "a")], "doc_id long, text string")
    made, keys = store.write_store(rows.withColumn("shard", F.lit("clash")), vocabulary())
    got = sorted((r["key"], r["nth"], r["start"], r["n_tokens"]) for r in made.digests(keys).collect())
    assert [(k, n) for k, n, _, _ in got] == [(-(2**63), 0), (-3, 0), (5, 0), (5, 1), (5, 2), (7, 0)]
    assert [s for _, _, s, _ in got] == np.cumsum([0, *(n for *_, n in got)])[:-1].tolist()
    assert made.get(5).tolist() == [*library.encode("a", add_special_tokens=False).ids, 0] and made.get(7).tolist() == [0]
    assert made.get(12345) is None
    made, keys = store.write_store(rows.limit(0), vocabulary())
    assert made.digests(keys).count() == 0


def test_minimal_hash():
    keys = np.unique(np.random.default_rng(2).integers(0, 2**63, 2000, dtype=np.uint64))
    for n in (1, 2, 7, 2000):
        seeds = store.minimal_hash(keys[:n])
        assert sorted(store._slot(keys[:n], seeds, n)) == list(range(n))


def test_store_get(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(40)
    made, keys = store.write_store(docs, vocabulary())
    buckets = {r["key"]: r["b"] for r in keys.select("key", made.bucket().alias("b")).collect()}
    for r in docs.collect():
        assert made.bucket_of(r["doc_id"]) == buckets[r["doc_id"]]
        assert made.get(r["doc_id"]).tolist() == [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0]
    assert made.get(10**12) is None


def test_mixture_equals_brute_force(spark):
    """Proportions by a plain EM over the words of a text, from the model's own trigram likelihoods."""
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("le chat et le chien", "fr")] * 4)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    given = ["the dog and der hund und die katze", "le chat", "12 34", None, "the cat " * 3000, "le chat"]
    got = {r["doc_id"]: r for r in language.predicted(spark.createDataFrame(list(enumerate(given)), "doc_id long, text string"), model).collect()}
    for k in (0, 1, 4):
        words = [w for w in given[k].split()]
        like = []
        for w in words:
            logs = sum(model.logs[model.grams.get(g, len(model.grams))] for g in language._grams(w))
            like.append([math.exp(x - max(logs)) for x in logs])
        share = [1 / len(model.langs)] * len(model.langs)
        for _ in range(8):
            new = [0.0] * len(share)
            for row in like:
                total = sum(p * s for p, s in zip(row, share))
                for j, p in enumerate(row):
                    new[j] += p * share[j] / total
            share = [x / len(words) for x in new]
        assert got[k]["lang_pred"] == model.langs[max(range(len(share)), key=lambda j: share[j])]
    assert got[1]["lang_pred"] == got[5]["lang_pred"] and got[1]["score"] == got[5]["score"]
    assert got[2]["lang_pred"] == got[3]["lang_pred"] == "und" and got[2]["score"] == 0


def test_ablations_sum_up(spark, sf_dir):
    rows = quality.ledger(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep_text=False)
    bits = [r["failed_bits"] for r in rows.collect()]
    mask = quality.mask("v2")
    for r in quality.ablations(rows, "v2").collect():
        assert r["n_failed"] == sum(bool(b & r["bit"]) for b in bits)
        assert r["n_failed_alone"] == r["n_passed_without"] == sum(b & mask == r["bit"] for b in bits)


def test_minimal_hash_tries_groups_together(monkeypatch):
    """Slots of the first tries are worked out for many groups at once, not group by group."""
    calls, mix = [], store._mix
    monkeypatch.setattr(store, "_mix", lambda x, seed: calls.append(1) or mix(x, seed))
    keys = np.random.default_rng(8).integers(0, 2**63, 256).astype(np.uint64)
    seeds = store.minimal_hash(keys)
    assert len(calls) < len(seeds)
    assert sorted(store._slot(keys, seeds, len(keys))) == list(range(len(keys)))
